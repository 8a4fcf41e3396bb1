"""Phrase collocations by prefix-free parsing.

Pieces of text are parsed into overlapping chunks: a chunk ends with a trigger, a window of `OVERLAP` words whose hash says so, and the next one begins with that
same window. Equal passages give equal chunks wherever they stand, so the corpus becomes a dictionary of distinct chunks with their frequencies in
the parse, and n-grams are counted inside the distinct chunks, weighted. The words of a closing trigger are the next chunk's: a chunk counts the
n-grams that begin before its closing trigger, all of which lie inside it (the longest is one word longer than the overlap), so each occurrence counts once.

Lengths are worked off one after the other. An n-gram can only be frequent if both (n-1)-grams in it are, so those of the last length are put into a Bloom
filter of bounded size, and n-grams that miss it are not counted. Counts by 64-bit hashes choose what to look at (a clash or a false hit only adds to
that); the counts that the scores use are then taken by the words themselves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.llm.common import arrow_rows, rows_of, small_side, stage, text_of

LONGEST = 5
OVERLAP = LONGEST - 1
EVERY = 8  # two in so many windows trigger, of those whose first word ends right
LEAST = 100
TOP = 2000
WHOLE_WORDS = 12  # shorter pieces are one chunk
BATCH_BYTES = 10 << 20
HELD_BYTES = 16 << 20  # of text whose chunks a task gathers before it hands them on
CHUNK_ROWS = 20_000  # of a batch of chunks
FILTER_BITS = 1 << 28
BLOCKS = 64
NO_LANG = "und"
_SMALL, _CAPITAL = bytes(range(97, 123)), bytes(range(65, 91))
#: A-Z to a-z, what ends a piece to a line feed, tab to space (fixed values).
_PLAIN = bytes.maketrans(_CAPITAL + b".,;:!?\x0b\x0c\r\t", _SMALL + b"\n" * 9 + b" ")


def chunks_of(words: list[bytes]) -> Iterator[tuple[bytes, bool]]:
    """(chunk, is it the last one) of the words of a piece. A window triggers by the last byte of its first word and a hash of it all."""
    start = 0
    for k in range(1, len(words) - OVERLAP + 1):
        if words[k][-1] & 3 == 0 and zlib.crc32(b" ".join(words[k:k + OVERLAP])) % EVERY < 2:
            yield b" ".join(words[start:k + OVERLAP]), False
            start = k
    yield b" ".join(words[start:]), True


def dictionary(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, chunk, last, n): the distinct chunks of each language and how often the parse has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, dict[bytes, int]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, last), found in counts.items():
                columns = [pa.array([lang] * len(found), pa.string()), pa.array(found, pa.binary()), pa.array([last] * len(found), pa.bool_()), pa.array(found.values(), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "chunk", "last", "n"])
            counts.clear()

        for lang, body in rows_of(batches, "lang", "body"):
            ends, inner = counts.setdefault((lang, True), {}), counts.setdefault((lang, False), {})
            for piece in body.translate(_PLAIN).split(b"\n"):
                words = piece.split()
                if len(words) < WHOLE_WORDS:
                    if words:
                        chunk = b" ".join(words)
                        ends[chunk] = ends.get(chunk, 0) + 1
                else:
                    for chunk, last in chunks_of(words):
                        of = ends if last else inner
                        of[chunk] = of.get(chunk, 0) + 1
            held += len(body)
            if held > HELD_BYTES:
                yield from flush()
                held = 0
        yield from flush()

    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), text_of(text_col).cast("binary").alias("body"))
    found = source.mapInArrow(run, "lang string, chunk binary, last boolean, n long")
    return found.groupBy("lang", "chunk", "last").agg(F.sum("n").alias("n")).withColumn("chunk", F.col("chunk").cast("string"))


class Filter:
    """A Bloom filter of two probes over 64-bit hashes, in blocks by their highest bits."""

    def __init__(self, blocks: dict[int, bytes], bits: int):
        self.bits = bits  # of a block
        self.table = np.zeros((BLOCKS, bits // 8), np.uint8)
        for k, block in blocks.items():
            self.table[k] = np.frombuffer(block, np.uint8)

    @staticmethod
    def places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        least = np.uint64(bits - 1)
        return (h >> np.uint64(58)).astype(np.int64), (h & least).astype(np.int64), ((h >> np.uint64(29)) & least).astype(np.int64)

    def has(self, h: np.ndarray) -> np.ndarray:
        block, a, b = self.places(h, self.bits)
        hit = (self.table[block, a >> 3] >> (a & 7).astype(np.uint8)) & 1
        return (hit & (self.table[block, b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)


def make_filter(hashes: DataFrame) -> Filter:
    """The filter of the staged column `hash`: 16 bits for each of them as far as FILTER_BITS reach. A task sets the bits of its blocks as the hashes stream by."""
    bits = 1 << 10
    n = hashes.count()
    while bits * BLOCKS < min(16 * n, FILTER_BITS):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            block, *places = Filter.places(batch.column(0).to_numpy().view(np.uint64), bits)
            for k in np.unique(block).tolist():
                table = tables.setdefault(k, np.zeros(bits // 8, np.uint8))
                for p in places:
                    at = p[block == k]
                    np.bitwise_or.at(table, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(tables, pa.int32()), pa.array([t.tobytes() for t in tables.values()], pa.binary())], names=["block", "bits"])

    dealt = hashes.select("hash").repartition(BLOCKS, F.shiftrightunsigned("hash", 58))
    return Filter({r.block: r.bits for r in dealt.mapInArrow(run, "block int, bits binary").collect()}, bits)


_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def longer(h: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that begin at each place, from those of the (n-1)-grams `h` and of the words."""
    out = np.zeros_like(h)
    size = len(words) - n + 1
    if size > 0:
        x = (h[:size] ^ (h[:size] >> np.uint64(32))) * _MIX + words[n - 1:] * _STEP
        out[:size] = x ^ (x >> np.uint64(29))
    return out


_POWERS = np.cumprod(np.full(4096, np.uint64(0x9FB21C651E98DF25)))


def hashes_of(texts: pa.Array, seed: int) -> np.ndarray:
    """64-bit hashes of texts: a polynomial over their bytes, mixed. (Clashes are told apart later, so speed is what counts.)"""
    if not len(texts):
        return np.zeros(0, np.uint64)
    raw = texts.cast(pa.large_binary())
    _, offsets, data = raw.buffers()
    ends = np.frombuffer(offsets, np.int64)[raw.offset:raw.offset + len(raw) + 1]
    sizes = np.diff(ends)
    octets = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)
    place = np.arange(len(octets)) - np.repeat(ends[:-1] - ends[0], sizes)
    terms = (octets.astype(np.uint64) + np.uint64(seed)) * _POWERS[place % len(_POWERS)]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms)))
    h = (sums[ends[1:] - ends[0]] - sums[ends[:-1] - ends[0]] + sizes.astype(np.uint64)) * _STEP
    return (h ^ (h >> np.uint64(31))) * _MIX


@dataclass
class Batch:
    """About BATCH_BYTES of chunks, flat: `ids` into the distinct words `names`, hashes by language and word, words up to the chunk's end, and the
    weight of what begins at each place (0 where the next chunk counts it)."""

    names: pa.Array
    ids: np.ndarray
    hashes: np.ndarray
    room: np.ndarray
    weight: np.ndarray
    langs: pa.Array
    lang: np.ndarray


def _batch(held: list[pa.RecordBatch]) -> Batch:
    column = lambda name: pa.concat_arrays([b.column(b.schema.get_field_index(name)) for b in held])
    lists = pc.split_pattern(column("chunk"), " ")
    sizes = np.diff(lists.offsets.to_numpy())
    words = lists.flatten().dictionary_encode()
    ids, names = words.indices.to_numpy(), words.dictionary
    langs = column("lang").dictionary_encode()
    lang = np.repeat(langs.indices.to_numpy(), sizes)
    hashes = (hashes_of(names, 1)[ids] ^ hashes_of(langs.dictionary, 2)[lang]) * _MIX
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(ids))
    last, n = column("last").to_numpy(zero_copy_only=False), column("n").to_numpy()
    weight = np.where(np.repeat(~last, sizes) & (room <= OVERLAP), 0, np.repeat(n, sizes))
    return Batch(names, ids, hashes, room, weight, langs.dictionary, lang)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[Batch]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(batch.schema.get_field_index("chunk")).nbytes
        if size >= BATCH_BYTES:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _runs(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places `at` in order of their hashes, and where each new hash begins."""
    at = at[np.argsort(h[at], kind="stable")]
    sorted_h = h[at]
    return at, np.flatnonzero(np.concatenate(([True], sorted_h[1:] != sorted_h[:-1])))


def frequent_hashes(chunks: DataFrame, n: int, shorter: Filter | None, least: int) -> DataFrame:
    """(hash, count) of the n-grams that occur `least` times and more and whose (n-1)-grams are in `shorter`."""
    shared = chunks.sparkSession.sparkContext.broadcast(shorter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in _batches(batches):
            h = b.hashes
            for k in range(2, n):
                h = longer(h, b.hashes, k)
            fits = (b.room >= n) & (b.weight > 0)
            if n > 1:
                alive = known.has(h)
                fits[:-1] &= alive[:-1] & alive[1:]
                h = longer(h, b.hashes, n)
            at = np.flatnonzero(fits)
            if len(at):
                at, starts = _runs(h, at)
                yield pa.RecordBatch.from_arrays([pa.array(h[at[starts]].view(np.int64)), pa.array(np.add.reduceat(b.weight[at], starts), pa.int64())], names=["hash", "count"])

    counted = chunks.mapInArrow(run, "hash long, count long")
    return counted.groupBy("hash").agg(F.sum("count").alias("count")).where(F.col("count") >= least)


def phrase_counts(chunks: DataFrame, filters: list[Filter], least: int) -> DataFrame:
    """(lang, phrase, size, f): exact counts of the phrases of one and more words that occur `least` times and more; `filters` by length hold them all."""
    shared = chunks.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in _batches(batches):
            h = b.hashes
            for k in range(1, len(known) + 1):
                h = longer(h, b.hashes, k) if k > 1 else h
                at = np.flatnonzero((b.room >= k) & (b.weight > 0) & known[k - 1].has(h))
                if not len(at):
                    continue
                at, starts = _runs(h, at)
                first = np.repeat(at[starts], np.diff(np.append(starts, len(at))))
                # Of equal hashes, places with other words than the first are rows of their own.
                same = b.lang[at] == b.lang[first]
                for j in range(k):
                    same &= b.ids[at + j] == b.ids[first + j]
                sums = np.add.reduceat(np.where(same, b.weight[at], 0), starts)
                rows, sums = np.concatenate((at[starts], at[~same])), np.concatenate((sums, b.weight[at][~same]))
                parts = [b.names.take(pa.array(b.ids[rows + j])) for j in range(k)]
                phrase = parts[0] if k == 1 else pc.binary_join_element_wise(*parts, " ")
                lang = b.langs.take(pa.array(b.lang[rows]))
                yield pa.RecordBatch.from_arrays([lang, phrase, pa.array(np.full(len(rows), k), pa.int32()), pa.array(sums, pa.int64())], names=["lang", "phrase", "size", "f"])

    counted = chunks.mapInArrow(run, "lang string, phrase string, size int, f long")
    return counted.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _words(first: Column | int, size: Column | int) -> Column:
    part = F.slice(F.split("phrase", " "), F.lit(first) if isinstance(first, int) else first, F.lit(size) if isinstance(size, int) else size)
    return F.array_join(part, " ")


def scored(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, n, score, cut) of every phrase in `counts` of two words and more, at its lowest-scoring cut."""
    parts = counts.select("lang", F.col("phrase").alias("part"), F.col("f"))
    cuts = counts.where("size > 1").withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"first": _words(1, F.col("cut")), "rest": _words(F.col("cut") + 1, F.col("size") - F.col("cut"))}).withColumnRenamed("f", "a")
    cuts = cuts.join(parts.withColumnsRenamed({"part": "first", "f": "l"}), ["lang", "first"])
    cuts = cuts.join(parts.withColumnsRenamed({"part": "rest", "f": "r"}), ["lang", "rest"]).join(F.broadcast(sizes), "lang")
    big = {c: F.col(c).cast("decimal(19,0)") for c in "alnr"}
    score = F.call_function("div", F.lit(Decimal(1000)) * big["a"] * big["n"], big["l"] * big["r"])
    best = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best")
    return cuts.groupBy("lang", "phrase", "size", "a", "n").agg(best).select("lang", "phrase", "size", "a", "best.l", "best.r", "n", "best.score", "best.cut")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language by score, then count, then text.

    A phrase of 2 to 5 words that occurs a >= `least` times, cut after its first words into parts that occur l and r times among n words, scores
    floor(1000 a n / (l r)) at its lowest-scoring cut. One that a longer phrase holds as often is left out. Null texts are empty, null languages are
    `und`; nothing frequent, or no rows: no rows.
    """
    chunks = stage(dictionary(docs, text_col, lang_col), "chunks")
    owned = F.size(F.split("chunk", " ")) - F.when(F.col("last"), 0).otherwise(OVERLAP)
    sizes = stage(chunks.groupBy("lang").agg(F.sum(owned * F.col("n")).alias("n")), "lang-sizes")
    filters: list[Filter] = []
    with arrow_rows(docs.sparkSession, CHUNK_ROWS):
        for n in range(1, LONGEST + 1):
            found = stage(frequent_hashes(chunks, n, filters[-1] if filters else None, least), f"frequent-{n}")
            if found.isEmpty():
                break
            filters.append(make_filter(found))
        counts = stage(phrase_counts(chunks, filters, least), "phrases")
    # The longest phrases that hold a candidate have at most its count, so the largest of their counts decides.
    starts = F.explode(F.expr("flatten(transform(sequence(2, size - 1), k -> transform(sequence(1, size - k + 1), s -> struct(s as s, k as k))))"))
    inner = counts.where("size > 2").withColumn("at", starts).select("lang", _words(F.col("at.s"), F.col("at.k")).alias("phrase"), "f")
    held = inner.groupBy("lang", "phrase").agg(F.max("f").alias("held"))
    kept = scored(counts, sizes).join(held, ["lang", "phrase"], "left").where("held is null or 100 * held < 100 * a")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same phrases for DuckDB.
ORACLE = rf"""
WITH pieces AS (SELECT coalesce(lang, '{NO_LANG}') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_CAPITAL.decode()}', '{_SMALL.decode()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
sizes AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
grams AS (SELECT lang, k, unnest(list_transform(range(len(words) - k + 1), lambda i: array_to_string(words[i + 1:i + k], ' '))) AS phrase
          FROM w, (SELECT unnest(range(1, {LONGEST + 1})) AS k) WHERE len(words) >= k),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}),
cuts AS (SELECT c.lang, c.phrase, c.k, c.f AS a, x.c AS cut, array_to_string(string_split(phrase, ' ')[1:x.c], ' ') AS first, array_to_string(string_split(phrase, ' ')[x.c + 1:], ' ') AS rest
         FROM counts c, (SELECT unnest(range(1, {LONGEST})) AS c) x WHERE x.c < c.k),
scores AS (SELECT cuts.*, p.f AS l, q.f AS r, sizes.n, CAST((1000::HUGEINT * a * n) // (p.f::HUGEINT * q.f) AS BIGINT) AS score
           FROM cuts JOIN counts p ON p.lang = cuts.lang AND p.phrase = first JOIN counts q ON q.lang = cuts.lang AND q.phrase = rest JOIN sizes ON sizes.lang = cuts.lang),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
held AS (SELECT lang, array_to_string(string_split(phrase, ' ')[s:s + m - 1], ' ') AS phrase, max(f) AS held
         FROM counts, (SELECT unnest(range(2, {LONGEST})) AS m), (SELECT unnest(range(1, {LONGEST + 1})) AS s) WHERE m < k AND s + m - 1 <= k GROUP BY ALL)
SELECT * FROM (SELECT best.lang, CAST(row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS BIGINT) AS rank, best.phrase, a, l, r, n, score
               FROM best LEFT JOIN held ON held.lang = best.lang AND held.phrase = best.phrase WHERE held IS NULL OR 100 * held < 100 * a)
WHERE rank <= {TOP}
"""
