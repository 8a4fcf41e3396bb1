"""SimHash near duplicates over an inverted index of positional bytes with count filtering.

A fingerprint of eight bytes is indexed by its bytes and their places. Two fingerprints at `RADIUS` or fewer differing bits differ
in at most that many bytes, so they share at least `8 - RADIUS` positional bytes. A list for one byte would hold 1/256 of all rows,
so lists are kept for joint places instead: the eight places fall into four runs of two, of which a qualifying pair shares at least two
whole; the index has one list for each pair of runs and their four bytes. Every pair met in a list has its shared positional bytes
tallied, pairs that reach the guaranteed minimum are kept, and the differing bits of those are counted.

A list may be hot (thousands of near copies). Lists of more than `LIST_ROWS` fingerprints are not paired: their members are hung on the
fingerprints one bit away from them. Two fingerprints lie within two bits exactly if they have such a point (or one of them) in common, at
most 65 fingerprints lie around a point, and all of those link to each other, so a star per point keeps every component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import free_name, rows_of, small_side, stage, text_of
from chalkline.llm.graph import connected_components

RADIUS = 2
RUNS = 4
LIST_ROWS = 64
SEED = 42
CHUNK = 1 << 16


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of UTF-8 text: a bit is set if it is set in over half the hashes of the shingles; no words: 0."""
    words = text.lower().split()  # bytes: A-Z are lowered, and words end at \x20 and \x09-\x0D
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    lows, highs = starts[:n].tolist(), ends[width - 1:].tolist()
    for at in range(0, n, CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(lows[at:at + CHUNK], highs[at:at + CHUNK])], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp) with the fingerprint as a signed long, for each row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            fps = np.array([fingerprint(t[0], width) for t in rows_of([batch], "body")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(fps)], names=["id", "fp"])

    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("body"))
    kind = dict(source.dtypes)["id"]
    return source.mapInArrow(run, f"id {kind}, fp long")


def _lists(fps: DataFrame) -> DataFrame:
    """(fp, list): the lists a fingerprint stands in."""
    run = [F.shiftrightunsigned("fp", 16 * k).bitwiseAND(0xFFFF) for k in range(RUNS)]
    keys = [F.lit(n << 32).bitwiseOR(F.shiftleft(run[i], 16)).bitwiseOR(run[j]) for n, (i, j) in enumerate(combinations(range(RUNS), 2))]
    return fps.select("fp", F.explode(F.array(*keys)).alias("list"))


def _shared_bytes(a: str, b: str):
    """Tally of the places at which both fingerprints have the same byte."""
    other = F.col(a).bitwiseXOR(F.col(b))
    same = [F.when(F.shiftrightunsigned(other, 8 * p).bitwiseAND(0xFF) == 0, 1).otherwise(0) for p in range(8)]
    return reduce(lambda x, y: x + y, same)


def links(fps: DataFrame) -> DataFrame:
    """(a, b) over distinct fingerprints `fp`: all pairs within RADIUS bits from lists of ordinary length, and for hot lists stars that
    connect the same fingerprints."""
    lists = _lists(fps)
    lengths = stage(lists.groupBy("list").agg(F.count("*").alias("n")).where("n > 1"), "lists")
    short = lists.join(lengths.where(F.col("n") <= LIST_ROWS).select("list"), "list")
    left, right = short.select("list", F.col("fp").alias("a")), short.select("list", F.col("fp").alias("b"))
    met = left.join(right, "list").where("a < b")
    kept = met.where(_shared_bytes("a", "b") >= 8 - RADIUS)
    near = kept.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).select("a", "b")

    hot = lists.join(lengths.where(F.col("n") > LIST_ROWS).select("list"), "list", "left_semi").select("fp").distinct()
    points = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63))) for b in range(64)])
    around = hot.select("fp", F.explode(points).alias("point")).groupBy("point").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = around.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")
    return near.unionByName(stars).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp, component) for each row: the component is the smallest id of all rows whose fingerprints are linked to the row's, directly
    or over others.

    Null ids are no candidates for the smallest id (a component of such rows alone has null). Null and empty texts and texts of white space
    share the fingerprint zero, which links like any other. Repeated rows are kept. An empty table gives no rows.
    """
    marked = stage(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = stage(marked.groupBy("fp").agg(F.min("id").alias("first_id")), "distinct")
    parts = connected_components(links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    joined = distinct.join(parts, "fp")
    least = joined.groupBy("component").agg(F.min("first_id").alias("least_id"))
    linked = stage(joined.join(least, "component").select("fp", "least_id"), "linked")
    of_fp = distinct.join(linked, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component"))
    return marked.join(stage(of_fp, "components"), "fp").select("id", "fp", "component")


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """The rows of `docs`, all columns, of which each component has one: the smallest id (null ids last), of rows equal in id and text any one.

    Only ids, fingerprints and a hash of (id, text) are gathered; texts move for repeated rows alone.
    """
    row, drop = free_name(docs, "simhash_row"), free_name(docs, "simhash_drop")
    names = [F.col(f"`{c}`") for c in docs.columns]
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    marked = fingerprints(docs.select(F.struct(key.alias("row"), F.col(id_col).alias("id")).alias("who"), F.col(text_col).alias("body_text")), "who", "body_text", width)
    place = F.struct(F.col("who.id").isNull().alias("last"), F.col("who.id").alias("id"), F.col("who.row").alias("row"))
    marked = stage(marked.withColumnRenamed("id", "who").select("fp", F.col("who.row").alias("row"), place.alias("place")), "marked")
    distinct = stage(marked.groupBy("fp").agg(F.min("place").alias("place")), "distinct")
    parts = connected_components(links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    joined = distinct.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    kept = joined.groupBy("component").agg(F.min("place").alias("kept"))
    kept = stage(joined.join(stage(kept, "kept"), "component").select("fp", F.col("kept.row").alias("kept")), "kept-of")
    rows = marked.groupBy("fp", "row").agg(F.count("*").alias("n")).join(kept, "fp")
    special = rows.where("row <> kept or n > 1").select(F.col("row").alias(row), (F.col("row") != F.col("kept")).alias(drop)).distinct()
    special = small_side(stage(special, "special"))
    flagged = docs.withColumn(row, key).join(special, row, "left")
    single = flagged.where(F.col(drop).isNull()).select(*names)
    repeated = flagged.where(~F.col(drop)).dropDuplicates([row]).select(*names)
    return single.unionByName(repeated)


def hex_digits(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
