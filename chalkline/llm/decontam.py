"""Benchmark decontamination by spaced-seed hashing, on DataFrame functions only.

A mask fixes which places count; a window of a benchmark item and one of a document meet if the words at those places are equal, whatever stands
at the others. Where windows meet, the item is laid along the document at that offset, and it leaks if in some stretch of `STRETCH` words (the
whole item, if shorter) at least `SHARE` of the words are equal in place. The masks `COVER` meet in every stretch that the rule accepts, wherever
the substituted words stand (the tests go through all patterns), so no accepted overlap is lost.

Items of fewer than `SPAN` words are found as a whole, by a window of their own length; in place of a share all their words must be equal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import free_name, small_side, stage

SPAN = 11
COVER = ((0, 1, 2, 4), (0, 3, 6, 7), (0, 4, 5, 6))
STRETCH = 20
SHARE = 0.7
BROADCAST_SEEDS = 2_000_000  # rows of 24 bytes
NOT_WORD = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    """Lower-case words; an empty array for null and for texts without any."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD, " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " ", -1))


def _seeds(df: DataFrame, keep: list[str], masks: list[tuple[int, ...]]) -> DataFrame:
    """(keep..., pos, seed): a row for each window and mask of the arrays `words`; masks end inside the words."""
    used = sorted({p for m in masks for p in m})
    hashed = df.select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    shifted = hashed.select(*keep, *[F.slice("hashes", F.lit(p + 1), F.size("hashes")).alias(f"at{p}") for p in used])
    windows = shifted.select(*keep, F.posexplode(F.arrays_zip(*[f"at{p}" for p in used])).alias("pos", "window"))
    seeds = [F.when(F.col(f"window.at{m[-1]}").isNotNull(), F.xxhash64(F.lit(",".join(map(str, m))), *[F.col(f"window.at{p}") for p in m])) for m in masks]
    return windows.select(*keep, "pos", F.explode(F.array(*seeds)).alias("seed")).where("seed is not null")


def _row(id_col: str, text_col: str) -> Column:
    """128 bits that tell rows apart by id and text."""
    return F.struct(F.xxhash64(id_col, text_col).alias("a"), F.xxhash64(F.lit(1), id_col, text_col).alias("b"))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
             item_text: str = "text") -> DataFrame:
    """(row, id, item, at, matched, n_words) for each document, leaking item and offset of the item's first word in the document.

    `row` is a hash of id and text: rows equal in both count once. Null texts have no words; null ids and items are kept as null.
    """
    items = benchmark.select(F.col(item_col).alias("item"), words_of(F.col(item_text)).alias("words")).distinct()
    items = stage(items.withColumn("item_row", F.xxhash64("item", "words")).where(F.size("words") > 0), "items")
    cover, short = list(COVER), sorted(r.n for r in items.where(F.size("words") < SPAN).select(F.size("words").alias("n")).distinct().collect())
    whole = [tuple(range(n)) for n in short]
    sized = items.withColumn("n_words", F.size("words"))
    parts = [_seeds(sized.where(F.col("n_words") >= SPAN), ["item_row", "n_words"], cover)]
    parts += [_seeds(sized.where(F.col("n_words") == len(m)), ["item_row", "n_words"], [m]) for m in whole]
    seeds = stage(reduce(DataFrame.unionByName, parts).withColumnRenamed("pos", "item_pos").distinct(), "seeds")
    seeds = small_side(seeds, limit=BROADCAST_SEEDS)
    marked = docs.select(_row(id_col, text_col).alias("row"), F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    met = _seeds(marked, ["row"], cover + whole).join(seeds, "seed").select("row", "item_row", "n_words", (F.col("pos") - F.col("item_pos")).alias("at"))
    met = stage(met.distinct().groupBy("row").agg(F.collect_list(F.struct("item_row", "n_words", "at")).alias("hits")), "met")
    met = small_side(met, F.sum(3 * F.size("hits") + 2))
    # Of a document only the words that an item is laid along go on, from the first one inside the document.
    along = F.transform("hits", lambda h: F.struct(h.item_row.alias("item_row"), h.n_words.alias("n_words"), h["at"].alias("at"),
                                                   F.slice("words", F.greatest(h["at"], F.lit(0)) + 1, h.n_words + F.least(h["at"], F.lit(0))).alias("part")))
    laid = marked.join(met, "row").select("row", "id", F.explode(along).alias("hit")).select("row", "id", "hit.*")
    laid = laid.join(small_side(items.select("item_row", "item", F.col("words").alias("item_words")), F.sum(F.size("item_words") + 2)), "item_row")
    equal = F.transform("item_words", lambda w, i: F.coalesce((F.get("part", i + F.least("at", F.lit(0))) == w).cast("int"), F.lit(0)))
    laid = laid.select("row", "id", "item", "at", "n_words", equal.alias("equal"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    length = F.least(F.lit(STRETCH), F.col("n_words"))
    stretches = F.transform(F.sequence(F.lit(1), F.col("n_words") - length + 1), lambda i: total(F.slice("equal", i, length)))
    leaking = laid.withColumn("best", F.array_max(stretches)).where(F.col("best") >= F.when(F.col("n_words") < SPAN, length).otherwise(F.lit(SHARE) * length))
    return leaking.select("row", "id", "item", "at", total("equal").alias("matched"), "n_words").distinct()


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that no benchmark item leaks into, all columns as they are."""
    row = free_name(docs, "leak_row")
    leaking = small_side(stage(overlaps(docs, benchmark, id_col, text_col).select(F.col("row").alias(row)).distinct(), "leaking"), F.count("*") * 2)
    names = [F.col(f"`{c}`") for c in docs.columns]
    return docs.withColumn(row, _row(id_col, text_col)).join(leaking, row, "left_anti").select(*names)


def _sql_seeds(table: str, key: str, where: str = "") -> str:
    joined = lambda places: " || chr(31) || ".join(f"words[pos + {p + 1}]" for p in places)
    return " UNION ALL ".join(f"SELECT {key}, pos, {k} AS mask, {joined(m)} AS seed FROM {table} WHERE pos + {m[-1]} < len(words){where}" for k, m in enumerate(COVER))


#: The same overlaps for DuckDB; items of fewer than SPAN words are looked for as a whole.
ORACLE = f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS words FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS words FROM benchmark),
dw AS (SELECT doc_id, words, unnest(range(len(words))) AS pos FROM d),
bw AS (SELECT item_id, words, unnest(range(len(words))) AS pos FROM b),
sizes AS (SELECT DISTINCT len(words) AS size FROM b WHERE len(words) BETWEEN 1 AND {SPAN - 1}),
ds AS ({_sql_seeds("dw", "doc_id")} UNION ALL
       SELECT doc_id, pos, -size AS mask, array_to_string(words[pos + 1:pos + size], chr(31)) AS seed FROM dw JOIN sizes ON pos + size <= len(words)),
bs AS ({_sql_seeds("bw", "item_id", f" AND len(words) >= {SPAN}")} UNION ALL
       SELECT item_id, 0 AS pos, -len(words) AS mask, array_to_string(words, chr(31)) AS seed FROM b WHERE len(words) BETWEEN 1 AND {SPAN - 1}),
met AS (SELECT DISTINCT doc_id, item_id, ds.pos - bs.pos AS shift FROM ds JOIN bs USING (mask, seed)),
laid AS (SELECT met.doc_id, met.item_id, shift, len(b.words) AS n,
         list_transform(range(len(b.words)), lambda i: CASE WHEN i + shift >= 0 AND d.words[i + shift + 1] = b.words[i + 1] THEN 1 ELSE 0 END) AS equal
         FROM met JOIN d USING (doc_id) JOIN b USING (item_id)),
scored AS (SELECT *, least({STRETCH}, n) AS size,
           list_max(list_transform(range(n - least({STRETCH}, n) + 1), lambda i: list_sum(equal[i + 1:i + least({STRETCH}, n)]))) AS best FROM laid)
SELECT doc_id, item_id, CAST(max(list_sum(equal)) AS BIGINT) AS matched, CAST(max(n) AS BIGINT) AS n_words
FROM scored WHERE best >= CASE WHEN n < {SPAN} THEN size ELSE {SHARE} * size END GROUP BY doc_id, item_id
"""
