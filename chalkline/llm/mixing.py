"""Mixing sources to target weights, on DataFrame functions only.

Every document gets a hash-random key; the rows are range-sorted by source and key, prefix sums of their word counts are taken over all ranges, and
each source is cut at its exact budget: whole epochs first, then the documents from the start of the order, the last one in part.

Prefix sums are taken in two steps: inside a range (one task holds one range), and over the sums of the ranges, of which there are as many as
partitions. Keys are random, so a large source is many ranges. Rows equal in source, id, text and size are one row with a count until the end, so a
group of copies is one row as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.llm.common import free_name, small_side, stage, text_of

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3  # a source gives at most so many times its size
RANGE_ROWS = 2_000_000
COPIES = 10_000  # copies of a row that one task writes out
SEED = "mix"


def key_of(id_col: str | Column, seed: str = SEED) -> Column:
    """The hash-random key: 60 bits of an MD5 of seed and id (null: empty)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def prefix_sums(rows: DataFrame, order: Sequence[str], **sums: Column) -> DataFrame:
    """`rows` (staged) with, for each name in `sums`, the sum of that column over all rows before this one in `order`, which must tell rows apart."""
    parts = max(1, -(-rows.count() // RANGE_ROWS))
    width = max(parts, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(width, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    ranged = stage(ranged, "ranges")
    named = [c.alias(f"__{n}") for n, c in sums.items()]
    totals = ranged.select("part", *named).groupBy("part").agg(*[F.sum(f"__{n}").alias(f"__{n}") for n in sums])
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", *[F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__before_{n}") for n in sums])
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.repartition(width, "part").withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    out = out.join(small_side(stage(totals, "range-sums")), "part")
    return out.withColumns({n: F.col(n) + F.col(f"__before_{n}") for n in sums}).drop("part", *[f"__before_{n}" for n in sums])


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(no_source, source, size, target) of `sources` (no_source, source, size; staged, one row each): weights are dealt in the order of the sources (null last), all sizes are
    shared out by weight, and what is over `most` times a source's size is reshared among the others.

    With the sources in order of `most` size / weight, those up to some place are full. Let the level of a place be what the rest gets per weight if
    all before it are full: levels rise up to the right place and fall after it, so the highest is the right one.
    """
    ranked = prefix_sums(sources, ["no_source", "source"], place=F.lit(1))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumns({"weight": weight.cast("long"), "cap": F.col("size") * most}).withColumn("ratio", F.col("cap") / F.col("weight"))
    ranked = stage(ranked, "weighed")
    total, all_weight = ranked.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    filled = prefix_sums(ranked, ["ratio", "no_source", "source"], full=F.col("cap"), used=F.col("weight"))
    level = filled.agg(F.max((F.lit(total) - F.col("full")) / (F.lit(all_weight) - F.col("used")))).first()[0] or 0.0
    target = F.least(F.col("weight") * F.lit(float(level)), F.col("cap").cast("double"))
    return stage(ranked.select("no_source", "source", "size", target.alias("target")), "targets")


def _groups(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[int], most: int, seed: str) -> DataFrame:
    """One row per distinct (source, id, text): its copies, its words, those before it in its source, and the source's budget."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    source = F.col(source_col).cast("string")
    rows = docs.select(source.isNull().alias("no_source"), F.coalesce(source, F.lit("")).alias("source"), F.col(id_col).alias("id"), key_of(id_col, seed).alias("key"),
                       size.alias("words"), F.xxhash64(text_of(text_col)).alias("t1"), F.xxhash64(F.lit(1), text_of(text_col)).alias("t2"))
    rows = stage(rows.groupBy("no_source", "source", "key", "id", "words", "t1", "t2").agg(F.count("*").alias("copies")), "keyed")
    sources = stage(rows.groupBy("no_source", "source").agg(F.sum(F.col("words") * F.col("copies")).alias("size")), "sources")
    targets = source_targets(sources, weights, most)
    placed = prefix_sums(rows, ["no_source", "source", "key", "id", "words", "t1", "t2"], before=F.col("words") * F.col("copies"))
    first = prefix_sums(sources, ["no_source", "source"], start=F.col("size"))
    targets = targets.join(small_side(stage(first.drop("size"), "starts")), ["no_source", "source"])
    budget = F.floor(F.col("target") + 0.5).cast("long")
    targets = targets.withColumns({"epochs": F.coalesce(F.floor(budget / F.nullif("size", F.lit(0))), F.lit(0)).cast("long")})
    targets = targets.withColumn("rest", budget - F.col("epochs") * F.col("size"))
    placed = placed.join(small_side(stage(targets, "budgets")), ["no_source", "source"])
    return placed.withColumn("before", F.col("before") - F.col("start"))


def _taken(before: Column) -> Column:
    return F.col("epochs") * F.col("words") + F.least(F.greatest(F.col("rest") - before, F.lit(0)), F.col("words"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, most: int = MOST,
        seed: str = SEED) -> DataFrame:
    """(id, source, size, source_size, target, taken) for each row of `docs`: its words, those of its source, what the source is to give, and how many of
    the row's words the mix takes, repeats counted. What a source's rows give is its target, rounded.

    Null and empty texts have no words and give none; null sources are one source, the last; null ids are one id. Rows equal in everything are told
    apart by nothing: as many of them as there are get the shares of their places. No rows: no rows.
    """
    groups = _groups(docs, id_col, text_col, source_col, weights, most, seed)
    kept = ["id", F.when(~F.col("no_source"), F.col("source")).alias("source"), F.col("words").alias("size"), F.col("size").alias("source_size"), "target"]

    def spread(rows: DataFrame, first: Column, last: Column) -> DataFrame:
        one = rows.withColumn("copy", F.explode(F.sequence(first, last)))
        return one.select(*kept, _taken(F.col("before") + F.col("copy") * F.col("words")).alias("taken"))

    few = spread(groups.where(F.col("copies") <= COPIES), F.lit(0).cast("long"), F.col("copies") - 1)
    many = groups.where(F.col("copies") > COPIES).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))))
    many = many.repartition("source", "key", "t1", "block")
    return few.unionByName(spread(many, F.col("block") * COPIES, F.least((F.col("block") + 1) * COPIES, F.col("copies")) - 1))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, most: int = MOST,
            seed: str = SEED) -> DataFrame:
    """The mixed corpus: the rows of `docs`, all columns, each as often as it is taken, with a number `epoch` from 1. A document taken in part comes
    with its first words, a space between them. Documents without words are not taken."""
    groups = _groups(docs, id_col, text_col, source_col, weights, most, seed).where("words > 0")
    total = F.col("copies") * F.col("epochs") * F.col("words") + F.least(F.greatest(F.col("rest") - F.col("before"), F.lit(0)), F.col("copies") * F.col("words"))
    row, count, words, epoch = (free_name(docs, n) for n in ("mix_row", "mix_count", "mix_words", "epoch"))
    source = F.col(source_col).cast("string")

    def row_key(no_source: Column, name: Column, key: Column, t1: Column, t2: Column) -> Column:
        return F.struct(no_source.alias("n"), name.alias("s"), key.alias("k"), t1.alias("a"), t2.alias("b"))

    shares = groups.select(row_key(*[F.col(c) for c in ("no_source", "source", "id", "t1", "t2")]).alias(row), F.col("words").alias(words), total.alias(count), "copies")
    shares = stage(shares.where(F.col(count) > 0), "shares")
    keyed = docs.withColumn(row, row_key(source.isNull(), F.coalesce(source, F.lit("")), F.col(id_col), F.xxhash64(text_of(text_col)), F.xxhash64(F.lit(1), text_of(text_col))))
    # Null ids match themselves: all fields of the key but the id are never null.
    safe = [F.col(f"{row}.{f}") for f in "nskab"]
    other = [F.col(f"__share.{f}") for f in "nskab"]
    on = [a.eqNullSafe(b) for a, b in zip(safe, other)]
    right = shares.withColumnRenamed(row, "__share")
    joined = keyed.join(right, on)
    single = joined.where("copies = 1")
    repeated = joined.where("copies > 1").dropDuplicates([row])
    names = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    out = single.unionByName(repeated).withColumn(epoch, F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col(count) / F.col(words)))))
    left = F.col(count) - (F.col(epoch) - 1) * F.col(words)
    part = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), F.lit(1), left.cast("int")), " ")
    out = out.withColumn(text_col, F.when(left >= F.col(words), F.col(text_col)).otherwise(part))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], epoch)


#: The same plan for DuckDB (rows of the same id and size need no order).
ORACLE = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
                  substr(md5(concat('{SEED}:', coalesce(CAST(doc_id AS VARCHAR), ''))), 1, 15) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} AS weight FROM d GROUP BY source),
f AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
             coalesce(sum({MOST} * source_size) OVER w, 0) AS used, coalesce(sum(weight) OVER w, 0) AS used_weight
      FROM s WINDOW w AS (ORDER BY {MOST} * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max(CAST(total - used AS DOUBLE) / CAST(weights - used_weight AS DOUBLE)) AS level FROM f),
t AS (SELECT source, source_size, least(weight * level, CAST({MOST} * source_size AS DOUBLE)) AS target FROM s, l),
b AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget FROM t),
e AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size END AS epochs FROM b),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT p.doc_id, p.size, e.source_size, e.target,
       CAST(e.epochs * p.size + least(greatest(e.budget - e.epochs * e.source_size - p.before, 0), p.size) AS BIGINT) AS taken
FROM p JOIN e ON p.source IS NOT DISTINCT FROM e.source
"""
