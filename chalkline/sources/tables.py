"""Table maintenance: keyed upserts, gap fills, partition replacement, audits, archives and manifests.

Every operator returns the new table as a DataFrame; `save` writes it. A table is written beside its old version and
listed in a small pointer table, so a job may read the table it replaces and a lost executor only repeats its tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.functions.names import name_key
from chalkline.functions.teams import rewrite_legacy
from chalkline.operators.ordered import attach, first_rows

Cols = Sequence[str]


def upsert(target: DataFrame, updates: DataFrame, keys: Cols, order: Cols = ()) -> DataFrame:
    """Updates replace target rows with the same key; a key repeated in the batch keeps its last row by `order`.

    Only the updates are ranked; the target is touched by one anti join."""
    last = first_rows(updates, keys, [F.col(c).desc_nulls_last() for c in (order or _rest(updates, keys))])
    kept = target.join(last.select(*keys), list(keys), "left_anti")
    return kept.unionByName(last.select(*[c for c in last.columns if c in target.columns]), allowMissingColumns=True)


def _rest(df: DataFrame, keys: Cols) -> list[str]:
    return [c for c in df.columns if c not in keys]


def upsert_columns(target: DataFrame, updates: DataFrame, keys: Cols, columns: Cols) -> DataFrame:
    """Change only `columns` of existing keys, insert absent keys."""
    last = first_rows(updates, keys, [F.col(c).desc_nulls_last() for c in columns])
    new = last.select(*keys, *[F.col(c).alias(f"__n_{c}") for c in columns])
    changed = attach(target, new, keys).withColumns(
        {c: F.coalesce(F.col(f"__n_{c}"), F.col(c)) for c in columns}).drop(*[f"__n_{c}" for c in columns])
    inserts = last.join(target.select(*keys), list(keys), "left_anti")
    return changed.unionByName(inserts.select(*[c for c in inserts.columns if c in target.columns]), allowMissingColumns=True)


def replace_all(batch: DataFrame, keys: Cols, order: Cols) -> DataFrame:
    """Full replacement; duplicates in the batch keep the last row by `order`."""
    return first_rows(batch, keys, [F.col(c).desc_nulls_last() for c in order])


def fill_gaps(target: DataFrame, extra: DataFrame, keys: Cols, order: Cols = ()) -> DataFrame:
    """Insert only keys the target does not have."""
    fresh = extra.join(target.select(*keys), list(keys), "left_anti")
    fresh = first_rows(fresh, keys, [F.col(c) for c in (order or _rest(extra, keys))])
    return target.unionByName(fresh, allowMissingColumns=True)


def replace_partition(target: DataFrame, batch: DataFrame, columns: Cols = ("year",)) -> DataFrame:
    """The batch's partitions replace the target's."""
    return target.join(batch.select(*columns).distinct(), list(columns), "left_anti").unionByName(batch, allowMissingColumns=True)


def append_keep_first(target: DataFrame, batch: DataFrame, keys: Cols, order: Cols = ()) -> DataFrame:
    return fill_gaps(target, batch, keys, order)


def append_keep_last(target: DataFrame, batch: DataFrame, keys: Cols, order: Cols = ()) -> DataFrame:
    return upsert(target, batch, keys, order)


def record_load(source: str, batch: DataFrame, loaded_at: Column, file_time: Column | None = None) -> DataFrame:
    """Audit row: source, newest input time (UTC), load time and row count; no row for an empty input."""
    newest = file_time if file_time is not None else F.col("_metadata.file_modification_time")
    agg = batch.select(newest.alias("__t")).agg(F.max("__t").alias("file_time"), F.count(F.lit(1)).alias("row_count"))
    return agg.where(F.col("row_count") > 0).select(F.lit(source).alias("source"), "file_time", loaded_at.alias("loaded_at"), "row_count")


def archive_snapshot(archive: DataFrame, snapshot: DataFrame, keys: Cols = ("scraped_at",)) -> DataFrame:
    """Add a snapshot unless its scrape time is archived already."""
    fresh = snapshot.join(archive.select(*keys).distinct(), list(keys), "left_anti")
    return archive.unionByName(fresh, allowMissingColumns=True)


def delete_years(df: DataFrame, years: Sequence[int], column: str = "year") -> tuple[DataFrame, DataFrame]:
    """Rows kept, and the number removed per year."""
    gone = F.coalesce(F.col(column).isin(list(years)), F.lit(False))
    return df.where(~gone), df.where(gone).groupBy(column).agg(F.count(F.lit(1)).alias("removed"))


def legacy_code_counts(tables: dict[str, tuple[DataFrame, Cols]]) -> DataFrame:
    """How many values a team-code rewrite would change, per table and column."""
    parts = []
    for name, (df, columns) in tables.items():
        pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("code")) for c in columns])
        parts.append(df.select(F.lit(name).alias("table_name"), F.inline(pairs)))
    rows = reduce(lambda a, b: a.unionByName(b), parts).where(F.col("code") != rewrite_legacy("code"))
    return rows.groupBy("table_name", "column_name", "code").agg(F.count(F.lit(1)).alias("n_rows"))


def rewrite_codes(df: DataFrame, columns: Cols) -> DataFrame:
    return df.withColumns({c: rewrite_legacy(c) for c in columns})


def export_view(df: DataFrame, keys: dict[str, object], display: str = "name", stored: str = "name_key") -> DataFrame:
    """Join keys first (missing ones as constants), a derived name key when there is a name, then the rest."""
    front = [F.col(k) if k in df.columns else F.lit(v).alias(k) for k, v in keys.items()]
    if display in df.columns:
        front.append(name_key(F.col(stored) if stored in df.columns else F.lit(None).cast("string"), display).alias(stored))
    taken = {*keys, stored if display in df.columns else ""}
    return df.select(*front, *[c for c in df.columns if c not in taken])


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, row_count and column list of every table."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(n).alias("table_name"), "row_count", F.lit(",".join(df.columns)).alias("columns")) for n, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def verify_manifest(saved: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Saved against live counts and columns; `ok` is false for a mismatch or a table missing on one side."""
    live = manifest(tables).select("table_name", F.col("row_count").alias("live_count"), F.col("columns").alias("live_columns"))
    both = saved.join(live, "table_name", "full_outer")
    same = F.col("row_count").eqNullSafe(F.col("live_count")) & F.col("columns").eqNullSafe(F.col("live_columns"))
    return both.select("table_name", "row_count", "live_count", same.alias("ok"))


def restore(saved: DataFrame, live: DataFrame) -> DataFrame:
    """A saved table in the columns of the live one, matched by name and cast to its types: columns the live table has gained are NULL, columns it
    has lost are left out, and the order is the live one."""
    return saved.select(*[(F.col(f.name) if f.name in saved.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in live.schema.fields])


def save(df: DataFrame, path: str, partition_by: Cols = (), fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write a table; with partition columns and mode overwrite only the partitions in `df` are replaced."""
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def save_version(df: DataFrame, root: str) -> str:
    """Write a new version folder of a table that may read its own old version, then append it to the pointer."""
    spark = df.sparkSession
    version = f"{root}/v_{uuid.uuid4().hex}"
    df.write.mode("error").parquet(version)
    spark.sql(f"SELECT '{version}' AS path, current_timestamp() AS at").write.mode("append").parquet(f"{root}/versions")
    return version


def read_version(spark: SparkSession, root: str) -> DataFrame:
    newest = spark.read.parquet(f"{root}/versions").orderBy(F.desc("at")).select("path").first()
    return spark.read.parquet(newest["path"])


def export_tables(tables: dict[str, tuple[DataFrame, Cols]], root: str, fmt: str = "csv") -> None:
    """Critical-table export, one folder per table, sorted by the given columns."""
    for name, (df, order) in tables.items():
        save(df.orderBy(*order), f"{root}/{name}", fmt=fmt)
