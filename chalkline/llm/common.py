"""Shared helpers: input columns, tables in shared storage, uneven joins."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BROADCAST_NUMBERS = 2_000_000
BATCH_ROWS = 1000


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the warehouse where that is unset (tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_stage"
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: the lineage ends there, and a lost executor costs no more than a reread."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(table: DataFrame, size: Column | None = None, limit: int = BROADCAST_NUMBERS) -> DataFrame:
    """A staged table for the small side of a join: marked for broadcast if its measured size (rows, or the sum `size` of numbers in them) is at most
    `limit`; beyond that the join shuffles both sides."""
    measured = table.agg(F.coalesce(size if size is not None else F.count("*"), F.lit(0))).first()[0]
    return F.broadcast(table) if measured <= limit else table


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a superseded intermediate table."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stage_path(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Like `stage`, with the path, for loops that drop the table of the last round."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def free_name(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def text_of(column: str = "text") -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def rows_of(batches: Iterator, *columns: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, a slice of the batch at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            yield from zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in columns))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside send batches of at most so many rows to Python workers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, held)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of texts; what goes to Python workers comes in batches of at most BATCH_ROWS rows, for texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{folder}/{name}.parquet")
