"""Derived tables that many queries start from: written once a session, bucketed by the key the queries group and join on.

A table stands under a fingerprint of its definition and of the files it is made from (names, sizes, times), so changed input makes a new one.
Aggregates and windows by the bucket key need no exchange; the number of buckets follows the size of the input.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

BUCKET_BYTES = 64 << 20


def shared_root(spark: SparkSession) -> str:
    """A folder that all executors share: spark.checkpoint.dir, or the warehouse where that is unset (tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return root.rstrip("/")


def input_files(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, int, int]]:
    """(path, bytes, modification time) of every file under `paths`."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = []
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        listing = at.getFileSystem(conf).listFiles(at, True)
        while listing.hasNext():
            s = listing.next()
            found.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return sorted(found)


def derived_table(spark: SparkSession, name: str, definition: str, make, paths: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """The table `make(buckets)`, whose rows come dealt over `buckets` partitions by `keys`, made at its first use in the session."""
    files = input_files(spark, paths)
    digest = hashlib.sha256(repr((definition, files, list(keys))).encode()).hexdigest()[:16]
    table = f"derived_{name}_{digest}"
    if not spark.catalog.tableExists(table):
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(size for _, size, _ in files) // BUCKET_BYTES))
        where = f"{shared_root(spark)}/derived/{table}-{spark.sparkContext.applicationId}"
        make(buckets).write.bucketBy(buckets, *keys).mode("overwrite").option("path", where).saveAsTable(table)
    return spark.table(table)


def dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`df` over the session's number of shuffle partitions by `keys`; Spark leaves that out for a table that already lies so."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def settled(df: DataFrame, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """`df` written to the shared folder and read again: several uses read rows instead of repeating the plan, and a lost executor costs a reread.

    With `keys` the rows, which then come `dealt` by them, stay so: grouping and joining by them (and more) shuffles nothing."""
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    where = f"{shared_root(spark)}/settled/{name}-{mark}"
    if keys:
        table = f"settled_{name.replace('-', '_')}_{mark}"
        df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).option("path", where).saveAsTable(table)
        return spark.table(table)
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)
