"""A table of the newest row per key that is fed batch by batch: a merge-on-read log with levelled compaction.

A batch adds one folder with its newest rows per key; `every` folders of a level are merged into one of the next, so a row is rewritten once a level and
the number of folders grows with the logarithm of the number of batches. Which folders are alive stands in a manifest, a small file that is written
beside and renamed into place after its folders are complete. A batch that is replayed is either known to the manifest and left alone, or its folders
are written anew. Folders go once neither the newest manifest nor the one before it names them, so a reader may lag by one batch.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVERY = 8


def newest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row per key that is largest by `order`, then by the other columns; combined before it is shuffled."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    top = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__top"))
    return top.select(*keys, *[F.col(f"__top.{c}").alias(c) for c in [*order, *rest]]).select(*rows.columns)


class Folder:
    """The few file operations a manifest needs, by Hadoop's file system, so any shared storage will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.root = spark._jvm, spark._jsc.hadoopConfiguration(), root.rstrip("/")

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def fs(self):
        return self.path("").getFileSystem(self.conf)

    def names(self, name: str = "") -> list[str]:
        at = self.path(name) if name else self.jvm.org.apache.hadoop.fs.Path(self.root)
        return sorted(s.getPath().getName() for s in self.fs().listStatus(at)) if self.fs().exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs().open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """All of the file or none of it."""
        fs, beside, at = self.fs(), self.path(f"_tmp-{uuid.uuid4().hex}"), self.path(name)
        stream = fs.create(beside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        fs.mkdirs(at.getParent())
        if fs.exists(at):
            fs.delete(at, False)
        if not fs.rename(beside, at):
            raise OSError(f"{name} can't be put in place")

    def delete(self, name: str) -> None:
        self.fs().delete(self.path(name), True)


class LatestTable:
    """Newest row per `keys` by `order` under `root`. One writer at a time; batch numbers rise."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], order: Sequence[str], every: int = EVERY):
        if every < 2:
            raise ValueError("a level needs two folders at least")
        self.spark, self.root, self.keys, self.order, self.every = spark, root.rstrip("/"), list(keys), list(order), every
        self.folder = Folder(spark, root)

    def _manifests(self) -> list[str]:
        return self.folder.names("manifest")

    def manifest(self) -> dict:
        found = self._manifests()
        return json.loads(self.folder.read(f"manifest/{found[-1]}")) if found else {"upto": -1, "parts": []}

    def _load(self, parts: Sequence[str], schema=None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return reduce(DataFrame.unionByName, [reader.parquet(f"{self.root}/{p}") for p in parts])

    def put(self, batch: DataFrame, batch_id: int) -> None:
        """Merge a batch; one that the table already holds changes nothing."""
        held = self.manifest()
        if batch_id <= held["upto"]:
            return
        name = f"level0-{batch_id}"
        newest(batch, self.keys, self.order).write.mode("overwrite").parquet(f"{self.root}/{name}")
        parts = [*held["parts"], [0, name]]
        while len(parts) >= self.every and len({level for level, _ in parts[-self.every:]}) == 1:
            merged = [p for _, p in parts[-self.every:]]
            level = parts[-1][0] + 1
            name = f"level{level}-{batch_id}"
            newest(self._load(merged, batch.schema), self.keys, self.order).write.mode("overwrite").parquet(f"{self.root}/{name}")
            parts = [*parts[: -self.every], [level, name]]
        self.folder.write(f"manifest/{batch_id:020d}.json", json.dumps({"upto": batch_id, "parts": parts}))
        self._clean()

    def _clean(self) -> None:
        found = self._manifests()
        alive = {p for m in found[-2:] for _, p in json.loads(self.folder.read(f"manifest/{m}"))["parts"]}
        for m in found[:-2]:
            self.folder.delete(f"manifest/{m}")
        for name in self.folder.names():
            if name.startswith(("level", "_tmp-")) and name not in alive:
                self.folder.delete(name)

    def read(self) -> DataFrame | None:
        """The table now, or None before the first batch."""
        parts = [p for _, p in self.manifest()["parts"]]
        return newest(self._load(parts), self.keys, self.order) if parts else None
