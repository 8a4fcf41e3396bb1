"""WARC archives: an index of byte ranges first, then coalesced sorted range reads of the selected records.

Writing: every record is a gzip member of its own, as in .warc.gz files. Rows are dealt over archives by a hash of a row number; a record's
offset is the sum of the lengths before it in its archive, so the index (archive, offset, length, URL, digest) is written before the records.
Records are written by Spark's text writer with a zero byte as the line separator (gzip readers skip zeros between members), so an archive is committed
whole or not at all, on any file system.

Reading: the index rows of the selected records are sorted by archive and offset; ranges that lie next to each other (or at most `GAP` bytes
apart) are fetched in one read of at most `READ` bytes, and the records are cut out of it.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from chalkline.llm.common import new_folder, rows_of, small_side, stage

ARCHIVE_BYTES = 256 << 20
READ = 4 << 20
GAP = 64 << 10
LEVEL = 3
END = "\r\n\r\n"
PAD = "\0"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hexadecimal digits are four base-32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def described(pages: DataFrame, id_col: str, url_col: str, body_col: str, least: int) -> DataFrame:
    """(row, id, url, body, payload_bytes, payload_digest, record_type, refers_to) of each row.

    Of rows with equal payloads (digest and length) of at least `least` bytes, those with the smallest id are responses and the others revisits
    of it. Null bodies are empty payloads; null ids come last: a null id is a response where all of its group are null.
    """
    body = F.coalesce(F.col(body_col), F.lit("")).cast("string")
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body"))
    rows = rows.select("*", F.octet_length("body").cast("long").alias("payload_bytes"), base32_sha1(F.col("body").cast("binary")).alias("payload_digest"))
    first = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    first = small_side(stage(first.where("n > 1").drop("n"), "first"))
    joined = rows.join(first, ["payload_digest", "payload_bytes"], "left")
    again = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    return joined.select("row", "id", "url", "body", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"),
                         F.when(again, F.col("first_id")).alias("refers_to"))


def _clean(c: Column) -> Column:
    """Header values hold no line breaks."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[\\r\\n]+", " ")


def _record(day: str) -> Column:
    """The record without the blank line that ends it."""
    revisit = F.col("record_type") == "revisit"
    name = F.coalesce(F.col("id").cast("string"), F.lit(""))
    stored = F.when(revisit, F.lit(0).cast("long")).otherwise(F.col("payload_bytes"))
    refers = F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">\r\n"),
                      F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\nWARC-Record-ID: <urn:page:"), name, F.lit(f">\r\nWARC-Date: {day}\r\nWARC-Target-URI: "),
                    _clean(F.col("url")), F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit("\r\nX-Payload-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit("\r\n"), F.when(revisit, refers).otherwise(F.lit("")),
                    F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "), stored.cast("string"), F.lit("\r\n\r\n"),
                    F.when(revisit, F.lit("")).otherwise(F.col("body")))


def _compressed(records: DataFrame) -> DataFrame:
    """`value`, the record, as a gzip member of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("value")
            members = []
            for (value,) in rows_of([batch], "value"):
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                members.append(packer.compress(value) + packer.flush())
            columns = list(batch.columns)
            columns[at] = pa.array(members, pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return records.mapInArrow(run, records.schema)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = 0,
                   day: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row under `path` and return its index: (archive, file, offset, length, id, url, digest, record_type).

    The index lies in `path`/index, the archives in `path`/archives. Archives hold about ARCHIVE_BYTES; there are at least as many as
    shuffle partitions, as far as there are rows. Repeated rows are records of their own.
    """
    spark = pages.sparkSession
    records = described(pages, id_col, url_col, body_col, least)
    value = F.concat(_record(day), F.lit(END)).cast("binary").alias("value")
    rows = stage(_compressed(records.select("row", "id", "url", "payload_digest", "record_type", value)), "records")
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("value"))).first()
    archives = max(1, -(-(size or 0) // ARCHIVE_BYTES), min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = rows.withColumn("archive", F.pmod(F.xxhash64("row"), F.lit(archives)).cast("int"))
    order = Window.partitionBy("archive").orderBy("row")
    index = dealt.select("archive", "row", "id", "url", F.col("payload_digest").alias("digest"), "record_type", F.octet_length("value").cast("long").alias("length"))
    before = F.coalesce(F.sum(F.col("length") + len(PAD)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    index.withColumn("offset", before).drop("row").write.parquet(f"{path}/index")
    placed = dealt.select("archive", "row", F.col("value").cast("string").alias("value")).repartition(archives, "archive").sortWithinPartitions("archive", "row")
    placed.select("archive", "value").write.partitionBy("archive").option("lineSep", PAD).text(f"{path}/archives")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """The index with the files that hold the archives."""
    index = spark.read.parquet(f"{path}/index")
    if index.isEmpty():
        return index.withColumn("file", F.lit(None).cast("string"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/archives").select("archive", F.col("path").alias("file"))
    return index.join(files, "archive")


def runs_of(ranges: list[tuple[int, int]], gap: int = GAP, most: int = READ) -> list[tuple[int, int, int, int]]:
    """(first, last + 1, offset, bytes) of the reads that cover sorted (offset, length) ranges; a longer record is a read of its own."""
    runs = []
    i = 0
    while i < len(ranges):
        start, end, j = ranges[i][0], sum(ranges[i]), i + 1
        while j < len(ranges) and ranges[j][0] - end <= gap and max(end, sum(ranges[j])) - start <= most:
            end = max(end, sum(ranges[j]))
            j += 1
        runs.append((i, j, start, end - start))
        i = j
    return runs


def unpacked(member: bytes) -> bytes:
    try:
        return zlib.decompress(member, 31)
    except zlib.error as e:
        raise ValueError(f"no record at this offset: {e}") from e


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of a record with the blank line that ends it."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogateescape").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record at this offset: {lines[0][:40]!r}")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def read_records(selected: DataFrame) -> DataFrame:
    """(record_type, page, url, refers_to, digest, payload_bytes, payload) of the index rows in `selected`; a response whose payload doesn't have its digest is
    an error. Revisits have no payload of their own (null)."""
    names = ["record_type", "page", "url", "refers_to", "digest", "payload_bytes", "payload"]
    schema = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for n in names])

    def target(urn: str | None) -> str | None:
        return None if urn is None else urn.removeprefix("<urn:page:").removesuffix(">") or None

    def decoded(record: bytes) -> tuple:
        headers, block = parse(unpacked(record))
        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        response = headers["WARC-Type"] == "response"
        if response and base64.b32encode(hashlib.sha1(block).digest()).decode() != digest:
            raise ValueError(f"payload of {headers['WARC-Record-ID']} doesn't have its digest")
        return (headers["WARC-Type"], target(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], target(headers.get("WARC-Refers-To")), digest,
                int(headers["X-Payload-Length"]), block if response else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            rows = list(rows_of([batch], "file", "offset", "length"))
            at = 0
            while at < len(rows):
                end = at
                while end < len(rows) and rows[end][0] == rows[at][0]:
                    end += 1
                uri = rows[at][0]
                system, path = fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)
                ranges = [(r[1], r[2]) for r in rows[at:end]]
                with system.open_input_file(path) as f:
                    for i, j, offset, size in runs_of(ranges):
                        data = f.read_at(size, offset)
                        out = [decoded(data[a - offset:a - offset + n]) for a, n in ranges[i:j]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                at = end

    partitions = selected.sparkSession.conf.get("spark.sql.shuffle.partitions")
    located = selected.select("file", "offset", "length").repartitionByRange(int(partitions), "file", "offset").sortWithinPartitions("file", "offset")
    return located.mapInArrow(run, "record_type string, page string, url string, refers_to string, digest string, payload_bytes long, payload binary")


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Write the pages into new archives in the shared folder and read all their records back."""
    spark = pages.sparkSession
    return read_records(write_archives(pages, new_folder(spark, "warc"), **columns))


def _base32_sql(digest: str) -> str:
    """The base32 text of a hexadecimal SHA-1 in DuckDB."""
    five = [f"CAST('0x' || substr({digest}, {1 + 5 * k}, 5) AS INTEGER)" for k in range(8)]
    return " || ".join(f"substr('{BASE32}', (({v} >> {shift}) & 31) + 1, 1)" for v in five for shift in (15, 10, 5, 0))


#: What the archives hold of every page, for DuckDB (unique ids).
ORACLE = f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
w AS (SELECT *, min(page_id) OVER (PARTITION BY h, payload_bytes) AS first_id FROM p)
SELECT page_id, payload_bytes, {_base32_sql("h")} AS payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM w
"""
