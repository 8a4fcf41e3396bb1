import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from chalkline.llm import warc
from chalkline.llm.common import new_folder
from chalkline.llm.queries import ORACLES, QUERIES
from tests.oracle_check import compare, connect

SCHEMA = "page_id long, url string, html string"


def slow(rows, least=0):
    out, first = [], {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= least and i is not None:
            first[b] = min(i, first.get(b, i))
    for i, _, h in rows:
        b = (h or "").encode()
        again = b in first and i != first[b]
        out.append((None if i is None else str(i), len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", str(first[b]) if again else None))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(1)
    bodies = ["", "<p>é\r\n\r\nWARC/1.1\r\n</p>", "x" * 300_000, "\r\n\r\n", "日本 \x00"] + ["".join(rng.choices("ab<>\r\n", k=rng.randint(1, 400))) for _ in range(40)]
    rows = [(k, f"http://e.example/{k}", rng.choice(bodies)) for k in range(300)]
    return rows + [(5, None, None), (None, "http://a\r\nb", bodies[7]), (None, "u", "only null ids"), (400, "u", None), rows[3], rows[3]]


@pytest.mark.parametrize("least", [0, 50])
def test_round_trip(spark, least):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit(1)).withColumn("archive", F.lit(2)).withColumn("length", F.lit(3))
    back = warc.round_trip(df, least=least)
    got = sorted(((r.page, r.payload_bytes, r.digest, r.record_type, r.refers_to) for r in back.collect()), key=str)
    assert got == slow(rows, least)


def test_index_selects_byte_ranges(spark):
    rows = corpus()
    path = new_folder(spark, "warc-test")
    index = warc.write_archives(spark.createDataFrame(rows, SCHEMA), path)
    assert index.count() == len(rows)
    some = warc.read_records(index.where("id between 10 and 40")).collect()
    assert sorted(int(r.page) for r in some) == list(range(10, 41))
    body = {i: (h or "").encode() for i, _, h in rows}
    assert all(r.payload == body[int(r.page)] for r in some if r.record_type == "response")
    files = [r.content for r in spark.read.format("binaryFile").load(f"{path}/archives").collect()]
    assert sum(map(len, files)) == index.agg(F.sum("length")).first()[0] + len(rows)
    assert sum(gzip.decompress(f).count(b"WARC-Record-ID") for f in files) == len(rows)
    with pytest.raises(Exception, match="no record"):
        warc.read_records(index.limit(1).withColumn("offset", F.col("offset") + 1)).collect()


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_runs_are_coalesced():
    assert warc.runs_of([(0, 10), (10, 5), (40, 10), (1000, 5)], gap=30, most=100) == [(0, 3, 0, 50), (3, 4, 1000, 5)]
    assert warc.runs_of([(0, 500), (500, 5)], gap=0, most=100) == [(0, 1, 0, 500), (1, 2, 500, 5)]
    assert warc.runs_of([(0, 60), (60, 60)], gap=0, most=100) == [(0, 1, 0, 60), (1, 2, 60, 60)]


def test_query_against_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    ok, message, _ = compare(spark, connect(folder), "op3", QUERIES["op3_warc_round_trip"], ORACLES["op3_warc_round_trip"], folder)
    assert ok, message
