import numpy as np
import pytest
from pyspark.sql import functions as F

from chalkline.llm import topk
from chalkline.llm.queries import ORACLES, QUERIES
from tests.oracle_check import compare, connect

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow(rows, k):
    vectors = [(i, n, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for n, (i, v) in enumerate(rows)
               if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, n, q in vectors:
        if i is not None and i % 20 == 0:
            others = [(-sum(a * b for a, b in zip(q, v)), j is None, j or 0, m) for j, m, v in vectors if m != n and len(v) == len(q)]
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j, _) in enumerate(sorted(others)[:k])]
    return sorted(out, key=str)


def got(df, k=20):
    return sorted(((r.query_id, r.rank, r.id, r.score) for r in topk.search(df, F.col("id") % 20 == 0, k).collect()), key=str)


@pytest.mark.parametrize("seed,kind", [(0, "normal"), (1, "clusters"), (2, "ties"), (3, "large")])
def test_against_all_pairs(spark, seed, kind):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(700, 16))
    if kind == "clusters":
        v = rng.normal(size=(10, 16))[rng.integers(0, 10, 700)] + rng.normal(size=(700, 16)) * 0.05
    if kind == "ties":
        v = np.round(v)
    if kind == "large":
        v *= 1e6
    rows = [(int(k), [float(x) for x in u]) for k, u in enumerate(v)]
    df = spark.createDataFrame([(i, u, 0) for i, u in rows], SCHEMA)
    assert got(df) == slow(rows, 20)


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (1, [1.0, 0.5]), (20, [0.5, -3.0]), (20, [0.25, 1.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]),
            (5, [float("inf"), 1.0]), (None, [9.0, 9.0]), (6, []), (40, []), (7, [1.0]), (60, [2.0]), (80, [0.0, 0.0])]
    df = spark.createDataFrame([(i, u, 0) for i, u in rows], SCHEMA).coalesce(1)
    odd = df.withColumn("row", F.lit(1)).withColumn("id", F.lit("x")).withColumn("v", F.lit(2)).withColumn("score", F.lit(3))
    assert got(odd, 3) == slow(rows, 3)
    assert topk.search(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_index_stops_early_and_stays_exact():
    rng = np.random.default_rng(5)
    v = (rng.normal(size=(20, 32))[rng.integers(0, 20, 2000)] * 60 + rng.normal(size=(2000, 32)) * 2).astype(np.int64)
    q, rows = v[:50], np.arange(2000)
    a, b, s = topk.best_in_block(q, rows[:50], v, rows, rows, 5)
    full = q @ v.T
    for i in range(50):
        want = sorted((-full[i, j], j) for j in range(2000) if j != i)[:5]
        assert [(-x, y) for x, y in zip(s[a == i], b[a == i])] == want


def test_query_against_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    ok, message, _ = compare(spark, connect(folder), "op2", QUERIES["op2_exact_top_k"], ORACLES["op2_exact_top_k"], folder)
    assert ok, message
