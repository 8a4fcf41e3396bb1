import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chalkline.llm import mixing
from chalkline.llm.queries import ORACLES, QUERIES
from tests.oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string"


def slow_targets(sizes, weights=(1, 2, 3), most=3):
    """Share out, take what is over, share that out again among the rest, until nothing is over."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total = sum(sizes.values())
    full = {s for s in order if not sizes[s]}
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in order if s not in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / open_weight for s in order}
        over = {s for s in order if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def slow_mix(rows, most=3):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    targets = slow_targets(sizes, most=most)
    out = []
    for s in sizes:
        mine = sorted([(int(hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest()[:15], 16), i is not None, i, words(t)) for i, t, x in rows if x == s], key=lambda r: (r[0], r[1], r[2] or 0, r[3]))
        budget = int(targets[s] + 0.5)
        taken = [0] * len(mine)
        while budget > 0 and sizes[s]:
            for k, (_, _, _, n) in enumerate(mine):
                part = min(n, budget)
                taken[k] += part
                budget -= part
        out += [(i, s, n, sizes[s], round(targets[s], 6), got) for (_, _, i, n), got in zip(mine, taken)]
    return Counter(out)


def rows_for(rng, n, sources):
    return [(k, rng.choice([None, "", " \t\x0b"]) if rng.random() < 0.1 else " ".join(["wörd"] * rng.randint(1, 40)), rng.choice(sources)) for k in range(n)]


def taken(df):
    return Counter((r.id, r.source, r.size, r.source_size, round(r.target, 6), r.taken) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_against_the_plain_version(spark, seed):
    rng = random.Random(seed)
    sources = [["a", "b", "c"], ["web"] * 30 + ["éa", "Z", None, "a b", "small"], [f"s{k}" for k in range(30)] + [None]][seed]
    rows = rows_for(rng, 300, sources) + [(5, "one two", sources[0])] * 4 + [(None, "x y z", sources[0]), (None, "x y", sources[0]), (7, "empty source", "")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("part", F.lit(1)).withColumn("key", F.lit("k")).withColumn("words", F.lit(3)).repartition(3)
    want = slow_mix(rows)
    assert taken(mixing.mix(docs)) == want and len(want) > 100
    by_source = Counter()
    for (_, s, n, _, target, got), times in want.items():
        by_source[s, target] += got * times
        assert got <= 3 * n
    assert all(abs(got - target) <= 0.5 + 1e-6 for (_, target), got in by_source.items())


def test_hot_source_many_ranges_and_copies(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 20)
    monkeypatch.setattr(mixing, "COPIES", 7)
    rng = random.Random(4)
    rows = rows_for(rng, 200, ["hot", "hot", "hot", "x", "y"]) + [(1, "a b c d", "hot")] * 100
    docs = spark.createDataFrame(rows, SCHEMA)
    assert taken(mixing.mix(docs)) == slow_mix(rows)
    assert taken(mixing.mix(docs.repartition(7))) == slow_mix(rows)


def test_mixture_holds_what_the_mix_takes(spark):
    rng = random.Random(6)
    rows = rows_for(rng, 80, ["a", "b", "b", "b", None]) + [(3, "twice the same", "a")] * 2
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("epoch", F.lit("e"))
    out = mixing.mixture(docs).collect()
    got, want = Counter(), Counter()
    for r in out:
        got[r.doc_id, r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    for r in mixing.mix(docs).collect():
        want[r.id, r.source] += r.taken
    assert got == Counter({k: v for k, v in want.items() if v}) and all(r.epoch == "e" for r in out)
    texts = {(i, s): t for i, t, s in rows}
    assert all(texts[r.doc_id, r.source].startswith(r.text) for r in out)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(docs).count() == 0 == mixing.mixture(docs).count()
    bare = spark.createDataFrame([(1, None, None), (2, "", "a")], SCHEMA)
    assert sorted((r.id, r.size, r.target, r.taken) for r in mixing.mix(bare).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_no_python_on_the_main_path(spark):
    plan = mixing.mix(spark.read.parquet(f"{FOLDER}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_query_against_its_sql(spark):
    ok, message, _ = compare(spark, connect(FOLDER), "op13", QUERIES["op13_source_mixture"], ORACLES["op13_source_mixture"], FOLDER)
    assert ok and "TYPES" not in message, message
