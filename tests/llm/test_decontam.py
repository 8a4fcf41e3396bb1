import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from chalkline.llm import decontam
from chalkline.llm.queries import ORACLES, QUERIES
from tests.oracle_check import compare, connect

WORDS = [f"word{k}" for k in range(400)]


def slow(docs, items):
    """{(doc, item)} by laying every item along every document at every offset, where a window meets."""
    tokens = lambda t: [w for w in re.split(r"[^a-z0-9]+", (t or "").lower()) if w]
    out = {}
    for i, t in docs:
        d = tokens(t)
        for k, u in items:
            b = tokens(u)
            if not b:
                continue
            for at in range(-len(b) + 1, len(d)):
                equal = [0 <= at + p < len(d) and d[at + p] == w for p, w in enumerate(b)]
                size = min(20, len(b))
                if max(sum(equal[p:p + size]) for p in range(len(b) - size + 1)) >= (0.7 * size if len(b) >= 11 else size):
                    out[i, k] = max(sum(equal), out.get((i, k), 0))
    return out


@pytest.fixture()
def items(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choices(WORDS, k=rng.randint(9, 45)))) for k in range(12)] + [(50, None), (51, ""), (None, " ".join(rng.choices(WORDS, k=30)))]
    return rows, spark.createDataFrame(rows, "item_id long, text string")


def test_against_all_offsets(make_docs, items):
    rng = random.Random(9)
    rows = []
    for k in range(60):
        body = rng.choices(WORDS, k=rng.randint(0, 120))
        b = (items[0][k % 15][1] or "").split()
        every = rng.choice([0, 3, 4, 5, 7])
        b = ["other" if every and n % every == every - 1 else w for n, w in enumerate(b)]
        if k % 4 == 3:
            b = b[: len(b) // 2]
        at = rng.randint(0, len(body))
        rows.append((k, ", ".join(body[:at]) + " -- " + " ".join(b).title() + "! " + " ".join(body[at:])))
    rows += [(5, rows[5][1]), (None, items[0][3][1]), (70, None), (71, ""), (72, "?!"), (73, " ".join(items[0][2][1].split() * 50))]
    want = slow(rows, items[0])
    docs = make_docs(rows).withColumn("row", F.lit(1)).withColumn("item", F.lit(2)).withColumn("words", F.lit("w")).withColumn("leak_row", F.lit(7))
    got = {}
    for r in decontam.overlaps(docs, items[1]).collect():
        got[r.id, r.item] = max(r.matched, got.get((r.id, r.item), 0))
    assert got == want and len(want) > 20
    kept = decontam.without_leaks(docs, items[1])
    assert kept.columns == docs.columns and all(r.leak_row == 7 for r in kept.collect())
    leaking = {i for i, _ in want}
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(i) for i, _ in rows if i not in leaking)


def test_substitutions_are_found(make_docs, items):
    text = next(t for _, t in items[0] if t and len(t.split()) >= 25).split()
    assert len(text) >= 20
    rows = [(e, "Before it " + " ".join("x" if n % e == e - 1 else w for n, w in enumerate(text)) + " and after") for e in (4, 5, 6, 9)]
    assert {r.id for r in decontam.overlaps(make_docs(rows), items[1]).collect()} == {4, 5, 6, 9}


def test_without_broadcast_and_empty_tables(make_docs, items, monkeypatch):
    docs = make_docs([(1, items[0][0][1])])
    monkeypatch.setattr(decontam, "BROADCAST_SEEDS", -1)
    assert decontam.overlaps(docs, items[1]).count() == 1
    assert decontam.overlaps(docs.limit(0), items[1]).count() == 0 == decontam.overlaps(docs, items[1].limit(0)).count()
    assert decontam.without_leaks(docs, items[1].limit(0)).count() == 1


def test_query_against_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    ok, message, _ = compare(spark, connect(folder), "op9", QUERIES["op9_benchmark_leaks"], ORACLES["op9_benchmark_leaks"], folder)
    assert ok, message


def test_every_accepted_stretch_is_met():
    for size in range(decontam.SPAN, decontam.STRETCH + 1):
        least = next(n for n in range(size + 1) if n >= decontam.SHARE * size)
        for equal in itertools.combinations(range(size), least):
            have = set(equal)
            assert any(all(at + p in have for p in m) for m in decontam.COVER for at in range(size)), (size, equal)


def test_all_offsets_without_a_seed(spark, make_docs):
    rng = random.Random(4)
    items = [(k, rng.choices(WORDS, k=n)) for k, n in enumerate([1, 2, 5, 9, 10, 11, 11, 12, 13, 15, 15, 17, 19, 20, 20, 25, 40, 59])]
    items[0] = (0, ["rareword"])
    rows = []
    for k in range(180):
        b = list(items[k % 18][1])
        for at in rng.sample(range(len(b)), rng.randint(0, max(1, len(b) * 2 // 5)) if len(b) > 1 and k % 5 else 0):
            b[at] = "other"
        body = rng.choices(WORDS, k=rng.randint(0, 60))
        at = rng.randint(0, len(body))
        rows.append((k, body[:at] + b + body[at:]))
    want = {}
    for i, d in rows:
        for k, b in items:
            size = min(20, len(b))
            for at in range(-len(b) + 1, len(d)):
                equal = [0 <= at + p < len(d) and d[at + p] == w for p, w in enumerate(b)]
                if max(sum(equal[p:p + size]) for p in range(len(b) - size + 1)) >= (0.7 * size if len(b) >= 11 else size):
                    want[i, k] = max(sum(equal), want.get((i, k), 0))
    found = decontam.overlaps(make_docs([(i, " ".join(d)) for i, d in rows]), spark.createDataFrame([(k, " ".join(b)) for k, b in items], "item_id long, text string"))
    got = {}
    for r in found.collect():
        got[r.id, r.item] = max(r.matched, got.get((r.id, r.item), 0))
    assert got == want and len(want) > 80
