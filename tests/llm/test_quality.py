import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chalkline.llm import crf, quality

FOLDER = "/root/testdata/sf0.01"


def test_chain_against_all_labellings():
    rng = np.random.default_rng(1)
    chain = crf.Chain(rng.normal(size=3), rng.normal(size=(2, 2)))
    for n in (1, 2, 6):
        u = rng.normal(size=n).tolist()
        scores = {y: sum(a * b for a, b in zip(u, y)) + sum(chain.move[i, j] for i, j in zip(y, y[1:])) for y in itertools.product((0, 1), repeat=n)}
        total = sum(np.exp(s) for s in scores.values())
        assert chain.marginals(u) == pytest.approx([sum(np.exp(s) for y, s in scores.items() if y[k]) / total for k in range(n)])
        assert chain.viterbi(u) == list(max(scores, key=scores.get))
    assert chain.marginals([]) == [] and chain.viterbi([]) == []


def test_gradient_is_the_slope():
    rng = np.random.default_rng(2)
    lengths = np.array([3, 1, 5])
    x, y = rng.normal(size=(9, 2)), rng.integers(0, 2, 9)
    starts = np.array([0, 3, 4])[np.argsort(-lengths, kind="stable")]
    sizes = np.sort(lengths)[::-1]
    steps = [starts[: int((sizes > t).sum())] + t for t in range(5)]
    theta = rng.normal(size=6)
    _, grad = crf._objective(theta, x, y, steps, 0.3)
    for k in range(6):
        e = np.eye(6)[k] * 1e-6
        slope = (crf._objective(theta + e, x, y, steps, 0.3)[0] - crf._objective(theta - e, x, y, steps, 0.3)[0]) / 2e-6
        assert grad[k] == pytest.approx(slope, abs=1e-4)


@pytest.fixture(scope="module")
def model(spark):
    return quality.learn(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))


def test_held_out_accuracy(spark, model):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = quality.score(spark.read.parquet(f"{FOLDER}/documents.parquet"), model).join(labels, F.col("id") == F.col("doc_id")).where(
        quality.is_held_out("doc_id")).select("doc_id", "score", "quality").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    right = [(r.score >= quality.THRESHOLD) == bool(r.quality) for r in rows]
    assert len(rows) > 40 and sum(right) / len(rows) >= 0.95


def test_odd_rows(spark, model, make_docs):
    long = "\n".join("Some plain words, in a line of text." for _ in range(3000))
    docs = make_docs([(1, None), (1, None), (2, ""), (3, " \n\t\n"), (4, long), (None, "x"), (5, "퟿\x00|\x85")]).withColumn("score", F.lit("clash"))
    out = quality.score(docs, model).collect()
    assert len(out) == 7 and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.id in (1, 2, 3)}) == 1
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.score(make_docs([]), model).count() == 0


def test_without_both_labels_the_share_is_the_score(spark, make_docs):
    docs = make_docs([(k, f"line {k}") for k in range(30)])
    labels = spark.createDataFrame([(k, 1, 0) for k in range(30)] + [(3, 0, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    m = quality.learn(docs, labels)
    assert len({m.score(t) for t in ("", "a", "b\nc" * 100)}) == 1 and m.score("a") > 0.8
    assert quality.learn(docs, labels.limit(0)).score("a") == pytest.approx(0.5)


def test_features_follow_the_neighbours():
    x, size = quality.line_features("Good line of words here.\n%%% $$$ ###\n\nAnother good line.")
    assert len(size) == 3 and x[0, quality.OWN + len(quality.NEAR) + 1] == x[1, 2] and x[2, quality.OWN + 1] == x[1, 2]
