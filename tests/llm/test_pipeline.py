"""The pipeline against a plain version: every stage by loops over the rows its predecessor kept."""

import re
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from chalkline.llm import quality
from chalkline.llm.queries import QUERIES, WORD_VOCABULARY, vocabulary_path
from tests.llm.test_lines import slow_cuts
from tests.llm.test_simhash import slow_components, slow_fingerprint

FOLDER = "/root/testdata/sf0.001"


def leaking(text, items):
    """Does an item lie along the words at any offset with enough words in place?"""
    words = [w for w in re.split(r"[^\w]|_", (text or "").lower()) if w]
    where = {}
    for i, w in enumerate(words):
        where.setdefault(w, []).append(i)
    for b in items:
        size = min(20, len(b))
        least = 0.7 * size if len(b) >= 11 else size
        shared = Counter(i - j for j, w in enumerate(b) for i in where.get(w, ()))
        for k in [k for k, n in shared.items() if n >= least]:
            equal = [0 <= k + p < len(words) and words[k + p] == w for p, w in enumerate(b)]
            if max(sum(equal[p:p + size]) for p in range(len(b) - size + 1)) >= least:
                return True
    return False


def slow_pipeline(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = quality.learn(docs, labels)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    rows = [(i, t) for i, t in rows if model.score(t or "") >= quality.THRESHOLD]
    rows = list(zip([i for i, _ in rows], slow_cuts(rows)))
    first = dict(slow_components([(i, slow_fingerprint(t)) for i, t in rows]))
    rows = [(i, t) for i, t in rows if first[i] == i]
    items = [[w for w in re.split(r"[^\w]|_", r.text.lower()) if w] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if not leaking(t, items)]
    library = Tokenizer.from_file(vocabulary_path(WORD_VOCABULARY))
    return {i: library.encode(t, add_special_tokens=False).ids for i, t in rows}, library


def test_run_against_the_plain_version(spark):
    want, library = slow_pipeline(spark)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert {i: r.ids for i, r in got.items()} == want and len(want) > 50
    assert all(r.n_tokens == len(r.ids) and r.decoded == library.decode(r.ids, skip_special_tokens=False) for r in got.values())


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "BPE encoding and decoding"]
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs.limit(0), FOLDER)
        assert out.dtypes == docs.dtypes and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), FOLDER).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_read_their_whole_table(spark, name):
    rows = QUERIES[name](spark, FOLDER).count()
    table = {"op2": None, "op3": "pages", "op8": "pages", "op9": None, "op11": None, "op12": None}.get(name.split("_")[0], "documents")
    if table:
        assert rows == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
