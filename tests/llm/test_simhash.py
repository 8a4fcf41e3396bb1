import random

import xxhash
from pyspark.sql import functions as F

from chalkline.llm import graph, simhash


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    """{id: smallest linked id} over (id, fp) rows, by comparing all."""
    label = {fp: fp for _, fp in fps}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    distinct = sorted({fp for _, fp in fps})
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                label[find(a)] = find(b)
    least = {}
    for i, fp in fps:
        if i is not None:
            least[find(fp)] = min(i, least.get(find(fp), i))
    return [(i, least.get(find(fp))) for i, fp in fps]


def test_fingerprint_of_odd_texts():
    for t in ["", " \t\x0b\n", "one", "One TWO", "a b c", "É é É", "x" * 200_000, "w " * 5000, "a b c a b c a b c", "\x1c\x85 a b c d"]:
        assert simhash.fingerprint(t.encode()) == slow_fingerprint(t), t[:20]


def test_groups_against_all_pairs(spark, make_docs):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 400))) for _ in range(60)]
    rows = [(k, base[k % 60]) for k in range(90)] + [(100, None), (101, ""), (102, "  "), (None, base[3]), (None, None), (7, base[7])]
    for k in range(120):
        t = base[k % 60].split()
        t[rng.randrange(len(t))] = "changed"
        rows.append((200 + k, " ".join(t)))
    got = simhash.near_groups(make_docs(rows)).collect()
    want = slow_components([(i, slow_fingerprint(t)) for i, t in rows])
    assert sorted(((r.id, r.component) for r in got), key=str) == sorted(want, key=str)
    assert len(got) == len(rows)


def test_hot_lists_keep_every_component(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LIST_ROWS", 4)
    rng = random.Random(2)
    fps = {0, (1 << 64) - 1}
    for _ in range(30):
        at = rng.getrandbits(64)
        for _ in range(25):
            fps.add(at)
            at ^= 1 << rng.randrange(64)
            at ^= (1 << rng.randrange(64)) * rng.randint(0, 1)
    rows = [(k, fp - (1 << 64) if fp >> 63 else fp) for k, fp in enumerate(sorted(fps))]
    df = spark.createDataFrame(rows, "id long, fp long")
    parts = graph.connected_components(simhash.links(df.select("fp")))
    of = {r.node: r.component for r in parts.collect()}
    plain = {i: fp & ((1 << 64) - 1) for i, fp in rows}
    want = {}
    for i, c in slow_components(list(plain.items())):
        want.setdefault(c, set()).add(i)
    got = {}
    for i, fp in rows:
        got.setdefault(of.get(fp, fp), set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_empty_table_and_clashing_columns(spark, make_docs):
    assert simhash.near_groups(make_docs([])).count() == 0
    extra = make_docs([(1, "a b c"), (2, "a b c")]).withColumn("fp", F.lit("x")).withColumn("component", F.lit(9)).withColumn("id", F.lit(5))
    assert sorted((r.id, r.component) for r in simhash.near_groups(extra).collect()) == [(1, 1), (2, 1)]


def test_one_row_of_each_group_stays(spark, make_docs):
    rng = random.Random(7)
    base = [" ".join(f"v{rng.randrange(500)}" for _ in range(rng.randint(1, 90))) for _ in range(25)]
    rows = [(k, base[k % 25]) for k in range(60)] + [(3, base[3]), (3, base[3]), (None, base[4]), (None, "only null ids"), (None, "only null ids"), (70, None), (71, ""), (71, "")]
    docs = make_docs(rows).withColumn("fp", F.lit(1)).withColumn("row", F.lit(2)).withColumn("who", F.lit("w"))
    out = simhash.first_of_groups(docs)
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    least = dict.fromkeys(c for _, c in slow_components([(i, slow_fingerprint(t)) for i, t in rows]))
    assert sorted((i for i, _ in got), key=str) == sorted(least, key=str) and len(got) == len(least)
    assert simhash.first_of_groups(make_docs([])).count() == 0
