import random
import re
from collections import Counter

from pyspark.sql import functions as F

from chalkline.llm import collocations
from chalkline.llm.queries import ORACLES, QUERIES
from tests.oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string"


def pieces(text):
    small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", small)]


def slow(rows, least=100, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        for words in pieces(text):
            n[lang or "und"] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang or "und", tuple(words[i:i + k])] += 1
    found = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            score, cut = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), p, f[lang, p[:cut]], f[lang, p[cut:]]))
    out = []
    for lang, mine in found.items():
        held = set()
        for _, a, _, p, _, _ in mine:
            held |= {(p[i:i + k], q) for k in range(2, len(p)) for i in range(len(p) - k + 1) for q in [-a]}
        most = {}
        for p, a in held:
            most[p] = max(a, most.get(p, 0))
        kept = sorted(x for x in mine if 100 * most.get(x[3], 0) < -100 * x[1])
        out += [(lang, rank, " ".join(p), -a, left, right, n[lang], -score) for rank, (score, a, _, p, left, right) in enumerate(kept[:top], 1)]
    return sorted(out)


def corpus(rng, n=150):
    vocab = [f"{a}{b}" for a in ("Ba", "dé", "ki", "LU", "mé", "ÉT") for b in ("ra", "so", "ti", "", "-x")]
    fixed = ["New  York City", "in spite\tof all that", "a b c d e f g h i j k l m n o p q r s t u v w x y z", "la la la la la la"]
    rows = []
    for k in range(n):
        parts = []
        for _ in range(rng.randint(0, 12)):
            parts += rng.choices(vocab, k=rng.randint(0, 14)) + [rng.choice(fixed)] * rng.randint(0, 1) + [rng.choice([". ", ", ", "\n", "?!", "\x0b", " ", "\r\n"])]
        rows.append((k, " ".join(parts), rng.choice(["en", "en", "fr", None, "und"])))
    return rows + [(900, None, "en"), (901, "", None), (902, " .\t", "xx"), (None, "one long text with words " * 3000, "fr"), (903, rows[0][1], "en"), (903, rows[0][1], "en")]


def test_chunks_own_every_ngram_once():
    rng = random.Random(1)
    for _ in range(200):
        words = [b"%d" % rng.randint(0, 9) for _ in range(rng.randint(1, 80))]
        want, got = Counter(), Counter()
        for k in range(1, 6):
            for i in range(len(words) - k + 1):
                want[tuple(words[i:i + k])] += 1
        parsed = list(collocations.chunks_of(words))
        for chunk, last in parsed:
            mine = chunk.split(b" ")
            for i in range(len(mine) - (0 if last else collocations.OVERLAP)):
                for k in range(1, 6):
                    if i + k <= len(mine):
                        got[tuple(mine[i:i + k])] += 1
        assert got == want and [last for _, last in parsed] == [False] * (len(parsed) - 1) + [True]


def test_equal_passages_have_equal_chunks():
    rng = random.Random(2)
    words = [b"w%d" % rng.randint(0, 300) for _ in range(400)]
    a = {c for c, _ in collocations.chunks_of(words)}
    b = {c for c, _ in collocations.chunks_of([b"other", b"words"] + words)}
    assert len(a) > 10 and len(a & b) >= len(a) - 2


def test_against_the_plain_version(spark):
    rows = corpus(random.Random(3))
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit(1)).withColumn("chunk", F.lit("c")).withColumn("words", F.lit(3)).repartition(5)
    got = sorted(tuple(r) for r in collocations.collocations(docs, least=20).collect())
    assert got == slow(rows, 20) and len({len(r[2].split()) for r in got}) >= 4 and len({r[0] for r in got}) >= 3
    assert sorted(tuple(r) for r in collocations.collocations(docs, least=20, top=3).collect()) == slow(rows, 20, 3)


def test_filter_keeps_all_hashes(spark, monkeypatch):
    monkeypatch.setattr(collocations, "FILTER_BITS", 1 << 17)
    hashes = spark.range(40_000).select(F.xxhash64("id").alias("hash"))
    known = collocations.make_filter(hashes)
    h = hashes.toPandas()["hash"].to_numpy().view("uint64")
    assert known.has(h).all() and known.bits * collocations.BLOCKS == 1 << 17


def test_small_filters_and_clashing_hashes_change_nothing(spark, monkeypatch):
    rows = corpus(random.Random(7), 60)
    docs = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(collocations, "FILTER_BITS", 1)
    assert sorted(tuple(r) for r in collocations.collocations(docs, least=30).collect()) == slow(rows, 30)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert collocations.collocations(docs).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, "a b", "en"), (2, None, None)], SCHEMA)).count() == 0


def test_query_against_its_sql(spark):
    ok, message, _ = compare(spark, connect(FOLDER), "op11", QUERIES["op11_phrase_collocations"], ORACLES["op11_phrase_collocations"], FOLDER)
    assert ok and "EMPTY" not in message and "TYPES" not in message, message
