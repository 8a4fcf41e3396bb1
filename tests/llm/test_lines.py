import random
import re

import xxhash
from pyspark.sql import functions as F

from chalkline.llm import lines

WORDS = [a + b + c for a in ("ba", "do", "ki", "lu", "me") for b in ("ra", "so", "ti", "vu", "") for c in ("n", "st", "l", "rk")]


def sentence(rng, low=4, high=14):
    return " ".join(rng.choices(WORDS, k=rng.randint(low, high))).capitalize() + "."


def passage(rng, n=8, between=" "):
    return between.join(sentence(rng) for _ in range(n))


def slow_units(text):
    """(unit, its block) in order: sentences of lines that have several, else lines; neighbouring short lines are one block."""
    units, block, joined = [], 0, False
    for line in text.split("\n"):
        if not line.strip():
            continue
        parts = [line] if "\0" in line else re.split(r"(?<=[.?!]) ", line)
        alone = len(parts) > 1 or len(line.split(" ")) >= 40
        if alone or not joined:
            block += 1
        joined = not alone
        units += [(p, block) for p in parts]
    return units


def slow_chunks(text):
    """(start, end, body, hashes before, hashes after): chunks between the boundaries of every block, then the shortest run from every unit."""
    units = slow_units(text)
    texts, words = [u for u, _ in units], [len(u.split(" ")) for u, _ in units]
    h = [xxhash.xxh64_intdigest(t) for t in texts]
    found = []
    for block in sorted({b for _, b in units}):
        mine = [i for i, (_, b) in enumerate(units) if b == block]
        ends, start = [], mine[0]
        for i in mine[1:-1]:
            if i > start and ((h[i - 1] * 31 + h[i]) >> 17) % 2 == 0:
                ends.append(i + 1)
                start = i + 1
        for a, b in zip([mine[0], *ends], [*ends, mine[-1] + 1]):
            if sum(words[a:b]) >= 8 and (b - a > 1 or words[a] >= 40):
                found.append((a, b, "\n".join(texts[a:b]), h[max(0, a - 6):a][::-1], h[b:b + 6]))
    for a in range(len(units)):
        b = next((b for b in range(a + 1, len(units) + 1) if sum(words[a:b]) >= (20 if b - a > 1 else 40)), None)
        if b:
            found.append((a, b, ("run", "\n".join(texts[a:b])), [], []))
    return found


def slow_cuts(rows):
    """Occurrences that go, by plain dictionaries: every chunk of equal bytes but the first, with its margins; what overlaps the first in its own text stays."""
    places = {}
    for order, (i, t) in enumerate(rows):
        for a, b, body, before, after in slow_chunks(t or ""):
            places.setdefault(body, []).append(((i is None, i or 0, order), a, b, before, after))
    cuts = {}
    for seen in places.values():
        seen.sort(key=lambda x: (x[0], x[1]))
        first, _, end, before0, after0 = seen[0]
        for key, a, b, before, after in seen[1:]:
            if key == first and a < end:
                continue
            left = next((k for k in range(max(len(before), len(before0))) if before[k:k + 1] != before0[k:k + 1]), len(before))
            right = next((k for k in range(max(len(after), len(after0))) if after[k:k + 1] != after0[k:k + 1]), len(after))
            cuts.setdefault(key[2], []).append((a - left, b + right))
    return [t if t is None or k not in cuts else lines.without(t, cuts[k]) for k, (_, t) in enumerate(rows)]


def corpus():
    rng = random.Random(3)
    shared = [passage(rng), passage(rng, 9, "\n"), passage(rng, 12), " ".join(rng.choices(WORDS, k=60))]
    rows = []
    for k in range(80):
        parts = [passage(rng, rng.randint(1, 5), rng.choice([" ", "\n"])) for _ in range(rng.randint(1, 5))]
        if k % 3 == 0:
            parts.insert(rng.randint(0, len(parts)), shared[k // 3 % 4])
        rows.append((k, "\n".join(parts)))
    return rows, shared


def test_shared_passages_stay_once(spark, make_docs):
    rows, shared = corpus()
    out = {r.doc_id: r.text for r in lines.drop_repeated(make_docs(rows)).collect()}
    assert len(out) == len(rows)
    for p in shared:
        assert [k for k, t in sorted(out.items()) if p in t] == [min(k for k, t in rows if p in t)]
        rest = [w for k, t in sorted(out.items())[1:] for w in p.split("\n")[1:-1] if len(w.split()) > 8 and w in t]
        assert len(rest) <= len(p.split("\n"))
    for k, t in rows:
        own = [line for line in t.split("\n") if not any(line in p or p in line for p in shared)]
        assert all(line in out[k] for line in own)


def test_against_plain_dictionaries(spark, make_docs):
    rows, _ = corpus()
    rows += [(k + 100, rows[k % 7][1]) for k in range(20)] + [(200, rows[0][1] + "\n" + rows[1][1]), (None, rows[2][1]), (300, None), (301, ""), (302, "\n \n")]
    got = {(r.doc_id, r.n_chars): r.text for r in lines.drop_repeated(make_docs(rows)).collect()}
    want = slow_cuts(rows)
    assert got == {(i, None if t is None else len(t)): t for (i, _), t in zip(rows, want)}


def test_boundaries_resist_shifts():
    rng = random.Random(8)
    p = passage(rng, 40, "\n").replace(". ", " ")
    a = {c[3] for c in lines.chunks_of(p)}
    b = {c[3] for c in lines.chunks_of("One more line here\n" + p)}
    assert len(a & b) >= len(a) - 2


def test_odd_rows(spark, make_docs):
    assert lines.drop_repeated(make_docs([])).count() == 0
    long = "\n".join(f"line number {k} of a very long text with words" for k in range(40_000))
    rows = [(1, long), (1, long), (2, long), (3, "a\0b. c. d"), (4, "x. " * 5000)]
    docs = make_docs(rows).withColumn("hash", F.lit("h")).withColumn("row", F.lit(1)).withColumn("cut", F.lit(2))
    out = lines.drop_repeated(docs)
    assert out.columns == docs.columns
    got = sorted((r.doc_id, len(r.text)) for r in out.collect())
    assert got[:3] == [(1, len(long)), (1, len(long)), (2, 0)] and got[3] == (3, 9)


def test_short_passages_between_foreign_neighbours(spark, make_docs):
    """Every passage of 50 words and more, in one to six sentences or lines, is gone from all documents but the first."""
    rng = random.Random(12)
    rows, passages = [], []
    for k in range(60):
        n, between = 1 + k % 6, " " if k % 2 else "\n"
        size = -(-54 // n)
        p = between.join(sentence(rng, size, size) for _ in range(n))
        passages.append(p)
        for copy in range(2):
            parts = [passage(rng, rng.randint(1, 4), between), p, passage(rng, rng.randint(1, 4), between)]
            rows.append((2 * k + copy, between.join(parts)))
    out = {r.doc_id: r.text for r in lines.drop_repeated(make_docs(rows)).collect()}
    for k, p in enumerate(passages):
        assert out[2 * k] == rows[2 * k][1]
        words = p.split()
        windows = {tuple(words[i:i + 20]) for i in range(len(words) - 19)}
        left = out[2 * k + 1].split()
        assert not windows & {tuple(left[i:i + 20]) for i in range(len(left) - 19)}
        assert len(left) == len(rows[2 * k + 1][1].split()) - len(words)


def test_first_occurrence_stays_in_periodic_texts(spark, make_docs):
    out = lines.drop_repeated(make_docs([(1, "one two three four five. " * 40), (2, "a b c d e f g.\nh i j k l m n.\n" * 20)])).collect()
    left = {r.doc_id: len(r.text.split()) for r in out}
    assert 20 <= left[1] < 60 and 20 <= left[2] < 70


def staged(monkeypatch):
    """Tables that the line search stages, by name."""
    kept, write = {}, lines.stage

    def keep(df, name):
        kept[name] = write(df, name)
        return kept[name]

    monkeypatch.setattr(lines, "stage", keep)
    return kept


def test_little_is_moved(spark, make_docs, monkeypatch):
    """Cuts of one passage are one range, runs move as digests, and lines that never repeat are not moved."""
    rng = random.Random(21)
    p = passage(rng, 40, "\n")
    rows = [(1, p), (2, p)] + [(k, passage(rng, 40, "\n")) for k in range(3, 60)]
    kept = staged(monkeypatch)
    out = {r.doc_id: r.text for r in lines.drop_repeated(make_docs(rows)).collect()}
    assert out == dict(rows) | {2: ""}
    assert [[tuple(c) for c in r[lines.CUT]] for r in kept["cuts"].collect()] == [[(0, 40)]]
    seen = kept["seen"].collect()
    copied = {(a, b) for a, b, *_ in slow_chunks(p)}
    assert {(r.start, r.stop) for r in seen if r.id == 2} == copied
    assert len(seen) < 2 * len(slow_chunks(p)) + 57 * 60 // 4
    bodies = {body for _, _, body, *_ in slow_chunks(p) if isinstance(body, str)}
    assert {r.body for r in seen if r.id == 2} == bodies | {None}


def test_a_full_filter_changes_nothing(spark, make_docs, monkeypatch):
    """What the filter lets through besides is counted out."""
    full = lines.make_filter(spark.range(0).selectExpr("id as hash"))
    full.table[:] = 255
    monkeypatch.setattr(lines, "make_filter", lambda hashes: full)
    rows, _ = corpus()
    kept = staged(monkeypatch)
    got = {r.doc_id: r.text for r in lines.drop_repeated(make_docs(rows)).collect()}
    assert got == {i: t for (i, _), t in zip(rows, slow_cuts(rows))}
    assert kept["seen"].count() == sum(len(slow_chunks(t)) for _, t in rows)
