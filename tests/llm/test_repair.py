import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from chalkline.llm import repair
from chalkline.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"


def slow_cheapest(symbols, start=0, ends=(0, 3)):
    """Relaxation over all nodes, whole audits kept, until nothing changes."""
    follow = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
    best = {(0, start): (0, "")}
    changed = True
    while changed:
        changed = False
        for (i, state), (cost, audit) in list(best.items()):
            steps = [("I", 2, i, to) for c, to in follow[state].items() if c != "s"]
            if i < len(symbols):
                c = symbols[i]
                steps.append(("D", 3, i + 1, state))
                if c != "-":
                    steps += [("R", 2 + c.isupper(), i + 1, to) for k, to in follow[state].items() if k != "s"]
                    steps += [("K", 0 + c.isupper(), i + 1, to) for k, to in follow[state].items() if k == c.lower()]
            for letter, w, j, to in steps:
                new = (cost + w, audit + letter)
                if (j, to) not in best or new < best[j, to]:
                    best[j, to] = new
                    changed = True
    found = [best[len(symbols), e] for e in ends if (len(symbols), e) in best]
    return min(found) if found else None


def slow_rows(rows):
    """Damaged rows by conversation."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = [" " if x is None else x for x in (role, text)]
        out.setdefault(conv, [])
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault:
            text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
            out[conv] += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def slow_repair(rows):
    out = {}
    for conv, kept in slow_rows(rows).items():
        kept.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        turns = [t for t, _, _ in kept if t is not None]
        symbols, counts, seen = "", {"blank": 0, "duplicate": 0, "truncated": 0}, set()
        for _, role, text in kept:
            end = text.rstrip(WHITE)[-1:]
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            c = role[:1] if role[:1] in ("s", "u", "a") else "x"
            symbols += "-" if fault in ("blank", "duplicate") else c.upper() if fault else c
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit = slow_cheapest(symbols)
        lines, at, last = [], 0, ""
        for letter in audit:
            needed = "assistant" if last == "u" else "user"
            if letter == "I":
                lines.append(f"{needed}:")
                last = needed[0]
                continue
            _, role, text = kept[at]
            at += 1
            if letter != "D":
                role = role if letter == "K" else needed
                lines.append(f"{role}:{text}")
                last = role[0]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_every_short_word_of_symbols():
    rng = random.Random(1)
    words = [""] + ["".join(rng.choices("suaxSUAX-", k=rng.randint(1, 9))) for _ in range(1500)]
    for w in words:
        assert repair.cheapest(w) == slow_cheapest(w), w
    for w in words[:200]:
        for start in range(4):
            for end in range(4):
                assert repair.cheapest(w, start, (end,)) == slow_cheapest(w, start, (end,)), (w, start, end)


def test_blocks_chain_to_the_whole():
    rng = random.Random(2)
    for _ in range(150):
        w = "".join(rng.choices("suaxUA-", weights=[1, 6, 6, 1, 2, 2, 1], k=rng.randint(0, 40)))
        chain, size = repair.Chain(), rng.randint(1, 9)
        parts = [w[k:k + size] for k in range(0, len(w), size)] or [""]
        for p in parts[:-1]:
            chain.add(p)
        chain.add(parts[-1], last=True)
        assert chain.best() == slow_cheapest(w), (w, size)


def rows_for(rng, n):
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "User"])
            text = rng.choice(["Yes.", "No", "Well?  \n", "", " \t", None, "Über alles!", "a.b!c?", f"text {turn}."])
            rows.append((conv, rng.choice([turn, turn, turn, 2 * turn, None]), role, text))
    return rows


@pytest.fixture()
def table(spark):
    return lambda rows: spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_against_the_plain_version(spark, table):
    rows = rows_for(random.Random(5), 250) + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (900, None, None, None), (901, 3, "user", "x" * 100_000)]
    rows += [(905, k, "user" if k % 2 else "assistant", f"{k}.") for k in range(5000)]  # several blocks
    docs = table(rows).withColumn("conv", F.lit(1)).withColumn("place", F.lit("p")).withColumn("fault", F.lit(2))
    got = {r.conv: tuple(r[c] for c in COLUMNS) for r in repair.damaged_and_repaired(docs.repartition(3)).collect()}
    want = slow_repair([r for r in rows if r[0] != 905])
    assert {k: v for k, v in got.items() if k != 905} == want
    assert got[905][5] <= 3 * 5000 and set(got[905][6]) <= set("KRDI")


def test_rows_of_the_repair(spark, table):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "What?"), (2, 0, "system", "Be."), (3, 0, "user", "A."), (3, 1, "assistant", "B.")]
    marked = repair.faults(table(rows).select(F.col("conv_id").alias("conv"), "turn", "role", "text"))
    found = repair.audits(marked)
    out = sorted(tuple(r) for r in repair.repaired_rows(marked, found).collect())
    assert {r.conv: (r.cost, r.audit) for r in found.collect()} == {1: (4, "IKKI"), 2: (3, "D"), 3: (0, "KK")}
    assert out == [(1, 1, "I", "user", ""), (1, 2, "K", "assistant", "Hello."), (1, 3, "K", "user", "What?"), (1, 4, "I", "assistant", ""),
                   (3, 1, "K", "user", "A."), (3, 2, "K", "assistant", "B.")]


def test_empty_table_and_lost_conversations(spark, table):
    assert repair.damaged_and_repaired(table([])).count() == 0
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    out = repair.damaged_and_repaired(table([(lost, 0, "user", "Hi.")])).collect()
    assert [tuple(r) for r in out] == [(lost, 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())]


def test_query_against_the_plain_version(spark):
    table = spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text")
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op12_conversation_repair"](spark, FOLDER).collect()}
    assert got == slow_repair([tuple(r) for r in table.collect()]) and len(got) >= 20
