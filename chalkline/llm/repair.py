"""Repair of conversation structure by bidirectional Dijkstra over the edit lattice.

A conversation is a row of symbols; a lattice node is (rows read, what has been written last), and an edge is an edit: K keeps a row, R gives it another
role, D deletes it, I inserts an empty turn. What is written must read `(s?(ua)+)?` in initials, so what is written last fixes what may follow. A
forward heap from the start and a reverse heap from the ends take turns until the sum of their least distances is over the best meeting found; by then
every path of least cost has an edge from a node settled forward to one settled in reverse. Of all these crossings the least concatenated audit is
taken. (Of two audits of equal cost between the same nodes neither begins with the other: it would lack an insertion and be cheaper. So least parts
make least wholes.)

Long conversations are read in blocks of `BLOCK` rows: each gives cost and least audit for every pair of states, and the pairs are chained. A task
reads a conversation as a sorted stream and holds one block and the audits. The repaired texts are hashed in a second stream, line by line.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from chalkline.llm.common import rows_of, stage

BLOCK = 2048
SPACES = " \t\n\x0b\x0c\r"
#: States by what has been written last: nothing, s, u, a. What each lets follow, as (initial, state after it).
FOLLOW = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
REROLE, DELETE, INSERT, CUT_SHORT = 2, 3, 2, 1
GONE = "-"  # symbol of a row that must be deleted; others are the initial (x: no known one), upper case if the text is cut short


def _onward(symbols: str, i: int, state: int) -> list[tuple[str, int, int, int]]:
    """Edges (letter, cost, rows read, state) out of a node."""
    follow = FOLLOW[state]
    out = [("I", INSERT, i, to) for initial, to in follow.items() if initial != "s"]
    if i < len(symbols):
        c = symbols[i]
        out.append(("D", DELETE, i + 1, state))
        if c != GONE:
            late = CUT_SHORT if c.isupper() else 0
            if c.lower() in follow:
                out.append(("K", late, i + 1, follow[c.lower()]))
            out += [("R", REROLE + late, i + 1, to) for initial, to in follow.items() if initial != "s"]
    return out


def _backward(symbols: str, i: int, state: int) -> list[tuple[str, int, int, int]]:
    """Edges into a node, as (letter, cost, rows read before, state before)."""
    out = []
    for before in range(4):
        for at in (i, i - 1):
            if at >= 0 and (at == i or i > 0):
                out += [(letter, cost, at, before) for letter, cost, j, to in _onward(symbols, at, before) if (j, to) == (i, state)]
    return out


def cheapest(symbols: str, start: int = 0, ends: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """(cost, least audit of that cost) from `start` over all symbols to one of `ends`; None if there is no way."""
    n = len(symbols)
    if n == 0 and start in ends:
        return 0, ""
    goals = {(n, e) for e in ends}
    heaps: list[list[tuple[int, int, int]]] = [[(0, 0, start)], [(0, n, e) for e in ends]]
    known: list[dict[tuple[int, int], int]] = [{(0, start): 0}, {g: 0 for g in goals}]
    settled: list[dict[tuple[int, int], int]] = [{}, {}]
    best = None

    def top(side: int) -> int | None:
        heap = heaps[side]
        while heap and heap[0][1:] in settled[side]:
            heapq.heappop(heap)
        return heap[0][0] if heap else None

    while True:
        a, b = top(0), top(1)
        if a is None and b is None:
            break
        if best is not None and b != 0 and (a is None or b is None or a + b > best):  # at b = 0 some ends may be unsettled yet
            break
        side = 1 if b is not None and (a is None or b <= a) else 0
        cost, i, state = heapq.heappop(heaps[side])
        settled[side][i, state] = cost
        other = settled[1 - side]
        for _, w, j, to in (_backward if side else _onward)(symbols, i, state):
            node = (j, to)
            if node in other and (best is None or cost + w + other[node] < best):
                best = cost + w + other[node]
            if node not in settled[side] and cost + w < known[side].get(node, cost + w + 1):
                known[side][node] = cost + w
                heapq.heappush(heaps[side], (cost + w, j, to))
    if best is None:
        return None
    heads: dict[tuple[int, int], str] = {(0, start): ""}
    for node, cost in sorted(settled[0].items(), key=lambda x: (x[1], x[0][0])):
        for letter, w, j, to in _onward(symbols, *node):
            if settled[0].get((j, to)) == cost + w and (j, to) != node:
                audit = heads[node] + letter
                if (j, to) not in heads or audit < heads[j, to]:
                    heads[j, to] = audit
    tails: dict[tuple[int, int], str] = {g: "" for g in goals}
    for node, cost in sorted(settled[1].items(), key=lambda x: (x[1], -x[0][0])):
        for letter, w, j, to in _backward(symbols, *node):
            if settled[1].get((j, to)) == cost + w:
                audit = letter + tails[node]
                if (j, to) not in tails or audit < tails[j, to]:
                    tails[j, to] = audit
    crossings = [heads[node] + letter + tails[j, to] for node, cost in settled[0].items() for letter, w, j, to in _onward(symbols, *node)
                 if (j, to) in settled[1] and cost + w + settled[1][j, to] == best]
    return best, min(crossings)


@lru_cache(maxsize=4096)
def _cached(symbols: str, start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    return cheapest(symbols, start, ends)


class Chain:
    """Cost and least audit up to each state, block after block."""

    def __init__(self) -> None:
        self.at: dict[int, tuple[int, str]] = {0: (0, "")}

    def add(self, symbols: str, last: bool = False) -> None:
        found = _cached if len(symbols) <= 64 else cheapest
        if last and list(self.at) == [0]:  # the whole conversation at once
            way = found(symbols, 0, ENDS)
            self.at = {0: (self.at[0][0] + way[0], self.at[0][1] + way[1])}
            return
        after: dict[int, tuple[int, str]] = {}
        for start, (cost, audit) in self.at.items():
            for end in ENDS if last else range(4):
                way = found(symbols, start, (end,))
                if way is not None:
                    whole = (cost + way[0], audit + way[1])
                    if end not in after or whole < after[end]:
                        after[end] = whole
        self.at = after

    def best(self) -> tuple[int, str]:
        return min(self.at.values())


def damage(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text) after the damage: by crc32(`conv:turn`) % 20, 0 drops a row, 1 empties its text, 2 takes its sentence marks, 3 repeats
    it, 4 makes it the user's. Nulls are one space, but for conversation and turn as such."""
    blank = F.lit(" ")
    named = rows.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), blank).alias("role"),
                        F.coalesce(F.col(text_col).cast("string"), blank).alias("text"))
    key = F.concat(F.coalesce(F.col("conv").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    fault = (F.crc32(key.cast("binary")) % 20).alias("fault")
    marked = named.select("conv", "turn", "role", "text", fault).where("fault <> 0")
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return marked.select("conv", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """`rows` with `place` (from 1, in its conversation) and `fault` (blank, duplicate, truncated or null: the first that holds).

    A row is a duplicate if an earlier one of the conversation has its role and text."""
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))
    turn = F.col("turn").asc_nulls_first()
    seen = F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy(turn))
    place = F.row_number().over(Window.partitionBy("conv").orderBy(turn, "role", "text", "seen"))
    dealt = rows.repartition("conv").withColumns({"last": last, "seen": seen}).withColumn("place", place)
    kind: Column = F.when(F.col("last") == "", "blank").when(F.col("seen") > 1, "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    return dealt.withColumn("fault", kind).drop("last", "seen")


def symbol(initial: str, fault: str | None) -> str:
    if fault in ("blank", "duplicate"):
        return GONE
    c = initial if initial in ("s", "u", "a") else "x"
    return c.upper() if fault == "truncated" else c


_LEGAL = {"su", "ua", "au"}
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


class _Reading:
    """One conversation as its rows come by."""

    def __init__(self, conv):
        self.conv, self.chain, self.part, self.counts = conv, Chain(), [], dict.fromkeys(["blank", "duplicate", "truncated", "illegal"], 0)
        self.low = self.high = self.before = None
        self.turns = 0

    def row(self, turn: int | None, initial: str, fault: str | None) -> None:
        if len(self.part) == BLOCK:
            self.chain.add("".join(self.part))
            self.part = []
        self.part.append(symbol(initial, fault))
        if fault:
            self.counts[fault] += 1
        if self.before is not None and self.before + initial not in _LEGAL:
            self.counts["illegal"] += 1
        self.before = initial
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1

    def result(self) -> tuple:
        self.chain.add("".join(self.part), last=True)
        cost, audit = self.chain.best()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, *self.counts.values(), cost, audit)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def audits(marked: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation in `marked` (from `faults`)."""
    source = marked.select("conv", "place", "turn", F.left("role", F.lit(1)).alias("initial"), "fault").repartition("conv").sortWithinPartitions("conv", "place")
    names, kinds = ["conv", *_COUNTS, "audit"], [to_arrow_type(source.schema["conv"].dataType), *[pa.int64()] * len(_COUNTS), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        reading = None
        for conv, place, turn, initial, fault in rows_of(batches, "conv", "place", "turn", "initial", "fault"):
            if place == 1:
                if reading:
                    done.append(reading.result())
                reading = _Reading(conv)
                if len(done) >= 4096:
                    yield _batch(done, names, kinds)
                    done = []
            reading.row(turn, initial, fault)
        if reading:
            done.append(reading.result())
        yield _batch(done, names, kinds)

    return source.mapInArrow(run, f"conv {dict(marked.dtypes)['conv']}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string")


_ROLES = {"u": "user", "a": "assistant"}


class Rewriter:
    """Writes out an audit over the rows of its conversation: (edit, role, text) of each line as soon as its row is known."""

    def __init__(self, audit: str):
        self.audit, self.at, self.follows = audit, 0, "u"

    def _line(self, letter: str, role: str, text: str) -> tuple[str, str, str]:
        self.follows = "a" if role[:1] == "u" else "u"
        return letter, role, text

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            yield self._line("I", _ROLES[self.follows], "")

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter != "D":
            yield self._line(letter, role if letter == "K" else _ROLES[self.follows], text)


def _behind_audits(marked: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, place, role, text) dealt out by conversation and in order, with the audit as the text of place 0."""
    heads = found.select("conv", F.lit(0).alias("place"), F.lit("").alias("role"), F.col("audit").alias("text"))
    rows = marked.select("conv", "place", "role", "text")
    return heads.unionByName(rows).repartition("conv").sortWithinPartitions("conv", "place")


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, place, edit, role, text) of the repaired lines of a stream from `_behind_audits`; each conversation begins with (conv, 0, None, "", "")."""
    conv, writer, n = None, None, 0
    for key, place, role, text in rows_of(batches, "conv", "place", "role", "text"):
        if not place:
            for line in writer.inserted() if writer else ():
                n += 1
                yield (conv, n, *line)
            conv, writer, n = key, Rewriter(text), 0
            yield conv, 0, None, "", ""
        else:
            for line in writer.row(role, text):
                n += 1
                yield (conv, n, *line)
    for line in writer.inserted() if writer else ():
        n += 1
        yield (conv, n, *line)


def repaired_digests(marked: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): the repaired `role:text` lines of each conversation, hashed as they stream by."""
    kind = dict(marked.dtypes)["conv"]
    source = _behind_audits(marked, found)
    kinds = [to_arrow_type(source.schema["conv"].dataType), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        conv, digest = None, None
        for key, place, _, role, text in _lines(batches):
            if not place:
                if digest:
                    done.append((conv, digest.hexdigest()))
                conv, digest = key, sha256()
                if len(done) >= 4096:
                    yield _batch(done, ["conv", "repaired_sha256"], kinds)
                    done = []
            else:
                digest.update(f"{chr(10) if place > 1 else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        if digest:
            done.append((conv, digest.hexdigest()))
        yield _batch(done, ["conv", "repaired_sha256"], kinds)

    return source.mapInArrow(run, f"conv {kind}, repaired_sha256 string")


def repaired_rows(marked: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, place, edit, role, text): the repaired conversations line by line, `place` from 1, inserted turns among them."""
    kind = dict(marked.dtypes)["conv"]
    source = _behind_audits(marked, found)
    names, kinds = ["conv", "place", "edit", "role", "text"], [to_arrow_type(source.schema["conv"].dataType), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        for line in _lines(batches):
            if line[1]:
                done.append(line)
            if len(done) >= 4096:
                yield _batch(done, names, kinds)
                done = []
        yield _batch(done, names, kinds)

    return source.mapInArrow(run, f"conv {kind}, place long, edit string, role string, text string")


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of `rows`, which are taken as they are.

    Null conversations are one; null turns come first; rows of the same turn are taken by role, then text. Null roles and texts must have been
    given a value (`damage` does). No rows: no rows.
    """
    named = rows.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    marked = stage(faults(named), "faults")
    found = stage(audits(marked), "audits")
    digests = repaired_digests(marked, found)
    on = F.col("conv").eqNullSafe(F.col("__conv"))
    return found.join(digests.withColumnRenamed("conv", "__conv"), on).drop("__conv")


def damaged_and_repaired(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """What `repair` says of the damaged rows, for every conversation of `rows`; one that lost all rows has zeros, an empty audit and the hash of nothing."""
    done = repair(damage(rows, id_col, turn_col, role_col, text_col), "conv", "turn", "role", "text")
    every = rows.select(F.col(id_col).alias("__conv")).distinct()
    out = every.join(done, F.col("conv").eqNullSafe(F.col("__conv")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _COUNTS]
    return out.select(F.col("__conv").alias("conv"), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(sha256(b"").hexdigest())).alias("repaired_sha256"))
