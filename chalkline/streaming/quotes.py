"""Structured Streaming forms of the time-based market operators.

Input stream: quotes(player_name, category, team, book, line, over_odds, scraped_at timestamp, ...). On a bounded input
each gives what its batch twin gives.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from chalkline.sources.latest import EVERY, LatestTable

KEY = ["player_name", "category", "book"]
SNAPSHOT_KEY = [*KEY, "line", "over_odds", "scraped_at"]


def dedupe_snapshots(quotes: DataFrame, delay: str = "1 day", keys: Sequence[str] = tuple(SNAPSHOT_KEY)) -> DataFrame:
    """Drop repeated snapshots of a quote; state is kept for the watermark delay only."""
    return quotes.withWatermark("scraped_at", delay).dropDuplicatesWithinWatermark(list(keys))


def line_windows(quotes: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "1 day",
                 watermark: bool = True) -> DataFrame:
    """First, last, lowest and highest line per quote key and time window; rows later than the delay are dropped."""
    stream = quotes.withWatermark("scraped_at", delay) if watermark else quotes
    at = F.struct("scraped_at", "line")
    w = F.window("scraped_at", size, slide) if slide else F.window("scraped_at", size)
    return stream.groupBy(w, *KEY).agg(
        F.count(F.lit(1)).alias("n"), F.min(at)["line"].alias("first_line"), F.max(at)["line"].alias("last_line"),
        F.min("line").alias("low_line"), F.max("line").alias("high_line")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *KEY, "n", "first_line",
        "last_line", "low_line", "high_line")


def flag_started(quotes: DataFrame, schedule: DataFrame) -> DataFrame:
    """Stream-static join: quotes with a lock flag, locked once scraped at or after the team's kickoff."""
    games = schedule.groupBy("team").agg(F.min("kickoff").alias("kickoff"))
    return quotes.join(games, "team", "left").withColumn(
        "started", F.coalesce(F.col("scraped_at") >= F.col("kickoff"), F.lit(False)))


def latest_before(quotes: DataFrame, kickoffs: DataFrame) -> DataFrame:
    """Newest quote per key strictly before the team's kickoff: the batch twin and the merge step of the closing job."""
    rows = quotes.join(kickoffs.select("team", "kickoff"), "team").where(F.col("scraped_at") < F.col("kickoff"))
    newest = F.max(F.struct("scraped_at", "line", "over_odds"))
    return rows.groupBy(*KEY, "team", "kickoff").agg(newest.alias("q")).select(
        *KEY, "team", "kickoff", "q.scraped_at", "q.line", "q.over_odds")


CLOSING_KEY, CLOSING_ORDER = [*KEY, "team", "kickoff"], ["scraped_at", "line", "over_odds"]


def closing_table(spark: SparkSession, root: str, every: int = EVERY) -> LatestTable:
    return LatestTable(spark, root, CLOSING_KEY, CLOSING_ORDER, every)


def closing_sink(root: str, kickoffs: DataFrame, every: int = EVERY):
    """foreachBatch writer: each batch is merged into one table of the newest quote per key, which is compacted as it grows.

    A replayed batch changes nothing, and a late quote takes part by its time."""

    def write(batch: DataFrame, batch_id: int) -> None:
        closing_table(batch.sparkSession, root, every).put(latest_before(batch, kickoffs), batch_id)

    return write


def read_closing(spark: SparkSession, root: str) -> DataFrame:
    return closing_table(spark, root).read()


class Baseline(StatefulProcessor):
    """Moves away from the first quote of a key, told as soon as a quote is `threshold` away.

    State per key: first and newest quote, the number of quotes, and, until the watermark has passed the first quote, all of them: so long an older
    quote may still turn up and become the first. Then what was told is told anew under the next version, with a null move where a quote no longer
    counts. Once the first quote is certain its timer fires and only the two quotes stay. A key without quotes for `forget_ms` is dropped."""

    STATE = "first_at long, first_line double, settled boolean, n long, version long, newest_at long, newest_line double"

    def __init__(self, threshold: float, forget_ms: int | None):
        self.threshold, self.forget_ms = threshold, forget_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("quotes", self.STATE)
        self.open = handle.getListState("open", "n long, at long, line double")

    def _told(self, key: tuple, quote: tuple, first: tuple, version: int) -> Row:
        n, at, line = quote
        move = line - first[1]
        return Row(*KEY, "n", "at", "line", "baseline", "move", "version")(*key, n, at, line, first[1], move if abs(move) >= self.threshold else None, version)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first_at, first_line, settled, n, version, newest_at, newest_line = self.state.get() or (None, None, False, 0, 0, None, None)
        first = before = None if first_at is None else (first_at, first_line)
        fresh, newest_quote = [], (newest_at, newest_line)
        for at, line in sorted((r["at"], r["line"]) for r in rows):
            n += 1
            fresh.append((n, at, line))
            if not settled and (first is None or (at, line) < first):
                first = (at, line)
            if newest_quote[0] is None or (at, line) > newest_quote:
                newest_quote = (at, line)
        again = []
        if first != before:
            if before is not None:
                version += 1
                again = [q for q in map(tuple, self.open.get()) if max(abs(q[2] - before[1]), abs(q[2] - first[1])) >= self.threshold]
                self.handle.deleteTimer(_after(before[0]))
            self.handle.registerTimer(_after(first[0]))
        if not settled:
            self.open.appendList(fresh)
        if self.forget_ms is not None:
            self.handle.registerTimer(_after(newest_quote[0]) + self.forget_ms)
        self.state.update((*first, settled, n, version, *newest_quote))
        for q in again:
            yield self._told(key, q, first, version)
        for q in fresh:
            if abs(q[2] - first[1]) >= self.threshold:
                yield self._told(key, q, first, version)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.state.get()
        if held is not None:
            now = timerValues.getCurrentWatermarkInMs()
            if self.forget_ms is not None and _after(held[5]) + self.forget_ms <= now:
                self.state.clear()
                self.open.clear()
            elif not held[2] and _after(held[0]) <= now:
                self.state.update((held[0], held[1], True, *held[3:]))
                self.open.clear()
        return iter(())

    def close(self) -> None:
        pass


def _after(micros: int) -> int:
    """The millisecond after a time."""
    return micros // 1000 + 1


def moves_since_baseline(quotes: DataFrame, threshold: float = 1.0, delay: str = "1 day", forget_ms: int | None = None) -> DataFrame:
    """Stream of (key, n, at, line, baseline, move, version) rows: the n-th quote of a key is `move` away from the key's first quote. The highest version of a
    quote holds; a null move takes an earlier one back. Quotes later than `delay` are dropped. Needs the state store of `with_state_store`."""
    stream = quotes.withWatermark("scraped_at", delay).where(F.col("line").isNotNull() & F.col("scraped_at").isNotNull())
    stream = stream.select(*[F.coalesce(c, F.lit("")).alias(c) for c in KEY], "scraped_at", F.unix_micros("scraped_at").alias("at"), F.col("line").cast("double").alias("line"))
    kinds = dict(quotes.dtypes)
    out = f"{', '.join(f'{c} {kinds[c]}' for c in KEY)}, n long, at long, line double, baseline double, move double, version long"
    return stream.groupBy(*KEY).transformWithState(Baseline(threshold, forget_ms), out, "append", "eventTime")


_STORE = "spark.sql.streaming.stateStore"
#: Keyed state on the executors' disks. Write buffers, indexes and blocks of all stores of an executor share one cache, in place of one each that grows
#: with the keys; rows are not counted, which would read every key once more before it is written.
STATE_STORE = {f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
               f"{_STORE}.rocksdb.boundedMemoryUsage": "true", f"{_STORE}.rocksdb.maxMemoryUsageMB": "500", f"{_STORE}.rocksdb.trackTotalNumberOfRows": "false"}


@contextmanager
def with_state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which holds more keys than memory does."""
    held = {name: spark.conf.get(name, None) for name in STATE_STORE}
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in held.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def read_moves(spark: SparkSession, root: str) -> DataFrame:
    """What a stream of moves has told so far: of each quote its highest version, unless that takes it back."""
    told = spark.read.parquet(root)
    last = told.groupBy(*KEY, "n").agg(F.max(F.struct("version", "at", "line", "baseline", "move")).alias("q"))
    return last.where("q.move is not null").select(*KEY, F.timestamp_micros("q.at").alias("scraped_at"), "q.line", "q.baseline", "q.move")


def first_quotes(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.min(F.struct("scraped_at", "line")).alias("f"))


def _moves(rows: DataFrame, first: DataFrame, threshold: float) -> DataFrame:
    moved = rows.join(first.select(*KEY, F.col("f.line").alias("baseline")), KEY)
    return moved.withColumn("move", F.col("line") - F.col("baseline")).where(F.abs("move") >= threshold)


def moves_since_baseline_batch(quotes: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Batch twin: the baseline is a map-side combined minimum joined back, so a hot key is never in one task."""
    rows = quotes.select(*KEY, "scraped_at", "line").where(F.col("line").isNotNull())
    return _moves(rows, first_quotes(rows), threshold)


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", for_each=None) -> None:
    """Run a stream over what is there now and stop; output as parquet or through a foreachBatch writer."""
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).outputMode(mode)
    query = writer.foreachBatch(for_each).start() if for_each else writer.format("parquet").option("path", out).start()
    query.awaitTermination()
