"""Streaming forms (SS) over the event file; every stream reads the whole table and stops when it is consumed."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chalkline.catalog.registry import query
from chalkline.catalog.views import VIEWS
from chalkline.sources.derived import shared_root
from chalkline.streaming import quotes as Q


FILES_PER_BATCH = 64


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in shared storage."""
    return f"{shared_root(spark)}/{name}_{uuid.uuid4().hex}"


def stream(t):
    """The event table, one file or a folder of part files, as a stream of quotes, shaped like the batch view."""
    raw = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(f"{t.folder}/event[s].parquet")
    name = f"events_stream_{uuid.uuid4().hex}"
    raw.createOrReplaceTempView(name)
    return t.spark.sql(VIEWS["quotes_t"].replace("FROM events", f"FROM {name}"))


@query("ss1_dedupe_snapshots", "SELECT player_name, book, count(*) AS n FROM (SELECT DISTINCT player_name, category, book, line, over_odds, scraped_at FROM quotes_t) x GROUP BY player_name, book")
def _(t):
    out, ck = scratch(t.spark, "ss1"), scratch(t.spark, "ss1c")
    s = stream(t)
    Q.run_available(Q.dedupe_snapshots(s.unionByName(s)), out, ck)
    return t.spark.read.parquet(out).groupBy("player_name", "book").agg(F.count(F.lit(1)).alias("n"))


def window_sql(start: str) -> str:
    return f"""SELECT CAST({start} AS STRING) AS window_start, player_name, book, count(*) AS n, arg_min(line, struct_pack(a := scraped_at, b := line)) AS first_line, arg_max(line, struct_pack(a := scraped_at, b := line)) AS last_line,
        min(line) AS low_line, max(line) AS high_line FROM quotes_t GROUP BY {start}, player_name, book"""


_OUT = ["window_start", "player_name", "book", "n", "first_line", "last_line", "low_line", "high_line"]


def _windows(t, size, slide, name):
    """Complete windows are written by batch id; a re-emitted window replaces its older version by its larger count."""
    root, ck = scratch(t.spark, name), scratch(t.spark, f"{name}c")

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{root}/batch_id={batch_id}")

    with Q.with_state_store(t.spark):
        Q.run_available(Q.line_windows(stream(t), size, slide), root, ck, "update", write)
    rows = t.spark.read.parquet(root)
    newest = rows.groupBy("window_start", "window_end", *Q.KEY).agg(F.max("n").alias("n"))
    kept = rows.join(newest, ["window_start", "window_end", *Q.KEY, "n"])
    return kept.withColumn("window_start", F.col("window_start").cast("string")).select(*_OUT)


@query("ss2_tumbling_windows", window_sql("date_trunc('hour', scraped_at)"))
def _(t):
    return _windows(t, "1 hour", None, "ss2")


@query("ss2_sliding_windows", window_sql("w").replace("FROM quotes_t", "FROM (SELECT q.*, date_trunc('hour', scraped_at) - INTERVAL '1' HOUR * k.i AS w FROM quotes_t q, (SELECT unnest(range(0, 6)) AS i) k) z"))
def _(t):
    return _windows(t, "6 hours", "1 hour", "ss2s")


@query("ss2_batch_windows", window_sql("date_trunc('hour', scraped_at)"))
def _(t):
    return Q.line_windows(t.quotes_t, watermark=False).withColumn("window_start", F.col("window_start").cast("string")).select(*_OUT)


@query("ss3_flag_started", "SELECT q.event_id, coalesce(q.scraped_at >= k.kickoff, false) AS started FROM quotes_t q LEFT JOIN kickoffs_t k USING (team)")
def _(t):
    out, ck = scratch(t.spark, "ss3"), scratch(t.spark, "ss3c")
    Q.run_available(Q.flag_started(stream(t), t.kickoffs_t).select("event_id", "started"), out, ck)
    return t.spark.read.parquet(out)


CLOSE_SQL = """SELECT player_name, book, line, over_odds FROM (SELECT q.*, row_number() OVER (PARTITION BY player_name, category, book, q.team ORDER BY scraped_at DESC, line DESC, over_odds DESC) AS rn
    FROM quotes_t q JOIN kickoffs_t k USING (team) WHERE q.scraped_at < k.kickoff) x WHERE rn = 1"""


@query("ss4_closing_quote", CLOSE_SQL)
def _(t):
    root, ck = scratch(t.spark, "ss4"), scratch(t.spark, "ss4c")
    Q.run_available(stream(t), root, ck, "append", Q.closing_sink(root, t.kickoffs_t))
    return Q.read_closing(t.spark, root).select("player_name", "book", "line", "over_odds")


MOVE_SQL = """SELECT player_name, book, line, base AS baseline, line - base AS move FROM (SELECT q.*, first_value(line) OVER (PARTITION BY player_name, category, book ORDER BY scraped_at, line) AS base FROM quotes_t q WHERE line IS NOT NULL) x WHERE abs(line - base) >= 5"""


@query("ss5_move_since_baseline", MOVE_SQL)
def _(t):
    root, ck = scratch(t.spark, "ss5"), scratch(t.spark, "ss5c")
    with Q.with_state_store(t.spark):
        Q.run_available(Q.moves_since_baseline(stream(t), 5.0), root, ck)
    return Q.read_moves(t.spark, root).select("player_name", "book", "line", "baseline", "move")


@query("ss5_move_since_baseline_batch", MOVE_SQL)
def _(t):
    return Q.moves_since_baseline_batch(t.quotes_t, 5.0).select("player_name", "book", "line", "baseline", "move")
