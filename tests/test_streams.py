"""Keyed state of the move stream and the compacted table of newest rows."""

import datetime as dt
import random
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chalkline.catalog import q_streams
from chalkline.catalog.views import Tables
from chalkline.sources.latest import LatestTable
from chalkline.streaming import quotes as Q

SCHEMA = "player_name string, category string, book string, line double, scraped_at timestamp"
START = dt.datetime(2024, 1, 1)


def quote(player, hours, line):
    return (player, "rush", "b", line, START + dt.timedelta(hours=hours))


class Feed:
    """A folder of quote files and the stream of moves over it; every run goes on from the same checkpoint."""

    def __init__(self, spark, **options):
        self.spark, self.options = spark, options
        self.source, self.out, self.checkpoint = (q_streams.scratch(spark, f"feed-{n}") for n in ("in", "out", "ck"))
        self.all = []

    def run(self, *files):
        for rows in files:
            self.all += rows
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.source)
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(self.source)
        with Q.with_state_store(self.spark):
            Q.run_available(Q.moves_since_baseline(stream, 1.0, **self.options), self.out, self.checkpoint)

    def moves(self):
        return sorted(tuple(r) for r in Q.read_moves(self.spark, self.out).collect())

    def expected(self):
        rows = Q.moves_since_baseline_batch(self.spark.createDataFrame(self.all, SCHEMA), 1.0)
        return sorted(tuple(r) for r in rows.select(*Q.KEY, "scraped_at", "line", "baseline", "move").collect())

    def told(self):
        return self.spark.read.parquet(self.out)


def test_late_first_quote_and_restart(spark):
    feed = Feed(spark, delay="2 days")
    feed.run([quote("a", 5, 10.0), quote("a", 6, 12.0), quote("b", 5, 3.0)], [quote("a", 7, 10.5), quote("b", 9, 3.5), quote("b", 9, 3.5)])
    assert feed.moves() == feed.expected() and len(feed.moves()) == 1
    # After a restart an older quote of `a` turns up: one move is taken back, others begin; `b` goes on.
    feed.run([quote("a", 1, 12.0), quote("b", 10, 5.0)], [quote("a", 8, 10.0), quote("a", 8, 10.0), quote("c", 60, 1.0)])
    assert feed.moves() == feed.expected() and {m[3:] for m in feed.moves()} >= {(START + dt.timedelta(hours=5), 10.0, 12.0, -2.0)}
    assert feed.told().where("move is null").count() == 1 and feed.told().agg(F.max("version")).first()[0] == 1
    feed.run([quote("c", 61, 2.0)], [quote("c", 60, 1.5), quote("a", 70, 14.0)])
    assert feed.moves() == feed.expected()


def test_random_lateness_within_the_delay(spark):
    rng = random.Random(4)
    feed = Feed(spark, delay="1 day")
    rows = [quote(rng.choice("abc"), h + rng.uniform(-20, 0), float(rng.randint(0, 4))) for h in range(0, 300, 3)]
    feed.run(*[rows[k:k + 25] for k in range(0, 50, 25)])
    feed.run(*[rows[k:k + 25] for k in range(50, 100, 25)])
    assert feed.moves() == feed.expected() and len(feed.moves()) > 20


def test_late_beyond_the_delay_and_forgotten_keys(spark):
    feed = Feed(spark, delay="1 hour", forget_ms=24 * 3_600_000)
    feed.run([quote("a", 10, 5.0), quote("x", 30, 0.0)], [quote("a", 31, 7.0)], [quote("a", 1, 9.0)])
    assert [m[3:] for m in feed.moves()] == [(START + dt.timedelta(hours=31), 7.0, 5.0, 2.0)]  # the quote of hour 1 came too late
    feed.run([quote("x", 100, 0.0)], [quote("y", 101, 0.0)], [quote("a", 102, 1.0), quote("a", 103, 2.0)])
    assert [m[3:] for m in feed.moves()][-1] == (START + dt.timedelta(hours=103), 2.0, 1.0, 1.0)  # `a` was forgotten and began anew


def test_latest_table_stays_small_and_right(spark):
    rng = random.Random(2)
    table = LatestTable(spark, q_streams.scratch(spark, "latest"), ["k"], ["at"], every=3)
    assert table.read() is None
    newest, schema = {}, "k long, at long, v string"
    for n in range(60):
        rows = [(rng.randint(0, 30), rng.randint(0, 1000), f"{n}-{j}") for j in range(5)] + [(None, n, "null key")]
        for k, at, v in rows:
            newest[k] = max(newest.get(k, (-1, "")), (at, v))
        batch = spark.createDataFrame(rows, schema).coalesce(1)
        table.put(batch, n)
        if n % 20 == 7:
            table.put(spark.createDataFrame([(1, 5000, "a replay does not count")], schema), n)
            table.put(spark.createDataFrame([(1, 5000, "nor an older batch")], schema), n - 3)
        if n % 15 == 14:
            assert {r.k: (r.at, r.v) for r in table.read().collect()} == newest
            assert len(table.manifest()["parts"]) <= 2 * 4  # two folders a level
    assert {r.k: (r.at, r.v) for r in table.read().collect()} == newest
    assert len(table.folder.names("manifest")) == 2 and sum(n.startswith("level") for n in table.folder.names()) <= 12


def test_a_batch_that_broke_off_is_written_anew(spark, monkeypatch):
    table = LatestTable(spark, q_streams.scratch(spark, "latest"), ["k"], ["at"], every=2)
    rows = lambda *r: spark.createDataFrame(list(r), "k long, at long")
    table.put(rows((1, 1)), 0)
    with monkeypatch.context() as m:
        m.setattr(type(table.folder), "write", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.put(rows((1, 2), (2, 1)), 1)
    assert [tuple(r) for r in table.read().collect()] == [(1, 1)]
    table.put(rows((1, 3), (2, 1)), 1)
    assert sorted(tuple(r) for r in table.read().collect()) == [(1, 3), (2, 1)]


@pytest.mark.parametrize("name, slide", [("ss2_sliding_windows", ("6 hours", "1 hour")), ("ss2_tumbling_windows", ("1 hour", None))])
def test_state_of_windows_is_on_disk(spark, tmp_path, monkeypatch, name, slide):
    rng = random.Random(7)
    for day in range(3):  # a file and a batch a day, in order of time, each reaching back into windows of the one before
        rows = [(100 * day + n, START + dt.timedelta(hours=24 * day + rng.uniform(-5, 24)), rng.choice([1, 2]), rng.choice(["view", "click"]), float(rng.randint(0, 9)), "{}") for n in range(100)]
        spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(q_streams, "FILES_PER_BATCH", 1)
    monkeypatch.setattr(q_streams, "scratch", lambda spark, kind: str(tmp_path / kind))
    settings = {k: spark.conf.get(k, None) for k in Q.STATE_STORE}
    told = entry.queries()[name](spark, str(tmp_path))
    twin = Q.line_windows(Tables(spark, str(tmp_path)).quotes_t, *slide, watermark=False).withColumn("window_start", F.col("window_start").cast("string"))
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, twin.select(*told.columns).collect())) and told.agg(F.max("n")).first()[0] > 1
    kept = [f for f in tmp_path.glob("ss2*c/state/0/[0-9]*/*") if not f.name.startswith(".")]
    assert not any(f.suffix == ".delta" for f in kept)  # those are of a store on the heap
    snapshot = zipfile.ZipFile(next(f for f in kept if f.suffix == ".zip"))
    options = next(snapshot.read(n).decode() for n in snapshot.namelist() if "OPTIONS" in n)
    assert "cache_index_and_filter_blocks=true" in options  # they count towards the bounded cache
    assert {k: spark.conf.get(k, None) for k in Q.STATE_STORE} == settings
