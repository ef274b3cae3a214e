"""Streams over several batches equal their batch twins; the state they keep stays cheap to read."""

import os
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tracelore.catalog.base import Tables
from tracelore.operators import pairing, windows
from tracelore.session import work_dir
from tracelore.streaming import jobs
from tracelore.streaming.runs import RunLog, newest, still_open

FOLDER = "/root/testdata/sf0.001"


def test_files_opened_stay_level_over_many_batches(spark):
    log = RunLog(spark, work_dir(spark, "runs"), "k", merge=newest("k", "v"), fan=4, range_rows=60)
    rng, truth, opened = random.Random(1), {}, []
    for batch in range(100):
        rows = {rng.randrange(400): batch * 1000 + i for i in range(12)}
        if batch % 5 == 4 or batch > 90:
            asked = spark.createDataFrame([(k,) for k in rng.sample(range(400), 5)], "k long")
            opened.append((batch, log.files(batch, asked)))
        if batch in (37, 64, 99):
            asked = spark.createDataFrame([(k,) for k in range(0, 400, 9)], "k long")
            seen = {r["k"]: r["v"] for r in log.before(batch, asked).collect()}
            assert {k: seen.get(k) for k in range(0, 400, 9)} == {k: truth.get(k) for k in range(0, 400, 9)}
            assert {r["k"]: r["v"] for r in log.before(batch).collect()} == truth
        log.write(spark.createDataFrame(list(rows.items()), "k long, v long"), batch)
        truth.update(rows)
    assert {r["k"]: r["v"] for r in log.after(100).collect()} == truth
    # Three runs a level at most, four levels, five keys: never near the hundred files that were written.
    assert max(n for _, n in opened) <= 3 * 4 + 5 * 4
    assert max(n for b, n in opened if b >= 50) <= max(n for b, n in opened if b < 50) + 12
    # Replaced runs are gone from the folder.
    kept = {d for d in os.listdir(log._path.removeprefix("file:") + "/run_level=0") if d.startswith("run_last")}
    assert len(kept) <= 8


def test_live_runs_follow_from_the_batch_number(spark):
    log = RunLog(spark, "unused", "k", fan=3)
    for batch in range(40):
        covered = []
        for level, last in log.live(batch):
            covered += range(last - 3**level + 1, last + 1)
        assert covered == list(range(batch))


def test_replayed_batch_changes_nothing(spark):
    log = RunLog(spark, work_dir(spark, "replay"), "k", fan=2)
    for batch in range(6):
        rows = spark.createDataFrame([(batch, 1)], "k long, v long")
        log.write(rows, batch)
        log.write(rows, batch)
    assert sorted(r["k"] for r in log.after(6).collect()) == list(range(6))


def test_removals_cancel_rows_and_outlive_merges(spark):
    rows = spark.createDataFrame([(1, "a", False), (1, "b", False), (1, "a", True), (2, "z", True)], "s int, e string, gone boolean")
    assert sorted((r["e"], r["gone"]) for r in still_open(rows, ["s", "e"]).collect()) == [("b", False), ("z", True)]


@pytest.fixture(scope="module")
def batches(spark):
    """The events of the small table in six files, by time, and once more in any order."""
    t = Tables(spark, FOLDER)
    rows = t.session_event.withColumn("source", F.when(F.col("k") % 3 == 0, F.lit(None)).when(F.col("k") % 2 == 1, "cli").otherwise("web")).toArrow().sort_by([("ts", "ascending"), ("event_id", "ascending")])
    rows = rows.slice(0, 600)
    root = work_dir(spark, "stream-batches").removeprefix("file:")
    mixed = list(range(rows.num_rows))
    random.Random(2).shuffle(mixed)
    for name, table in (("timed", rows), ("mixed", rows.take(mixed))):
        os.makedirs(f"{root}/{name}")
        step = -(-table.num_rows // 6)
        for i in range(6):
            path = f"{root}/{name}/{i}.parquet"
            pq.write_table(table.slice(i * step, step), path)
            os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return root


def stream(spark, folder):
    return jobs.read_folder(spark, folder, "*.parquet", per_trigger=1)


def test_fixes_come_from_closing_windows(spark, batches):
    root = work_dir(spark, "fix-stream").removeprefix("file:")
    jobs.run_to_end(jobs.fixes_stream(stream(spark, f"{batches}/timed"), f"{root}/out", f"{root}/state", 40))
    whole = windows.stop_windows(spark.read.parquet(f"{batches}/timed"), 40).filter("window_no IS NOT NULL").withColumn("window_id", F.concat_ws(":", F.col("session_id").cast("string"), F.col("window_no").cast("string")))
    want = {tuple(r) for r in pairing.fix_for_failure(whole, "window_id").select("window_id", "failed_id", "fix_id").collect()}
    got = [tuple(r) for r in spark.read.parquet(f"{root}/out_fixes").select("window_id", "failed_id", "fix_id").collect()]
    assert want and len(got) == len(want) and set(got) == want
    placed = {(r["event_id"], r["window_no"]) for r in whole.collect()}
    assert {(r["event_id"], r["window_no"]) for r in spark.read.parquet(f"{root}/out").collect()} == placed
    assert spark.read.parquet(f"{root}/out").select("batch").distinct().count() == 6


def test_sessions_projects_and_users_with_late_rows(spark, batches):
    root = work_dir(spark, "touch-stream").removeprefix("file:")
    jobs.run_to_end(jobs.sessions_stream(stream(spark, f"{batches}/mixed"), f"{root}/out", f"{root}/state"))
    events = spark.read.parquet(f"{batches}/mixed")
    at = F.struct("ts", "event_id")
    for kind, key in jobs.TOUCHED.items():
        spoken = F.when(F.col("source").isNotNull(), at)
        want = events.groupBy(F.col(key).cast("string").alias("id")).agg(F.min("ts"), F.max("ts"), F.min_by("source", spoken), F.max_by("source", spoken))
        got = jobs.read_touched(spark, f"{root}/out", kind)
        assert {tuple(r) for r in got.select("id", "created_at", "last_activity_at", "source", "last_source").collect()} == {tuple(r) for r in want.collect()}
    owner = {r["id"]: (r["user_id"], r["project_id"]) for r in jobs.read_touched(spark, f"{root}/out", "session").collect()}
    first = events.groupBy("session_id").agg(F.min_by(F.struct("user_id", "project_id"), at).alias("o")).select("session_id", "o.*").collect()
    assert owner == {str(r["session_id"]): (str(r["user_id"]), str(r["project_id"])) for r in first}


def test_ingest_and_chain_over_batches(spark, batches):
    root = work_dir(spark, "once-stream").removeprefix("file:")
    jobs.run_to_end(jobs.chain_stream(stream(spark, f"{batches}/timed"), f"{root}/chain", f"{root}/chain-state"))
    events = spark.read.parquet(f"{batches}/timed")
    want = events.selectExpr("event_id", "lag(event_id) over (partition by session_id order by ts, event_id) p")
    assert {tuple(r) for r in spark.read.parquet(f"{root}/chain").select("event_id", "prev_event_id").collect()} == {tuple(r) for r in want.collect()}
    rows = stream(spark, f"{batches}/mixed").filter("prompt is not null").select("session_id", F.lit("base").alias("prompt_name"), F.lit("x").alias("target"), F.col("prompt").alias("content"), "ts")
    jobs.run_to_end(jobs.inject_once_stream(rows, f"{root}/once", f"{root}/once-state"))
    got = spark.read.parquet(f"{root}/once").select("session_id", "content").collect()
    distinct = {(r["session_id"], r["prompt"]) for r in events.filter("prompt is not null").collect()}
    assert len(got) == len(distinct) and {tuple(r) for r in got} == distinct
