import random
from collections import defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tracelore.operators import windows
from tracelore.operators.segments import neighbours, running_sums, time_slice
from tracelore.session import work_dir
from tracelore.streaming import jobs

T0 = datetime(2024, 1, 1)


def log(seed, n=400):
    """A third of the events belong to one session."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        session = 0 if i % 3 == 0 else rng.randint(1, 6)
        rows.append((session, i, T0 + timedelta(minutes=7 * i), "Stop" if rng.random() < 0.12 else "PostToolUse"))
    return rows


def queue(rows, limit):
    waiting, number, out = defaultdict(list), defaultdict(int), {}
    for session, event, _, name in rows:
        waiting[session].append(event)
        if name == "Stop":
            number[session] += 1
            for e in waiting[session][:limit]:
                out[e] = number[session]
            waiting[session] = waiting[session][limit:]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "session_id long, event_id long, ts timestamp, event_name string")


def test_stop_windows_equal_a_queue(spark):
    rows = log(3)
    for limit in (2, 5, 200):
        got = {r.event_id: r.window_no for r in windows.stop_windows(frame(spark, rows), limit).filter("window_no IS NOT NULL").collect()}
        assert got == queue(rows, limit)


def test_streams_over_many_batches_equal_the_whole(spark):
    rows = log(5, 240)
    folder = work_dir(spark, "stream-input")
    for part in range(4):
        frame(spark, rows[part * 60 : (part + 1) * 60]).coalesce(1).write.parquet(f"{folder}/p{part}")
    out, state = work_dir(spark, "w"), work_dir(spark, "ws")
    chain, chain_state = work_dir(spark, "c"), work_dir(spark, "cs")
    for part in range(4):
        batch = spark.readStream.schema("session_id long, event_id long, ts timestamp, event_name string").parquet(f"{folder}/p[0-{part}]")
        jobs.run_to_end(jobs.windows_stream(batch, out, state, 4))
        jobs.run_to_end(jobs.chain_stream(batch, chain, chain_state))
    got = {r.event_id: r.window_no for r in spark.read.parquet(out).collect()}
    assert got == queue(rows, 4)
    last, want = {}, {}
    for session, event, _, _ in rows:
        want[event] = last.get(session)
        last[session] = event
    assert {r.event_id: r.prev_event_id for r in spark.read.parquet(chain).collect()} == want


def test_segmented_frames_equal_plain_windows(spark):
    df = frame(spark, log(9))
    got = running_sums(df, ["session_id"], ["ts", "event_id"], time_slice(F.col("ts"), 1800), {"c": F.lit(1)})
    plain = df.withColumn("c2", F.expr("count(*) OVER (PARTITION BY session_id ORDER BY ts, event_id)"))
    assert got.join(plain.select("event_id", "c2"), "event_id").filter("c <> c2").isEmpty()
    near = neighbours(df, ["session_id"], ["ts", "event_id"], time_slice(F.col("ts"), 1800), "event_id")
    plain = df.withColumn("p", F.expr("lag(event_id) OVER (PARTITION BY session_id ORDER BY ts, event_id)"))
    assert near.join(plain.select("event_id", "p"), "event_id").filter("NOT (prev_event_id <=> p)").isEmpty()


def test_closure_and_roots(spark):
    edges = spark.createDataFrame([(None, 1), (1, 2), (2, 3), (None, 9)], "parent long, child long")
    assert {(r.ancestor, r.node, r.depth) for r in windows.closure(edges).collect()} == {
        (1, 1, 0), (2, 2, 0), (3, 3, 0), (9, 9, 0), (1, 2, 1), (2, 3, 1), (1, 3, 2)
    }
    assert {r.node: r.root for r in windows.roots(edges).collect()} == {1: 1, 2: 1, 3: 1, 9: 9}


def test_events_are_numbered_once_for_their_windows(spark):
    rows = [(i, 1 + i % 2, datetime(2024, 1, 1) + timedelta(seconds=i), "Stop" if i % 9 == 8 else "PreToolUse") for i in range(60)]
    events = spark.createDataFrame(rows, "event_id long, session_id long, ts timestamp, event_name string")
    placed = windows.stop_windows(events, 10)
    assert placed.count() == 60
    # The rows and their segments' sums.
    assert placed._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") <= 4


def test_a_ledger_without_counts_is_one_of_zeros(spark):
    digests = spark.createDataFrame([("w1", 1, 2, "d1", 3, [1, 2, 3])], "window_id string, session_id long, project_id long, digest string, event_count long, event_ids array<long>")
    zeros = digests.select("window_id", F.lit(0).alias("learning_count"), F.lit(0).alias("observation_count"))
    with_zeros, without = (windows.processing_ledger(digests, "turn", c, ["window_id"], {"llm_status": F.lit("called")}) for c in (zeros, None))
    for one, other in zip(with_zeros, without):
        assert sorted(map(repr, one.select(*other.columns).collect())) == sorted(map(repr, other.collect()))
    assert without[0].first()["summary"] == "Processed 3 turn events and produced 0 learning actions and 0 observations."
