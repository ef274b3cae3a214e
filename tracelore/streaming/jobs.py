"""The event-time rules as Structured Streaming jobs. Each has a batch twin that is its check."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tracelore import params
from tracelore.functions.text import sha16
from tracelore.operators import events as ev
from tracelore.operators import pairing, windows
from tracelore.session import cut
from tracelore.streaming.runs import RunLog, newest, still_open


def read_folder(spark: SparkSession, folder: str, pattern: str, per_trigger: int | None = None) -> DataFrame:
    """Parquet files of ``folder`` matching ``pattern`` as a stream, schema taken from the files."""
    sample = spark.read.option("pathGlobFilter", pattern).parquet(folder)
    reader = spark.readStream.schema(sample.schema).option("pathGlobFilter", pattern)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    df = reader.parquet(folder)
    for field in sample.schema.fields:
        if field.dataType.simpleString() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def run_to_end(query: StreamingQuery) -> None:
    """Wait for a query that stops when the available input is done."""
    query.awaitTermination()


def _start(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return (
        df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )


def deduplicated_log(spark: SparkSession, path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A log with one row per key for good: identity has no time limit, so no watermark decides what is kept. The keys are
    kept apart (``RunLog``); a batch reads those of the ranges that its own fall into."""
    known = RunLog(spark, f"{path}_keys", key, merge=lambda rows: rows.distinct())

    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = cut(batch.dropDuplicates([key]))
        seen = known.before(batch_id, rows)
        new = rows if seen is None else cut(rows.join(seen, key, "left_anti"))
        new.write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")
        known.write(new.select(key), batch_id)

    return sink


def ingest_stream(raw: DataFrame, client: str, path: str, checkpoint: str) -> StreamingQuery:
    """Payloads to typed rows, one per event id, however late a payload comes."""
    return _start(ev.ingest(raw, client), checkpoint, deduplicated_log(raw.sparkSession, path, "event_id"))


def chain_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Link every event to the one before it in its session, in arrival order. Inside a batch
    the chain is built over time segments, so a busy session is not one task; across batches
    only each session's last event is remembered."""
    last = RunLog(events.sparkSession, f"{path}_last", "session_id", merge=newest("session_id", "ts"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch = cut(batch)
        linked = ev.event_chain(batch).select("session_id", "event_id", "ts", "prev_event_id")
        known = last.before(batch_id, batch)
        if known is not None:
            linked = linked.join(known.select("session_id", F.col("event_id").alias("__last")), "session_id", "left").withColumn(
                "prev_event_id", F.coalesce("prev_event_id", "__last")
            ).drop("__last")
        linked.write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")
        ends = batch.groupBy("session_id").agg(F.max(F.struct("ts", "event_id")).alias("e")).select("session_id", "e.ts", "e.event_id")
        last.write(ends, batch_id)

    return _start(events.select("session_id", "event_id", "ts"), checkpoint, sink)


def windows_stream(
    events: DataFrame, path: str, checkpoint: str, limit: int = params.EXTRACTION_WINDOW, tops: DataFrame | None = None,
    carry: Sequence[str] = (), on_closed: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Emit the events of every window a Stop closes. Events no window has taken stay open in a log of their own; a batch reads the open
    events of the sessions it touches and writes what it adds to and takes from them. An open Stop has fired already and
    does not fire again. With ``tops`` (node, root) a window takes the events of a whole session tree, and ``session_id`` of the
    output is the root's. ``on_closed`` gets the events of the windows that a batch closes, with window_no, window_id and the columns
    ``carry``."""
    spark = events.sparkSession
    placed_in = windows.in_trees(events, tops) if tops is not None else events.withColumn("root_session_id", F.col("session_id")).withColumn("closes", F.col("event_name") == "Stop")
    done = RunLog(spark, f"{path}_count", "session_id", merge=newest("session_id", "windows"))
    key = ["session_id", "event_id"]
    waiting = RunLog(spark, f"{path}_open", "session_id", merge=lambda rows: still_open(rows, key))

    def sink(batch: DataFrame, batch_id: int) -> None:
        new = cut(batch.withColumnRenamed("closes", "fires"))
        touched = new.select("session_id").distinct()
        open_ = waiting.before(batch_id, touched)
        todo = new
        if open_ is not None:
            known = open_.filter(~F.col("gone")).drop("gone").join(touched, "session_id", "left_semi")
            todo = cut(new.withColumn("new", F.lit(True)).unionByName(known.withColumn("fires", F.lit(False)).withColumn("new", F.lit(False))))
        else:
            todo = cut(new.withColumn("new", F.lit(True)))
        placed = cut(windows.stop_windows(todo, limit, fires=F.col("fires")))
        count = todo.groupBy("session_id").agg(F.count_if("fires").alias("windows"))
        past = done.before(batch_id, touched)
        closed = placed.filter("window_no IS NOT NULL").withColumn("__before", F.lit(0).cast("long"))
        if past is not None:
            past = past.select("session_id", F.col("windows").alias("__past"))
            count = count.join(past, "session_id", "left").select("session_id", (F.col("windows") + F.coalesce("__past", F.lit(0))).alias("windows"))
            closed = closed.join(past, "session_id", "left").withColumn("__before", F.coalesce("__past", F.lit(0))).drop("__past")
        closed = closed.withColumn("window_no", F.col("window_no") + F.col("__before"))
        closed.select("session_id", "window_no", "event_id", "ts").write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")
        if on_closed is not None:
            on_closed(closed.drop("new", "fires", "__before").withColumn("window_id", F.concat_ws(":", F.col("session_id").cast("string"), F.col("window_no").cast("string"))), batch_id)
        opened = placed.filter("window_no IS NULL AND new").drop("window_no", "fires", "new").withColumn("gone", F.lit(False))
        taken = placed.filter("window_no IS NOT NULL AND NOT new").select(*[F.col(c) if c in key else F.lit(None).cast(t).alias(c) for c, t in opened.dtypes if c != "gone"], F.lit(True).alias("gone"))
        waiting.write(opened.unionByName(taken), batch_id)
        done.write(count, batch_id)

    return _start(placed_in.select(F.col("root_session_id").alias("session_id"), "event_id", "ts", "event_name", "closes", *carry), checkpoint, sink)


#: What a fix is found by.
CALL = ("tool_name", "tool_input", "tool_response", "tool_error", "is_interrupt")


def fixes_stream(events: DataFrame, path: str, checkpoint: str, limit: int = params.EXTRACTION_WINDOW) -> StreamingQuery:
    """Failures with their fixes, told when the window that holds both closes; nothing outside the stream is read."""

    def told(closed: DataFrame, batch_id: int) -> None:
        pairing.fix_for_failure(closed, "window_id").write.mode("overwrite").parquet(f"{path}_fixes/batch={batch_id:012d}")

    return windows_stream(events, path, checkpoint, limit, carry=CALL, on_closed=told)


#: The kinds of rows that activity touches, and the column of their id.
TOUCHED = {"session": "session_id", "project": "project_id", "user": "user_id"}


def _joined_touches(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind", "id").agg(
        F.min("created_at").alias("created_at"), F.max("last_activity_at").alias("last_activity_at"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.min("owner").alias("owner"), F.min("home").alias("home"),
    )


def touches_log(spark: SparkSession, path: str) -> RunLog:
    return RunLog(spark, path, ["kind", "id"], merge=_joined_touches)


def sessions_stream(touches: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Sessions, projects and users in one snapshot: a batch writes one partial row per id it touches, with first and last activity, the first and
    last source, and a session's first owner and project; rows are merged as runs are. Columns ``source`` and ``project_id`` may be missing."""
    log = touches_log(touches.sparkSession, path)
    have = dict(touches.dtypes)
    rows = touches.select("ts", "event_id", *[F.col(c).cast("string").alias(c) if c in have else F.lit(None).cast("string").alias(c) for c in ("session_id", "project_id", "user_id", "source")])

    def partial(batch: DataFrame, batch_id: int) -> None:
        at = F.struct("ts", "event_id")

        def said(name: str) -> Column:
            return F.when(F.col(name).isNotNull(), F.struct(at.alias("at"), F.col(name).alias("value")))

        each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("id")) for k, c in TOUCHED.items()]))
        found = batch.select("*", each.alias("of")).select("*", "of.kind", "of.id").filter("id IS NOT NULL")
        log.write(found.groupBy("kind", "id").agg(
            F.min("ts").alias("created_at"), F.max("ts").alias("last_activity_at"), F.min(said("source")).alias("first"), F.max(said("source")).alias("last"),
            F.min(said("user_id")).alias("owner"), F.min(said("project_id")).alias("home"),
        ), batch_id)

    return _start(rows, checkpoint, partial)


def read_touched(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The rows of a kind after the last batch: id, created_at, last_activity_at, first and last source; for sessions also user_id and project_id."""
    last = spark.read.parquet(path).agg(F.max(F.col("run_last").cast("long")).alias("n")).first()["n"]
    rows = touches_log(spark, path).after(last + 1).filter(F.col("kind") == kind)
    return rows.select(
        F.col("id"), "created_at", "last_activity_at", F.col("first.value").alias("source"), F.col("last.value").alias("last_source"),
        *([F.col("owner.value").alias("user_id"), F.col("home.value").alias("project_id")] if kind == "session" else []),
    )


def link_stream(injections: DataFrame, events: DataFrame, path: str, checkpoint: str, seconds: int = params.INJECTION_WINDOW_SECONDS) -> StreamingQuery:
    """Injections with hook events within the interval, whichever side comes first and however late: both sides are kept in
    a log by session, and a batch joins its new rows with the other side's rows of its sessions' ranges."""
    common = ["session_id", "name", "at", "prompt", "injection_id", "learning_id", "event_id"]
    kinds = dict(events.dtypes) | dict(injections.dtypes)

    def missing(name: str) -> Column:
        return F.lit(None).cast(kinds[name]).alias(name)

    inj = injections.select("session_id", F.col("hook_event").alias("name"), F.col("injected_at").alias("at"), "prompt", "injection_id", "learning_id", missing("event_id"))
    hook = events.filter(F.col("event_name").isin(*ev.INJECTION_EVENTS)).select(
        "session_id", F.col("event_name").alias("name"), F.col("ts").alias("at"), "prompt", missing("injection_id"), missing("learning_id"), "event_id"
    )

    def pairs(i: DataFrame, e: DataFrame) -> DataFrame:
        i, e = i.alias("i"), e.alias("e")
        near = (
            (F.col("i.session_id") == F.col("e.session_id")) & (F.col("i.name") == F.col("e.name")) & (F.col("i.prompt").isNull() | (F.col("i.prompt") == F.col("e.prompt")))
            & (F.col("e.at") >= F.col("i.at") - F.expr(f"INTERVAL {seconds} SECONDS")) & (F.col("e.at") <= F.col("i.at"))
        )
        return i.join(e, near).select("i.injection_id", "i.learning_id", "e.event_id", F.col("e.at").alias("event_ts"))

    sides = RunLog(events.sparkSession, f"{path}_sides", "session_id")

    def sink(batch: DataFrame, batch_id: int) -> None:
        new = cut(batch)
        old = sides.before(batch_id, new.select("session_id"))
        old = new.limit(0) if old is None else old
        is_injection = F.col("injection_id").isNotNull()
        found = pairs(new.filter(is_injection), old.unionByName(new).filter(~is_injection)).unionByName(pairs(old.filter(is_injection), new.filter(~is_injection)))
        found.write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")
        sides.write(new, batch_id)

    return _start(inj.select(*common).unionByName(hook.select(*common)), checkpoint, sink)


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """The newest match of every injection."""
    return spark.read.parquet(path).groupBy("injection_id", "learning_id").agg(F.max_by("event_id", F.struct("event_ts", "event_id")).alias("event_id"))


def inject_once_stream(injections: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """One injection of a content per session and target, for good."""
    rows = injections.withColumn("content_sha", sha16(F.col("content"))).withColumn(
        "injection_key", F.concat_ws("|", F.col("session_id").cast("string"), "prompt_name", "content_sha", "target")
    )
    return _start(rows, checkpoint, deduplicated_log(injections.sparkSession, path, "injection_key"))
