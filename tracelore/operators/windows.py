"""Work windows: what a Stop closes, what is still unprocessed, digests and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelore import params
from tracelore.operators.events import NEUTRAL_EVENTS
from tracelore.operators.segments import HOUR, SEG, SLICE_ROWS, laid_out, running_sums, time_slice, top_per_key
from tracelore.session import bucketed, cut, stored

DAY = 24 * HOUR


def closure(edges: DataFrame, parent: str = "parent", child: str = "child") -> DataFrame:
    """(ancestor, node, depth) for every node and each of its ancestors, itself at depth 0.

    Each round joins what is known with itself, so the reach doubles and a tree of depth n takes
    log n rounds. A pair keeps its smallest depth, so links in a circle end as well: each node then
    has the circle's other nodes as ancestors.
    """
    steps = edges.select(F.col(parent).alias("ancestor"), F.col(child).alias("node")).filter("ancestor IS NOT NULL AND ancestor <> node").distinct()
    nodes = edges.select(F.col(child).alias("node")).union(edges.select(F.col(parent))).filter(F.col("node").isNotNull()).distinct()
    reached = cut(nodes.select(F.col("node").alias("ancestor"), "node", F.lit(0).alias("depth")).unionByName(steps.withColumn("depth", F.lit(1))))
    while True:
        up = reached.filter("depth > 0").select("ancestor", F.col("node").alias("__mid"), F.col("depth").alias("__far"))
        far = reached.filter("depth > 0").withColumnRenamed("ancestor", "__mid").join(up, "__mid").select("ancestor", "node", (F.col("depth") + F.col("__far")).alias("depth"))
        nxt = cut(reached.unionByName(far).groupBy("ancestor", "node").agg(F.min("depth").alias("depth")))
        if nxt.join(reached, ["ancestor", "node", "depth"], "left_anti").isEmpty():
            return reached
        reached = nxt


def roots(edges: DataFrame, parent: str = "parent", child: str = "child") -> DataFrame:
    """(node, root): each round doubles the reach. A node that is open after as many doublings as its
    table could need lies below a circle, which is an error."""
    jump = cut(
        edges.select(F.col(child).alias("node"), F.coalesce(F.col(parent), F.col(child)).alias("root")).distinct()
    )
    for _ in range(jump.count().bit_length() + 1):
        up = jump.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
        moved = cut(
            jump.join(up, F.col("root") == F.col("__n"), "left").select(
                "node", F.coalesce("__r", "root").alias("root"), (F.coalesce("__r", "root") != F.col("root")).alias("__moved")
            )
        )
        jump = moved.drop("__moved")
        if moved.filter("__moved").isEmpty():
            return jump
    raise ValueError("cyclic parent links")


def unprocessed(
    events: DataFrame, tree: DataFrame, ledger: DataFrame, limit: int = params.EXTRACTION_WINDOW
) -> DataFrame:
    """Per origin session the oldest ``limit`` events of it and its descendants that the
    ledger of (project, mode) does not hold. ``tree`` is a closure (ancestor, node)."""
    todo = events.join(ledger.select("project_id", "event_id"), ["project_id", "event_id"], "left_anti")
    scoped = todo.join(tree.select(F.col("ancestor").alias("origin_session_id"), F.col("node").alias("session_id")), "session_id")
    return top_per_key(scoped, ["origin_session_id"], [F.col("ts").asc(), F.col("event_id").asc()], limit, "position")


def stop_windows(
    events: DataFrame, limit: int = params.EXTRACTION_WINDOW, session: str = "session_id", fires: Column | None = None, most: int = SLICE_ROWS,
    ordered: bool = False,
) -> DataFrame:
    """Number the windows closed by each session's Stops: at a Stop the oldest ``limit``
    unprocessed events are taken, the rest wait for the next Stop. Events no Stop has
    reached yet get a null ``window_no``. ``fires`` marks the closing events, Stops by default; ``ordered`` adds ``window_order``, the running number
    of the event in its session.

    With N_k events up to Stop k, the events taken by then are
    C_i = min over k <= i of (N_k + limit * (i - k)) and limit * i, a running minimum;
    an event with running number g belongs to the first i with C_i >= g. A window
    covers at most two blocks of ``limit`` running numbers, which makes the match an
    equi-join on the block.
    """
    closing = F.col("event_name") == "Stop" if fires is None else fires
    rows = laid_out(events, [session], ["ts", "event_id"], most=most)
    numbered = running_sums(rows, [session], ["ts", "event_id"], F.col(SEG), {"__g": F.lit(1), "__i": closing.cast("int")})
    if ordered:
        # The narrow rows of ``membership``: read twice below, for the stops and for the events they take.
        numbered = stored(numbered, "numbered-events")
    stops = stored(numbered.filter(closing).select(
        session, F.col("__i").alias("window_no"), (F.col("__g") - limit * F.col("__i")).alias("__d"),
        F.floor(F.col("__i") / 1000).alias("__b"),
    ), "stops")
    # Running minimum over stops, again in two levels: blocks of 1000 stops.
    inner = Window.partitionBy(session, "__b").orderBy("window_no").rowsBetween(Window.unboundedPreceding, 0)
    blocks = stops.groupBy(session, "__b").agg(F.min("__d").alias("__m"), F.max("window_no").alias("__w"))
    outer = Window.partitionBy(session).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__m0", F.min("__m").over(outer)).drop("__m", "__w")
    taken = stops.withColumn("__m", F.min("__d").over(inner)).join(blocks, [session, "__b"]).select(
        session, "window_no",
        (F.least(F.col("__m"), F.coalesce("__m0", F.lit(0)), F.lit(0)) + limit * F.col("window_no")).alias("__hi"),
        "__b",
    )
    ends = taken.select(session, (F.col("window_no") + 1).alias("window_no"), F.col("__hi").alias("__lo"))
    spans = taken.join(ends, [session, "window_no"], "left").select(
        session, "window_no", "__hi", F.coalesce("__lo", F.lit(0)).alias("__lo")
    )
    spans = spans.filter(F.col("__hi") > F.col("__lo")).withColumn(
        "__block", F.explode(F.sequence(F.floor((F.col("__lo")) / limit), F.floor((F.col("__hi") - 1) / limit)))
    )
    placed = numbered.withColumn("__block", F.floor((F.col("__g") - 1) / limit))
    hit = (
        placed[session].eqNullSafe(spans[session])
        & (placed["__block"] == spans["__block"])
        & (placed["__g"] > spans["__lo"])
        & (placed["__g"] <= spans["__hi"])
    )
    return placed.join(spans, hit, "left").select(*[placed[c] for c in events.columns], spans["window_no"], *([placed["__g"].alias("window_order")] if ordered else []))


def membership(events: DataFrame, limit: int = params.EXTRACTION_WINDOW, session: str = "session_id", fires: Column | None = None) -> DataFrame:
    """(event_id, session, window_no, window_order, window_id): the windows that Stops have closed, as a narrow table in buckets of event_id. Only the columns
    that decide membership are read and written; a job joins it to the event columns it needs, and the table is not shuffled for that."""
    closing = F.col("event_name") == "Stop" if fires is None else fires
    narrow = events.select("event_id", session, "ts", closing.alias("__fires"))
    placed = stop_windows(narrow, limit, session, F.col("__fires"), ordered=True).filter("window_no IS NOT NULL")
    name = F.concat_ws(":", F.col(session).cast("string"), F.col("window_no").cast("string"))
    return bucketed(placed.select("event_id", session, "window_no", "window_order", name.alias("window_id")), ["event_id"], "windows")


def in_windows(events: DataFrame, members: DataFrame) -> DataFrame:
    """``events`` of closed windows with window_no, window_order and window_id. What a later step doesn't use of them is never read."""
    return events.join(members.select("event_id", "window_no", "window_order", "window_id"), "event_id")


def in_trees(events: DataFrame, tops: DataFrame) -> DataFrame:
    """Add ``root_session_id`` and ``closes``: a session's subagents, at any depth, belong to its root's work, and a Stop
    of the root closes a window over all of it. ``tops``: (node, root); a session without a row is its own root."""
    known = events.join(tops.select(F.col("node").alias("session_id"), F.col("root").alias("__root")), "session_id", "left")
    root = F.coalesce("__root", "session_id")
    return known.withColumn("root_session_id", root).withColumn("closes", (F.col("event_name") == "Stop") & (F.col("session_id") == root)).select(
        *events.columns, "root_session_id", "closes"
    )


def tree_windows(events: DataFrame, tops: DataFrame, limit: int = params.EXTRACTION_WINDOW) -> DataFrame:
    """``stop_windows`` over session trees: the events of a root session and of all its subagents are taken together."""
    return stop_windows(in_trees(events, tops), limit, session="root_session_id", fires=F.col("closes"))


def window_digest(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Per window: digest of the ordered event ids, bounds, counts. A window holds at
    most its limit, so the id list is short."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct("ts", F.col("event_id").cast("string").alias("id")))), lambda x: x["id"])
    return windows.groupBy(*keys).agg(
        ids.alias("event_ids"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("ended_at"),
        F.count("*").alias("event_count"),
        F.bool_or(~F.col("event_name").isin(*NEUTRAL_EVENTS)).alias("has_work"),
    ).withColumn(
        "digest", F.substring(F.sha1(F.array_join("event_ids", "\n").cast("binary")), 1, 16)
    )


def work_windows(digests: DataFrame) -> DataFrame:
    """Windows that hold more than session start and end markers."""
    return digests.filter("has_work")


def processing_ledger(digests: DataFrame, mode: str, counts: DataFrame | None, keys: list[str], run: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(ledger rows, window-event rows). ``counts`` gives learning and observation
    counts per window, None where a run produced nothing; ``run`` the model, status and skip reason columns."""
    produced = ("learning_count", "observation_count")
    counted = digests.withColumns({c: F.lit(0) for c in produced}) if counts is None else digests.join(counts, keys, "left")
    ledger = counted.withColumns(
        {
            **{c: F.coalesce(c, F.lit(0)) for c in produced},
            "mode": F.lit(mode),
            "processing_id": F.concat_ws(
                ":", F.lit("processing"), F.col("project_id").cast("string"), F.col("session_id").cast("string"), F.lit(mode), F.col("digest")
            ),
            **run,
        }
    ).withColumn(
        "summary",
        F.concat(
            F.lit("Processed "), F.col("event_count").cast("string"), F.lit(f" {mode} events and produced "),
            F.col("learning_count").cast("string"), F.lit(" learning actions and "),
            F.col("observation_count").cast("string"), F.lit(" observations."),
        ),
    )
    events = ledger.select("processing_id", F.explode("event_ids").alias("event_id"))
    return ledger.drop("event_ids"), events


# --- injections ----------------------------------------------------------------

def echo_pairs(links: DataFrame, tree: DataFrame, injected: DataFrame) -> DataFrame:
    """Rows of ``links`` (learning_id, session_id, at) whose learning had been injected into
    the session or one of its subagents by ``at``. An injection is carried up to the
    ancestors of its session, as many rows as the tree is deep, and only the earliest per
    (learning, ancestor) is kept; a root with many subagents costs nothing extra."""
    climbed = injected.join(tree.select(F.col("node").alias("session_id"), "ancestor"), "session_id").groupBy(
        "learning_id", F.col("ancestor").alias("session_id")
    ).agg(F.min("first_injected_at").alias("__at"))
    return links.join(climbed, ["learning_id", "session_id"]).filter(F.col("__at") <= F.col("at")).select(
        "learning_id", "session_id", "at"
    ).distinct()


def flag_injected(shortlist: DataFrame, tree: DataFrame, injected: DataFrame) -> DataFrame:
    """Add ``injected_this_session`` to shortlist rows (learning_id, session_id, at): true where the fact had been
    injected into the session or one of its subagents by ``at``, the end of the window."""
    known = echo_pairs(shortlist, tree, injected).withColumn("injected_this_session", F.lit(True))
    return shortlist.join(known, ["learning_id", "session_id", "at"], "left").select(
        *shortlist.columns, F.coalesce("injected_this_session", F.lit(False)).alias("injected_this_session")
    )


def link_injections(injections: DataFrame, events: DataFrame, seconds: int = params.INJECTION_WINDOW_SECONDS) -> DataFrame:
    """Each injection with the newest matching hook event at most ``seconds`` before it.

    The interval is cut into slices of its own width: an injection looks into its slice
    and the one before, so the join is an equi-join on (session, event name, slice).
    """
    inj = injections.withColumn(
        "__slice", F.explode(F.array(time_slice(F.col("injected_at"), seconds), time_slice(F.col("injected_at"), seconds) - 1))
    )
    ev = events.select(
        "session_id", F.col("event_name").alias("hook_event"), F.col("event_id").alias("linked_event_id"),
        F.col("ts").alias("event_ts"), F.col("prompt").alias("event_prompt"), time_slice(F.col("ts"), seconds).alias("__slice"),
    )
    hit = inj.join(ev, ["session_id", "hook_event", "__slice"]).filter(
        F.col("event_ts").between(F.col("injected_at") - F.expr(f"INTERVAL '{seconds}' SECOND"), F.col("injected_at"))
        & (F.col("prompt").isNull() | (F.col("prompt") == F.col("event_prompt")))
    )
    return hit.groupBy("injection_id", "learning_id", "session_id").agg(
        F.max_by("linked_event_id", F.struct("event_ts", "linked_event_id")).alias("event_id"),
        F.max("event_ts").alias("event_ts"),
    )


def backfill_links(
    injections: DataFrame, events: DataFrame, links: DataFrame, seconds: int = params.INJECTION_WINDOW_SECONDS
) -> DataFrame:
    """From the event side: injections recorded up to ``seconds`` before the event, whose
    learning has no link to an event in that time yet."""
    inj = injections.withColumn(
        "__slice", F.explode(F.array(time_slice(F.col("injected_at"), seconds), time_slice(F.col("injected_at"), seconds) + 1))
    )
    ev = events.select(
        "session_id", F.col("event_name").alias("hook_event"), "event_id", F.col("ts").alias("event_ts"),
        time_slice(F.col("ts"), seconds).alias("__slice"),
    )
    late = inj.join(ev, ["session_id", "hook_event", "__slice"]).filter(
        F.col("injected_at").between(F.col("event_ts") - F.expr(f"INTERVAL '{seconds}' SECOND"), F.col("event_ts"))
    ).select("learning_id", "session_id", "event_id", "event_ts").distinct()
    recent = links.select(
        "learning_id", F.col("event_ts").alias("__linked"),
        F.explode(F.array(time_slice(F.col("event_ts"), seconds), time_slice(F.col("event_ts"), seconds) + 1)).alias("__slice"),
    )
    fresh = (
        (F.col("l.learning_id") == F.col("r.learning_id"))
        & (F.col("l.__slice") == F.col("r.__slice"))
        & F.col("r.__linked").between(F.col("l.event_ts") - F.expr(f"INTERVAL '{seconds}' SECOND"), F.col("l.event_ts"))
    )
    return late.withColumn("__slice", time_slice(F.col("event_ts"), seconds)).alias("l").join(
        recent.alias("r"), fresh, "left_anti"
    ).drop("__slice")
