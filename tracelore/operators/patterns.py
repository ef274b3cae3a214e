"""Task labels: resolution through aliases and merges, tagging, merge decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelore.functions.text import normalize_label, pattern_id
from tracelore.operators.segments import top_per_key
from tracelore.session import cut


def live_targets(patterns: DataFrame) -> DataFrame:
    """(id, live_id) for merged patterns: the end of the merge chain. Chains that leave the
    table or run in a circle have none. Each round doubles the step."""
    live = patterns.filter(F.coalesce("status", F.lit("active")) != "merged").select("id")
    jump = cut(patterns.filter("status = 'merged'").select("id", F.col("merged_into").alias("to")))
    # A chain has at most as many links as there are merged rows; what is open after that
    # many doublings runs in a circle.
    rounds = jump.count().bit_length() + 1
    for _ in range(rounds):
        hop = jump.select(F.col("id").alias("to"), F.col("to").alias("__next"))
        nxt = cut(jump.join(hop, "to", "left").select("id", F.coalesce("__next", "to").alias("to"), F.col("__next").isNotNull().alias("__open")))
        jump = nxt.drop("__open")
        if nxt.filter("__open").isEmpty():
            break
    return jump.join(live.select(F.col("id").alias("to")), "to", "left_semi").select("id", F.col("to").alias("live_id"))


def label_lookup(patterns: DataFrame, aliases: DataFrame) -> DataFrame:
    """(project_id, label, pattern_id), one row per label: a live pattern's own text and
    aliases come first, then merged-away texts followed to their live end; smallest id wins."""
    live = patterns.filter(F.coalesce("status", F.lit("active")) != "merged")
    own = live.select("project_id", F.col("normalized").alias("label"), F.lit(0).alias("tier"), F.col("id").alias("by"), F.col("id").alias("pattern_id"))
    extra = aliases.join(live.select("id"), "id", "left_semi").select(
        "project_id", "label", F.lit(0).alias("tier"), F.col("id").alias("by"), F.col("id").alias("pattern_id")
    )
    gone = patterns.join(live_targets(patterns), "id").select(
        "project_id", F.col("normalized").alias("label"), F.lit(1).alias("tier"), F.col("id").alias("by"), F.col("live_id").alias("pattern_id")
    )
    rows = own.unionByName(extra).unionByName(gone).filter(F.coalesce("label", F.lit("")) != "")
    return rows.groupBy("project_id", "label").agg(F.min_by("pattern_id", F.struct("tier", "by")).alias("pattern_id"))


def tag(learnings: DataFrame, tags: DataFrame, lookup: DataFrame) -> dict[str, DataFrame]:
    """Resolve every untagged learning's label exactly or mint a pattern for it. Returns the
    new tags, the minted patterns and all (pattern, session) links."""
    todo = learnings.filter(F.trim(F.coalesce("task_pattern", F.lit(""))) != "").join(
        tags.select(F.col("learning_id").alias("id")), "id", "left_anti"
    )
    named = todo.select("id", "project_id", F.trim("task_pattern").alias("raw"), normalize_label(F.col("task_pattern")).alias("label")).filter("label <> ''")
    found = named.join(lookup.select("project_id", "label", F.col("pattern_id").cast("string").alias("known")), ["project_id", "label"], "left")
    placed = found.withColumn("pattern_id", F.coalesce("known", pattern_id(F.col("project_id"), F.col("label"))))
    minted = placed.filter("known IS NULL").groupBy("pattern_id", "project_id", F.col("label").alias("normalized")).agg(
        F.min_by("raw", "id").alias("text")
    )
    new_tags = placed.select(F.col("id").alias("learning_id"), "pattern_id")
    every = new_tags.unionByName(tags.select("learning_id", F.col("pattern_id").cast("string").alias("pattern_id")))
    links = every.join(learnings.select(F.col("id").alias("learning_id"), "session_id"), "learning_id").select("pattern_id", "session_id").distinct()
    return {"tags": new_tags, "minted": minted, "links": links}


def pattern_profiles(patterns: DataFrame, tagged: DataFrame, skills: DataFrame, derived: DataFrame, samples: int = 2) -> DataFrame:
    """Per live pattern: tagged count, top sample ids by confidence, live skill slugs.
    ``tagged``: (pattern_id, learning_id, confidence)."""
    live = patterns.filter(F.coalesce("status", F.lit("active")) == "active")
    counts = tagged.groupBy("pattern_id").agg(F.count("*").alias("learning_count"))
    best = top_per_key(tagged, ["pattern_id"], [F.coalesce("confidence", F.lit(0.0)).desc(), F.col("learning_id").asc()], samples)
    best = best.groupBy("pattern_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "learning_id"))), lambda x: x["learning_id"]).alias("samples")
    )
    feeds = tagged.join(derived.select("learning_id", "skill_id"), "learning_id").join(
        skills.filter("status = 'approved'").select("skill_id", "slug"), "skill_id"
    ).select("pattern_id", "slug").distinct().groupBy("pattern_id").agg(F.array_sort(F.collect_list("slug")).alias("skill_slugs"))
    rows = live.withColumn("pattern_id", F.col("id"))
    for part in (counts, best, feeds):
        rows = rows.join(part.withColumnRenamed("learning_count", "tagged_count"), "pattern_id", "left")
    return rows.select(
        "id", "project_id", F.coalesce("tagged_count", F.lit(0)).alias("learning_count"), "samples", "skill_slugs",
        F.col("embedding").isNotNull().alias("embedded"), "reviewed",
    )


def check_merges(members: DataFrame, merges: DataFrame, labels: DataFrame) -> DataFrame:
    """(reply_id, reason): reason null when every merge of the reply is sound, else the first
    failing rule of the first failing merge. ``members``: (reply_id, merge, label);
    ``merges``: (reply_id, merge, canonical); ``labels``: (reply_id, label) shown."""
    known = labels.withColumn("__known", F.lit(True))
    seen = members.join(known, ["reply_id", "label"], "left")
    unknown = seen.filter("__known IS NULL").select("reply_id", "merge", F.lit(1).alias("rule"))
    sizes = seen.select("reply_id", "merge", "label").distinct()
    counts = merges.select("reply_id", "merge").join(sizes.groupBy("reply_id", "merge").agg(F.count("*").alias("n")), ["reply_id", "merge"], "left")
    small = counts.filter(F.coalesce("n", F.lit(0)) < 2).select("reply_id", "merge", F.lit(2).alias("rule"))
    firsts = sizes.groupBy("reply_id", "label").agg(F.min("merge").alias("__first"))
    twice = sizes.join(firsts, ["reply_id", "label"]).filter("merge > __first").select("reply_id", "merge", F.lit(3).alias("rule"))
    outside = merges.select("reply_id", "merge", F.col("canonical").alias("label")).join(
        sizes, ["reply_id", "merge", "label"], "left_anti"
    ).select("reply_id", "merge", F.lit(4).alias("rule"))
    worst = unknown.unionByName(small).unionByName(twice).unionByName(outside).groupBy("reply_id").agg(F.min(F.struct("merge", "rule")).alias("w"))
    # What each rule says.
    text = (
        F.when(F.col("w.rule") == 1, "unknown label").when(F.col("w.rule") == 2, "a merge needs at least two distinct members")
        .when(F.col("w.rule") == 3, "label appears in more than one merge").when(F.col("w.rule") == 4, "canonical is not one of its members")
    )
    return merges.select("reply_id").distinct().join(worst, "reply_id", "left").select("reply_id", text.alias("reason"))


def guard_skills(merge_members: DataFrame, feeds: DataFrame) -> DataFrame:
    """(merge_id, skills, refused): a merge whose patterns feed two live skills is refused.
    ``merge_members``: (merge_id, pattern_id); ``feeds``: (pattern_id, slug)."""
    spans = merge_members.join(feeds, "pattern_id", "left").groupBy("merge_id").agg(F.count_distinct("slug").alias("skills"))
    return spans.withColumn("refused", F.col("skills") > 1)


def apply_merges(merges: DataFrame, patterns: DataFrame, tags: DataFrame, links: DataFrame, aliases: DataFrame, now, learnings: DataFrame | None = None) -> dict[str, DataFrame]:
    """State after merges (target, source, pos): tags and links move to the survivor, sources
    become tombstones, the survivor takes over their labels as aliases. With ``learnings`` the label text
    of the facts that moved becomes the survivor's; a fact with several takes the smallest target."""
    target = merges.select(F.col("source").alias("pattern_id"), "target")
    moved = tags.join(target, "pattern_id", "left").select("learning_id", F.coalesce("target", "pattern_id").alias("pattern_id")).distinct()
    seen = links.join(target, "pattern_id", "left").select(F.coalesce("target", "pattern_id").alias("pattern_id"), "session_id").distinct()
    gone = merges.select(F.col("source").alias("id"), F.col("target").alias("__to"))
    kept = merges.select(F.col("target").alias("id"), F.lit(True).alias("__kept")).distinct()
    state = patterns.join(gone, "id", "left").join(kept, "id", "left").withColumns(
        {
            "status": F.when(F.col("__to").isNotNull(), "merged").when(F.col("__kept"), "active").otherwise(F.col("status")),
            "merged_into": F.coalesce("__to", "merged_into"),
            "reviewed_at": F.when(F.col("__kept"), now).otherwise(F.col("reviewed_at") if "reviewed_at" in patterns.columns else F.lit(None).cast("timestamp")),
        }
    ).drop("__to", "__kept")
    out = {"tags": moved, "links": seen, "patterns": state, "aliases": merged_aliases(merges, patterns, aliases)}
    if learnings is not None:
        label = tags.join(target, "pattern_id").join(patterns.select(F.col("id").alias("target"), F.col("text").alias("__label")), "target").groupBy(
            F.col("learning_id").alias("id")
        ).agg(F.min_by("__label", "target").alias("__label"))
        out["learning"] = learnings.join(label, "id", "left").withColumn("task_pattern", F.coalesce("__label", "task_pattern")).drop("__label")
    return out


def merged_aliases(merges: DataFrame, patterns: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, label, position): a survivor's aliases, then each source's own text and aliases in
    merge order, first mention kept, never the survivor's own text."""
    owners = merges.select(F.col("target").alias("id")).distinct()
    own = aliases.join(owners, "id").select("id", F.lit(0).alias("src"), F.lit(0).alias("part"), "label")
    text = merges.join(patterns.select(F.col("id").alias("source"), F.col("normalized").alias("label")), "source").select(
        F.col("target").alias("id"), F.col("pos").alias("src"), F.lit(1).alias("part"), "label"
    )
    theirs = merges.join(aliases.select(F.col("id").alias("source"), "label"), "source").select(
        F.col("target").alias("id"), F.col("pos").alias("src"), F.lit(2).alias("part"), "label"
    )
    named = own.unionByName(text).unionByName(theirs).join(
        patterns.select("id", F.col("normalized").alias("__own")), "id"
    ).filter((F.coalesce("label", F.lit("")) != "") & (F.col("label") != F.col("__own")))
    # A survivor absorbs at most a community's worth of patterns, so its list is short.
    firsts = named.groupBy("id", "label").agg(F.min(F.struct("src", "part")).alias("at"))
    order = F.expr("row_number() OVER (PARTITION BY id ORDER BY at.src, at.part, label)")
    return firsts.select("id", "label", order.alias("position"))


def reviewed_after_pass(patterns: DataFrame, edges: DataFrame, presented: DataFrame) -> DataFrame:
    """Ids to mark reviewed: what was shown, plus unreviewed embedded patterns without any neighbour."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    lonely = patterns.filter(F.col("embedding").isNotNull() & ~F.col("reviewed") & (F.coalesce("status", F.lit("active")) == "active")).select("id").join(ends, "id", "left_anti")
    return presented.select("id").unionByName(lonely).distinct()
