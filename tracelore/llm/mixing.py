"""Mixing sources to target weights by Pareto order sampling.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share all words;
a target stops at ``MOST`` times its source's size, the excess goes to the others by weight. Inside a
source the same sharing runs over size classes (powers of two), where longer documents weigh a little
less, so that inclusion is unequal. target / size of a class is the wished number of copies: its whole part
is certain, its fraction is the probability p of one more copy. Documents are ranked by random odds over
inclusion odds, u/(1-u) : p/(1-p), and taken in that order until the words that remain of the source's
target are used up; the document on the border is taken when that comes nearer to the target.

The rank is never a sort of a whole source: words are added up by (source, bin of the rank), the bin on the
border is found from those sums, and only its documents are ordered.

Null texts have size 0 and are taken 0 times; a null source is a source of its own; u depends on doc_id
alone, so reruns agree, and rows with equal doc_id in a source are taken or left together; an empty table gives an
empty result; other columns are kept by ``mix`` and ignored by ``mix_plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelore.llm.base import fresh, hash_share, join_on, n_words, publish

WEIGHTS = (5, 2, 1)
MOST = 3
#: Bins of the rank in a source.
BINS = 16384


def share_out(groups: DataFrame, parts: list[str], total: Column) -> DataFrame:
    """Add ``target``: ``total`` of the part shared by ``weight``, at most ``cap`` each, what is over reshared
    by weight until nothing is. Columns: parts, weight, cap. Each round is one aggregate per part; only a count of
    newly capped groups reaches the driver."""
    state = publish(groups.withColumn("__full", F.lit(False)), "shares")
    while True:
        if parts:
            level = state.groupBy(*parts).agg(
                F.sum(F.when(F.col("__full"), F.col("cap")).otherwise(0.0)).alias("__used"),
                F.sum(F.when(~F.col("__full"), F.col("weight")).otherwise(0.0)).alias("__open"),
            )
            known = join_on(state, level, parts)
        else:
            row = state.agg(F.sum(F.when(F.col("__full"), F.col("cap")).otherwise(0.0)), F.sum(F.when(~F.col("__full"), F.col("weight")).otherwise(0.0))).first()
            known = state.withColumn("__used", F.lit(float(row[0] or 0.0))).withColumn("__open", F.lit(float(row[1] or 0.0)))
        offer = F.when(F.col("__open") > 0, (total - F.col("__used")) * F.col("weight") / F.col("__open")).otherwise(F.col("cap"))
        known = known.withColumn("target", F.when(F.col("__full"), F.col("cap")).otherwise(offer))
        over = ~F.col("__full") & (F.col("target") > F.col("cap"))
        if known.filter(over).isEmpty():
            return known.select(*groups.columns, "target")
        state = publish(known.select(*groups.columns, (F.col("__full") | over).alias("__full")), "shares")


def _ranked(sources: DataFrame) -> DataFrame:
    """Add ``rank`` (0, 1, ...) by source in code point order, null last: ranges first, then a number inside each
    range plus the rows of the ranges before."""
    ranges = publish(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("__range", F.spark_partition_id()), "sources")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranges.groupBy("__range").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(F.col("source").asc_nulls_last())) - 1
    return ranges.withColumn("rank", inside).join(counts, "__range").select(*sources.columns, (F.col("rank") + F.col("__before")).alias("rank"))


def targets(sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, source_size, target) and (source, class, class_target, whole, p) of a table (source, class, size)."""
    classes = publish(sizes.groupBy("source", "class").agg(F.sum("size").alias("class_size"), F.count("*").alias("n")), "classes")
    sources = classes.groupBy("source").agg(F.sum("class_size").alias("source_size"))
    ranked = _ranked(sources)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    by_source = publish(share_out(
        ranked.select("source", "source_size", weight.alias("weight"), (MOST * F.col("source_size")).cast("double").alias("cap")), [], F.lit(total)
    ).select("source", "source_size", "target"), "targets")
    mixed = join_on(classes.filter("class_size > 0"), by_source, ["source"]).select(
        "source", "class", "class_size", "n", F.col("target").alias("whole_target"),
        (F.col("class_size") / (1 + F.col("class") / 16)).alias("weight"), (MOST * F.col("class_size")).cast("double").alias("cap"),
    )
    shared = share_out(mixed, ["source"], F.col("whole_target"))
    copies = F.round(F.col("target") / F.col("class_size"), 9)
    by_class = publish(shared.select("source", "class", "class_size", "n", "whole_target", F.floor(copies).alias("whole"), (copies - F.floor(copies)).alias("p")), "classes")
    return by_source, by_class


def _logit(x: Column) -> Column:
    return F.log(x / (1 - x))


def mix_plan(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row of (doc_id, source, text)."""
    size_class = F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)).cast("double"))).cast("int")
    sizes = publish(docs.select("doc_id", "source", n_words("text").alias("size")).withColumn("class", size_class), "sizes")
    return _planned(sizes, seed).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _planned(sizes: DataFrame, seed: int) -> DataFrame:
    by_source, by_class = targets(sizes)
    # The rank's bins follow the source's mean inclusion, so that they hold about as many documents each.
    centre = by_class.groupBy("source").agg(
        F.max("whole_target").alias("whole_target"), F.sum(F.col("class_size") * F.col("whole")).alias("certain"),
        F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.sum(F.col("p") * F.col("n")) / F.sum("n"))).alias("mean_p"),
    ).select("source", (F.col("whole_target") - F.col("certain")).alias("rest"), "mean_p")
    known = publish(join_on(by_class, centre, ["source"]).select("source", "class", "whole", "p", "mean_p", "rest"), "inclusion")
    offered = join_on(sizes.filter("size > 0"), known, ["source", "class"]).select(
        "source", "doc_id", "size", *_rank("mean_p", seed)
    ).filter("p > 0")
    sums = offered.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.max("rest").alias("rest"))
    so_far = F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
    border = publish(
        sums.withColumn("so_far", so_far).filter(F.col("so_far") > F.col("rest"))
        .groupBy("source").agg(F.min(F.struct("bin", (F.col("so_far") - F.col("words")).alias("before"), "rest")).alias("b"))
        .select("source", F.col("b.bin").alias("bin"), F.col("b.before").alias("before"), F.col("b.rest").alias("rest")), "border")
    near = join_on(offered.drop("rest"), border, ["source", "bin"]).groupBy("source", "odds", "doc_id").agg(
        F.sum("size").alias("words"), F.max("before").alias("before"), F.max("rest").alias("rest")
    )
    line = Window.partitionBy("source").orderBy("odds", F.col("doc_id").asc_nulls_first())
    reached = F.col("before") + F.sum("words").over(line.rowsBetween(Window.unboundedPreceding, 0))
    # A document is taken while that brings the source nearer to its target.
    last = near.withColumn("gain", F.abs(reached - F.col("rest")) <= F.abs(reached - F.col("words") - F.col("rest"))).filter("gain").groupBy("source").agg(
        F.max(F.struct("odds", F.col("doc_id").isNotNull().alias("some"), "doc_id")).alias("last")
    )
    cut = join_on(border.select("source", F.col("bin").alias("last_bin")), last, ["source"], "left")
    plan = publish(join_on(join_on(known, cut, ["source"], "left"), by_source, ["source"]), "plan")
    rows = join_on(sizes, plan.drop("source_size", "target"), ["source", "class"], "left").select(
        "source", "doc_id", "size", "class", "whole", "last_bin", "last", *_rank("mean_p", seed)
    )
    here = F.struct("odds", F.col("doc_id").isNotNull().alias("some"), "doc_id")
    more = (F.col("p") > 0) & (F.col("last_bin").isNull() | (F.col("bin") < F.col("last_bin")) | ((F.col("bin") == F.col("last_bin")) & F.col("last").isNotNull() & (here <= F.col("last"))))
    copies = F.when(F.col("size") > 0, F.coalesce(F.col("whole"), F.lit(0)) + F.when(F.coalesce(more, F.lit(False)), 1).otherwise(0)).otherwise(0).cast("long")
    return join_on(rows.withColumn("copies", copies), by_source, ["source"]).select("doc_id", "source", "size", "source_size", "target", "copies")


def _rank(mean_p: str, seed: int) -> list[Column]:
    """p, rest, odds (the logarithm of random odds over inclusion odds) and its bin."""
    p = F.col("p")
    odds = F.when(p > 0, _logit(hash_share("doc_id", seed=seed)) - _logit(p))
    at = 1 / (1 + F.exp(-(odds + _logit(F.col(mean_p)))))
    return [p.alias("p"), F.col("rest").alias("rest"), odds.alias("odds"), F.floor(at * BINS).cast("int").alias("bin")]


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mixed corpus: each row as often as planned, its columns unchanged. Rows meet the plan by (doc_id, source, size),
    which fixes the number of copies."""
    plan = mix_plan(docs, seed).select("doc_id", "source", "size", "copies").distinct()
    size, times = fresh(docs, "__size"), fresh(docs, "__times")
    sized = docs.withColumn(size, n_words("text"))
    planned = plan.select("doc_id", "source", F.col("size").alias(size), F.col("copies").alias(times))
    joined = join_on(sized, planned, ["doc_id", "source", size])
    return joined.withColumn(times, F.explode(F.array_repeat(F.lit(1), F.col(times).cast("int")))).select(*docs.columns)
