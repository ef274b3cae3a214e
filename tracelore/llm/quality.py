"""Quality rules as a short-circuit cascade.

Each rule is a boolean expression that rejects a document. Its cost and its rejection rate are
measured on a small sample; the rules are then tried in the order of rejections per cost, and the
first that rejects ends the trial. The order changes the work, never the verdict.

Null texts are empty, empty texts have no words and fail the base rule; ties, repeated rows and
repeated ids are judged row by row; an empty table gives an empty result; other columns of the
input are ignored by ``text_statistics`` and kept by ``cascade``.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelore.llm.base import fresh, let, publish, whole, words

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows on which costs and selectivities are measured.
SAMPLE_ROWS = 500
TIMINGS = 2
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def _covered(hashes: Column, width: int) -> Column:
    """Positions covered by windows whose hash occurs twice: sort (hash, position), take the
    positions with an equal neighbour, add up the uncovered part that each brings."""
    order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    marked = let(order, lambda s: F.sort_array(F.transform(
        F.filter(
            F.transform(s, lambda x, i: F.struct(x["i"].alias("i"), (F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))).alias("twice"))),
            lambda x: x["twice"],
        ),
        lambda x: x["i"],
    )))
    return let(marked, lambda p: F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width)))), F.lit(0), lambda a, x: a + x
    ))


def repeated_words(array: Column, width: int = WINDOW) -> Column:
    """Words inside ``width``-word windows that occur twice or more; equal 64-bit hashes count as equal windows."""
    return let(array, lambda w: F.when(F.size(w) <= width, F.lit(0)).otherwise(let(
        F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width))),
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h, width)),
    )))


def lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of the base rules: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long); columns of
    these names are replaced."""
    t = whole(text)
    kept = [c for c in df.columns if c.lower() not in COUNTS]
    word_stats = let(words(text), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("repeat")))
    line_stats = let(lines(t), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    w, l = fresh(df, "__words"), fresh(df, "__lines")  # noqa: E741
    return df.select(
        *kept, word_stats.alias(w), line_stats.alias(l),
        _without(t, " \t\n\x0b\x0c\r").cast("long").alias("word_chars"), (F.length(t) - _without(t, SYMBOLS)).cast("long").alias("n_symbols"),
    ).select(
        *kept, F.col(f"{w}.n").cast("long").alias("n_words"), "word_chars", "n_symbols",
        F.col(f"{l}.n").cast("long").alias("n_lines"), F.col(f"{l}.dup").cast("long").alias("n_dup_lines"), F.col(f"{w}.repeat").cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def default_rules(text: str = "text") -> list[Rule]:
    """Rules over the text and the counts of ``text_statistics``."""
    t = whole(text)
    stutter = let(words(text), lambda w: F.size(F.filter(F.transform(w, lambda x, i: F.coalesce(F.get(w, i - 1) == x, F.lit(False))), lambda same: same)))
    wordless = F.size(F.filter(words(text), lambda w: ~w.rlike(r"\p{L}")))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > F.col("n_words")),
        Rule("exclaiming", 10 * (F.length(t) - _without(t, "!")) > F.col("n_words")),
        Rule("shouting", F.length(t) - _without(t, UPPER) > F.length(t) - _without(t, UPPER.lower())),
        Rule("repeated lines", 2 * F.col("n_dup_lines") > F.col("n_lines")),
        Rule("word length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))),
        Rule("stutter", 10 * stutter > 3 * F.col("n_words")),
        Rule("no letters", 2 * wordless > F.col("n_words")),
    ]


def measured_order(sample: DataFrame, rules: list[Rule]) -> list[tuple[Rule, float, float]]:
    """(rule, rejection rate, seconds) by falling rejections per second on the sample. A rule's seconds are the least of ``TIMINGS`` runs, the first of
    which compiles, less those of a run without a rule, so that scheduling does not count. One aggregate row per run reaches the driver."""

    def least(rejects: Column) -> tuple[float, float]:
        spent = []
        for _ in range(TIMINGS):
            start = time.perf_counter()
            row = sample.agg(F.avg(F.coalesce(rejects, F.lit(False)).cast("double")).alias("share")).first()
            spent.append(time.perf_counter() - start)
        return float(row["share"] or 0.0), min(spent)

    _, idle = least(F.lit(False))
    found = []
    for rule in rules:
        share, spent = least(rule.rejects)
        found.append((rule, share, max(1e-4, spent - idle)))
    return sorted(found, key=lambda x: (-x[1] / max(x[2], 1e-6), x[2]))


def cascade(df: DataFrame, rules: list[Rule], sample: DataFrame | None = None, first: Column | None = None, name: str = "kept") -> DataFrame:
    """Add boolean ``name``: no rule rejects the row. ``first`` is a verdict known beforehand (true: rejected),
    which spares the row all rules. Null conditions do not reject."""
    if sample is None:
        total = df.count()
        sample = publish(df.sample(min(1.0, SAMPLE_ROWS / max(total, 1)), seed=7), "quality-sample")
    chain = None
    if first is not None:
        chain = F.when(first, F.lit(False))
    for rule, _, _ in measured_order(sample, rules):
        test = F.coalesce(rule.rejects, F.lit(False))
        chain = F.when(test, F.lit(False)) if chain is None else chain.when(test, F.lit(False))
    return df.withColumn(fresh(df, name), F.lit(True) if chain is None else chain.otherwise(F.lit(True)))


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and the verdict of the cascade. The counts are wanted of every
    document, so the cascade saves only the rules beyond them."""
    source = docs.select("doc_id", "text")
    total = source.count()
    sample = publish(text_statistics(source.sample(min(1.0, SAMPLE_ROWS / max(total, 1)), seed=7)), "quality-sample")
    counted = text_statistics(source)
    judged = cascade(counted, default_rules(), sample, base_failed())
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), "kept")
