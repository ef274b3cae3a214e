"""Ordered computations over keys of any size.

A plain window over a key puts the whole key on one task. Here a key is cut into
segments: time slices, a pure function of the row, or, where some slice of a key holds too many rows, ranges
that follow density (``laid_out``). The heavy window runs per (key, segment); one summary
row per segment carries the running state across. The join back uses the same
(key, segment) partitioning, so the detail rows are shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelore.session import stored

SEG = "__segment"
HOUR = 3600
#: Rows of one key in one time slice beyond which cuts follow density.
SLICE_ROWS = 1_000_000


def time_slice(ts: Column, seconds: int = HOUR) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("long")


def _same(keys: Sequence[str], left: DataFrame, right: DataFrame) -> Column:
    cond = left[SEG] == right[SEG]
    for key in keys:
        cond = cond & left[key].eqNullSafe(right[key])
    return cond


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: Column,
    values: dict[str, Column],
    inclusive: bool = True,
) -> DataFrame:
    """Add running sums of ``values`` within ``keys`` by ``order``. ``segment`` must not
    decrease along ``order``."""
    keys = list(keys)
    base = df.withColumn(SEG, segment)
    for name, value in values.items():
        base = base.withColumn(f"__v_{name}", value)
    frame = Window.partitionBy(*keys, SEG).orderBy(*order)
    frame = frame.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = base
    for name in values:
        local = local.withColumn(f"__l_{name}", F.coalesce(F.sum(f"__v_{name}").over(frame), F.lit(0)))
    totals = base.groupBy(*keys, SEG).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in values])
    before = Window.partitionBy(*keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, SEG, *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__c_{n}") for n in values]
    )
    joined = local.join(carry, _same(keys, local, carry), "inner")
    return joined.select(
        *[local[c] for c in df.columns],
        *[(F.col(f"__l_{n}") + F.col(f"__c_{n}")).alias(n) for n in values],
    )


def neighbours(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], segment: Column, value: str
) -> DataFrame:
    """Add ``prev_<value>`` and ``next_<value>`` along ``order`` within ``keys``."""
    keys = list(keys)
    base = df.withColumn(SEG, segment)
    win = Window.partitionBy(*keys, SEG).orderBy(*order)
    local = base.withColumn("__prev", F.lag(value).over(win)).withColumn("__next", F.lead(value).over(win))
    position = F.struct(*order)
    edges = base.groupBy(*keys, SEG).agg(
        F.min_by(value, position).alias("__first"), F.max_by(value, position).alias("__last")
    )
    along = Window.partitionBy(*keys).orderBy(SEG)
    edges = edges.select(
        *keys, SEG, F.lag("__last").over(along).alias("__before"), F.lead("__first").over(along).alias("__after")
    )
    joined = local.join(edges, _same(keys, local, edges), "inner")
    return joined.select(
        *[local[c] for c in df.columns],
        F.coalesce("__prev", "__before").alias(f"prev_{value}"),
        F.coalesce("__next", "__after").alias(f"next_{value}"),
    )


def dense_segments(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "segments", segment: str = SEG, parts: int | None = None
) -> DataFrame:
    """``df`` in stored form with a column ``segment`` that cuts every key where its rows are dense: rows are dealt by ranges of
    (keys, order), whose bounds Spark takes from a sample, so a key of many rows is cut into many segments however close together they
    lie, and small keys share a range without being cut. Segments never decrease along ``order``. ``order`` should tell
    rows apart; only rows equal in all of it must share a segment. The cuts are read back from files, so a repeated task
    sees the same ones. Without ``parts`` the session's number of shuffle partitions holds, small ones merged."""
    by = [F.col(k).asc_nulls_first() for k in keys] + list(order)
    dealt = df.repartitionByRange(*by) if parts is None else df.repartitionByRange(parts, *by)
    return stored(dealt.withColumn(segment, F.spark_partition_id().cast("long")), name)


def laid_out(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str = "ts", width: int = HOUR, most: int = SLICE_ROWS, name: str = "segments",
    parts: int | None = None,
) -> DataFrame:
    """``df`` with a segment that never decreases along ``order`` and holds a bounded part of a key: slices of ``width`` seconds where they suffice,
    else ranges that follow density, in which a key may hold all its rows in one second."""
    sliced = df.withColumn(SEG, time_slice(F.col(ts), width))
    if sliced.groupBy(*keys, SEG).agg(F.count("*").alias("__n")).filter(F.col("__n") > most).isEmpty():
        return sliced
    return dense_segments(df, keys, [F.col(c).asc_nulls_first() for c in order], name, parts=parts)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "place", keep: Sequence[Column | str] | None = None) -> DataFrame:
    """``df``, or its columns ``keep``, with the rank of each row within ``keys`` by ``order``, from 0. Ranks are counted inside the ranges
    that rows are dealt into; one line per key and range carries the count before it. ``keep`` needs the keys and drops columns that only
    the order uses before the rows are written."""
    keys, by = list(keys), [F.col(k).asc_nulls_first() for k in keys] + list(order)
    laid = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    laid = stored(laid.select(*(keep if keep is not None else df.columns), "__at"), f"numbered-{name}")
    laid = laid.withColumn(SEG, F.shiftright("__at", 33))
    before = Window.partitionBy(*keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    starts = laid.groupBy(*keys, SEG).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    shift = F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")
    starts = starts.select(*[F.col(c).alias(f"__of_{c}") for c in [*keys, SEG]], shift.alias("__shift"))
    same = F.lit(True)
    for key in [*keys, SEG]:
        same = same & F.col(key).eqNullSafe(F.col(f"__of_{key}"))
    rest = [c for c in laid.columns if c not in ("__at", SEG)]
    return laid.join(starts, same).select(*rest, (F.col("__at") + F.col("__shift")).cast("long").alias(name))


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every key. The rank filter lets each map task keep
    only ``k`` rows per key before the shuffle, so a hot key costs k rows per task."""
    win = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(win)).filter(F.col(rank) <= k)
