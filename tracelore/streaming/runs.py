"""Keyed state of foreachBatch jobs that grows without a batch reading more and more of it.

Every batch appends one run: its rows, dealt by ranges of the key's hash into about one file per ``RANGE_ROWS`` rows. Whenever ``FAN`` runs of a level
are complete they are merged into one run of the next level, so n batches leave fewer than FAN runs on each of log(n) levels,
and a row is rewritten once per level. A lookup opens the live runs' files of the hash ranges that its keys fall into. Which runs
are live follows from the batch number alone: a replayed batch sees what it saw before and overwrites its own runs. Runs that a
merge replaced are deleted one batch later, when that batch can't be replayed any more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelore.session import cut

FAN = 8
RANGE_ROWS = 1_000_000
MOST_BITS = 20

Merge = Callable[[DataFrame], DataFrame]


def _hash(keys: list[str]) -> Column:
    """The key's hash as a number from 0 to 2^MOST_BITS - 1."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - MOST_BITS)


class RunLog:
    """Rows by ``keys``. ``merge`` shortens the rows of runs put together, for instance to one per key; by default they stay as they are."""

    def __init__(self, spark: SparkSession, path: str, keys: str | list[str], merge: Merge | None = None, fan: int = FAN, range_rows: int = RANGE_ROWS):
        self._spark, self._path, self._fan, self._range_rows = spark, path, fan, range_rows
        self._keys = [keys] if isinstance(keys, str) else list(keys)
        self._merge = merge or (lambda rows: rows)

    def _run(self, level: int, last: int) -> str:
        return f"{self._path}/run_level={level}/run_last={last:012d}"

    def live(self, batch_id: int) -> list[tuple[int, int]]:
        """(level, last batch) of the runs that hold the batches before ``batch_id``, oldest first."""
        runs, end, level, rest = [], batch_id, 0, batch_id
        while rest:
            here = rest % self._fan
            runs += [(level, end - 1 - i * self._fan**level) for i in range(here)]
            end -= here * self._fan**level
            rest //= self._fan
            level += 1
        return runs[::-1]

    def _read(self, runs: list[tuple[int, int]], ranges: Column | None = None) -> DataFrame:
        rows = self._spark.read.option("basePath", self._path).parquet(*[self._run(*r) for r in runs])
        rows = rows if ranges is None else rows.filter(ranges)
        return rows.drop("run_level", "run_last", "run_bits", "run_range")

    def _touched(self, runs: list[tuple[int, int]], touched: DataFrame) -> Column:
        """The folders that the keys of ``touched`` fall into. What reaches the driver is at most one number per folder."""
        found = self._spark.read.option("basePath", self._path).parquet(*[self._run(*r) for r in runs]).select("run_bits").distinct()
        cond = F.lit(False)
        hashes = touched.select(_hash(self._keys).alias("h"))
        for bits in sorted(r["run_bits"] for r in found.collect()):
            if bits == 0:
                cond = cond | (F.col("run_bits") == 0)
            else:
                numbers = [r["r"] for r in hashes.select(F.shiftright("h", MOST_BITS - bits).alias("r")).distinct().collect()]
                cond = cond | ((F.col("run_bits") == bits) & F.col("run_range").isin(numbers))
        return cond

    def before(self, batch_id: int, touched: DataFrame | None = None) -> DataFrame | None:
        """The rows of earlier batches, merged; with ``touched`` only those that may share a key with it."""
        runs = self.live(batch_id)
        if not runs:
            return None
        return self._merge(self._read(runs, None if touched is None else self._touched(runs, touched)))

    def files(self, batch_id: int, touched: DataFrame) -> int:
        """How many files ``before`` opens."""
        runs = self.live(batch_id)
        if not runs:
            return 0
        rows = self._spark.read.option("basePath", self._path).parquet(*[self._run(*r) for r in runs])
        return rows.filter(self._touched(runs, touched)).select(F.input_file_name().alias("f")).distinct().count()

    def _put(self, rows: DataFrame, level: int, last: int) -> None:
        rows = cut(rows)
        bits = min(MOST_BITS, max(0, (max(1, rows.count()) - 1) // self._range_rows).bit_length())
        if not bits:
            # One file, also of no rows, so that a run can always be read.
            rows.coalesce(1).write.mode("overwrite").parquet(f"{self._run(level, last)}/run_bits=0/run_range=0")
            return
        dealt = rows.withColumn("run_bits", F.lit(bits)).withColumn("run_range", F.shiftright(_hash(self._keys), MOST_BITS - bits).cast("int"))
        dealt.repartition(1 << bits, "run_range").write.mode("overwrite").partitionBy("run_bits", "run_range").parquet(self._run(level, last))

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """The run of a batch, and the merges that it completes."""
        self._put(rows, 0, batch_id)
        level, count = 0, batch_id + 1
        while count % self._fan == 0:
            width = self._fan**level
            parts = [(level, batch_id - i * width) for i in range(self._fan)]
            self._put(self._merge(self._read(parts[::-1])), level + 1, batch_id)
            level, count = level + 1, count // self._fan
        self._forget(batch_id - 1)

    def _forget(self, batch_id: int) -> None:
        """Delete the runs that the merges of ``batch_id`` replaced."""
        gone, level, count = [], 0, batch_id + 1
        while batch_id >= 0 and count % self._fan == 0:
            gone += [(level, batch_id - i * self._fan**level) for i in range(self._fan)]
            level, count = level + 1, count // self._fan
        jvm, conf = self._spark._jvm, self._spark._jsc.hadoopConfiguration()
        for run in gone:
            path = jvm.org.apache.hadoop.fs.Path(self._run(*run))
            path.getFileSystem(conf).delete(path, True)

    def after(self, batches: int) -> DataFrame | None:
        """The merged rows of the first ``batches`` batches."""
        return self.before(batches)


def newest(keys: str | list[str], order: str) -> Merge:
    """One row per key, the last by ``order``."""
    by = [keys] if isinstance(keys, str) else list(keys)
    return lambda rows: rows.groupBy(*by).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def still_open(rows: DataFrame, keys: list[str], gone: str = "gone") -> DataFrame:
    """Rows and their removals cancel out; a removal whose row lies in an older run stays."""
    here, removed = rows.filter(~F.col(gone)), rows.filter(F.col(gone))
    left = here.join(removed.select(*keys).distinct(), keys, "left_anti")
    return left.unionByName(removed.join(here.select(*keys).distinct(), keys, "left_anti"))
