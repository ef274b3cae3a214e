"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelore.session import prepare, work_dir

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once: bound as a lambda variable it is not
    copied into the lambdas that use it, as a plain expression would be."""
    return F.transform(F.array(value), body)[0]


def whole(text: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def n_words(text: str | Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def words(text: str | Column) -> Column:
    return F.filter(F.split(whole(text), SPACE), lambda w: w != "")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def publish(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared checkpoint folder and read back: later jobs start from files that
    outlive any executor, and the planner knows the size, so a join broadcasts such a
    table only when its files are below the session's threshold."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows, and bytes, of whole texts that go to a Python worker at a time.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def in_text_batches(df: DataFrame) -> DataFrame:
    """``df``, with its session's batches for Python workers no larger than texts allow: a worker holds a batch a few times over."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = conf.get(key, None)
        if now is None or not str(now).isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df


def hash_share(*keys: str | Column, seed: int = 0) -> Column:
    """A number in (0, 1) that depends on the keys and the seed alone: the first 52 bits of an MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which nulls match; columns of ``left`` and the other columns of ``right``."""
    other = right.select(*[F.col(c).alias(f"__right_{c}" if c in keys else c) for c in right.columns])
    cond = F.lit(True)
    for key in keys:
        cond = cond & F.col(key).eqNullSafe(F.col(f"__right_{key}"))
    return left.join(other, cond, how).drop(*[f"__right_{k}" for k in keys])
