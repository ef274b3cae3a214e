"""Session settings and lineage cutting."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tracelore", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs expect; cluster settings win where given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Timestamps are UTC everywhere; the checkpoint folder comes from the cluster."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="tracelore-ckpt-")
        context.setCheckpointDir(folder)
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Materialise to the reliable checkpoint folder: iterations restart from
    files that outlive any executor, and the plan stays one round long."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, for job output and stream state."""
    prepare(spark)
    base = spark.sparkContext.getCheckpointDir()
    token = os.urandom(6).hex()
    return f"{base}/{name}-{token}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back. Unlike a checkpoint the rows are columnar and compressed, later jobs read
    only the columns they use, and the planner knows the size."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is sorted and merged, not sent through the driver. For tables that grow with the input but whose files are small for
    their rows (words, ids): the planner takes the size of the files, the driver holds the rows."""
    return df.hint("merge")


def bucketed(df: DataFrame, keys: list[str], name: str, buckets: int | None = None) -> DataFrame:
    """Like ``stored``, but in buckets of ``keys`` (the session's number of shuffle partitions by default), so that joins on the keys don't shuffle it."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(count, *keys).write.bucketBy(count, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    return spark.table(table)
