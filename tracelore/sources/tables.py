"""Readers for the warehouse tables, and the snapshot store used for keyed state.

Parquet has no MERGE. State is therefore a chain of immutable snapshots:
a transition is a pure function of the last snapshot, its result is written to a
new folder, and a one-row pointer table is replaced last. A reader never sees a
half-written snapshot and no path is overwritten while it is being read.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelore.session import prepare

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    # Zone-less columns are UTC by contract.
    for field in df.schema.fields:
        if isinstance(field.dataType, T.TimestampNTZType):
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def replace_table(df: DataFrame, path: str, schema: T.StructType) -> DataFrame:
    """Truncate-and-load under a declared schema: unknown columns are dropped,
    missing ones fail, types are cast."""
    shaped = df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    shaped.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def publish_snapshot(df: DataFrame, root: str, run_id: str | None = None) -> str:
    """Write ``df`` as a new snapshot under ``root`` and move the pointer to it."""
    spark = df.sparkSession
    run_id = run_id or f"{int(time.time() * 1000):015d}"
    target = f"{root}/state/run_id={run_id}"
    df.write.mode("errorifexists").parquet(target)
    spark.createDataFrame([(run_id, target)], "run_id string, path string").coalesce(1).write.mode(
        "append"
    ).parquet(f"{root}/pointer")
    return target


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The newest published snapshot."""
    row = spark.read.parquet(f"{root}/pointer").agg(F.max_by("path", "run_id").alias("path")).first()
    return spark.read.parquet(row["path"])


def refresh_partition(df: DataFrame, path: str, partition: str) -> None:
    """Replace only the partitions present in ``df`` (e.g. ``source='seed'`` edges)."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )
