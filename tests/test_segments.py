"""Cuts that follow density."""

from pyspark.sql import functions as F

from tracelore.operators.segments import dense_segments, numbered


def _busy(spark):
    """One key with most rows, all in one minute; keys of one row; a null key; repeated rows."""
    base = spark.range(9000).select(
        F.when(F.col("id") < 6000, F.lit("busy")).when(F.col("id") < 6010, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("k"),
        F.when(F.col("id") % 50 == 0, F.lit(None)).otherwise(F.xxhash64("id") % 60).alias("ts"), (F.col("id") % 4500).alias("v"),
    )
    return base.unionByName(base.filter("v < 20"))


def test_numbered_ranks_keys_of_any_size(spark):
    df = _busy(spark)
    rows = numbered(df, ["k"], [F.col("ts").asc_nulls_first(), F.col("v").asc()]).collect()
    assert len(rows) == df.count()
    of = {}
    for r in rows:
        of.setdefault(r["k"], []).append((r["place"], r["ts"] if r["ts"] is not None else -100, r["v"]))
    for found in of.values():
        found.sort()
        assert [x[0] for x in found] == list(range(len(found)))
        assert [x[1:] for x in found] == sorted(x[1:] for x in found)
    narrow = numbered(df, ["k"], [F.col("v").asc()], "at", ["k"])
    assert narrow.columns == ["k", "at"] and narrow.count() == len(rows)


def test_a_busy_key_is_cut(spark):
    df = _busy(spark)
    cut = dense_segments(df, ["k"], [F.col("ts").asc_nulls_first(), F.col("v").asc()], parts=8).cache()
    sizes = cut.groupBy("k", "__segment").count().collect()
    busy = [r["count"] for r in sizes if r["k"] == "busy"]
    assert len(busy) > 1 and max(busy) < 6000
    order = cut.filter("k = 'busy'").groupBy("__segment").agg(F.min(F.struct("ts", "v")).alias("lo"), F.max(F.struct("ts", "v")).alias("hi")).orderBy("__segment").collect()
    assert all(a["hi"] <= b["lo"] for a, b in zip(order, order[1:]) if a["hi"]["ts"] is not None and b["lo"]["ts"] is not None)
