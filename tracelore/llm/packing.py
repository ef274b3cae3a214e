"""Packing into optimal length buckets.

Documents are cut into sequences of at most ``max_len`` words, so a histogram of all sequence lengths has at
most ``max_len`` rows whatever the corpus. Dynamic programming over that histogram chooses the ``n_buckets`` upper
bounds with the least padding in total. Inside a bucket of bound b, batches of floor(budget / b) sequences are formed
in the order of a hash of (doc_id, sequence).

The place of a sequence in its bucket is found without sorting a bucket in one task: each bucket is cut into shards by
ranges of the hash, rows are numbered inside their shard, and the shards' counts are summed.

Null and empty texts have no words: one row with n_tokens 0 and no bucket or batch. Repeated rows are
sequences of their own; equal hashes are ordered by (doc_id, sequence); an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelore.llm.base import n_words, publish

MAX_LEN = 2048
N_BUCKETS = 8
BUDGET = 16384
SHARD_ROWS = 1024


def optimal_bounds(counts: dict[int, int], n_buckets: int) -> list[int]:
    """Upper bounds, at most ``n_buckets``, with the least sum of (bound - length) x count. Among equal sums the
    smaller split points are kept."""
    lengths = np.array(sorted(counts), dtype=np.int64)
    if not len(lengths):
        return []
    n = np.concatenate([[0], np.cumsum([counts[int(x)] for x in lengths])]).astype(np.float64)
    # A bucket over lengths i..j-1 pads to lengths[j-1]; the words themselves are a constant.
    top = lengths.astype(np.float64)
    best = np.concatenate([[0.0], np.full(len(lengths), np.inf)])
    back = []
    for _ in range(min(n_buckets, len(lengths))):
        nxt, source = np.full(len(best), np.inf), np.zeros(len(best), dtype=np.int64)
        for j in range(1, len(best)):
            cost = best[:j] + top[j - 1] * (n[j] - n[:j])
            source[j] = int(np.argmin(cost))
            nxt[j] = cost[source[j]]
        back.append(source)
        best = nxt
    bounds, j = [], len(lengths)
    for source in reversed(back):
        bounds.append(int(lengths[j - 1]))
        j = int(source[j])
    return sorted(bounds)


def sequences(docs: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """(doc_id, seq, n_tokens): each document's words in pieces of at most ``max_len``."""
    sized = docs.select("doc_id", n_words("text").alias("n"))
    pieces = F.when(F.col("n") > 0, F.sequence(F.lit(0), ((F.col("n") - 1) / max_len).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return sized.select("doc_id", "n", F.explode(pieces).alias("seq")).select(
        "doc_id", "seq", F.least(F.lit(max_len).cast("long"), F.col("n") - F.col("seq") * max_len).alias("n_tokens")
    )


def pack(docs: DataFrame, max_len: int = MAX_LEN, n_buckets: int = N_BUCKETS, budget: int = BUDGET) -> DataFrame:
    """One row per sequence: doc_id, seq, start_word, n_tokens, bucket_len (its padded length), batch (0, 1, ... in the
    bucket) and slot (its place in the batch). No batch exceeds ``budget`` padded words."""
    if budget < max_len:
        raise ValueError("a batch must hold at least one sequence of max_len")
    place = F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("seq").cast("string"))), 1, 15)
    seqs = publish(sequences(docs, max_len).withColumn("place", F.conv(place, 16, 10).cast("long")), "sequences")
    histogram = seqs.filter("n_tokens > 0").groupBy("n_tokens").count().collect()  # at most max_len rows
    bounds = optimal_bounds({int(r["n_tokens"]): int(r["count"]) for r in histogram}, n_buckets)
    per_bucket = {b: sum(int(r["count"]) for r in histogram if low < r["n_tokens"] <= b) for low, b in zip([0, *bounds], bounds, strict=False)}
    bucket = F.lit(None).cast("long")
    shards = F.lit(1)
    for b in reversed(bounds):
        bucket = F.when(F.col("n_tokens") <= b, F.lit(b).cast("long")).otherwise(bucket)
        shards = F.when(F.col("n_tokens") <= b, F.lit(-(-per_bucket[b] // SHARD_ROWS))).otherwise(shards)
    full = seqs.filter("n_tokens > 0").withColumn("bucket_len", bucket).withColumn("__shard", F.floor(F.col("place") / float(2**60) * shards))
    counts = full.groupBy("bucket_len", "__shard").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("bucket_len").orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    carry = counts.select("bucket_len", "__shard", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("bucket_len", "__shard").orderBy("place", "doc_id", "seq")
    numbered = full.withColumn("__at", F.row_number().over(inside) - 1).join(carry, ["bucket_len", "__shard"]).withColumn("__at", F.col("__at") + F.col("__before"))
    size = F.floor(F.lit(budget) / F.col("bucket_len"))
    packed = numbered.select(
        "doc_id", "seq", (F.col("seq") * max_len).alias("start_word"), "n_tokens", "bucket_len",
        F.floor(F.col("__at") / size).alias("batch"), (F.col("__at") % size).alias("slot"),
    )
    none = F.lit(None).cast("long")
    empty = seqs.filter("n_tokens = 0").select("doc_id", "seq", F.lit(0).cast("long").alias("start_word"), "n_tokens", none.alias("bucket_len"), none.alias("batch"), none.alias("slot"))
    return packed.unionByName(empty)
