"""SimHash near-duplicates by BK-trees.

A fingerprint is the bitwise majority of the 64-bit hashes of a text's three-word shingles. Two fingerprints that differ in
at most three of 64 bits agree in two of five blocks of bits, so each goes to ten shards, one per pair of blocks. A
shard's fingerprints form a BK-tree: the children of a node are keyed by their Hamming distance to it, and a search with
radius r follows only edges within r of the query's distance. A shard larger than ``SHARD_ROWS`` is cut into chunks, and each
pair of chunks has a task: the tree of one is sent to the queries of the other. Fingerprints are distinct before they
are dealt, and a shard returns a chain of links per group found, so large groups of copies cost one row, and large groups
of near copies a row per member and shard.

Null and empty texts have fingerprint zero, and link like any other; texts of one or two words are one shingle; rows that repeat
a doc_id or a text share a component; a null doc_id is no smallest id unless the group has no other; an empty table
gives an empty result; other columns are ignored by ``near_duplicates`` and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelore.llm.base import fresh, in_text_batches, join_on, publish, whole
from tracelore.llm.components import Groups, components

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Bits of the blocks; radius + 2 blocks, so any two fingerprints within the radius agree in two of them.
BLOCKS = (13, 13, 13, 13, 12)
SHARD_ROWS = 1024
BITS = np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    n = len(words) - SHINGLE + 1
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[SHINGLE - 1:].tolist(), strict=True)), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 8192):
        ones += np.unpackbits(hashes[at: at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((1 << BITS[2 * ones > n]).sum(dtype=np.uint64)) if (2 * ones > n).any() else 0


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    """Fingerprints as signed longs."""
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


class BKTree:
    """Distinct fingerprints by Hamming distance."""

    def __init__(self, values: list[int]):
        self.root = values[0] if values else None
        self.children: dict[int, dict[int, int]] = {v: {} for v in values}
        for v in values[1:]:
            node = self.root
            while node != v:
                d = (node ^ v).bit_count()
                node = self.children[node].setdefault(d, v)

    def near(self, query: int, radius: int) -> list[int]:
        found, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            d = (node ^ query).bit_count()
            if d <= radius:
                found.append(node)
            edges = self.children[node]
            if edges:
                stack.extend(child for k, child in edges.items() if d - radius <= k <= d + radius)
        return found


def _shard_links(radius: int):
    """Rows (shard, tree chunk, query chunk, fp, in_tree), sorted by the first three; the rows of a shard may span batches."""

    def search(rows: list[tuple[int, bool]]) -> list[tuple[int, int]]:
        tree = BKTree([v for v, inside in rows if inside])
        queries = [v for v, inside in rows if not inside] or list(tree.children)
        groups = Groups()
        for q in queries:
            for other in tree.near(q, radius):
                if other != q:
                    groups.join(q, other)
        return groups.chains()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, key = [], None
        for pdf in batches:
            links = []
            for *k, fp, inside in zip(pdf["shard"], pdf["i"], pdf["j"], pdf["fp"].to_numpy().view(np.uint64).tolist(), pdf["in_tree"], strict=True):
                if k != key:
                    if len(held) > 1:
                        links += search(held)
                    held, key = [], k
                held.append((fp, inside))
            yield _signed(links)
        if len(held) > 1:
            yield _signed(search(held))

    return run


def _signed(links: list[tuple[int, int]]) -> pd.DataFrame:
    pairs = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def link_chains(distinct: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``fp``) whose components are those of all links within ``radius``."""
    fp = F.col("fp")
    at, blocks = 0, []
    for width in BLOCKS:
        blocks.append(F.shiftrightunsigned(fp, at).bitwiseAND((1 << width) - 1))
        at += width
    keys = [F.lit(n) + 16 * (F.shiftleft(blocks[i], 13) + blocks[j]) for n, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))]
    dealt = publish(distinct.select("fp", F.explode(F.array(*keys)).alias("shard")), "shards")
    sizes = dealt.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = publish(sizes.select("shard", F.ceil(F.col("n") / shard_rows).cast("int").alias("k")), "shard-sizes")
    chunk = F.pmod(F.xxhash64("fp", "shard"), F.col("k")).cast("int")
    members = dealt.join(sizes, "shard").withColumn("c", chunk)
    single = members.filter("k = 1").select("shard", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp", F.lit(True).alias("in_tree"))
    cut = members.filter("k > 1")
    as_tree = cut.select("shard", F.col("c").alias("i"), F.explode(F.sequence("c", F.col("k") - 1)).alias("j"), "fp", F.lit(True).alias("in_tree"))
    as_query = cut.select("shard", F.explode(F.sequence(F.lit(0), F.col("c"))).alias("i"), F.col("c").alias("j"), "fp", F.lit(False).alias("in_tree")).filter("i < j")
    rows = single.unionByName(as_tree).unionByName(as_query)
    return rows.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j").mapInPandas(_shard_links(radius), "a long, b long").distinct()


def fingerprint_roots(printed: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root): the smallest fingerprint that each one reaches."""
    distinct = publish(printed.select("fp").distinct(), "fingerprints")
    roots = components(link_chains(distinct, radius)).withColumnRenamed("node", "fp")
    return publish(distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "fingerprint-roots")


def fingerprint_groups(printed: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component_id) of a table (doc_id, fp): the smallest doc_id over all linked fingerprints."""
    named = printed.groupBy("fp").agg(F.min("doc_id").alias("first")).join(fingerprint_roots(printed, radius), "fp")
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return publish(named.join(smallest, "root").select("fp", "component_id"), "fingerprint-groups")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id of every row."""
    printed = publish(in_text_batches(docs).select("doc_id", fingerprints("text").alias("fp")), "printed")
    return printed.join(fingerprint_groups(printed), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group, columns unchanged: the row with the smallest doc_id (null last), and of equal ids the smallest
    hash of the text; of rows equal in both, any one."""
    digest, copies = fresh(docs, "__digest"), fresh(docs, "__copies")
    printed = publish(in_text_batches(docs).select("doc_id", F.xxhash64(whole("text")).alias("digest"), fingerprints("text").alias("fp")).groupBy("doc_id", "digest", "fp").agg(F.count("*").alias("n")), "printed")
    named = printed.join(fingerprint_roots(printed), "fp")
    kept = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "n")).alias("k"))
    kept = publish(kept.select(F.col("k.doc_id").alias("doc_id"), F.col("k.digest").alias(digest), F.col("k.n").alias(copies)), "kept-rows")
    rows = join_on(docs.withColumn(digest, F.xxhash64(whole("text"))), kept, ["doc_id", digest])
    single = rows.filter(F.col(copies) == 1).select(*docs.columns)
    repeated = rows.filter(F.col(copies) > 1).groupBy("doc_id", digest).agg(F.first(F.struct(*[F.col(c) for c in docs.columns])).alias("row")).select("row.*")
    return single.unionByName(repeated)
