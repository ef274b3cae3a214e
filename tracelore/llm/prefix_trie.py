"""The trie of conversation prefixes as tables of nodes in minimal perfect hash slots.

Each turn has two 64-bit hashes of (place, role, text), and their running exclusive or is the digest of a prefix, so a node is a
distinct digest and its parent the digest one turn shorter. Conversations are cut into units of ``BAND`` turns; a
shard is as many units as go to a worker at a time. Inside a shard the distinct digests get slots of a minimal perfect hash:
level by level, keys hash to places, a place that holds one digest only (checked against the stored one) becomes
a slot, the rest go on. Counts are scattered into flat arrays by slot, and sums over subtrees run through the array of parent
slots from the deepest level up.

A node may lie in many shards: its lines are summed by digest. What lies below a unit's end reaches the unit as one carried number
per conversation, since every node has an owner, its smallest member, and the nodes below a node are owned by its members. So
no task holds a subtree, however large or deep, and there are no rounds by depth.

Turns are ordered by (turn, role, text), null turns first; null roles and texts are empty. Rows without conv_id can't be rebuilt and are left
out; repeated rows are turns of their own; an empty table gives no nodes; other columns are ignored. A very long text counts by
its bytes; only its hashes travel on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelore.llm.base import publish
from tracelore.operators.segments import numbered

#: Turns of a unit.
BAND = 64
#: Units whose running totals are one window; more of a conversation are carried across.
STRETCH = 4096
#: A conversation takes the first turns of the first of its family of so many, fewer than ``PREFIX`` of them.
FAMILY, PREFIX = 5, 9
#: conv_ids in one piece of a hashed list.
PIECE = 4096

_LEVELS = 40
_MIX = np.uint64(0x9E3779B97F4A7C15)
_START = np.int64(0x5DEECE66D1CE4E5B)
NOTHING = hashlib.sha256(b"").hexdigest()


def hashed(turns: DataFrame) -> DataFrame:
    """conv_id, rx, ry, size of every turn, and its place in its conversation."""
    said = [F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))]
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), *[c.alias(n) for c, n in zip(said, ("role", "text"), strict=True)])
    keep = ["conv_id", F.xxhash64("role", "text").alias("rx"), F.xxhash64(F.lit("other"), "text", "role").alias("ry"), F.octet_length("text").cast("long").alias("size")]
    return numbered(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()], keep=keep)


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id), and their turns after rebuilding (conv_id, place, rx, ry, size)."""
    convs = rows.groupBy("conv_id").agg(F.count("*").alias("turns"))
    convs = convs.select("conv_id", "turns", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % PREFIX).alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    heads = convs.select(F.col("conv_id").alias("base"), F.least("turns", F.lit(PREFIX)).alias("base_turns"))
    convs = publish(convs.join(heads, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("base_turns", F.lit(0))).alias("given")), "conversations")
    # At most PREFIX turns of a conversation go to its family, so a long one is not multiplied.
    first = rows.filter(F.col("place") < PREFIX).withColumnRenamed("conv_id", "base")
    taken = convs.select("conv_id", "base", "h").join(first, "base").filter("place < h").select("conv_id", "place", "rx", "ry", "size")
    own = rows.join(convs.select("conv_id", "h", "given"), "conv_id").filter("place >= h").select("conv_id", (F.col("place") - F.col("h") + F.col("given")).alias("place"), "rx", "ry", "size")
    return convs.select("conv_id"), taken.unionByName(own)


def _along(rows: DataFrame, values: dict[str, Column], forward: bool) -> DataFrame:
    """conv_id, band and each value of the conversation's bands before (or, backwards, behind) this one taken together."""
    part = F.floor(F.col("band") / STRETCH)
    rows = rows.withColumn("part", part)
    order = (lambda c: F.col(c).asc()) if forward else (lambda c: F.col(c).desc())
    inside = Window.partitionBy("conv_id", "part").orderBy(order("band")).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("conv_id").orderBy(order("part")).rowsBetween(Window.unboundedPreceding, -1)
    xor = forward
    total = F.bit_xor if xor else F.sum
    parts = rows.groupBy("conv_id", "part").agg(*[total(v).alias(n) for n, v in values.items()])
    parts = parts.select("conv_id", "part", *[F.coalesce(total(n).over(across), F.lit(0)).alias(f"far_{n}") for n in values])
    local = rows.select("conv_id", "band", "part", *[F.coalesce(total(v).over(inside), F.lit(0)).alias(f"near_{n}") for n, v in values.items()])
    both = (lambda n: F.col(f"near_{n}").bitwiseXOR(F.col(f"far_{n}"))) if xor else (lambda n: F.col(f"near_{n}") + F.col(f"far_{n}"))
    return local.join(parts, ["conv_id", "part"]).select("conv_id", "band", *[both(n).alias(n) for n in values])


def units(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per conversation and band: the digest before it (px, py), the depth there, and the hashes and sizes of its turns. Every
    conversation has band 0."""
    deep = F.xxhash64("place", "rx", "ry").alias("a"), F.xxhash64("ry", "place", "rx").alias("b")
    rows = turns.select("conv_id", F.floor(F.col("place") / BAND).alias("band"), "place", *deep, "size")
    bands = rows.groupBy("conv_id", "band").agg(
        F.sort_array(F.collect_list(F.struct("place", "a", "b", "size"))).alias("said"), F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb")
    )
    empty = convs.join(turns.select("conv_id").distinct(), "conv_id", "left_anti").select("conv_id", F.lit(0).cast("long").alias("band"))
    bands = publish(bands.unionByName(empty, allowMissingColumns=True), "bands")
    before = _along(bands.select("conv_id", "band", "xa", "xb"), {"px": F.col("xa"), "py": F.col("xb")}, True)
    said = F.coalesce("said", F.array().cast("array<struct<place:long,a:long,b:long,size:long>>"))
    return bands.join(before, ["conv_id", "band"]).select("px", "py", "band", (F.col("band") * BAND).alias("above"), "conv_id", *[said[c].alias(c) for c in ("a", "b", "size")])


def _near(df: DataFrame) -> DataFrame:
    """Units with a common beginning side by side, so that they meet in a shard; equal ones are dealt by conversation."""
    by = ["band", "px", "py", F.coalesce(F.try_element_at("a", F.lit(1)), F.lit(0)), F.coalesce(F.try_element_at("a", F.lit(2)), F.lit(0)), "conv_id"]
    return df.repartitionByRange(*by).sortWithinPartitions(*by)


def slots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int]:
    """(slot of every key, number of slots) of a minimal perfect hash over the distinct pairs (a, b)."""
    found = np.empty(len(a), np.int64)
    rest, used = np.arange(len(a)), 0
    for level in range(_LEVELS):
        if not len(rest):
            return found, used
        x = (a[rest] ^ (b[rest] * np.uint64(2 * level + 1))) * _MIX
        width = 2 * len(rest)
        at = ((x ^ (x >> np.uint64(31))) % np.uint64(width)).astype(np.int64)
        last = np.empty(width, np.int64)
        last[at] = rest
        other = (a[rest] != a[last[at]]) | (b[rest] != b[last[at]])
        shared = np.zeros(width, bool)
        shared[at[other]] = True
        taken = np.zeros(width, bool)
        taken[at] = True
        taken &= ~shared
        number = np.cumsum(taken) - 1 + used
        alone = taken[at]
        found[rest[alone]] = number[at[alone]]
        used += int(taken.sum())
        rest = rest[~alone]
    raise ValueError("digests that no level tells apart")


class Shard:
    """The node table of a batch of units. ``entries`` are the units' starts followed by their turns."""

    def __init__(self, batch: pa.RecordBatch):
        col = lambda n: batch.column(batch.schema.get_field_index(n))
        ints = lambda n: col(n).to_numpy().astype(np.int64)
        lists = col("a")
        self.counts = np.diff(lists.offsets.to_numpy())
        flat = lambda n: col(n).flatten().to_numpy().astype(np.int64)
        units, turns = batch.num_rows, int(self.counts.sum())
        self.conv, self.band = ints("conv_id"), ints("band")
        self.of = np.repeat(np.arange(units), self.counts)
        first = np.cumsum(self.counts) - self.counts
        self.step = np.arange(turns) - np.repeat(first, self.counts)

        def running(turn: np.ndarray, start: np.ndarray) -> np.ndarray:
            acc = np.concatenate([[0], np.bitwise_xor.accumulate(turn)]) if turns else np.zeros(1, np.int64)
            return acc[1:] ^ (acc[first] ^ start)[self.of]

        a, b = running(flat("a"), ints("px")), running(flat("b"), ints("py"))
        self.a, self.b = (np.concatenate([s, t]) for s, t in ((ints("px"), a), (ints("py"), b)))
        # A start below the root is a place of its own: what its unit adds up is not added to the same node of the band above.
        below = np.concatenate([np.where(self.band > 0, _START, 0), np.zeros(turns, np.int64)])
        slot, self.n = slots((self.a ^ below).view(np.uint64), self.b.view(np.uint64))
        self.start, self.turn = slot[:units], slot[units:]
        # The entry before a turn is the turn before it or, for the first, the unit's start.
        before = np.where(self.step == 0, self.of, units + np.arange(turns) - 1)
        above = ints("above")
        self.depth = self.spread(np.concatenate([above, above[self.of] + self.step + 1]), slot)
        self.parent = np.full(self.n, -1, np.int64)
        self.parent[self.turn] = slot[before]
        self.node = np.empty(self.n, np.int64)
        self.node[slot] = np.arange(len(slot))
        self.size = np.zeros(self.n, np.int64)
        self.size[self.turn] = flat("size")

    def spread(self, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n, np.int64)
        out[at] = values
        return out

    def members(self) -> tuple[np.ndarray, np.ndarray]:
        """(members, smallest member) of each slot; a unit's start counts for band 0 only."""
        count, low = np.zeros(self.n, np.int64), np.full(self.n, np.iinfo(np.int64).max)
        top = self.band == 0
        for at, conv in ((self.turn, self.conv[self.of]), (self.start[top], self.conv[top])):
            np.add.at(count, at, 1)
            np.minimum.at(low, at, conv)
        return count, low

    def upwards(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees, level by level from the deepest."""
        order = np.argsort(-self.depth, kind="stable")
        for level in np.split(order, np.flatnonzero(np.diff(self.depth[order])) + 1):
            level = level[self.parent[level] >= 0]
            np.add.at(values, self.parent[level], values[level])
        return values


def _lines(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], list(columns))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        s = Shard(batch)
        count, low = s.members()
        at = np.flatnonzero(count)
        up = np.where(s.parent[at] >= 0, s.parent[at], at)
        pa_, pb_ = s.a[s.node[up]], s.b[s.node[up]]
        yield _lines(a=s.a[s.node[at]], b=s.b[s.node[at]], pa=pa_, pb=pb_, depth=s.depth[at], n=count[at], low=low[at], size=s.size[at])


def _below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        s = Shard(batch)
        sums = []
        owned = batch.column(batch.schema.get_field_index("owned"))
        steps = owned.flatten()
        unit = np.repeat(np.arange(batch.num_rows), np.diff(owned.offsets.to_numpy()))
        first = np.cumsum(s.counts) - s.counts
        end = np.where(s.counts > 0, s.turn[np.minimum(first + s.counts - 1, max(0, len(s.turn) - 1))] if len(s.turn) else s.start, s.start)
        for name in ("leaves", "saved"):
            values = np.zeros(s.n, np.int64)
            if len(steps):
                at = s.turn[first[unit] + steps.field("step").to_numpy().astype(np.int64)]
                np.add.at(values, at, steps.field(name).to_numpy().astype(np.int64))
            np.add.at(values, end, batch.column(batch.schema.get_field_index(f"later_{name}")).to_numpy().astype(np.int64))
            sums.append(s.upwards(values))
        # A start below the root gets its sum with the band above it.
        at = np.flatnonzero((s.parent >= 0) | (s.depth == 0))
        yield _lines(a=s.a[s.node[at]], b=s.b[s.node[at]], leaves=sums[0][at], saved=sums[1][at])


def ends(convs_end: DataFrame) -> DataFrame:
    """a, b, ends_sha256 of (a, b, conv_id): the ids are joined in pieces, ranges of them side by side; one pass per node feeds the
    pieces to the hash. SHA-256 is a chain, so that last pass is one task's for a node, but it holds one piece at a time."""
    by = ["a", "b", "conv_id"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, c = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(a) != 0) | (np.diff(b) != 0)) + 1, [len(a)]]) if len(a) else np.zeros(1, int)
            out = [(a[k], b[k], c[k], ",".join(map(str, c[k : min(k + PIECE, j)].tolist()))) for i, j in zip(cuts, cuts[1:], strict=False) for k in range(i, j, PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string() if i == 3 else pa.int64()) for i in range(4)], ["a", "b", "first", "ids"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for a, b, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if (a, b) == key:
                    state.update(b",")
                else:
                    if key:
                        done.append((*key, state.hexdigest()))
                    key, state = (a, b), hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(("a", "b", "ends_sha256"), r, strict=True)) for r in done])
        if key:
            yield pa.RecordBatch.from_pylist([{"a": key[0], "b": key[1], "ends_sha256": state.hexdigest()}])

    ids = convs_end.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(pieces, "a long, b long, first long, ids string")
    return ids.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(chain, "a long, b long, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    return prefix_nodes(*rebuilt(hashed(turns)))


def prefix_nodes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of the trie over ``convs`` (conv_id) and their ``turns`` (conv_id, place, rx, ry, size)."""
    paths = publish(units(convs, turns), "units")
    told = _near(paths).mapInArrow(_members, "a long, b long, pa long, pb long, depth long, n long, low long, size long")
    nodes = publish(told.groupBy("a", "b").agg(
        F.sum("n").alias("n_convs"), F.min("low").alias("conv_id"), F.first("depth").alias("depth"), F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.first("size").alias("size")
    ), "nodes")
    below = nodes.filter("depth > 0")
    kids = below.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = publish(nodes.join(kids, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")

    # What each conversation owns, at most BAND nodes of a band.
    own = nodes.filter("depth > 0").select(
        "conv_id", F.floor((F.col("depth") - 1) / BAND).alias("band"), F.pmod(F.col("depth") - 1, F.lit(BAND)).alias("step"),
        (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"),
    )
    own = publish(own.groupBy("conv_id", "band").agg(F.collect_list(F.struct("step", "leaves", "saved")).alias("owned"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "owned")
    every = paths.select("conv_id", "band").join(own.drop("owned"), ["conv_id", "band"], "left")
    later = _along(every, {"later_leaves": F.coalesce("leaves", F.lit(0)), "later_saved": F.coalesce("saved", F.lit(0))}, False)
    full = paths.join(later, ["conv_id", "band"]).join(own.select("conv_id", "band", "owned"), ["conv_id", "band"], "left")
    full = full.withColumn("owned", F.coalesce("owned", F.array().cast("array<struct<step:long,leaves:long,saved:long>>")))
    sums = _near(publish(full, "owned-units")).mapInArrow(_below, "a long, b long, leaves long, saved long").groupBy("a", "b").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    xor = lambda c, p: F.bit_xor(F.aggregate(c, F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))).alias(p)
    last = ends(paths.groupBy("conv_id").agg(xor("a", "a"), xor("b", "b")))
    parents = nodes.filter("n_children > 0").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"))
    found = nodes.join(sums, ["a", "b"]).join(last, ["a", "b"], "left").join(parents, ["pa", "pb", "depth"], "left")
    # Of an empty trie the root alone is childless.
    leaves = F.when((F.col("depth") == 0) & (F.col("n_children") == 0), F.lit(1)).otherwise(F.col("n_leaves")).cast("long")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", leaves.alias("n_leaves"), "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
