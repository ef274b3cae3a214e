"""Fingerprints and groups against brute force."""

import random

import pytest
import xxhash

from edges import SCHEMA, odd
from tracelore.llm import simhash
from tracelore.llm.components import components

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_print(text):
    w = (text or "").translate(LOWER).split(" ")
    w = [x for part in w for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", part)]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows):
    """rows: (doc_id, fp) -> component of each fp."""
    fps = sorted({fp for _, fp in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= 3:
                a_, b_ = find(a), find(b)
                root[max(a_, b_)] = min(a_, b_)
    low = {}
    for d, fp in rows:
        r = find(fp)
        low[r] = min((x for x in (low.get(r), d) if x is not None), default=None)
    return {f: low[find(f)] for f in fps}


@pytest.mark.parametrize("rows", ["given", "odd"])
def test_near_duplicates(spark, rows):
    docs = odd(spark, extra=True) if rows == "odd" else spark.read.parquet(f"{FOLDER}/documents.parquet")
    printed = [(r["doc_id"], brute_print(r["text"])) for r in docs.collect()]
    group = brute_groups(printed)
    want = sorted((str(d), f"{fp:016x}", str(group[fp])) for d, fp in printed)
    got = sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    root = {}
    for d, fp in printed:
        root.setdefault(group[fp], fp)
    assert kept.count() == len({tuple(sorted(f for f in group if group[f] == g)) for g in group.values()})
    if rows == "given":
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(group.values()))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_large_shards_lose_no_link(spark):
    """A drifting family and random prints; chunks of 16 against brute force."""
    rng = random.Random(5)
    fps, x = set(), rng.getrandbits(64)
    for _ in range(300):
        for _ in range(rng.randint(1, 5)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    base = rng.getrandbits(64)
    fps |= {base ^ (1 << rng.randrange(20)) ^ (1 << rng.randrange(20)) ^ (1 << rng.randrange(20)) for _ in range(300)} | {rng.getrandbits(64) for _ in range(200)}
    rows = [(i, fp) for i, fp in enumerate(sorted(fps))]
    table = spark.createDataFrame([(fp - (1 << 64) if fp >> 63 else fp,) for _, fp in rows], "fp long")
    want = brute_groups(rows)
    for size in (16, 10**6):
        links = simhash.link_chains(table, shard_rows=size)
        roots = {r["node"] % 2**64: r["root"] % 2**64 for r in components(links).collect()}
        groups, expected = {}, {}
        for _, fp in rows:
            groups.setdefault(roots.get(fp, fp), set()).add(fp)
            expected.setdefault(want[fp], set()).add(fp)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_bk_tree_search():
    rng = random.Random(1)
    values = list({rng.getrandbits(12) for _ in range(400)})
    tree = simhash.BKTree(values)
    for q in values[:50] + [rng.getrandbits(12) for _ in range(50)]:
        assert sorted(tree.near(q, 2)) == sorted(v for v in values if (v ^ q).bit_count() <= 2)


def test_repeated_rows_keep_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "en", "s", 1)] * 5 + [(2, "a b c d e", "en", "s", 1), (None, "z y x w v", "en", "s", 1)], SCHEMA)
    assert sorted(str(r["doc_id"]) for r in simhash.drop_near_duplicates(docs).collect()) == ["1", "None"]


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 5000), (5000, 1000), (7, 7), (None, 3), (9999, 9998)] + [(20000, 20000 + i) for i in range(1, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    want = {i: 0 for i in range(201)} | {1000: 1000, 5000: 1000, 9999: 9998, 9998: 9998} | {20000 + i: 20000 for i in range(300)}
    assert got == want
