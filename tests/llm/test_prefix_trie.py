"""The prefix trie against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tracelore.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = tuple(own.get(c - c % 5, [])[:h] + said[h:])
    members, last = {}, {}
    for c, path in made.items():
        last.setdefault(path, []).append(c)
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    kids, leaves, saved = {}, {}, {}
    for p in members:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in kids)
            saved[p[:d]] = saved.get(p[:d], 0) + ((len(m) - 1) * len(p[-1][1].encode()) if p else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p], sha(last.get(p, []))) for p, m in members.items())


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def made(seed, convs, most, words):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(convs * 2), convs):
        for t in range(rng.randrange(1, most)):
            rows.append((c, t if rng.random() < 0.95 else rng.choice([None, 1]), rng.choice(["user", "assistant", None]) if t > 2 else "user", rng.choice(words)))
    return rows


@pytest.mark.parametrize("seed,convs,most,words", [(1, 120, 8, ["a", "b", "", None]), (2, 40, 30, ["x"]), (3, 200, 3, ["é", "bb"])])
def test_trie_matches_brute_force(spark, monkeypatch, seed, convs, most, words):
    rows = made(seed, convs, most, words)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = brute(rows)
    if seed == 2:
        monkeypatch.setattr(prefix_trie, "BAND", 3)
        monkeypatch.setattr(prefix_trie, "STRETCH", 2)
    assert got(prefix_trie.trie(df)) == want


def test_long_and_common_conversations(spark):
    rows = [(7, t, "user", f"t{t % 5}") for t in range(900)] + [(c, t, "user", "same") for c in range(100, 400) for t in range(3)]
    rows += [(None, 1, "user", "x"), (1000, None, None, None), (1000, None, None, None), (503, 1, "a", "b"), (-3, 1, "a", "b"), (-3, 1, "a", "b")]
    extra = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", a string, band long")
    assert got(prefix_trie.trie(extra)) == brute(rows)
    assert got(prefix_trie.trie(spark.createDataFrame([], SCHEMA))) == []


def test_conversations_without_turns(spark):
    # 503's family head is missing, so its first turns are replaced by none.
    rows = [(c, 1, "u", "t") for c in (503, 508, 1) if zlib.crc32(str(c).encode()) % 9 > 0]
    assert rows and got(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert brute(rows)[0][4:6] == (0, 1)


def test_list_hash_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    ids = list(range(-20, 300))
    df = spark.createDataFrame([(1, 2, i) for i in ids] + [(1, 3, 5)], "a long, b long, conv_id long")
    want = {(1, 2): hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), (1, 3): hashlib.sha256(b"5").hexdigest()}
    assert {(r["a"], r["b"]): r["ends_sha256"] for r in prefix_trie.ends(df).collect()} == want


def test_slots_are_minimal_and_told_apart():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 50, 20000).astype(np.uint64), rng.integers(0, 2**63, 20000).astype(np.uint64) % np.uint64(40)
    slot, n = prefix_trie.slots(a, b)
    pairs = {}
    for key, s in zip(zip(a.tolist(), b.tolist()), slot.tolist()):
        assert pairs.setdefault(key, s) == s
    assert n == len(pairs) and sorted(pairs.values()) == list(range(n))
    assert prefix_trie.slots(a[:0], b[:0])[1] == 0
