"""Collocations against brute force."""

import random
import re
from collections import Counter

import pytest

from edges import SCHEMA, odd
from tracelore.llm import phrases

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, min_count, top):
    f = {}
    for lang, text in rows:
        of = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            of.update(tuple(w[i:i + m]) for m in (1, 2, 3, 4) for i in range(len(w) - m + 1))
    out = []
    for lang, of in f.items():
        cand = {p: a for p, a in of.items() if len(p) > 1 and a >= min_count}
        gone = {p[i:i + k] for p, a in cand.items() for k in range(2, len(p)) for i in range(len(p) - k + 1)
                if cand.get(p[i:i + k]) and 100 * a >= 80 * cand[p[i:i + k]]}
        n = sum(a for p, a in of.items() if len(p) == 1)
        ranked = []
        for p, a in cand.items():
            if p not in gone:
                score, _, left, right = min((2_000_000 * a // (of[p[:k]] + of[p[k:]]), k, of[p[:k]], of[p[k:]]) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


def made(seed):
    rng = random.Random(seed)
    shared = " ".join(rng.choice("abcdefgh") for _ in range(200))
    rows = []
    for i in range(60):
        text = "".join(rng.choice(["A", "b", "c", "dé", "é\x85", "x.", "y,", "z\n", "\t"]) + rng.choice([" ", " ", "  ", "\t"]) for _ in range(rng.randrange(0, 120)))
        rows.append((rng.choice(["en", "de", None, "und"]), text + (shared if i % 3 == 0 else "")))
    return rows


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_collocations_match_brute_force(spark, seed):
    rows = made(seed)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    want = brute(rows, 3, 40)
    assert want and got(phrases.collocations(docs, 3, 40)) == want


def test_odd_documents(spark):
    docs = odd(spark, extra=True)
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    assert got(phrases.collocations(docs, 5, 100)) == brute(rows, 5, 100)
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_parse_owns_every_phrase_once():
    """The own parts of the chunks, put together, are the text; repeated passages give the same chunks."""
    rng = random.Random(5)
    passage = " ".join(f"w{rng.randrange(50)}" for _ in range(2000))
    for text in (passage, "x " * 500, "one", "one two", ". . .", passage + ". " + passage):
        chunks = [c.split(b" ") for c in phrases.parse(text.encode())]
        assert [t for c in chunks for t in c[:-phrases.OVERLAP]] == phrases.tokens(text.encode())
    alone, behind = set(phrases.parse(passage.encode())), set(phrases.parse(("other words before " + passage).encode()))
    assert len(alone - behind) <= 1 and len(alone) > 40


def test_counts_beyond_64_bits(spark):
    rows = [("en", "a b", 2, 6_000_000_000_000_000_000), ("en", "a b c", 3, 5_000_000_000_000_000_000)]
    found = spark.createDataFrame(rows, "lang string, phrase string, size int, a long")
    assert [r["phrase"] for r in phrases.uncovered(found).collect()] == ["a b c"]
    counts = spark.createDataFrame([("en", p, 9_000_000_000_000_000_000) for p in ("a", "b", "c", "b c")] + [("en", "a b", 6 * 10**18)], "lang string, phrase string, a long")
    assert {r["phrase"]: r["score"] for r in phrases.scored(found, counts).collect()} == {"a b": 666_666, "a b c": 555_555}
