"""Code lengths against a plain coder, accuracy on held-out documents."""

import math
import random
import zlib

import numpy as np
import pytest

from edges import odd
from tracelore.llm import langid

FOLDER = "/root/testdata/sf0.01"


def trees(sample):
    """{lang: {context: {byte: n}}} of (lang, piece)."""
    out = {}
    for lang, piece in sample:
        for i in range(len(piece)):
            for k in range(min(i, langid.ORDER) + 1):
                of = out.setdefault(lang, {}).setdefault(piece[i - k:i], {})
                of[piece[i]] = of.get(piece[i], 0) + 1
    return out


def bits(tree, text):
    total = 0.0
    for i, byte in enumerate(text):
        for k in range(min(i, langid.ORDER), -2, -1):
            if k < 0:
                total += 8
                break
            seen = tree.get(text[i - k:i])
            if seen is None:
                continue
            t, d = sum(seen.values()), len(seen)
            if byte in seen:
                total -= math.log2(seen[byte] / (t + d))
                break
            total -= math.log2(d / (t + d))
    return total


def test_code_lengths_match_a_plain_coder(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.choice(["aa", "bb", "cc"]), "".join(rng.choice(a) for _ in range(rng.randrange(1, 300)))) for a in ("abc ", "abé d", "xyz\n a") for _ in range(40)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    sample = [(r["lang"], bytes(r["piece"])) for r in langid.pieces(df).collect()]
    assert sum(len(p) for _, p in sample) == sum(len(x) for x in {(lang, t.encode()[i:i + 256]) for lang, t in rows for i in range(0, len(t.encode()), 256)} for x in [x[1]])
    model, want = langid.fit(df), trees(sample)
    texts = [t.encode() for _, t in rows[::7]] + [b"", b"\x00\xff never", "é".encode(), b"a" * 3000, b"q"]
    expected = [[bits(want[lang], t) for lang in model.langs] for t in texts]
    assert np.allclose(model.code_lengths(texts), expected, atol=1e-6)
    monkeypatch.setattr(langid, "BLOCK", 50)
    assert np.allclose(model.code_lengths(texts), expected, atol=1e-6)


def test_learning_is_bounded_and_shared(spark):
    rng = random.Random(4)
    rows = [("big", "".join(rng.choice("abcdefgh") for _ in range(5000))) for _ in range(60)] + [("small", "zyx wvu " * 400)] + [("big", "copy " * 100)] * 50
    sample = langid.pieces(spark.createDataFrame(rows, "lang string, text string"), 64 * 256).collect()
    per = {}
    for r in sample:
        per[r["lang"]] = per.get(r["lang"], 0) + 1
    assert per["big"] == 32 and 1 <= per["small"] <= 32
    assert len({(r["lang"], bytes(r["piece"])) for r in sample}) == len(sample)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    true = {r["doc_id"]: r["lang"] for r in docs.collect()}
    found = langid.languages(docs).collect()
    assert len(found) == len(true)
    test = [r for r in found if r["held_out"] and r["lang_pred"] != "und" and true[r["doc_id"]]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    assert len(test) > 150 and sum(r["lang_pred"] == true[r["doc_id"]] for r in test) / len(test) > 0.97


@pytest.mark.parametrize("extra", [False, True])
def test_odd_documents(spark, extra):
    docs = odd(spark, extra)
    rows = langid.languages(docs).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["lang_pred"] == by[3]["lang_pred"] == by[4]["lang_pred"] == "und" and by[2]["score"] == 0
    assert all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in rows)
    assert by[None]["held_out"] is False
    assert langid.languages(docs.limit(0)).count() == 0
    untaught = langid.languages(docs.selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert {r["lang_pred"] for r in untaught.collect()} == {"und"}
