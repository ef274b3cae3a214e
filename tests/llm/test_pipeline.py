"""The pipeline's stages one by one, each against a plain version on its own input."""

import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from edges import odd, words
from test_native import base_secrets
from test_simhash import brute_groups, brute_print
from tracelore.llm import packing
from tracelore.llm.base import publish

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").unionByName(odd(spark).withColumn("doc_id", F.col("doc_id") + 1_000_000))
    seen = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = publish(stage(spark, docs, FOLDER), f"test-{name}")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == seen["documents"].columns
    rows = {name: df.collect() for name, df in seen.items()}

    gone = Counter(map(str, rows["documents"])) - Counter(map(str, rows["toxicity"]))
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    dropped = [r["doc_id"] for r in rows["documents"] if str(r) in gone]
    assert all(labels.get(d, 1) == 1 for d in dropped) and len(rows["toxicity"]) + sum(gone.values()) == len(rows["documents"])

    printed = [(r["doc_id"], brute_print(r["text"])) for r in rows["toxicity"]]
    group = brute_groups(printed)
    kept = [group[brute_print(r["text"])] for r in rows["simhash"]]
    assert sorted(map(str, kept)) == sorted(map(str, {str(group[fp]): group[fp] for _, fp in printed}.values()))
    assert not Counter(map(str, rows["simhash"])) - Counter(map(str, rows["toxicity"]))

    text = {r["doc_id"]: r["text"] for r in rows["secrets"]}
    assert len(text) == len(rows["simhash"])
    for r in rows["simhash"]:
        spans = base_secrets(r["text"] or "")
        if not spans:
            assert text[r["doc_id"]] == r["text"]
        for a, _, b in spans:
            assert r["text"][a:b] not in text[r["doc_id"]]

    size, taken = defaultdict(int), defaultdict(int)
    for r in rows["secrets"]:
        size[r["source"]] += len(words(r["text"]))
    for r in rows["mixing"]:
        taken[r["source"]] += len(words(r["text"]))
    assert abs(sum(taken.values()) - sum(size.values())) < 0.3 * sum(size.values())
    known = set(map(str, rows["secrets"]))
    assert all(str(r) in known for r in rows["mixing"]) and max(Counter(map(str, rows["mixing"])).values()) <= 3

    assert sum(r["n_tokens"] for r in rows["packing"]) == sum(taken.values())
    for (bucket, _), n in Counter((r["bucket_len"], r["batch"]) for r in rows["packing"] if r["n_tokens"]).items():
        assert bucket * n <= packing.BUDGET


def test_run_is_the_stages(spark):
    a = corpus_pipeline.run(spark, FOLDER).collect()
    b = corpus_pipeline.run(spark, FOLDER).collect()
    digest = lambda rows: hashlib.md5("\n".join(sorted(map(str, rows))).encode()).hexdigest()
    assert len(a) > 0 and digest(a) == digest(b)
    assert corpus_pipeline.ORACLE_SQL is None
