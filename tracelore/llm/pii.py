"""Personal data by bootstrapped contextual extraction.

Base kinds are found by their patterns. The label-like words before a find (``phone:``, ``contact number is``) are lexical
patterns, and every identifier-like token after such words is an instance. Patterns and instances form a graph that
Spark scores until nothing changes: a pattern is as reliable as the share of seeds and trusted instances among those that follow
it, an instance as the most reliable of its patterns, and what reaches ``TRUST`` is trusted. Trusted instances that no base kind
covers are reported as kind ``found``.

Null texts are empty; empty texts have no spans; rows that repeat a (doc_id, text) get the same spans; texts are scanned whole, in
linear time for runs of any length; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelore.llm.base import in_text_batches, join_on, publish, whole

KINDS = ("email", "ip", "card", "phone", "found")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match begins where a run of digits begins, so the look-behind changes nothing but the work on long runs.
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Words that tie a label to the value after it, beside ``:``, ``=`` and ``#``.
TIES = frozenset("is no no. nr nr. number num ist lautet est es número".split())
TOKEN = re.compile(r"[^\s\"'<>(),;]{5,}+")
#: A pattern needs so many different trusted instances, and that score makes a pattern or an instance trusted.
SUPPORT, TRUST = 3, 0.8


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """A match ends a run of local characters at an ``@`` that a domain follows; it begins where the run does, after the last match."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                out.append((start, domain.end()))
                last = domain.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base kinds, in report order."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 or not p.lstrip("0") or len(p.lstrip("0")) <= 3 and int(p.lstrip("0")) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


def label_before(text: str, start: int) -> str | None:
    """The lexical pattern before a place: one or two words and the tie, digits as 0; none where the words do not label."""
    left = text[max(0, start - 80): start].rstrip("\"'(< ")
    words = left.lower().split()[-3:]
    if not words:
        return None
    last = words[-1]
    if last[-1] in ":=#":
        name = last.rstrip(":=#") or (words[-2] if len(words) > 1 else "")
        return f"{name}{last[-1]}" if any(c.isalpha() for c in name) else None
    if last in TIES and len(words) > 1:
        return " ".join(words[-2:]) if any(c.isalpha() for c in words[-2]) else None
    return None


def instances(text: str, base: list[tuple[int, int, int]]) -> list[tuple[str, str, int, int, bool]]:
    """(pattern, instance, start, end, seed): labelled base finds and labelled tokens with four digits or more that no find touches."""
    out = []
    for _, a, b in base:
        label = label_before(text, a)
        if label:
            out.append((label, text[a:b].lower(), a, b, True))
    taken = sorted((a, b) for _, a, b in base)
    for m in TOKEN.finditer(text):
        token = m[0]
        # A label may be written against its value.
        cut = max(token.rfind(c, 0, -4) for c in ":=#") + 1
        a, b = m.start() + cut, m.end()
        while b > a and text[b - 1] in ".:!?":
            b -= 1
        value = text[a:b]
        if sum(c.isdigit() for c in value) < 4 or any(x < b and a < y for x, y in taken):
            continue
        label = label_before(text, a)
        if label:
            out.append((label, value.lower(), a, b, False))
    return out


SCAN = T.StructType([
    T.StructField("base", T.ArrayType(T.StructType([T.StructField("k", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    T.StructField("labelled", T.ArrayType(T.StructType([
        T.StructField("pattern", T.StringType()), T.StructField("instance", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("seed", T.BooleanType()),
    ]))),
])


@F.pandas_udf(SCAN)
def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        base = [base_spans(t or "") for t in texts]
        labelled = [instances(t or "", b) for t, b in zip(texts, base, strict=True)]
        yield pd.DataFrame({
            "base": [[{"k": k, "start": a, "end": b} for k, a, b in x] for x in base],
            "labelled": [[{"pattern": p, "instance": i, "start": a, "end": b, "seed": s} for p, i, a, b, s in x] for x in labelled],
        })


def trusted_instances(found: DataFrame) -> DataFrame:
    """(pattern, instance) pairs to report, from rows (pattern, instance, seed). Both sides are counted once per pair, so a
    pattern that copies repeat weighs no more; joins are on patterns and instances, sums are combined before they are dealt.
    Trust only grows, so as many reliable patterns as in the round before are the same ones."""
    edges = publish(found.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pattern-instances")
    state, known = edges.withColumn("trusted", F.col("seed")), 0
    while True:
        patterns = state.groupBy("pattern").agg(F.avg(F.col("trusted").cast("int")).alias("share"), F.count(F.when(F.col("trusted"), 1)).alias("support"))
        reliable = publish(patterns.filter((F.col("support") >= SUPPORT) & (F.col("share") >= TRUST)).select("pattern"), "patterns")
        count = reliable.count()
        if count == known:
            return state.filter(F.col("trusted") & ~F.col("seed")).select("pattern", "instance")
        known = count
        good = edges.join(reliable, "pattern", "left_semi").select("instance").distinct().withColumn("good", F.lit(True))
        state = publish(edges.join(good, "instance", "left").select("pattern", "instance", "seed", (F.col("seed") | F.coalesce("good", F.lit(False))).alias("trusted")), "instances")


def personal_spans(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, base and all spans (k, start, end) of every row of (doc_id, text)."""
    scanned = in_text_batches(docs).select("doc_id", F.xxhash64(whole("text")).alias("digest"), scan("text").alias("s"))
    found = publish(scanned.select("doc_id", "digest", "s.base", "s.labelled"), "pii")
    labelled = found.filter(F.size("labelled") > 0).select("doc_id", "digest", F.inline("labelled"))
    hits = labelled.filter(~F.col("seed")).join(trusted_instances(labelled.select("pattern", "instance", "seed")), ["pattern", "instance"])
    extra = hits.groupBy("doc_id", "digest").agg(F.collect_set(F.struct(F.lit(KINDS.index("found")).alias("k"), "start", "end")).alias("extra"))
    none = F.array().cast("array<struct<k:int,start:int,end:int>>")
    return join_on(found.drop("labelled"), extra, ["doc_id", "digest"], "left").select(
        "doc_id", "digest", "base", F.sort_array(F.concat("base", F.coalesce("extra", none))).alias("spans")
    )


def _text(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["k"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts per base kind, digest of the base spans, all spans."""
    count = lambda k: F.size(F.filter("base", lambda s: s["k"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return personal_spans(docs).select(
        "doc_id", *[count(k) for k in KINDS[:4]], F.sha2(_text(F.sort_array("base")), 256).alias("base_sha256"), _text(F.col("spans")).alias("spans")
    )
