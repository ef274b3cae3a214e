"""Secret scans with multipart credential linking.

Strong candidates (the base patterns) are always reported. Weak ones, an account name, a bare random key, a service
address, mean little alone. Access identifiers, secrets and endpoints are therefore joined as intervals: a weak candidate
is reported when at most ``SCOPE`` code points lie between it and a complementary part in the same document. The join is
a semi-join by cells of ``SCOPE`` characters, so no pair of parts is ever emitted.

Null and empty texts have no spans; rows that repeat a (doc_id, text) get the same spans; long texts are scanned whole;
an empty table gives an empty result; other columns are ignored by ``secret_spans`` and kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelore.llm.base import fresh, join_on, let, publish, whole

SCOPE = 256
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Digits and letters run on to where they end, so a lower bound on the run is the same as dropping short runs.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LOGIN = r"""(?i:client[_-]?id|access[_-]?key[_-]?id|user(?:name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
#: Kept only with a digit, a capital and a small letter, at any length, with the name that is written against it.
BARE = r"[A-Za-z0-9+/_=-]{32,}"
ENDPOINT = r"""[a-z][a-z0-9+]{1,15}://[A-Za-z0-9._~:@/?#%&=+-]{3,}"""
#: Kinds in report order, and the part each is.
KINDS = ("assign", "access", "hex", "login", "bare", "endpoint")
PART = {"assign": "secret", "access": "identifier", "hex": "secret", "login": "identifier", "bare": "secret", "endpoint": "endpoint"}
#: What completes a weak candidate.
NEEDS = {"login": ("secret",), "endpoint": ("secret",), "bare": ("identifier", "endpoint")}
SPAN = "array<struct<start:int,k:int,end:int>>"


def _spans(text: Column, kind: str, pattern: str, keep: int | None = None) -> Column:
    """All matches as (start, kind, end) in code points: the gaps that a split leaves and the matches alternate. ``keep``: the
    least length of group 2; the others are dropped after they have taken their place."""
    none = F.array().cast(SPAN)
    k = F.lit(KINDS.index(kind))

    def placed(found: Column) -> Column:
        sizes = F.zip_with(F.slice(F.transform(F.split(text, pattern, -1), F.length), F.lit(1), F.size(found)), found, lambda gap, m: F.struct(gap.alias("gap"), F.length(m).alias("n")))
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.aggregate(sizes, start, lambda a, x: F.struct(
            (a["at"] + x["gap"] + x["n"]).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), k.alias("k"), (a["at"] + x["gap"] + x["n"]).alias("end")))).alias("out"),
        ), lambda a: a["out"])

    def long_enough(spans: Column) -> Column:
        if keep is None:
            return spans
        value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        return let(value, lambda v: F.filter(spans, lambda s, i: F.length(F.get(v, i)) >= keep))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(long_enough(placed(found))))


def _has(text: Column, *parts: str) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(text, p))


def _random_looking(text: Column):
    def test(span: Column) -> Column:
        value = F.substring(text, span["start"] + 1, span["end"] - span["start"])
        return value.rlike("[0-9]") & value.rlike("[A-Z]") & value.rlike("[a-z]")

    return test


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, strong, weak): spans of the base patterns and of the weak parts."""
    t = F.col("text")
    none = F.array().cast(SPAN)
    low = F.lower(t)
    strong = F.concat(
        F.when(_has(low, "password", "passwd", "secret", "token", "apikey", "api_key"), _spans(t, "assign", ASSIGN, 6)).otherwise(none),
        F.when(F.contains(t, F.lit("AKIA")), _spans(t, "access", ACCESS)).otherwise(none),
        _spans(t, "hex", HEX),
    )
    weak = F.concat(
        F.when(_has(low, "client", "access", "user", "login"), _spans(t, "login", LOGIN)).otherwise(none),
        F.when(t.rlike(BARE), F.filter(_spans(t, "bare", BARE), _random_looking(t))).otherwise(none),
        F.when(F.contains(t, F.lit("://")), _spans(t, "endpoint", ENDPOINT)).otherwise(none),
    )
    return docs.select("doc_id", whole("text").alias("text")).select("doc_id", F.xxhash64("text").alias("digest"), F.sort_array(strong).alias("strong"), weak.alias("weak"))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, digest, extra): weak candidates with a complementary part within ``scope``."""
    part = F.create_map(*[F.lit(x) for k in KINDS for x in (KINDS.index(k), PART[k])])
    serves = F.create_map(*[x for p in ("secret", "identifier", "endpoint") for x in (F.lit(p), F.array(*[F.lit(KINDS.index(k)) for k, need in NEEDS.items() if p in need]))])
    some = found.filter(F.size("weak") > 0)
    # Two spans no more than the scope apart share a cell when one of them is widened by the scope.
    cells = lambda by: F.explode(F.sequence(F.floor((F.col("s.start") - by) / scope), F.floor((F.col("s.end") + by) / scope))).alias("cell")
    weak = some.select("doc_id", "digest", F.explode("weak").alias("s")).distinct().select("doc_id", "digest", "s", cells(0))
    parts = some.select("doc_id", "digest", F.explode(F.concat("strong", "weak")).alias("s")).distinct()
    partners = parts.select("doc_id", "digest", "s", F.explode(serves[part[F.col("s.k")]]).alias("k")).select(
        "doc_id", "digest", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "k", cells(scope)
    )
    w, p = weak.alias("w"), partners.alias("p")
    near = (
        F.col("w.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("w.digest") == F.col("p.digest")) & (F.col("w.cell") == F.col("p.cell"))
        & (F.col("w.s.k") == F.col("p.k")) & (F.col("p.start") - F.col("w.s.end") <= scope) & (F.col("w.s.start") - F.col("p.end") <= scope)
    )
    return w.join(p, near, "left_semi").groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set("s")).alias("extra"))


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, strong, spans) of every row of (doc_id, text); spans: (start, k, end), k an index into ``KINDS``."""
    found = publish(candidates(docs), "secret-parts")
    none = F.array().cast(SPAN)
    return join_on(found, linked(found), ["doc_id", "digest"], "left").select("doc_id", "digest", "strong", F.sort_array(F.concat("strong", F.coalesce("extra", none))).alias("spans"))


def _digest_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["k"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts per base kind, digest of the base spans, all spans."""
    count = lambda k: F.size(F.filter("strong", lambda s: s["k"] == KINDS.index(k))).cast("long")
    return secret_spans(docs).select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_digest_text(F.col("strong")), 256).alias("base_sha256"), _digest_text(F.col("spans")).alias("spans"),
    )


def mask(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or run of overlapping spans (in start order), replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    folded = F.aggregate(spans, start, lambda a, s: F.struct(
        F.greatest(a["at"], s["end"]).alias("at"),
        F.when((s["start"] >= a["at"]), F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark)))).otherwise(a["out"]).alias("out"),
    ))
    return let(folded, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))


def redact(docs: DataFrame) -> DataFrame:
    """All rows with the secrets in ``text`` masked and ``n_chars`` (where there is one) renewed; rows without secrets are
    unchanged, null texts stay null."""
    digest, spans, own, of = (fresh(docs, c) for c in ("__digest", "__spans", "__id", "__of"))
    hits = secret_spans(docs).filter(F.size("spans") > 0).select("doc_id", "digest", "spans").distinct()
    hits = publish(hits.select(F.col("doc_id").alias(own), F.col("digest").alias(of), F.col("spans").alias(spans)), "secret-spans")
    marked = docs.withColumn(digest, F.xxhash64(whole("text"))).alias("d").join(hits, F.col("d.doc_id").eqNullSafe(F.col(own)) & (F.col(f"d.{digest}") == F.col(of)), "left")
    clean = F.when(F.col(spans).isNotNull(), mask(F.col("d.text"), F.col(spans))).otherwise(F.col("d.text"))
    out = {"text": clean}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col(spans).isNotNull(), F.length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("d.n_chars"))
    return marked.select(*[out[c].alias(c) if c in out else F.col(f"d.`{c}`") for c in docs.columns])
