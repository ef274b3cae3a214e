"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts of 0 to ``ORDER`` bytes with the counts of what followed. A byte costs, in its longest known
context, minus the logarithm of its share there; where it never followed, the escape of that context plus its
cost in the context one byte shorter, and below the empty context 8 bits. Escapes follow method C: with T bytes of D kinds seen, a
byte seen n times has n / (T + D), an escape D / (T + D). A context that a language never saw is passed for free, as in any such
coder. Counts are frozen after learning, so the code length of a text is a sum of table entries, whatever order they are added in,
and the language with the shortest code wins.

Learning reads at most ``FIT_BYTES`` bytes over all languages: texts are cut into pieces of ``PIECE`` bytes, the distinct pieces of
a language are ranked by hash, and each language gives an equal share. So copies and long texts don't count more, and what is collected and
sent to the workers is bounded: at most FIT_BYTES * (ORDER + 1) n-grams, with one number for each of at most ``LANGUAGES`` languages (those with
the most text). Counting is a Spark aggregate, whole texts are scored.

``lang_pred`` is ``und`` for null texts and texts without a letter, and where nothing was learned; ``score`` is then 0. Otherwise it is the
share of the winning language among all when each is as likely before. Null langs teach nothing, null doc_ids count as the empty
text in the hold-out rule, repeated rows are scored each, ties go to the first language by name, other columns are ignored, an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelore.llm.base import in_text_batches, publish

ORDER = 4
FIT_BYTES = 1 << 20
LANGUAGES = 64
PIECE = 256
UNKNOWN = "und"
FOLDS, HELD = 4, 2
#: Bits of a byte that the empty context never saw.
NEW_BYTE = 8.0
#: Bytes scored at a time.
BLOCK = 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


def pieces(labelled: DataFrame, fit_bytes: int = FIT_BYTES) -> DataFrame:
    """lang, piece of the texts to learn from, at most ``fit_bytes`` bytes in all. A first pass measures the languages, so that only
    about twice what is needed is cut out and ranked."""
    said = labelled.filter("lang is not null and text <> ''").select("lang", "text")
    sizes = said.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"))
    sizes = publish(sizes.orderBy(F.desc("bytes"), "lang").limit(LANGUAGES), "languages")
    sizes = sizes.crossJoin(F.broadcast(sizes.agg(F.greatest(F.lit(1), F.floor(F.lit(fit_bytes) / PIECE / F.count("*"))).cast("long").alias("most"))))
    share = F.least(F.lit(1.0), (2 * F.col("most") + 64) * PIECE / F.col("bytes"))
    rows = said.join(sizes.select("lang", share.alias("share")), "lang")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for lang, text, part in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                bar = int(part * 2**64)
                for i in range(0, len(text), PIECE):
                    piece = text[i : i + PIECE]
                    h = xxhash.xxh64_intdigest(piece, 7)
                    if h < bar:
                        found.add((lang, h - 2**63, piece))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found, strict=True) if found else ([], [], []), (pa.string(), pa.int64(), pa.binary()), strict=True)], ["lang", "h", "piece"])

    cutted = in_text_batches(rows).mapInArrow(cut, "lang string, h long, piece binary").distinct()
    ranked = cutted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "piece")))
    return ranked.join(sizes.select("lang", "most"), "lang").filter("rank <= most").select("lang", "piece")


def _keys(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` bytes before and at each place as one number with the length above them; 0 where the text is shorter."""
    n = len(data)
    out = np.full(n, np.uint64(length) << np.uint64(56), np.uint64)
    if length > n:
        return np.zeros(n, np.uint64)
    for i in range(length):
        shift = length - 1 - i
        out[length - 1 :] |= data[i : n - shift].astype(np.uint64) << np.uint64(8 * shift)
    out[np.arange(n) - starts < length - 1] = 0
    return out


def grams(sample: DataFrame) -> DataFrame:
    """lang, gram, n: how often each n-gram of 1 to ORDER + 1 bytes occurs inside the pieces."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for lang, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(piece)
            for lang, held in by.items():
                data, starts, _ = _joined(held)
                keys = np.concatenate([_keys(data, starts, m) for m in range(1, ORDER + 2)])
                found, n = np.unique(keys[keys > 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(found)), pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    return sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes, where the text of each byte starts, number of the text of each byte)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(sizes) - sizes
    return np.frombuffer(b"".join(texts), np.uint8), np.repeat(begin, sizes), np.repeat(np.arange(len(texts)), sizes)


class Index:
    """Row of a key in a table of distinct keys, -1 if it is none: keys are laid out by the top bits of a product."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(len(keys)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        h = (keys * _MIX) >> self.shift
        self.order = np.argsort(h, kind="stable")
        self.keys = keys[self.order]
        self.first = np.searchsorted(h[self.order], np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        h = ((keys * _MIX) >> self.shift).astype(np.int64)
        at, end, rest = self.first[h], self.first[h + 1], np.arange(len(keys))
        while len(rest):
            live = at < end
            at, end, rest = at[live], end[live], rest[live]
            hit = self.keys[at] == keys[rest]
            out[rest[hit]] = self.order[at[hit]]
            at, end, rest = at[~hit] + 1, end[~hit], rest[~hit]
        return out


class Model:
    """The trees of all languages in one table: the cost of each known n-gram's last byte and of each known context's escape, by language."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.langs = langs
        keys = np.unique(gram)
        length = keys >> np.uint64(56)
        body = keys & np.uint64((1 << 56) - 1)
        counts = np.zeros((len(keys), len(langs)))
        counts[np.searchsorted(keys, gram), lang] = n
        # A context is an n-gram without its last byte, the empty one included.
        context = (length - np.uint64(1)) << np.uint64(56) | body >> np.uint64(8)
        known, of = np.unique(context, return_inverse=True)
        total, kinds = np.zeros((len(known), len(langs))), np.zeros((len(known), len(langs)))
        np.add.at(total, of, counts)
        np.add.at(kinds, of, counts > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.escape = np.where(total > 0, np.log2(total + kinds) - np.log2(kinds), 0.0)
            self.cost = np.where(counts > 0, np.log2(total + kinds)[of] - np.log2(counts), 0.0)
        for m in range(1, ORDER + 2):
            rows = np.flatnonzero(length == m)
            if m == 1:
                below = np.full((len(rows), len(langs)), NEW_BYTE)
            else:
                shorter = np.uint64(m - 1) << np.uint64(56) | body[rows] & np.uint64((1 << 8 * (m - 1)) - 1)
                below = self.cost[np.searchsorted(keys, shorter)]
            self.cost[rows] = np.where(counts[rows] > 0, self.cost[rows], self.escape[of[rows]] + below)
        self.grams, self.contexts = Index(keys), Index(known)

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        out = np.zeros((len(texts), len(self.langs)))
        data, starts, of = _joined(texts)
        for lo in range(0, len(data), BLOCK):
            back = min(lo, ORDER)
            hi = min(len(data), lo + BLOCK)
            part, begin, text = data[lo - back : hi], starts[lo - back : hi] - (lo - back), of[lo - back : hi]
            begin = np.maximum(begin, -ORDER)
            base = text[0]
            sums = np.zeros((int(text[-1] - base) + 1, len(self.langs)))
            rest = np.arange(back, len(part))
            for m in range(ORDER + 1, 0, -1):
                keys = _keys(part, begin, m)
                here = rest[keys[rest] > 0]
                row = self.grams.find(keys[here])
                self._add(sums, text[here[row >= 0]] - base, self.cost[row[row >= 0]])
                missed = here[row < 0]
                context = np.uint64(m - 1) << np.uint64(56) | (keys[missed] & np.uint64((1 << 56) - 1)) >> np.uint64(8)
                at = self.contexts.find(context)
                self._add(sums, text[missed[at >= 0]] - base, self.escape[at[at >= 0]])
                rest = np.concatenate([rest[keys[rest] == 0], missed])
            sums += np.bincount(text[rest] - base, minlength=len(sums))[:, None] * NEW_BYTE
            out[base : base + len(sums)] += sums
        return out

    def _add(self, sums: np.ndarray, at: np.ndarray, costs: np.ndarray) -> None:
        for i in range(len(self.langs)):
            sums[:, i] += np.bincount(at, costs[:, i], len(sums))

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the best language, its share) of each text."""
        bits = self.code_lengths(texts)
        best = np.argmin(np.round(bits, 6), axis=1)
        gap = bits - bits[np.arange(len(texts)), best][:, None]
        return best, 1.0 / np.sum(np.exp2(-np.minimum(gap, 1000.0)), axis=1)


def fit(labelled: DataFrame, fit_bytes: int = FIT_BYTES) -> Model | None:
    """The model of the rows (text, lang), None if they teach nothing."""
    counted = publish(grams(pieces(labelled, fit_bytes)), "grams").toArrow()
    if not counted.num_rows:
        return None
    names = counted["lang"].combine_chunks().dictionary_encode()
    langs = sorted(names.dictionary.to_pylist())
    number = np.array([langs.index(x) for x in names.dictionary.to_pylist()])
    return Model(langs, number[names.indices.to_numpy()], counted["gram"].to_numpy().view(np.uint64), counted["n"].to_numpy())


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    model = fit(docs.filter(~held_out()))
    rows = docs.select("doc_id", held_out().alias("held_out"), F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            best, share = known.predict([t or b"" for t in texts])
            names = [known.langs[i] if t is not None else UNKNOWN for i, t in zip(best.tolist(), texts, strict=True)]
            share = np.where([t is not None for t in texts], share, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(share, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return in_text_batches(rows).mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
