"""Phrase collocations by prefix-free parsing.

Every text is cut where the hash of three tokens says so (a content-defined trigger), and each chunk runs on through the three
tokens of the next trigger. So repeated passages give the same chunks wherever they stand, and every phrase of up to four
words lies whole in exactly one chunk that owns its first word: n-grams that start in a chunk's last three tokens belong to the next
one. The distinct chunks with their parse frequencies are the dictionary; n-grams are counted inside distinct chunks, weighted by
frequency, so a passage that fills a third of the corpus is counted once.

Counting goes up from words to phrases of four. A phrase is frequent only if both phrases one word shorter are, so a
level is counted only where a bitmap of the frequent phrases below it has both parts. The bitmap has a fixed size (``BITS``): a false
hit costs work, never a wrong count, as counts are of the phrases themselves.

Texts and langs may be null (empty, ``und``), repeated rows count again, other columns are ignored, an empty table gives an empty
result. A very long text is cut like any other; a text without triggers is one chunk. doc_id is never read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelore.llm.base import in_text_batches, publish

MOST_WORDS = 4
MIN_COUNT = 30
#: A candidate goes if a longer one that holds it has so many hundredths of its count.
COVERED = 80
TOP = 2000
SCALE = 2_000_000
UNKNOWN = "und"

#: Tokens that two neighbouring chunks share, and the trigger's length.
OVERLAP = MOST_WORDS - 1
#: One window in so many starts a chunk.
EVERY = 24
#: Ends a piece. A word can't be this token, since a full stop ends a piece.
STOP = b"."
_STOPS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", STOP * 9)
#: Tokens that a task counts at a time.
BLOCK_TOKENS = 1 << 21
#: Bits of the map of frequent phrases.
BITS = 26

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def tokens(text: bytes) -> list[bytes]:
    """Words with A-Z in lower case; ``STOP`` stands where a piece ends."""
    return text.lower().translate(_STOPS).replace(STOP, b" . ").split()


def parse(text: bytes) -> Iterator[bytes]:
    """The chunks of a text, tokens joined by one space."""
    said = tokens(text)
    n = len(said)
    if not n:
        return
    said += [STOP] * OVERLAP
    h = np.fromiter(map(zlib.crc32, said), np.uint64, len(said))
    window = h[: n - 1] if n > 1 else h[:0]
    for i in range(1, OVERLAP):
        window = window * _MIX[0] + h[i : i + len(window)]
    window = (window * _MIX[1]) >> np.uint64(33)
    cuts = [0, *(np.flatnonzero(window[1:] % np.uint64(EVERY) == 0) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield b" ".join(said[a : b + OVERLAP])


def dictionary(docs: DataFrame) -> DataFrame:
    """lang, chunk, n: the distinct chunks and how often the parse has them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(parse(text))
            for lang, counts in found.items():
                chunks = pa.array(list(counts), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(counts)), chunks, pa.array(list(counts.values()), pa.int64())], ["lang", "chunk", "n"])

    said = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.col("text")).filter("text <> ''")
    return in_text_batches(said).mapInArrow(cut, "lang string, chunk string, n long").groupBy("lang", "chunk").agg(F.sum("n").alias("n"))


def _hashes(values: pa.Array) -> np.ndarray:
    """A 64-bit number for each string."""
    low = np.fromiter((zlib.crc32(v) for v in values.cast(pa.binary()).to_pylist()), np.uint64, len(values))
    high = np.fromiter((zlib.adler32(v) for v in values.cast(pa.binary()).to_pylist()), np.uint64, len(values))
    return (low << np.uint64(32) | high) * _MIX[1]


def _slots(lang: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """The bit of each phrase, from the hashes of its lang and its words."""
    x = lang
    for w in words:
        x = (x ^ w) * _MIX[0]
        x = x ^ (x >> np.uint64(29))
    return (x * _MIX[2]) >> np.uint64(64 - BITS)


def frequent_map(frequent: DataFrame) -> np.ndarray:
    """The bitmap of the phrases: 2^BITS bits, whatever their number."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lang = batch.column(0).dictionary_encode()
            split = pc.split_pattern(batch.column(1), " ")
            word = split.flatten().dictionary_encode()
            of = _hashes(word.dictionary)[word.indices.to_numpy()].reshape(batch.num_rows, -1)
            slots = _slots(_hashes(lang.dictionary)[lang.indices.to_numpy()], list(of.T))
            at, inverse = np.unique(slots >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(at), np.uint64)
            np.bitwise_or.at(bits, inverse, np.uint64(1) << (slots & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(bits.view(np.int64))], ["at", "bits"])

    rows = frequent.select("lang", "phrase").mapInArrow(mark, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    found = np.zeros(1 << (BITS - 6), np.uint64)
    found[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return found


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each distinct key stands first in order, its number for every key, its sum of weights)."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(keys) else np.zeros(0, bool)
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    sums = np.add.reduceat(weights[order], np.flatnonzero(new)) if len(keys) else np.zeros(0, np.int64)
    return order[new], number, sums


def _grams(lang: pa.Array, chunk: pa.Array, n: np.ndarray, length: int, below: np.ndarray | None) -> pa.RecordBatch:
    """lang, phrase, n of the phrases of ``length`` words that start in the own part of the chunks and have both parts in ``below``."""
    split = pc.split_pattern(chunk, " ")
    sizes = pc.list_value_length(split).to_numpy()
    word = split.flatten().dictionary_encode()
    langs = lang.dictionary_encode()
    ids, names = word.indices.to_numpy().astype(np.int64), word.dictionary
    of_lang = np.repeat(langs.indices.to_numpy().astype(np.int64), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(ids))
    open_ = ids != pc.index_in(pa.scalar(STOP.decode()), names).as_py() if STOP.decode() in set(names.to_pylist()) else np.ones(len(ids), bool)
    whole = open_.copy()
    for i in range(1, length):
        whole[:-i] &= open_[i:]
        whole[-i:] = False
    at = np.flatnonzero(whole & (left > OVERLAP))
    if below is not None and len(at):
        word_hash, lang_hash = _hashes(names)[ids], _hashes(langs.dictionary)
        for first in (0, 1):
            slots = _slots(lang_hash[of_lang[at]], [word_hash[at + first + i] for i in range(length - 1)])
            at = at[(below[slots >> np.uint64(6)] >> (slots & np.uint64(63)) & np.uint64(1)).astype(bool)]
    key, total, most = of_lang[at], len(names), len(langs.dictionary)
    weights = np.repeat(n, sizes)[at]
    for i in range(length):
        if most * total >= 1 << 62:
            first, key, _ = _summed(key, weights)
            most = len(first)
        key, most = key * total + ids[at + i], most * total
    first, _, sums = _summed(key, weights)
    starts = at[first]
    parts = [names.take(pa.array(ids[starts + i])) for i in range(length)]
    phrase = pc.binary_join_element_wise(*parts, " ") if length > 1 else parts[0]
    return pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(of_lang[starts])), phrase, pa.array(sums)], ["lang", "phrase", "n"])


def count_phrases(chunks: DataFrame, length: int, below: np.ndarray | None = None) -> DataFrame:
    """lang, phrase, a: occurrences of the phrases of ``length`` words."""
    shared = None if below is None else chunks.sparkSession.sparkContext.broadcast(below)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        known = None if shared is None else shared.value

        def counted() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            return _grams(table["lang"].chunk(0), table["chunk"].chunk(0), table["n"].to_numpy(), length, known)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += pc.sum(pc.count_substring(batch.column(1), " ")).as_py() + batch.num_rows
            if size >= BLOCK_TOKENS:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    return chunks.select("lang", "chunk", "n").mapInArrow(count, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("a"))


def _exact(value: Column | str, times: int) -> Column:
    """``value * times`` beyond 64 bits."""
    return (F.col(value) if isinstance(value, str) else value).cast("decimal(20,0)") * F.lit(times).cast("decimal(10,0)")


def uncovered(found: DataFrame) -> DataFrame:
    """The candidates (lang, phrase, size, a) that no longer one covers."""
    words = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda k: F.transform(
        F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))))
    holding = found.filter("size > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return found.join(holding, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (_exact("longer", 100) < _exact("a", COVERED))).drop("longer")


def scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """With l, r and score of the cut that scores lowest."""
    words = F.split("phrase", " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(
        k.alias("k"), F.array_join(F.slice(words, 1, k), " ").alias("head"), F.array_join(F.slice(words, k + 1, F.col("size")), " ").alias("tail")))
    each = candidates.select("lang", "phrase", "a", F.explode(cuts).alias("cut")).select("lang", "phrase", "a", "cut.*")
    each = each.join(counts.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), ["lang", "head"])
    each = each.join(counts.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r")), ["lang", "tail"])
    # `div` of decimals is exact and drops the rest.
    each = each.withColumn("top", _exact("a", SCALE)).withColumn("score", F.expr("top div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    low = each.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    return low.select("lang", "phrase", "a", "low.l", "low.r", "low.score")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each lang."""
    chunks = publish(dictionary(docs), "chunks")
    words = publish(count_phrases(chunks, 1), "words")
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    levels = [publish(words.filter(F.col("a") >= min_count), "words-often")]
    for length in range(2, MOST_WORDS + 1):
        often = count_phrases(chunks, length, frequent_map(levels[-1])).filter(F.col("a") >= min_count)
        levels.append(publish(often, f"phrases-{length}"))
    counts = levels[0].select("*", F.lit(1).alias("size"))
    for length, level in enumerate(levels[1:], 2):
        counts = counts.unionByName(level.select("*", F.lit(length).alias("size")))
    ranked = scored(uncovered(counts.filter("size > 1")), counts.filter(F.col("size") < MOST_WORDS))
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    first = ranked.withColumn("rank", F.row_number().over(by).cast("long")).filter(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
