"""Toxicity by a weighted finite-state pattern grammar.

Insult stems (word beginnings) are learned from a bounded sample of labelled rows and joined with a small fixed list; threats,
targets, negations and reported speech are fixed word lists. The tokens of a clause that holds a hit become
symbols, and composed transducers rewrite them: negation (``not ... insult``), reported speech (``said ... insult``), target
(``you ... insult`` and ``insult ... you``, ``kill ... you``). The score is a logistic function of the weights that
matched clauses carry by output symbol; the weights are fitted on the same sample.

Null texts are empty; empty texts and texts without a hit get the score of no match (below 0.5 unless most labelled texts without a match are
toxic); very long texts are read whole, clause by clause, once; repeated rows are scored alike; without labelled rows of both classes the fixed list and fixed weights
serve; an empty table gives an empty result; other columns are kept by ``with_scores``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelore.llm.base import fresh, hash_share, in_text_batches, publish

#: Labelled rows that the model is fitted on, at most about so many: the fit costs the same at every size.
FIT_ROWS = 20_000
PREFIXES = range(4, 9)
#: A stem needs so many different surroundings in toxic rows, and no more than that share of it in others.
MIN_PLACES, MOST_OTHER = 8, 0.01
MAX_STEMS = 4000

# Words of the grammar in the four languages.
INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "pathetic", "worthless", "disgusting", "imbecile", "trottel", "abschaum", "widerlich", "crétin", "imbécile", "estúpido", "imbécil")
THREATS = ("kill", "murder", "destroy", "strangle", "töten", "umbringen", "tuer", "matar", "asesinar")
TARGETS = frozenset("you your yours u ya he him she her they them du dich dir dein ihr euch sie tu toi te vous ton ta vos tú ti usted ustedes vosotros".split())
NEGATIONS = frozenset("not no never isn't aren't don't nicht kein keine nie ne pas jamais aucun nunca jamás tampoco".split())
REPORTS = frozenset("said says told wrote quoted quote claimed alleged called sagte sagt schrieb dit disait écrit dijo dice escribió".split())

TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[\"“”„«»]")
STEM_TOKEN = re.compile(r"[^\W\d_]{3,}")
BREAK = re.compile(r"[.!?;:\n]")
OUTPUTS = "IirJjVvK"


class Transducer:
    """A deterministic transducer: ``moves[state, symbol] = (state, output)``; other symbols pass through and lead to ``falls[state]``."""

    def __init__(self, moves: dict[tuple[int, str], tuple[int, str]], falls: dict[int, int]):
        self.moves, self.falls = moves, falls

    def __call__(self, symbols: list[str]) -> list[str]:
        state, out = 0, []
        for s in symbols:
            state, o = self.moves.get((state, s)) or (self.falls.get(state, state), s)
            out.append(o)
        return out


def _within(opener: str, rewrites: dict[str, str], reach: int) -> Transducer:
    """Rewrites symbols that follow ``opener`` within ``reach`` tokens."""
    states = range(reach + 1)
    moves = {(s, opener): (reach, opener) for s in states}
    moves |= {(s, a): (s - 1, b) for s in states if s for a, b in rewrites.items()}
    return Transducer(moves, {s: max(0, s - 1) for s in states})


NEGATE = _within("N", {"I": "i", "V": "v"}, 3)
ADDRESS = _within("T", {"I": "J", "i": "j", "V": "K"}, 4)
REPORT = Transducer({(s, a): (1, b) for s in (0, 1) for a, b in (("R", "R"), ("Q", "Q"))} | {(1, a): (1, "r") for a in "IiJjVvK"}, {})


def compose(symbols: list[str]) -> list[str]:
    """Negation, then targets on either side, then reported speech."""
    return REPORT(ADDRESS(ADDRESS(NEGATE(symbols))[::-1])[::-1])


@dataclass(frozen=True)
class Grammar:
    #: stem -> weight; a stem that ends in "$" is a whole word.
    stems: dict[str, float]
    #: bias, then one weight per symbol of OUTPUTS.
    weights: tuple[float, ...]


#: What a symbol weighs before learning: open insults and threats speak for toxicity, negated and reported ones say nothing by themselves.
PRIOR = {"I": 5.0, "J": 5.0, "V": 5.0, "K": 5.0, "i": 0.0, "j": 0.0, "v": 0.0, "r": 0.0}
DEFAULT = Grammar({w: 1.0 for w in INSULTS}, (-3.0, *[PRIOR[s] for s in OUTPUTS]))


def _automaton(stems: dict[str, float]):
    a = ahocorasick.Automaton()
    for stem, weight in stems.items():
        a.add_word(stem.rstrip("$"), (stem, weight, "I"))
    for word in THREATS:
        if word not in a:
            a.add_word(word, (word, 1.0, "V"))
    a.make_automaton()
    return a


def _hits(low: str, automaton) -> dict[int, tuple[float, str]]:
    """Start of word -> (weight, symbol) of the heaviest stem that begins there."""
    found: dict[int, tuple[float, str]] = {}
    for end, (stem, weight, symbol) in automaton.iter(low):
        start = end + 1 - len(stem.rstrip("$"))
        if start and low[start - 1].isalpha():
            continue
        if (stem[-1] == "$" or symbol == "V") and end + 1 < len(low) and low[end + 1].isalpha():
            continue
        if weight > found.get(start, (0.0, ""))[0]:
            found[start] = (weight, symbol)
    return found


def clause_evidence(text: str, automaton) -> np.ndarray:
    """Weight by output symbol, summed over matched clauses; in a clause each symbol counts once, by its heaviest token."""
    out = np.zeros(len(OUTPUTS))
    low = text.lower()
    hits = _hits(low, automaton)
    at = 0
    for start in sorted(hits):
        if start < at:
            continue
        # The last clause ended at ``at``, so what lies before is not searched again.
        left = max(low.rfind(c, at, start) for c in ".!?;:\n") + 1
        stop = BREAK.search(low, start)
        at = stop.start() if stop else len(low)
        symbols, weights = [], []
        for m in TOKEN.finditer(low, left, at):
            word = m.group()
            weight, symbol = hits.get(m.start(), (0.0, ""))
            symbols.append(symbol or ("Q" if not word[0].isalpha() else "N" if word in NEGATIONS else "T" if word in TARGETS else "R" if word in REPORTS else "o"))
            weights.append(weight)
        best: dict[str, float] = {}
        for s, w in zip(compose(symbols), weights, strict=True):
            if w and s in OUTPUTS:
                best[s] = max(best.get(s, 0.0), w)
        for s, w in best.items():
            out[OUTPUTS.index(s)] += w
    return np.minimum(out, 5.0)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        toxic, other = Counter(), Counter()
        for text, label in zip(pdf["text"], pdf["toxic"], strict=True):
            found = set()
            for w in set(STEM_TOKEN.findall((text or "").lower())):
                found.add(w + "$")
                found.update(w[:n] for n in PREFIXES if len(w) >= n)
            (toxic if label else other).update(found)
        names = list(toxic | other)
        yield pd.DataFrame({"stem": pd.Series(names, dtype="object"), "toxic": [toxic[s] for s in names], "other": [other[s] for s in names]}).astype({"toxic": "int64", "other": "int64"})


def _places(wanted: list[str]):
    """Surroundings (a hash of the words on either side) of the wanted stems, so that copies of a text count once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = frozenset(wanted)
        for pdf in batches:
            rows = set()
            for text, label in zip(pdf["text"], pdf["toxic"], strict=True):
                tokens = STEM_TOKEN.findall((text or "").lower())
                for i, w in enumerate(tokens):
                    for stem in [w + "$", *(w[:n] for n in PREFIXES if len(w) >= n)]:
                        if stem in known:
                            rows.add((stem, " ".join(tokens[max(0, i - 1): i + 2]), int(label)))
            yield pd.DataFrame(list(rows), columns=["stem", "place", "toxic"]).astype({"toxic": "int64"})

    return run


def learn_stems(sample: DataFrame) -> dict[str, float]:
    """Stems whose surroundings are almost all in toxic rows; the shortest that is clean enough stands for longer ones."""
    counted = sample.mapInPandas(_counts, "stem string, toxic long, other long").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    likely = counted.filter((F.col("toxic") >= 5) & (F.col("other") <= 0.05 * F.col("toxic")))
    wanted = [r["stem"] for r in likely.orderBy(F.desc("toxic"), "stem").limit(MAX_STEMS).collect()]
    wanted += [w for w in INSULTS if w not in wanted]
    placed = sample.mapInPandas(_places(wanted), "stem string, place string, toxic int").distinct()
    rows = placed.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("other")).collect()  # at most MAX_STEMS
    seen = {r["stem"]: (int(r["toxic"]), int(r["other"])) for r in rows}
    good = {s: 1.0 - o / (t + o) for s, (t, o) in seen.items() if t >= MIN_PLACES and o <= MOST_OTHER * t}
    good |= {s: 1.0 for s in INSULTS if seen.get(s, (0, 0))[1] <= MOST_OTHER * seen.get(s, (0, 0))[0]}
    kept: dict[str, float] = {}
    for stem in sorted(good, key=lambda s: (len(s.rstrip("$")), s)):
        if not any(stem[:n] in kept for n in range(1, len(stem))):
            kept[stem] = good[stem]
    return kept


def _evidence(stems: dict[str, float]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(stems)
        for pdf in batches:
            x = [clause_evidence(t or "", automaton).tolist() for t in pdf["text"]]
            yield pd.DataFrame({"x": x, "toxic": pdf["toxic"]})

    return run


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Newton steps; a ridge towards the weights of ``PRIOR``, the bias free."""
    x1 = np.hstack([np.ones((len(x), 1)), x])
    w = np.array(DEFAULT.weights)
    prior, strength = w.copy(), np.array([1e-6, *[ridge] * x.shape[1]])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        gradient = x1.T @ (n * (p - y)) + strength * (w - prior)
        hessian = (x1 * (n * p * (1 - p))[:, None]).T @ x1 + np.diag(strength + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        w = w - np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Grammar:
    """A grammar from about ``fit_rows`` labelled rows that are not held out, chosen by a hash of the id."""
    marked = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, fit_rows / max(1, marked.count()))
    chosen = marked.filter(hash_share("doc_id", seed=11) < share)
    sample = publish(in_text_batches(docs).select("doc_id", "text").join(publish(chosen, "toxic-ids"), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic")), "toxic-sample")
    classes = {r["toxic"] for r in sample.select("toxic").distinct().collect()}  # 0 and 1
    if not {0, 1} <= classes:
        return DEFAULT
    stems = learn_stems(sample)
    rows = sample.mapInPandas(_evidence(stems), "x array<double>, toxic int").groupBy("x", "toxic").count().collect()  # at most fit_rows
    x, y, n = np.array([r["x"] for r in rows]), np.array([float(r["toxic"]) for r in rows]), np.array([float(r["count"]) for r in rows])
    return Grammar(stems, tuple(float(v) for v in _logistic(x, y, n)))


def with_scores(docs: DataFrame, grammar: Grammar, name: str = "score") -> DataFrame:
    """Add ``name``: toxicity of the whole text, 0 to 1."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton, w = _automaton(grammar.stems), np.array(grammar.weights)
        for texts in batches:
            x = np.array([clause_evidence(t or "", automaton) for t in texts]).reshape(-1, len(OUTPUTS))
            yield pd.Series(1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30))))

    return in_text_batches(docs).withColumn(name, score("text"))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = with_scores(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows scored below 0.5, columns unchanged."""
    score = fresh(docs, "__score")
    return with_scores(docs, fit(docs, labels), score).filter(F.col(score) < 0.5).select(*docs.columns)
