"""User-supplied batch embedders, run where the rows are."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelore import params

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float] | None]]


def embedding_input(*parts: Column) -> Column:
    """The non-blank parts, one per line."""
    return F.concat_ws("\n", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def embed(rows: DataFrame, text: str, fn: Embedder, out: str = "embedding", batch: int = params.EMBED_BATCH) -> DataFrame:
    """``rows`` with a vector column from ``fn``, called on ``batch`` texts at a time. A failing
    batch yields nulls; blank texts are not sent; order and rows are kept."""
    schema = T.StructType([f for f in rows.schema.fields if f.name != out] + [T.StructField(out, T.ArrayType(T.FloatType()))])
    names = [f.name for f in schema.fields if f.name != out]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors: list = [None] * len(frame)
            sent = [i for i, value in enumerate(frame[text]) if isinstance(value, str) and value.strip()]
            for start in range(0, len(sent), batch):
                part = sent[start : start + batch]
                try:
                    found = list(fn([frame[text].iloc[i] for i in part]))
                except Exception:  # noqa: BLE001 - a provider failure leaves nulls
                    found = [None] * len(part)
                for i, vector in zip(part, found):
                    vectors[i] = list(map(float, vector)) if vector is not None else None
            yield frame[names].assign(**{out: pd.Series(vectors, index=frame.index, dtype=object)})

    return rows.mapInPandas(run, schema)


def backfill(rows: DataFrame, fn: Embedder, only_missing: bool = True, rationale: str | None = None) -> DataFrame:
    """(id, embedding) for live rows that lack a vector (or for all of them)."""
    todo = rows.filter(F.col("status").isin(*params.LIVE_STATUSES) & F.col("text").isNotNull())
    if only_missing:
        todo = todo.filter(F.col("embedding").isNull())
    parts = [F.col("text")] + ([F.col(rationale)] if rationale else [])
    return embed(todo.select("id", embedding_input(*parts).alias("__text")), "__text", fn).select("id", "embedding").filter("embedding IS NOT NULL")


def text_key(text: Column) -> Column:
    """What a vector is kept under: the hash of the text it was made from."""
    return F.sha2(text.cast("binary"), 256)


def memory_texts(learnings: DataFrame, observations: DataFrame, patterns: DataFrame, skills: DataFrame) -> DataFrame:
    """(kind, id, text): what each row of memory is embedded by. Facts and task labels by their text, episodes by title and narrative, skills by name,
    description and content."""
    parts = {
        "learning": (learnings, "id", ("text",)), "observation": (observations, "id", ("title", "narrative")),
        "pattern": (patterns, "id", ("text",)), "skill": (skills, "skill_id", ("name", "description", "content")),
    }
    found = None
    for kind, (rows, key, names) in parts.items():
        part = rows.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), embedding_input(*[F.col(n) for n in names]).alias("text"))
        found = part if found is None else found.unionByName(part)
    return found


def fill_store(store: DataFrame | None, texts: DataFrame, fn: Embedder, batch: int = params.EMBED_BATCH) -> DataFrame:
    """The store (text_key, embedding) with a vector for every text of ``texts`` (text) that it lacks: each distinct text goes to the provider once,
    whatever number and kind of rows have it. Blank texts and those without a vector from the provider get no entry, so a later run asks again."""
    wanted = texts.filter(F.trim("text") != "").select(text_key(F.col("text")).alias("text_key"), "text").dropDuplicates(["text_key"])
    if store is not None:
        wanted = wanted.join(store.select("text_key"), "text_key", "left_anti")
    fresh = embed(wanted, "text", fn, batch=batch).filter("embedding IS NOT NULL").select("text_key", "embedding")
    return fresh if store is None else store.select("text_key", "embedding").unionByName(fresh)


def look_up(texts: DataFrame, store: DataFrame) -> DataFrame:
    """``texts`` with the vector of their text, null where the store has none."""
    return texts.withColumn("text_key", text_key(F.col("text"))).join(store.select("text_key", "embedding"), "text_key", "left").drop("text_key")


def attach(rows: DataFrame, fresh: DataFrame) -> DataFrame:
    """New vectors where there are any, the stored ones otherwise."""
    new = fresh.select("id", F.col("embedding").alias("__new"))
    return rows.join(new, "id", "left").withColumn("embedding", F.coalesce("__new", "embedding")).drop("__new")
