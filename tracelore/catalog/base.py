"""Registry of runnable queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

from tracelore.session import stored
from tracelore.sources.adapters import view, with_clause

T = TypeVar("T")
_SHARED: dict[tuple, object] = {}


class Tables:
    """Lazy access to the base tables and model views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._seen: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return view(self.spark, self.folder, name, self._seen)

    def put(self, name: str, df: DataFrame) -> None:
        """``df`` stands for ``name``, also in the views built on it from now on."""
        self._seen[name] = df

    def keep(self, name: str) -> None:
        """Write the view ``name`` once; it and the views built on it from now on read those files."""
        self._seen[name] = stored(getattr(self, name), name)

    def shared(self, name: str, build: Callable[[], T]) -> T:
        """What ``build`` makes, once per application and folder, whose files must not change meanwhile: an index that several queries read."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _SHARED:
            _SHARED[key] = build()
        return _SHARED[key]


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Tables], DataFrame]
    oracle: str | None
    rows: tuple[str, ...]


REGISTRY: dict[str, Query] = {}


def query(name: str, rows: str = "", uses: str = "", oracle: str | None = None, recursive: bool = False):
    """Register ``run(tables)``. ``uses`` names the views the check needs in its
    WITH clause; ``rows`` lists the inventory ids the query covers."""

    def register(run: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        sql = None
        if oracle is not None:
            prefix = with_clause(tuple(uses.split())) if uses else ""
            body = oracle.strip().rstrip(";")
            keyword = "WITH RECURSIVE" if recursive else "WITH"
            if body.startswith("WITH"):
                body = body[len("WITH"):]
                sql = f"{keyword} {prefix + ', ' if prefix else ''}{body}"
            else:
                sql = f"{keyword} {prefix}\n{body}" if prefix else body
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, run, sql, tuple(rows.split()))
        return run

    return register
