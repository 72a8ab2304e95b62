"""Registry of named queries (one per operator key of the inventory) and their SQL oracles."""

from __future__ import annotations

import functools
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
#: Intermediates of the query that is being built; each call has its own, also in another thread.
_SHARED: ContextVar[dict[tuple, DataFrame] | None] = ContextVar("shared", default=None)


def shared(fn):
    """Mark an intermediate used by several branches of one query.

    Within one query call it is built once and materialised, so later
    branches read the checkpoint instead of re-running the tokenizer,
    split or vocabulary pipeline.
    """

    @functools.wraps(fn)
    def wrapper(spark: SparkSession, sf: str, *args, **kwargs):
        key = (fn.__qualname__, id(spark), sf, args, tuple(sorted(kwargs.items())))
        found = _SHARED.get()
        if found is None:  # not inside a query: nothing to share with
            return fn(spark, sf, *args, **kwargs)
        if key not in found:
            found[key] = materialize(fn(spark, sf, *args, **kwargs))
        return found[key]

    return wrapper


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` (and its oracle SQL)."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            token = _SHARED.set({})
            try:
                return fn(spark, sf)
            finally:
                _SHARED.reset(token)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating-point column so engines agree on the compared digits."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)
