"""Lookups of skewed keys in a table that grows with the data.

Word frequencies are Zipfian: a few words make up a third of all positions, and joined on the word they would meet in a
few tasks.  The table's head, a fixed number of rows that holds the frequent keys, is broadcast; rows it answers go
through the join with the rest of the table under a key of their own that matches nothing and spreads evenly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the broadcast head at most.
HEAD_ROWS = 4096
_SPREAD = 1 << 16


def head_tail_lookup(rows: DataFrame, key: str, spread: list[str], head: DataFrame, tail: DataFrame,
                     value: str, out: str | None = None) -> DataFrame:
    """``rows`` with the column ``out``: ``value`` of its ``key`` in ``head`` or else in ``tail``, null if in neither.

    ``head`` has HEAD_ROWS rows at most; both have the columns ``key`` and ``value`` and one row per key.  ``spread``
    names columns of ``rows`` that tell rows apart.
    """
    salt = F.pmod(F.xxhash64(*spread), F.lit(_SPREAD))
    text = dict(tail.dtypes)[key] == "string"
    aside: Column = F.concat(F.lit("\0"), salt.cast("string")) if text else (-1 - salt).cast(dict(tail.dtypes)[key])
    j = rows.join(F.broadcast(head.select(F.col(key).alias("_hk"))), F.col(key) == F.col("_hk"), "left")
    j = j.withColumn("_tail", F.when(F.col("_hk").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(aside)).drop("_hk")
    j = j.join(tail.select(F.col(key).alias("_tk"), F.col(value).alias("_tv")), F.col("_tail") == F.col("_tk"), "left")
    # the head's values come after the shuffle: rows that move carry keys only, however wide the values are
    j = j.join(F.broadcast(head.select(F.col(key).alias("_hk"), F.col(value).alias("_hv"))), F.col(key) == F.col("_hk"), "left")
    return j.withColumn(out or value, F.coalesce("_hv", "_tv")).drop("_hk", "_hv", "_tail", "_tk", "_tv")


def by_id(table: DataFrame, key: str = "token_id") -> tuple[DataFrame, DataFrame]:
    """Head and tail of a vocabulary whose ids are in order of frequency."""
    return table.where(F.col(key) < HEAD_ROWS), table.where(F.col(key) >= HEAD_ROWS)
