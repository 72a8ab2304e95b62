"""Consecutive 0-based row numbers in a global order without a one-task window.

``row_number() over (order by k)`` with no partition moves every row into one
task.  Instead: range-partition and sort on the key (a distributed sort),
number rows inside each partition with ``monotonically_increasing_id`` (its low
33 bits are the in-partition ordinal), count rows per partition (a tiny table
with one row per partition), turn the counts into start offsets and add them
back with a broadcast join whose size is bounded by the partition count.

Rows that tie in the order key get different numbers, in an order that is theirs
in the written numbering only; where reruns must agree, the key must be unique.  The numbered rows are materialised with a
reliable checkpoint before they are counted, so the counts and the rows they
offset come from one execution: a second run of the range exchange could
sample different bounds (its input order after a shuffle is not fixed) and
Spark does not guarantee to reuse the first one.  The checkpoint also means an
executor loss re-reads the numbering instead of recomputing it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_LOW33 = (1 << 33) - 1


def with_global_index(df: DataFrame, order: list[Column], name: str = "idx",
                      num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 0-based position of each row in ``order``; ties are numbered in any order, each row once."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_df = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    tagged = sorted_df.withColumn("_mid", F.monotonically_increasing_id()).withColumns({
        "_pid": F.shiftright(F.col("_mid"), 33),
        "_local": F.col("_mid").bitwiseAND(F.lit(_LOW33)),
    })
    tagged = materialize(tagged)
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: a global window here is over at most n rows
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_start"),
    ).fillna(0, ["_start"])
    return (
        tagged.join(F.broadcast(offsets), "_pid")
        .withColumn(name, F.col("_start") + F.col("_local"))
        .drop("_mid", "_pid", "_local", "_start")
    )
