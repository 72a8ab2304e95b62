"""Helpers shared by the training-data operators: inputs, written intermediates, skew-safe joins, components.

Documents are identified by ``KEY``: the id (null as the smallest long) and a hash of the text.  Rows that repeat
both are one document and get the same result; rows that share an id but not the text stay apart.  A null text
counts as empty unless an operator says otherwise; a null ``doc_id`` is a value like any other and sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import scratch_path

#: A key is hot when it holds more than one row in HOT_SHARE; so at most HOT_SHARE keys can be hot.
HOT_SHARE = 1000
KEY = ["_id", "_h"]
NULL_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def with_key(docs: DataFrame) -> DataFrame:
    """``docs`` and its KEY columns, which are never null and so join by plain equality."""
    return docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), "_h": F.xxhash64("text")})


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB at most: executors and workers hold a few of them at a time, beside the heap."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, and lost executors only reread it."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``max_bytes`` at most, but one row at least."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        step = max(1, min(rows, rows * max_bytes // max(batch.nbytes, 1)))
        for at in range(0, rows, step):
            yield batch.slice(at, step)


def join_counted(left: DataFrame, right: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row per ``key`` and its row count in ``left`` as ``n``.

    Keys with over ``total / HOT_SHARE`` rows go by broadcast: as counts sum up to ``total``, there are at most
    HOT_SHARE of them whatever the input.  The rest is shuffled, where no key holds more than that share.
    ``left`` and ``right`` should be written tables; each is read twice.
    """
    bound = max(total // HOT_SHARE, 1)
    hot, cold = right.where(F.col(n) > bound), right.where(F.col(n) <= bound)
    hot_keys = hot.select(F.col(key).alias("_hot"))
    by_hot = left.join(F.broadcast(hot), key)
    rest = left.join(F.broadcast(hot_keys), left[key] == hot_keys["_hot"], "left_anti")
    return by_hot.unionByName(rest.join(cold, key))


def components(edges: DataFrame, name: str) -> DataFrame:
    """``node, root``: each node of ``edges`` (longs ``u``, ``v``) with the smallest node of its component.

    Alternating large-star and small-star steps until the edges are stable.  Each step is a partial and final
    ``min`` per node and one join with it; hub nodes go through ``join_counted``.
    """
    def stars(e: DataFrame, step: str) -> DataFrame:
        both = e if step == "small" else e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        both = written(both, f"{name}-{step}")
        least = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n")), f"{name}-min")
        total = least.agg(F.sum("n")).first()[0] or 0
        joined = join_counted(both, least, "u", "n", total)
        if step == "large":
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    def digest(e: DataFrame) -> tuple:
        row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    # every edge points from the larger to the smaller node
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                    f"{name}-edges")
    before = digest(edges)
    while before[0]:
        edges = written(stars(written(stars(edges, "large"), f"{name}-large"), "small"), f"{name}-edges")
        after = digest(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
