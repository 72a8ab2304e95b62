"""Parquet table access (A1 on the test tables).

Tables are read with ``spark.read.parquet`` so Catalyst prunes columns and
pushes filters into the scan; callers select only what they use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Session setting: number of partitions that scans of TABLE_KEYS are dealt into by key.  Unset (the default), a scan
#: keeps its splits.  For tables whose files are one row group each, which no split size divides.
SCAN_PARTITIONS = "tessera.scan.partitions"
TABLE_KEYS = {"documents": "doc_id", "embeddings": "vec_id", "events": "event_id", "labels": "doc_id"}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    parts = spark.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(parts), TABLE_KEYS[name]) if parts and name in TABLE_KEYS else df


def labelled_documents(spark: SparkSession, sf_dir: str, label: str = "lang") -> DataFrame:
    """Row-per-document table ``(doc_id, text, label)``; ``label`` names the class column."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", "text", F.col(label).alias("label"))
