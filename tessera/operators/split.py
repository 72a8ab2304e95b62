"""Sampling, splitting, batching.

Random choices are replaced by md5 order of ``seed:key`` -- deterministic,
partition-independent and reproducible in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indexing import with_global_index


def seeded_hash(key: Column | str, seed: int = 42) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


def class_quotas(counts: DataFrame, label_col: str = "label", count_col: str = "n_label",
                 test_pct: int = 20) -> DataFrame:
    """Per-class train/test sizes of a stratified split.

    Test size = ceil(test_pct% of n). Train places are shared by the largest
    remainder rule (integer arithmetic, ties by label); a class's test quota
    is the rest of its rows.  ``counts`` has one row per class.
    """
    dec = "decimal(38,0)"
    # windows below run over the class table only (one row per class)
    every = Window.partitionBy()
    q = counts.withColumn("_n", F.sum(F.col(count_col).cast(dec)).over(every))
    n = F.col("_n")
    n_test = F.floor((n * test_pct + 99) / 100).cast(dec)  # ceil(p% of n) in integers
    q = q.withColumn("_n_train", (n - n_test).cast(dec))
    prod = F.col(count_col).cast(dec) * F.col("_n_train")  # exact even when it passes 2**63
    q = q.withColumns({
        "_fl": F.floor(prod / n).cast("bigint"),
        "_rem": F.pmod(prod, n),
    })
    need = F.col("_n_train") - F.sum("_fl").over(every)
    order = Window.orderBy(F.col("_rem").desc(), F.col(label_col))
    q = q.withColumn("_rank", F.row_number().over(order))
    return q.select(
        label_col, count_col,
        (F.col("_fl") + F.when(F.col("_rank") <= need, 1).otherwise(0)).alias("train_quota"),
    ).withColumn("test_quota", F.col(count_col) - F.col("train_quota"))


def split_thresholds(df: DataFrame, label_col: str = "label", key_col: str = "doc_id",
                     test_pct: int = 20, seed: int = 42, bucket_hex: int = 4) -> DataFrame:
    """``(label, _th, _tk)``: per class the hash and key of its last train row in md5(seed:key) order.

    Rows are counted by class and the first ``bucket_hex`` hex digits of their hash; the running count tells in which
    bucket a class's quota ends, and only that bucket's rows (about 1/16**bucket_hex of the class) are ranked.
    Reads label and key alone.  A class without train rows has no threshold.
    """
    keyed = df.select(label_col, F.col(key_col).alias("_k"), seeded_hash(key_col, seed).alias("_h")) \
        .withColumn("_b", F.substring("_h", 1, bucket_hex))
    buckets = keyed.groupBy(label_col, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    counts = buckets.groupBy(label_col).agg(F.sum("_cnt").alias("n_label"))
    quotas = class_quotas(counts, label_col, "n_label", test_pct).select(label_col, "train_quota")
    w = Window.partitionBy(label_col).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    need = F.col("train_quota") - F.coalesce(F.sum("_cnt").over(w), F.lit(0))
    edge = buckets.join(F.broadcast(quotas), label_col).withColumn("_need", need) \
        .where("_need > 0 and _need <= _cnt").select(label_col, "_b", "_need")
    ranked = keyed.join(F.broadcast(edge), [label_col, "_b"]) \
        .withColumn("_rn", F.row_number().over(Window.partitionBy(label_col).orderBy("_h", "_k")))
    return ranked.where("_rn = _need").select(label_col, F.col("_h").alias("_th"), F.col("_k").alias("_tk"))


def stratified_split(df: DataFrame, label_col: str = "label", key_col: str = "doc_id",
                     test_pct: int = 20, seed: int = 42, bucket_hex: int = 4,
                     out_col: str = "split") -> DataFrame:
    """Exact stratified train/test split, decided in the scan.

    Within each class the first ``train_quota`` rows in (md5(seed:key), key) order go to train.  What is broadcast has
    one row per class, so no text moves.  Rows that repeat a key go to the same side; a null label is no class and
    its rows go to test.
    """
    edges = split_thresholds(df, label_col, key_col, test_pct, seed, bucket_hex).withColumnRenamed(label_col, "_label")
    j = df.withColumn("_h", seeded_hash(key_col, seed)).join(F.broadcast(edges), F.col(label_col) == F.col("_label"), "left")
    train = (F.col("_h") < F.col("_th")) | ((F.col("_h") == F.col("_th")) & (F.col(key_col) <= F.col("_tk")))
    return j.withColumn(out_col, F.when(train, F.lit("train")).otherwise(F.lit("test"))).drop("_h", "_label", "_th", "_tk")


def sample_n(df: DataFrame, n: int = 100, key_col: str = "doc_id", seed: int = 42) -> DataFrame:
    """Seeded sample of exactly ``n`` rows (top-n by hash, a TakeOrderedAndProject)."""
    return df.orderBy(seeded_hash(key_col, seed), F.col(key_col)).limit(n)


def assign_batches(df: DataFrame, batch_size: int, key_col: str = "doc_id",
                   shuffle: bool = False, seed: int = 42) -> DataFrame:
    """S3: cut rows into batches of ``batch_size`` in key order (or hashed order).

    ``batch_id = row_index div batch_size``; the last batch may be short.
    """
    order = [seeded_hash(key_col, seed), F.col(key_col)] if shuffle else [F.col(key_col)]
    indexed = with_global_index(df, order, name="_row")
    return indexed.withColumns({
        "batch_id": F.floor(F.col("_row") / batch_size).cast("bigint"),
        "pos_in_batch": F.pmod(F.col("_row"), F.lit(batch_size)).cast("int"),
    }).drop("_row")
