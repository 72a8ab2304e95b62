"""Epoch-log analytics (E1-E7): window functions over ``(run, epoch)`` logs.

Windows are partitioned by ``run``; a run's epoch log is bounded by its
epoch count, so each window partition is small and runs spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def epoch_weighted_means(batches: DataFrame, by: tuple[str, ...] = ("run", "epoch", "phase")) -> DataFrame:
    """Per epoch, loss = sum(batch_loss * n) / sum(n), accuracy = sum(correct) / sum(n)."""
    return batches.groupBy(*by).agg(
        (F.sum(F.col("batch_loss") * F.col("n")) / F.sum("n")).alias("loss"),
        (F.sum("correct") / F.sum("n")).alias("accuracy"),
        F.sum("n").alias("n"),
    )


def epoch_log(means: DataFrame) -> DataFrame:
    """Wide epoch log ``(run, epoch, train_loss, val_loss, train_acc, val_acc)`` from E1 rows."""
    return means.groupBy("run", "epoch").agg(
        F.first(F.when(F.col("phase") == "train", F.col("loss")), ignorenulls=True).alias("train_loss"),
        F.first(F.when(F.col("phase") == "val", F.col("loss")), ignorenulls=True).alias("val_loss"),
        F.first(F.when(F.col("phase") == "train", F.col("accuracy")), ignorenulls=True).alias("train_acc"),
        F.first(F.when(F.col("phase") == "val", F.col("accuracy")), ignorenulls=True).alias("val_acc"),
    )


def improvements(log: DataFrame, metric: str = "val_acc", start: float = 0.0) -> DataFrame:
    """Flag epochs whose metric is strictly above the running max of earlier epochs (start 0)."""
    prior = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    best_before = F.coalesce(F.max(metric).over(prior), F.lit(start))
    return log.withColumn("improved", F.col(metric) > F.greatest(best_before, F.lit(start)))


def best_epoch(log: DataFrame, metric: str = "val_acc") -> DataFrame:
    """Checkpoint epochs and the best (= last improving) epoch per run."""
    imp = improvements(log, metric)
    return imp.groupBy("run").agg(
        F.max(F.when(F.col("improved"), F.col("epoch"))).alias("best_epoch"),
        F.max(metric).alias(f"best_{metric}"),
        F.count_if("improved").alias("n_checkpoints"),
    )


def early_stop_epoch(log: DataFrame, patience: int = 3, metric: str = "val_acc") -> DataFrame:
    """First epoch whose count of consecutive non-improving epochs reaches ``patience``.

    ``stop_epoch`` is the epoch training ends at (the last one when patience
    never runs out); ``stopped_early`` tells which case applies.
    """
    imp = improvements(log, metric)
    upto = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    last_imp = F.last(F.when(F.col("improved"), F.col("epoch")), ignorenulls=True).over(upto)
    since = F.when(last_imp.isNull(), F.col("epoch") + 1).otherwise(F.col("epoch") - last_imp)
    early = F.min(F.when(F.col("since_improvement") >= patience, F.col("epoch")))
    return imp.withColumn("since_improvement", since).groupBy("run").agg(
        F.coalesce(early, F.max("epoch")).alias("stop_epoch"),
        early.isNotNull().alias("stopped_early"),
    )


def lr_changes(log: DataFrame, lr_col: str = "lr") -> DataFrame:
    """The logged learning rate per epoch, and whether it differs from the epoch before (a reduction on plateau)."""
    before = F.lag(lr_col).over(Window.partitionBy("run").orderBy("epoch"))
    return log.select("run", "epoch", F.col(lr_col).alias("lr"), F.coalesce(F.col(lr_col) != before, F.lit(False)).alias("changed"))


def compare_runs(logs: list[DataFrame] | DataFrame, metrics: tuple[str, ...] | None = None) -> DataFrame:
    """E5: long curve table ``(run, epoch, metric, value)`` across runs; optional columns allowed."""
    if isinstance(logs, list):
        df = logs[0]
        for other in logs[1:]:
            df = df.unionByName(other, allowMissingColumns=True)
    else:
        df = logs
    metrics = metrics or tuple(c for c in df.columns if c not in ("run", "epoch", "test_type", "run_type"))
    return df.unpivot(["run", "epoch"], list(metrics), "metric", "value").where(F.col("value").isNotNull())


def attention_evolution(traces: DataFrame) -> DataFrame:
    """Weight per token position per epoch of one traced example.

    Token labels come from each run's earliest trace; epochs are shown 1-based.
    """
    first = Window.partitionBy("run").orderBy("epoch")
    labelled = traces.withColumn("_tok0", F.first("tokens").over(first))
    return labelled.select(
        "run", (F.col("epoch") + 1).alias("epoch_display"),
        F.posexplode(F.arrays_zip(F.col("_tok0").alias("token"), F.col("attention_weights").alias("weight")))
        .alias("pos", "z"),
    ).select("run", "epoch_display", "pos", F.col("z.token").alias("token"), F.col("z.weight").alias("weight"))


def sweep_curves(histories: DataFrame) -> DataFrame:
    """Stacked loss curves labelled ``VECTORIZER - layers``."""
    return histories.withColumn("curve", F.concat_ws(" - ", F.upper("vectorizer"), F.col("hidden")))
