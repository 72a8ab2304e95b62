"""Projections and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_null_rows(df: DataFrame) -> DataFrame:
    """B1: remove every row that has a null in any column."""
    return df.na.drop(how="any")


def project_xy(df: DataFrame, text_col: str = "text", label_col: str = "label",
               keep_key: str | None = "doc_id") -> tuple[DataFrame, DataFrame]:
    """B2: the (features, target) projections: text with its key, and the label."""
    key = [keep_key] if keep_key else []
    return df.select(*key, text_col), df.select(*key, label_col)


def filter_misclassified(pred: DataFrame) -> DataFrame:
    """Rows with predicted != true; confidence = probability of the predicted class."""
    return (
        pred.where(F.col("pred_idx") != F.col("true_idx"))
        .withColumn("confidence", F.element_at("probabilities", F.col("pred_idx") + 1))
    )


def filter_class_rows(report: DataFrame, label_col: str = "label") -> DataFrame:
    """Keep report rows whose label does not match ``avg|accuracy``."""
    return report.where(~F.col(label_col).rlike("avg|accuracy"))
