"""Corpus profiling (P1-P12): hash aggregates, small windows over aggregates.

Token counting always goes explode -> groupBy, so partial (map-side)
aggregation collapses frequent words before the shuffle; top-k per group is
``row_number() <= k`` which Spark turns into a partial WindowGroupLimit ahead
of the exchange.  No token list is ever collected to the driver.

Token arrays are exploded with ``explode_outer`` plus a null filter: for a
plain ``explode`` Catalyst infers ``size(tokens) > 0`` and pushes it below the
projection, which evaluates the whole tokenizer a second time per document.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import alpha_tokens, token_count, whitespace_tokens


def union_splits(full: DataFrame, split_df: DataFrame, split_col: str = "split",
                 full_name: str = "full") -> DataFrame:
    """The whole collection plus its named splits as one table keyed by ``split``."""
    return full.withColumn(split_col, F.lit(full_name)).unionByName(split_df)


def with_total(counts: DataFrame, by: str, total: str | None) -> DataFrame:
    """Counts per group, and once more under the group name ``total`` for the whole collection.

    Applied to aggregated rows, so the collection is not read again beside its splits.
    """
    return counts if total is None else counts.withColumn(by, F.explode(F.array(F.col(by), F.lit(total))))


def class_distribution(df: DataFrame, label_col: str = "label", by: str = "split", total: str | None = None) -> DataFrame:
    """Rows per label and their percentage of the group total."""
    counts = with_total(df.groupBy(by, label_col).agg(F.count(F.lit(1)).alias("n")), by, total)
    counts = counts.groupBy(by, label_col).agg(F.sum("n").alias("n"))
    tot = F.sum("n").over(Window.partitionBy(by))  # window over the (group, label) table
    return counts.withColumn("pct", 100.0 * F.col("n") / tot)


def table_profile(df: DataFrame) -> DataFrame:
    """Per column: type name, non-null count, total rows (one aggregate pass)."""
    aggs = [F.count(F.col(f"`{c}`")).alias(f"nn_{i}") for i, c in enumerate(df.columns)]
    wide = df.agg(F.count(F.lit(1)).alias("n_rows"), *aggs)
    stack = ", ".join(
        f"{i}, '{f.name}', '{f.dataType.simpleString()}', nn_{i}" for i, f in enumerate(df.schema.fields))
    return wide.selectExpr(
        "n_rows",
        f"stack({len(df.columns)}, {stack}) as (ordinal, column_name, data_type, non_null)",
    )


def table_head(df: DataFrame, order_col: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows in key order."""
    return df.orderBy(order_col).limit(n)


def distinct_labels(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Number of distinct labels and the sorted list of them.

    ``collect_set`` runs after a distinct, so its size is the number of classes.
    """
    labels = df.select(label_col).distinct()
    return labels.agg(
        F.count(label_col).alias("n_labels"),
        F.array_join(F.array_sort(F.collect_list(label_col)), ",").alias("labels"),
    )


def with_token_length(df: DataFrame, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    return df.withColumn(out, token_count(text_col))


def length_counts(df: DataFrame, text_col: str = "text", by: str = "split", total: str | None = None) -> DataFrame:
    """``(by, n_tokens, n)``: rows per group and whitespace-token count; each text is tokenized once."""
    counts = df.groupBy(by, token_count(text_col).alias("n_tokens")).agg(F.count(F.lit(1)).alias("n"))
    return with_total(counts, by, total).groupBy(by, "n_tokens").agg(F.sum("n").alias("n"))


def token_length_stats(df: DataFrame, text_col: str = "text", by: str = "split", total: str | None = None) -> DataFrame:
    """P5: mean and exact median whitespace-token count per group, from the counts of each length.

    The median is the exact percentile (midpoint of the two middle values), weighted by the counts.
    """
    x = length_counts(df, text_col, by, total)
    return x.groupBy(by).agg((F.sum(F.col("n_tokens") * F.col("n")) / F.sum("n")).alias("mean_tokens"),
                             F.percentile("n_tokens", 0.5, F.col("n")).alias("median_tokens"))


def equal_width_histogram(counts: DataFrame, value_col: str, bins: int, by: str, integer: bool = False,
                          weight: str = "n") -> DataFrame:
    """Equal-width bins over [min, max] of each group, last bin closed, empty bins kept.

    ``counts`` has one row per group and value with its number of rows, so a group's window and grid are bounded by
    its distinct values.
    """
    own = Window.partitionBy(by)
    ranged = counts.withColumns({"_mn": F.min(value_col).over(own), "_mx": F.max(value_col).over(own)})
    x, mn, mx = F.col(value_col), F.col("_mn"), F.col("_mx")
    if integer:
        raw = F.floor((x - mn) * bins / (mx - mn))
    else:
        raw = F.floor((x - mn) * (bins / (mx - mn)))
    b = F.when(mx == mn, F.lit(bins // 2)).otherwise(F.least(raw, F.lit(bins - 1))).cast("int")
    lo = F.when(mx == mn, mn - 0.5).otherwise(mn.cast("double"))
    width = F.when(mx == mn, F.lit(1.0)).otherwise((mx - mn).cast("double")) / bins
    # the group's filled bins in one row, then all of its bins
    filled = ranged.groupBy(by, lo.alias("_lo"), width.alias("_w"), b.alias("bin")).agg(F.sum(weight).alias("n")) \
        .groupBy(by, "_lo", "_w").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_n"))
    return filled.select(by, "_lo", "_w", "_n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).select(
        by, "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("bin_lo"),
        (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("bin_hi"),
        F.coalesce(F.try_element_at("_n", F.col("bin")), F.lit(0)).cast("bigint").alias("n"))


def token_length_histogram(df: DataFrame, text_col: str = "text", by: str = "split",
                           bins: int = 50, total: str | None = None) -> DataFrame:
    """50 equal-width bins of whitespace-token counts per group."""
    return equal_width_histogram(length_counts(df, text_col, by, total), "n_tokens", bins, by, integer=True)


def avg_length_per_label(df: DataFrame, text_col: str = "text", label_col: str = "label") -> DataFrame:
    """Mean whitespace-token count per label."""
    return df.groupBy(label_col).agg(F.avg(token_count(text_col)).alias("avg_tokens"))


def word_frequency(df: DataFrame, text_col: str = "text", by: str = "split",
                   stopwords: Iterable[str] | None = None, total: str | None = None) -> DataFrame:
    """Frequency of profile tokens (T9) per group."""
    toks = df.select(by, F.explode_outer(alpha_tokens(text_col, stopwords)).alias("token"))
    counts = toks.where(F.col("token").isNotNull()).groupBy(by, "token").agg(F.count(F.lit(1)).alias("n"))
    return counts if total is None else with_total(counts, by, total).groupBy(by, "token").agg(F.sum("n").alias("n"))


def _whitespace_token_counts(df: DataFrame, text_col: str) -> DataFrame:
    return (df.select(F.explode_outer(whitespace_tokens(text_col)).alias("token"))
            .where(F.col("token").isNotNull()).groupBy("token").agg(F.count(F.lit(1)).alias("n")))


def vocabulary_size(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct case-sensitive whitespace tokens (exact; two-phase distinct)."""
    return _whitespace_token_counts(df, text_col).agg(F.count(F.lit(1)).alias("vocabulary_size"))


def approx_vocabulary_size(df: DataFrame, text_col: str = "text", rsd: float = 0.01) -> DataFrame:
    """P9 (approximate): HyperLogLog++ sketch, constant memory per task."""
    toks = df.select(F.explode_outer(whitespace_tokens(text_col)).alias("token"))
    return toks.agg(F.approx_count_distinct("token", rsd).alias("vocabulary_size"))


def rare_word_share(df: DataFrame, text_col: str = "text") -> DataFrame:
    """P10: tokens seen exactly once: count, distinct total, percentage."""
    counts = _whitespace_token_counts(df, text_col)
    return counts.agg(
        F.count_if(F.col("n") == 1).alias("n_rare"),
        F.count(F.lit(1)).alias("n_distinct"),
    ).withColumn("rare_pct", 100.0 * F.col("n_rare") / F.col("n_distinct"))


def top_tokens_per_class(df: DataFrame, text_col: str = "text", label_col: str = "label",
                         k: int = 10, stopwords: Iterable[str] | None = None) -> DataFrame:
    """The ``k`` most frequent profile tokens per label (ties: token ascending)."""
    counts = (
        df.select(label_col, F.explode_outer(alpha_tokens(text_col, stopwords)).alias("token"))
        .where(F.col("token").isNotNull()).groupBy(label_col, "token").agg(F.count(F.lit(1)).alias("n"))
    )
    w = Window.partitionBy(label_col).orderBy(F.col("n").desc(), F.col("token"))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def duplicate_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows equal (in ``cols``) to an earlier row = sum over groups of (size - 1).

    Rows are grouped by a 256-bit hash of the columns (as JSON, which tells null from empty), so texts stay where they
    are.
    """
    cols = cols or df.columns
    row = F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)
    groups = df.groupBy(F.unhex(row).alias("_row")).agg(F.count(F.lit(1)).alias("_c"))
    return groups.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("bigint").alias("n_duplicates"))
