"""Evaluation metrics over a prediction table (M1-M21), grouped by ``run``.

Input layout (prediction record): ``run, row_id, true_idx, true_label,
class_names ARRAY<STRING>, logits ARRAY<DOUBLE>``.  Per-row work is in-row
array math; every class-level metric comes from ONE aggregate
``groupBy(run, true_idx, pred_idx).count()`` whose size is bounded by
runs x classes^2, so nothing downstream of it touches the rows again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..session import materialize

#: Runs whose axes go to the records by one broadcast.
AXES_RUNS = 4096

# --- fixed values: summary metrics and their display names, in report order
SUMMARY_METRICS = (
    ("accuracy", "Accuracy"),
    ("precision", "Precision"),
    ("recall", "Recall"),
    ("f1", "F1"),
    ("top3_accuracy", "Top3_Accuracy"),
)


def with_predictions(scores: DataFrame) -> DataFrame:
    """M1 + M2: probabilities, argmax, predicted label, confidence, correctness."""
    out = scores.withColumns({
        "probabilities": A.softmax("logits"),
        "pred_idx": A.argmax("logits"),
    })
    return out.withColumns({
        "predicted_label": F.element_at("class_names", F.col("pred_idx") + 1),
        "confidence": F.array_max("probabilities"),
        "correct": F.col("pred_idx") == F.col("true_idx"),
    })


def softmax_long(pred: DataFrame) -> DataFrame:
    """M1 in long form: ``(run, row_id, class_idx, prob)``."""
    return pred.select("run", "row_id", F.posexplode("probabilities").alias("class_idx", "prob"))


def accuracy(pred: DataFrame) -> DataFrame:
    """M3: share of correct rows per run."""
    return pred.groupBy("run").agg(F.avg(F.col("correct").cast("double")).alias("accuracy"))


def pair_counts(pred: DataFrame, k: int = 3) -> DataFrame:
    """The single row pass behind M3-M8: per (run, true class, predicted class) the rows ``n``, their top-k hits and
    summed loss, and the class names.  Of runs x classes^2 rows; what follows reads this table alone."""
    nll = A.log_sum_exp("logits") - F.element_at("logits", F.col("true_idx") + 1)
    return pred.groupBy("run", "true_idx", "pred_idx").agg(
        F.count(F.lit(1)).alias("n"), F.sum(A.topk_hit("logits", "true_idx", k).cast("bigint")).alias("hits"),
        F.sum(nll).alias("loss"), F.first("class_names").alias("names"))


def class_names(counts: DataFrame) -> DataFrame:
    """(run, class_idx, label) from the per-run class list of the pair table (bounded by classes)."""
    return (counts.groupBy("run").agg(F.first("names").alias("names"))
            .select("run", F.posexplode("names").alias("class_idx", "label")))


def per_class_report(pred: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """M5: precision, recall, f1, support per class; classes = true or predicted ones.

    Undefined ratios are 0 (zero_division=0).
    """
    counts = counts if counts is not None else pair_counts(pred)
    name = lambda c: F.element_at("names", F.col(c) + 1).alias("label")
    roles = counts.select(
        "run", "n",
        F.explode(F.array(
            F.struct(F.col("true_idx").alias("class_idx"), F.lit(1).alias("is_true"),
                     (F.col("true_idx") == F.col("pred_idx")).cast("int").alias("hit"), name("true_idx")),
            F.struct(F.col("pred_idx").alias("class_idx"), F.lit(0).alias("is_true"), F.lit(0).alias("hit"), name("pred_idx")),
        )).alias("r"))
    per = roles.groupBy("run", F.col("r.class_idx").alias("class_idx")).agg(
        F.first("r.label").alias("label"),
        F.sum(F.when(F.col("r.hit") == 1, F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("r.is_true") == 1, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("r.is_true") == 0, F.col("n")).otherwise(0)).alias("n_pred"),
    )
    zero = F.lit(0.0)
    return per.select(
        "run", "class_idx", "label",
        F.coalesce(F.try_divide(F.col("tp"), F.col("n_pred").cast("double")), zero).alias("precision"),
        F.coalesce(F.try_divide(F.col("tp"), F.col("support").cast("double")), zero).alias("recall"),
        F.coalesce(F.try_divide(2.0 * F.col("tp"), (F.col("support") + F.col("n_pred")).cast("double")),
                   zero).alias("f1"),
        F.col("support").cast("bigint").alias("support"),
    )


def macro_prf(report: DataFrame) -> DataFrame:
    """M4: unweighted means over classes."""
    return report.groupBy("run").agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                                     F.avg("f1").alias("f1"))


def class_report(pred: DataFrame) -> DataFrame:
    """The classification report of all runs, in one pass: accuracy is the support-weighted recall."""
    report = per_class_report(pred)
    w = Window.partitionBy("run")  # a run's classes
    r = report.withColumns({
        "s": F.sum("support").over(w), "mp": F.avg("precision").over(w), "mr": F.avg("recall").over(w), "mf": F.avg("f1").over(w),
        "wp": F.sum(F.col("precision") * F.col("support")).over(w), "wr": F.sum(F.col("recall") * F.col("support")).over(w),
        "wf": F.sum(F.col("f1") * F.col("support")).over(w), "first": F.row_number().over(w.orderBy("class_idx")) == 1})

    def row(name, p, rc, f, s="s"):
        return F.struct(name.alias("label"), p.alias("precision"), rc.alias("recall"), f.alias("f1"), F.col(s).alias("support"))

    c, per = F.col, lambda x: F.col(x) / F.col("s")
    own = row(c("label"), c("precision"), c("recall"), c("f1"), "support")
    extra = F.array(row(F.lit("accuracy"), per("wr"), per("wr"), per("wr")), row(F.lit("macro avg"), c("mp"), c("mr"), c("mf")),
                    row(F.lit("weighted avg"), per("wp"), per("wr"), per("wf")))
    return r.select("run", F.inline(F.when(c("first"), F.concat(F.array(own), extra)).otherwise(F.array(own))))


def confusion_matrix(pred: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """M6: dense counts, rows = true class, columns = predicted class, zeros kept.

    The class list per run (true or predicted classes, bounded by the class
    count) is expanded into the k x k output grid and left-joined to the counts.
    """
    counts = counts if counts is not None else pair_counts(pred)
    # one row per run: its classes, its class names and its cells; the grid is made in the row
    per_run = counts.groupBy("run").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("true_idx", "pred_idx"))))).alias("cs"),
        F.first("names").alias("names"),
        F.map_from_entries(F.collect_list(F.struct(F.struct("true_idx", "pred_idx"), "n"))).alias("cells"))
    grid = per_run.select("run", "cs", "names", "cells", F.explode("cs").alias("true_idx")) \
        .select("run", "names", "cells", "true_idx", F.explode("cs").alias("pred_idx"))
    label = lambda c: F.element_at("names", F.col(c) + 1)
    n = F.coalesce(F.try_element_at("cells", F.struct("true_idx", "pred_idx")), F.lit(0))
    return grid.select("run", "true_idx", "pred_idx", label("true_idx").alias("true_label"),
                       label("pred_idx").alias("predicted_label"), n.cast("bigint").alias("n"))


def test_metrics(pred: DataFrame) -> DataFrame:
    """One nested row per run, as the evaluation writes it: accuracy, macro F1, class names, the matrix of counts and a
    map of per-class figures.  A run has classes^2 counts."""
    counts = pair_counts(pred)
    rep = per_class_report(pred, counts)
    per = rep.groupBy("run").agg(
        F.avg("f1").alias("macro_f1"),
        F.map_from_entries(F.collect_list(F.struct("label", F.struct("precision", "recall", "f1", "support")))).alias("per_class"))
    cells = counts.groupBy("run").agg(
        F.first("names").alias("classes"), (F.sum(F.when(F.col("true_idx") == F.col("pred_idx"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"),
        F.map_from_entries(F.collect_list(F.struct(F.struct("true_idx", "pred_idx"), "n"))).alias("cells"))
    index = F.transform("classes", lambda c, i: i)
    cell = lambda i, j: F.coalesce(F.try_element_at("cells", F.struct(i.alias("true_idx"), j.alias("pred_idx"))), F.lit(0).cast("bigint"))
    matrix = F.transform(index, lambda i: F.transform(index, lambda j: cell(i, j)))
    return cells.join(per, "run").select("run", "accuracy", "macro_f1", "classes", matrix.alias("confusion_matrix"), "per_class")


def topk_accuracy(pred: DataFrame, k: int = 3) -> DataFrame:
    """M7: share of rows whose true class is among the ``k`` best scores."""
    hit = A.topk_hit("logits", "true_idx", k).cast("double")
    return pred.groupBy("run").agg(F.avg(hit).alias(f"top{k}_accuracy"))


def cross_entropy(pred: DataFrame) -> DataFrame:
    """M8: mean of -log softmax[true] = mean(logsumexp - logit_true)."""
    nll = A.log_sum_exp("logits") - F.element_at("logits", F.col("true_idx") + 1)
    return pred.groupBy("run").agg(F.avg(nll).alias("loss"))


def confidence(pred: DataFrame) -> DataFrame:
    """M9: max probability per row and whether the row is correct."""
    return pred.select("run", "row_id", "confidence", "correct")


def calibration_curve(pred: DataFrame, n_bins: int = 10) -> DataFrame:
    """Uniform bins on confidence, right-closed (bin = #interior edges below the value).

    Per non-empty bin: mean confidence and share correct.
    """
    edges = F.array(*[F.lit(i * (1.0 / n_bins)) for i in range(1, n_bins)])
    b = F.size(F.filter(edges, lambda e: e < F.col("confidence"))).cast("int")
    return pred.groupBy("run", b.alias("bin")).agg(
        F.avg("confidence").alias("mean_confidence"),
        F.avg(F.col("correct").cast("double")).alias("frac_correct"),
        F.count(F.lit(1)).alias("n"))


def confidence_histogram(pred: DataFrame, bins: int = 25) -> DataFrame:
    """Equal bins over each run's min..max confidence; counts of correct / incorrect rows."""
    stats = pred.groupBy("run").agg(F.min("confidence").alias("_mn"), F.max("confidence").alias("_mx"))
    x, mn, mx = F.col("confidence"), F.col("_mn"), F.col("_mx")
    b = F.when(mx == mn, F.lit(bins // 2)).otherwise(
        F.least(F.floor((x - mn) * (bins / (mx - mn))), F.lit(bins - 1))).cast("int")
    counts = (pred.select("run", "confidence", "correct").join(F.broadcast(stats), "run")  # one row per run
              .groupBy("run", b.alias("bin"))
              .agg(F.count_if("correct").alias("n_correct"), F.count_if(~F.col("correct")).alias("n_incorrect")))
    lo = F.when(mx == mn, mn - 0.5).otherwise(mn)
    w = F.when(mx == mn, F.lit(1.0)).otherwise(mx - mn) / bins
    grid = stats.select("run", lo.alias("_lo"), w.alias("_w"),
                        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, ["run", "bin"], "left").select(
        "run", "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("bin_lo"),
        (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("bin_hi"),
        F.coalesce("n_correct", F.lit(0)).cast("bigint").alias("n_correct"),
        F.coalesce("n_incorrect", F.lit(0)).cast("bigint").alias("n_incorrect"))


def misclassified(pred: DataFrame) -> DataFrame:
    """B3 on the prediction table: wrong rows with the confidence of the predicted class."""
    return pred.where(~F.col("correct")).select(
        "run", "row_id", "true_label", "predicted_label",
        F.element_at("probabilities", F.col("pred_idx") + 1).alias("confidence"))


def top_misclassified(pred: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most confident errors per run (ties by row_id)."""
    w = Window.partitionBy("run").orderBy(F.col("confidence").desc(), F.col("row_id"))
    return misclassified(pred).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def summary_metrics(pred: DataFrame) -> DataFrame:
    """Per run: accuracy, macro precision/recall/f1, top-3 accuracy, loss; predictions are read once.

    The pair table (classes^2 rows per run) becomes one row per class and run, and these one row per run.
    """
    hit = F.when(F.col("true_idx") == F.col("pred_idx"), F.col("n")).otherwise(0)
    # each pair counts for its true class and for its predicted one; figures of the whole run go with the former
    roles = pair_counts(pred, 3).select("run", F.inline(F.array(
        F.struct(F.col("true_idx").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("n_pred"), hit.alias("tp"), "hits", "loss"),
        F.struct(F.col("pred_idx").alias("cls"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("n_pred"),
                 F.lit(0).cast("bigint").alias("tp"), F.lit(None).alias("hits"), F.lit(None).alias("loss")))))
    by_class = roles.groupBy("run", "cls").agg(*[F.sum(c).alias(c) for c in ("support", "n_pred", "tp", "hits", "loss")])
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, support, n_pred = F.col("tp"), F.col("support"), F.col("n_pred")
    return by_class.groupBy("run").agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg(ratio(tp, n_pred)).alias("precision"),
        F.avg(ratio(tp, support)).alias("recall"), F.avg(ratio(2 * tp, support + n_pred)).alias("f1"),
        (F.sum("hits") / F.sum("support")).alias("top3_accuracy"), (F.sum("loss") / F.sum("support")).alias("loss"))


def run_summary(summary: DataFrame, entropy: DataFrame | None = None, kinds: DataFrame | None = None) -> DataFrame:
    """One display row per run, rounded to 4 places.

    ``entropy``: ``(run, avg_attn_entropy)`` of the runs with attention; the others show NULL.  ``kinds``:
    ``(run, test_type)``; a run without one is 'Unknown'.
    """
    s = summary if entropy is None else summary.join(entropy, "run", "left")
    s = s if kinds is None else s.join(kinds, "run", "left")
    ent = F.col("avg_attn_entropy") if entropy is not None else F.lit(None).cast("double")
    kind = F.col("test_type") if kinds is not None else F.lit(None).cast("string")
    # --- fixed values: the display names of the summary
    r4 = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)), 4)
    return s.select(
        F.col("run").alias("Model"),
        r4("accuracy").alias("Accuracy"),
        r4("f1").alias("Macro-F1"),
        r4("precision").alias("Precision"),
        r4("recall").alias("Recall"),
        r4("top3_accuracy").alias("Top-3 Accuracy"),
        F.round(ent, 4).alias("Avg Attention Entropy"),
        F.round(F.col("loss"), 4).alias("Loss"),
        F.coalesce(kind, F.lit("Unknown")).alias("Test Type"),
    )


def metrics_long(summary: DataFrame) -> DataFrame:
    """(Model, Metric, Value) for the five summary metrics; missing = 0."""
    return summary.select(
        F.col("run").alias("Model"),
        F.inline(F.array(*[F.struct(F.lit(title).alias("Metric"),
                                    F.coalesce(F.col(m), F.lit(0.0)).alias("Value"))
                           for m, title in SUMMARY_METRICS])))


def metrics_wide(long: DataFrame) -> DataFrame:
    """Model x metric matrix (pivot over the fixed metric list)."""
    return long.groupBy("Model").pivot("Metric", [t for _, t in SUMMARY_METRICS]).agg(F.first("Value"))


def factorize_labels(df: DataFrame, label_col: str = "label", order_col: str = "row_id") -> DataFrame:
    """Integer codes for labels in first-seen order."""
    from ..functions.indexing import with_global_index

    first = df.groupBy(label_col).agg(F.min(order_col).alias("_first"))
    return with_global_index(first, [F.col("_first")], name="_i").select(
        label_col, F.col("_i").cast("int").alias("code"))


def gram_blocks(states: DataFrame, by: str = "run", vector_col: str = "hidden_state") -> DataFrame:
    """``by, d, n, sums, cells``: per run and task the rows, their sum and the sum of their outer products (row by row).

    Vectors are taken as blocks of Arrow batches, each one matrix product, so what leaves a task is one small row per run
    and width, however many records it read.  Products are of values less the task's first vector, which ``origin``
    holds: sums of products of values far from zero would lose digits.
    """
    kind = states.schema[by].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]):
        total: dict = {}
        for batch in batches:
            runs, vectors = batch.column(0).to_pylist(), batch.column(1)
            lens = vectors.value_lengths().fill_null(0).to_numpy()
            ends = np.concatenate([[0], np.cumsum(lens)])
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            groups: dict = {}
            for i, r in enumerate(runs):
                if lens[i]:
                    groups.setdefault((r, int(lens[i])), []).append(i)
            for key, rows in groups.items():
                x = flat[ends[rows][:, None] + np.arange(key[1])]
                one = total.setdefault(key, [x[0].copy(), 0, np.zeros(key[1]), np.zeros((key[1], key[1]))])
                y = x - one[0]
                one[1] += len(y)
                one[2] += y.sum(axis=0)
                one[3] += y.T @ y
        if total:
            yield pa.RecordBatch.from_arrays([
                pa.array([r for r, _ in total], batch.schema.field(0).type), pa.array([d for _, d in total], pa.int32()),
                pa.array([v[0].tolist() for v in total.values()], pa.list_(pa.float64())), pa.array([v[1] for v in total.values()], pa.int64()),
                pa.array([v[2].tolist() for v in total.values()], pa.list_(pa.float64())),
                pa.array([v[3].ravel().tolist() for v in total.values()], pa.list_(pa.float64()))], [by, "d", "origin", "n", "sums", "cells"])

    return states.select(by, F.col(vector_col).cast("array<double>").alias("x")).mapInArrow(
        kernel, f"{by} {kind}, d int, origin array<double>, n long, sums array<double>, cells array<double>")


def hidden_pca(states: DataFrame, k: int = 2, by: str = "run") -> DataFrame:
    """``k``-component PCA of centred hidden states, fitted per run.

    A run's mean and covariance come from one row per task (``gram_blocks``); records are projected where they are read.
    The axes, one small row per run, are not joined with the records by run: each run's records would meet in one task.
    They go to the records as a table of runs by broadcast, in blocks of AXES_RUNS runs, so what is sent has a bound; a
    scan takes one block.  Of the two signs of a component the one with a positive largest entry is taken.
    """
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        d = int(rows.d.max())
        rows = rows[rows.d == d]
        n, origin = rows.n.sum(), np.array(rows.origin.iloc[0])
        total, square = np.zeros(d), np.zeros((d, d))
        for r in rows.itertuples():  # moved to one origin
            shift, part = np.array(r.origin) - origin, np.array(r.sums)
            total += part + r.n * shift
            square += np.array(r.cells).reshape(d, d) + np.outer(part, shift) + np.outer(shift, part) + r.n * np.outer(shift, shift)
        mean = total / n
        values, vectors = np.linalg.eigh(square / n - np.outer(mean, mean))
        top = vectors[:, np.argsort(-values)[:k]].T
        top *= np.sign(top[np.arange(len(top)), np.abs(top).argmax(axis=1)])[:, None]
        return pd.DataFrame({by: [rows[by].iloc[0]], "axes": [[a.tolist() for a in top]], "shift": [(top @ (mean + origin)).tolist()]})

    kind = states.schema[by].dataType.simpleString()
    axes = materialize(gram_blocks(states, by).groupBy(by).applyInPandas(fit, f"{by} {kind}, axes array<array<double>>, shift array<double>"))
    x = states.select(by, "row_id", "label", F.col("hidden_state").cast("array<double>").alias("x"))
    projected = F.transform("axes", lambda a, i: A.dot(F.col("x"), a) - F.col("shift")[i])
    of = F.pmod(F.xxhash64(by), F.lit(max(1, -(-axes.count() // AXES_RUNS))))
    out = None
    for b in range(max(1, -(-axes.count() // AXES_RUNS))):
        part = x.where(of == b).join(F.broadcast(axes.where(of == b)), by).select(by, "row_id", "label", projected.alias("components"))
        out = part if out is None else out.unionByName(part)
    return out


def document_attention(weights: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, entropy, max_weight)`` from token weights ``(key, token_id, n, weight)``; 0 ln 0 = 0."""
    w = F.col("weight")
    return weights.groupBy(key).agg((-F.sum(F.when(w > 0, F.col("n") * w * F.log(w)).otherwise(0.0))).alias("entropy"),
                                    F.max(w).alias("max_weight"))


def attention_entropy(weights: DataFrame, key: str = "doc_id") -> DataFrame:
    """Mean over rows of -sum(w ln w) (0 ln 0 = 0)."""
    return document_attention(weights, key).agg(F.count(F.lit(1)).alias("n_rows"), F.avg("entropy").alias("mean_entropy"))


def attention_by_run(records: DataFrame, weights_col: str = "attention_weights") -> DataFrame:
    """``(run, avg_attn_entropy)`` for M16: mean over a run's records of -sum(w ln w) (0 ln 0 = 0), in the row and by
    partial means.  Records without weights (null or empty) have no say; a run of such records only has no entropy."""
    w = F.col(weights_col)
    own = F.when(F.size(w) > 0, -F.aggregate(w, F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.log(x)).otherwise(0.0)))
    return records.groupBy("run").agg(F.avg(own).alias("avg_attn_entropy"))


def attention_batch_stats(weights: DataFrame, batches: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per batch: mean row entropy and max weight (batches from S3)."""
    j = document_attention(weights, key).join(batches.select(key, "batch_id"), key)
    return j.groupBy("batch_id").agg(F.avg("entropy").alias("entropy"), F.max("max_weight").alias("max_weight"),
                                     F.count(F.lit(1)).alias("n"))


def attention_max(batch_stats: DataFrame) -> DataFrame:
    """Max attention weight of each batch, averaged over batches."""
    return batch_stats.agg(F.avg("max_weight").alias("mean_batch_max_weight"))


def batch_mean_metrics(batch_stats: DataFrame) -> DataFrame:
    """Unweighted mean of batch means (evaluation mode) and the last batch's value
    (training-log mode)."""
    return batch_stats.agg(F.avg("entropy").alias("mean_of_batch_entropy"),
                           F.max_by("entropy", "batch_id").alias("last_batch_entropy"),
                           F.count(F.lit(1)).alias("n_batches"))
