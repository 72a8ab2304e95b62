"""Evaluation metrics (M-family) on hand vectors and invariants."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators import metrics as M


def scores(spark, rows):
    df = spark.createDataFrame(rows, "run string, row_id long, true_idx int, logits array<double>")
    names = F.array(*[F.lit(str(i)) for i in range(len(rows[0][3]))])
    return M.with_predictions(df.withColumn("true_label", F.col("true_idx").cast("string"))
                              .withColumn("class_names", names))


def test_argmax_ties_lowest_index(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0],)], "a array<double>")
    assert df.select(A.argmax("a")).first()[0] == 1


def test_topk_tie_rule(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0], t) for t in range(3)], "a array<double>, t int")
    k1 = [r[0] for r in df.select(A.topk_hit("a", "t", 1)).collect()]
    k2 = [r[0] for r in df.select(A.topk_hit("a", "t", 2)).collect()]
    assert k1 == [False, False, True] and k2 == [False, True, True]


def test_entropy_zero_weight(spark):
    df = spark.createDataFrame([([0.2, 0.8, 0.0],)], "w array<double>")
    assert df.select(A.entropy("w")).first()[0] == pytest.approx(0.500402, abs=1e-6)


def test_softmax_sums_to_one(spark):
    p = scores(spark, [("r", 1, 0, [3.0, 1.0, -2.0]), ("r", 2, 2, [0.0, 0.0, 0.0])])
    for r in p.collect():
        assert sum(r["probabilities"]) == pytest.approx(1.0)


def test_calibration_bins_right_closed(spark):
    df = spark.createDataFrame([("r", c, True) for c in (0.1, 0.10001, 1.0)], "run string, confidence double, correct boolean")
    got = sorted(r["bin"] for r in M.calibration_curve(df).collect())
    assert got == [0, 1, 9]


def test_constant_predictor_identity(spark):
    # 10 classes, always answering class 0 which holds share p of the rows
    n, k = 1000, 10
    n0 = 97  # p = 0.097
    rows = [("c", i, 0 if i < n0 else 1 + i % (k - 1), [1.0] + [0.0] * (k - 1)) for i in range(n)]
    p = scores(spark, rows)
    mac = M.macro_prf(M.per_class_report(p)).first()
    share = n0 / n
    assert mac["precision"] == pytest.approx(share / k)
    assert mac["recall"] == pytest.approx(1 / k)
    assert mac["f1"] == pytest.approx(2 * share / (1 + share) / k)


def test_confusion_total_and_trace(spark):
    rows = [("r", i, i % 3, [float((i * 7) % 5), float((i * 3) % 4), float(i % 2)]) for i in range(60)]
    p = scores(spark, rows)
    cm = M.confusion_matrix(p).collect()
    assert sum(r["n"] for r in cm) == 60
    acc = M.accuracy(p).first()["accuracy"]
    assert sum(r["n"] for r in cm if r["true_idx"] == r["pred_idx"]) / 60 == pytest.approx(acc)


def test_cross_entropy_matches_definition(spark):
    p = scores(spark, [("r", 1, 0, [2.0, 0.0]), ("r", 2, 1, [2.0, 0.0])])
    want = (-math.log(math.exp(2) / (math.exp(2) + 1)) - math.log(1 / (math.exp(2) + 1))) / 2
    assert M.cross_entropy(p).first()["loss"] == pytest.approx(want)


def test_summary_with_runs_with_and_without_attention(spark):
    import math
    rec = spark.createDataFrame([("a", 1, [0.5, 0.5, 0.0]), ("a", 2, [1.0]), ("a", 3, None), ("b", 4, []), ("b", 5, None)],
                                "run string, row_id long, attention_weights array<double>")
    ent = {r["run"]: r["avg_attn_entropy"] for r in M.attention_by_run(rec).collect()}
    assert abs(ent["a"] - math.log(2) / 2) < 1e-12 and ent["b"] is None
    s = spark.createDataFrame([(r, 0.5, 0.5, 0.5, 0.5, 0.5, 1.0) for r in "abc"], "run string, accuracy double, f1 double, precision double, recall double, top3_accuracy double, loss double")
    out = {r["Model"]: r["Avg Attention Entropy"] for r in M.run_summary(s, entropy=M.attention_by_run(rec)).collect()}
    assert out == {"a": 0.3466, "b": None, "c": None}
