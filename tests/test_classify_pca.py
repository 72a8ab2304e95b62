"""Classifier (G1-G6) and PCA (M20): shapes, repeatability, better than guessing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import classify as G, metrics as M, split, text_ops, vectorize, vocab

SHAPES = ((4,), (6, 3))


@pytest.fixture(scope="module")
def bow(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.col("lang").alias("label"))
    sd = split.stratified_split(docs)
    prepared = text_ops.prepare_text(sd).select("doc_id", "split", "label", "clean_text")
    b = vocab.label_encode(prepared, vocab.label_dictionary(sd.where("split = 'train'"))).checkpoint()
    train, test = b.where("split = 'train'"), b.where("split = 'test'")
    v = vectorize.fit_idf(vectorize.fit_vocabulary(vectorize.term_frequencies(train), 200), train).checkpoint()
    return train, test, v, b.select("label", "label_idx").distinct().checkpoint()


def test_fit_predict_accuracy_and_loss(spark, bow):
    train, test, v, classes = bow
    tr, te = G.featurize(train, test, v, "count")
    fits = [G.mlp_fit(tr, v.count(), classes.count(), (6,), max_iter=25) for _ in range(2)]
    assert list(fits[0].weights) == list(fits[1].weights)
    pred = G.mlp_predict(fits[0], te, classes)
    assert pred.count() == test.count() and pred.where("predicted_label is null").count() == 0
    acc = G.mlp_accuracy(pred).first()["accuracy"]
    rows = [r["label"] for r in test.select("label").collect()]
    assert acc > max(rows.count(x) for x in set(rows)) / len(rows)
    losses = [r["loss"] for r in G.loss_curve(spark, fits[0]).orderBy("epoch").collect()]
    assert losses[-1] < losses[0] and len(losses) > 3


def test_sweep_has_a_row_per_vectorizer_and_shape(spark, bow):
    train, test, v, classes = bow
    acc, hist = G.mlp_sweep(spark, train, test, v, classes, classes.count(), shapes=SHAPES, max_iter=8)
    got = {(r["vectorizer"], r["hidden"]): r["accuracy"] for r in acc.collect()}
    assert set(got) == {(k, str(s)) for k in G.VECTORIZERS for s in SHAPES} and all(0 <= a <= 1 for a in got.values())
    assert {(r["vectorizer"], r["hidden"]) for r in hist.collect()} == set(got)


def test_queries_of_the_family_are_registered():
    from tessera.plans.catalog import QUERIES
    assert {"mlp_fit", "mlp_predict", "mlp_accuracy", "loss_curve", "mlp_sweep", "prep_ablation", "hidden_pca"} <= set(QUERIES)


def test_pca_equals_singular_vectors(spark):
    rng = np.random.default_rng(2)
    rows = []
    for run, d in (("a", 5), ("b", 3)):
        x = rng.normal(size=(60, d)) @ rng.normal(size=(d, d)) + 3
        rows += [(run, i, "l", v.tolist()) for i, v in enumerate(x)]
    states = spark.createDataFrame(rows, "run string, row_id long, label string, hidden_state array<double>")
    got = {}
    for r in M.hidden_pca(states).collect():
        got.setdefault(r["run"], {})[r["row_id"]] = r["components"]
    assert set(got) == {"a", "b"} and all(len(g) == 60 for g in got.values())
    for run, g in got.items():
        x = np.array([r[3] for r in rows if r[0] == run])
        centred = x - x.mean(axis=0)
        axes = np.linalg.svd(centred)[2][:2]
        want = centred @ axes.T
        have = np.array([g[i] for i in range(60)])
        assert np.allclose(np.abs(have), np.abs(want)) and np.allclose(have.mean(axis=0), 0)
    again = {(r["run"], r["row_id"]): r["components"] for r in M.hidden_pca(states).collect()}
    assert all(np.allclose(again[run, i], c) for run, g in got.items() for i, c in g.items())


def test_report_and_summary_read_predictions_once(spark):
    df = spark.createDataFrame([("r", i, i % 3, [float((i * 7) % 5), float((i * 3) % 4), float(i % 2)]) for i in range(60)],
                               "run string, row_id long, true_idx int, logits array<double>")
    p = M.with_predictions(df.withColumn("class_names", F.array(*[F.lit(x) for x in "abc"])))
    s, rep = M.summary_metrics(p).first(), M.per_class_report(p)
    assert s["accuracy"] == pytest.approx(M.accuracy(p).first()["accuracy"]) and s["loss"] == pytest.approx(M.cross_entropy(p).first()["loss"])
    assert s["f1"] == pytest.approx(M.macro_prf(rep).first()["f1"])
    extra = {r["label"]: r for r in M.class_report(p).collect()}
    assert extra["accuracy"]["f1"] == pytest.approx(s["accuracy"]) and extra["macro avg"]["recall"] == pytest.approx(s["recall"])
    for out in (M.summary_metrics(p), M.confusion_matrix(p), M.class_report(p)):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    summary = M.run_summary(M.summary_metrics(p)).first()
    assert summary["Avg Attention Entropy"] is None and summary["Test Type"] == "Unknown"


def test_pca_moves_one_row_per_task_and_run(spark, monkeypatch):
    """Records far from zero, many runs in several broadcast blocks; empty and null vectors have no say."""
    rng = np.random.default_rng(3)
    rows = [(f"r{i % 7}", i, "l", (rng.normal(size=6) * np.arange(1, 7) + 1e7).tolist()) for i in range(700)]
    states = spark.createDataFrame(rows, "run string, row_id long, label string, hidden_state array<double>").repartition(3)
    odd = spark.createDataFrame([("r0", 900, "l", None), ("r0", 901, "l", [])], states.schema)
    assert M.gram_blocks(states).count() == 3 * 7
    whole = {r["row_id"]: r["components"] for r in M.hidden_pca(states.unionByName(odd)).collect()}
    for run in ("r0", "r3"):
        x = np.array([r[3] for r in rows if r[0] == run])
        centred = x - x.mean(axis=0)
        want = centred @ np.linalg.svd(centred)[2][:2].T
        have = np.array([whole[r[1]] for r in rows if r[0] == run])
        assert np.allclose(np.abs(have), np.abs(want), atol=1e-5)
    monkeypatch.setattr(M, "AXES_RUNS", 2)
    blocks = {r["row_id"]: r["components"] for r in M.hidden_pca(states).collect()}
    assert set(blocks) == {r[1] for r in rows} and all(np.allclose(blocks[i], whole[i], atol=1e-6) for i in blocks)


def test_summary_is_an_aggregate_over_classes(spark):
    """One row per class and run; nothing gathers a run's pairs into a row."""
    df = spark.range(400).select(F.lit("r").alias("run"), F.col("id").alias("row_id"), (F.col("id") % 60).cast("int").alias("true_idx"),
                                 F.expr("transform(sequence(0, 59), c -> cast(pmod(c * 7 + id, 61) as double))").alias("logits"),
                                 F.expr("transform(sequence(0, 59), c -> cast(c as string))").alias("class_names"))
    p = M.with_predictions(df)
    s = M.summary_metrics(p)
    assert "collect_list" not in s._jdf.queryExecution().optimizedPlan().toString()
    s = s.first()
    assert s["f1"] == pytest.approx(M.macro_prf(M.per_class_report(p)).first()["f1"])
    assert s["top3_accuracy"] == pytest.approx(M.topk_accuracy(p).first()["top3_accuracy"])
