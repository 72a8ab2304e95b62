"""Epoch-log analytics on the committed smoke log's val_acc column."""

import pytest

from tessera.operators import epochs as E

VAL_ACC = [0.10, 0.10, 0.10, 0.10, 0.12]


def log(spark):
    return spark.createDataFrame([("r", e, v) for e, v in enumerate(VAL_ACC)], "run string, epoch int, val_acc double")


def test_best_epoch(spark):
    r = E.best_epoch(log(spark)).first()
    assert r["best_epoch"] == 4 and r["n_checkpoints"] == 2


def test_early_stop(spark):
    r = E.early_stop_epoch(log(spark), patience=3).first()
    assert r["stop_epoch"] == 3 and r["stopped_early"]


def test_lr_changes_of_the_log(spark):
    rows = [("r", e, lr) for e, lr in enumerate([0.01, 0.01, 0.005, 0.005, 0.0025])] + [("q", 3, 1.0)]
    out = E.lr_changes(spark.createDataFrame(rows, "run string, epoch int, lr double")).collect()
    assert sorted(r["epoch"] for r in out if r["changed"]) == [2, 4] and len(out) == 6


def test_compare_runs_with_columns_that_some_runs_lack(spark):
    a = spark.createDataFrame([("a", 0, 1.0)], "run string, epoch int, val_loss double")
    b = spark.createDataFrame([("b", 0, 2.0, 0.5)], "run string, epoch int, val_loss double, grad_norm double")
    got = {(r["run"], r["metric"]): r["value"] for r in E.compare_runs([a, b]).collect()}
    assert got == {("a", "val_loss"): 1.0, ("b", "val_loss"): 2.0, ("b", "grad_norm"): 0.5}


def test_weighted_epoch_means(spark):
    b = spark.createDataFrame([("r", 0, "train", 0, 2, 1.0, 1), ("r", 0, "train", 1, 1, 4.0, 1)],
                              "run string, epoch int, phase string, batch_id long, n long, batch_loss double, correct long")
    r = E.epoch_weighted_means(b).first()
    assert r["loss"] == pytest.approx(2.0) and r["accuracy"] == pytest.approx(2 / 3)
