"""Derived inputs: tables the reference produced with models, rebuilt from the test tables.

* prediction scores -- nearest-centroid logits over ``embeddings`` (hidden
  states), one run per feature width; logit = -squared distance to the class
  centroid, rounded to 6 digits so every engine ranks the same values.
* epoch/batch logs -- aggregates of ``events``: run := event_type and block of
  EPOCHS user buckets, epoch := the bucket in its block (so runs grow with the
  users and a run has EPOCHS epochs at most), batch := event-id block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table

# --- fixed values: fixture runs (name, number of leading embedding dims used)
RUNS = (("full64", 64), ("dims8", 8))
USERS_PER_EPOCH = 15
EPOCHS = 10  # of a run
EVENTS_PER_BATCH = 64


def centroid_scores(emb: DataFrame, runs=RUNS) -> DataFrame:
    """``(run, row_id, label, classes ARRAY<INT>, logits ARRAY<DOUBLE>)`` per embedding row.

    Centroids are a (run, class, dim) aggregate -- bounded by runs x classes x
    dims -- packed into one matrix row per run and broadcast to the rows of
    that run; the distances are computed in-row with higher-order functions,
    so the embedding rows are never exploded or shuffled.
    """
    cfg = F.array(*[F.struct(F.lit(n).alias("run"), F.lit(d).alias("dims")) for n, d in runs])
    x = emb.select(F.col("vec_id").alias("row_id"), "label", F.inline(cfg),
                   F.col("embedding").cast("array<double>").alias("emb")) \
        .withColumn("x", F.expr("slice(emb, 1, dims)")).drop("emb", "dims")
    cent = (
        x.select("run", "label", F.posexplode("x").alias("pos", "v"))
        .groupBy("run", "label", "pos").agg(F.avg("v").alias("mu"))
        .groupBy("run", "label").agg(F.array_sort(F.collect_list(F.struct("pos", "mu"))).alias("m"))
        .select("run", F.struct(F.col("label").alias("cls"),
                                F.transform("m", lambda s: s["mu"]).alias("mu")).alias("c"))
        .groupBy("run").agg(F.array_sort(F.collect_list("c")).alias("centroids"))
    )
    j = x.join(F.broadcast(cent), "run")  # one matrix per run: runs x classes x dims values
    logits = F.transform("centroids", lambda c: F.round(-F.aggregate(
        F.zip_with("x", c["mu"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, t: acc + t), 6))
    return j.select("run", "row_id", "label",
                    F.transform("centroids", lambda c: c["cls"]).alias("classes"),
                    logits.alias("logits"))


def prediction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores in the prediction-record layout: ``run, row_id, true_idx, true_label, class_names, logits``."""
    s = centroid_scores(read_table(spark, sf_dir, "embeddings"))
    return s.select(
        "run", "row_id",
        (F.array_position("classes", F.col("label")) - 1).cast("int").alias("true_idx"),
        F.col("label").cast("string").alias("true_label"),
        F.transform("classes", lambda c: c.cast("string")).alias("class_names"),
        "logits",
    )


def hidden_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden-state records ``(run, row_id, hidden_state ARRAY<DOUBLE>, label STRING)``."""
    emb = read_table(spark, sf_dir, "embeddings")
    cfg = F.array(*[F.struct(F.lit(n).alias("run"), F.lit(d).alias("dims")) for n, d in RUNS])
    return emb.select(F.col("vec_id").alias("row_id"), F.col("label").cast("string").alias("label"),
                      F.inline(cfg), F.col("embedding").cast("array<double>").alias("e")) \
        .select("run", "row_id", F.expr("slice(e, 1, dims)").alias("hidden_state"), "label")


def batch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mini-batch log ``(run, epoch, phase, batch_id, n, batch_loss, correct)`` from ``events``.

    phase: every fifth event id is validation, the rest training; a batch is
    a block of ``EVENTS_PER_BATCH`` consecutive event ids.
    """
    ev = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return (
        ev.select(
            F.concat_ws("-", "event_type", F.floor(F.col("user_id") / (USERS_PER_EPOCH * EPOCHS))).alias("run"),
            F.pmod(F.floor(F.col("user_id") / USERS_PER_EPOCH), F.lit(EPOCHS)).cast("int").alias("epoch"),
            F.when(F.pmod("event_id", F.lit(5)) == 0, "val").otherwise("train").alias("phase"),
            F.floor(F.col("event_id") / EVENTS_PER_BATCH).cast("bigint").alias("batch_id"),
            F.log1p("value").alias("loss"),
            (F.col("value") < 100).cast("int").alias("ok"),
        )
        .groupBy("run", "epoch", "phase", "batch_id")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("loss").alias("batch_loss"), F.sum("ok").alias("correct"))
    )


def epoch_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Further columns of the epoch log, per ``(run, epoch)``: figures of the epoch's own events."""
    ev = read_table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    run = F.concat_ws("-", "event_type", F.floor(F.col("user_id") / (USERS_PER_EPOCH * EPOCHS)))
    epoch = F.pmod(F.floor(F.col("user_id") / USERS_PER_EPOCH), F.lit(EPOCHS)).cast("int")
    return ev.groupBy(run.alias("run"), epoch.alias("epoch")).agg(
        F.round(F.min("value"), 2).alias("lr"), F.max("value").alias("grad_norm"), F.log1p(F.avg("value")).alias("attn_entropy"))


def attention_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(run, row_id, attention_weights)`` of the one run with attention: a softmax over each vector's entries."""
    from ..functions.arrays import softmax

    emb = read_table(spark, sf_dir, "embeddings")
    return emb.select(F.lit(RUNS[0][0]).alias("run"), F.col("vec_id").alias("row_id"),
                      softmax(F.col("embedding").cast("array<double>")).alias("attention_weights"))
