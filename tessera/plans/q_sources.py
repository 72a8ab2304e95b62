"""Registered queries: file sources and sinks (A1-A10) as write -> scan round trips.

Each query writes tables derived from the test data into a fresh folder under
the session's shared checkpoint dir, scans them back with the A-operators and
returns what was read; the oracle is the SQL of the data that was written.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import array_sum
from ..operators import epochs as E, filters, metrics as M, vocab
from ..session import scratch_path
from ..sources import files
from ..sources.tables import read_table
from . import sqlparts as q
from .fixtures import RUNS
from .q_corpus import SPLITS, split_docs
from .q_encode import SEQ, ids_text, seq_tokens, train_vocab
from .q_epochs import BATCH, elog, means
from .q_metrics import PRED, preds
from .registry import query, rounded

EPOCH_SCHEMA = "epoch INT, train_loss DOUBLE, val_loss DOUBLE, train_acc DOUBLE, val_acc DOUBLE"


@query("scan_documents", "SELECT doc_id, text, lang AS label FROM documents")
def _a1(spark, sf):
    path = scratch_path(spark, "documents-csv")
    src = read_table(spark, sf, "documents").select("doc_id", F.col("text").alias("abstract"),
                                                     F.col("lang").alias("label"))
    files.write_csv(src, path)
    back = files.scan_documents(spark, path, "doc_id BIGINT, abstract STRING, label STRING")
    return back.select("doc_id", "text", "label")


@query("scan_runs", f"""WITH {BATCH}
SELECT run, epoch, round(train_loss, 6) AS train_loss, round(val_loss, 6) AS val_loss,
       round(train_acc, 6) AS train_acc, round(val_acc, 6) AS val_acc FROM el""")
def _a2(spark, sf):
    root = scratch_path(spark, "runs")
    files.write_csv(elog(spark, sf), root, partition_by=["run"])
    return rounded(files.scan_runs(spark, root, "*.csv", EPOCH_SCHEMA))


@query("scan_json_arrays", f"WITH {PRED} SELECT run, row_id, true_label, predicted_label FROM p")
def _a3(spark, sf):
    # files as the evaluation writes them: one pretty-printed array of objects per file
    root = scratch_path(spark, "predictions-json")
    p = preds(spark, sf).select("run", "row_id", "true_label", "predicted_label", "probabilities")
    files.write_json_arrays(p, root, "run")
    back = files.scan_json_arrays(
        spark, f"{root}/*/*.txt", "row_id BIGINT, true_label STRING, predicted_label STRING, probabilities ARRAY<DOUBLE>")
    return back.select("run", "row_id", "true_label", "predicted_label")


def _evaluation(spark, sf):
    """An evaluation's documents over both runs, written and published as one set."""
    from .fixtures import hidden_states
    from .q_epochs import traces

    root = scratch_path(spark, "evaluation")
    p = preds(spark, sf)
    examples = traces(spark, sf).select("run", F.col("epoch").cast("bigint").alias("row_id"), "tokens", "attention_weights")
    files.sink_evaluation({"hidden_states": hidden_states(spark, sf), "misclassified": filters.filter_misclassified(p),
                           "attention_examples": examples}, root)
    return root


@query("scan_hidden_states", """SELECT run, vec_id AS row_id, CAST(label AS VARCHAR) AS label, CAST(len(x) AS INTEGER) AS n_dims,
round(list_sum(x), 6) AS vsum FROM (SELECT r.run, vec_id, label, (embedding::DOUBLE[])[1:r.dims] AS x FROM embeddings, (VALUES %s) r(run, dims))"""
       % ", ".join(f"('{n}', {d})" for n, d in RUNS))
def _a3_hidden(spark, sf):
    back = files.scan_evaluation(spark, _evaluation(spark, sf), "hidden_states")
    return rounded(back.select("run", "row_id", "label", F.size("hidden_state").alias("n_dims"), array_sum(F.col("hidden_state")).alias("vsum")))


@query("scan_misclassified", f"WITH {PRED} SELECT run, row_id, true_label, predicted_label, round(confidence, 6) AS confidence FROM p WHERE NOT correct")
def _a3_misclassified(spark, sf):
    return rounded(files.scan_evaluation(spark, _evaluation(spark, sf), "misclassified"))


@query("scan_attention_examples", f"""WITH {BATCH},
ex AS (SELECT {q.basic_english(q.normalize('text'))}[1:40] AS toks FROM documents ORDER BY doc_id LIMIT 1)
SELECT run, CAST(epoch AS BIGINT) AS row_id, array_to_string(toks, ' ') AS tokens, CAST(len(toks) AS INTEGER) AS n_weights, 1.0::DOUBLE AS total FROM el, ex""")
def _a3_examples(spark, sf):
    back = files.scan_evaluation(spark, _evaluation(spark, sf), "attention_examples")
    return rounded(back.select("run", "row_id", F.array_join("tokens", " ").alias("tokens"), F.size("attention_weights").alias("n_weights"),
                               array_sum(F.col("attention_weights")).alias("total")))


@query("sink_history", f"""WITH {BATCH}, fin AS (SELECT run, phase, arg_max(accuracy, epoch) AS accuracy FROM em GROUP BY run, phase)
SELECT run, phase, epoch, round(loss, 6) AS loss, round(accuracy, 6) AS final_accuracy FROM em JOIN fin USING (run, phase)""".replace("accuracy, 6)", "fin.accuracy, 6)"))
def _a6(spark, sf):
    root = scratch_path(spark, "history")
    m = means(spark, sf)
    files.sink_sweep(m.select("run", "phase", "epoch", "loss"),
                     m.groupBy("run", "phase").agg(F.max_by("accuracy", "epoch").alias("final_accuracy")), root, keys=("run", "phase"))
    root = files.published(spark, root)
    back = files.scan_nested_runs(spark, f"{root}/loss", "*.csv", "epoch INT, loss DOUBLE", ("run", "phase"))
    acc = files.csv_reader(spark, "run STRING, phase STRING, final_accuracy DOUBLE").csv(f"{root}/accuracies")
    return rounded(back.join(acc, ["run", "phase"]))


@query("sink_metrics", f"""WITH {PRED}
SELECT run AS "Model", round(accuracy, 4) AS "Accuracy", round(f1, 4) AS "Macro-F1", round(precision, 4) AS "Precision",
       round(recall, 4) AS "Recall", round(top3_accuracy, 4) AS "Top-3 Accuracy", CAST(NULL AS DOUBLE) AS "Avg Attention Entropy",
       round(loss, 4) AS "Loss", 'Unknown' AS "Test Type" FROM summ""")
def _a7(spark, sf):
    root = scratch_path(spark, "metrics")
    files.sink_metrics(M.run_summary(M.summary_metrics(preds(spark, sf))), root)
    schema = ("`Model` STRING, `Accuracy` DOUBLE, `Macro-F1` DOUBLE, `Precision` DOUBLE, `Recall` DOUBLE, "
              "`Top-3 Accuracy` DOUBLE, `Avg Attention Entropy` DOUBLE, `Loss` DOUBLE, `Test Type` STRING")
    return files.csv_reader(spark, schema).csv(f"{root}/csv")


@query("nested_test_metrics", f"""WITH {PRED}
SELECT g.run, g.true_idx, g.pred_idx, CAST(kt.cls AS VARCHAR) AS true_label, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n, round(rep.f1, 6) AS f1
FROM (SELECT a.run, a.cidx AS true_idx, b.cidx AS pred_idx FROM kk a JOIN kk b USING (run)) g
LEFT JOIN cnt USING (run, true_idx, pred_idx) JOIN kk kt ON kt.run = g.run AND kt.cidx = g.true_idx
LEFT JOIN rep ON rep.run = g.run AND rep.class_idx = g.true_idx""")
def _a7_nested(spark, sf):
    root = scratch_path(spark, "test-metrics")
    files.write_json_documents(M.test_metrics(preds(spark, sf)), root, "run")
    back = files.scan_json_arrays(spark, f"{root}/*/*.txt", files.TEST_METRICS_SCHEMA)
    rows = back.select("run", "classes", "per_class", F.posexplode("confusion_matrix").alias("true_idx", "row"))
    cells = rows.select("run", "true_idx", F.element_at("classes", F.col("true_idx") + 1).alias("true_label"), "per_class",
                        F.posexplode("row").alias("pred_idx", "n"))
    return rounded(cells.select("run", "true_idx", "pred_idx", "true_label", "n",
                                F.try_element_at("per_class", F.col("true_label"))["f1"].alias("f1")))


@query("sink_splits", f"WITH {SPLITS} SELECT doc_id, label, split FROM splits")
def _a8(spark, sf):
    root = scratch_path(spark, "splits")
    files.sink_splits(split_docs(spark, sf).select("doc_id", "label", "split"), root)
    return files.read_splits(spark, root).select("doc_id", "label", "split")


@query("artifact_tables", f"WITH {SEQ} SELECT token, token_id, freq FROM vocab")
def _a9(spark, sf):
    root = scratch_path(spark, "artifacts")
    files.save_artifacts({"vocab": train_vocab(spark, sf)}, root)
    return files.load_artifacts(spark, root, ("vocab",))["vocab"]


@query("artifact_reuse", f"""WITH {SEQ}, lab AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_idx
  FROM (SELECT DISTINCT label FROM splits WHERE split = 'train'))
SELECT doc_id, label_idx, array_to_string(ids, ' ') AS encoded FROM encl JOIN lab USING (label)""")
def _a9_reuse(spark, sf):
    # training saves vocabulary, label dictionary and prepared test rows; evaluation reads nothing else
    root = scratch_path(spark, "artifacts")
    sd = split_docs(spark, sf)
    test = seq_tokens(spark, sf).where(F.col("split") == "test").select("doc_id", "label", "tokens")
    files.save_artifacts({"vocab": train_vocab(spark, sf), "labels": vocab.label_dictionary(sd.where(F.col("split") == "train")),
                          "prepared": test}, root)
    a = files.load_artifacts(spark, root, ("vocab", "labels", "prepared"))
    enc = vocab.label_encode(vocab.encode_tokens(a["prepared"], "tokens", a["vocab"]), a["labels"])
    return enc.select("doc_id", "label_idx", ids_text("token_ids").alias("encoded"))


@query("optional_inputs", f"""WITH {PRED} SELECT DISTINCT run, 'missing' AS status FROM p""")
def _a10(spark, sf):
    root = scratch_path(spark, "runs-optional")
    files.write_csv(elog(spark, sf), root, partition_by=["run"])
    found = files.scan_mandatory(spark, root, "*.csv", EPOCH_SCHEMA)
    # no run has this file: an empty scan, not an error
    found = found.select("run").unionByName(files.scan_runs(spark, root, "test_metrics.csv", EPOCH_SCHEMA).select("run"))
    requested = preds(spark, sf).select("run").unionByName(found.select("run"))
    return files.optional_inputs(requested, found)


@query("scan_attention_trace", f"""WITH {BATCH},
ex AS (SELECT {q.basic_english(q.normalize('text'))}[1:40] AS toks FROM documents ORDER BY doc_id LIMIT 1),
tp AS (SELECT unnest(range(len(toks))) AS pos, unnest(toks) AS token FROM ex),
sc AS (SELECT el.run, el.epoch, tp.pos, tp.token, length(tp.token) * el.val_acc AS s FROM el, tp),
mx AS (SELECT *, max(s) OVER (PARTITION BY run, epoch) AS m FROM sc)
SELECT run, epoch AS file_epoch, CAST(pos AS INTEGER) AS pos, token,
       round(exp(s - m) / sum(exp(s - m)) OVER (PARTITION BY run, epoch), 6) AS weight FROM mx""")
def _a4(spark, sf):
    from .q_epochs import traces

    root = scratch_path(spark, "traces")
    files.write_traces(traces(spark, sf), root)
    back = files.scan_attention_trace(spark, root, pattern="*/*/*.json", tag="run")
    # long form of what was read: one row per (trace file, position)
    return rounded(back.select("run", "file_epoch", F.posexplode(F.arrays_zip(
        F.col("tokens").alias("token"), F.col("attention_weights").alias("weight"))).alias("pos", "z"))
        .select("run", "file_epoch", "pos", F.col("z.token").alias("token"), F.col("z.weight").alias("weight")))


@query("scan_vectors", f"""WITH {SEQ}
SELECT v.token, CAST(len(e.embedding) AS INTEGER) AS n_dims, round(list_sum(e.embedding::DOUBLE[]), 6) AS vsum
FROM vocab v JOIN embeddings e ON e.vec_id = v.token_id % (SELECT count(*) FROM embeddings) WHERE regexp_full_match(v.token, '[a-z]+')""")
def _a5(spark, sf):
    from .q_attention import pretrained_vectors

    root = scratch_path(spark, "vectors")
    files.write_vectors(pretrained_vectors(spark, sf), root)
    back = files.scan_vectors(spark, root, dim=64)
    # per-token summary of what was read (the full table is tokens x 64 floats)
    return rounded(back.select("token", F.size("vector").alias("n_dims"), array_sum(F.col("vector")).alias("vsum")))


@query("sweep_curves", f"""WITH {BATCH}
SELECT run AS vectorizer, phase AS hidden, epoch, round(loss, 6) AS loss, upper(run) || ' - ' || phase AS curve FROM em""")
def _e7(spark, sf):
    root = scratch_path(spark, "sweep")
    hist = means(spark, sf).select(F.col("run").alias("vectorizer"), F.col("phase").alias("hidden"), "epoch", "loss")
    files.sink_history(hist, root)
    back = files.scan_nested_runs(spark, root, "*.csv", "epoch INT, loss DOUBLE", ("vectorizer", "hidden"))
    return rounded(E.sweep_curves(back))
