"""Registered queries: evaluation metrics (M1-M19, M21) and B3/B4 on prediction tables.

Predictions: nearest-centroid scores over ``embeddings`` (see fixtures).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, metrics as M
from ..sources.tables import read_table
from .fixtures import RUNS, attention_records, prediction_scores
from .registry import query, rounded

_RUNS_SQL = ", ".join(f"('{n}', {d})" for n, d in RUNS)

PRED = f"""runs(run, dims) AS (VALUES {_RUNS_SQL}),
ex AS (SELECT vec_id, label, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings),
x AS (SELECT r.run, e.vec_id, e.label, e.pos, e.v FROM ex e JOIN runs r ON e.pos < r.dims),
cent AS (SELECT run, label AS cls, pos, avg(v) AS mu FROM x GROUP BY ALL),
kk AS (SELECT run, cls, CAST(row_number() OVER (PARTITION BY run ORDER BY cls) - 1 AS INTEGER) AS cidx
       FROM (SELECT DISTINCT run, cls FROM cent)),
d AS (SELECT x.run, x.vec_id AS row_id, x.label, c.cls, round(-sum((x.v - c.mu) * (x.v - c.mu)), 6) AS logit
      FROM x JOIN cent c ON x.run = c.run AND x.pos = c.pos GROUP BY ALL),
pl AS (SELECT d.run, d.row_id, k.cidx AS class_idx, t.cidx AS true_idx, CAST(d.label AS VARCHAR) AS true_label, d.logit,
              max(d.logit) OVER w AS m, max(CASE WHEN d.cls = d.label THEN d.logit END) OVER w AS t_logit
       FROM d JOIN kk k ON d.run = k.run AND d.cls = k.cls JOIN kk t ON d.run = t.run AND d.label = t.cls
       WINDOW w AS (PARTITION BY d.run, d.row_id)),
pr AS (SELECT run, row_id, any_value(true_idx) AS true_idx, any_value(true_label) AS true_label,
              min(class_idx) FILTER (WHERE logit = m) AS pred_idx, any_value(m) AS m,
              any_value(m) + ln(sum(exp(logit - m))) AS lse, any_value(t_logit) AS t_logit,
              1.0 / sum(exp(logit - m)) AS confidence,
              count(*) FILTER (WHERE logit > t_logit OR (logit = t_logit AND class_idx > true_idx)) AS ahead
       FROM pl GROUP BY run, row_id),
p AS (SELECT pr.*, CAST(k.cls AS VARCHAR) AS predicted_label, pr.pred_idx = pr.true_idx AS correct
      FROM pr JOIN kk k ON pr.run = k.run AND pr.pred_idx = k.cidx),
cnt AS (SELECT run, true_idx, pred_idx, count(*) AS n FROM p GROUP BY ALL),
roles AS (SELECT run, true_idx AS class_idx, n, 1 AS is_true, CASE WHEN true_idx = pred_idx THEN 1 ELSE 0 END AS hit FROM cnt
          UNION ALL SELECT run, pred_idx, n, 0, 0 FROM cnt),
per AS (SELECT run, class_idx, coalesce(sum(n) FILTER (WHERE hit = 1), 0) AS tp,
               coalesce(sum(n) FILTER (WHERE is_true = 1), 0) AS support,
               coalesce(sum(n) FILTER (WHERE is_true = 0), 0) AS n_pred FROM roles GROUP BY ALL),
rep AS (SELECT per.run, per.class_idx, CAST(k.cls AS VARCHAR) AS label,
               CASE WHEN n_pred = 0 THEN 0.0 ELSE tp / n_pred END AS precision,
               CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall,
               CASE WHEN support + n_pred = 0 THEN 0.0 ELSE 2.0 * tp / (support + n_pred) END AS f1,
               CAST(support AS BIGINT) AS support
        FROM per JOIN kk k ON per.run = k.run AND per.class_idx = k.cidx),
acc AS (SELECT run, avg(CAST(correct AS DOUBLE)) AS accuracy, avg(CASE WHEN ahead < 3 THEN 1.0 ELSE 0.0 END) AS top3_accuracy,
               avg(lse - t_logit) AS loss FROM p GROUP BY run),
mac AS (SELECT run, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1 FROM rep GROUP BY run),
summ AS (SELECT acc.*, mac.precision, mac.recall, mac.f1 FROM acc JOIN mac USING (run)),
repx AS (SELECT run, label, precision, recall, f1, support FROM rep
         UNION ALL SELECT s.run, 'accuracy', a.accuracy, a.accuracy, a.accuracy, s.s FROM acc a JOIN (SELECT run, CAST(sum(support) AS BIGINT) AS s FROM rep GROUP BY run) s USING (run)
         UNION ALL SELECT run, 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM rep GROUP BY run
         UNION ALL SELECT run, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                          sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM rep GROUP BY run)"""


def preds(spark, sf):
    return M.with_predictions(prediction_scores(spark, sf))


@query("softmax_probs", f"WITH {PRED} SELECT pl.run, pl.row_id, pl.class_idx, round(exp(pl.logit - pr.lse), 6) AS prob FROM pl JOIN pr USING (run, row_id)")
def _softmax(spark, sf):
    return rounded(M.softmax_long(preds(spark, sf)))


@query("predict_argmax", f"WITH {PRED} SELECT run, row_id, pred_idx, true_label, predicted_label FROM p")
def _argmax(spark, sf):
    return preds(spark, sf).select("run", "row_id", "pred_idx", "true_label", "predicted_label")


@query("filter_misclassified", f"WITH {PRED} SELECT run, row_id, true_label, predicted_label, round(confidence, 6) AS confidence FROM p WHERE NOT correct")
def _misclassified(spark, sf):
    p = preds(spark, sf)
    return rounded(filters.filter_misclassified(p).select("run", "row_id", "true_label", "predicted_label",
                                                          "confidence"))


@query("accuracy", f"WITH {PRED} SELECT run, round(accuracy, 6) AS accuracy FROM acc")
def _accuracy(spark, sf):
    return rounded(M.accuracy(preds(spark, sf)))


@query("macro_prf", f"WITH {PRED} SELECT run, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM mac")
def _macro(spark, sf):
    return rounded(M.macro_prf(M.per_class_report(preds(spark, sf))))


@query("per_class_report", f"WITH {PRED} SELECT run, class_idx, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rep")
def _per_class(spark, sf):
    return rounded(M.per_class_report(preds(spark, sf)))


@query("confusion_matrix", f"""WITH {PRED},
cl AS (SELECT DISTINCT run, c FROM (SELECT run, true_idx AS c FROM cnt UNION ALL SELECT run, pred_idx FROM cnt)),
g AS (SELECT a.run, a.c AS true_idx, b.c AS pred_idx FROM cl a JOIN cl b USING (run))
SELECT g.run, g.true_idx, g.pred_idx, CAST(kt.cls AS VARCHAR) AS true_label, CAST(kp.cls AS VARCHAR) AS predicted_label,
       CAST(coalesce(cnt.n, 0) AS BIGINT) AS n
FROM g LEFT JOIN cnt USING (run, true_idx, pred_idx)
JOIN kk kt ON kt.run = g.run AND kt.cidx = g.true_idx JOIN kk kp ON kp.run = g.run AND kp.cidx = g.pred_idx""")
def _confusion(spark, sf):
    return M.confusion_matrix(preds(spark, sf))


@query("topk_accuracy", f"WITH {PRED} SELECT run, round(top3_accuracy, 6) AS top3_accuracy FROM acc")
def _topk(spark, sf):
    return rounded(M.topk_accuracy(preds(spark, sf), 3))


@query("cross_entropy", f"WITH {PRED} SELECT run, round(loss, 6) AS loss FROM acc")
def _xent(spark, sf):
    return rounded(M.cross_entropy(preds(spark, sf)))


@query("confidence", f"WITH {PRED} SELECT run, row_id, round(confidence, 6) AS confidence, correct FROM p")
def _confidence(spark, sf):
    return rounded(M.confidence(preds(spark, sf)))


@query("calibration_curve", f"""WITH {PRED},
cb AS (SELECT run, CAST(len(list_filter(list_transform(range(1, 10), lambda i: i * (1.0::DOUBLE / 10)), lambda e: e < confidence)) AS INTEGER) AS bin,
              confidence, correct FROM p)
SELECT run, bin, round(avg(confidence), 6) AS mean_confidence, round(avg(CAST(correct AS DOUBLE)), 6) AS frac_correct, count(*) AS n
FROM cb GROUP BY run, bin""")
def _calibration(spark, sf):
    return rounded(M.calibration_curve(preds(spark, sf), 10))


@query("confidence_histogram", f"""WITH {PRED},
s AS (SELECT run, min(confidence) AS mn, max(confidence) AS mx FROM p GROUP BY run),
b AS (SELECT p.run, CASE WHEN s.mx = s.mn THEN 12 ELSE CAST(least(floor((p.confidence - s.mn) * (25 / (s.mx - s.mn))), 24) AS INTEGER) END AS bin,
             count(*) FILTER (WHERE correct) AS n_correct, count(*) FILTER (WHERE NOT correct) AS n_incorrect
      FROM p JOIN s USING (run) GROUP BY ALL),
g AS (SELECT run, mn, mx, CAST(unnest(range(25)) AS INTEGER) AS bin FROM s)
SELECT g.run, g.bin,
       round(CASE WHEN mx = mn THEN mn - 0.5 ELSE mn END + g.bin * (CASE WHEN mx = mn THEN 1.0 ELSE mx - mn END / 25), 6) AS bin_lo,
       round(CASE WHEN mx = mn THEN mn - 0.5 ELSE mn END + (g.bin + 1) * (CASE WHEN mx = mn THEN 1.0 ELSE mx - mn END / 25), 6) AS bin_hi,
       CAST(coalesce(b.n_correct, 0) AS BIGINT) AS n_correct, CAST(coalesce(b.n_incorrect, 0) AS BIGINT) AS n_incorrect
FROM g LEFT JOIN b USING (run, bin)""")
def _conf_hist(spark, sf):
    return rounded(M.confidence_histogram(preds(spark, sf), 25))


@query("top_misclassified", f"""WITH {PRED},
r AS (SELECT run, row_id, true_label, predicted_label, confidence,
             CAST(row_number() OVER (PARTITION BY run ORDER BY confidence DESC, row_id) AS INTEGER) AS rank FROM p WHERE NOT correct)
SELECT run, row_id, true_label, predicted_label, round(confidence, 6) AS confidence, rank FROM r WHERE rank <= 5""")
def _top_mis(spark, sf):
    return rounded(M.top_misclassified(preds(spark, sf), 5))


@query("run_summary", f"""WITH {PRED}
SELECT run AS "Model", round(accuracy, 4) AS "Accuracy", round(f1, 4) AS "Macro-F1", round(precision, 4) AS "Precision",
       round(recall, 4) AS "Recall", round(top3_accuracy, 4) AS "Top-3 Accuracy", CAST(NULL AS DOUBLE) AS "Avg Attention Entropy",
       round(loss, 4) AS "Loss", CASE run WHEN 'full64' THEN 'all dims' ELSE 'Unknown' END AS "Test Type" FROM summ""")
def _run_summary(spark, sf):
    kinds = spark.createDataFrame([("full64", "all dims")], "run string, test_type string")  # dims8 names no type
    return M.run_summary(M.summary_metrics(preds(spark, sf)), kinds=kinds)


@query("run_summary_attention", f"""WITH {PRED},
aw AS (SELECT vec_id, exp(v - max(v) OVER w) / 1.0 AS e FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings) WINDOW w AS (PARTITION BY vec_id)),
pw AS (SELECT vec_id, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM aw),
ent AS (SELECT '{RUNS[0][0]}' AS run, avg(h) AS entropy FROM (SELECT vec_id, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS h FROM pw GROUP BY vec_id))
SELECT run AS "Model", round(accuracy, 4) AS "Accuracy", round(f1, 4) AS "Macro-F1", round(precision, 4) AS "Precision",
       round(recall, 4) AS "Recall", round(top3_accuracy, 4) AS "Top-3 Accuracy", round(entropy, 4) AS "Avg Attention Entropy",
       round(loss, 4) AS "Loss", 'Unknown' AS "Test Type" FROM summ LEFT JOIN ent USING (run)""")
def _run_summary_attention(spark, sf):
    # one of the two runs has attention
    entropy = M.attention_by_run(attention_records(spark, sf))
    return M.run_summary(M.summary_metrics(preds(spark, sf)), entropy=entropy)


_LONG_SQL = """SELECT run AS "Model", m.title AS "Metric",
  round(CASE m.key WHEN 'accuracy' THEN accuracy WHEN 'precision' THEN precision WHEN 'recall' THEN recall
        WHEN 'f1' THEN f1 ELSE top3_accuracy END, 6) AS "Value"
FROM summ, (VALUES ('accuracy', 'Accuracy'), ('precision', 'Precision'), ('recall', 'Recall'), ('f1', 'F1'),
                   ('top3_accuracy', 'Top3_Accuracy')) m(key, title)"""


@query("metrics_long", f"WITH {PRED} {_LONG_SQL}")
def _metrics_long(spark, sf):
    return rounded(M.metrics_long(M.summary_metrics(preds(spark, sf))))


@query("metrics_wide", f"""WITH {PRED}
SELECT run AS "Model", round(accuracy, 6) AS "Accuracy", round(precision, 6) AS "Precision", round(recall, 6) AS "Recall",
       round(f1, 6) AS "F1", round(top3_accuracy, 6) AS "Top3_Accuracy" FROM summ""")
def _metrics_wide(spark, sf):
    return rounded(M.metrics_wide(M.metrics_long(M.summary_metrics(preds(spark, sf)))))


def _report(spark, sf):
    return M.class_report(preds(spark, sf))


@query("filter_class_rows", f"""WITH {PRED}
SELECT run, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support
FROM repx WHERE NOT regexp_matches(label, 'avg|accuracy')""")
def _class_rows(spark, sf):
    return rounded(filters.filter_class_rows(_report(spark, sf)))


_GRID_COLS = ", ".join(
    f"round(max({m}) FILTER (WHERE run = '{r}'), 6) AS \"{r}_{m}\"" for r, _ in RUNS for m in ("precision", "recall", "f1"))


@query("per_class_grid", f"""WITH {PRED}
SELECT label, {_GRID_COLS} FROM repx WHERE NOT regexp_matches(label, 'avg|accuracy') GROUP BY label""")
def _grid(spark, sf):
    rows = filters.filter_class_rows(_report(spark, sf))
    wide = rows.groupBy("label").pivot("run", [r for r, _ in RUNS]).agg(
        F.first("precision").alias("precision"), F.first("recall").alias("recall"), F.first("f1").alias("f1"))
    return rounded(wide)


@query("factorize_labels", """SELECT CAST(label AS VARCHAR) AS label, CAST(row_number() OVER (ORDER BY f) - 1 AS INTEGER) AS code
FROM (SELECT label, min(vec_id) AS f FROM embeddings GROUP BY label)""")
def _factorize(spark, sf):
    emb = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"),
                                                     F.col("label").cast("string").alias("label"))
    return M.factorize_labels(emb, "label", "row_id")
