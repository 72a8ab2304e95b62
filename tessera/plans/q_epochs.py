"""Registered queries: epoch-log analytics (E1-E6) over logs derived from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.text import basic_english_tokens, normalize_placeholders, truncate_tokens
from ..operators import epochs as E
from ..sources.tables import read_table
from . import sqlparts as q
from .fixtures import EPOCHS, EVENTS_PER_BATCH, USERS_PER_EPOCH, batch_log, epoch_extras
from .registry import query, rounded

BATCH = f"""bl AS (SELECT event_type || '-' || CAST(floor(user_id / {USERS_PER_EPOCH * EPOCHS}) AS BIGINT) AS run,
              CAST(floor(user_id / {USERS_PER_EPOCH}) AS INTEGER) % {EPOCHS} AS epoch,
              CASE WHEN event_id % 5 = 0 THEN 'val' ELSE 'train' END AS phase,
              CAST(floor(event_id / {EVENTS_PER_BATCH}) AS BIGINT) AS batch_id,
              count(*) AS n, avg(ln(1 + value)) AS batch_loss, sum(CASE WHEN value < 100 THEN 1 ELSE 0 END) AS correct
       FROM events GROUP BY ALL),
em AS (SELECT run, epoch, phase, sum(batch_loss * n) / sum(n) AS loss, sum(correct) / sum(n) AS accuracy,
              CAST(sum(n) AS BIGINT) AS n FROM bl GROUP BY ALL),
el AS (SELECT run, epoch, max(loss) FILTER (WHERE phase = 'train') AS train_loss, max(loss) FILTER (WHERE phase = 'val') AS val_loss,
              max(accuracy) FILTER (WHERE phase = 'train') AS train_acc, max(accuracy) FILTER (WHERE phase = 'val') AS val_acc
       FROM em GROUP BY run, epoch),
imp AS (SELECT *, val_acc > greatest(coalesce(max(val_acc) OVER (PARTITION BY run ORDER BY epoch
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS improved FROM el)"""


def means(spark, sf):
    return E.epoch_weighted_means(batch_log(spark, sf))


def elog(spark, sf):
    return E.epoch_log(means(spark, sf))


@query("epoch_weighted_means", f"WITH {BATCH} SELECT run, epoch, phase, round(loss, 6) AS loss, round(accuracy, 6) AS accuracy, n FROM em")
def _e1(spark, sf):
    return rounded(means(spark, sf))


@query("best_epoch", f"""WITH {BATCH}
SELECT run, max(epoch) FILTER (WHERE improved) AS best_epoch, round(max(val_acc), 6) AS best_val_acc,
       count(*) FILTER (WHERE improved) AS n_checkpoints FROM imp GROUP BY run""")
def _e2(spark, sf):
    return rounded(E.best_epoch(elog(spark, sf)))


@query("early_stop_epoch", f"""WITH {BATCH},
li AS (SELECT *, last_value(CASE WHEN improved THEN epoch END IGNORE NULLS) OVER (PARTITION BY run ORDER BY epoch
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS li FROM imp)
SELECT run, coalesce(min(epoch) FILTER (WHERE CASE WHEN li IS NULL THEN epoch + 1 ELSE epoch - li END >= 3), max(epoch)) AS stop_epoch,
       min(epoch) FILTER (WHERE CASE WHEN li IS NULL THEN epoch + 1 ELSE epoch - li END >= 3) IS NOT NULL AS stopped_early
FROM li GROUP BY run""")
def _e3(spark, sf):
    return E.early_stop_epoch(elog(spark, sf), patience=3)


EXTRAS = f"""xs AS (SELECT event_type || '-' || CAST(floor(user_id / {USERS_PER_EPOCH * EPOCHS}) AS BIGINT) AS run,
              CAST(floor(user_id / {USERS_PER_EPOCH}) AS INTEGER) % {EPOCHS} AS epoch,
              round(min(value), 2) AS lr, max(value) AS grad_norm, ln(1 + avg(value)) AS attn_entropy FROM events GROUP BY ALL)"""


@query("lr_plateau", f"""WITH {EXTRAS}
SELECT run, epoch, lr, lr <> lag(lr, 1, lr) OVER (PARTITION BY run ORDER BY epoch) AS changed FROM xs""")
def _e4(spark, sf):
    return E.lr_changes(epoch_extras(spark, sf))


# runs of one event type log two columns more than the others
@query("compare_runs", f"""WITH {BATCH}, {EXTRAS},
more AS (SELECT el.*, CASE WHEN run LIKE 'click-%' THEN grad_norm END AS grad_norm, CASE WHEN run LIKE 'click-%' THEN attn_entropy END AS attn_entropy
         FROM el JOIN xs USING (run, epoch))
SELECT run, epoch, metric, round(value, 6) AS value FROM (UNPIVOT more ON train_loss, val_loss, train_acc, val_acc, grad_norm, attn_entropy
  INTO NAME metric VALUE value) WHERE value IS NOT NULL""")
def _e5(spark, sf):
    log = elog(spark, sf)
    rich = log.where(F.col("run").startswith("click-")).join(
        epoch_extras(spark, sf).select("run", "epoch", "grad_norm", "attn_entropy"), ["run", "epoch"])
    return rounded(E.compare_runs([log.where(~F.col("run").startswith("click-")), rich]))


def traces(spark, sf):
    """Attention trace per (run, epoch): the first 40 tokens of the lowest-id document,
    weights = softmax over positions of token length x that epoch's val_acc."""
    docs = read_table(spark, sf, "documents")
    example = docs.orderBy("doc_id").limit(1).select(
        truncate_tokens(basic_english_tokens(normalize_placeholders("text")), 40).alias("toks"))
    toks = example.scalar()  # scalar subquery: one array, no join
    log = elog(spark, sf).withColumn("tokens", toks)
    scores = F.transform("tokens", lambda t: F.length(t) * F.col("val_acc"))
    return log.select("run", "epoch", "tokens", A.softmax(scores).alias("attention_weights"))


@query("attention_evolution", f"""WITH {BATCH},
ex AS (SELECT {q.basic_english(q.normalize('text'))}[1:40] AS toks FROM documents ORDER BY doc_id LIMIT 1),
tp AS (SELECT unnest(range(len(toks))) AS pos, unnest(toks) AS token FROM ex),
sc AS (SELECT el.run, el.epoch, tp.pos, tp.token, length(tp.token) * el.val_acc AS s FROM el, tp),
mx AS (SELECT *, max(s) OVER (PARTITION BY run, epoch) AS m FROM sc)
SELECT run, epoch + 1 AS epoch_display, CAST(pos AS INTEGER) AS pos, token,
       round(exp(s - m) / sum(exp(s - m)) OVER (PARTITION BY run, epoch), 6) AS weight FROM mx""")
def _e6(spark, sf):
    return rounded(E.attention_evolution(traces(spark, sf)))
