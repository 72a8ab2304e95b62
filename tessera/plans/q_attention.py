"""Registered queries: word vectors (C7-C10), attention pooling (N1-N4), attention metrics.

Pipeline: train vocabulary (C1) -> pretrained vectors (fixture: vocabulary
tokens of plain ASCII letters take the ``embeddings`` row ``token_id mod <rows of the table>``;
all other tokens are out of vocabulary) -> C7 table -> padded test sequences
(C3) embedded per position (C10) -> pooled per document (N1-N3).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import array_sum
from ..operators import attention as N, embedding as EM, metrics as M, split
from ..sources.tables import read_table
from .q_encode import SEQ, test_padded, train_vocab
from .registry import query, rounded, shared

DIM = 64
# --- scorer parameters, generated by fixed rules
W_LIN = [((i % 7) - 3) / 10 for i in range(DIM)]
B_LIN = 0.1
W1 = [[(((i + 3 * j) % 5) - 2) / 10 for i in range(DIM)] for j in range(4)]
B1 = [0.05 * j for j in range(4)]
W2 = [0.5, -0.25, 0.25, -0.5]
B2 = 0.0


def pretrained_vectors(spark, sf, vocab=None):
    vocab = train_vocab(spark, sf) if vocab is None else vocab
    emb = read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    v = vocab.where(F.col("token").rlike("^[a-z]+$"))
    return v.join(emb, F.pmod(v["token_id"], F.lit(emb.count())) == emb["vec_id"]) \
        .select("token", F.col("embedding").alias("vector"))


def emb_table(spark, sf):
    """The whole C7 table; read once by each of its queries, so it is not written: only the columns these use are made."""
    return EM.embedding_join(train_vocab(spark, sf), pretrained_vectors(spark, sf), DIM, 0.6)


@shared
def used_emb_table(spark, sf):
    """C7 rows for the ids that occur in the test sequences only.

    The semi-join runs before the vector draws, so out-of-vocabulary vectors
    are generated for used tokens only (the full matrix is C7's own query).
    """
    used = test_padded(spark, sf).select(F.explode_outer("padded").alias("token_id")).distinct()
    vocab = train_vocab(spark, sf).join(used, "token_id", "left_semi")
    v = pretrained_vectors(spark, sf, vocab)
    return EM.embedding_join(vocab, v, DIM, 0.6)


def seq_vectors(spark, sf):
    return EM.embed_sequence(test_padded(spark, sf), "padded", used_emb_table(spark, sf))


def _lit(vals):
    return "[" + ", ".join(repr(float(v)) for v in vals) + "]::DOUBLE[]"


def _normal_sql(key: str, scale: str) -> str:
    u = "((('0x' || substr(md5('42:' || {k} || ':' || i), {s}, 13))::BIGINT + 0.5) / 4503599627370496.0)"
    return (f"list_transform(range({DIM}), lambda i: {scale} * sqrt(-2 * ln({u.format(k=key, s=1)}))"
            f" * cos(2 * pi() * {u.format(k=key, s=14)}))")


EMB = SEQ + f""",
pv AS (SELECT v.token, e.embedding::DOUBLE[] AS vector FROM vocab v JOIN embeddings e ON e.vec_id = v.token_id % (SELECT count(*) FROM embeddings)
       WHERE regexp_full_match(v.token, '[a-z]+')),
emb AS (SELECT v.token_id, v.token, pv.vector IS NOT NULL AS found,
               coalesce(pv.vector, {_normal_sql('v.token', '0.6')}) AS vector
        FROM vocab v LEFT JOIN pv ON v.token = pv.token),
sp AS (SELECT doc_id, unnest(range(len(ids))) AS pos, unnest(ids) AS token_id FROM padded),
sv AS (SELECT sp.doc_id, sp.pos, sp.token_id, e.vector FROM sp JOIN emb e USING (token_id))"""


def _pool_sql(score: str) -> str:
    return EMB + f""",
sc AS (SELECT doc_id, pos, vector, {score} AS score FROM sv),
mx AS (SELECT *, max(score) OVER (PARTITION BY doc_id) AS m FROM sc),
wt AS (SELECT *, exp(score - m) / sum(exp(score - m)) OVER (PARTITION BY doc_id) AS weight FROM mx),
ctx AS (SELECT doc_id, CAST(i AS INTEGER) AS dim, sum(weight * v) AS value
        FROM (SELECT doc_id, weight, unnest(range({DIM})) AS i, unnest(vector) AS v FROM wt) GROUP BY ALL),
ent AS (SELECT doc_id, -sum(CASE WHEN weight > 0 THEN weight * ln(weight) ELSE 0 END) AS entropy, max(weight) AS mw FROM wt GROUP BY doc_id),
bt AS (SELECT ent.*, (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS batch_id FROM ent),
bs AS (SELECT batch_id, avg(entropy) AS entropy, max(mw) AS max_weight FROM bt GROUP BY batch_id)"""


LIN_SQL = _pool_sql(f"list_dot_product(vector, {_lit(W_LIN)}) + {B_LIN}")
MLP_HIDDEN = ", ".join(f"tanh(list_dot_product(vector, {_lit(row)}) + {bj})" for row, bj in zip(W1, B1))
MLP_SQL = _pool_sql(f"list_dot_product([{MLP_HIDDEN}], {_lit(W2)}) + {B2}")
DOT_SQL = EMB + f""",
q AS (SELECT doc_id, arg_max(vector, pos) AS qv FROM sv GROUP BY doc_id),
sc AS (SELECT sv.doc_id, sv.pos, sv.vector, list_dot_product(sv.vector, q.qv) AS score FROM sv JOIN q USING (doc_id)),
mx AS (SELECT *, max(score) OVER (PARTITION BY doc_id) AS m FROM sc),
wt AS (SELECT *, exp(score - m) / sum(exp(score - m)) OVER (PARTITION BY doc_id) AS weight FROM mx),
ctx AS (SELECT doc_id, CAST(i AS INTEGER) AS dim, sum(weight * v) AS value
        FROM (SELECT doc_id, weight, unnest(range({DIM})) AS i, unnest(vector) AS v FROM wt) GROUP BY ALL)"""

CTX_OUT = "SELECT doc_id, dim, round(value, 6) AS value FROM ctx"


def weights_linear(spark, sf):
    counts = N.token_counts(test_padded(spark, sf), "padded")
    return N.weights_by_token(counts, used_emb_table(spark, sf), N.linear_score(F.col("vector"), W_LIN, B_LIN))


def _vec_summary(df, *more):
    return df.select("token_id", "token", *more, array_sum(F.col("vector")).alias("vsum"),
                     array_sum(F.transform("vector", lambda x: x * x)).alias("vsq"))


@query("embedding_join", f"""WITH {EMB}
SELECT token_id, token, found, round(list_sum(vector), 6) AS vsum, round(list_sum(list_transform(vector, lambda x: x * x)), 6) AS vsq FROM emb""")
def _c7(spark, sf):
    e = emb_table(spark, sf)
    return rounded(_vec_summary(e, "found"))


@query("embedding_coverage", f"""WITH {EMB}
SELECT count(*) FILTER (WHERE found) AS n_found, count(*) AS n_total, round(count(*) FILTER (WHERE found) / count(*), 6) AS coverage FROM emb""")
def _c8(spark, sf):
    return rounded(EM.embedding_coverage(emb_table(spark, sf)))


@query("random_embedding", f"""WITH {SEQ}
SELECT token_id, token, round(list_sum(vector), 6) AS vsum, round(list_sum(list_transform(vector, lambda x: x * x)), 6) AS vsq
FROM (SELECT token_id, token, CASE WHEN token_id = 1 THEN list_transform(range({DIM}), lambda i: 0.0)
                                   ELSE {_normal_sql('token', '1.0')} END AS vector FROM vocab)""")
def _c9(spark, sf):
    return rounded(_vec_summary(EM.random_embedding(train_vocab(spark, sf), DIM)))


@query("embed_sequence", f"WITH {EMB} SELECT doc_id, CAST(pos AS INTEGER) AS pos, token_id, round(list_sum(vector), 6) AS vsum FROM sv")
def _c10(spark, sf):
    s = seq_vectors(spark, sf)
    return rounded(s.select("doc_id", "pos", "token_id", array_sum(F.col("vector")).alias("vsum")))


@query("attn_pool_linear", f"WITH {LIN_SQL} {CTX_OUT}")
def _n1(spark, sf):
    table = used_emb_table(spark, sf)
    return rounded(N.context_long(N.attn_pool_linear(test_padded(spark, sf), "padded", table, W_LIN, B_LIN)))


@query("attn_pool_dot", f"WITH {DOT_SQL} {CTX_OUT}")
def _n2(spark, sf):
    return rounded(N.context_long(N.attn_pool_dot(test_padded(spark, sf), "padded", used_emb_table(spark, sf), DIM)))


@query("attn_pool_mlp", f"WITH {MLP_SQL} {CTX_OUT}")
def _n3(spark, sf):
    return rounded(N.context_long(N.attn_pool_mlp(test_padded(spark, sf), "padded", used_emb_table(spark, sf), W1, B1, W2, B2)))


@query("attn_weights", f"WITH {LIN_SQL} SELECT doc_id, CAST(pos AS INTEGER) AS pos, round(weight, 6) AS weight FROM wt")
def _n4(spark, sf):
    return rounded(N.attn_weights(weights_linear(spark, sf), test_padded(spark, sf).select("doc_id", "padded"), "padded"))


@query("attention_entropy", f"WITH {LIN_SQL} SELECT count(*) AS n_rows, round(avg(entropy), 6) AS mean_entropy FROM ent")
def _m10(spark, sf):
    return rounded(M.attention_entropy(weights_linear(spark, sf)))


def _batch_stats(spark, sf):
    batches = split.assign_batches(test_padded(spark, sf).select("doc_id"), 8)
    return M.attention_batch_stats(weights_linear(spark, sf), batches)


@query("attention_max", f"WITH {LIN_SQL} SELECT round(avg(max_weight), 6) AS mean_batch_max_weight FROM bs")
def _m11(spark, sf):
    return rounded(M.attention_max(_batch_stats(spark, sf)))


@query("batch_mean_metrics", f"""WITH {LIN_SQL} SELECT round(avg(entropy), 6) AS mean_of_batch_entropy,
round(arg_max(entropy, batch_id), 6) AS last_batch_entropy, count(*) AS n_batches FROM bs""")
def _m12(spark, sf):
    return rounded(M.batch_mean_metrics(_batch_stats(spark, sf)))
