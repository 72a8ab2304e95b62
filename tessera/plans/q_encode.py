"""Registered queries: vocabulary/encoding (C1-C6) and vectorization (V1-V3).

The sequence path follows the reference: placeholder normalisation (T6) ->
basic_english tokens (T7) -> vocabulary from the train split (C1) -> test
split encoded with the train vocabulary (C2) -> padded to 350 (C3).
The bag-of-words path: prepare_text (T5) -> vectorizer tokens (T10) ->
vocabulary/idf fitted on train (V1/V2) -> applied to test (V3).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import basic_english_tokens, normalize_placeholders
from ..operators import split, text_ops, vectorize, vocab
from . import sqlparts as q
from .q_corpus import SPLITS, split_docs
from .registry import query, rounded, shared

MAX_LEN = 350


def seq_tokens(spark, sf):
    return split_docs(spark, sf).withColumn(
        "tokens", basic_english_tokens(normalize_placeholders("text"))).drop("text")


@shared
def train_vocab(spark, sf):
    return vocab.build_vocab(seq_tokens(spark, sf).where(F.col("split") == "train"), "tokens")


@shared
def test_encoded(spark, sf, max_len=None):
    test = seq_tokens(spark, sf).where(F.col("split") == "test").select("doc_id", "label", "tokens")
    return vocab.encode_tokens(test, "tokens", train_vocab(spark, sf), max_len=max_len)


@shared
def test_padded(spark, sf):
    enc = test_encoded(spark, sf, max_len=MAX_LEN)
    return enc.select("doc_id", "label", vocab.pad_truncate("token_ids", MAX_LEN).alias("padded"))


def ids_text(col):
    return F.array_join(F.transform(col, lambda x: x.cast("string")), " ")


SEQ = SPLITS + f""",
st AS (SELECT doc_id, label, split, {q.basic_english(q.normalize('text'))} AS toks FROM splits),
cnt AS (SELECT tok AS token, count(*) AS freq FROM (SELECT unnest(toks) AS tok FROM st WHERE split = 'train')
        WHERE tok NOT IN ('<unk>', '<pad>') GROUP BY tok),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY freq DESC, token) + 1 AS INTEGER) AS token_id, freq FROM cnt
          UNION ALL SELECT '<unk>', 0, 0 UNION ALL SELECT '<pad>', 1, 0),
tpos AS (SELECT doc_id, unnest(range(len(toks))) AS p, unnest(toks) AS token FROM st WHERE split = 'test'),
enc AS (SELECT t.doc_id, t.p, coalesce(v.token_id, 0) AS id FROM tpos t LEFT JOIN vocab v USING (token)),
encl AS (SELECT s.doc_id, s.label, coalesce(list(e.id ORDER BY e.p) FILTER (WHERE e.id IS NOT NULL), []) AS ids
         FROM st s LEFT JOIN enc e USING (doc_id) WHERE s.split = 'test' GROUP BY s.doc_id, s.label),
padded AS (SELECT doc_id, label, list_concat(ids[1:{MAX_LEN}],
                  list_transform(range(greatest(0, {MAX_LEN} - len(ids))), lambda x: 1)) AS ids FROM encl)"""


@query("build_vocab", f"WITH {SEQ} SELECT token, token_id, freq FROM vocab")
def _build_vocab(spark, sf):
    return train_vocab(spark, sf)


@query("encode_tokens", f"WITH {SEQ} SELECT doc_id, array_to_string(ids, ' ') AS encoded, len(ids) AS n_tokens FROM encl")
def _encode(spark, sf):
    enc = test_encoded(spark, sf)
    return enc.select("doc_id", ids_text("token_ids").alias("encoded"), F.size("token_ids").cast("bigint").alias("n_tokens"))


@query("pad_truncate", f"WITH {SEQ} SELECT doc_id, array_to_string(ids, ' ') AS padded, len(ids) AS length FROM padded")
def _pad(spark, sf):
    return test_padded(spark, sf).select("doc_id", ids_text("padded").alias("padded"),
                                         F.size("padded").cast("bigint").alias("length"))


@query("pad_to_longest", f"""WITH {SEQ},
b AS (SELECT doc_id, ids, (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS batch_id FROM encl),
m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS longest FROM b)
SELECT doc_id, batch_id, array_to_string(list_concat(ids, list_transform(range(longest - len(ids)), lambda x: 0)), ' ') AS padded,
       longest AS length FROM m""")
def _pad_longest(spark, sf):
    batched = split.assign_batches(test_encoded(spark, sf), 8, key_col="doc_id")
    out = vocab.pad_to_longest(batched, "token_ids", "batch_id", pad_id=0)
    return out.select("doc_id", "batch_id", ids_text("padded").alias("padded"), F.size("padded").cast("bigint").alias("length"))


@query("decode_ids", f"""WITH {SEQ},
pp AS (SELECT doc_id, unnest(range(len(ids))) AS p, unnest(ids) AS token_id FROM padded),
dec AS (SELECT pp.doc_id, pp.p, coalesce(v.token, '<unk>') AS tok FROM pp LEFT JOIN vocab v USING (token_id) WHERE pp.token_id <> 1)
SELECT p.doc_id, coalesce(string_agg(d.tok, ' ' ORDER BY d.p), '') AS decoded FROM padded p LEFT JOIN dec d USING (doc_id) GROUP BY p.doc_id""")
def _decode(spark, sf):
    return vocab.decode_ids(test_padded(spark, sf).select("doc_id", "padded"), "padded", train_vocab(spark, sf))


@query("label_encode", f"""WITH {SPLITS}
SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_idx FROM (SELECT DISTINCT label FROM splits WHERE split = 'train')""")
def _label_encode(spark, sf):
    return vocab.label_dictionary(split_docs(spark, sf).where(F.col("split") == "train"))


# ---------------------------------------------------------------- vectorization (V)

def bow(spark, sf):
    """(doc_id, split, clean_text) with T5 cleaning (no lemmatization)."""
    return text_ops.prepare_text(split_docs(spark, sf), lem=False).select("doc_id", "split", "clean_text")


@shared
def train_tf(spark, sf):
    """Term counts of the train split, read by both the vocabulary fit and the weighting."""
    return vectorize.term_frequencies(bow(spark, sf).where(F.col("split") == "train"))


def fitted(spark, sf, max_features=5000):
    b = bow(spark, sf)
    train = b.where(F.col("split") == "train")
    tf_train = train_tf(spark, sf)
    v = vectorize.fit_idf(vectorize.fit_vocabulary(tf_train, max_features), train)
    return b, tf_train, v


BOW = SPLITS + f""",
pt AS (SELECT doc_id, split, array_to_string({q.clean_tokens('text')}, ' ') AS clean FROM splits),
terms AS (SELECT doc_id, split, unnest(regexp_extract_all(lower(clean), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM pt),
tf AS (SELECT doc_id, split, term, count(*) AS tf FROM terms GROUP BY ALL),
ttot AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf WHERE split = 'train' GROUP BY term),
top AS (SELECT term, df FROM ttot ORDER BY total DESC, term LIMIT 5000),
ntr AS (SELECT count(*) AS n FROM pt WHERE split = 'train'),
vi AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_index,
              ln((1 + n) / (1 + df)) + 1 AS idf FROM top, ntr),
w AS (SELECT tf.doc_id, tf.split, vi.term_index, tf.term, tf.tf, tf.tf * vi.idf AS w FROM tf JOIN vi USING (term))"""


@query("count_vectors", f"WITH {BOW} SELECT doc_id, term_index, term, tf FROM w WHERE split = 'train'")
def _count_vectors(spark, sf):
    _, tf_train, v = fitted(spark, sf)
    return vectorize.count_vectors(tf_train, v)


_TFIDF_SQL = """SELECT doc_id, term_index, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight
FROM w WHERE split = '{split}'"""


@query("tfidf_vectors", f"WITH {BOW} " + _TFIDF_SQL.format(split="train"))
def _tfidf(spark, sf):
    _, tf_train, v = fitted(spark, sf)
    return rounded(vectorize.tfidf_vectors(tf_train, v))


@query("vectorize_heldout", f"WITH {BOW} " + _TFIDF_SQL.format(split="test"))
def _heldout(spark, sf):
    b, _, v = fitted(spark, sf)
    tf_test = vectorize.term_frequencies(b.where(F.col("split") == "test"))
    return rounded(vectorize.tfidf_vectors(tf_test, v))
