"""Registered queries: text functions (T), filters (B1-B2), splits (S), profiling (P).

Input: ``documents`` with label := ``lang`` (and ``labels`` for B1).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import filters, profile, split, text_ops
from ..sources.tables import labelled_documents, read_table
from . import sqlparts as q
from .registry import query, rounded, shared

DOCS = q.docs_cte()
SPLITS = DOCS + "," + q.split_ctes()
UNION = SPLITS + """,
u AS (SELECT 'full' AS split, doc_id, text, label FROM docs
      UNION ALL SELECT split, doc_id, text, label FROM splits)"""


def docs(spark, sf):
    return labelled_documents(spark, sf)


def split_docs(spark, sf):
    return split.stratified_split(docs(spark, sf))


def union_docs(spark, sf):
    return profile.union_splits(docs(spark, sf), split_docs(spark, sf))


# ---------------------------------------------------------------- text (T)

@query("clean_strip", f"WITH {DOCS} SELECT doc_id, {q.clean_strip('text')} AS clean_text FROM docs")
def _clean_strip(spark, sf):
    return docs(spark, sf).select("doc_id", tx.clean_strip("text").alias("clean_text"))


@query("word_tokenize", f"""WITH {DOCS}, t AS (SELECT doc_id, {q.word_tokenize(q.clean_strip('text'))} AS toks FROM docs)
SELECT doc_id, array_to_string(toks, ' ') AS tokens, len(toks) AS n_tokens FROM t""")
def _word_tokenize(spark, sf):
    toks = tx.word_tokenize(tx.clean_strip("text"))
    return docs(spark, sf).select("doc_id", F.array_join(toks, " ").alias("tokens"),
                                  F.size(toks).cast("bigint").alias("n_tokens"))


@query("remove_stopwords", f"""WITH {DOCS}, t AS (SELECT doc_id, {q.clean_tokens('text')} AS toks FROM docs)
SELECT doc_id, array_to_string(toks, ' ') AS tokens, len(toks) AS n_tokens FROM t""")
def _remove_stopwords(spark, sf):
    toks = tx.clean_tokens("text")
    return docs(spark, sf).select("doc_id", F.array_join(toks, " ").alias("tokens"),
                                  F.size(toks).cast("bigint").alias("n_tokens"))


_LEMMA_SQL = f"""WITH {DOCS},
t AS (SELECT doc_id, {q.clean_tokens('text')} AS toks FROM docs),
pos AS (SELECT doc_id, unnest(range(len(toks))) AS p, unnest(toks) AS token FROM t),
vocab AS (SELECT DISTINCT token FROM pos),
rules(r, old, new) AS (VALUES {q.noun_rules_values()}),
cand AS (SELECT v.token, r.r, left(v.token, length(v.token) - length(r.old)) || r.new AS base
         FROM vocab v JOIN rules r ON suffix(v.token, r.old) AND length(v.token) > length(r.old)),
known AS (SELECT c.* FROM cand c WHERE c.base IN (SELECT token FROM vocab)),
best AS (SELECT token, arg_min(base, length(base) * 100 + r) AS lemma, min(length(base)) AS len
         FROM known GROUP BY token),
exc(token, lemma) AS (VALUES {q.irregular_values()}),
lem AS (SELECT token, lemma FROM best WHERE len < length(token) AND token NOT IN (SELECT token FROM exc) UNION ALL SELECT token, lemma FROM exc),
mapped AS (SELECT p.doc_id, p.p, coalesce(l.lemma, p.token) AS tok FROM pos p LEFT JOIN lem l USING (token))
SELECT d.doc_id, coalesce(string_agg(m.tok, ' ' ORDER BY m.p), '') AS clean_text
FROM t d LEFT JOIN mapped m USING (doc_id) GROUP BY d.doc_id"""


@query("lemmatize_nouns", _LEMMA_SQL)
def _lemmatize(spark, sf):
    return text_ops.prepare_text(docs(spark, sf), lem=True).select("doc_id", "clean_text")


@query("prepare_text", f"WITH {DOCS} SELECT doc_id, array_to_string({q.clean_tokens('text')}, ' ') AS clean_text FROM docs")
def _prepare_text(spark, sf):
    return text_ops.prepare_text(docs(spark, sf), lem=False).select("doc_id", "clean_text")


@query("normalize_placeholders", f"WITH {DOCS} SELECT doc_id, {q.normalize('text')} AS norm_text FROM docs")
def _normalize(spark, sf):
    return docs(spark, sf).select("doc_id", tx.normalize_placeholders("text").alias("norm_text"))


@query("basic_english_tokens", f"""WITH {DOCS}, t AS (SELECT doc_id, {q.basic_english(q.normalize('text'))} AS toks FROM docs)
SELECT doc_id, array_to_string(toks, ' ') AS tokens, len(toks) AS n_tokens FROM t""")
def _basic_english(spark, sf):
    toks = tx.basic_english_tokens(tx.normalize_placeholders("text"))
    return docs(spark, sf).select("doc_id", F.array_join(toks, " ").alias("tokens"),
                                  F.size(toks).cast("bigint").alias("n_tokens"))


@query("whitespace_tokens", f"WITH {DOCS} SELECT doc_id, {q.token_count('text')} AS n_tokens FROM docs")
def _whitespace(spark, sf):
    return docs(spark, sf).select("doc_id", tx.token_count("text").cast("bigint").alias("n_tokens"))


@query("alpha_tokens", f"""WITH {DOCS}, t AS (SELECT doc_id, {q.alpha_tokens('text')} AS toks FROM docs)
SELECT doc_id, array_to_string(toks, ' ') AS tokens, len(toks) AS n_tokens FROM t""")
def _alpha(spark, sf):
    toks = tx.alpha_tokens("text")
    return docs(spark, sf).select("doc_id", F.array_join(toks, " ").alias("tokens"),
                                  F.size(toks).cast("bigint").alias("n_tokens"))


@query("vectorizer_tokens", f"""WITH {DOCS}, t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS toks FROM docs)
SELECT doc_id, array_to_string(toks, ' ') AS tokens, len(toks) AS n_tokens FROM t""")
def _vectorizer_tokens(spark, sf):
    toks = tx.vectorizer_tokens("text")
    return docs(spark, sf).select("doc_id", F.array_join(toks, " ").alias("tokens"),
                                  F.size(toks).cast("bigint").alias("n_tokens"))


@query("truncate_tokens", f"""WITH {DOCS}, t AS (SELECT doc_id, {q.basic_english(q.normalize('text'))} AS toks FROM docs)
SELECT doc_id, array_to_string(toks[1:40], ' ') AS tokens FROM t""")
def _truncate(spark, sf):
    toks = tx.truncate_tokens(tx.basic_english_tokens(tx.normalize_placeholders("text")), 40)
    return docs(spark, sf).select("doc_id", F.array_join(toks, " ").alias("tokens"))


# ---------------------------------------------------------------- filters (B1, B2)

_JOINED = """j AS (SELECT d.doc_id, d.text, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"""


def _joined(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "text", "lang")
    lab = read_table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    return d.join(lab, "doc_id", "left")


@query("drop_null_rows", f"""WITH {_JOINED}
SELECT * FROM j WHERE doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL""")
def _drop_null(spark, sf):
    return filters.drop_null_rows(_joined(spark, sf))


@query("project_xy", f"""WITH {_JOINED}
SELECT doc_id, text, quality AS label FROM j WHERE doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL""")
def _project_xy(spark, sf):
    clean = filters.drop_null_rows(_joined(spark, sf)).withColumnRenamed("quality", "label")
    x, y = filters.project_xy(clean, text_col="text", label_col="label")
    return x.join(y, "doc_id")


# ---------------------------------------------------------------- splits (S)

@query("stratified_split", f"WITH {SPLITS} SELECT doc_id, label, split FROM splits")
def _stratified(spark, sf):
    return split_docs(spark, sf).select("doc_id", "label", "split")


@query("sample_n", f"WITH {DOCS} SELECT doc_id, label FROM docs ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100")
def _sample(spark, sf):
    return split.sample_n(docs(spark, sf), 100).select("doc_id", "label")


@query("assign_batches", f"""WITH {DOCS}, r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS i FROM docs)
SELECT doc_id, i // 32 AS batch_id, CAST(i % 32 AS INTEGER) AS pos_in_batch FROM r""")
def _batches(spark, sf):
    return split.assign_batches(docs(spark, sf).select("doc_id"), 32, shuffle=True) \
        .select("doc_id", "batch_id", "pos_in_batch")


# ---------------------------------------------------------------- profiling (P)

@query("union_splits", f"WITH {UNION} SELECT split, doc_id, label FROM u")
def _union(spark, sf):
    return union_docs(spark, sf).select("split", "doc_id", "label")


@query("class_distribution", f"""WITH {UNION}, c AS (SELECT split, label, count(*) AS n FROM u GROUP BY split, label)
SELECT split, label, n, round(100.0 * n / sum(n) OVER (PARTITION BY split), 6) AS pct FROM c""")
def _class_dist(spark, sf):
    return rounded(profile.class_distribution(split_docs(spark, sf), total="full"))


@query("table_profile", """SELECT a.n_rows, v.ordinal, v.column_name, v.data_type,
  CASE v.ordinal WHEN 0 THEN a.c0 WHEN 1 THEN a.c1 WHEN 2 THEN a.c2 WHEN 3 THEN a.c3 ELSE a.c4 END AS non_null
FROM (SELECT count(*) AS n_rows, count(doc_id) AS c0, count(text) AS c1, count(lang) AS c2,
             count(source) AS c3, count(n_chars) AS c4 FROM documents) a,
     (VALUES (0, 'doc_id', 'bigint'), (1, 'text', 'string'), (2, 'lang', 'string'),
             (3, 'source', 'string'), (4, 'n_chars', 'bigint')) v(ordinal, column_name, data_type)""")
def _table_profile(spark, sf):
    return profile.table_profile(read_table(spark, sf, "documents"))


@query("table_head", "SELECT doc_id, text, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 5")
def _table_head(spark, sf):
    return profile.table_head(read_table(spark, sf, "documents"), "doc_id", 5)


@query("distinct_labels", f"WITH {DOCS} SELECT count(DISTINCT label) AS n_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM docs")
def _distinct_labels(spark, sf):
    return profile.distinct_labels(docs(spark, sf))


@query("token_length_stats", f"""WITH {UNION}
SELECT split, round(avg({q.token_count('text')}), 6) AS mean_tokens, round(median({q.token_count('text')}), 6) AS median_tokens FROM u GROUP BY split""")
def _length_stats(spark, sf):
    return rounded(profile.token_length_stats(split_docs(spark, sf), total="full"))


@query("token_length_histogram", f"""WITH {UNION},
l AS (SELECT split, {q.token_count('text')} AS x FROM u),
s AS (SELECT split, min(x) AS mn, max(x) AS mx FROM l GROUP BY split),
b AS (SELECT l.split, CASE WHEN s.mx = s.mn THEN 25 ELSE least((l.x - s.mn) * 50 // (s.mx - s.mn), 49) END AS bin, count(*) AS n
      FROM l JOIN s USING (split) GROUP BY ALL),
g AS (SELECT split, mn, mx, unnest(range(50)) AS bin FROM s)
SELECT g.split, CAST(g.bin AS INTEGER) AS bin,
       round(CASE WHEN mx = mn THEN mn - 0.5 ELSE mn END + g.bin * (CASE WHEN mx = mn THEN 1.0 ELSE (mx - mn)::DOUBLE END / 50), 6) AS bin_lo,
       round(CASE WHEN mx = mn THEN mn - 0.5 ELSE mn END + (g.bin + 1) * (CASE WHEN mx = mn THEN 1.0 ELSE (mx - mn)::DOUBLE END / 50), 6) AS bin_hi,
       coalesce(b.n, 0) AS n
FROM g LEFT JOIN b USING (split, bin)""")
def _length_hist(spark, sf):
    return rounded(profile.token_length_histogram(split_docs(spark, sf), total="full"))


@query("avg_length_per_label", f"WITH {DOCS} SELECT label, round(avg({q.token_count('text')}), 6) AS avg_tokens FROM docs GROUP BY label")
def _avg_len(spark, sf):
    return rounded(profile.avg_length_per_label(docs(spark, sf)))


@query("word_frequency", f"""WITH {UNION}, t AS (SELECT split, unnest({q.alpha_tokens('text')}) AS token FROM u)
SELECT split, token, count(*) AS n FROM t GROUP BY split, token""")
def _word_freq(spark, sf):
    return profile.word_frequency(split_docs(spark, sf), total="full")


@query("vocabulary_size", f"WITH {DOCS} SELECT count(DISTINCT tok) AS vocabulary_size FROM (SELECT unnest({q.nonempty_split('text')}) AS tok FROM docs)")
def _vocab_size(spark, sf):
    return profile.vocabulary_size(docs(spark, sf))


@query("rare_word_share", f"""WITH {DOCS}, c AS (SELECT tok, count(*) AS n FROM (SELECT unnest({q.nonempty_split('text')}) AS tok FROM docs) GROUP BY tok)
SELECT count(*) FILTER (WHERE n = 1) AS n_rare, count(*) AS n_distinct,
       round(100.0 * count(*) FILTER (WHERE n = 1) / count(*), 6) AS rare_pct FROM c""")
def _rare(spark, sf):
    return rounded(profile.rare_word_share(docs(spark, sf)))


@query("top_tokens_per_class", f"""WITH {DOCS}, t AS (SELECT label, unnest({q.alpha_tokens('text')}) AS token FROM docs),
c AS (SELECT label, token, count(*) AS n FROM t GROUP BY label, token),
r AS (SELECT label, token, n, CAST(row_number() OVER (PARTITION BY label ORDER BY n DESC, token) AS INTEGER) AS rank FROM c)
SELECT label, token, n, rank FROM r WHERE rank <= 10""")
def _top_tokens(spark, sf):
    return profile.top_tokens_per_class(docs(spark, sf)).select("label", "token", "n", "rank")


@query("duplicate_rows", """SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS n_duplicates
FROM (SELECT text, lang, count(*) AS c FROM documents GROUP BY text, lang)""")
def _dups(spark, sf):
    return profile.duplicate_rows(read_table(spark, sf, "documents").select("text", "lang"))
