"""TF-IDF hand vector (V2) and exact stratified quotas."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import split as S, vectorize as V


def test_tfidf_hand_vector(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (2, "aa")], "doc_id long, clean_text string")
    tf = V.term_frequencies(docs)
    vocab = V.fit_idf(V.fit_vocabulary(tf, 5000), docs)
    idf = {r["term"]: r["idf"] for r in vocab.collect()}
    assert idf["aa"] == pytest.approx(1.0) and idf["bb"] == pytest.approx(1.405465, abs=1e-6)
    w = {(r["doc_id"], r["term"]): r["weight"] for r in V.tfidf_vectors(tf, vocab).collect()}
    assert w[(1, "aa")] == pytest.approx(0.579739, abs=1e-6)
    assert w[(1, "bb")] == pytest.approx(0.814802, abs=1e-6)
    assert w[(2, "aa")] == pytest.approx(1.0)


def test_stratified_split_quotas(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(1, 1001)]
    df = spark.createDataFrame(rows, "doc_id long, label string")
    out = S.stratified_split(df, test_pct=20, bucket_hex=1)
    counts = {(r["label"], r["split"]): r["count"] for r in out.groupBy("label", "split").count().collect()}
    assert counts[("a", "test")] + counts[("b", "test")] == 200
    assert out.count() == 1000 and out.select("doc_id").distinct().count() == 1000
    # within a class, train rows are exactly the first ones in hash order
    ranked = out.where("label = 'a'").orderBy(S.seeded_hash("doc_id")).select("split").collect()
    n_train = counts[("a", "train")]
    assert all(r["split"] == "train" for r in ranked[:n_train])
    assert all(r["split"] == "test" for r in ranked[n_train:])


def test_sample_n_exact(spark):
    df = spark.range(500).withColumnRenamed("id", "doc_id")
    assert S.sample_n(df, 100).count() == 100
    b = S.assign_batches(df, 32).groupBy("batch_id").count().orderBy("batch_id").collect()
    assert [r["count"] for r in b] == [32] * 15 + [20]


def test_documents_with_one_id_stay_apart(spark):
    docs = spark.createDataFrame([(1, "aa bb aa"), (1, "aa"), (None, "bb"), (2, ""), (3, None)], "doc_id long, clean_text string").repartition(2)
    tf = V.term_frequencies(docs)
    vocab = V.fit_idf(V.fit_vocabulary(tf, 5000), docs)
    got = sorted(map(repr, ((r["doc_id"], r["term"], r["tf"]) for r in V.count_vectors(tf, vocab).collect())))
    assert got == sorted(map(repr, [(1, "aa", 2), (1, "bb", 1), (1, "aa", 1), (None, "bb", 1)]))
    weights = V.tfidf_vectors(tf, vocab).where("doc_id = 1 and term = 'aa'").select("weight").collect()
    assert sorted(r["weight"] for r in weights)[1] == pytest.approx(1.0) and len(weights) == 2
    assert {r["df"] for r in vocab.collect()} == {2}


def test_batches_of_rows_that_share_an_id(spark):
    df = spark.createDataFrame([(i // 4, f"r{i}") for i in range(40)] + [(None, "x"), (None, "x")], "doc_id long, name string").repartition(3)
    out = S.assign_batches(df, 8).collect()
    assert sorted(r["name"] for r in out) == sorted([f"r{i}" for i in range(40)] + ["x", "x"])
    assert len({(r["batch_id"], r["pos_in_batch"]) for r in out}) == 42
