"""Attention pooling (N1-N4) and word vectors (C7-C10) on hand inputs."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import attention as N, embedding as EM


def seqs(spark):
    return spark.createDataFrame([(1, [5, 6, 1]), (2, [5])], "doc_id long, ids array<int>")


def table(spark):
    rows = [(5, [1.0, 0.0]), (6, [0.0, 1.0]), (1, [0.0, 0.0]), (9000, [2.0, 2.0])]
    return spark.createDataFrame(rows, "token_id int, vector array<double>")


def weights(spark, **more):
    return N.weights_by_token(N.token_counts(seqs(spark), "ids", **more), table(spark), N.linear_score(F.col("vector"), [2.0, 1.0], 0.0))


def test_linear_pool_matches_softmax(spark):
    out = {r["doc_id"]: r for r in N.attn_pool_linear(seqs(spark), "ids", table(spark), [2.0, 1.0], 0.0).collect()}
    e = [math.exp(2.0), math.exp(1.0), math.exp(0.0)]
    w = [x / sum(e) for x in e]
    got = {(r["doc_id"], r["token_id"]): r["weight"] for r in weights(spark).collect()}
    assert [got[1, t] for t in (5, 6, 1)] == pytest.approx(w) and got[2, 5] == pytest.approx(1.0)
    assert out[1]["context"] == pytest.approx([w[0], w[1]]) and out[2]["context"] == pytest.approx([1.0, 0.0])


def test_mask_pad_drops_pad_positions(spark):
    got = {r["token_id"]: r["weight"] for r in weights(spark, mask_pad=True).where("doc_id = 1").collect()}
    assert set(got) == {5, 6} and sum(got.values()) == pytest.approx(1.0)


def test_dot_pool_uses_the_final_position(spark):
    # document 1 ends in the pad: q = 0, all scores are equal
    out = {r["doc_id"]: r["context"] for r in N.attn_pool_dot(seqs(spark), "ids", table(spark), 2).collect()}
    assert out[1] == pytest.approx([1 / 3, 1 / 3]) and out[2] == pytest.approx([1.0, 0.0])
    other = spark.createDataFrame([(3, [5, 1, 6])], "doc_id long, ids array<int>")
    e = [1.0, 1.0, math.e]  # q = [0, 1]
    got = N.attn_pool_dot(other, "ids", table(spark), 2).first()["context"]
    assert got == pytest.approx([e[0] / sum(e), e[2] / sum(e)])


def test_repeated_tokens_and_tail_ids(spark):
    s = spark.createDataFrame([(4, [9000, 5, 5, 9000, 5])], "doc_id long, ids array<int>")
    e = [math.exp(6.0)] * 2 + [math.exp(2.0)] * 3
    w = [x / sum(e) for x in e]
    got = N.attn_pool_linear(s, "ids", table(spark), [2.0, 1.0], 0.0).first()["context"]
    assert got == pytest.approx([2 * (w[0] + w[1]) + sum(w[2:]), 2 * (w[0] + w[1])])


def test_attn_weights_long_form(spark):
    rows = N.attn_weights(weights(spark), seqs(spark), "ids").where("doc_id = 1").collect()
    assert sorted(r["pos"] for r in rows) == [0, 1, 2]
    assert sum(r["weight"] for r in rows) == pytest.approx(1.0)


def test_embed_sequence_keeps_unknown_ids(spark):
    emb = spark.createDataFrame([(0, [7.0]), (5, [1.0])], "token_id int, vector array<double>")
    s = spark.createDataFrame([(1, [5, 77, 5])], "doc_id long, ids array<int>")
    assert {r["pos"]: r["vector"] for r in EM.embed_sequence(s, "ids", emb).collect()} == {0: [1.0], 1: [7.0], 2: [1.0]}


def test_seeded_vectors_are_deterministic_and_scaled(spark):
    df = spark.range(2000).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("token"))
    v = df.select(EM.gaussian_vector(F.col("token"), 8, 0.6).alias("v"))
    a = [r["v"] for r in v.collect()]
    b = [r["v"] for r in v.collect()]
    assert a == b
    xs = [x for vec in a for x in vec]
    mean = sum(xs) / len(xs)
    sd = math.sqrt(sum((x - mean) ** 2 for x in xs) / len(xs))
    assert abs(mean) < 0.03 and abs(sd - 0.6) < 0.03


def test_embedding_join_coverage_and_sequence(spark):
    vocab = spark.createDataFrame([("<unk>", 0), ("<pad>", 1), ("cat", 2), ("Dog", 3)], "token string, token_id int")
    vecs = spark.createDataFrame([("cat", [1.0, 2.0]), ("Dog", [3.0, 4.0]), ("dog", [9.0, 9.0]), ("Dog", [5.0, 0.0])], "token string, vector array<float>")
    emb = EM.embedding_join(vocab, vecs, 2)
    cov = EM.embedding_coverage(emb).first()
    assert (cov["n_found"], cov["n_total"]) == (2, 4)
    seqs = spark.createDataFrame([(7, [2, 3, 1, 1])], "doc_id long, padded array<int>")
    out = {r["pos"]: r["vector"] for r in EM.embed_sequence(seqs, "padded", emb).collect()}
    assert out[0] == [1.0, 2.0] and out[1] == [3.0, 4.0] and out[2] == out[3]
    rnd = {r["token_id"]: r["vector"] for r in EM.random_embedding(vocab, 2).collect()}
    assert rnd[1] == [0.0, 0.0]


def test_pooling_by_blocks(spark, monkeypatch):
    """Rows with one key stay apart, ids without vectors have no weight, and block ends change nothing."""
    from tessera.functions import blocks

    rows = [(1, [5, 6, 5]), (1, [6]), (None, [5, 77]), (2, [77]), (3, []), (4, None), (5, [6, 77])] + [(10 + i, [5] * (i + 1) + [6]) for i in range(40)]
    s = spark.createDataFrame(rows, "doc_id long, ids array<int>").repartition(2)
    whole = sorted(map(repr, map(tuple, N.attn_pool_mlp(s, "ids", table(spark), [[1.0, 0.0]], [0.1], [2.0], 0.0).collect())))
    assert len(whole) == len(rows)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 40)
    cut = sorted(map(repr, map(tuple, N.attn_pool_mlp(s, "ids", table(spark), [[1.0, 0.0]], [0.1], [2.0], 0.0).collect())))
    assert cut == whole
    got = {}
    for r in N.attn_pool_linear(s, "ids", table(spark), [2.0, 1.0], 0.0).collect():
        got.setdefault(r["doc_id"], []).append(r["context"])
    a, b = 2 * math.exp(2.0), math.exp(1.0)
    assert sorted(got[1]) == [pytest.approx([0.0, 1.0]), pytest.approx([a / (a + b), b / (a + b)])]
    assert got[None] == [[1.0, 0.0]] and got[2] == got[3] == got[4] == [None]
    dots = {r["doc_id"]: r["context"] for r in N.attn_pool_dot(s.where("doc_id = 5"), "ids", table(spark), 2).collect()}
    assert dots == {5: None}  # its last id has no vector
    masked = N.attn_pool_dot(spark.createDataFrame([(1, [5, 6, 1])], "doc_id long, ids array<int>"), "ids", table(spark), 2, mask_pad=True)
    assert masked.first()["context"] == pytest.approx([0.5, 0.5])  # the pad asks, with a vector of zeros


def test_lookup_moves_no_values_of_the_head(spark):
    """Rows that the head answers go through the shuffle with the tail; their vectors must not."""
    from tessera.functions.lookup import by_id, head_tail_lookup

    rows = spark.range(100).selectExpr("id doc_id", "cast(id * 97 as int) token_id")
    table = spark.range(8000).selectExpr("cast(id as int) token_id", "array(id * 1.0D) vector")
    found = head_tail_lookup(rows, "token_id", ["doc_id"], *by_id(table), "vector")
    assert {r["doc_id"]: r["vector"] for r in found.collect()} == {i: [i * 97.0] if i * 97 < 8000 else None for i in range(100)}
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [line for line in plan if "Join LeftOuter" in line]
    assert [("_tail" in line) for line in joins] == [False, True, False]  # head's values, tail, head's keys


def test_coverage_writes_no_vectors(spark, monkeypatch):
    from tessera.plans import registry
    from tessera.plans.catalog import QUERIES

    written, write = [], registry.materialize
    monkeypatch.setattr(registry, "materialize", lambda df: (written.append(df.columns), write(df))[1])
    row = QUERIES["embedding_coverage"](spark, "/root/testdata/sf0.001").first()
    assert row["n_total"] > row["n_found"] > 0
    assert written and not any("vector" in columns for columns in written)
