"""Vocabulary, encoding, padding, decoding, labels, global index."""

from pyspark.sql import functions as F

from tessera.functions.indexing import with_global_index
from tessera.operators import vocab as V


def test_build_vocab_order(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b", "c"])], "doc_id long, tokens array<string>")
    got = {r["token"]: r["token_id"] for r in V.build_vocab(df).collect()}
    assert got == {"<unk>": 0, "<pad>": 1, "b": 2, "a": 3, "c": 4}


def test_pad_truncate(spark):
    df = spark.createDataFrame([([5, 6, 7],), ([1, 2, 3, 4, 5, 6],), ([],)], "a array<int>")
    got = [r["p"] for r in df.select(V.pad_truncate("a", 5).alias("p")).collect()]
    assert got == [[5, 6, 7, 1, 1], [1, 2, 3, 4, 5], [1, 1, 1, 1, 1]]


def test_encode_decode_roundtrip(spark):
    docs = spark.createDataFrame([(1, ["x", "y", "x"]), (2, ["z", "q"]), (3, [])],
                                 "doc_id long, tokens array<string>")
    vocab = V.build_vocab(docs.where("doc_id = 1"))
    enc = V.encode_tokens(docs, "tokens", vocab)
    got = {r["doc_id"]: r["token_ids"] for r in enc.collect()}
    assert got == {1: [2, 3, 2], 2: [0, 0], 3: []}
    padded = enc.select("doc_id", V.pad_truncate("token_ids", 4).alias("p"))
    dec = {r["doc_id"]: r["decoded"] for r in V.decode_ids(padded, "p", vocab).collect()}
    assert dec == {1: "x y x", 2: "<unk> <unk>", 3: ""}


def test_pad_to_longest(spark):
    df = spark.createDataFrame([(1, 0, [1, 2, 3]), (2, 0, [4]), (3, 1, [5, 6])], "doc_id long, batch_id long, ids array<int>")
    got = {r["doc_id"]: r["padded"] for r in V.pad_to_longest(df, "ids").collect()}
    assert got == {1: [1, 2, 3], 2: [4, 0, 0], 3: [5, 6]}


def test_label_dictionary_and_unseen(spark):
    import pytest

    df = spark.createDataFrame([("b",), ("a",), ("b",), ("c",)], "label string")
    d = V.label_dictionary(df)
    assert {r["label"]: r["label_idx"] for r in d.collect()} == {"a": 0, "b": 1, "c": 2}
    other = spark.createDataFrame([("a",), ("zz",)], "label string")
    with pytest.raises(Exception):
        V.label_encode(other, d).collect()


def test_global_index_is_consecutive(spark):
    df = spark.range(0, 5000).withColumn("k", F.md5(F.col("id").cast("string")))
    idx = with_global_index(df, [F.col("k")], "i", num_partitions=7)
    rows = idx.orderBy("k").select("i").collect()
    assert [r["i"] for r in rows] == list(range(5000))


def test_global_index_after_shuffle_is_a_permutation(spark):
    # input order inside partitions is not fixed after a shuffle
    df = (spark.range(0, 20000).withColumn("g", F.col("id") % 997).groupBy("g")
          .agg(F.count(F.lit(1)).alias("c"), F.max("id").alias("m")))
    idx = with_global_index(df, [F.col("c").desc(), F.col("g")], "i", num_partitions=5)
    got = [r["i"] for r in idx.orderBy(F.col("c").desc(), "g").collect()]
    assert got == list(range(997))


def test_scan_partitions_is_an_explicit_setting(spark):
    from tessera.sources.tables import SCAN_PARTITIONS, read_table

    plain = read_table(spark, "/root/testdata/sf0.001", "documents")
    assert "Exchange" not in plain._jdf.queryExecution().executedPlan().toString()
    spark.conf.set(SCAN_PARTITIONS, "5")
    try:
        dealt = read_table(spark, "/root/testdata/sf0.001", "documents")
        assert dealt.count() == plain.count() and "Exchange" in dealt._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(SCAN_PARTITIONS)


def test_repeated_ids_stay_rows_and_nothing_is_merged(spark):
    """Rows that share an id, or repeat, come back one for one from encoding and decoding."""
    rows = [(1, ["a", "b"]), (1, ["b", "a", None]), (1, ["a", "b"]), (None, ["c"]), (2, []), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(3)
    vocab = spark.createDataFrame([("<unk>", 0), ("<pad>", 1), ("a", 2), ("b", 3)], "token string, token_id int")
    enc = V.encode_tokens(docs, "tokens", vocab)
    assert sorted(map(repr, map(tuple, enc.collect()))) == sorted(map(repr, [
        (1, [2, 3]), (1, [3, 2, 0]), (1, [2, 3]), (None, [0]), (2, []), (2, [])]))
    back = V.decode_ids(enc, "token_ids", vocab)
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, [
        (1, "a b"), (1, "b a <unk>"), (1, "a b"), (None, "<unk>"), (2, ""), (2, "")]))


def test_blocks_cut_long_arrays_and_positions_are_not_shuffled(spark, monkeypatch):
    from tessera.functions import blocks

    monkeypatch.setattr(blocks, "BLOCK_BYTES", 2000)
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.struct(F.lit("x").alias("extra")).alias("more"),
                                   F.expr("transform(sequence(0, cast(id % 90 as int)), i -> concat('w', (i * id) % 37))").alias("tokens"))
    vocab = V.build_vocab(docs)
    packed = blocks.pack(docs, "tokens")
    assert packed.count() > 20
    enc = V.encode_tokens(docs, "tokens", vocab)
    ids = {r["token"]: r["token_id"] for r in vocab.collect()}
    want = {r["doc_id"]: [ids[t] for t in r["tokens"]] for r in docs.collect()}
    got = enc.collect()
    assert {r["doc_id"]: r["token_ids"] for r in got} == want and len(got) == 200 and got[0]["more"]["extra"] == "x"
    # what is exploded are words of blocks: fewer rows than positions
    assert blocks.words(packed, "token").count() < sum(map(len, want.values())) / 2


def test_from_csv_to_padded_ids_with_repeated_rows(spark, tmp_path):
    from tessera.functions.text import basic_english_tokens, normalize_placeholders
    from tessera.sources import files

    text = 'A "quoted" text,\nwith lines. And more'
    rows = [(text, "x"), (text, "x"), ("other, text", "y"), (text, "x"), ("", "y")]
    files.write_csv(spark.createDataFrame(rows, "abstract string, label string").coalesce(1), str(tmp_path / "c"))
    docs = files.scan_documents(spark, str(tmp_path / "c")).withColumn("tokens", basic_english_tokens(normalize_placeholders(F.coalesce("text", F.lit("")))))
    vocab = V.build_vocab(docs)
    padded = V.encode_tokens(docs, "tokens", vocab).select("label", V.pad_truncate("token_ids", 12).alias("p")).collect()
    assert len(padded) == 5 and sum(1 for r in padded if r["label"] == "x") == 3
    assert len({tuple(r["p"]) for r in padded if r["label"] == "x"}) == 1
