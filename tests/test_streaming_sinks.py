"""Streaming encoder (micro-batches through the batch operators) and sink round trips."""

import tempfile

from pyspark.sql import functions as F

from tessera.operators import vocab as V
from tessera.sources import files
from tessera.streaming import text_stream as S
from conftest import SF001


def test_stream_encoding_matches_batch(spark):
    src = tempfile.mkdtemp(prefix="tessera-stream-src-")
    docs = spark.read.parquet(f"{SF001}/documents.parquet").limit(40)
    docs.write.mode("overwrite").parquet(src + "/part1")
    toks = docs.select("doc_id", S.basic_english_tokens(S.normalize_placeholders("text")).alias("tokens"))
    vocab = V.build_vocab(toks, "tokens")
    out = tempfile.mkdtemp(prefix="tessera-stream-out-")
    ckpt = tempfile.mkdtemp(prefix="tessera-stream-ckpt-")
    q = S.start_encoding(S.document_stream(spark, src + "/part1"), vocab, out, ckpt, max_len=50, trigger_once=True)
    q.awaitTermination(120)
    streamed = {r["doc_id"]: r["padded"] for r in spark.read.parquet(out).collect()}
    batch = {r["doc_id"]: r["padded"] for r in S.encode_batch(docs, vocab, 50).collect()}
    assert streamed == batch and len(streamed) == 40
    assert all(len(p) == 50 for p in streamed.values())


def test_metrics_csv_and_artifacts_round_trip(spark):
    root = tempfile.mkdtemp(prefix="tessera-sink-")
    df = spark.createDataFrame([("m1", 0.5, "N/A"), ("m2", 0.25, "1.5")], "Model string, `Macro-F1` double, Entropy string")
    files.sink_metrics(df, root)
    back = files.csv_reader(spark, "Model STRING, `Macro-F1` DOUBLE, Entropy STRING").csv(f"{root}/csv")
    assert sorted(map(tuple, back.collect())) == [("m1", 0.5, "N/A"), ("m2", 0.25, "1.5")]
    assert spark.read.json(f"{root}/json").count() == 2
    files.save_artifacts({"labels": df.select("Model")}, root + "/art")
    assert files.load_artifacts(spark, root + "/art", ("labels",))["labels"].count() == 2


def test_csv_documents_keep_newlines_and_quotes(spark):
    root = tempfile.mkdtemp(prefix="tessera-docs-")
    df = spark.createDataFrame([(1, 'line one\nline "two"', "a"), (2, "  padded  ", "b")],
                               "doc_id long, abstract string, label string")
    files.write_csv(df, root)
    back = files.scan_documents(spark, root, "doc_id BIGINT, abstract STRING, label STRING")
    got = {r["doc_id"]: r["text"] for r in back.collect()}
    assert got == {1: 'line one\nline "two"', 2: "  padded  "}
