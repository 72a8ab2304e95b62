"""The stateless text path on a stream of documents (no new operators).

Cleaning (T6/T7), encoding with an already fitted vocabulary (C2) and padding
(C3) keep no state across documents, so each micro-batch runs the batch
operators unchanged through ``foreachBatch``.  Output is written per batch id
with overwrite, so a replayed micro-batch replaces its own output
(exactly-once with the query's checkpoint).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import basic_english_tokens, normalize_placeholders
from ..operators.vocab import encode_tokens, pad_truncate

DOC_STREAM_SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def document_stream(spark: SparkSession, path: str, schema: str = DOC_STREAM_SCHEMA,
                    max_files_per_trigger: int = 1) -> DataFrame:
    """Parquet files arriving in ``path`` as a stream of documents."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)


def encode_batch(docs: DataFrame, vocab: DataFrame, max_len: int = 350) -> DataFrame:
    """One micro-batch: normalise, tokenize, encode (first ``max_len`` positions), pad."""
    toks = docs.select("doc_id", basic_english_tokens(normalize_placeholders("text")).alias("tokens"))
    enc = encode_tokens(toks, "tokens", vocab, max_len=max_len)
    return enc.select("doc_id", pad_truncate("token_ids", max_len).alias("padded"))


def start_encoding(stream: DataFrame, vocab: DataFrame, out_path: str, checkpoint: str,
                   max_len: int = 350, trigger_once: bool = False):
    """Start the streaming job; returns the ``StreamingQuery``."""
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        encode_batch(batch, vocab, max_len).write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
