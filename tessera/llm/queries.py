"""The registered queries of the training-data operators, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (byte_bpe, decontaminate, language_id, lexical_search, license_scan, line_dedup, ngram_join, pii, quality, simhash,
               suffix_dedup, token_store, whitening)
from .common import small_batches, table
from tessera.session import scratch_path


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(simhash.classes(table(spark, sf_dir, "documents"), shingle=4, radius=4))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digests(license_scan.scan(table(spark, sf_dir, "documents")))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(line_dedup.dedup(table(spark, sf_dir, "documents")))


#: The key makes surrogates reproducible; a deployment passes its own secret to pii.replace().
SURROGATE_KEY = b"registered query"


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.replace(table(spark, sf_dir, "documents"), SURROGATE_KEY))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = table(spark, sf_dir, "documents")
    store = token_store.Store.create(docs, scratch_path(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_store.digests(store.read(spark))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return byte_bpe.digests(byte_bpe.decode(encoded, path))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return suffix_dedup.digests(suffix_dedup.dedup(table(spark, sf_dir, "documents"), length=200))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digests(quality.score(table(spark, sf_dir, "documents")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    model = whitening.fit(embeddings, k=8)
    return whitening.digests(whitening.transform(embeddings, model), model)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"), ngram_join.Settings(shingle=4, percent=85))


QUERIES = {f.__name__: f for f in (
    op1_simhash, op2_license_scan, op3_decontaminate, op4_language_id, op5_line_dedup, op6_pii, op7_token_store, op8_byte_bpe,
    op9_suffix_dedup, op10_quality, op11_whitening, op12_lexical_search, op13_ngram_join)}
ORACLES = {"op2_license_scan": license_scan.oracle_sql(), "op10_quality": quality.oracle_sql(),
           "op12_lexical_search": lexical_search.oracle_sql()}
