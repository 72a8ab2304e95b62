"""Word vectors (C7-C10): vocabulary x pretrained vectors, deterministic fallbacks.

Random vectors use Box-Muller on md5-derived uniforms of ``seed:token:i``:
the same token gets the same vector on every executor and in every rerun
(a lost task recomputes identical values), and SQL engines can reproduce it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lookup import by_id, head_tail_lookup

_TWO52 = float(2 ** 52)


def _uniform(h: Column, start: int) -> Column:
    """(0, 1) uniform from 13 hex digits of an md5 string."""
    return (F.conv(F.substring(h, start, 13), 16, 10).cast("double") + 0.5) / _TWO52


def gaussian_vector(key: Column, dim: int, scale: float = 1.0, seed: int = 42) -> Column:
    """``dim`` N(0, scale^2) draws keyed by ``key`` (array<double>)."""
    def draw(i):
        h = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"), F.lit(":"), i.cast("string")))
        return scale * F.sqrt(-2.0 * F.log(_uniform(h, 1))) * F.cos(2.0 * math.pi * _uniform(h, 14))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), draw)


def embedding_join(vocab: DataFrame, vectors: DataFrame, dim: int, scale: float = 0.6,
                   seed: int = 42) -> DataFrame:
    """Per vocabulary token its pretrained vector, else a seeded N(0, scale^2) vector.

    A token is found if the vector table holds exactly that token; of repeated lines of a token the smallest vector
    counts, so that reruns agree.  Specials are treated like any other token (the pad row is not zeroed).

    The vocabulary is asked first: a semi-join drops the lines of tokens it lacks, so their vectors are neither cast nor
    aggregated.  ``scan_vectors(..., tokens=vocab)`` drops them before they are parsed.
    """
    asked = vectors.select("token", "vector").join(vocab.select("token"), "token", "left_semi")
    vec = asked.groupBy(F.col("token").alias("_k")).agg(F.min(F.col("vector").cast("array<double>")).alias("_v"))
    j = vocab.select("token_id", "token").join(vec, vocab["token"] == vec["_k"], "left")
    return j.select("token_id", "token", F.col("_v").isNotNull().alias("found"),
                    F.coalesce("_v", gaussian_vector(F.col("token"), dim, scale, seed)).alias("vector"))


def embedding_coverage(emb: DataFrame) -> DataFrame:
    """Tokens with a pretrained vector / all tokens."""
    return emb.agg(F.count_if("found").alias("n_found"), F.count(F.lit(1)).alias("n_total")) \
        .withColumn("coverage", F.col("n_found") / F.col("n_total"))


def random_embedding(vocab: DataFrame, dim: int, pad_id: int = 1, seed: int = 42) -> DataFrame:
    """N(0, 1) vectors for every token, the pad row all zeros."""
    zeros = F.array_repeat(F.lit(0.0), dim)
    return vocab.select("token_id", "token", F.when(F.col("token_id") == pad_id, zeros)
                        .otherwise(gaussian_vector(F.col("token"), dim, 1.0, seed)).alias("vector"))


def embed_sequence(seqs: DataFrame, ids_col: str, emb: DataFrame, key: str = "doc_id", unk_id: int = 0) -> DataFrame:
    """Id sequences -> long ``(key, pos, token_id, vector)`` rows (model input).

    Every position stays: an id without a vector takes that of ``unk_id``.  Frequent ids, pads among them, are answered
    from the broadcast head of the table.
    """
    ex = seqs.select(key, F.posexplode(ids_col).alias("pos", "token_id"))
    table = emb.select("token_id", "vector")
    unknown = table.where(F.col("token_id") == unk_id).select(F.col("vector").alias("_unk"))  # one row
    found = head_tail_lookup(ex, "token_id", [key, "pos"], *by_id(table), "vector")
    return found.withColumn("vector", F.coalesce("vector", unknown.scalar())).select(key, "pos", "token_id", "vector")
