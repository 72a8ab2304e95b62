"""Language identification by nearest centroid.

A text becomes a unit vector: counts of byte n-grams (1 to 4 bytes of the lower-cased text, hashed to ``dims``
cells), dampened by a logarithm and weighted by inverse document frequency.  Per language, spherical k-means finds a
few centroids; a text gets the language of the centroid with the largest cosine.  A cosine under that centroid's own
limit (a low quantile of its members' cosines, times ``slack``) marks the prediction as rejected: the text is unlike
anything learned, and the nearest language is a guess.

Document frequencies count every training row.  The centroids are fitted on a bounded sample: about
``sample_per_lang`` rows per language, chosen by hash, never more than twice that.  Model size is
languages x ``clusters`` x ``dims`` floats.

Null texts and texts without a letter are ``und`` with score 0.  Rows with null text or label teach nothing.
Without any training row all predictions are ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UND = "und"


@dataclass(frozen=True)
class Settings:
    dims: int = 1 << 13  #: cells of the hashed n-grams, a power of two
    clusters: int = 3  #: centroids per language
    sample_per_lang: int = 1500  #: training rows per language for the centroids
    rounds: int = 8  #: of k-means
    quantile: float = 0.005
    slack: float = 0.8
    seed: int = 5


def counts(text: str, dims: int) -> np.ndarray:
    """Counts of the text's n-grams by cell."""
    data = np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8).astype(np.uint32)
    shift = np.uint32(32 - (dims.bit_length() - 1))
    out = np.bincount((data * np.uint32(0x9E3779B1)) >> shift, minlength=dims)
    gram = data
    for n in range(1, 4):
        if len(data) <= n:
            break
        gram = gram[:-1] * np.uint32(0x01000193) + data[n:] + np.uint32(n)  # wraps
        out += np.bincount((gram * np.uint32(0x9E3779B1)) >> shift, minlength=dims)
    return out


def vector(text: str, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts(text, len(idf))).astype(np.float32) * idf
    return v / max(float(np.sqrt(v @ v)), 1e-12)


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    langs: list[str]  #: of each centroid
    centroids: np.ndarray
    limits: np.ndarray
    idf: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine, whether it is rejected."""
        if not _has_letter(text) or not self.langs:
            return UND, 0.0, True
        cosine = self.centroids @ vector(text, self.idf)
        best = int(cosine.argmax())
        return self.langs[best], float(min(max(cosine[best], 0.0), 1.0)), bool(cosine[best] < self.limits[best])


def _frequencies(dims: int):
    def kernel(batches: Iterator[pa.RecordBatch]):
        seen, n = np.zeros(dims, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen += counts(text, dims) > 0
                n += 1
        cells = [*range(dims), -1]
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array([*seen.tolist(), n], pa.int64())], ["cell", "n"])

    return kernel


def cluster(vectors: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: centroids and their rejection limits."""
    rng = np.random.default_rng(s.seed)
    centers = [vectors[int(rng.integers(len(vectors)))]]
    for _ in range(min(s.clusters, len(vectors)) - 1):  # the farthest row next
        centers.append(vectors[int(np.max(vectors @ np.array(centers).T, axis=1).argmin())])
    centers = np.array(centers)
    for _ in range(s.rounds):
        own = (vectors @ centers.T).argmax(axis=1)
        sums = np.array([vectors[own == k].sum(axis=0) if (own == k).any() else centers[k] for k in range(len(centers))])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    cosine = vectors @ centers.T
    own = cosine.argmax(axis=1)
    limits = np.array([np.quantile(cosine[own == k, k], s.quantile) * s.slack if (own == k).any() else 1.0 for k in range(len(centers))])
    return centers, limits


def fit(train: DataFrame, s: Settings = Settings()) -> Model:
    """Learns from ``doc_id, text, lang``; the driver gets ``dims`` counts and the model."""
    train = train.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    seen = np.zeros(s.dims, np.int64)
    n = 0
    for r in train.select("text").mapInArrow(_frequencies(s.dims), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        if r.cell < 0:
            n = r.n
        else:
            seen[r.cell] = r.n
    idf = np.log((1 + n) / (1 + seen)).astype(np.float32) + 1
    if not n:
        return Model([], np.zeros((0, s.dims), np.float32), np.zeros(0), idf)
    # a hash picks about sample_per_lang rows of each language before any text is shuffled; the rank bounds them
    sizes = train.groupBy("lang").agg(F.count("*").alias("_n"))
    draw = F.xxhash64(F.lit(s.seed), "doc_id", "text")
    share = F.lit(float(s.sample_per_lang)) / F.col("_n")
    picked = (train.withColumn("_draw", draw).join(F.broadcast(sizes), "lang")
              .where(F.pmod("_draw", F.lit(1 << 20)) < share * (1 << 20))
              .withColumn("_rank", F.row_number().over(W.partitionBy("lang").orderBy("_draw", "doc_id")))
              .where(F.col("_rank") <= 2 * s.sample_per_lang).select("lang", "text"))

    def per_language(rows: pd.DataFrame) -> pd.DataFrame:
        vectors = np.array([vector(t, idf) for t in sorted(rows.text) if _has_letter(t)], np.float32)
        if not len(vectors):
            return pd.DataFrame({"lang": [], "centroid": [], "limit": []})
        centers, limits = cluster(vectors, s)
        return pd.DataFrame({"lang": rows.lang.iloc[0], "centroid": [c.astype(np.float32).tobytes() for c in centers], "limit": limits})

    rows = sorted(picked.groupBy("lang").applyInPandas(per_language, "lang string, centroid binary, limit double").collect())
    return Model([r.lang for r in rows], np.array([np.frombuffer(r.centroid, np.float32) for r in rows]).reshape(len(rows), s.dims),
                 np.array([r.limit for r in rows]), idf)


def held_out():
    """Rows that never teach: a quarter, by the checksum of the id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` per row of ``docs``; reads the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batches: Iterator[pa.RecordBatch]):
        m = shared.value
        for batch in batches:
            lang, score, rejected = zip(*map(m.predict, batch.column(2).to_pylist())) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                                              pa.array(rejected, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
            .mapInArrow(kernel, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"))


def identify(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Learns from the rows that are not held out and predicts all."""
    return predict(docs, fit(docs.where(~held_out()), s))
