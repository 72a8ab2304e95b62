"""Attention pooling (N1-N4): by blocks of documents (contexts) and by token (weights).

Contexts (N1-N3) are matrix products of a block: the counts of its documents' tokens, and the vectors of its distinct
tokens.  Weights alone (N4, and the entropies of M10-M12) need no vector per document: each vocabulary row is scored
once and a document is the counts of its tokens.  Scorer parameters are plain arrays (learning them is the model's job,
not this engine's).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blocks
from ..functions.arrays import dot
from ..functions.lookup import by_id, head_tail_lookup


def _lit_vec(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def linear_score(vector: Column, w: Sequence[float], b: float) -> Column:
    """N1 scorer: w . x + b."""
    return dot(vector, _lit_vec(w)) + F.lit(float(b))


def mlp_score(vector: Column, w1: Sequence[Sequence[float]], b1: Sequence[float],
              w2: Sequence[float], b2: float) -> Column:
    """N3 scorer: w2 . tanh(W1 x + b1) + b2."""
    hidden = F.array(*[F.tanh(dot(vector, _lit_vec(row)) + F.lit(float(bj))) for row, bj in zip(w1, b1)])
    return dot(hidden, _lit_vec(w2)) + F.lit(float(b2))


def token_counts(seqs: DataFrame, ids_col: str, key: str = "doc_id", pad_id: int | None = 1,
                 mask_pad: bool = False) -> DataFrame:
    """``(key, token_id, n)``: how often each id stands in a sequence.  ``mask_pad`` leaves pads out."""
    ids = F.filter(ids_col, lambda i: i != pad_id) if mask_pad and pad_id is not None else F.col(ids_col)
    return seqs.select(key, F.explode(ids).alias("token_id")).groupBy(key, "token_id").agg(F.count(F.lit(1)).alias("n"))


def _softmax(scored: DataFrame, key: str) -> DataFrame:
    """``(key, token_id, n, weight)``: the weight that each of a token's n positions has."""
    doc = Window.partitionBy(key)
    e = scored.withColumn("_e", F.exp(F.col("score") - F.max("score").over(doc)))
    return e.withColumn("weight", F.col("_e") / F.sum(F.col("n") * F.col("_e")).over(doc)).select(key, "token_id", "n", "weight")


def weights_by_token(counts: DataFrame, table: DataFrame, score: Column, key: str = "doc_id") -> DataFrame:
    """Softmax over positions of ``score``, an expression over the table's ``vector``."""
    scores = table.select("token_id", score.alias("score"))
    return _softmax(head_tail_lookup(counts, "token_id", [key, "token_id"], *by_id(scores), "score"), key)


# -- pooling by blocks -----------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Scorer:
    """Scores of a document's distinct tokens (rows of a matrix), given the vector at its last position."""

    scores: Callable[[np.ndarray, np.ndarray | None], np.ndarray]
    needs_last: bool = False


def linear_scorer(w: Sequence[float], b: float) -> Scorer:
    w = np.array(w, float)
    return Scorer(lambda x, last: x @ w + b)


def mlp_scorer(w1, b1, w2, b2: float) -> Scorer:
    w1, b1, w2 = np.array(w1, float), np.array(b1, float), np.array(w2, float)
    return Scorer(lambda x, last: np.tanh(x @ w1.T + b1) @ w2 + b2)


def last_scorer() -> Scorer:
    return Scorer(lambda x, last: x @ last, needs_last=True)


def pool(seqs: DataFrame, ids_col: str, table: DataFrame, scorer: Scorer, key: str = "doc_id", pad_id: int | None = 1,
         mask_pad: bool = False) -> DataFrame:
    """``(key, context)``: softmax of the scores over a document's positions, and the weighted sum of their vectors.

    Documents are packed into blocks with the distinct ids they hold (``functions.blocks``).  A block's ids fetch their
    vectors, each once, as one array; in the block a document is its distinct ids and their counts, its scores one matrix
    product and its context another.  Positions are never exploded and no vector stands per position.  Ids without a
    vector have no weight; a document none of whose ids has one, or whose last id has none where the scorer asks for it,
    has no context (null).  Rows that share a key stay rows of their own.
    """
    ids = F.filter(ids_col, lambda i: i != pad_id) if mask_pad and pad_id is not None else F.col(ids_col)
    packed = blocks.pack(seqs.select(key, F.element_at(ids_col, F.when(F.size(ids_col) > 0, -1)).alias("_last"), ids.alias("_ids")), "_ids")
    # the last id, a pad in short documents, is asked for too, also where pads are masked
    lasts = packed.select("_block", F.explode(F.array_distinct(F.transform("_rows", lambda r: r["_last"]))).alias("token_id"), F.lit(-1).alias("_code"))
    asked = blocks.words(packed, "token_id").select("_block", "token_id", "_code").unionByName(lasts.select("_block", "token_id", "_code"))
    found = asked.join(table.select("token_id", "vector"), "token_id")
    vectors = found.groupBy("_block").agg(F.collect_list(F.struct("token_id", "_code", "vector")).alias("_vectors"))  # a block's
    kind = packed.schema["_rows"].dataType.elementType[key].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for rows, held in zip(batch.column(0), batch.column(1)):
                docs, found = rows.values, held.values
                if found is None:  # no id of the block has a vector
                    yield pa.RecordBatch.from_arrays([docs.field(key), pa.nulls(len(docs), pa.list_(pa.float64()))], [key, "context"])
                    continue
                n = len(found)
                codes, tokens = found.field("_code").to_numpy(), found.field("token_id").to_numpy()
                matrix = found.field("vector").flatten().to_numpy().reshape(n, -1)
                at_code = np.full(int(codes.max(initial=-1)) + 1, -1)
                at_code[codes[codes >= 0]] = np.flatnonzero(codes >= 0)
                at_token = dict(zip(tokens.tolist(), range(n)))
                out = []
                flat = docs.field("_codes")
                ends = np.concatenate([[0], np.cumsum(flat.value_lengths().fill_null(0).to_numpy())])
                of_id = flat.flatten().fill_null(-1).to_numpy()
                for i, last in enumerate(docs.field("_last").to_pylist()):
                    own = of_id[ends[i]:ends[i + 1]]
                    own = own[(own >= 0) & (own < len(at_code))]
                    own, counts = np.unique(at_code[own], return_counts=True)
                    own, counts = own[own >= 0], counts[own >= 0]
                    query = matrix[at_token[last]] if last in at_token else None
                    if not len(own):
                        out.append(None)
                        continue
                    x = matrix[own]
                    if query is None and scorer.needs_last:
                        out.append(None)
                        continue
                    score = scorer.scores(x, query)
                    share = counts * np.exp(score - score.max())
                    out.append((share / share.sum()) @ x)
                yield pa.RecordBatch.from_arrays([docs.field(key), pa.array(out, pa.list_(pa.float64()))], [key, "context"])

    joined = packed.select("_block", "_rows").join(vectors, "_block", "left").select("_rows", "_vectors")
    return joined.mapInArrow(kernel, f"{key} {kind}, context array<double>")


def attn_pool_linear(seqs: DataFrame, ids_col: str, table: DataFrame, w: Sequence[float], b: float, key: str = "doc_id",
                     pad_id: int | None = 1, mask_pad: bool = False) -> DataFrame:
    """Softmax over positions of w . x + b; context = sum of weight * x."""
    return pool(seqs, ids_col, table, linear_scorer(w, b), key, pad_id, mask_pad)


def attn_pool_dot(seqs: DataFrame, ids_col: str, table: DataFrame, dim: int, key: str = "doc_id",
                  pad_id: int | None = 1, mask_pad: bool = False) -> DataFrame:
    """score = x . q, q = the vector at the final position (a pad in short documents)."""
    return pool(seqs, ids_col, table, last_scorer(), key, pad_id, mask_pad)


def attn_pool_mlp(seqs: DataFrame, ids_col: str, table: DataFrame, w1, b1, w2, b2, key: str = "doc_id",
                  pad_id: int | None = 1, mask_pad: bool = False) -> DataFrame:
    """score = w2 . tanh(W1 x + b1) + b2."""
    return pool(seqs, ids_col, table, mlp_scorer(w1, b1, w2, b2), key, pad_id, mask_pad)


def attn_weights(weights: DataFrame, seqs: DataFrame, ids_col: str, key: str = "doc_id") -> DataFrame:
    """One row per (key, pos) with its attention weight.  No pad mask by default,
    so pads share the weight (entropy <= ln max_len)."""
    maps = weights.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("token_id", "weight"))).alias("_w"))
    return seqs.join(maps, key).select(key, F.posexplode(ids_col).alias("pos", "token_id"), "_w") \
        .select(key, "pos", F.col("_w")[F.col("token_id")].alias("weight")).where("weight is not null")


def context_long(pooled: DataFrame, key: str = "doc_id") -> DataFrame:
    return pooled.select(key, F.posexplode("context").alias("dim", "value"))
