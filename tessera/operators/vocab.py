"""Vocabulary, encoding and label dictionaries.

All lookups are equi-joins of the vocabulary, which grows with the corpus, with the distinct tokens of
blocks of documents (see ``functions.blocks``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blocks
from ..functions.indexing import with_global_index

SPECIALS = ("<unk>", "<pad>")
UNK_ID = 0
PAD_ID = 1


def build_vocab(df: DataFrame, tokens_col: str = "tokens",
                specials: tuple[str, ...] = SPECIALS) -> DataFrame:
    """``(token, token_id, freq)``; specials first (freq 0), then by frequency desc, token asc.

    Counting is a partial+final hash aggregate; ids come from a distributed
    range sort (no single-task window), offset by the number of specials.
    """
    spark = df.sparkSession
    counts = (
        df.select(F.explode_outer(tokens_col).alias("token")).where(F.col("token").isNotNull())
        .groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
        .where(~F.col("token").isin(list(specials)))
    )
    indexed = with_global_index(counts, [F.col("freq").desc(), F.col("token")], name="_i")
    words = indexed.select("token", (F.col("_i") + len(specials)).cast("int").alias("token_id"), "freq")
    sp = spark.createDataFrame([(s, i) for i, s in enumerate(specials)], "token string, token_id int") \
        .withColumn("freq", F.lit(0).cast("bigint"))
    return sp.unionByName(words)


def encode_tokens(df: DataFrame, tokens_col: str, vocab: DataFrame, out_col: str = "token_ids",
                  max_len: int | None = None, unk_id: int = UNK_ID) -> DataFrame:
    """Token array -> id array in the same order; unknown and null tokens -> ``unk_id``.

    Blocks of rows look up their distinct tokens (``functions.blocks``); no position leaves its row.  With ``max_len``
    only the first ``max_len`` tokens are kept (the encoding is 1:1, so padding them later gives the same result).
    Rows need no key: each comes back once, also where ids repeat.  A null array counts as empty.
    """
    if max_len is not None:
        df = df.withColumn(tokens_col, F.slice(tokens_col, 1, max_len))
    packed = blocks.pack(df, tokens_col)
    found = blocks.words(packed, "token").join(vocab.select("token", "token_id"), "token", "left")
    return blocks.replace(packed, found.select("_block", "_code", "token_id"), "token_id", out_col, F.lit(unk_id))


def pad_truncate(ids: Column | str, max_len: int = 350, pad_id: int = PAD_ID) -> Column:
    """First ``max_len`` ids, right-padded with ``pad_id`` to exactly ``max_len``."""
    a = F.col(ids) if isinstance(ids, str) else ids
    return F.concat(F.slice(a, 1, max_len),
                    F.array_repeat(F.lit(pad_id), F.greatest(F.lit(0), max_len - F.size(a))))


def pad_to_longest(df: DataFrame, ids_col: str, batch_col: str = "batch_id",
                   pad_id: int = 0, out_col: str = "padded") -> DataFrame:
    """C4: pad each sequence with ``pad_id`` to the longest one in its batch.

    A window per batch: each batch holds at most ``batch_size`` rows.
    """
    from pyspark.sql import Window

    longest = F.max(F.size(ids_col)).over(Window.partitionBy(batch_col))
    return df.withColumn(out_col, F.concat(
        F.col(ids_col), F.array_repeat(F.lit(pad_id), (longest - F.size(ids_col)).cast("int"))))


def decode_ids(df: DataFrame, ids_col: str, vocab: DataFrame, pad_id: int = PAD_ID, unk: str = "<unk>",
               out_col: str = "decoded") -> DataFrame:
    """Ids -> words joined by a space; ``pad_id`` dropped, unknown ids -> ``unk``.  Rows as in ``encode_tokens``."""
    packed = blocks.pack(df.withColumn(ids_col, F.filter(ids_col, lambda i: i != pad_id)), ids_col)
    found = blocks.words(packed, "token_id").join(vocab.select("token_id", "token"), "token_id", "left")
    opened = blocks.replace(packed, found.select("_block", "_code", "token"), "token", out_col, F.lit(unk))
    return opened.withColumn(out_col, F.array_join(out_col, " "))


def label_dictionary(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Sorted distinct labels -> ``label_idx`` 0..k-1."""
    labels = df.select(label_col).distinct().where(F.col(label_col).isNotNull())
    return with_global_index(labels, [F.col(label_col)], name="_i") \
        .select(label_col, F.col("_i").cast("int").alias("label_idx"))


def label_encode(df: DataFrame, dictionary: DataFrame, label_col: str = "label",
                 out_col: str = "label_idx") -> DataFrame:
    """Apply a fitted dictionary; a label the dictionary lacks raises an error."""
    d = dictionary.select(F.col(label_col).alias("_lab"), F.col("label_idx").alias("_idx"))
    j = df.join(d, df[label_col] == d["_lab"], "left")
    return j.withColumn(out_col, F.when(
        F.col("_idx").isNull(),
        F.raise_error(F.concat(F.lit("unseen label: "), F.col(label_col).cast("string")))).otherwise(F.col("_idx"))
        .cast("int")).drop("_lab", "_idx")

