"""Dictionary-encoded blocks of rows: lookups of array elements without a row per element.

A block is one row that holds some hundred documents: their columns, the distinct elements of their arrays, and each
array as positions among these.  Only the distinct elements are exploded and joined; the values come back as one array
per block, from which each document reads its own by position.  Documents need no key, so rows that repeat an id stay
rows of their own, and a word that stands everywhere is looked up once per block, so frequent words make no hot key.

    words:   _block, _code, <key>          what a lookup joins with its table
    replace: the documents, with the array of values

Blocks are written once (``materialize``): their number, which names them, would differ in another execution.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import materialize

BLOCK_BYTES = 2 << 20  #: of the arrays of a block, about; a longer array is a block of its own


def pieces(batches: Iterator[pa.RecordBatch], column: int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches whose ``column`` has about ``max_bytes`` at most, one row at least."""
    for batch in batches:
        rows = batch.num_rows
        step = max(1, min(rows, rows * max_bytes // max(batch.column(column).nbytes, 1))) if rows else 1
        for at in range(0, rows, step):
            yield batch.slice(at, step)


def pack(df: DataFrame, col: str) -> DataFrame:
    """``_block, _words, _rows``: blocks of ``df``'s rows; ``_rows`` has all columns but ``col``, and ``_codes``.

    A null array counts as empty; a null element has a null code.
    """
    rest = [c for c in df.columns if c != col]
    fields = [df.schema[c] for c in rest]
    element = df.schema[col].dataType.elementType
    row = T.StructType([*fields, T.StructField("_codes", T.ArrayType(T.IntegerType()))])
    out = T.StructType([T.StructField("_words", T.ArrayType(element)), T.StructField("_rows", T.ArrayType(row))])
    kinds = to_arrow_schema(out)

    def kernel(batches: Iterator[pa.RecordBatch]):
        for batch in pieces(batches, len(rest), BLOCK_BYTES):
            arrays = batch.column(len(rest))
            flat = arrays.flatten().dictionary_encode()
            lens = arrays.value_lengths().fill_null(0).to_numpy()
            ends = pa.array([0, *lens.cumsum().tolist()], pa.int32())
            codes = pa.ListArray.from_arrays(ends, flat.indices.cast(pa.int32()))
            kind = kinds.field("_rows").type.value_type
            own = [kind.field(i).type for i in range(kind.num_fields)]
            rows = pa.StructArray.from_arrays([*[c.cast(t) for c, t in zip(batch.columns[:-1], own)], codes.cast(own[-1])],
                                              fields=[kind.field(i) for i in range(kind.num_fields)])
            words = pa.ListArray.from_arrays(pa.array([0, len(flat.dictionary)], pa.int32()), flat.dictionary)
            yield pa.RecordBatch.from_arrays([words.cast(kinds.field("_words").type),
                                              pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows).cast(kinds.field("_rows").type)],
                                             ["_words", "_rows"])

    packed = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{col}`")).mapInArrow(kernel, out)
    return materialize(packed.withColumn("_block", F.monotonically_increasing_id()))


def words(blocks: DataFrame, key: str) -> DataFrame:
    """``_block, _code, key``: each block's distinct elements."""
    return blocks.select("_block", F.posexplode("_words").alias("_code", key)).where(F.col(key).isNotNull())


def gather(found: DataFrame, value: str) -> DataFrame:
    """``_block, _values``: from rows ``_block, _code, value`` the array of a block's values by code."""
    by_code = F.array_sort(F.collect_list(F.struct("_code", value)))
    return found.groupBy("_block").agg(F.transform(by_code, lambda s: s[value]).alias("_values"))


def replace(blocks: DataFrame, found: DataFrame, value: str, out: str, default: Column) -> DataFrame:
    """The documents of ``blocks`` with the array ``out``: for each element its ``value`` in ``found`` (``_block, _code,
    value``, a row for every code), or ``default`` where that is null or the element was."""
    columns = [f.name for f in blocks.schema["_rows"].dataType.elementType.fields if f.name != "_codes"]
    j = blocks.select("_block", "_rows").join(gather(found, value), "_block", "left")
    read = lambda r: F.transform(r["_codes"], lambda c: F.coalesce(F.get(F.col("_values"), c), default))
    return j.select(F.inline(F.transform("_rows", lambda r: F.struct(*[r[c].alias(c) for c in columns], read(r).alias(out)))))
