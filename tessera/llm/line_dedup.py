"""Line dedup: repeated runs of lines go, but for their first occurrence.

The lines of a text that hold a word are hashed without the white space around them.  Winnowing selects, of each
window of ``run - gram + 1`` neighbouring hashes of ``gram`` lines, the smallest (the rightmost of equal ones) as
fingerprint; so two places that share ``run`` lines share a fingerprint at the same offset.  Positions are joined on
fingerprints that stand at two places or more; around each, the match is extended both ways over the windows that
selected it, whose ``run`` lines must be equal in full.  A window whose lines occurred earlier (by KEY, then by
line) is repeated, its lines go, and neighbouring windows make up runs of any length.

Fewer lines are a window too if they hold ``words`` words or more (words are what white space separates), down to a
single line; such a window selects among its own grams, and a line alone is its own gram.

So exactly those lines go that stand in ``run`` consecutive lines, or in fewer with ``words`` words, that occurred
earlier.  Occurrences may overlap: of equal lines in a row the first stays.  Shorter runs of fewer words stay, blank
lines stay, null texts stay null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KEY, join_counted, with_key, written

SPACE = " \t\r\x0b\x0c"


def full_lines(text: str | None) -> list[str]:
    """The lines that hold a word, without the white space around them."""
    return [s for line in (text or "").split("\n") if (s := line.strip(SPACE))]


def line_hashes(text: str | None) -> list[int]:
    """Hashes of the lines that hold a word."""
    return [xxhash.xxh3_64_intdigest(s.encode()) for s in full_lines(text)]


def winnow(hashes: list[int], gram: int, run: int) -> Iterator[tuple[int, int, int, bytes]]:
    """``fingerprint, its position, window start, hash of the window's lines`` for each window of ``run`` lines."""
    if len(hashes) < run:
        return
    data = np.array(hashes, "<u8").tobytes()
    grams = [xxhash.xxh3_64_intdigest(data[8 * i:8 * (i + gram)]) for i in range(len(hashes) - gram + 1)]
    width = run - gram + 1
    for s in range(len(hashes) - run + 1):
        at = max(range(s, s + width), key=lambda i: (-grams[i], i))
        yield grams[at], at, s, xxhash.xxh3_128_digest(data[8 * s:8 * (s + run)])


def wordy(lines: list[str], hashes: list[int], gram: int, run: int, words: int) -> Iterator[tuple[int, int, int, bytes, int]]:
    """The same, and the number of lines, for each window of fewer than ``run`` lines that hold ``words`` words or more."""
    total = list(accumulate((len(s.split()) for s in lines), initial=0))
    for size in range(1, min(run - 1, len(lines)) + 1):
        for s in range(len(lines) - size + 1):
            if total[s + size] - total[s] >= words:
                fp, at, _, _ = next(winnow(hashes[s:s + size], min(gram, size), size))
                # of the text itself: one line's 64-bit hash alone could collide
                yield fp, s + at, s, xxhash.xxh3_128_digest("\n".join(lines[s:s + size]).encode()), size


WINDOW = "fp long, at int, start int, lines binary, size int, _id long, _h long"


def windows(docs: DataFrame, gram: int, run: int, words: int) -> DataFrame:
    """All windows with the fingerprint that each selects."""

    def kernel(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = []
            for key, h, text in zip(*(c.to_pylist() for c in batch.columns)):
                hashes = line_hashes(text)
                out += [(*w, run, key, h) for w in winnow(hashes, gram, run)]
                out += [(*w, key, h) for w in wordy(full_lines(text), hashes, gram, run, words)]
            fp, at, start, lines, size, key, h = zip(*out) if out else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(at, pa.int32()), pa.array(start, pa.int32()),
                 pa.array(lines, pa.binary()), pa.array(size, pa.int32()), pa.array(key, pa.int64()), pa.array(h, pa.int64())],
                ["fp", "at", "start", "lines", "size", "_id", "_h"])

    return with_key(docs.select("doc_id", "text")).select(*KEY, "text").mapInArrow(kernel, WINDOW)


def repeated(docs: DataFrame, gram: int, run: int, words: int) -> DataFrame:
    """``_id, _h, spans``: the windows (``start, size``) of each document whose lines occurred earlier."""
    found = written(windows(docs, gram, run, words), "line-windows")
    place = F.struct(*KEY, "at")
    shared = written(found.groupBy("fp").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("n"))
                     .where("a <> b").select("fp", "n"), "line-fingerprints")
    total = shared.agg(F.sum("n")).first()[0] or 0
    near = written(join_counted(found, shared, "fp", "n", total).select("lines", "start", "size", *KEY), "line-matches")
    first = written(near.groupBy("lines").agg(F.min(F.struct(*KEY, "start")).alias("first"), F.count("*").alias("n")).where("n > 1"),
                    "line-first")
    total = first.agg(F.sum("n")).first()[0] or 0
    later = join_counted(near, first, "lines", "n", total).where(F.struct(*KEY, "start") > F.col("first"))
    return later.groupBy(*KEY).agg(F.collect_set(F.struct("start", "size")).alias("spans"))


def without(text: str | None, spans: list[dict] | None) -> tuple[str | None, int, int]:
    """The text without the lines of the windows, its lines with a word, and how many of them went."""
    lines = (text or "").split("\n")
    gone = {i for w in spans or () for i in range(w["start"], w["start"] + w["size"])}
    kept, n = [], 0
    for line in lines:
        if line.strip(SPACE):
            if n not in gone:
                kept.append(line)
            n += 1
        else:
            kept.append(line)
    return (None if text is None else "\n".join(kept)), n, len(gone)


def dedup(docs: DataFrame, gram: int = 2, run: int = 3, words: int = 50) -> DataFrame:
    """``row, text, n_lines, n_removed``: per document its other columns as a struct, the shortened text, its lines with
    a word and how many of them went."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    keyed = docs.select(F.struct(*others).alias("row"), "doc_id", "text")
    joined = with_key(keyed).join(repeated(docs, gram, run, words), KEY, "left").select("row", "text", "spans")
    schema = T.StructType([*joined.schema.fields[:2], T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])

    def kernel(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = [without(t, s) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["row", "text", "n_lines", "n_removed"])

    return joined.mapInArrow(kernel, schema)


def digests(found: DataFrame) -> DataFrame:
    """What the query returns."""
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_lines", "n_removed", "text")


def shorten(docs: DataFrame, gram: int = 2, run: int = 3, words: int = 50) -> DataFrame:
    """``docs`` with shortened texts (and ``n_chars`` to match, if there is one); documents of which nothing is left go."""
    out = dedup(docs, gram, run, words).where("n_removed = 0 or n_removed < n_lines")

    def column(c: str):
        own = F.col("text") if c == "text" else F.col("row").getField(c)
        if c == "n_chars":
            own = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(own)
        return own.alias(c)

    return out.select(*map(column, docs.columns))
