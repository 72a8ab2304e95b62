"""Benchmark decontamination: windows of documents within a small edit distance of a benchmark item.

Texts and items become lower-case words without ASCII punctuation.  An item of n words is found where a stretch of
a document is within ``d = floor(max_edits * n)`` word edits of it:

1. Windows.  d edits leave a run of ``q = floor((n - d) / (d + 1))`` (3 at most) of the item's words untouched, so
   each occurrence holds one of its q-grams; each q-gram hit proposes the item-sized window aligned with it.  Windows
   that share fewer than n - d words with the item cannot be within d edits and go.
2. LSH.  The CGK random walk copies the window's words to output steps and moves on after a step if a random bit of
   (step, word) says so; few edits then change few outputs.  Each of ``rounds`` walks samples ``samples`` of the first
   ``span * n`` steps, which end before the walk does (2n on average): later steps show padding, equal for all texts.
   A window is a candidate if in one round it falls into the item's bucket.  Of windows at the full 20 % of edits 99 of
   100 or more do, of unrelated ones of the item's length about one in a hundred (tests, over several seeds).
3. Exact check.  The least edit distance of the item to any stretch around the candidate must be d at most.

The items are a stated query set, searched in blocks of ``block_words`` words; per block the index is broadcast, of
a size bounded by that number, and the documents are scanned once, without a shuffle.  Items without words are
skipped, null texts are empty.  Repeated rows of documents give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

BLOCK_BYTES = 4 << 20
#: ASCII letters to lower case; other ASCII but digits to space.
TABLE = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


@dataclass(frozen=True)
class Settings:
    max_edits: float = 0.2  #: per word of the item: a similarity of 0.8
    rounds: int = 96
    samples: int = 2
    span: float = 1.6  #: of the walk, in words of the item, that samples come from
    seed: int = 11
    block_words: int = 2_000_000


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def cgk_keys(rows: np.ndarray, lens: np.ndarray, s: Settings) -> np.ndarray:
    """Bucket of each row (word numbers, 0 behind the end) in each round: walks of span * lens steps, sampled."""
    n, width = rows.shape
    rounds = np.arange(s.rounds, dtype=np.uint64)
    rng = np.random.default_rng(s.seed)
    shares = rng.random((s.rounds, s.samples))  # of the walk, so that equal lengths sample equal steps
    picks = (shares[None] * (s.span * lens)[:, None, None]).astype(np.int64)
    padded = np.concatenate([rows, np.zeros((n, 1), rows.dtype)], axis=1).astype(np.uint64)
    at = np.zeros((n, s.rounds), np.int64)
    line = np.arange(n)[:, None]
    keys = np.zeros((n, s.rounds), np.uint64)
    for step in range(int(np.ceil(s.span * width))):
        symbol = padded[line, np.minimum(at, width)]
        for k in range(s.samples):
            hit = picks[:, :, k] == step
            if hit.any():
                keys += np.where(hit, _mix(symbol * np.uint64(s.samples + 1) + np.uint64(k + 1)), np.uint64(0))
        seed = np.uint64(s.seed) + np.uint64(step) * np.uint64(0x100000001B3)
        at += (_mix(symbol + _mix(rounds + seed)) & np.uint64(1)).astype(np.int64)
    return _mix(keys + lens.astype(np.uint64)[:, None] + rounds * np.uint64(0x9E37))


def infix_distance(item: np.ndarray, stretch: np.ndarray) -> tuple[int, int]:
    """Least number of word edits between the item and any part of the stretch, and where the part ends."""
    row = np.zeros(len(stretch) + 1, np.int64)
    steps = np.arange(len(stretch) + 1)
    for k, w in enumerate(item.tolist(), 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (stretch != w))
        best = np.concatenate([[k], best])
        row = np.minimum.accumulate(best - steps) + steps  # insertions along the row
    end = int(row.argmin())
    return int(row[end]), end


class Index:
    """A block of items: q-grams, word bags and buckets."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], s: Settings):
        self.s = s
        self.ids = [i for i, _ in items]
        vocabulary: dict[bytes, int] = {}
        self.items = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in ws], np.int64) for _, ws in items]
        self.number = vocabulary
        self.base = len(vocabulary) + 1
        self.lens = np.array([len(x) for x in self.items], np.int64)
        self.edits = (self.lens * s.max_edits + 1e-9).astype(np.int64)
        q = np.clip((self.lens - self.edits) // (self.edits + 1), 1, 3)
        self.grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # q: codes, item, offset
        for size in (1, 2, 3):
            found = [(code, k, i) for k in np.flatnonzero(q == size).tolist()
                     for i, code in enumerate(self._codes(self.items[k], size).tolist())]
            if found:
                code, item, offset = np.array(sorted(found)).T
                self.grams[size] = code, item, offset
        self.bag = np.unique(np.concatenate([x + k * self.base for k, x in enumerate(self.items)])) if self.items else np.zeros(0, np.int64)
        width = int(self.lens.max(initial=1))
        self.keys = np.concatenate([self._keys(self.items[a:a + 2000], self.lens[a:a + 2000]) for a in range(0, len(items), 2000)]) if items else None
        self.width = width

    def _codes(self, numbers: np.ndarray, q: int) -> np.ndarray:
        code = numbers[:len(numbers) - q + 1]
        for k in range(1, q):
            code = code * self.base + numbers[k:len(numbers) - q + 1 + k]
        return code

    def _keys(self, rows: list[np.ndarray], lens: np.ndarray) -> np.ndarray:
        matrix = np.zeros((len(rows), int(lens.max(initial=1))), np.int64)
        for k, x in enumerate(rows):
            matrix[k, :len(x)] = x
        return cgk_keys(matrix, lens, self.s)

    def proposals(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``item, start`` of all aligned windows in a stream of word numbers (0: no word of any item)."""
        items, starts = [], []
        for q, (codes, item, offset) in self.grams.items():
            if len(stream) < q:
                continue
            known = stream[:len(stream) - q + 1] > 0
            for k in range(1, q):
                known &= stream[k:len(stream) - q + 1 + k] > 0
            at = np.flatnonzero(known)
            code = stream[at]
            for k in range(1, q):
                code = code * self.base + stream[at + k]
            first, last = np.searchsorted(codes, code), np.searchsorted(codes, code, "right")
            n = last - first
            which = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum())) if len(n) else np.zeros(0, np.int64)
            items.append(item[which])
            starts.append(np.repeat(at, n) - offset[which])
        if not items:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.unique(np.column_stack([np.concatenate(items), np.concatenate(starts)]), axis=0)
        return both[:, 0], both[:, 1]

    def search(self, stream: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """``row, item, start in the row, edits`` of the best match per row and item; row k is stream[bounds[k]:bounds[k+1]],
        which ends in a 0."""
        item, start = self.proposals(stream)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for a in range(0, len(item), 4096):
            k, at = item[a:a + 4096], start[a:a + 4096]
            n = self.lens[k]
            # the row of the gram: the window may begin before it or end behind it
            inside = np.clip(at + n // 2, 0, len(stream) - 1)
            row = np.searchsorted(bounds, inside, "right") - 1
            low, high = bounds[row], bounds[row + 1] - 1
            steps = np.arange(int(n.max()))
            where = at[:, None] + steps
            ok = (steps < n[:, None]) & (where >= low[:, None]) & (where < high[:, None])
            window = np.where(ok, stream[np.clip(where, 0, len(stream) - 1)], 0)
            code = window + k[:, None] * self.base
            spot = np.minimum(np.searchsorted(self.bag, code), len(self.bag) - 1)
            shared = ((self.bag[spot] == code) & (window > 0)).sum(axis=1)
            near = np.flatnonzero(shared + 2 * self.edits[k] >= n)  # a window that is off by d words holds 2d fewer
            if not len(near):
                continue
            k, at, n, row, low, high, window = k[near], at[near], n[near], row[near], low[near], high[near], window[near]
            hit = (cgk_keys(window, n, self.s) == self.keys[k]).any(axis=1)
            for i in np.flatnonzero(hit).tolist():
                d = int(self.edits[k[i]])
                left = max(int(low[i]), int(at[i]) - d)
                stretch = stream[left:min(int(high[i]), int(at[i] + n[i]) + d)]
                edits, end = infix_distance(self.items[k[i]], stretch)
                if edits <= d:
                    pair = (int(row[i]), int(k[i]))
                    found = (edits, max(0, left + end - int(n[i]) - int(low[i])))
                    if pair not in best or found < best[pair]:
                        best[pair] = found
        for (row, k), (edits, at) in sorted(best.items()):
            yield row, k, at, edits


def indexes(items: DataFrame, s: Settings) -> Iterator[Index]:
    """The items (``item_id, text``) in blocks of about ``block_words`` words."""
    block, size = [], 0
    for r in items.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        if ws := words(r.text):
            block.append((r.item_id, ws))
            size += len(ws)
            if size >= s.block_words:
                yield Index(block, s)
                block, size = [], 0
    if block:
        yield Index(block, s)


def _search(index: Index, batch_texts: list[str | None]) -> Iterator[tuple[int, int, int, int]]:
    get = index.number.get
    numbers: list[int] = []
    bounds = [0]
    for t in batch_texts:
        numbers += [get(w, 0) for w in words(t)]
        numbers.append(0)
        bounds.append(len(numbers))
    yield from index.search(np.array(numbers, np.int64), np.array(bounds, np.int64))


def find(docs: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``doc_id, item_id, start_word, edits, similarity``: the best match of each document row and item."""
    schema = "doc_id long, item_id long, start_word long, edits long, similarity double"
    spark = docs.sparkSession
    out = spark.createDataFrame([], schema)

    def search(shared):
        def kernel(batches: Iterator[pa.RecordBatch]):
            index = shared.value
            for batch in slices(batches, BLOCK_BYTES):
                ids = batch.column(0).to_pylist()
                rows = [(ids[row], index.ids[k], at, edits, 1 - edits / int(index.lens[k]))
                        for row, k, at, edits in _search(index, batch.column(1).to_pylist())]
                cols = list(zip(*rows)) if rows else [()] * 5
                kinds = [pa.int64()] * 4 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "item_id", "start_word", "edits", "similarity"])
        return kernel

    for index in indexes(items, s):
        out = out.unionByName(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search(spark.sparkContext.broadcast(index)), schema))
    return out


def keep_clean(docs: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    at = docs.columns.index("text")
    names = docs.columns

    def clean(shared):
        def kernel(batches: Iterator[pa.RecordBatch]):
            for batch in slices(batches, BLOCK_BYTES):
                kept = np.ones(batch.num_rows, bool)
                kept[[row for row, *_ in _search(shared.value, batch.column(at).to_pylist())]] = False
                yield batch.filter(pa.array(kept))
        return kernel

    for index in indexes(items, s):
        docs = docs.mapInArrow(clean(docs.sparkSession.sparkContext.broadcast(index)), docs.schema)
    return docs.select(*names)
