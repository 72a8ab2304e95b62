"""Byte-level BPE encoding by corpus-level merge replay, and decoding.

A task takes its rows in blocks.  Of a block it collects the distinct words (matches of the split pattern) that it
has not met yet and encodes them together: an inverted index holds, for each token pair, the positions at which it
stands in any of these words; merges are applied in rank order, each to all its positions at once, and only the two
pairs beside a merge are looked up anew.  The block's texts are then put together from the words' ids.  What a task
keeps in memory is one block and a bounded table of words, so the work is one pass without a shuffle.

Null texts count as empty and have no ids.  Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .runs import Codes, Runs, run_sums

BLOCK_BYTES = 2 << 20  #: text encoded at once
CACHE_WORDS = 80_000  #: words and pieces whose ids a worker keeps between blocks


class Ranks:
    """A rank file: lines of base64 token and rank."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(self.rank.values()) + 1
        self.token = [b""] * self.size
        for token, rank in self.rank.items():
            self.token[rank] = token
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.bytes_of = pa.array(self.token, pa.large_binary())
        # every pair of tokens that makes a token, in an open-addressed table
        pairs = {}
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        self.mask = (1 << max(4, (4 * len(pairs)).bit_length())) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.values = np.full(self.mask + 1, -1, np.int64)
        for key, rank in pairs.items():
            at = (key * MIX & MASK64) >> 40 & self.mask
            while self.keys[at] >= 0:
                at = at + 1 & self.mask
            self.keys[at], self.values[at] = key, rank

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair merges to, or -1."""
        key = left * self.size + right
        at = ((key.astype(np.uint64) * np.uint64(MIX)) >> np.uint64(40)).astype(np.int64) & self.mask
        found = self.keys[at]
        out = np.where(found == key, self.values[at], -1)
        on = np.flatnonzero((found != key) & (found >= 0))
        while len(on):
            at[on] = (at[on] + 1) & self.mask
            found = self.keys[at[on]]
            hit = found == key[on]
            out[on[hit]] = self.values[at[on[hit]]]
            on = on[~hit & (found >= 0)]
        return out

    def one(self, word: bytes) -> list[int]:
        """A single word: merge the lowest-ranked pair, leftmost first, until there is none."""
        parts = [word[i:i + 1] for i in range(len(word))]
        while len(parts) > 1:
            found = [(r, i) for i in range(len(parts) - 1) if (r := self.rank.get(parts[i] + parts[i + 1])) is not None]
            if not found:
                break
            i = min(found)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[x] for x in parts]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``ids, counts`` of the words, by replaying the merges over all of them.

        ``here[i]`` is the rank of the pair that starts at position i (-1: none).  The inverted index is a table of
        (rank, position), sorted for a window of ranks at a time; pairs made on the way join it.
        """
        lens = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lens)
        n = int(ends[-1]) if len(words) else 0
        tok = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        after, before = np.arange(1, n + 2), np.arange(-1, n)  # live neighbours; position n is a dead end
        tok = np.append(tok, -1)
        start = ends - lens
        word_end = ends - 1
        filled = lens > 0
        after[word_end[filled]] = n
        before[start[filled]] = n
        after[n] = before[n] = n
        here = np.full(n + 1, -1, np.int64)
        inner = np.flatnonzero(after[:n] < n)
        here[inner] = self.merged(tok[inner], tok[after[inner]])
        none = np.zeros(0, np.int64)
        odd: list[np.ndarray] = []  # positions where a merge has made a pair of lower rank
        taken = np.zeros(n + 1, bool)
        later_rank, later_at = [here[inner]], [inner]  # pairs of the windows to come
        for lo in range(0, self.size, WINDOW):
            hi = lo + WINDOW
            rank, at = np.concatenate(later_rank), np.concatenate(later_at)
            now = (rank >= lo) & (rank < hi)
            keep = rank >= hi
            later_rank, later_at = [rank[keep]], [at[keep]]
            rank, at = rank[now], at[now]
            order = np.argsort(rank, kind="stable")
            rank, at = rank[order], at[order]
            ranks, first = np.unique(rank, return_index=True)
            places = dict(zip(ranks.tolist(), np.split(at, first[1:]))) if len(ranks) else {}
            added: dict[int, list[int]] = {}  # positions that join the window on the way
            heap = ranks.tolist()
            while heap:
                r = heapq.heappop(heap)
                i = places.pop(r, None)
                if i is None:
                    continue
                if extra := added.pop(r, None):
                    i = np.concatenate([i, extra])
                i = i[here[i] == r]
                if not len(i):
                    continue
                j = after[i]
                taken[i] = True
                if taken[j].any():  # a run like aaa: from the left, each token once
                    i = np.unique(i)
                    pick, free = [], -1
                    for x, y in zip(i.tolist(), after[i].tolist()):
                        if x >= free:
                            pick.append(x)
                            free = y + 1
                    taken[i] = False
                    i = np.array(pick)
                    j = after[i]
                else:
                    taken[i] = False
                k = after[j]
                tok[i] = r
                tok[j] = here[j] = -1
                after[i] = k
                before[k] = i
                before[n] = n
                h = before[i]
                right = self.merged(np.full(len(i), r), tok[k])
                right[k == n] = -1
                here[i] = right
                h_at = np.flatnonzero(h != n)
                h = h[h_at]
                left = self.merged(tok[h], np.full(len(h), r))
                here[h] = left
                made, made_at = np.concatenate([right, left]), np.concatenate([i, h])
                low = (made >= 0) & (made < r)
                if low.any():
                    odd.append(made_at[low])
                soon = (made > r) & (made < hi)
                if soon.any():
                    for x, y in zip(made[soon].tolist(), made_at[soon].tolist()):
                        if x in added:
                            added[x].append(y)
                        else:
                            added[x] = [y]
                            if x not in places:
                                places[x] = none
                                heapq.heappush(heap, x)
                far = made >= hi
                later_rank.append(made[far])
                later_at.append(made_at[far])
        live = tok[:n] >= 0
        counts = np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(live)])[ends]])).astype(np.int64)
        ids = tok[:n][live]
        if odd:
            return self._mend(words, ids, counts, np.unique(np.searchsorted(ends, np.concatenate(odd), "right")))
        return ids, counts

    def _mend(self, words, ids, counts, odd) -> tuple[np.ndarray, np.ndarray]:
        """Encodes one by one the words in which merges did not come in the order of ranks."""
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for w in odd.tolist():
            parts[w] = np.array(self.one(words[w]), np.int64)
            counts[w] = len(parts[w])
        return np.concatenate(parts), counts


MIX, MASK64 = 0x9E3779B97F4A7C15, (1 << 64) - 1
WINDOW = 1024


@functools.lru_cache(maxsize=4)
def ranks(path: str) -> Ranks:
    """Read once in a worker."""
    return Ranks(path)


class Encoder:
    """Texts to ids; keeps the ids of words and pieces it has met.

    A piece is what stands between two spaces, with the space before it.  A split pattern that takes at most one
    space in front of a word, and otherwise never lets a match reach over the start of a white-space run, cuts at
    each space that no white space precedes; so pieces are independent unless one is empty or ends in white space.
    Texts with such a piece are split as a whole.
    """

    def __init__(self, path: str, pattern: str, cache: int = CACHE_WORDS):
        self.ranks, self.split, self.cache = ranks(path), regex.compile(pattern), cache
        self._forget()

    def _forget(self) -> None:
        self.words, self.word_runs = Codes(), Runs()
        self.pieces, self.piece_runs = Codes(), Runs()  # a text's first piece is kept as (piece,)
        self.loose: set[int] = set()  # codes of pieces that may depend on what follows

    def _words(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The strings' word codes in a row, and how many each has; new words are encoded."""
        codes: list[int] = []
        sizes = []
        findall, code = self.split.findall, self.words.__getitem__
        for s in strings:
            found = findall(s)
            codes.extend(map(code, found))
            sizes.append(len(found))
        new, self.words.new = [w.encode() for w in self.words.new], []
        if new:
            self.word_runs.add(*self.ranks.replay(new))
        return np.array(codes, np.int64), np.array(sizes, np.int64)

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``ids, counts``: all ids of the texts in a row, and how many of them each text has."""
        if len(self.words) + len(self.pieces) > self.cache:
            self._forget()
        codes: list[int] = []
        code = self.pieces.__getitem__
        bounds = [0]
        for t in texts:
            pieces = t.split(" ")
            codes.append(code((pieces[0],)))
            codes.extend(map(code, pieces[1:]))
            bounds.append(len(codes))
        new, self.pieces.new = self.pieces.new, []
        if new:
            known = len(self.pieces) - len(new)
            strings = [p[0] if isinstance(p, tuple) else " " + p for p in new]
            self.loose.update(known + i for i, p in enumerate(strings) if p in ("", " ") or p[-1].isspace())
            word_codes, sizes = self._words(strings)
            ids, n = self.word_runs.take(word_codes)
            self.piece_runs.add(ids, run_sums(n, sizes))
        codes = np.array(codes, np.int64)
        ids, n = self.piece_runs.take(codes)
        counts = run_sums(n, np.diff(bounds))
        if self.loose:
            loose = np.isin(codes, np.fromiter(self.loose, np.int64))
            whole = np.flatnonzero(run_sums(loose, np.diff(bounds))).tolist()
            if whole:
                word_codes, sizes = self._words([texts[k] for k in whole])
                other, n = self.word_runs.take(word_codes)
                parts = np.split(ids, np.cumsum(counts)[:-1])
                mended = np.split(other, np.cumsum(run_sums(n, sizes))[:-1])
                for k, x in zip(whole, mended):
                    parts[k] = x
                    counts[k] = len(x)
                ids = np.concatenate(parts)
        return ids, counts


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One per worker; later tasks profit from the words it has met."""
    return Encoder(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids``: the token ids of each whole text (an empty list for null and empty texts)."""

    def kernel(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, BLOCK_BYTES):
            ids, counts = encoder(path, pattern).block([t or "" for t in batch.column(1).to_pylist()])
            at = np.concatenate([[0], np.cumsum(counts)])
            rows = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), rows], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(kernel, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (``doc_id, ids``) with ``decoded``, the bytes that the ids stand for."""

    def kernel(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, BLOCK_BYTES):
            ids = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            tokens = ranks(path).bytes_of.take(ids.flatten())
            offsets = np.frombuffer(tokens.buffers()[1], np.int64)[tokens.offset:tokens.offset + len(tokens) + 1]
            bounds = np.asarray(ids.offsets) - ids.offsets[0].as_py()
            data = tokens.buffers()[2]
            joined = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer(offsets[bounds].tobytes()), data])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), joined.cast(pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(kernel, "doc_id long, ids array<int>, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """What the query returns of ``doc_id, ids, decoded``."""
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
