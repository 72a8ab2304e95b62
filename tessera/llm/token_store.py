"""Token-id files: independent zstandard frames, a trailing seek table, a checksum per frame.

A file is a run of zstandard frames in the public seekable layout: data frames, then one skippable frame with the
seek table (compressed size, decompressed size and the low 32 bits of XXH64 of each frame).  The last data frame is
the index of documents; each frame before it holds whole documents:

    n uint32, width uint8 | doc_id int64 x n (null as the smallest) | n_tokens int64 x n | ids as uint16 or uint32
    index: n uint32 | first doc_id int64, last doc_id int64, documents int64, tokens int64, each x n frames

A reader fetches the tail, finds the frames whose range holds a wanted id and decompresses these only; a frame
whose checksum differs raises.  Files are written per range of doc_id, each under a name of its own attempt; the manifest
lists those of the attempts that ended well, and readers open no others, so a lost or repeated task does no harm on any
file system.  Documents with equal ids are ordered by their text;
null and empty texts have the end id alone.
"""

from __future__ import annotations

import functools
import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices
from .runs import Codes, Runs, run_sums

FRAME_TOKENS = 1 << 18  #: a frame is closed when it holds that many ids
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  #: fixed values of the seekable layout
NULL_ID = -(1 << 63)
BLOCK_BYTES = 4 << 20
CACHE_WORDS = 200_000
MARKS = frozenset(".,;:!?")


def _byte_letters() -> dict[int, int]:
    """The public byte-level alphabet: visible characters of Latin-1 stand for their byte, the other bytes follow 256."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in visible)}


BYTE_LETTERS = _byte_letters()


def byte_letters(word: str) -> str:
    return word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS)


# -- tokens ---------------------------------------------------------------------------------------------------------
class WordEncoder:
    """Encodes texts with the tokenizers library, each distinct part of a word once while it is remembered.

    Holds for tokenizers that drop white space before they split and keep letters, digits and punctuation apart: no
    token then spans a space or a line break, and a mark behind a letter or digit stands for itself.  Latin words are
    lower-cased, as the tokenizer would.  Texts that hold the string of an added token go through the library whole.
    """

    def __init__(self, path: str, end_id: int, cache: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer
        self.library, self.tokenizer = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # for words, whose text holds no added token; lower-casing may make one
        self.end_id, self.cache = end_id, cache
        #: strings that the library takes out of the raw text before all else
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # where a plain word is one pre-token by its bytes, the library's model can take it without the steps before
        probes = ("a", "word", "tokenization", "zqxj", "é", "ñandú", "straße", "çà", "œuvre", "žluťoučký")
        self.plain = all(self._ids(w) == [t.id for t in self.tokenizer.model.tokenize(byte_letters(w))] for w in probes)
        self._forget()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _forget(self):
        self.words, self.word_runs, self.word_hits = Codes(), Runs(), np.zeros(0, np.int64)
        self.parts, self.part_runs, self.part_hits = Codes(), Runs(), np.zeros(0, np.int64)

    def _keep_frequent(self, codes: Codes, runs: Runs, hits: np.ndarray) -> tuple[Codes, Runs, np.ndarray]:
        """The strings that came more than once, half the table at most: most strings never come again."""
        kept = np.flatnonzero(hits > 1)
        kept = kept[np.argsort(-hits[kept], kind="stable")][:self.cache // 2]
        names, fewer, found = list(codes), Codes(), Runs()
        fewer.update((names[c], k) for k, c in enumerate(kept.tolist()))
        found.add(*runs.take(kept))
        return fewer, found, hits[kept] // 2

    def _encode(self, parts: list[str]) -> None:
        ids: list[int] = []
        ends = []
        model, plain = self.tokenizer.model.tokenize, self.plain
        for p in parts:
            if plain and p.isalpha() and p.islower():
                if p.isascii():
                    ids += [t.id for t in model(p)]
                elif max(p) < "\u0180":
                    ids += [t.id for t in model(byte_letters(p))]
                else:
                    ids += self._ids(p)
            else:
                ids += self._ids(p)
            ends.append(len(ids))
        self.part_runs.add(np.array(ids, np.int32), np.diff(np.array([0, *ends], np.int64)))

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``ids, counts`` of the texts, each with the end id."""
        whole = {k: self.library.encode(t, add_special_tokens=False).ids for k, t in enumerate(texts) if any(a in t for a in self.added)}
        if whole:  # an added token may end inside a word: such texts go through the library as they are
            ids, counts = self.block([t for k, t in enumerate(texts) if k not in whole]) if len(whole) < len(texts) else (np.zeros(0, np.uint32), [])
            rest = iter(np.split(ids, np.cumsum(counts)[:-1]))
            rows = [np.array([*whole[k], self.end_id], np.uint32) if k in whole else next(rest) for k in range(len(texts))]
            return np.concatenate(rows), np.array([len(r) for r in rows], np.int64)
        if len(self.words) > self.cache:
            self.words, self.word_runs, self.word_hits = self._keep_frequent(self.words, self.word_runs, self.word_hits)
        if len(self.parts) > self.cache:
            self.parts, self.part_runs, self.part_hits = self._keep_frequent(self.parts, self.part_runs, self.part_hits)
        codes: list[int] = []
        sizes = []
        code = self.words.__getitem__
        for t in texts:
            words = t.replace("\n", " ").split(" ")
            codes.extend(map(code, words))
            sizes.append(len(words))
        new, self.words.new = self.words.new, []
        if new:
            parts, n = [], []
            code = self.parts.__getitem__
            for w in new:
                if w.isascii() or max(w) < "\u0180" and "İ" not in w:  # one letter for one letter
                    w = w.lower()
                if w[-1:] in MARKS and w[-2:-1].isalnum():
                    parts += (code(w[:-1]), code(w[-1]))
                    n.append(2)
                else:
                    parts.append(code(w))
                    n.append(1)
            fresh, self.parts.new = self.parts.new, []
            if fresh:
                self._encode(fresh)
            at = np.array(parts, np.int64)
            self.part_hits = _added(self.part_hits, at, len(self.parts))
            ids, lens = self.part_runs.take(at)
            self.word_runs.add(ids, run_sums(lens, np.array(n, np.int64)))
        at = np.array(codes, np.int64)
        self.word_hits = _added(self.word_hits, at, len(self.words))
        flat, n = self.word_runs.take(at)
        counts = run_sums(n, np.array(sizes, np.int64))
        return np.insert(flat.astype(np.uint32), np.cumsum(counts), np.uint32(self.end_id)), counts + 1


def _added(hits: np.ndarray, codes: np.ndarray, size: int) -> np.ndarray:
    more = np.bincount(codes, minlength=size)
    more[:len(hits)] += hits
    return more


@functools.lru_cache(maxsize=2)
def word_encoder(path: str, end_id: int) -> WordEncoder:
    return WordEncoder(path, end_id)


# -- files ----------------------------------------------------------------------------------------------------------
def pack_frame(doc_ids: list[int], counts: list[int], ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return struct.pack("<IB", len(doc_ids), width) + np.array(doc_ids, "<i8").tobytes() + np.array(counts, "<i8").tobytes() \
        + ids.astype(f"<u{width}").tobytes()


def unpack_frame(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, width = struct.unpack_from("<IB", data)
    doc_ids, counts = np.frombuffer(data, "<i8", n, 5), np.frombuffer(data, "<i8", n, 5 + 8 * n)
    return doc_ids, counts, np.frombuffer(data, f"<u{width}", -1, 5 + 16 * n).astype(np.uint32)


class FrameWriter:
    """Writes frames one after another; memory holds the open frame."""

    def __init__(self, sink, level: int = 3):
        self.sink, self.compressor = sink, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.table: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int]] = []

    def _frame(self, data: bytes) -> None:
        packed = self.compressor.compress(data)
        self.table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.sink.write(packed)

    def add(self, doc_ids: list[int], counts: list[int], ids: np.ndarray) -> None:
        self._frame(pack_frame(doc_ids, counts, ids))
        self.index.append((doc_ids[0], doc_ids[-1], len(doc_ids), len(ids)))

    def close(self) -> None:
        self._frame(struct.pack("<I", len(self.index)) + np.array(self.index, "<i8").reshape(-1, 4).T.tobytes())
        entries = b"".join(struct.pack("<III", *e) for e in self.table)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.table), 0x80, SEEKABLE))


class FrameReader:
    """Reads one file; ``frames`` decompresses only what is asked for."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != SEEKABLE or not flags & 0x80:
            raise ValueError("no seek table with checksums")
        table = np.frombuffer(source.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(-1, 3).astype(np.int64)
        self.table, self.at = table, np.concatenate([[0], np.cumsum(table[:, 0])])
        data = self._data(n - 1)
        count = struct.unpack_from("<I", data)[0]
        self.first, self.last, self.documents, self.tokens = np.frombuffer(data, "<i8", -1, 4).reshape(4, count)

    def _data(self, k: int) -> bytes:
        packed = self.source.read_at(int(self.table[k, 0]), int(self.at[k]))
        data = zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(self.table[k, 1]))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k}: checksum differs")
        return data

    def frames(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """``start, doc_ids, counts, ids`` per frame that may hold a wanted id (all frames: None)."""
        starts = np.concatenate([[0], np.cumsum(self.tokens)])
        for k in range(len(self.first)):
            if wanted is None or any(self.first[k] <= w <= self.last[k] for w in wanted):
                yield int(starts[k]), *unpack_frame(self._data(k))


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:/") else f"file://{uri}")


def write(docs: DataFrame, folder: str, path: str, end_id: int) -> DataFrame:
    """Writes ``docs`` (``doc_id, text``) as files in ``folder``, a folder that all executors share.

    Returns the manifest ``part, file, documents, tokens``: one row per file, in ascending order of doc_id.
    """

    def kernel(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        writer = sink = None
        name = f"part-{part:06d}-{uuid.uuid4().hex[:16]}.tokens.zst"  # of this attempt alone
        documents = tokens = 0
        for batch in slices(batches, BLOCK_BYTES):
            if writer is None:
                store, base = _open(folder)
                store.create_dir(base, recursive=True)
                sink = store.open_output_stream(f"{base}/{name}", compression=None)  # frames are compressed one by one
                writer = FrameWriter(sink)
            ids, counts = word_encoder(path, end_id).block([t or "" for t in batch.column(1).to_pylist()])
            doc_ids = [NULL_ID if i is None else i for i in batch.column(0).to_pylist()]
            at = np.concatenate([[0], np.cumsum(counts)])
            k = 0
            while k < len(doc_ids):  # whole documents up to the frame's size, one at least
                end = max(k + 1, int(np.searchsorted(at, at[k] + FRAME_TOKENS, "right")) - 1)
                writer.add(doc_ids[k:end], counts[k:end].tolist(), ids[at[k]:at[end]])
                k = end
            documents += len(doc_ids)
            tokens += len(ids)
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "file": name, "documents": documents, "tokens": tokens}])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
            .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
            .mapInArrow(kernel, "part long, file string, documents long, tokens long"))


@dataclass
class Store:
    """A folder of token files and its manifest (one row per file, so bounded by the number of partitions)."""

    folder: str
    files: list[tuple[str, int, int]]  #: name, ids before it, documents

    @staticmethod
    def create(docs: DataFrame, folder: str, path: str, end_id: int) -> "Store":
        files, before = [], 0
        for r in sorted(write(docs, folder, path, end_id).collect(), key=lambda r: r.part):
            files.append((r.file, before, r.documents))
            before += r.tokens
        return Store(folder, files)

    def read(self, spark: SparkSession, wanted: list[int] | None = None) -> DataFrame:
        """``doc_id, start, ids`` of all documents, or of the wanted ids; a task per file."""
        folder = self.folder

        def kernel(batches: Iterator[pa.RecordBatch]):
            store, base = _open(folder)
            for batch in batches:
                for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    with store.open_input_file(f"{base}/{name}") as f:
                        for start, doc_ids, counts, ids in FrameReader(f).frames(wanted):
                            at = np.concatenate([[0], np.cumsum(counts)])
                            rows = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                            out = pa.RecordBatch.from_arrays(
                                [pa.array(doc_ids, mask=doc_ids == NULL_ID), pa.array(before + start + at[:-1]), rows], ["doc_id", "start", "ids"])
                            yield out if wanted is None else out.filter(pa.array(np.isin(doc_ids, wanted)))

        rows = spark.createDataFrame([f[:2] for f in self.files], "file string, before long")
        return (rows.repartitionByRange(max(1, len(self.files)), "file")
                .mapInArrow(kernel, "doc_id long, start long, ids array<int>"))


def digests(read: DataFrame) -> DataFrame:
    """What the query returns of ``doc_id, start, ids``."""

    def kernel(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids = batch.column(2)
            flat, at = ids.flatten().to_numpy().astype("<u4"), np.asarray(ids.offsets) - ids.offsets[0].as_py()
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())],
                                             ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read.mapInArrow(kernel, "doc_id long, start long, n_tokens long, ids_crc32 long")
