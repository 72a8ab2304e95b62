"""Removal of repeated byte strings by suffix arrays, built by linear grouping.

A byte goes if a string of ``length`` bytes covers it that also starts anywhere else, in the same text or another;
strings are judged on the input, and all their places go.

1. Anchors.  Winnowing selects, of each window of ``length`` bytes, one of its ``GRAM``-byte grams by hash; equal
   windows select equal grams at equal offsets.  A record is an anchor with the stretch of neighbouring windows that
   selected it; each window belongs to one record.
2. Records whose gram occurs once hold no repeated window and go.  Records with equal grams and stretches are one
   context with a weight; a gram with a single context of weight two or more is repeated as a whole.
3. Of the other grams the contexts' bytes are fetched and dealt into buckets of bounded size, all contexts of a gram
   together.  As equal windows select equal grams, what a context shares with another one stands around the gram;
   the rest is trimmed, and contexts that are equal then are one string with their weights added up.  In a bucket the
   suffix array of the strings is built (see ``suffix_array``); neighbouring suffixes that share ``length`` bytes are
   classes, repeated if their weights sum up to two.
   A gram with over ``CONTEXTS`` contexts would not fit a bucket.  Its windows are split by where they start before the
   gram: all of a half hold more bytes than the gram, and these are the grams that the halves are dealt by.  What is
   still too large after ``HALVINGS`` rounds is dealt window by window, by hash.
4. The windows found are united by document and cut out of the text.

Null texts count as empty.  Rows that repeat id and text are two places: their bytes go like any other copy's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, join_counted, slices, with_key, written

GRAM = 48
CONTEXTS = 1000  #: contexts of one gram that may meet in a bucket
HALVINGS = 4
BUCKET_BYTES = 1 << 18  #: context bytes of a bucket, before they are trimmed
STRING_BYTES = 1 << 16  #: bytes of one suffix array
CHUNK = 1 << 20  #: windows handled at once
LOW = (1 << 21) - 1


# -- suffix array ---------------------------------------------------------------------------------------------------
def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of positive integers, by grouping suffixes by their longest Lyndon prefix.

    First all suffixes are grouped by their first symbol; a group is named by the first of its places in the array.
    Groups are taken in descending order.  A suffix of the group is preceded by the nearest suffix in a lower group,
    its previous smaller one, found over the pointers set so far.  The suffixes so pointed at have a Lyndon prefix
    that goes on with this group's, once for each pointer; they leave their groups for new ones right behind these,
    those with more pointers further behind.  In the end each group shares one Lyndon prefix.

    Then the array is filled in ascending order: behind a suffix at its place, the suffix before it and the chain of
    that one's previous smaller suffixes take the next free places of their groups.
    """
    text = [*text, 0]
    n = len(text)
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        by_symbol.setdefault(c, []).append(i)
    group = [0] * n  # first place of a suffix's group
    members: dict[int, list[int] | set[int]] = {}
    start_of_end: dict[int, int] = {}
    at = 0
    for c in sorted(by_symbol):
        places = by_symbol[c]
        for i in places:
            group[i] = at
        members[at] = places
        start_of_end[at + len(places) - 1] = at
        at += len(places)
    previous = [-1] * n
    end = n - 1
    while end >= 0:
        start = start_of_end[end]
        pointed: dict[int, int] = {}
        for i in sorted(members[start]):
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if pointed:
            by_count: dict[int, dict[int, list[int]]] = {}
            for p, times in pointed.items():
                by_count.setdefault(times, {}).setdefault(group[p], []).append(p)
            for times in sorted(by_count, reverse=True):
                for g, moved in by_count[times].items():
                    rest = members[g]
                    if len(moved) == len(rest):
                        continue
                    if not isinstance(rest, set):
                        rest = members[g] = set(rest)
                    last = g + len(rest) - 1
                    rest.difference_update(moved)
                    new = g + len(rest)
                    for p in moved:
                        group[p] = new
                    members[new] = moved
                    start_of_end[last] = new
                    start_of_end[new - 1] = g
        end = start - 1
    out = [-1] * n
    free = dict.fromkeys(members, 0)
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[g + free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = previous[j]
    return out[1:]


def repeated_starts(contexts: list[bytes], weights: list[int], length: int) -> list[np.ndarray]:
    """Per context the starts of its strings of ``length`` bytes that occur twice or more in all, by weight."""
    symbols: list[int] = []
    bounds = [0]
    for k, c in enumerate(contexts):
        symbols += [b + len(contexts) + 1 for b in c]
        symbols.append(k + 1)  # a separator of its own
        bounds.append(len(symbols))
    order = np.array(suffix_array(symbols), np.int64)
    bounds = np.array(bounds)
    owner = np.searchsorted(bounds, order, "right") - 1
    full = order + length < bounds[owner + 1]
    order, owner = order[full], owner[full]
    data = np.array(symbols, np.int32)
    same = np.zeros(len(order), bool)  # as the one before
    steps = np.arange(length)
    for at in range(1, len(order), 4096):
        now = order[at:at + 4096, None] + steps
        one_before = order[at - 1:at - 1 + len(now), None] + steps
        same[at:at + 4096] = (data[now] == data[one_before]).all(axis=1)
    label = np.cumsum(~same) - 1
    total = np.bincount(label, np.array(weights)[owner], minlength=1) if len(order) else np.zeros(1)
    hit = total[label] >= 2 if len(order) else np.zeros(0, bool)
    out = [[] for _ in contexts]
    for k, s in zip(owner[hit].tolist(), (order[hit] - bounds[owner[hit]]).tolist()):
        out[k].append(s)
    return [np.array(sorted(x), np.int64) for x in out]


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n - 1  # a[:low] == b[:low], a[:high + 1] != b[:high + 1]
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def shared_parts(contexts: list[bytes], offsets: list[int]) -> list[tuple[int, int]]:
    """Per context the part around its gram (at ``offsets``) that bounds what it shares with any other: behind the
    gram's start the longest common prefix, before it the longest common suffix, each with its neighbour in order."""
    reach = []
    for strings in ([c[:o][::-1] for c, o in zip(contexts, offsets)], [c[o:] for c, o in zip(contexts, offsets)]):
        order = sorted(range(len(strings)), key=strings.__getitem__)
        longest = [0] * len(strings)
        for x, y in zip(order, order[1:]):
            n = _common(strings[x], strings[y])
            longest[x], longest[y] = max(longest[x], n), max(longest[y], n)
        reach.append(longest)
    return [(o - left, o + right) for o, left, right in zip(offsets, *reach)]


def repeated_in_grams(grams: list[tuple[list[bytes], list[int], list[int]]], length: int) -> list[list[np.ndarray]]:
    """For the contexts, gram offsets and weights of each gram: the repeated starts of each context."""
    strings: dict[tuple[int, bytes], int] = {}  # weight by gram and trimmed string
    parts = []
    for g, (contexts, offsets, weights) in enumerate(grams):
        bounds = shared_parts(contexts, offsets)
        own = [(g, c[a:b]) if b - a >= length else None for c, (a, b) in zip(contexts, bounds)]
        for key, w in zip(own, weights):
            if key is not None:
                strings[key] = strings.get(key, 0) + w
        # a context of weight two or more is repeated as a whole, whatever it shares
        parts.append([(None, 0) if w > 1 else (key, a) for key, (a, _), w in zip(own, bounds, weights)])
    several: dict[int, list[tuple[int, bytes]]] = {}
    for key in strings:
        several.setdefault(key[0], []).append(key)
    starts: dict[tuple[int, bytes], np.ndarray] = {}
    batch: list[tuple[int, bytes]] = []

    def flush():
        if batch:
            starts.update(zip(batch, repeated_starts([k[1] for k in batch], [strings[k] for k in batch], length)))
            batch.clear()

    for keys in several.values():
        if len(keys) == 1:  # one string needs no order: all its places count
            starts[keys[0]] = np.arange(len(keys[0][1]) - length + 1) if strings[keys[0]] > 1 else np.zeros(0, np.int64)
            continue
        batch += keys
        if sum(len(k[1]) for k in batch) >= STRING_BYTES:
            flush()
    flush()
    out = []
    for (contexts, _, weights), placed in zip(grams, parts):
        out.append([np.arange(len(c) - length + 1) if w > 1 else starts[key] + a if key is not None else np.zeros(0, np.int64)
                    for c, w, (key, a) in zip(contexts, weights, placed)])
    return out


# -- anchors --------------------------------------------------------------------------------------------------------
_FACTOR = 0x9E3779B97F4A7C15
_BYTE = np.array([xxhash.xxh64_intdigest(bytes([b]), 17) for b in range(256)], np.uint64)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Polynomial hash modulo 2**64 of each ``gram`` bytes, mixed."""
    n = len(data) - gram + 1
    total, done = np.zeros(n, np.uint64), 0
    runs, size = _BYTE[data], 1  # hashes of all runs of ``size`` bytes
    while done < gram:
        if gram & size:  # append such a run
            total = total * np.uint64(pow(_FACTOR, size, 1 << 64)) + runs[done:done + n]
            done += size
        if done < gram:
            runs = runs[:-size] * np.uint64(pow(_FACTOR, size, 1 << 64)) + runs[size:]
            size *= 2
    total = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(32))


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return v if size == width else np.minimum(v[:len(v) - (width - size)], v[width - size:])


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``hash, position, first window, last window`` of each record of a text."""
    width = length - gram + 1
    windows = len(data) - length + 1
    parts = []
    for at in range(0, windows, CHUNK):  # a run of windows cut here becomes two records
        h = gram_hashes(data[at:at + CHUNK + length - 1], gram)
        spot = np.arange(len(h), dtype=np.uint64)
        # the smallest hash, and of equal ones the rightmost
        v = _sliding_min((h & ~np.uint64(LOW)) | (np.uint64(LOW) - spot), width)
        chosen = np.int64(LOW) - (v & np.uint64(LOW)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(chosen) - 1]])
        p = chosen[first]
        parts.append((h[p], p + at, first + at, last + at))
    return tuple(np.concatenate(x) for x in zip(*parts))


RECORD = "fp long, ctx long, _id long, _h long, first long, n int, at int"


def records(docs: DataFrame, length: int) -> DataFrame:
    """One row per record: hash of the gram, hash of the stretch, document, first window, number of windows, and the
    gram's place behind the first window's start."""

    def kernel(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            cols: list[list[np.ndarray]] = [[], [], [], [], [], [], []]
            for key, h, text in zip(*(c.to_pylist() for c in batch.columns)):
                raw = (text or "").encode()
                if len(raw) < length:
                    continue
                fp, at, first, last = anchors(np.frombuffer(raw, np.uint8), length, GRAM)
                ctx = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b + length]) for a, b in zip(first.tolist(), last.tolist())), np.uint64, len(first))
                for c, x in zip(cols, (fp.view(np.int64), ctx.view(np.int64), np.full(len(fp), key), np.full(len(fp), h), first, last - first + 1, at - first)):
                    c.append(x)
            kinds = (np.int64,) * 5 + (np.int32,) * 2
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(t) if c else np.zeros(0, t)) for c, t in zip(cols, kinds)],
                                             ["fp", "ctx", "_id", "_h", "first", "n", "at"])

    return with_key(docs.select("doc_id", "text")).select(*KEY, "text").mapInArrow(kernel, RECORD)


def packed(docs: DataFrame) -> DataFrame:
    """``doc_id, KEY, data``: the text's bytes, compressed for the shuffle."""

    def kernel(batches: Iterator[pa.RecordBatch]):
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data = [z.compress((t or "").encode()) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(data, pa.binary())], ["doc_id", *KEY, "data"])

    return (with_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", *KEY, "text")
            .mapInArrow(kernel, "doc_id long, _id long, _h long, data binary"))


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


def _sum(df: DataFrame, column: str) -> int:
    return df.agg(F.sum(column)).first()[0] or 0


# -- the operator ---------------------------------------------------------------------------------------------------
CONTEXT = "fp long, kinds long, gram long, ctx long, weight long, shift int, at int, low int, high int, bytes binary"


def fetch(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The contexts of ``wanted`` with their bytes, as CONTEXT: dealt by ``fp`` (of ``kinds`` contexts), belonging to
    ``gram, ctx``, whose bytes begin ``shift`` behind the context's; the gram is at ``at``, and windows start from
    ``low`` to ``high`` before it."""
    places = wanted.groupBy(*KEY).agg(F.collect_list(F.struct("fp", "kinds", "ctx", "weight", "first", "n", "at")).alias("places"))

    def kernel(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, 1 << 22):
            out = []
            for data, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = _unpack(data)
                out += [(p["fp"], p["kinds"], p["fp"], p["ctx"], p["weight"], 0, p["at"], 0, length - GRAM,
                         raw[p["first"]:p["first"] + p["n"] + length - 1]) for p in places]
            yield _context_batch(out)

    # rows that repeat a key bring the same bytes, so one of them is enough
    one = packed(docs).join(places, KEY).dropDuplicates(KEY)
    return one.select("data", "places").mapInArrow(kernel, CONTEXT)


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.int32()] * 4 + [pa.binary()]
    cols = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [c.split()[0] for c in CONTEXT.split(", ")])


def halves(contexts: DataFrame, length: int) -> DataFrame:
    """Contexts cut in two by where their windows start before the gram, each dealt by the bytes all of the half hold;
    those that share them with no other context are gone."""

    def kernel(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, 1 << 22):
            out = []
            for fp, _, gram, ctx, weight, shift, at, low, high, raw in zip(*(c.to_pylist() for c in batch.columns)):
                mid = (low + high) // 2
                for a, b in ((low, mid), (mid + 1, high)):
                    # window starts, as places in raw: from at - b to at - a, as far as the context has them
                    begin, end = max(0, at - b), min(len(raw) - length, at - a)
                    if begin > end:
                        continue
                    core = raw[at - a:at - b + length]  # in every window of the half
                    key = xxhash.xxh3_64_intdigest(core + bytes([a & 255]) + (fp & (1 << 64) - 1).to_bytes(8, "little"))
                    out.append((key - (1 << 64) if key >> 63 else key, 0, gram, ctx, weight, shift + begin, at - begin, a, b, raw[begin:end + length]))
            yield _context_batch(out)

    cut = written(contexts.mapInArrow(kernel, CONTEXT).drop("kinds"), "suffix-halves")
    sizes = written(cut.groupBy("fp").agg(F.count("*").alias("kinds"), F.sum("weight").alias("w")).where("w > 1"), "suffix-half-grams")
    return written(join_counted(cut, sizes, "fp", "kinds", _sum(sizes, "kinds")).select(*[c.split()[0] for c in CONTEXT.split(", ")]), "suffix-half")


RUNS = "array<struct<first:int,n:int>>"
FOUND = f"fp long, ctx long, runs {RUNS}"  #: repeated windows of a context, as runs of starts


def _runs(starts: np.ndarray) -> list[dict]:
    """Ascending starts as runs of neighbours."""
    edges = np.flatnonzero(np.diff(starts) != 1) + 1
    first = starts[np.concatenate([[0], edges])]
    n = np.diff(np.concatenate([[0], edges, [len(starts)]]))
    return [{"first": a, "n": b} for a, b in zip(first.tolist(), n.tolist())]



def by_suffix_arrays(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated starts of each context; all contexts of a gram meet in one bucket."""
    size = _sum(contexts.select(F.length("bytes").alias("size")), "size")
    buckets = max(1, -(-size // BUCKET_BYTES))

    def bucket(rows: pd.DataFrame) -> pd.DataFrame:
        grams = [g for _, g in rows.sort_values(["fp", "ctx", "shift"]).groupby("fp")]
        found = repeated_in_grams([(g["bytes"].tolist(), g["at"].tolist(), g.weight.tolist()) for g in grams], length)
        out = [(f, c, _runs(s + d)) for g, starts in zip(grams, found) for f, c, d, s in zip(g.gram, g.ctx, g["shift"], starts) if len(s)]
        return pd.DataFrame(out, columns=["fp", "ctx", "runs"])

    return contexts.groupBy(F.pmod(F.xxhash64("fp"), F.lit(buckets)).alias("bucket")).applyInPandas(bucket, FOUND)


def by_windows(contexts: DataFrame, length: int) -> DataFrame:
    """The same for grams of very many contexts, window by window."""

    def kernel(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, 1 << 20):
            out = [(gram, ctx, weight, xxhash.xxh3_128_digest(raw[s:s + length]), shift + s)
                   for _, _, gram, ctx, weight, shift, _, _, _, raw in zip(*(c.to_pylist() for c in batch.columns)) for s in range(len(raw) - length + 1)]
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32()))],
                                             ["fp", "ctx", "weight", "window", "start"])

    rows = written(contexts.mapInArrow(kernel, "fp long, ctx long, weight long, window binary, start int"), "suffix-windows")
    twice = written(rows.groupBy("window").agg(F.sum("weight").alias("w"), F.count("*").alias("m")).where("w > 1"), "suffix-twice")
    single = F.struct(F.col("start").alias("first"), F.lit(1).alias("n"))
    return join_counted(rows, twice, "window", "m", _sum(twice, "m")).groupBy("fp", "ctx").agg(F.collect_list(single).alias("runs"))


def starts_of(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated starts of all contexts, as FOUND; a context may have several rows."""
    found = by_suffix_arrays(contexts.where(F.col("kinds") <= CONTEXTS), length)
    large = contexts.where(F.col("kinds") > CONTEXTS)
    for _ in range(HALVINGS):
        if not large.limit(1).count():
            return found
        cut = halves(large, length)
        found = found.unionByName(by_suffix_arrays(cut.where(F.col("kinds") <= CONTEXTS), length))
        large = cut.where(F.col("kinds") > CONTEXTS)
    return found.unionByName(by_windows(large, length)) if large.limit(1).count() else found


def repeated(docs: DataFrame, length: int) -> DataFrame:
    """``_id, _h, spans``: per document the windows found, as ``first, n`` (n windows from a first on)."""
    all_records = written(records(docs, length), "suffix-records")
    shared = written(all_records.groupBy("fp").agg(F.count("*").alias("times")).where("times > 1"), "suffix-grams")
    near = written(join_counted(all_records, shared, "fp", "times", _sum(shared, "times")), "suffix-near")
    contexts = near.groupBy("fp", "ctx").agg(F.count("*").alias("weight"), F.min(F.struct(*KEY, "first", "n", "at")).alias("place"))
    contexts = written(contexts.select("fp", "ctx", "weight", "place.*"), "suffix-contexts")
    kinds = contexts.groupBy("fp").agg(F.count("*").alias("kinds"))
    # a gram with one context: all its windows are repeated; its records are those of its context
    single = F.col("kinds") == 1
    kinds = written(kinds, "suffix-kinds")
    told = written(join_counted(contexts, kinds, "fp", "kinds", _sum(kinds, "kinds")), "suffix-told")
    found = told.where(single).select("fp", "ctx", F.lit(None).cast(RUNS).alias("runs"))
    if told.where(~single).limit(1).count():
        contexts = written(fetch(docs, told.where(~single), length), "suffix-bytes")
        found = found.unionByName(starts_of(contexts, length))
    # back to all records of the contexts; the hash of the stretch is joined with its gram's
    mark = F.xxhash64("fp", "ctx")
    found = found.join(told.select("fp", "ctx", "weight"), ["fp", "ctx"]).withColumn("mark", mark)
    found = written(found, "suffix-found")
    hit = join_counted(near.withColumn("mark", mark).select("mark", "fp", "ctx", *KEY, "first", "n"),
                       found.select("mark", F.col("fp").alias("f"), F.col("ctx").alias("c"), "runs", "weight"), "mark", "weight", _sum(found, "weight"))
    hit = hit.where("fp = f and ctx = c")
    spans = F.when(F.col("runs").isNull(), F.array(F.struct("first", F.col("n").cast("int").alias("n")))).otherwise(
        F.transform("runs", lambda r: F.struct((F.col("first") + r["first"]).alias("first"), r["n"].alias("n"))))
    return hit.groupBy(*KEY).agg(F.flatten(F.collect_set(spans)).alias("spans"))


def cut(raw: bytes, spans: list[dict] | None, length: int) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left, and the maximal runs that went, as ``from, to``."""
    if not spans:
        return raw, []
    edges = np.zeros(len(raw) + 1, np.int64)
    for s in spans:
        edges[s["first"]] += 1
        edges[s["first"] + s["n"] + length - 1] -= 1
    gone = np.cumsum(edges)[:-1] > 0
    change = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), list(zip(change[::2].tolist(), change[1::2].tolist()))


def dedup(docs: DataFrame, length: int = 200) -> DataFrame:
    """``doc_id, n_bytes, removed, kept``: the removed runs (``from, to``) and the bytes that are left, per row."""
    joined = packed(docs).join(repeated(docs, length), KEY, "left").select("doc_id", "data", "spans")

    def kernel(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, 1 << 22):
            sizes, runs, kept = [], [], []
            for data, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = _unpack(data)
                left, gone = cut(raw, spans, length)
                sizes.append(len(raw))
                runs.append([{"from": a, "to": b} for a, b in gone])
                kept.append(left)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))),
                 pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    return joined.mapInArrow(kernel, "doc_id long, n_bytes long, removed array<struct<from:long,to:long>>, kept binary")


def digests(found: DataFrame) -> DataFrame:
    """What the query returns."""
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["to"] - x["from"])
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))

