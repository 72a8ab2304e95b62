"""SimHash near-duplicates by tiled exact comparison.

The distinct fingerprints are dealt into tiles by population count.  Two fingerprints within ``radius`` bits differ
in population count by ``radius`` at most, so tile pairs further apart are skipped; every other pair of tiles is
compared in full, as numpy blocks of exclusive-or and bit counts.  Inside a pair the same bound holds for blocks and
for the population counts of the four 16-bit parts.  A pair of tiles returns a spanning forest of its links, at most
one row per fingerprint, and the components of all forests are the classes.

Exact copies meet as one fingerprint, so groups of copies cost nothing here.  Texts without words have fingerprint
zero and are linked like any other; null counts as empty.  Work grows with the square of the number of distinct
fingerprints divided by what the bounds skip; moved rows grow linearly up to TILE * TILES fingerprints.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, components, join_counted, with_key, written

SEED = 42
TILES = 24  #: tiles at least, so that pairs of them spread over the cluster
TILE = 1 << 16  #: fingerprints in a tile at most, about
BLOCK = 512



def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash over word shingles, as a signed integer."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lens) - 1
    n = max(1, len(words) - shingle + 1)
    starts = (ends - lens + 1)[:n].tolist()
    stops = ends[shingle - 1:].tolist() if len(words) >= shingle else [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), "<u8", n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        part = hashes[at:at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``doc_id, _id, _h, fp`` per row."""

    def kernel(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            fps = [fingerprint(t, shingle) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fps, pa.int64())], ["doc_id", "_id", "_h", "fp"])

    return (with_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", *KEY, "text")
            .mapInArrow(kernel, "doc_id long, _id long, _h long, fp long"))


# -- tiles ----------------------------------------------------------------------------------------------------------
def plan_tiles(sizes: dict[int, int], radius: int) -> tuple[dict[int, tuple[int, int]], list[list[list[int]]]]:
    """From the number of fingerprints by population count: ``first tile, splits`` of each count, and the pairs of
    tiles, by tile, whose counts are within ``radius``."""
    total = sum(sizes.values())
    goal = max(1, -(-total // max(TILES, -(-total // TILE))))
    where: dict[int, tuple[int, int]] = {}
    ranges: list[list[int]] = []
    filled = goal
    for pop in sorted(sizes):
        splits = -(-sizes[pop] // goal)
        if splits > 1:
            where[pop] = (len(ranges), splits)
            ranges += [[pop, pop] for _ in range(splits)]
            filled = goal
        else:
            if filled + sizes[pop] > goal:
                ranges.append([pop, pop])
                filled = 0
            ranges[-1][1] = pop
            where[pop] = (len(ranges) - 1, 1)
            filled += sizes[pop]
    pairs: list[list[list[int]]] = [[] for _ in ranges]
    for i, (_, hi) in enumerate(ranges):
        for j in range(i, len(ranges)):
            if ranges[j][0] - hi > radius:
                break
            pairs[i].append([i, j])
            if i != j:
                pairs[j].append([i, j])
    return where, pairs


def _profile(fps: np.ndarray) -> np.ndarray:
    """Population counts: of all bits, then of each 16-bit part."""
    parts = np.bitwise_count(fps.view(np.uint16).reshape(-1, 4)).astype(np.int16)
    return np.column_stack([parts.sum(axis=1), parts])


def _ordered(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    profile = _profile(fps)
    order = np.lexsort(profile.T[::-1])
    return fps[order], profile[order]


class Forest:
    """Smallest index of each class, by hooking and pointer jumping."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        root = self.root
        while True:
            a, b = root[u], root[v]
            apart = a != b
            if not apart.any():
                return
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (up := root[root]).tobytes() != root.tobytes():
                root[:] = up


def linked(left: np.ndarray, right: np.ndarray | None, radius: int) -> np.ndarray:
    """A spanning forest of the links between two tiles (``right`` None: inside one), rows of two fingerprints."""
    if not len(left) or right is not None and not len(right):
        return np.zeros((0, 2), np.uint64)
    a, pa_ = _ordered(left)
    b, pb = (a, pa_) if right is None else _ordered(right)
    shift = 0 if right is None else len(a)
    forest = Forest(len(a) + (0 if right is None else len(b)))
    spans = lambda p: [(p[i:i + BLOCK].min(axis=0), p[i:i + BLOCK].max(axis=0)) for i in range(0, len(p), BLOCK)]
    span_a, span_b = spans(pa_), spans(pb)
    low_b, high_b = np.array([x[0] for x in span_b]), np.array([x[1] for x in span_b])
    for i, (low, high) in enumerate(span_a):
        gap = np.maximum(0, np.maximum(low_b - high, low - high_b))
        near = np.maximum(gap[:, 0], gap[:, 1:].sum(axis=1)) <= radius
        for j in np.flatnonzero(near).tolist():
            if right is None and j < i:
                continue
            x, y = a[i * BLOCK:(i + 1) * BLOCK], b[j * BLOCK:(j + 1) * BLOCK]
            u, v = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
            if len(u):
                forest.link(u + i * BLOCK, v + j * BLOCK + shift)
    nodes = a if right is None else np.concatenate([a, b])
    child = np.flatnonzero(forest.root != np.arange(len(nodes)))
    return np.column_stack([nodes[child], nodes[forest.root[child]]])


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """``u, v``: forests of the links between the fingerprints of ``distinct`` (a written table, column ``fp``)."""
    pop = F.bit_count("fp")
    sizes = {r.pop: r["count"] for r in distinct.groupBy(pop.alias("pop")).count().collect()}  # 65 rows at most
    where, pairs = plan_tiles(sizes, radius)
    at = F.from_json(F.lit(json.dumps([where.get(p, (0, 1)) for p in range(65)])), "array<array<int>>")[pop]
    of_tile = F.from_json(F.lit(json.dumps(pairs or [[]])), "array<array<array<int>>>")
    dealt = (distinct.select("fp", (at[0] + F.pmod(F.xxhash64("fp"), at[1].cast("long"))).cast("int").alias("tile"))
             .select("fp", "tile", F.explode(of_tile[F.col("tile")]).alias("pair"))
             .select("fp", "tile", F.col("pair")[0].alias("i"), F.col("pair")[1].alias("j")))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = int(rows.i.iloc[0]), int(rows.j.iloc[0])
        fps, tile = rows.fp.to_numpy().view(np.uint64), rows.tile.to_numpy()
        found = linked(fps, None, radius) if i == j else linked(fps[tile == i], fps[tile == j], radius)
        found = found.view(np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": found[:, 0], "v": found[:, 1]})

    return dealt.groupBy("i", "j").applyInPandas(compare, "u long, v long")


def classes(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """``doc_id, _id, _h, fp, component_id`` per row; the id is the smallest of the class (null ids do not count)."""
    rows = written(fingerprints(docs, shingle), "simhash")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "fingerprints")
    roots = written(components(links(distinct, radius), "simhash"), "classes")
    total = distinct.agg(F.sum("n")).first()[0] or 0
    member = roots.join(distinct.select(F.col("fp").alias("node"), "least"), "node")
    least = member.groupBy("root").agg(F.min("least").alias("class_least"))
    sizes = roots.groupBy("root").agg(F.count("*").alias("_members")).join(least, "root")
    sizes = written(sizes, "class-least")
    named = join_counted(roots, sizes, "root", "_members", sizes.agg(F.sum("_members")).first()[0] or 0)
    by_fp = distinct.join(named.select(F.col("node").alias("fp"), "class_least"), "fp", "left").select(
        "fp", "n", F.coalesce("class_least", "least").alias("component_id"))
    return join_counted(rows, written(by_fp, "class-of"), "fp", "n", total).drop("n")


def digests(found: DataFrame) -> DataFrame:
    """What the query returns."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the one with the smallest id, null last."""
    found = written(classes(docs, shingle, radius), "simhash-classes")
    # a class without any id is named by none; its fingerprint class stands for it
    stay = found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("_fp")).agg(
        F.min(F.struct(F.col("doc_id").isNull(), *KEY)).alias("k")).select("k._id", "k._h")
    rows = with_key(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")).select("row", *KEY)
    return rows.join(stay, KEY, "left_semi").dropDuplicates(KEY).select("row.*")
