"""Ranked lexical search with geometric blocks in each term's posting list.

Documents are vectors of integer impacts, one coordinate per term.  They are searched in segments of bounded size, so
an index moves nowhere and a lost executor repeats its own segments only:

1. Vectors.  One scan turns each text into the counts of the terms that some query holds; N, L and the document
   frequencies come from all rows of that (written) table.
2. Blocks.  In a segment, a term's posting list is clustered by document similarity: evenly spaced documents of the
   list are pivots, each document joins the pivot with the largest inner product (of idf-weighted vectors, randomly
   projected to SKETCH dimensions).  A block stores its coordinatewise maximum, rounded up to a byte.  A list is
   blocked when the first query opens it and kept for the others.
3. Search.  A query goes through its lists, rarest term first.  A block whose summary's product with the query is below
   the k-th best score so far cannot hold an answer and is skipped; of all other blocks every document is scored in
   full.  Documents met in list i and not before hold no earlier term, or were skipped for good, so bounds count terms
   from i on; when the maxima of the remaining lists cannot reach the k-th score, the rest is skipped as a whole.

Bounds are never below the score, so the result is that of scoring every document.  Queries are a stated set, taken in
blocks of ``block_terms`` terms (driver and broadcast hold one block) and, in a task, in parts of ``part_terms``.

Terms are runs of ASCII letters and digits and of characters beyond ASCII; A-Z are lower-cased.  Null and empty texts
have none: such documents count nowhere, such items give no rows.  Repeated rows are documents of their own; repeated
items get an answer each.  Equal scores go by ascending id, null first.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, slices, written

#: ASCII letters to lower case; other ASCII but digits to space.
TABLE = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))
CELLS = 1 << 23  #: documents times terms of a segment
BLOCK = 48  #: documents in a block, about
SKETCH = 32
STEP = 4096  #: of a summary's coordinates; an impact is 10**6 at most


@dataclass(frozen=True)
class Settings:
    block_terms: int = 1_000_000
    part_terms: int = 8192


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


# -- queries --------------------------------------------------------------------------------------------------------
@dataclass
class Queries:
    """A block of items: ``ids``, and for each the numbers of its distinct terms."""

    ids: list[int | None]
    vocabulary: dict[bytes, int]
    members: list[np.ndarray]

    @staticmethod
    def blocks(items: DataFrame, s: Settings) -> Iterator[Queries]:
        ids, vocabulary, members = [], {}, []
        for r in items.select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text").toLocalIterator():
            held = [vocabulary.setdefault(t, len(vocabulary)) for t in dict.fromkeys(terms(r.text))]
            if held:
                ids.append(r.item_id)
                members.append(np.array(held, np.int64))
            if len(vocabulary) >= s.block_terms:
                yield Queries(ids, vocabulary, members)
                ids, vocabulary, members = [], {}, []
        if ids:
            yield Queries(ids, vocabulary, members)

    def parts(self, weight: np.ndarray, s: Settings) -> list[Part]:
        """Items in runs whose terms number ``part_terms`` at most (or one item)."""
        out: list[Part] = []
        held: set[int] = set()
        run: list[int] = []
        for k, m in enumerate(self.members):
            more = set(m[weight[m] > 0].tolist())
            if run and len(held | more) > s.part_terms:
                out.append(Part.of(self, run, held, weight))
                held, run = set(), []
            held |= more
            run.append(k)
        return [*out, Part.of(self, run, held, weight)] if run else out


@dataclass
class Part:
    """Items whose terms are the columns of one matrix."""

    numbers: np.ndarray  #: of the columns' terms, rising
    weight: np.ndarray
    items: list[tuple[int, np.ndarray]]  #: item, its columns from the rarest term on
    sketch: np.ndarray

    @staticmethod
    def of(queries: Queries, run: list[int], held: set[int], weight: np.ndarray) -> Part:
        numbers = np.array(sorted(held), np.int64)
        own = weight[numbers]
        items = []
        for k in run:
            columns = np.searchsorted(numbers, m := queries.members[k][weight[queries.members[k]] > 0])
            items.append((k, columns[np.lexsort((m, -own[columns]))]))
        turn = np.random.default_rng(7).standard_normal((len(numbers), SKETCH), np.float32)
        return Part(numbers, own, items, turn * own[:, None].astype(np.float32))


# -- a segment ------------------------------------------------------------------------------------------------------
class Segment:
    """Documents as rows of impacts; ``lists`` are blocked on demand."""

    def __init__(self, part: Part, ids: np.ndarray, rows: np.ndarray, numbers: np.ndarray, impact: np.ndarray):
        """``rows, numbers, impact`` are the cells of the documents ``ids``; other terms than the part's are left out."""
        self.part, self.ids = part, ids
        at = np.minimum(np.searchsorted(part.numbers, numbers), max(len(part.numbers) - 1, 0))
        own = part.numbers[at] == numbers if len(part.numbers) else np.zeros(len(numbers), bool)
        rows, at, impact = rows[own], at[own], impact[own]
        self.impact = np.zeros((len(ids), len(part.numbers)), np.uint32)
        self.impact[rows, at] = impact
        self.code = ((self.impact + np.uint32(STEP - 1)) // np.uint32(STEP)).astype(np.uint8)  # rounded up
        order = np.lexsort((rows, at))
        self.postings, self.ends = rows[order], np.searchsorted(at[order], np.arange(len(part.numbers) + 1))
        self.most = self.code.max(axis=0, initial=0).astype(np.int64) * STEP * part.weight
        self.sketch: np.ndarray | None = None
        self.lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def blocked(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The list's documents by block, the blocks' ends, and their summaries."""
        if term not in self.lists:
            docs = self.postings[self.ends[term]:self.ends[term + 1]]
            if len(docs) > BLOCK:
                if self.sketch is None:
                    near = self.code.astype(np.float32) @ self.part.sketch
                    self.sketch = near / np.maximum(np.linalg.norm(near, axis=1, keepdims=True), 1e-9)
                count = -(-len(docs) // BLOCK)
                pivots = docs[np.arange(count) * len(docs) // count]
                group = (self.sketch[docs] @ self.sketch[pivots].T).argmax(axis=1)
                order = np.argsort(group, kind="stable")
                docs, group = docs[order], group[order]
                first = np.searchsorted(group, group)  # where the document's cluster begins
                cuts = np.flatnonzero((np.arange(len(docs)) - first) % (2 * BLOCK) == 0)
            else:
                cuts = np.zeros(min(len(docs), 1), np.int64)
            ends = np.append(cuts[1:], len(docs)) if len(cuts) else cuts
            summary = np.array([self.code[docs[a:b]].max(axis=0) for a, b in zip(cuts, ends)], np.uint8).reshape(len(cuts), -1)
            self.lists[term] = docs, np.append(0, ends), summary
        return self.lists[term]

    def search(self, columns: np.ndarray, best: Best) -> None:
        weight = self.part.weight[columns]
        rest = np.append(np.cumsum(self.most[columns][::-1])[::-1], 0)  # of the lists from here on
        seen = np.zeros(len(self.ids), bool)
        for i, term in enumerate(columns.tolist()):
            if rest[i] < best.least:
                return
            if self.ends[term] == self.ends[term + 1]:
                continue
            docs, ends, summary = self.blocked(term)
            bound = summary[:, columns[i:]].astype(np.int64) @ (weight[i:] * STEP)
            order = np.argsort(-bound, kind="stable")
            at, step = 0, 2
            while at < len(order):
                some = order[at:at + step]
                some = some[bound[some] >= best.least]
                if not len(some):
                    break
                found = np.concatenate([docs[ends[b]:ends[b + 1]] for b in some.tolist()])
                found = found[~seen[found]]
                if len(found):
                    seen[found] = True
                    best.add(self.impact[np.ix_(found, columns)].astype(np.int64) @ weight, self.ids[found])
                at, step = at + step, 2 * step


class Best:
    """The ``k`` first of the documents scored so far, and the score below which none can come in."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = scores[keep := scores >= self.least], ids[keep]
        if len(scores):
            scores, ids = np.append(self.scores, scores), np.append(self.ids, ids)
            order = np.lexsort((ids, -scores))[:self.k]
            self.scores, self.ids = scores[order], ids[order]


# -- over all documents ---------------------------------------------------------------------------------------------
def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, counts`` of each document with a term: its length, and the vocabulary's terms it holds."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def kernel(batches: Iterator[pa.RecordBatch]):
        number = shared.value
        for batch in slices(batches, 8 << 20):
            ids, lens, flat, counts, ends = [], [], [], [], [0]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ts = terms(text)
                if ts:
                    count = Counter(ts)
                    held = number.keys() & count.keys()
                    ids.append(i)
                    lens.append(len(ts))
                    flat += [number[t] for t in held]
                    counts += [count[t] for t in held]
                    ends.append(len(flat))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(lens, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32())),
                pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32()))], ["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        kernel, "doc_id long, n long, terms array<int>, counts array<int>")


def weights(table: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """N, L and each term's weight (0 for terms no document holds)."""
    total = table.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    out = np.zeros(size, np.int64)
    for r in table.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toLocalIterator():
        out[r.t] = math.floor(1000 * math.log((2 * total.n + 2) / (2 * r.df + 1)))
    return total.n, total.l or 0, out


def _segments(batch: pa.RecordBatch, n: int, length: int) -> tuple:
    ids = batch.column(0).fill_null(NULL_ID).to_numpy()
    damp = np.array([10 + 90 * k * n // length for k in batch.column(1).to_pylist()], np.int64)
    lens = batch.column(2).value_lengths().to_numpy()
    rows = np.repeat(np.arange(len(ids)), lens)
    numbers = batch.column(2).flatten().to_numpy().astype(np.int64)
    tf = batch.column(3).flatten().to_numpy().astype(np.int64)
    return ids, rows, numbers, 1_000_000_000 * tf // (1000 * tf + 8 * damp[rows])


def search(docs: DataFrame, items: DataFrame, k: int = 10, s: Settings = Settings()) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item."""
    spark = docs.sparkSession
    schema = "item int, item_id long, doc_id long, score long"
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")

    def kernel_of(shared):
        def kernel(batches: Iterator[pa.RecordBatch]):
            queries, parts, n, length = shared.value
            best = [Best(k) for _ in queries.ids]
            widest = max((len(p.numbers) for p in parts), default=1)
            most = max(64, min(4096, CELLS // max(widest, 1)))
            for whole in batches:
                pieces = -(-whole.num_rows // most)
                for piece in range(pieces):
                    a, b = piece * whole.num_rows // pieces, (piece + 1) * whole.num_rows // pieces
                    cells = _segments(whole.slice(a, b - a), n, length)
                    for part in parts:
                        segment = Segment(part, *cells)
                        for item, columns in part.items:
                            segment.search(columns, best[item])
            for item, b in enumerate(best):
                if len(b.ids):
                    ids = pa.array(b.ids, mask=b.ids == NULL_ID)
                    yield pa.RecordBatch.from_pydict({
                        "item": pa.array([item] * len(ids), pa.int32()), "item_id": pa.array([queries.ids[item]] * len(ids), pa.int64()),
                        "doc_id": ids, "score": pa.array(b.scores)})
        return kernel

    for queries in Queries.blocks(items, s):
        table = written(vectors(docs, queries.vocabulary), "term-vectors")
        n, length, weight = weights(table, len(queries.vocabulary))
        shared = spark.sparkContext.broadcast((Queries(queries.ids, {}, []), queries.parts(weight, s), n, length))
        first = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
        ranked = table.mapInArrow(kernel_of(shared), schema).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
        out = out.unionByName(ranked.select("item_id", "rank", "doc_id", "score"))
    return out


def oracle_sql(k: int = 10) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    of = lambda text: (f"regexp_extract_all(translate(coalesce({text}, ''), '{upper}', '{lower}'), "  # noqa: E731
                       "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {of('text')} AS ts FROM documents),
sized AS (SELECT r, doc_id, ts, CAST(len(ts) AS BIGINT) AS n FROM d WHERE len(ts) > 0),
g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM sized),
i AS (SELECT row_number() OVER () AS i, item_id, {of('text')} AS ts FROM benchmark),
q AS (SELECT i, item_id, unnest(list_distinct(ts)) AS term FROM i),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(ts) AS term FROM sized)
      WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM p GROUP BY term), g),
v AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length))) AS part
      FROM p JOIN w USING (term), g),
s AS (SELECT i, item_id, r, doc_id, CAST(sum(part) AS BIGINT) AS score FROM q JOIN v USING (term) GROUP BY ALL HAVING sum(part) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score
FROM s QUALIFY rank <= {k}"""
