"""Jaccard self-join of word shingles with adaptive multi-match prefixes.

A document's set holds its distinct shingles as 64-bit hashes in one global order, rare ones first.  Its l-prefix is the
first ``n - ceil(t * n) + l`` of them: two sets with a Jaccard similarity of t or more share at least l tokens of their
l-prefixes, whatever the order and for every l.  If each set picks its own l, a pair must share the smaller of the two.

1. Order.  One scan counts how many documents hold a shingle in a sketch of SKETCH counters (fixed size, all documents;
   a counter may serve several shingles, which only makes the order less sharp).  Counters, coded in eighths of powers of
   two, and then the hash make the order.
2. Prefixes.  Each set lengthens its prefix from a twentieth of its size on to where the estimated cost is least: tokens
   to shuffle, plus the candidates that the prefix's counts predict, divided by the matches then required.
3. Groups.  Prefix tokens are sorted by token.  All sets that share a token get the smallest of their ids as hub, so
   both sets of any pair meet in a group.  Sets whose shared tokens are fewer than the matches required of any set of a
   size they could link with leave here; the others' shingles are fetched by one more scan.
4. Verification.  Groups are cut into tiles of about TILE tokens, each with the hub's set.  In a tile, a set's shared
   prefix tokens with all others are counted; pairs with enough of them, of linkable sizes and not yet connected are
   compared exactly.  A tile returns a forest of its links.
5. Tiles of one group are then compared with each other, save pairs of tiles that hold one and the same component only:
   a large group of near copies is done after step 4, as all of them link with the hub.

Exact copies are one set; sets of fewer than ``least_size`` shingles can link with nothing but copies.  Texts without
words are linked with nothing, each row for itself; null texts are empty.  Components carry the smallest id (null ids do
not count; without any id it is null).  Repeated rows are copies of each other.  Two sets or shingles are taken for
equal if their 64-bit hashes are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, join_counted, slices, written

BATCH_BYTES = 4 << 20
SKETCH = 1 << 23  #: counters of the frequency sketch
CHUNK = 1 << 16
TILE = 1 << 16  #: tokens in a tile, about
BLOOM = 1 << 25  #: bits of the filter of wanted sets
WORDS_KEPT = 1 << 18  #: word hashes a task keeps at most
VERIFY = 20.0  #: cost of comparing a candidate, in shuffled tokens
MIX = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


@dataclass(frozen=True)
class Settings:
    shingle: int = 4
    percent: int = 85  #: pairs link if 100 * intersection >= percent * union
    base: int = 20  #: one token in so many is the fewest matches required

    def overlap(self, n):
        """Tokens that a set of n must share with any set it links with."""
        return (self.percent * n + 99) // 100

    def least_matches(self, n):
        return np.maximum(1, n // self.base)

    @property
    def least_size(self) -> int:
        """The smallest set that can link with a different one, which then has one token more."""
        return next(n for n in range(1, 10**6) if 100 * n >= self.percent * (n + 1))


# -- sets -----------------------------------------------------------------------------------------------------------
class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, hashes: WordHashes, size: int = 4) -> np.ndarray:
    """The distinct shingles' hashes, rising; fewer words than ``size`` are one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out ^ h[k:k + n]) * MIX[k % len(MIX)]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def set_id(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


def _slots(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(17)).astype(np.int64) & (SKETCH - 1)


def _scan(docs: DataFrame, kernel, schema: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(kernel, schema)


def sized(docs: DataFrame, s: Settings) -> DataFrame:
    """Per row ``doc_id, set, n``; and, with ``chunk`` not null, parts of the sketch's counts."""

    def kernel(batches: Iterator[pa.RecordBatch]):
        counts, hashes = np.zeros(SKETCH, np.uint32), WordHashes()
        none = lambda n, kind: pa.nulls(n, kind)
        for batch in slices(batches, BATCH_BYTES):
            ids, lens, slots = [], [], []
            for text in batch.column(1).to_pylist():
                tokens = shingle_set(text, hashes, s.shingle)
                ids.append(set_id(tokens))
                lens.append(len(tokens))
                if len(tokens) >= s.least_size:
                    slots.append(_slots(tokens))
            for some in slots:
                np.add.at(counts, some, np.uint32(1))
            n = len(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.int64()), pa.array(lens, pa.int64()),
                                              none(n, pa.int32()), none(n, pa.binary())], ["doc_id", "set", "n", "chunk", "counts"])
        for at in range(SKETCH // CHUNK):
            part = counts[at * CHUNK:(at + 1) * CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays([none(1, pa.int64()), none(1, pa.int64()), none(1, pa.int64()), pa.array([at], pa.int32()),
                                                  pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["doc_id", "set", "n", "chunk", "counts"])

    return _scan(docs, kernel, "doc_id long, set long, n long, chunk int, counts binary")


def sketch_of(parts: DataFrame) -> np.ndarray:
    """The sketch's counts as codes: SKETCH bytes, whatever the input."""

    def add(batches: Iterator[pa.RecordBatch]):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[at] = total.get(at, 0) + np.frombuffer(zlib.decompress(data), np.uint32).astype(np.uint64)
        for at, counts in total.items():
            code = np.ceil(8 * np.log2(counts + 1.0)).clip(0, 255).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([at], pa.int32()), "codes": pa.array([code.tobytes()], pa.binary())})

    codes = np.zeros(SKETCH, np.uint8)
    summed = parts.select("chunk", "counts").repartition(SKETCH // CHUNK, "chunk").mapInArrow(add, "chunk int, codes binary")
    for r in summed.toLocalIterator():  # SKETCH bytes in all
        codes[r.chunk * CHUNK:(r.chunk + 1) * CHUNK] = np.frombuffer(r.codes, np.uint8)
    return codes


# -- prefixes -------------------------------------------------------------------------------------------------------
class Order:
    """The global order of tokens and what a token is expected to cost."""

    def __init__(self, codes: np.ndarray, s: Settings):
        self.codes, self.s = codes, s
        noise = float(np.median(codes))
        count = 2.0 ** (np.arange(256) / 8) - 1
        #: sets that hold a token of this code, besides those the sketch would show for any token
        self.others = np.maximum(count - (2.0 ** (noise / 8) - 1) * 2, 0)

    def sort(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rare ones first, with their codes; ``tokens`` rise."""
        code = self.codes[_slots(tokens)]
        order = np.argsort(code, kind="stable")
        return tokens[order], code[order]

    def matches(self, code: np.ndarray) -> int:
        """The number of prefix matches to require of a set, by estimated cost."""
        n, s = len(code), self.s
        least = int(s.least_matches(n))
        first = n - s.overlap(n)
        options = np.unique(np.minimum(s.overlap(n), least * np.array([1, 2, 3, 4, 6])))
        load = np.cumsum(self.others[code])
        ends = first + options
        cost = ends + VERIFY * load[ends - 1] / options
        return int(options[cost.argmin()])

    def prefix(self, tokens: np.ndarray) -> tuple[np.ndarray, int]:
        tokens, code = self.sort(tokens)
        match = self.matches(code)
        return tokens[:len(tokens) - self.s.overlap(len(tokens)) + match], match


def postings(docs: DataFrame, order, s: Settings) -> DataFrame:
    """``token, set, n`` for each prefix token."""

    def kernel(batches: Iterator[pa.RecordBatch]):
        hashes, ranks = WordHashes(), order.value
        names = ["token", "set", "n"]
        for batch in slices(batches, BATCH_BYTES):
            found: dict[int, tuple[np.ndarray, int]] = {}
            for text in batch.column(1).to_pylist():
                tokens = shingle_set(text, hashes, s.shingle)
                if len(tokens) >= s.least_size and (i := set_id(tokens)) not in found:
                    found[i] = ranks.prefix(tokens)[0], len(tokens)
            if found:
                lens = [len(p) for p, _ in found.values()]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([p for p, _ in found.values()]).view(np.int64)), pa.array(np.repeat(np.array(list(found), np.int64), lens)),
                    pa.array(np.repeat([n for _, n in found.values()], lens).astype(np.int32))], names)

    return _scan(docs, kernel, "token long, set long, n int")


def memberships(rows: DataFrame) -> DataFrame:
    """``set, n, hub, shared``: per set and hub the tokens they meet by.  Tokens of one set only fall away."""

    def kernel(batches: Iterator[pa.RecordBatch]):
        names = ["set", "n", "hub"]
        token = hub = last = None  # of the run that is open
        held: pa.RecordBatch | None = None  # its first row, until a second set shows that the run counts
        for batch in batches:
            t, i = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(t):
                continue
            again = np.append(t[0] == token and i[0] == last, (t[1:] == t[:-1]) & (i[1:] == i[:-1]))  # copies
            rows = np.flatnonzero(~again)
            if not len(rows):
                continue
            t, i, batch = t[rows], i[rows], batch.take(pa.array(rows))
            new = np.append(t[0] != token, t[1:] != t[:-1])
            run = np.cumsum(new)
            starts = np.flatnonzero(new)
            hubs = np.append(hub if hub is not None else 0, i[starts])[run]
            sizes = np.bincount(run, minlength=int(run[-1]) + 1)
            counts = sizes[run] > 1
            if not new[0]:
                counts[run == 0] = True  # goes on from an earlier batch
                if held is not None:
                    yield held
            held = None
            kept = np.flatnonzero(counts)
            if len(kept):
                some = batch.take(pa.array(kept))
                yield pa.RecordBatch.from_arrays([*some.columns[1:], pa.array(hubs[kept])], names)
            token, hub, last = t[-1], hubs[-1], i[-1]
            if not counts[-1]:
                end = batch.slice(batch.num_rows - 1)
                held = pa.RecordBatch.from_arrays([*end.columns[1:], pa.array(hubs[-1:])], names)

    return (rows.repartition("token").sortWithinPartitions("token", "set").mapInArrow(kernel, "set long, n int, hub long")
            .groupBy("set", "hub").agg(F.first("n").alias("n"), F.count("*").alias("shared")))


def candidates(found: DataFrame, s: Settings) -> DataFrame:
    """``g, at, class, set, n``: memberships of the sets that share enough prefix tokens to link with anything.

    Groups are split by size: sets that link are at most one class of sizes apart, so a set goes to the groups of its
    class and of the next; ``at`` is the group's class.  ``found`` is written.
    """
    enough = F.greatest(F.lit(1), F.floor(F.floor((F.lit(s.percent) * F.col("n") + 99) / 100) / s.base))
    stay = found.groupBy("set").agg(F.sum("shared").alias("all"), F.max("n").alias("n")).where(F.col("all") >= enough).select("set")
    ratio = -float(np.log(s.percent / 100))
    kept = found.join(stay, "set", "left_semi").withColumn("class", F.floor(F.log("n") / ratio + 1e-6).cast("int"))
    placed = kept.select("hub", "set", "n", "class", F.explode(F.array(F.col("class"), F.col("class") + 1)).alias("at"))
    return placed.select(F.xxhash64("hub", "at").alias("g"), "at", "class", "set", "n")


# -- verification ---------------------------------------------------------------------------------------------------
class Tile:
    """Sets that may link: shared prefix tokens are counted, candidates compared, classes kept."""

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray], order: Order, labels: np.ndarray | None = None):
        self.ids, self.sets, self.s = ids, sets, order.s
        self.lens = np.array([len(x) for x in sets], np.int64)
        prefixes = [order.prefix(x) for x in sets]
        self.match = np.array([m for _, m in prefixes], np.int64)
        number = np.unique(np.concatenate([p for p, _ in prefixes]), return_inverse=True)[1]
        row = np.repeat(np.arange(len(sets)), [len(p) for p, _ in prefixes])
        by = np.argsort(number, kind="stable")
        self.holders, self.ends = row[by], np.searchsorted(number[by], np.arange(number.max(initial=-1) + 2))
        self.prefix = np.split(number, np.cumsum([len(p) for p, _ in prefixes])[:-1])
        self.root = np.unique(labels, return_inverse=True)[1] if labels is not None else np.arange(len(sets))
        self.links: list[tuple[int, int]] = []

    def _meet(self, i: int, open_: np.ndarray) -> None:
        lists = [self.holders[self.ends[t]:self.ends[t + 1]] for t in self.prefix[i].tolist()]
        shared = np.bincount(np.concatenate(lists), minlength=len(self.sets))
        n, lens = self.lens[i], self.lens
        near = open_ & (self.root != self.root[i]) & (shared >= np.minimum(self.match, self.match[i]))
        near &= 100 * np.minimum(n, lens) >= self.s.percent * np.maximum(n, lens)
        for j in np.flatnonzero(near).tolist():
            if self.root[j] != self.root[i]:
                common = n + lens[j] - len(np.union1d(self.sets[i], self.sets[j]))
                if 100 * common >= self.s.percent * (n + lens[j] - common):
                    self.links.append((int(self.ids[i]), int(self.ids[j])))
                    self.root[self.root == self.root[j]] = self.root[i]

    def forest(self, first: int) -> list[tuple[int, int]]:
        """Links that connect all that belong together.  A set is done when it has met all open ones, and nothing is left
        to find when these are one component; so after the set ``first``, members of small components go first."""
        open_ = np.ones(len(self.sets), bool)
        i = first
        while True:
            open_[i] = False
            self._meet(i, open_)
            left = np.flatnonzero(open_)
            roots, at, sizes = np.unique(self.root[left], return_inverse=True, return_counts=True)
            if len(roots) < 2:
                return self.links
            i = int(left[sizes[at].argmin()])

    def across(self, left: np.ndarray) -> list[tuple[int, int]]:
        """Links between the sets ``left`` and the others."""
        for i in np.flatnonzero(left).tolist():
            self._meet(i, ~left)
        return self.links


def fetched(docs: DataFrame, wanted: DataFrame, s: Settings) -> DataFrame:
    """``set, tokens`` (bytes of rising hashes) of the sets in ``wanted``: a scan thinned by a filter of BLOOM bits."""

    def mark(batches: Iterator[pa.RecordBatch]):
        bits = np.zeros(BLOOM, bool)
        for batch in batches:
            bits[batch.column(0).to_numpy().view(np.uint64) & np.uint64(BLOOM - 1)] = True
        packed = np.packbits(bits)
        for at in range(0, len(packed), CHUNK):
            if packed[at:at + CHUNK].any():
                yield pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int32()), "bits": pa.array([zlib.compress(packed[at:at + CHUNK].tobytes(), 1)], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[at] = total.get(at, 0) | np.frombuffer(zlib.decompress(data), np.uint8)
        for at, bits in total.items():
            yield pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})

    packed = np.zeros(BLOOM // 8, np.uint8)
    parts = wanted.select("set").mapInArrow(mark, "at int, bits binary").repartition(BLOOM // 8 // CHUNK, "at")
    for r in parts.mapInArrow(merge, "at int, bits binary").toLocalIterator():  # BLOOM bits in all
        packed[r["at"]:r["at"] + CHUNK] = np.frombuffer(r.bits, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(packed)

    def kernel(batches: Iterator[pa.RecordBatch]):
        hashes, bits = WordHashes(), shared.value
        for batch in slices(batches, BATCH_BYTES):
            found: dict[int, bytes] = {}
            for text in batch.column(1).to_pylist():
                tokens = shingle_set(text, hashes, s.shingle)
                if len(tokens) >= s.least_size and (i := set_id(tokens)) not in found and bits[(k := i & (BLOOM - 1)) >> 3] >> (7 - (k & 7)) & 1:
                    found[i] = tokens.tobytes()
            yield pa.RecordBatch.from_pydict({"set": pa.array(list(found), pa.int64()), "tokens": pa.array(list(found.values()), pa.binary())})

    return (_scan(docs, kernel, "set long, tokens binary").join(wanted, "set", "left_semi")
            .groupBy("set").agg(F.first("tokens").alias("tokens")))


def compared(dealt: DataFrame, order) -> DataFrame:
    """``u, v``: a forest of the links in each tile.  Rows of ``dealt``: ``g, tile, side, set, label, tokens``; a tile
    with one side is compared in full, one with two sides across; sets with equal labels are known to be connected."""

    def links_of(rows: list[tuple], ranks: Order) -> list[tuple[int, int]]:
        rows = list({r[1]: r for r in rows}.values())  # the hub may be there twice
        if len(rows) < 2:
            return []
        tile = Tile(np.array([r[1] for r in rows], np.int64), [np.frombuffer(r[3], np.uint64) for r in rows], ranks,
                    np.array([r[2] for r in rows], np.int64))
        side = np.array([r[0] for r in rows])
        return tile.across(side == 0) if side.any() else tile.forest(int(tile.ids.argmin()))

    def kernel(batches: Iterator[pa.RecordBatch]):
        ranks, key, rows = order.value, None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for at, row in zip(keys, zip(*[c.to_pylist() for c in batch.columns[2:]])):
                if at != key:
                    out += links_of(rows, ranks)
                    key, rows = at, []
                rows.append(row)
            yield _edges(out)
        yield _edges(links_of(rows, ranks))

    return (dealt.select("g", "tile", "side", "set", "label", "tokens").repartition("g", "tile").sortWithinPartitions("g", "tile")
            .mapInArrow(kernel, "u long, v long"))


def _edges(links: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(links, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])


def links(docs: DataFrame, order, s: Settings) -> DataFrame:
    """``u, v``: a forest of the links between different sets."""
    members = written(candidates(written(memberships(postings(docs, order, s)), "ngram-memberships"), s), "ngram-candidates")
    groups = members.groupBy("g").agg(F.count("*").alias("size"), F.sum("n").alias("weight"), F.max("class").alias("_top"),
                                      F.first("at").alias("_at"), F.min("set").alias("hub"))
    # members of one class meet in their own class's group; the next class's has them for its own members only
    groups = groups.where("size > 1 and _top = _at").select(
        "g", "size", "hub", F.ceil(F.col("weight") / TILE).cast("int").alias("tiles"))
    groups = written(groups, "ngram-groups")
    total = groups.agg(F.sum("size")).first()[0] or 0
    placed = join_counted(members.select("g", "set", "n"), groups, "g", "size", total)
    placed = written(placed.withColumn("tile", F.pmod(F.xxhash64("set"), F.col("tiles").cast("long")).cast("int")), "ngram-placed")
    sets = written(fetched(docs, placed.select("set").distinct(), s), "ngram-sets")
    # each tile has its group's hub too
    of_hub = groups.where("tiles > 1").select("g", F.col("hub").alias("set"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    dealt = placed.select("g", "set", "tile").unionByName(of_hub)
    alone = {"side": F.lit(0), "label": F.col("set")}
    first = written(compared(dealt.join(sets, "set").withColumns(alone), order), "ngram-links")
    large = placed.where("tiles > 1")
    if large.isEmpty():
        return first
    return first.unionByName(written(compared(_rest(large, first, groups).join(sets, "set"), order), "ngram-links"))


def _rest(large: DataFrame, first: DataFrame, groups: DataFrame) -> DataFrame:
    """``g, tile, side, set, label``: the pairs of tiles that still have to be compared.

    A group's members outside its largest component are dealt into tiles of their own; each of these is compared in
    full, with each other one, and with each tile of the largest component.
    """
    roots = written(components(first, "ngram-first"), "ngram-roots")
    named = large.join(roots.select(F.col("node").alias("set"), "root"), "set", "left").withColumn("label", F.coalesce("root", "set"))
    named = written(named.select("g", "set", "n", "tile", "tiles", "label"), "ngram-labelled")
    parts = written(named.groupBy("g", "label").agg(F.count("*").alias("size"), F.sum("n").alias("weight")), "ngram-parts")
    main = parts.groupBy("g").agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.sum("size").alias("size"),
                                  (F.sum("weight") - F.max_by("weight", F.struct("size", "label"))).alias("other"))
    main = written(main.where("other > 0").withColumn("others", F.ceil(F.col("other") / TILE).cast("int")), "ngram-main")
    total = main.agg(F.sum("size")).first()[0] or 0
    rows = join_counted(named, main, "g", "size", total)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("set"), F.col("others").cast("long")).cast("int"))
    is_main = F.col("label") == F.col("main")
    each = lambda n: F.sequence(F.lit(0), n - 1)
    tile = lambda a, b, side: F.struct(F.concat_ws("-", a, b).alias("tile"), F.lit(side).alias("side"))
    own = F.col("own").cast("string")
    with_main = F.when(is_main, F.transform(each(F.col("others")), lambda a: tile(a.cast("string"), F.concat(F.lit("m"), F.col("tile")), 1)))
    with_main = with_main.otherwise(F.transform(each(F.col("tiles")), lambda j: tile(own, F.concat(F.lit("m"), j), 0)))
    # tile a with tile b: a below b is side 0; a with itself has side 0 only
    among = F.transform(each(F.col("others")), lambda b: F.when(
        b >= F.col("own"), tile(own, b.cast("string"), 0)).otherwise(tile(b.cast("string"), own, 1)))
    places = F.concat(with_main, F.when(is_main, F.array().cast("array<struct<tile:string,side:int>>")).otherwise(among))
    return rows.select("g", "set", "label", F.explode(places).alias("p")).select("g", "p.tile", "p.side", "set", "label")


# -- classes --------------------------------------------------------------------------------------------------------
def classes(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row."""
    spark = docs.sparkSession
    scanned = written(sized(docs, s), "ngram-sets-of-rows")
    order = spark.sparkContext.broadcast(Order(sketch_of(scanned.where(F.col("chunk").isNotNull())), s))
    rows = scanned.where(F.col("chunk").isNull()).select("doc_id", "set", F.col("n").alias("n_shingles"))
    full = rows.where("n_shingles > 0")
    distinct = written(full.groupBy("set").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "ngram-distinct")
    roots = written(components(links(docs, order, s), "ngram"), "ngram-classes")
    least = roots.join(distinct.select(F.col("set").alias("node"), "least"), "node").groupBy("root").agg(
        F.min("least").alias("class_least"), F.count("*").alias("_members"))
    least = written(least, "ngram-least")
    named = join_counted(roots, least, "root", "_members", least.agg(F.sum("_members")).first()[0] or 0)
    of_set = distinct.join(named.select(F.col("node").alias("set"), "class_least"), "set", "left").select(
        "set", "n", F.coalesce("class_least", "least").alias("component_id"))
    total = distinct.agg(F.sum("n")).first()[0] or 0
    linked = join_counted(full, written(of_set, "ngram-of-set"), "set", "n", total).select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
