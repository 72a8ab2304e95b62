import random
import re

import numpy as np
import pytest

from tessera.llm import ngram_join as N


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(words[i:i + 4]) for i in range(len(words) - 3)) or frozenset([" ".join(words)] if words else [])


def brute(rows):
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(map(repr, ((i, len(s), least.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets)))))


def corpus(seed=1):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(400)}"
    passage = " ".join(word() for _ in range(40))
    texts = [None, "", " \n\t", "one", "One", "a b c", "A  b\nc", "a b c d", "x " * 20_000, "x y " * 300]
    for size in (6, 9, 10, 12, 30, 60, 200):
        for _ in range(6):
            base = [word() for _ in range(size)]
            texts += [" ".join(base), " ".join(base).upper()]
            for _ in range(5):
                copy = base[:]
                for _ in range(rnd.choice([1, 1, 2, 4, 8])):
                    copy[rnd.randrange(size)] = word()
                texts += [" ".join(copy), " ".join(copy[rnd.randrange(3):])]
            texts.append(" ".join(base) + " " + passage)
    texts += [passage + " " + " ".join(word() for _ in range(k)) for k in (0, 1, 2, 3, 4, 5, 6, 8, 10) for _ in range(6)]
    chain = [f"c{k}" for k in range(80)]
    for k in range(25):
        texts.append(" ".join(chain[k:k + 55]))
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)] + [(4, texts[30]), (None, texts[31]), (None, None), (31, texts[10])]
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.mark.parametrize("tile", [1 << 19, 300])
def test_query_against_brute_force(docs_of, rows, monkeypatch, tile):
    monkeypatch.setattr(N, "TILE", tile)
    docs = docs_of(rows).repartition(4)
    got = N.classes(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    want = brute(rows)
    assert sorted(map(repr, map(tuple, got.collect()))) == want


def test_prefixes_share_enough_tokens():
    """Whatever each set chooses, linked sets share the smaller number of matches; predicted cost lengthens prefixes."""
    rng = np.random.default_rng(5)
    s = N.Settings()
    codes = np.repeat([0, 85], N.SKETCH // 2).astype(np.uint8)  # by the slot's highest bit: held by few, by many
    top = np.uint64(N.SKETCH // 2 << 17)
    order, chosen = N.Order(codes, s), set()

    def tokens(k, common):
        x = rng.integers(0, 1 << 63, k).astype(np.uint64) << np.uint64(1)
        return np.where(rng.random(k) < common, x | top, x & ~top)

    for _ in range(400):
        n, common = int(rng.integers(6, 300)), rng.choice([0.0, 0.5, 0.97])
        a = np.unique(tokens(n, common))
        swap = int(len(a) * rng.uniform(0, 0.09))
        b = np.unique(np.concatenate([a[swap:], tokens(swap, 0.5)]))
        shared = len(np.intersect1d(a, b))
        (p, k), (q, m) = order.prefix(a), order.prefix(b)
        assert k >= s.least_matches(len(a)) and len(p) == len(a) - s.overlap(len(a)) + k
        chosen.add(k > s.least_matches(len(a)))
        if 100 * shared >= 85 * (len(a) + len(b) - shared):
            assert len(np.intersect1d(p, q)) >= min(k, m)
    assert chosen == {True, False}
    flat = N.Order(np.zeros(N.SKETCH, np.uint8), s)
    assert flat.matches(np.zeros(200, np.uint8)) == 10 < N.Order(codes, s).matches(np.full(200, 85, np.uint8))


def test_large_group_of_near_copies_is_one_pass():
    """The hub links a group of near copies; no other pair is compared."""
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 1 << 62, 200).astype(np.uint64))
    sets = [np.unique(np.append(np.delete(base, rng.integers(0, 200, 2)), rng.integers(0, 1 << 62, 2).astype(np.uint64))) for _ in range(300)]
    tile = N.Tile(np.arange(300), sets, N.Order(np.zeros(N.SKETCH, np.uint8), N.Settings()))
    met = []
    meet = tile._meet
    tile._meet = lambda i, o: (met.append(i), meet(i, o))
    assert len(tile.forest(0)) == 299 and met == [0]


def test_least_size():
    assert N.Settings().least_size == 6 and N.Settings(percent=80).least_size == 4


def test_empty_and_clashing(spark, docs_of):
    from pyspark.sql import functions as F
    assert N.classes(docs_of([])).count() == 0
    assert N.classes(docs_of([None, "", "a b"])).count() == 3
    docs = docs_of([(1, "a b c d e"), (2, "A b c d e")]).withColumns({c: F.lit("x") for c in ("set", "n", "g", "hub", "component_id", "tokens", "n_shingles")})
    assert sorted(map(tuple, N.classes(docs).collect())) == [(1, 2, 1), (2, 2, 1)]
