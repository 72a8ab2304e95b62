import random
import re

import numpy as np
import xxhash

from tessera.llm import simhash as S


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(fps, radius):
    root = list(range(len(fps)))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_tiles_against_brute_force(monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)
    rnd = random.Random(5)
    fps = [rnd.getrandbits(64) for _ in range(150)]
    for _ in range(200):  # chains
        fps.append(fps[rnd.randrange(len(fps))] ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(1, 7))))
    fps = sorted(set(fps))
    sizes = {}
    for f in fps:
        sizes[f.bit_count()] = sizes.get(f.bit_count(), 0) + 1
    where, pairs = S.plan_tiles(sizes, 4)
    tiles = {}
    for k, f in enumerate(fps):
        first, splits = where[f.bit_count()]
        tiles.setdefault(first + k % splits, []).append(f)
    assert max(map(len, tiles.values())) <= 2 * len(fps) / S.TILES + 2
    got = np.arange(len(fps))
    at = {f: i for i, f in enumerate(fps)}
    forest = S.Forest(len(fps))
    for i, j in {tuple(p) for ps in pairs for p in ps}:
        a, b = (np.array(tiles.get(t, []), np.uint64) for t in (i, j))
        if len(a) and len(b):
            for u, v in S.linked(a, None if i == j else b, 4).tolist():
                forest.link(np.array([at[u]]), np.array([at[v]]))
    got = forest.root
    assert got.tolist() == brute_classes(fps, 4) and len(set(got.tolist())) < len(fps)


def test_query_against_brute_force(spark, docs_of):
    rnd = random.Random(1)
    base = [" ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) + str(rnd.randrange(40)) for _ in range(120)) for _ in range(12)]
    texts = [None, "", " \n", "One two", "one  TWO", "a b c d", "A b\tc d", "x " * 40_000]
    for b in base:
        w = b.split()
        w[50] = "changed"
        texts += [b, b, " ".join(w), b.upper() + " Ä"]
    rows = [(10 * i + 3, t) for i, t in enumerate(texts)] + [(33, texts[3]), (None, base[0])]
    rnd.shuffle(rows)
    docs = docs_of(rows)
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_classes(fps, 4)
    least = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    got = S.digests(S.classes(docs)).collect()
    assert sorted(map(repr, ((r.doc_id, r.fingerprint, r.component_id) for r in got))) == sorted(
        map(repr, ((i, f"{f:016x}", least[r]) for (i, _), f, r in zip(rows, fps, roots))))
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert len(kept.collect()) == len(set(roots))
    # a lone null id can only stay when nothing else is in its class
    assert {r.doc_id for r in kept.collect()} <= set(least.values()) | {None}


def test_empty_table(docs_of):
    assert S.digests(S.classes(docs_of([]))).count() == 0 and S.keep_one(docs_of([])).count() == 0
