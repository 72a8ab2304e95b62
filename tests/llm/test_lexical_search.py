import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import lexical_search as L

from .oracle import same


def brute(docs, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, c) for i, t in docs if (c := Counter(terms(t)))]
    n, length = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 10 + 90 * c.total() * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, -(1 << 63) if i is None else i))
        out += [(item, rank, None if i == -(1 << 63) else i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(2)
    words = [f"w{int(rnd.paretovariate(0.6))}" for _ in range(3000)]
    texts = [None, "", " .,; ", "ÄÖ é日, Z", "z Z z"] + [" ".join(rnd.choices(words, k=rnd.choice([3, 40, 200]))) for _ in range(900)]
    texts += [texts[20]] * 15 + ["w1 " * 30_000]
    docs = [(3 * i + 1, t) for i, t in enumerate(texts)] + [(61, texts[20]), (None, texts[30]), (None, texts[31])]
    items = [(i, " ".join(rnd.choices(words, k=25))) for i in range(30)] + [(7, texts[20]), (7, texts[20]), (None, "Z, é日"), (50, None), (51, "..."), (52, "nowhere")]
    return docs, items


@pytest.mark.parametrize("cells, block_terms, part_terms", [(1 << 23, 10**6, 8192), (1 << 15, 200, 90)])
def test_search_against_brute_force(spark, docs_of, corpus, monkeypatch, cells, block_terms, part_terms):
    docs, items = corpus
    table = docs_of(docs).repartition(3)
    queries = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(L, "CELLS", cells)
    got = L.search(table, queries, 10, L.Settings(block_terms, part_terms)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(docs, items)))


def test_blocks_are_skipped_and_lists_are_partitioned():
    rng = np.random.default_rng(4)
    weight = np.arange(60, 0, -1)
    queries = L.Queries(["a"], {}, [np.arange(60)])
    part = queries.parts(weight, L.Settings())[0]
    cells = np.unique(np.column_stack([rng.integers(0, 500, 9000), rng.integers(0, 60, 9000)]), axis=0)
    impact = rng.integers(1, 900_000, len(cells))
    segment = L.Segment(part, np.arange(500), cells[:, 0], cells[:, 1], impact)
    for term in (0, 30):
        docs, ends, summary = segment.blocked(term)
        assert sorted(docs.tolist()) == sorted(cells[cells[:, 1] == term, 0].tolist()) and len(ends) - 1 == len(summary) > 1
        for b, (a, e) in enumerate(zip(ends, ends[1:])):  # summaries bound every document of the block, by less than a step
            top = segment.impact[docs[a:e]].max(axis=0)
            assert (summary[b].astype(int) * L.STEP >= top).all() and (summary[b].astype(int) * L.STEP - top < L.STEP).all()
    scored = []
    best = L.Best(10)
    add, best.add = best.add, lambda s, i: (scored.extend(i.tolist()), add(s, i))
    columns = np.array([0, 1, 2, 3])
    segment.search(columns, best)
    exact = segment.impact[:, columns].astype(int) @ weight[columns]
    order = np.lexsort((np.arange(500), -exact))[:10]
    assert best.ids.tolist() == order.tolist() and best.scores.tolist() == exact[order].tolist()
    assert len(scored) == len(set(scored)) < (exact > 0).sum()


def test_sql(spark, docs_of, corpus):
    docs, items = corpus
    table, queries = docs_of([d for d in docs if d[0] is not None]), spark.createDataFrame(items, "item_id long, text string")
    same(L.search(table, queries), L.oracle_sql(), documents=table, benchmark=queries)


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert L.search(docs_of(["a"]), none).count() == 0 and L.search(docs_of([]), some).count() == 0
    assert [tuple(r) for r in L.search(docs_of(["a", None]), some).collect()] == brute([(0, "a")], [(1, "a b")])
