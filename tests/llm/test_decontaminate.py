import random

import numpy as np
import pytest

from tessera.llm import decontaminate as D


def levenshtein_infix(item, text):
    """Plain dynamic programme: least edits between the item and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != x)))
        row = new
    return min(row)


def world(seed=2, n_items=40, n_docs=300):
    rnd = random.Random(seed)
    vocab = ["the", "of", "and", "to"] * 60 + [f"w{i}" for i in range(600)]
    items = [[rnd.choice(vocab) for _ in range(rnd.randrange(12, 60))] for _ in range(n_items)]
    docs = []
    for k in range(n_docs):
        doc = [rnd.choice(vocab) for _ in range(rnd.randrange(5, 200))]
        if k % 2:
            w = list(rnd.choice(items))
            for _ in range(rnd.randrange(0, int(len(w) * 0.26) + 1)):
                at = rnd.randrange(len(w))
                kind = rnd.randrange(3)
                if kind == 0:
                    w[at] = "zz%d" % rnd.randrange(99)
                elif kind == 1:
                    del w[at]
                else:
                    w.insert(at, "yy")
            at = rnd.randrange(len(doc))
            doc[at:at] = w
        docs.append(doc)
    return items, docs


def test_recall_and_precision_against_brute_force():
    items, docs = world()
    s = D.Settings()
    index = D.Index([(i, [w.encode() for w in x]) for i, x in enumerate(items)], s)
    got = {(row, k): e for row, k, _, e in D._search(index, [" ".join(d) for d in docs])}
    want = {}
    for r, d in enumerate(docs):
        for k, item in enumerate(items):
            e = levenshtein_infix(item, d)
            if e <= int(len(item) * s.max_edits + 1e-9):
                want[r, k] = e
    assert set(got) <= set(want)  # the check is exact
    assert len(set(got)) >= 0.97 * len(want) and len(want) > 80, (len(got), len(want))
    assert all(got[p] == want[p] for p in got if want[p] <= 2)
    exact = {p for p, e in want.items() if e == 0}
    assert exact <= set(got)


def test_infix_distance():
    rnd = np.random.default_rng(0)
    for _ in range(100):
        a, b = rnd.integers(0, 4, rnd.integers(1, 9)), rnd.integers(0, 4, rnd.integers(0, 15))
        assert D.infix_distance(a, b)[0] == levenshtein_infix(a.tolist(), b.tolist())


@pytest.fixture(scope="module")
def items_of(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string")


def test_query_and_stage(spark, docs_of, items_of):
    passage = "The quick brown fox jumps over the lazy dog, and then it rests a while; nobody minds it at all."
    items = items_of([(7, passage), (8, None), (9, ""), (10, "tiny item"), (7, passage), (None, "of an item without any id at all here")])
    texts = [None, "", "clean text " * 50, "before. " + passage.upper().replace(",", " -") + " after", "a tiny  ITEM here",
             "x " * 50_000 + passage, passage.replace("lazy", "sleepy"), "of an item without any id at all here", "the of and it a"]
    docs = docs_of(texts + texts[3:4])
    small = D.Settings(block_words=20)  # several blocks
    for s in (D.Settings(), small):
        got = {(r.doc_id, r.item_id, r.edits) for r in D.find(docs, items, s).collect()}
        assert got == {(3, 7, 0), (5, 7, 0), (6, 7, 1), (9, 7, 0), (4, 10, 0), (7, None, 0)}
        kept = D.keep_clean(docs, items, s)
        assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 8] and kept.columns == docs.columns
    assert D.find(docs, items_of([])).count() == 0 and D.keep_clean(docs, items_of([])).count() == len(texts) + 1
    assert D.find(docs_of([]), items).count() == 0


def test_buckets_find_edited_windows_and_leave_others():
    """The LSH by itself, over five seeds: windows with 20 % of words edited share a bucket, unrelated ones do not."""
    import dataclasses
    for seed in (1, 2, 4, 7, 11):
        rng, s = np.random.default_rng(seed), dataclasses.replace(D.Settings(), seed=seed)
        for n in (10, 25, 60):
            items = rng.integers(1, 4000, (150, n))
            near = items.copy()
            for i in range(len(items)):
                words = items[i].tolist()
                for _ in range(n // 5):
                    at = int(rng.integers(len(words)))
                    words[at:at + int(rng.integers(2))] = rng.integers(1, 4000, int(rng.integers(2))).tolist()
                near[i] = (words + rng.integers(1, 4000, n).tolist())[:n]
            lens = np.full(len(items), n)
            keys = [D.cgk_keys(x, lens, s) for x in (items, near, rng.integers(1, 4000, items.shape))]
            assert (keys[0] == keys[1]).any(axis=1).mean() >= 0.95
            assert (keys[0] == keys[2]).any(axis=1).mean() < 0.05
            assert (keys[0] == D.cgk_keys(items, lens, s)).all()
