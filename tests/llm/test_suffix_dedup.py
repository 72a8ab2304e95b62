import hashlib
import random

import numpy as np
import pytest

from tessera.llm import suffix_dedup as S


def brute(texts, length):
    places = {}
    raws = [(t or "").encode() for t in texts]
    for k, raw in enumerate(raws):
        for i in range(len(raw) - length + 1):
            places.setdefault(raw[i:i + length], []).append((k, i))
    gone = [np.zeros(len(r), bool) for r in raws]
    for where in places.values():
        if len(where) > 1:
            for k, i in where:
                gone[k][i:i + length] = True
    out = []
    for raw, g in zip(raws, gone):
        kept = bytes(b for b, x in zip(raw, g) if not x)
        spans = int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum())
        out.append((len(raw), int(g.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_array():
    rnd = random.Random(4)
    for n in (0, 1, 2, 5, 30, 200):
        for alphabet in (1, 2, 3, 20):
            for _ in range(20):
                t = [rnd.randrange(1, alphabet + 1) for _ in range(n)]
                assert S.suffix_array(t) == sorted(range(n), key=lambda i: t[i:])
    t = [1, 2] * 500
    assert S.suffix_array(t) == sorted(range(1000), key=lambda i: t[i:])


def test_anchors_are_the_same_for_equal_windows():
    rnd = np.random.default_rng(1)
    shared = rnd.integers(97, 100, 300).astype(np.uint8)
    for data in (np.concatenate([rnd.integers(97, 100, 77).astype(np.uint8), shared, rnd.integers(97, 100, 500).astype(np.uint8)]), np.full(700, 65, np.uint8)):
        fp, at, first, last = S.anchors(data, 200, 48)
        assert first[0] == 0 and last[-1] == len(data) - 200 and (first[1:] == last[:-1] + 1).all()
        assert (at >= last).all() and (at + 48 <= first + 200).all()
    _, at, first, last = S.anchors(shared, 200, 48)
    assert len(S.gram_hashes(shared, 48)) == 300 - 47
    h = S.gram_hashes(np.concatenate([shared, shared]), 48)
    assert (h[:253] == h[300:]).all() and len(np.unique(h[:253])) > 200


def test_runs():
    assert S._runs(np.array([3, 4, 5, 9, 11, 12])) == [{"first": 3, "n": 3}, {"first": 9, "n": 1}, {"first": 11, "n": 2}]


def test_repeated_starts_against_brute_force():
    rnd = random.Random(9)
    for _ in range(30):
        texts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(8, 40))) for _ in range(6)]
        weights = [rnd.choice([1, 1, 2]) for _ in texts]
        times = {}
        for t, w in zip(texts, weights):
            for i in range(len(t) - 7):
                times[t[i:i + 8]] = times.get(t[i:i + 8], 0) + w
        for t, starts in zip(texts, S.repeated_starts(texts, weights, 8)):
            assert starts.tolist() == [i for i in range(len(t) - 7) if times[t[i:i + 8]] > 1]


def sample(rnd):
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(70), prose(14)
    texts = [None, "", "short", "a" * 199, "a" * 200, "b" * 450, prose(400), "é" * 130]
    texts += [texts[6], texts[6][:300] + " other " + texts[6][310:]]
    for k in range(50):
        t = prose(rnd.randrange(1, 90))
        if k % 3 == 0:
            t += " " + passage[rnd.randrange(60):len(passage) - rnd.randrange(60)] + " " + prose(30)
        if k % 2:
            t += "\n" + line + "\n" + prose(25)
        texts.append(t)
    w = prose(60)
    return texts + [w + " " + prose(9) + " " + w, "abcdefghij" * 60]


@pytest.mark.parametrize("contexts, halvings", [(1000, 4), (3, 4), (2, 1)])
def test_against_brute_force(docs_of, monkeypatch, contexts, halvings):
    monkeypatch.setattr(S, "HALVINGS", halvings)
    monkeypatch.setattr(S, "CONTEXTS", contexts)
    monkeypatch.setattr(S, "BUCKET_BYTES", 5000)
    monkeypatch.setattr(S, "STRING_BYTES", 2000)
    monkeypatch.setattr(S, "CHUNK", 333)
    texts = sample(random.Random(contexts))
    rows = list(enumerate(texts)) + [(3000, "same id " + texts[20]), (3000, "x"), (5, texts[5]), (None, texts[6][:250])]
    got = sorted(map(repr, ((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.digests(S.dedup(docs_of(rows))).collect())))
    assert got == sorted(map(repr, ((i, *x) for (i, _), x in zip(rows, brute([t for _, t in rows], 200)))))


def test_nothing_repeated_and_empty_table(docs_of):
    got = S.digests(S.dedup(docs_of(["one text", "x" * 100]))).collect()
    assert [r.n_removed for r in got] == [0, 0]
    assert S.digests(S.dedup(docs_of([]))).count() == 0
