import zlib

import numpy as np

from tessera.llm import language_id as L


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got) and len(held) > 100
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert {r.lang_pred for r in got} <= {"en", "de", "fr", "es", "und"} and all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark, docs_of):
    rows = [(i, t) for i, t in enumerate(["the cat and the dog", "a dog of the house", "this is the end"] * 8)]
    held = next(i for i in range(200, 300) if zlib.crc32(str(i).encode()) % 4 == 2)
    docs = docs_of(rows + [(100, None), (101, ""), (102, "123 456 !!"), (None, "the dog"), (held, "x" * 200_000)])
    got = {r.doc_id: r for r in L.identify(docs).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0
    assert got[None].lang_pred == "en" and got[held].lang_pred == "en" and got[held].rejected and not got[0].rejected
    assert L.identify(docs.limit(0)).count() == 0
    untaught = docs_of([(1, "a text")], lang=None)
    assert [r.lang_pred for r in L.identify(untaught).collect()] == ["und"]


def test_several_centroids():
    rng = np.random.default_rng(0)
    a, b = np.eye(8)[0], np.eye(8)[1]
    rows = np.array([a + rng.normal(0, .01, 8) for _ in range(50)] + [b + rng.normal(0, .01, 8) for _ in range(50)])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    centers, limits = L.cluster(rows, L.Settings(clusters=2))
    assert sorted(np.abs(centers).argmax(axis=1)) == [0, 1] and (limits < 1).all() and (limits > .7).all()
