"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

import corpus_pipeline as C  # noqa: E402
from tessera.llm import (byte_bpe, decontaminate, language_id, license_scan, line_dedup, ngram_join, pii, quality, simhash,  # noqa: E402
                         suffix_dedup, token_store)

CLASH = ("_id", "_h", "_norm", "fp", "ctx", "row", "n", "n_words", "kept", "labels", "starts", "ids", "start", "score", "entities",
         "component_id", "n_lines", "n_removed", "removed", "data", "spans", "mentions", "names", "held_out", "item_id", "base")
TEXT = "the quick brown fox jumps over the lazy dog and then sleeps"
TEXTS = [None, "", " ", "x", TEXT, TEXT, (TEXT + "\n") * 2000, "word " * 300, "\n\n\n", "é日🙂 " * 40]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, TEXT), (None, None)], "item_id long, text string")


def operators(tmp, spark, items):
    ranks = P.path("byte_bpe_50k.tiktoken")

    def tokens(d):
        store = token_store.Store.create(d, str(tmp), P.path("word_bpe_49k.json"), 2)
        return token_store.digests(store.read(spark))

    return {
        "simhash": lambda d: simhash.digests(simhash.classes(d)), "license": lambda d: license_scan.digests(license_scan.scan(d)),
        "language": language_id.identify, "lines": lambda d: line_dedup.digests(line_dedup.dedup(d)),
        "pii": lambda d: pii.digests(pii.replace(d, b"k")), "tokens": tokens,
        "bpe": lambda d: byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(d, ranks, P.PATTERN), ranks)),
        "suffix": lambda d: suffix_dedup.digests(suffix_dedup.dedup(d)), "quality": quality.score, "ngrams": ngram_join.classes,
    }


@pytest.mark.parametrize("name", ["simhash", "license", "language", "lines", "pii", "tokens", "bpe", "suffix", "quality", "ngrams"])
def test_one_row_per_row_whatever_else_is_there(spark, docs_of, items, tmp_path, name):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(4, TEXT), (None, TEXT), (None, None)]
    docs = docs_of(rows).withColumns({c: F.lit("clash") for c in CLASH}).withColumn("lang", F.when(F.col("doc_id") != 3, F.col("lang")))
    run = operators(tmp_path / "a", spark, items)[name]
    got = run(docs).collect()
    assert sorted(map(repr, (r.doc_id for r in got))) == sorted(map(repr, (i for i, _ in rows)))
    plain = run(docs_of(rows).withColumn("lang", F.when(F.col("doc_id") != 3, F.col("lang")))).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, plain))


def test_search_and_whitening_ignore_other_columns(spark, docs_of):
    from tessera.llm import lexical_search, whitening

    more = {c: F.lit("clash") for c in (*CLASH, "rank", "terms", "counts", "vec", "whitened", "deviation")}
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(4, TEXT), (None, TEXT)]
    items = spark.createDataFrame([(1, TEXT), (1, TEXT), (None, None), (2, "")], "item_id long, text string")
    plain = sorted(map(repr, map(tuple, lexical_search.search(docs_of(rows), items).collect())))
    clash = lexical_search.search(docs_of(rows).withColumns(more), items.withColumns({"rank": F.lit(1), "term": F.lit("x")}))
    assert sorted(map(repr, map(tuple, clash.collect()))) == plain and len(plain) % 2 == 0
    table = spark.createDataFrame([(i % 5, [float(i), float(i % 3), 1.0]) for i in range(30)], "vec_id long, embedding array<float>")
    a, b = (whitening.digests(whitening.transform(t, m := whitening.fit(t)), m) for t in (table, table.withColumns(more)))
    assert a.count() == b.count() == 60 and a.columns == b.columns


def test_decontamination_and_stages_keep_clashing_columns(spark, docs_of, items):
    docs = docs_of([(i, t) for i, t in enumerate(TEXTS)]).withColumns({c: F.lit(f"own {c}") for c in CLASH})
    assert {r.doc_id for r in decontaminate.find(docs, items).collect()} == {4, 5, 6}
    stages = [quality.keep_good, line_dedup.shorten, simhash.keep_one, lambda d: decontaminate.keep_clean(d, items)]
    assert len(stages) == len(C.STAGES) - 1
    for stage in stages:
        out = stage(docs)
        assert out.columns == docs.columns
        assert all(r[c] == f"own {c}" for r in out.collect() for c in CLASH)
