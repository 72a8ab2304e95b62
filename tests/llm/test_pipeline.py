"""run() against a brute-force version of all five stages, on a small documents table."""
import hashlib
import random

import pytest

P = pytest.importorskip("public_tokenizers")
import tiktoken  # noqa: E402

import corpus_pipeline as C  # noqa: E402
from tessera.llm import byte_bpe, decontaminate  # noqa: E402

from .test_decontaminate import levenshtein_infix  # noqa: E402
from .test_line_dedup import brute as brute_lines  # noqa: E402
from .test_quality import brute as brute_quality  # noqa: E402
from .test_simhash import brute_classes, brute_fingerprint  # noqa: E402

COMMON = "the of and to in is it that was for on with as his they at be this from have or by one had not but what".split()


def world():
    rnd = random.Random(12)
    word = lambda: rnd.choice(COMMON) if rnd.random() < 0.6 else "".join(rnd.choice("abcdefghilmnoprstu") for _ in range(rnd.randrange(4, 9)))
    prose = lambda lines: "\n".join(" ".join(word() for _ in range(14)) + "." for _ in range(lines))
    items = [" ".join(word() for _ in range(30)) for _ in range(5)]
    shared = prose(5)
    clean, junk = [prose(12) for _ in range(40)], []
    texts = list(clean)
    for k in range(6):  # near copies: one word differs
        w = clean[k].split(" ")
        w[40] = "altered"
        texts.append(" ".join(w))
    texts += clean[:3]  # exact copies
    texts += [prose(6) + "\n" + shared + "\n" + prose(6) for _ in range(4)]
    texts += [prose(4) + " " + items[k % 5] + " " + prose(4) for k in range(6)]
    for k in range(4):
        w = items[k].split()
        w[7] = "edited"
        texts.append(prose(5) + " " + " ".join(w) + " " + prose(5))
    junk += [prose(10).upper(), " ".join(f"{word()}###" for _ in range(150)), "too short", None, "", "again and again " * 60]
    rows = [(i, t, "en", "src", None if t is None else len(t)) for i, t in enumerate(texts + junk)]
    rnd.shuffle(rows)
    return rows, items, len(texts)


def brute(rows, items, n_good):
    # quality: the base rule, and the histograms by construction
    docs = [(i, t) for i, t, *_ in rows if i < n_good and not brute_quality(t)[5]]
    shorter = brute_lines([(i, t, 0) for i, t in docs], 3)
    docs = [(i, text) for (i, _), (text, n, gone) in shorter.items() if gone == 0 or gone < n]
    docs.sort()
    roots = brute_classes([brute_fingerprint(t) for _, t in docs], 4)
    docs = [d for k, d in enumerate(docs) if roots[k] == k]  # sorted by id: a root is its class's smallest
    words = lambda t: [w.decode() for w in decontaminate.words(t)]
    leak = lambda t: any(levenshtein_infix(words(x), words(t)) <= len(words(x)) // 5 for x in items)
    docs = [(i, t) for i, t in docs if not leak(t)]
    path = P.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.ranks(path).rank, special_tokens={})
    return [(i, len(ids := enc.encode_ordinary(t)), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
             hashlib.sha256(t.encode()).hexdigest()) for i, t in docs]


def test_run_equals_brute_force(spark, tmp_path):
    rows, items, n_good = world()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in C.run(spark, str(tmp_path)).collect()]
    want = brute(rows, items, n_good)
    assert sorted(got) == sorted(want) and 35 <= len(want) < n_good


def test_stages_return_the_columns_of_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in C.STAGES][0] == "quality rules" and len(C.STAGES) == 5 and C.ORACLE_SQL is None
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, docs, sf).schema == docs.schema


def test_empty_documents(spark, tmp_path):
    rows, items, _ = world()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0
