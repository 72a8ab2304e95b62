import re

import numpy as np

from tessera.llm import quality

from .oracle import same

PROSE = "the cat and the dog sat on the mat while it was raining in the old town, and nobody of them cared. "


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), failed


def test_base_figures(docs_of):
    texts = [None, "", "   \n\t", "a b c a b c", "x y z w", "l1\nl1\n\n \nl1 ", PROSE * 4, "ü|ö " * 60,
             " ".join(f"w{i} of" for i in range(40)) + " w1 of w2 of", "a " * 5000]
    got = {r.doc_id: r for r in quality.score(docs_of(texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), t
        assert not (r.base_failed and r.kept)


def test_divergence(docs_of, spark):
    words = "the of and to in is it that was for on with as his they at be this from have or by one had not but what".split()
    rnd = np.random.default_rng(3)
    prose = [" ".join(rnd.choice(words, 150)) + "." for _ in range(30)]
    junk = [" ".join(f"{w}### {w[::-1]}%%%" for w in rnd.choice(words, 120)), " ".join(rnd.choice(words, 200)).upper(),
            " ".join("".join(rnd.choice(list("bcdfgxz"), 6)) for _ in range(150))]
    docs = docs_of(prose + junk + prose[:2])
    kept = {r.doc_id: r.kept for r in quality.score(docs).collect()}
    assert [i for i, k in kept.items() if not k] == [30, 31, 32]
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and sorted(r.doc_id for r in good.collect()) == [*range(30), 33, 34]


def test_clashing_columns_nulls_and_empty_table(docs_of, spark):
    from pyspark.sql import functions as F
    docs = docs_of([None, PROSE * 9]).withColumn("kept", F.lit("x")).withColumn("lang", F.lit(None).cast("string"))
    assert quality.score(docs).count() == 2
    assert quality.score(docs.limit(0)).count() == 0 and quality.keep_good(docs.limit(0)).count() == 0


def test_js_distance():
    assert quality.js_distance(np.array([1.0, 0]), np.array([0, 1.0])) == 1
    assert quality.js_distance(np.array([.5, .5]), np.array([.5, .5])) == 0


def test_against_sql(docs_of):
    words = "the of and to in is it that was for on with as his they at be this from have or by one had not but what".split()
    rnd = np.random.default_rng(5)
    texts = [" ".join(rnd.choice(words, int(n))) + "." for n in rnd.integers(20, 300, 25)]
    texts += [None, "", " \t\n", "l1\nl1\n\n \nl1 ", PROSE * 4, PROSE.upper() * 5, "ü|ö " * 80, "é à # % " * 60, "a b c a b c " * 30, "x" * 3000]
    docs = docs_of(texts)
    same(quality.digests(quality.score(docs)), quality.oracle_sql(), documents=docs)
