"""Hand vectors for the text functions (T1-T11) and lemmatization (T4/T5)."""

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import text_ops


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("r")).first()["r"]


def test_normalize_placeholders(spark):
    cases = {
        "see $x^2$ at http://a.b/c now": "see MATH> at URL> now",
        "in 1995, re-run (ok) abc123": "in NUM> rerun ok abcNUM>",
        "3.5 x->y a<b <=5": "NUM>NUM> x->y ab =NUM>",
    }
    for raw, want in cases.items():
        assert one(spark, tx.normalize_placeholders, raw) == want


def test_clean_strip_keeps_ascii_letters_only(spark):
    assert one(spark, tx.clean_strip, "Re-run 3 été!") == "rerun  t"


def test_word_tokenize_splits_contractions(spark):
    got = one(spark, lambda c: tx.word_tokenize(c), "we cannot  gonna wanna go")
    assert got == ["we", "can", "not", "gon", "na", "wan", "na", "go"]


def test_stopwords_keep_order_and_repeats(spark):
    got = one(spark, lambda c: tx.clean_tokens(c), "The cat and the Cat don't sat")
    assert got == ["cat", "cat", "dont", "sat"]  # apostrophe removed first: "dont" survives


def test_basic_english_and_truncate(spark):
    got = one(spark, lambda c: tx.basic_english_tokens(c), "Hello, World! (a) b;c \"q\"")
    assert got == ["hello", ",", "world", "!", "(", "a", ")", "b", "c", "q"]
    assert one(spark, lambda c: F.size(tx.truncate_tokens(tx.whitespace_tokens(c), 40)),
               " ".join(["w"] * 100)) == 40


def test_whitespace_and_alpha_tokens(spark):
    assert one(spark, tx.token_count, "") == 0
    assert one(spark, tx.token_count, "  a \n b  ") == 2
    assert one(spark, lambda c: tx.alpha_tokens(c), "The Figure shows 3 cats, été et al") == ["shows", "été"]


def test_vectorizer_tokens_drop_single_chars(spark):
    assert one(spark, lambda c: tx.vectorizer_tokens(c), "a bb Ccc d_e 12") == ["bb", "ccc", "d_e", "12"]


def test_lemmatize_against_corpus_lexicon(spark):
    df = spark.createDataFrame([(1, "models model boxes box women woman glasses"), (2, "")], "doc_id long, text string")
    out = {r["doc_id"]: r["clean_text"] for r in text_ops.prepare_text(df, lem=True).collect()}
    # 'glasses' -> 'glass' needs 'glass' in the lexicon; 'women' -> 'woman' is not shorter, kept
    assert out == {1: "model model box box women woman glasses", 2: ""}


def test_lemmatize_with_given_lexicon(spark):
    df = spark.createDataFrame([(1, "glasses studies")], "doc_id long, text string")
    lex = spark.createDataFrame([("glass",), ("study",)], "form string")
    out = text_ops.prepare_text(df, lem=True, lexicon=lex).first()["clean_text"]
    assert out == "glass study"


def test_irregular_nouns_come_before_rules(spark):
    words = "mice children analyses axes cats mouse cat boxes feet criteria matrices knives buses news"
    df = spark.createDataFrame([(1, words), (1, "mice"), (1, "mice")], "doc_id long, text string")
    got = sorted(r["clean_text"] for r in text_ops.prepare_text(df, lem=True).collect())
    assert got == ["mouse", "mouse", "mouse child analysis axis cat mouse cat boxes foot criterion matrix knife buses news"]
    # a lexicon has the last word on bases; a listed form takes no rule
    lex = spark.createDataFrame([("mouse",), ("analyse",), ("ax",), ("cat",)], "form string")
    table = {r["token"]: r["lemma"] for r in text_ops.lemma_table(
        spark.createDataFrame([(w,) for w in words.split()], "token string"), lex).collect()}
    assert table == {"mice": "mouse", "cats": "cat"}
    own = spark.createDataFrame([("axes", "ax"), ("axes", "axis")], "form string, base string")
    table = text_ops.lemma_table(spark.createDataFrame([("axes",), ("mice",)], "token string"), None, own)
    assert [tuple(r) for r in table.collect()] == [("axes", "ax")]
