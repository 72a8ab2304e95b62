"""Text scalar functions (T1-T3, T6-T11) as native Column expressions.

All work happens in JVM string/regex functions and higher-order array
functions; no Python UDF is involved. ``(?U)`` switches Java's ``\\w \\s \\d``
to Unicode classes, matching Python's ``re`` defaults on ``str`` patterns.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stopwords import NLTK_ENGLISH_STOPWORDS, profile_stopwords


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- fixed values: word splits applied by the Treebank word tokenizer to
# --- letter-only text (first part, second part); apostrophe forms cannot occur
TREEBANK_SPLITS = (
    ("can", "not"),
    ("gim", "me"),
    ("gon", "na"),
    ("got", "ta"),
    ("lem", "me"),
    ("wan", "na"),
)


def nonempty(tokens: Column) -> Column:
    return F.filter(tokens, lambda x: x != F.lit(""))


def clean_strip(col: Column | str) -> Column:
    """Lower-case, then delete every character outside ``[a-zA-Z]`` and whitespace."""
    return F.regexp_replace(F.lower(_c(col)), r"(?U)[^a-zA-Z\s]", "")


def word_tokenize(col: Column | str) -> Column:
    """Word tokens of letter-only text (whitespace split plus contraction splits)."""
    # one pass for all pairs: of the groups, those of the pair that stands there are filled
    either = "|".join(f"({first})({second})" for first, second in TREEBANK_SPLITS)
    numbers = range(1, 2 * len(TREEBANK_SPLITS) + 1)
    parts = "".join(f"${n}" for n in numbers if n % 2) + " " + "".join(f"${n}" for n in numbers if n % 2 == 0)
    return nonempty(F.split(F.regexp_replace(_c(col), rf"(?i)\b(?:{either})\b", parts), r"(?U)\s+"))


def remove_stopwords(tokens: Column, stopwords: Iterable[str] = NLTK_ENGLISH_STOPWORDS) -> Column:
    """Drop tokens in the stop list, keeping order and repeats.

    ``isin`` over a literal list becomes an ``InSet`` hash lookup in Catalyst.
    """
    stop = list(stopwords)
    return F.filter(tokens, lambda x: ~x.isin(stop))


def clean_tokens(col: Column | str, stopwords: Iterable[str] = NLTK_ENGLISH_STOPWORDS) -> Column:
    """T1 -> T2 -> T3 as a token array."""
    return remove_stopwords(word_tokenize(clean_strip(col)), stopwords)


def normalize_placeholders(col: Column | str) -> Column:
    """Placeholder normalisation used before the sequence models.

    Ordered rules: lower; ``$...$`` -> `` <MATH> ``; URLs -> `` <URL> ``; digit
    runs -> ``<NUM>``; delete any char that is not a word char, whitespace or
    ``>`` unless it follows ``<`` or precedes ``>``; collapse whitespace; trim.
    The deletion rule removes the ``<`` of each tag, so tags read ``MATH>``.
    """
    s = F.lower(_c(col))
    s = F.regexp_replace(s, r"\$.*?\$", " <MATH> ")
    s = F.regexp_replace(s, r"(?U)http\S+|www\.\S+", " <URL> ")
    s = F.regexp_replace(s, r"(?U)\d+", "<NUM>")
    s = F.regexp_replace(s, r"(?U)(?<!<)[^\w\s>](?!>)", "")
    s = F.regexp_replace(s, r"(?U)\s+", " ")
    return F.trim(s)


# --- fixed values: the "basic_english" normaliser (text, replacement), in order; runs of white space end as one blank
BASIC_ENGLISH_RULES = (
    ("'", " '  "),
    ('"', ""),
    (".", " . "),
    ("<br />", " "),
    (",", " , "),
    ("(", " ( "),
    (")", " ) "),
    ("!", " ! "),
    ("?", " ? "),
    (";", " "),
    (":", " "),
)


def basic_english_tokens(col: Column | str) -> Column:
    """Lower-case, pad/drop punctuation by the fixed rules, split on whitespace.

    The rules are plain texts, so they are replaced without a pattern matcher."""
    s = F.lower(_c(col))
    for text, repl in BASIC_ENGLISH_RULES:
        s = F.replace(s, F.lit(text), F.lit(repl))
    return nonempty(F.split(s, r"(?U)\s+"))


def whitespace_tokens(col: Column | str) -> Column:
    """``str.split()`` -- maximal runs of non-whitespace."""
    return nonempty(F.split(_c(col), r"(?U)\s+"))


def token_count(col: Column | str) -> Column:
    """Number of whitespace tokens (0 for an empty text)."""
    return F.size(whitespace_tokens(col))


def alpha_tokens(col: Column | str, stopwords: Iterable[str] | None = None) -> Column:
    """Lower, whitespace split, keep all-letter tokens outside the profile stop set."""
    stop = list(profile_stopwords() if stopwords is None else stopwords)
    toks = whitespace_tokens(F.lower(_c(col)))
    return F.filter(toks, lambda x: x.rlike(r"^\p{L}+$") & ~x.isin(stop))


def vectorizer_tokens(col: Column | str) -> Column:
    """The bag-of-words vectorizer's own tokens: runs of >= 2 word characters."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(r"(?U)\b\w\w+\b"), 0)


def truncate_tokens(tokens: Column, n: int = 40) -> Column:
    """First ``n`` elements of an array (attention traces keep 40)."""
    return F.slice(tokens, 1, n)
