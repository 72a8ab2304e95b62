"""Quality rules by distribution divergence.

A document's character-class and common-word histograms are compared with references per language by
Jensen-Shannon distance (base 2, 0 to 1).  The references come from the documents of the whole table that are prose:
texts with over 1 % symbols, over 20 % capitals or under 70 % letters are left out, as junk would shape what it is
judged by (all documents are judged).  Character classes
are summed, and of each language the ``top_words`` most frequent words make the word histogram's bins (all other
words share one bin).  Short documents have noisy histograms; each test has a minimum length below which it does
not speak.

Null or empty texts have no words and fail the base rule.  A null ``lang``, or one of which no text is prose, is
compared with every reference, and the nearest counts.  Repeated rows are judged alike; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices, written

#: Character classes by byte of the UTF-8 text.  Digits (numbers are no sign of a language) and the later bytes
#: of long characters count nothing.
CLASSES = ("lower", "upper", "space", "mark", "symbol", "other", "wide")
SYMBOLS = "#*$%&|<>"
BLOCK_BYTES = 4 << 20  #: text handled at once


def _byte_classes() -> np.ndarray:
    out = np.full(256, 5, np.uint8)
    for b in range(128):
        c = chr(b)
        if c.islower():
            out[b] = 0
        elif c.isupper():
            out[b] = 1
        elif c.isdigit():
            out[b] = 7
        elif c in " \t\n\r\x0b\x0c":
            out[b] = 2
        elif c in ".,;:!?'\"()-":
            out[b] = 3
        elif c in SYMBOLS:
            out[b] = 4
    out[0xC0:] = 6  # the first byte of a longer character
    out[0x80:0xC0] = 7  # its other bytes
    return out


BYTE_CLASS = _byte_classes()
EDGES = b".,;:!?'\"()-#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    min_words: int = 50  #: base rule
    max_repeat_pct: int = 50  #: base rule: share of words in repeated 3-word windows
    top_words: int = 100  #: bins of the word histogram, per language
    min_chars_js: int = 200  #: shorter texts are not judged by character classes
    min_words_js: int = 100  #: shorter texts are not judged by common words
    max_char_js: float = 0.18
    max_word_js: float = 0.45


def _class_counts(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return np.bincount(BYTE_CLASS[data], minlength=8)[:7]


def plain_words(text: str) -> list[bytes]:
    """Lower-cased words without ASCII punctuation and symbols."""
    return text.lower().encode().translate(None, EDGES).split()


def _is_prose(counts: np.ndarray) -> bool:
    """Whether a text may shape a reference: mostly letters, hardly any symbols, not in capitals."""
    total = counts.sum()
    return counts[4] * 100 <= total and counts[1] * 5 <= total and (counts[0] + counts[1] + counts[6]) * 10 >= total * 7


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: words of each language with their counts, and class counts as words ``\\0<class>``."""
    for batch in slices(batches, BLOCK_BYTES):
        plain: dict[str, list[bytes]] = {}
        classes: dict[str, np.ndarray] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts = _class_counts(text)
            if _is_prose(counts):
                plain.setdefault(lang, []).append(text.lower().encode().translate(None, EDGES))
                classes[lang] = classes.get(lang, 0) + counts
        for lang, found in plain.items():
            words = pc.ascii_split_whitespace(pa.array(found, pa.binary()).cast(pa.string())).flatten().value_counts()
            keys = pa.concat_arrays([words.field(0), pa.array([f"\0{i}" for i in range(len(CLASSES))])])
            counts = pa.concat_arrays([words.field(1).cast(pa.int64()), pa.array(classes[lang].tolist(), pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(keys)), keys, counts], ["lang", "word", "n"])


@dataclass
class Reference:
    chars: np.ndarray  #: share of each character class
    words: np.ndarray  #: share of each common word, then of all others
    index: dict[bytes, int]


def references(docs: DataFrame, rules: Rules) -> dict[str, Reference]:
    """Per language: class shares and the shares of its most frequent words, over all documents that are prose.

    What comes to the driver has ``top_words + 8`` rows per language.
    """
    counts = (docs.where("lang is not null and text is not null").select("lang", "text")
              .mapInArrow(_count_words, "lang string, word string, n long").where("word <> ''")  # of white space at the ends
              .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    counts = written(counts, "word-counts")  # read by the ranking and by the totals; the texts are scanned once
    is_class = F.col("word").startswith("\0")
    ranked = counts.withColumn("r", F.row_number().over(W.partitionBy("lang", is_class).orderBy(F.desc("n"), "word")))
    totals = counts.where(~is_class).groupBy("lang").agg(F.sum("n").alias("n")).select(
        "lang", F.lit("\0n").alias("word"), "n", F.lit(0).alias("r"))
    out: dict[str, Reference] = {}
    by_lang: dict[str, dict[str, int]] = {}
    for r in ranked.where(F.col("r") <= rules.top_words).unionByName(totals).orderBy("lang", "r", "word").collect():
        by_lang.setdefault(r.lang, {})[r.word] = r.n
    for lang, found in by_lang.items():
        total = found.pop("\0n", 0)
        chars = np.array([found.pop(f"\0{i}", 0) for i in range(len(CLASSES))], float)
        top = np.array(list(found.values()) + [total - sum(found.values())], float)
        if total and chars.sum():
            out[lang] = Reference(chars / chars.sum(), top / total, {w.encode(): i for i, w in enumerate(found)})
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence with logarithms to base 2."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = (np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()) / 2
    return float(np.sqrt(min(max(d, 0.0), 1.0)))


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words inside 3-word windows that the text holds twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    pair = ids[:-1] * distinct + ids[1:]
    if distinct >= 1 << 20:  # three ids would not fit 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    triple = pair[:-1] * distinct + ids[2:]
    ordered = np.sort(triple)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    order = np.argsort(triple, kind="stable")
    same = triple[order][1:] == triple[order][:-1]
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:n - 2 + k] |= again
    return int(covered.sum())


def judge(text: str | None, lang: str | None, refs: dict[str, Reference], rules: Rules) -> tuple:
    """All figures of one text, in the order of ``SCHEMA`` behind ``doc_id``."""
    text = text or ""
    words = text.encode().split()  # bytes split at ASCII white space only
    n = len(words)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    word_chars = len(text) - sum(map(text.count, " \t\n\r\x0b\x0c"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    repeats = repeated_words(ids, len(seen))
    base_failed = n < rules.min_words or 100 * repeats > rules.max_repeat_pct * n
    char_js = word_js = None
    own = [refs[lang]] if lang in refs else list(refs.values())
    if own and len(text) >= rules.min_chars_js:
        counts = _class_counts(text)
        p = counts / max(counts.sum(), 1)
        char_js = min(js_distance(p, ref.chars) for ref in own)
    if own and n >= rules.min_words_js:
        plain = plain_words(text)
        word_js = 1.0
        for ref in own:
            other = len(ref.index)
            at = np.fromiter((ref.index.get(w, other) for w in plain), np.int64, len(plain))
            word_js = min(word_js, js_distance(np.bincount(at, minlength=other + 1) / max(len(plain), 1), ref.words))
    kept = not base_failed and not (char_js is not None and char_js > rules.max_char_js) \
        and not (word_js is not None and word_js > rules.max_word_js)
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeats, base_failed, kept, char_js, word_js


SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, char_js double, word_js double")
_TYPES = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def score(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row of figures and the verdict per document (``doc_id``, ``text``, ``lang`` are read)."""
    refs = references(docs, rules)

    def kernel(batches):
        for batch in slices(batches, BLOCK_BYTES):
            rows = [judge(t, lang, refs, rules) for t, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_TYPES)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *cols], _NAMES)

    return docs.select("doc_id", "text", "lang").mapInArrow(kernel, SCHEMA)


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that pass, all columns as they are; no shuffle."""
    refs = references(docs, rules)
    text_at, lang_at = docs.columns.index("text"), docs.columns.index("lang")

    def kernel(batches):
        for batch in slices(batches, BLOCK_BYTES):
            kept = [judge(t, lang, refs, rules)[6] for t, lang in zip(batch.column(text_at).to_pylist(), batch.column(lang_at).to_pylist())]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(kernel, docs.schema)


def digests(scored: DataFrame) -> DataFrame:
    """What the query returns: distances to six digits, on which engines agree."""
    return scored.withColumns({c: F.round(c, 6) for c in ("char_js", "word_js")})


def oracle_sql(rules: Rules = Rules()) -> str:
    """The same in DuckDB."""
    gap = "[ \\x09-\\x0D]"
    classes = ["[a-z]", "[A-Z]", gap, "[.,;:!?''\"()-]", "[#*$%&|<>]", None, "[^\\x00-\\x7F]"]
    count = lambda c: f"length(text) - length(regexp_replace(text, '{c}', '', 'g'))"
    classes[5] = "[^a-zA-Z0-9\\x09-\\x0D .,;:!?''\"()#*$%&|<>-]"  # other ASCII, and all that is wide
    c = [f"{count(x)} AS c{i}" for i, x in enumerate(classes)]
    sums = "+".join(f"c{i}" for i in range(7))
    js = lambda p, q: (f"sqrt(least(greatest(sum(CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END"  # noqa: E731
                       f" + CASE WHEN {q} > 0 THEN {q} * log2({q} / (({p} + {q}) / 2)) ELSE 0 END) / 2, 0), 1))")
    bins = "UNION ALL ".join(f"SELECT k, lang, {i} AS bin, c{i} AS c, total FROM t " for i in range(7))
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, coalesce(text, '') AS text FROM documents),
t0 AS (SELECT *, {', '.join(c)}, regexp_extract_all(text, '[^ \\x09-\\x0D]+') AS words,
   regexp_extract_all(regexp_replace(lower(text), '[.,;:!?''"()#*$%&|<>-]', '', 'g'), '[^ \\x09-\\x0D]+') AS plain,
   list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\x09-\\x0D]')) AS lines FROM d),
t AS MATERIALIZED (SELECT * REPLACE (c5 - c6 AS c5), {sums.replace('c5', '(c5 - c6)')} AS total, len(words) AS n FROM t0),
prose AS (SELECT * FROM t WHERE text <> '' AND lang IS NOT NULL AND c4 * 100 <= total AND c1 * 5 <= total AND (c0 + c1 + c6) * 10 >= total * 7),
cref AS (SELECT lang, bin, sum(c)::DOUBLE / sum(sum(c)) OVER (PARTITION BY lang) AS q FROM ({bins.replace('FROM t ', 'FROM prose ')}) GROUP BY lang, bin),
wc AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(plain) AS word FROM prose) GROUP BY ALL),
wr AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r, sum(n) OVER (PARTITION BY lang) AS total FROM wc),
wref AS (SELECT lang, word, n::DOUBLE / total AS q FROM wr WHERE r <= {rules.top_words}
  UNION ALL SELECT lang, NULL, (max(total) - sum(n) FILTER (r <= {rules.top_words}))::DOUBLE / max(total) FROM wr GROUP BY lang),
langs AS (SELECT DISTINCT lang FROM wref),
own AS (SELECT t.k, l.lang FROM t, langs l WHERE t.lang = l.lang OR t.lang IS NULL OR t.lang NOT IN (SELECT lang FROM langs)),
cjs AS (SELECT k, min(js) AS char_js FROM (SELECT b.k, o.lang, {js('(b.c::DOUBLE / greatest(b.total, 1))', 'r.q')} AS js
  FROM ({bins}) b JOIN own o ON o.k = b.k JOIN cref r ON r.lang = o.lang AND r.bin = b.bin GROUP BY b.k, o.lang) GROUP BY k),
pw AS (SELECT k, word, count(*) AS n FROM (SELECT k, unnest(plain) AS word FROM t) GROUP BY ALL),
wbin AS (SELECT o.k, o.lang, r.word, r.q, CASE WHEN r.word IS NULL THEN NULL ELSE coalesce(pw.n, 0) END AS n, greatest(len(t.plain), 1) AS total, len(t.plain) AS m
  FROM own o JOIN t ON t.k = o.k JOIN wref r ON r.lang = o.lang LEFT JOIN pw ON pw.k = o.k AND pw.word = r.word),
wfull AS (SELECT k, lang, q, (CASE WHEN word IS NULL THEN m - sum(coalesce(n, 0)) OVER (PARTITION BY k, lang) ELSE n END)::DOUBLE / total AS p FROM wbin),
wjs AS (SELECT k, min(js) AS word_js FROM (SELECT k, lang, {js('p', 'q')} AS js FROM wfull GROUP BY k, lang) GROUP BY k),
grams AS (SELECT k, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT k, words, unnest(generate_series(1, n - 2)) AS i FROM t WHERE n >= 3)),
again AS (SELECT k, unnest([i, i + 1, i + 2]) AS i FROM (SELECT *, count(*) OVER (PARTITION BY k, g) AS times FROM grams) WHERE times > 1),
rep AS (SELECT k, count(DISTINCT i) AS n_repeat FROM again GROUP BY k),
f AS (SELECT t.doc_id, t.n, t.words, t.c4, len(lines) - len(list_distinct(lines)) AS dup, coalesce(n_repeat, 0) AS n_repeat,
  CASE WHEN length(text) >= {rules.min_chars_js} THEN char_js END AS char_js, CASE WHEN n >= {rules.min_words_js} THEN word_js END AS word_js,
  n < {rules.min_words} OR 100 * coalesce(n_repeat, 0) > {rules.max_repeat_pct} * n AS failed
  FROM t LEFT JOIN cjs USING (k) LEFT JOIN wjs USING (k) LEFT JOIN rep USING (k))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
  CAST(c4 AS BIGINT) AS n_symbols, CAST(dup AS BIGINT) AS n_dup_lines, CAST(n_repeat AS BIGINT) AS n_repeat_words, failed AS base_failed,
  NOT failed AND NOT coalesce(char_js > {rules.max_char_js}, false) AND NOT coalesce(word_js > {rules.max_word_js}, false) AS kept,
  round(char_js, 6) AS char_js, round(word_js, 6) AS word_js FROM f
"""
