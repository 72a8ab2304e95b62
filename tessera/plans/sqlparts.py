"""Reusable SQL pieces (DuckDB dialect) for the oracle statements.

Each function returns SQL text; the same fixed values (stop lists, rules) that
the Spark operators use are rendered into the statements, so both sides read
one definition.  RE2 has no look-around; the oracle form of the placeholder
rule is exact when raw text carries no ``<``/``>`` (true for the test corpus).
"""

from __future__ import annotations

from ..functions.stopwords import NLTK_ENGLISH_STOPWORDS, profile_stopwords
from ..functions.text import TREEBANK_SPLITS
from ..operators.text_ops import IRREGULAR_NOUNS, NOUN_RULES


def lit_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


NLTK_STOP_SQL = lit_list(NLTK_ENGLISH_STOPWORDS)
PROFILE_STOP_SQL = lit_list(profile_stopwords())


def nonempty_split(expr: str, pattern: str = r"\s+") -> str:
    return f"list_filter(regexp_split_to_array({expr}, '{pattern}'), lambda x: x <> '')"


def clean_strip(expr: str) -> str:
    return f"regexp_replace(lower({expr}), '[^a-zA-Z\\s]', '', 'g')"


def word_tokenize(expr: str) -> str:
    s = expr
    for a, b in TREEBANK_SPLITS:
        s = f"regexp_replace({s}, '\\b({a})({b})\\b', '\\1 \\2', 'gi')"
    return nonempty_split(s)


def remove_stop(list_expr: str, stop_sql: str = NLTK_STOP_SQL) -> str:
    return f"list_filter({list_expr}, lambda x: NOT list_contains({stop_sql}, x))"


def clean_tokens(expr: str) -> str:
    return remove_stop(word_tokenize(clean_strip(expr)))


def normalize(expr: str) -> str:
    s = f"lower({expr})"
    s = f"regexp_replace({s}, '\\$.*?\\$', ' <MATH> ', 'g')"
    s = f"regexp_replace({s}, 'http\\S+|www\\.\\S+', ' <URL> ', 'g')"
    s = f"regexp_replace({s}, '\\d+', '<NUM>', 'g')"
    s = f"regexp_replace({s}, '[^\\p{{L}}\\p{{N}}_\\s>]', '', 'g')"
    s = f"regexp_replace({s}, '\\s+', ' ', 'g')"
    return f"trim({s})"


def basic_english(expr: str) -> str:
    rules = [("'", " '  "), ('"', ""), ("\\.", " . "), ("<br \\/>", " "), (",", " , "),
             ("\\(", " ( "), ("\\)", " ) "), ("\\!", " ! "), ("\\?", " ? "), ("\\;", " "),
             ("\\:", " "), ("\\s+", " ")]
    s = f"lower({expr})"
    for pat, rep in rules:
        pat = pat.replace("'", "''")
        rep = rep.replace("'", "''")
        s = f"regexp_replace({s}, '{pat}', '{rep}', 'g')"
    return nonempty_split(s)


def alpha_tokens(expr: str) -> str:
    return (f"list_filter({nonempty_split(f'lower({expr})')}, "
            f"lambda x: regexp_full_match(x, '\\p{{L}}+') AND NOT list_contains({PROFILE_STOP_SQL}, x))")


def token_count(expr: str) -> str:
    return f"len({nonempty_split(expr)})"


def docs_cte(label: str = "lang") -> str:
    return f"docs AS (SELECT doc_id, text, {label} AS label FROM documents)"


def split_ctes(src: str = "docs", test_pct: int = 20, seed: int = 42) -> str:
    """S1 as plain SQL: class quotas by largest remainder, then row_number by md5."""
    return f"""
cls AS (SELECT label, count(*) AS n_label FROM {src} GROUP BY label),
tot AS (SELECT sum(n_label) AS n, sum(n_label) - (sum(n_label) * {test_pct} + 99) // 100 AS n_train FROM cls),
q0 AS (SELECT c.label, c.n_label, (c.n_label * t.n_train) // t.n AS fl,
              (c.n_label * t.n_train) % t.n AS rem, t.n_train FROM cls c, tot t),
q1 AS (SELECT label, n_label,
              fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, label)
                             <= max(n_train) OVER () - sum(fl) OVER () THEN 1 ELSE 0 END AS train_quota
       FROM q0),
ranked AS (SELECT d.*, row_number() OVER (PARTITION BY d.label
                  ORDER BY md5('{seed}:' || CAST(d.doc_id AS VARCHAR))) AS rn FROM {src} d),
splits AS (SELECT r.* EXCLUDE (rn), CASE WHEN r.rn <= q.train_quota THEN 'train' ELSE 'test' END AS split
           FROM ranked r JOIN q1 q USING (label))"""


def noun_rules_values() -> str:
    return ", ".join(f"({i}, '{old}', '{new}')" for i, (old, new) in enumerate(NOUN_RULES))


def irregular_values() -> str:
    return ", ".join(f"('{form}', '{base}')" for form, base in IRREGULAR_NOUNS)
