"""License scan by ordered signature rules, with DataFrame functions only.

Texts become lower-case words.  A rule is a label, a tier, a keyword and a regular expression over words; rules are
made from the table of licenses (names as written by hand) and the forms in which a license is mentioned.  A rule
runs on a text only if its keyword stands there.  Detections of one text are intervals of words; one is suppressed if
an interval of a stronger tier contains it, or a longer one of the same tier, or an equal one of an earlier rule.

Null and empty texts have no words and no detections.  Rows are scanned one by one, in time linear in the text for each
rule that matches; only detections are shuffled, by row, so repeated rows and frequent lines cost what they cost alone.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.arrays import let

#: Fixed phrases whose places are counted, with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: label: names of the license as regular expressions over words, most specific first.
LICENSES = {
    "mit": ["mit license", "mit licen[cs]e", "expat license", "mit x11 license"],
    "mit-0": ["mit 0", "mit no attribution"],
    "isc": ["isc license", "internet systems consortium license"],
    "0bsd": ["0bsd", "zero clause bsd", "bsd zero clause license"],
    "bsd-2-clause": ["bsd 2 clause(?: license)?", "2 clause bsd(?: license)?", "simplified bsd license", "freebsd license"],
    "bsd-3-clause": ["bsd 3 clause(?: license)?", "3 clause bsd(?: license)?", "new bsd license", "modified bsd license", "revised bsd license"],
    "bsd-4-clause": ["bsd 4 clause(?: license)?", "4 clause bsd(?: license)?", "original bsd license"],
    "bsd": ["bsd style license", "bsd license"],
    "apache-1": ["apache(?: software)? license (?:version |v )?1 [01]", "apache 1 [01]"],
    "apache-2": ["apache(?: software)? license (?:version |v )?2(?: 0)?", "apache 2(?: 0)?"],
    "apache": ["apache(?: software)? license"],
    "gpl-1": ["gnu general public license (?:version |v )?1", "gpl(?: )?(?:version |v )?1(?: 0)?"],
    "gpl-2": ["gnu general public license (?:version |v )?2(?: 0)?", "gpl(?: )?(?:version |v )?2(?: 0)?(?: only| or later)?"],
    "gpl-3": ["gnu general public license (?:version |v )?3(?: 0)?", "gpl(?: )?(?:version |v )?3(?: 0)?(?: only| or later)?"],
    "gpl": ["gnu general public license", "gnu gpl", "gpl"],
    "lgpl-2.1": ["gnu lesser general public license (?:version |v )?2 1", "lgpl(?: )?(?:version |v )?2 1"],
    "lgpl-3": ["gnu lesser general public license (?:version |v )?3", "lgpl(?: )?(?:version |v )?3(?: 0)?"],
    "lgpl": ["gnu lesser general public license", "gnu library general public license", "lgpl"],
    "agpl-3": ["gnu affero general public license (?:version |v )?3", "agpl(?: )?(?:version |v )?3(?: 0)?"],
    "agpl": ["gnu affero general public license", "affero general public license", "agpl"],
    "gfdl": ["gnu free documentation license", "gfdl"],
    "mpl-1": ["mozilla public license (?:version |v )?1 [01]", "mpl 1 [01]"],
    "mpl-2": ["mozilla public license (?:version |v )?2(?: 0)?", "mpl 2(?: 0)?"],
    "mpl": ["mozilla public license"],
    "epl-1": ["eclipse public license (?:version |v )?1(?: 0)?", "epl 1(?: 0)?"],
    "epl-2": ["eclipse public license (?:version |v )?2(?: 0)?", "epl 2(?: 0)?"],
    "cddl": ["common development and distribution license", "cddl(?: 1 [01])?"],
    "cpl": ["common public license"],
    "eupl": ["european union public licen[cs]e", "eupl(?: 1 [012])?"],
    "artistic-1": ["artistic license 1(?: 0)?"],
    "artistic-2": ["artistic license (?:version )?2(?: 0)?"],
    "artistic": ["artistic license", "perl artistic license"],
    "boost": ["boost software license", "bsl 1 0"],
    "zlib": ["zlib license", "zlib libpng license"],
    "libpng": ["libpng license", "png reference library license"],
    "openssl": ["openssl license", "ssleay license"],
    "python": ["python software foundation license", "psf license", "python license 2 0"],
    "ruby": ["ruby license", "ruby s license"],
    "php": ["php license (?:version )?3(?: 01?)?", "php license"],
    "postgresql": ["postgresql license"],
    "unlicense": ["unlicense", "the unlicense"],
    "wtfpl": ["wtfpl", "do what the fuck you want to public license"],
    "cc0": ["cc0(?: 1 0)?", "creative commons zero", "creative commons cc0"],
    "cc-by-nc-nd": ["cc by nc nd(?: \\d 0)?", "creative commons attribution non(?: )?commercial no(?: )?deriv(?:ative)?s"],
    "cc-by-nc-sa": ["cc by nc sa(?: \\d 0)?", "creative commons attribution non(?: )?commercial share(?: )?alike"],
    "cc-by-nc": ["cc by nc(?: \\d 0)?", "creative commons attribution non(?: )?commercial"],
    "cc-by-nd": ["cc by nd(?: \\d 0)?", "creative commons attribution no(?: )?deriv(?:ative)?s"],
    "cc-by-sa": ["cc by sa(?: \\d 0)?", "creative commons attribution share(?: )?alike"],
    "cc-by": ["cc by(?: \\d 0)?", "creative commons attribution"],
    "creative-commons": ["creative commons license", "creative commons"],
    "odbl": ["open database license", "odbl(?: 1 0)?"],
    "odc-by": ["open data commons attribution license", "odc by"],
    "pddl": ["public domain dedication and license", "pddl"],
    "ofl": ["sil open font license", "open font license", "ofl 1 1"],
    "ms-pl": ["microsoft public license", "ms pl"],
    "ms-rl": ["microsoft reciprocal license", "ms rl"],
    "upl": ["universal permissive license", "upl 1 0"],
    "ncsa": ["ncsa open source license", "university of illinois ncsa"],
    "afl": ["academic free license"],
    "osl": ["open software license"],
    "qpl": ["q public license"],
    "bsl": ["business source license", "busl 1 1"],
    "sspl": ["server side public license", "sspl"],
    "elastic": ["elastic license(?: 2 0)?"],
    "json": ["json license"],
    "vim": ["vim license"],
    "curl": ["curl license"],
    "icu": ["icu license", "unicode license"],
    "openrail": ["openrail(?: m)?", "responsible ai license"],
    "etalab": ["licence ouverte", "etalab(?: 2 0)?"],
    "dl-de": ["datenlizenz deutschland"],
}

#: (label, expression): sentences of license texts and notices.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "neither the name of (?:\\S+ ){1,8}?nor the names of its contributors"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu"),
    ("gpl-2", "either version 2 of the license or at your option any later version"),
    ("gpl-3", "either version 3 of the license or at your option any later version"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license"),
    ("zlib", "this software is provided as is without any express or implied warranty"),
    ("boost", "permission is hereby granted free of charge to any person or organization"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", "this work is in the public domain"),
    ("proprietary", "all rights reserved"),
    ("proprietary", "proprietary and confidential"),
    ("proprietary", "no part of this publication may be reproduced"),
    ("proprietary", "unauthori[sz]ed (?:copying|reproduction|distribution)"),
    ("proprietary", "tous droits réservés"),
    ("proprietary", "alle rechte vorbehalten"),
    ("proprietary", "todos los derechos reservados"),
]

#: Forms of a mention, strongest first: tier and the expression around a name.
FORMS = [
    (1, "spdx license identifier {}"),
    (2, "(?:is |are )?(?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?{}"),
    (2, "under (?:the )?(?:terms of (?:the )?)?{}"),
    (3, "{}"),
]
#: Score of a text's strongest kept detection by tier; 0: the fixed phrases.
SCORES = {0: 1.0, 1: 0.95, 2: 0.9, 3: 0.6, 4: 0.4}


#: Words that many licenses share; a gate without any other word is the last choice.
COMMON = {"license", "public", "general", "software", "version", "the", "and", "of", "to", "in"}


def _gate(expression: str) -> str:
    """A plain string that each match holds: of the expression's literal parts the most telling one."""
    while (bare := re.sub(r"\([^()]*\)(?:\?|\{[^}]*\}\??)?|\[[^][]*\]\??|\w\?|\\[dS]|\+", "*", expression)) != expression:
        expression = bare
    parts = [p.strip() for p in expression.split("*") if p.strip()]
    return max(parts, key=lambda p: (bool(set(p.split()) - COMMON), len(p)), default="")


def rules() -> list[tuple[int, str, int, str, str]]:
    """``order, label, tier, gate, expression``, in order of priority; expressions match ' word word'."""
    out = []
    for label, expression in NOTICES:
        out.append((label, 4 if label == "proprietary" else 2, expression, expression))
    for tier, form in FORMS:
        for label, names in LICENSES.items():
            out += [(label, tier, form.replace("{}", name), name) for name in names]
    out.sort(key=lambda r: r[1])
    rows = []
    for i, (label, tier, expression, name) in enumerate(out):
        rows.append((i, label, tier, _gate(name), f" (?:{expression})(?= )"))
    return rows


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII that is neither a letter nor a digit.
GAPS = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def normalized(docs: DataFrame) -> DataFrame:
    """``doc_id, _norm``: the lower-cased words of a text, a single space before each and behind the last; one space
    if there are none."""
    plain = F.concat(F.lit(" "), F.translate(F.coalesce("text", F.lit("")), UPPER + GAPS, LOWER + " " * len(GAPS)), F.lit(" "))
    docs = docs.select("doc_id", plain.alias("_plain"))
    for _ in range(2):  # most runs of spaces have two or three
        docs = docs.select("doc_id", F.replace("_plain", F.lit("  "), F.lit(" ")).alias("_plain"))
    longer = F.col("_plain").contains("  ")
    return docs.select("doc_id", F.when(longer, F.regexp_replace("_plain", " +", " ")).otherwise(F.col("_plain")).alias("_norm"))


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


#: Marks around a match; normalized texts hold no control characters.
OPEN, CLOSE = "\u0001", "\u0002"


def _intervals(norm: Column, expression: Column) -> Column:
    """First and last word (from 0) of each match, in time linear in the text: matches are marked, and the marked words
    tell their places."""
    marked = F.regexp_replace(norm, expression, F.lit(f"{OPEN}$0{CLOSE}"))
    at = lambda w, mark, less: F.filter(F.transform(w, lambda x, i: F.when(x.contains(mark), i - less)), lambda i: i.isNotNull())
    # a match begins with the space before its first word; the text's own first piece is empty
    places = let(F.split(marked, " "), lambda w: F.arrays_zip(at(w, OPEN, 0).alias("first"), at(w, CLOSE, 1).alias("last")))
    return F.when(marked.contains(OPEN), places).otherwise(F.expr("cast(array() as array<struct<first:int,last:int>>)"))


def _contains_any(norm: Column, gates: list[str]) -> Column:
    cond = F.lit(False)
    for g in gates:
        cond = cond | norm.contains(g)
    return cond


def _gates() -> list[str]:
    """Strings of which each text with a rule's gate holds one: the gates, shortened where many share a stem."""
    stems = ("licen", "gnu ", "gpl", "bsd", "apache", "creative commons", "cc by", "public domain", "permission")
    gates = sorted({next((x for x in stems if x in r[3]), r[3]) for r in rules()}, key=len)
    return [g for i, g in enumerate(gates) if not any(h in g for h in gates[:i])]


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, base, kept``: word count, places of the fixed phrases and detections that are not
    suppressed, both as arrays of ``label, tier, first, last`` (words from 0)."""
    one = normalized(docs)
    norm = F.col("_norm")
    one = one.withColumn("n_words", F.greatest(_spaces(norm) - 1, F.lit(0)).cast("long"))
    kind = "array<struct<order:int,label:string,tier:int,gate:string,expression:string>>"

    def table(rows):  # a constant that the optimizer folds
        names = ("order", "label", "tier", "gate", "expression")
        return F.from_json(F.lit(json.dumps([dict(zip(names, r)) for r in rows])), kind)

    def detect(rows):
        gates = F.from_json(F.lit(json.dumps(sorted({r[3] for r in rows}))), "array<string>")
        there = F.filter(gates, lambda g: norm.contains(g))
        return F.flatten(F.transform(there, lambda g: F.flatten(F.transform(F.filter(table(rows), lambda r: r["gate"] == g), lambda r: F.transform(
            _intervals(norm, r["expression"]),
            lambda x: F.struct(r["order"].alias("order"), r["label"].alias("label"), r["tier"].alias("tier"), x["first"].alias("first"), x["last"].alias("last")))))))

    # a phrase may overlap itself only by its ending, which these do not; so matches are all places
    phrases = [(i, label, 0, f" {phrase} ", f" {phrase}(?= )") for i, (phrase, label) in enumerate(PHRASES.items())]
    none = F.expr("cast(array() as array<struct<order:int,label:string,tier:int,first:int,last:int>>)")
    one = one.withColumn("base", F.when(_contains_any(norm, [p[3] for p in phrases]), detect(phrases)).otherwise(none))
    one = one.withColumn("_all", F.when(_contains_any(norm, _gates()), detect(rules())).otherwise(none))
    return _suppressed(one)


def _suppressed(one: DataFrame) -> DataFrame:
    """Drops detections that lie in a better one: of a stronger tier, or of the same and longer, or earlier in the table.

    In the order of (first, -last, tier, table) all that may contain a detection comes before it, and does so if it ends
    no earlier; so one running maximum per tier decides, in time linear in a text's sorted detections.  Only detections
    move, not texts.
    """
    numbered = one.withColumn("_row", F.monotonically_increasing_id())  # before the explode: a number per text
    rows = numbered.select("_row", "doc_id", "n_words", F.explode_outer(F.concat(
        F.transform("base", lambda d: F.struct(F.lit(True).alias("base"), d.alias("d"))),
        F.transform("_all", lambda d: F.struct(F.lit(False).alias("base"), d.alias("d"))))).alias("x"))
    rows = rows.select("_row", "doc_id", "n_words", "x.base", "x.d")
    d = F.col("d")
    before = Window.partitionBy("_row", "base").orderBy(
        d["first"], d["last"].desc(), d["tier"], d["order"]).rowsBetween(Window.unboundedPreceding, -1)
    tiers = sorted({r[2] for r in rules()})
    ends = F.array(*[F.max(F.when(d["tier"] <= t, d["last"])).over(before) for t in tiers])
    end = F.get(ends, F.array_position(F.array(*map(F.lit, tiers)), d["tier"]).cast("int") - 1)
    rows = rows.withColumn("_end", F.when(~F.col("base"), end)).withColumn("_in", F.coalesce(F.col("_end") >= d["last"], F.lit(False)))
    listed = lambda c: F.array_sort(F.collect_list(F.when(c, F.struct(
        d["order"].alias("order"), d["label"].alias("label"), d["tier"].alias("tier"), d["first"].alias("first"), d["last"].alias("last")))))
    return rows.groupBy("_row", "doc_id", "n_words").agg(
        listed(F.col("base")).alias("base"), listed(~F.col("base") & ~F.col("_in")).alias("kept")).drop("_row")


def digests(scanned: DataFrame) -> DataFrame:
    """What the query returns."""
    score = F.lit(0.0)
    for tier in sorted(SCORES, reverse=True):
        there = F.array_contains(F.transform(F.concat("base", "kept"), lambda d: d["tier"]), tier)
        score = F.when(there, F.lit(SCORES[tier])).otherwise(score)
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda d: d["label"]))), ",")
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda d: d["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda d: d["first"])).cast("long").alias("last_word"),
        labels(F.col("base")).alias("base_labels"), labels(F.concat("base", "kept")).alias("labels"), score.alias("score"))


def oracle_sql() -> str:
    """The same in DuckDB: detections by unnested rules, suppression by an anti-join.

    Its words stand between two spaces each, so that matches need no look-ahead.
    """
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    doubled = lambda e: " " + e[1:].removesuffix("(?= )").replace(" ", "  ") + " "
    values = ",\n".join(f"({i},{quote(label)},{tier},{quote(gate)},{quote(doubled(expr))})" for i, label, tier, gate, expr in rules())
    phrases = ",".join(f"({i},{quote(label)},0,{quote(p)},{quote(doubled(' ' + p))})" for i, (p, label) in enumerate(PHRASES.items()))
    scores = " ".join(f"WHEN bool_or(tier = {t}) THEN {s}" for t, s in sorted(SCORES.items()))
    size = lambda x: f"len(regexp_extract_all({x}, '[^ ]+'))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
n AS MATERIALIZED (SELECT k, doc_id, len(words) AS n_words, array_to_string(words, ' ') AS plain,
    CASE WHEN len(words) = 0 THEN '' ELSE ' ' || array_to_string(words, '  ') || ' ' END AS norm FROM d),
rules(ord, label, tier, gate, expr) AS (VALUES {values}),
phrases(ord, label, tier, gate, expr) AS (VALUES {phrases}),
todo AS (SELECT k, norm, 'r' AS kind, r.* FROM n, rules r WHERE contains(plain, gate)
   UNION ALL SELECT k, norm, 'p', p.* FROM n, phrases p WHERE contains(plain, gate)),
cut AS (SELECT k, kind, ord, label, tier, list_transform(regexp_extract_all(norm, expr), lambda x: {size('x')}) AS hits,
    list_transform(regexp_split_to_array(norm, expr), lambda x: {size('x')}) AS gaps FROM todo),
found AS MATERIALIZED (SELECT k, kind, ord, label, tier,
    list_sum(gaps[1:i]) + coalesce(list_sum(hits[1:i - 1]), 0) AS a, list_sum(gaps[1:i]) + list_sum(hits[1:i]) - 1 AS b
  FROM (SELECT *, unnest(generate_series(1, len(hits))) AS i FROM cut WHERE len(hits) > 0)),
kept AS (SELECT * FROM found f WHERE kind = 'p' OR NOT EXISTS (SELECT 1 FROM found g WHERE g.kind = 'r' AND g.k = f.k AND g.a <= f.a AND g.b >= f.b
   AND (g.tier < f.tier OR g.tier = f.tier AND (g.b - g.a > f.b - f.a OR g.b - g.a = f.b - f.a AND g.ord < f.ord)))),
agg AS (SELECT k, count(*) FILTER (kind = 'p') AS n_base, min(a) FILTER (kind = 'p') AS first_word, max(a) FILTER (kind = 'p') AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kind = 'p') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
    CAST(CASE {scores} ELSE 0 END AS DOUBLE) AS score FROM kept GROUP BY k)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM n LEFT JOIN agg USING (k)
"""
