import re

from tessera.llm import license_scan as L

from .oracle import same

TEXTS = [
    None, "", " .,;", "Released under the MIT License.", "under the MIT-License under the mit license under THE mit\nlicense",
    "SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under the Apache License, Version 2.0 and CC BY-NC 4.0; cc by nc cc_by_nc",
    "This work is licensed under the GNU General Public License, version 3. All rights reserved.",
    "ich komme mit dem Bus", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "Neither the name of the Example Org nor the names of its contributors may be used", "gpl gpl2 gpl 2 gplv3 LGPL 2.1 agpl",
    "x " * 30000 + "under the mit license", "Tous droits réservés", "mit license " * 40, "creative commons attribution noncommercial",
]


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for p, label in L.PHRASES.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_rules_are_gated_by_what_they_hold():
    for _, _, _, gate, expression in L.rules():
        assert gate and any(g in gate for g in L._gates())
    assert len(L.rules()) > 300
    # the phrases are found by the common gate of all rules, or by their own
    assert L._gate("apache(?: software)? license (?:version |v )?2(?: 0)?") == "apache"


def test_against_brute_force_and_sql(docs_of):
    docs = docs_of(TEXTS + TEXTS[3:5])
    out = L.digests(L.scan(docs))
    same(out, L.oracle_sql(), documents=docs)
    for r in out.collect():
        text = (TEXTS + TEXTS[3:5])[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(text)
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_suppression(docs_of):
    got = {r.doc_id: r.labels for r in L.digests(L.scan(docs_of(TEXTS))).collect()}
    assert got[5] == "gpl-3" and got[7] == "gpl-3,proprietary" and got[6] == "apache-2,cc-by-nc" and got[8] == ""
    assert got[9] == "mit" and got[10] == "bsd-3-clause" and got[15] == "cc-by-nc"


def test_empty_table_and_clashing_columns(docs_of):
    from pyspark.sql import functions as F
    docs = docs_of(TEXTS[3:4]).withColumn("labels", F.lit(1)).withColumn("n_words", F.lit("x"))
    assert L.digests(L.scan(docs)).first().labels == "mit"
    assert L.digests(L.scan(docs.limit(0))).count() == 0


def test_a_page_of_names_is_scanned_in_linear_time(docs_of):
    """20,000 and 80,000 mentions in one text: detections are counted right, and four times the text is no sixteen times the work."""
    import time
    took = {}
    for n in (20_000, 80_000, 20_000, 80_000):  # the first round also compiles
        began = time.time()
        r = L.scan(docs_of(["gpl foo " * n + "under the mit license"])).first()
        took[n] = time.time() - began
        kept = [(d.label, d.first, d.last) for d in r.kept]
        assert len(kept) == n + 1 and ("mit", 2 * n, 2 * n + 3) in kept and [d.first for d in r.base] == [2 * n]
        assert {f for label, f, _ in kept if label == "gpl"} == set(range(0, 2 * n, 2))
    assert took[80_000] < 9 * took[20_000] + 2


def brute_kept(found):
    """Suppression as it is defined, all pairs."""
    better = lambda e, d: e[3] <= d[3] and e[4] >= d[4] and (e[2] < d[2] or e[2] == d[2] and (
        e[4] - e[3] > d[4] - d[3] or e[4] - e[3] == d[4] - d[3] and e[0] < d[0]))
    return sorted(d for d in found if not any(better(e, d) for e in found))


def test_suppression_against_all_pairs(spark):
    import random

    from pyspark.sql import functions as F
    rnd = random.Random(8)
    rows = []
    for i in range(60):
        found = sorted({(rnd.randrange(9), "x", rnd.randrange(1, 5), a := rnd.randrange(12), a + rnd.randrange(6)) for _ in range(rnd.randrange(25))})
        rows.append((i, 3, [], found))
    kind = "array<struct<order:int,label:string,tier:int,first:int,last:int>>"
    one = spark.createDataFrame(rows, f"doc_id long, n_words long, base {kind}, _all {kind}")
    got = {r.doc_id: sorted(tuple(d) for d in r.kept) for r in L._suppressed(one).collect()}
    assert got == {i: brute_kept(found) for i, _, _, found in rows}
    assert L._suppressed(one.where(F.col("doc_id") < 0)).count() == 0
