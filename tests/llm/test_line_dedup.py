import random

import xxhash
from pyspark.sql import functions as F

from tessera.llm import line_dedup as D


def brute(rows, run):
    """Kept texts by (id, text): direct search for each window among all earlier ones."""
    key = lambda r: (-(1 << 63) if r[0] is None else r[0], r[2])
    out, seen = {}, set()
    for i, text, _ in sorted(set(rows), key=key):
        lines = (text or "").split("\n")
        full = [k for k, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c")]
        gone = set()
        for s in range(len(full) - run + 1):
            w = tuple(lines[k].strip(" \t\r\x0b\x0c") for k in full[s:s + run])
            if w in seen:
                gone.update(full[s:s + run])
            seen.add(w)
        out[i, text] = (None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)), len(full), len(gone)
    return out


def sample():
    rnd = random.Random(3)
    pool = [f"line number {i} of the pool" for i in range(30)]
    passage = ["first shared line", "second shared line", "third one", "a fourth"]
    texts = [None, "", "\n\n", "one\ntwo", "x\nx\nx\nx\nx", "p\nq\nr\n\np\n q \nr\t"]
    for k in range(60):
        own = [f"own {k} {j}" for j in range(rnd.randrange(1, 6))]
        at = rnd.randrange(len(pool) - 6)
        texts.append("\n".join(own[:2] + (passage if k % 2 else pool[at:at + rnd.randrange(1, 6)]) + own[2:]))
    texts.append("\n".join(f"long {i % 700}" for i in range(5000)))
    return texts + texts[10:14]


def test_against_brute_force(spark, docs_of):
    rows = [(i % 50, t) for i, t in enumerate(sample())] + [(None, "first shared line\nsecond shared line\nthird one")] * 2
    docs = docs_of(rows)
    hashes = {(r.doc_id, r.text): r.h for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    for gram, run in ((2, 3), (1, 2), (2, 5)):
        want = brute([(i, t, hashes[i, t]) for i, t in rows], run)
        got = D.dedup(docs, gram, run)
        pairs = sorted((repr((r.doc_id, r.n_lines, r.n_removed, r.text)) for r in D.digests(got).collect()))
        assert pairs == sorted(repr((i, want[i, t][1], want[i, t][2], want[i, t][0])) for i, t in rows)


def test_stage(docs_of):
    docs = docs_of(["a\nb\nc\nd", "a\nb\nc", "z\na\nb\nc", None, ""]).withColumns({"n_lines": F.lit("clash"), "_id": F.lit("x")})
    kept = D.shorten(docs)
    got = {r.doc_id: (r.text, r.n_chars) for r in kept.collect()}
    assert got == {0: ("a\nb\nc\nd", 7), 2: ("z", 1), 3: (None, None), 4: ("", 0)} and kept.columns == docs.columns
    assert D.digests(D.dedup(docs)).count() == 5
    assert D.shorten(docs_of([])).count() == 0


def test_winnowing_guarantee():
    rnd = random.Random(1)
    shared = [rnd.getrandbits(64) for _ in range(6)]
    for _ in range(50):
        a = [rnd.getrandbits(64) for _ in range(rnd.randrange(4))] + shared + [rnd.getrandbits(64) for _ in range(rnd.randrange(4))]
        b = [rnd.getrandbits(64) for _ in range(rnd.randrange(4))] + shared
        fa, fb = ({w[3]: w[0] for w in D.winnow(x, 2, 5)} for x in (a, b))
        both = fa.keys() & fb.keys()
        assert len(both) == 2 and all(fa[w] == fb[w] for w in both)
    assert xxhash.xxh3_64_intdigest(b"a") == D.line_hashes(" a\t\n\n")[0]


def brute_spans(rows, run, words):
    """As brute(), for all windows of ``run`` lines and those of fewer with ``words`` words."""
    key = lambda r: (-(1 << 63) if r[0] is None else r[0], r[2])
    out, seen = {}, set()
    for i, text, _ in sorted(set(rows), key=key):
        lines = (text or "").split("\n")
        full = [k for k, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c")]
        gone = set()
        for s in range(len(full)):
            for n in range(1, min(run, len(full) - s) + 1):
                w = tuple(lines[k].strip(" \t\r\x0b\x0c") for k in full[s:s + n])
                if n == run or sum(len(x.split()) for x in w) >= words:
                    if w in seen:
                        gone.update(full[s:s + n])
                    seen.add(w)
        out[i, text] = (None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)), len(full), len(gone)
    return out


def test_passages_of_fifty_words_in_few_lines(docs_of):
    rnd = random.Random(8)
    line = lambda name, n: " ".join(f"{name}{j}" for j in range(n))
    one, just, under = line("one", 60), line("just", 50), line("under", 49)
    two, mixed, three = (line("a", 30), line("b", 20)), (line("long", 70), line("tail", 3)), (line("c", 20), line("d", 10), line("e", 25))
    texts = [None, "", one, one, just, just, under, under, "\n".join(two), " \n" + "\n\n".join(two) + "\t", "\n".join(mixed), f"own\n{mixed[0]}\n{mixed[1]}\nend",
             f"x\n{mixed[1]}\n{mixed[0]}", f"{one}\n{one}\n{one}", "\n".join(three[:2]), "\n".join(three), "\n".join(three[1:])]
    pool = [line(f"p{k}_", n) for k, n in enumerate((60, 50, 49, 30, 25, 20, 3, 1))]
    texts += ["\n".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 5))) for _ in range(80)]
    rows = [(i % 60, t) for i, t in enumerate(texts)] + [(None, one), (None, one)]
    docs = docs_of(rows)
    hashes = {(r.doc_id, r.text): r.h for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    for gram, run, words in ((2, 3, 50), (1, 2, 50), (2, 5, 25)):
        want = brute_spans([(i, t, hashes[i, t]) for i, t in rows], run, words)
        got = sorted(repr((r.doc_id, r.n_lines, r.n_removed, r.text)) for r in D.digests(D.dedup(docs, gram, run, words)).collect())
        assert got == sorted(repr((i, want[i, t][1], want[i, t][2], want[i, t][0])) for i, t in rows)
    kept = {r.doc_id: r.text for r in D.shorten(docs_of([one, one, just, f"own\n{just}", under, under, "\n".join(mixed), "\n".join(mixed)])).collect()}
    assert kept == {0: one, 2: just, 3: "own", 4: under, 5: under, 6: "\n".join(mixed)}
