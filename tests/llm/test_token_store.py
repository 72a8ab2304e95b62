import os
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from tessera.llm import token_store as S  # noqa: E402

PATH = P.path("word_bpe_49k.json")
ODD = ["", " ", "a\n\nb  c\td", "Don't STOP   now", "é é ́x", "日本語 🙂", "<|endoftext|> x", "a <|endoftext|> b", "ab<|startoftext|>cd<|endoftext|>", "<|ENDOFTEXT|> y", "x<|endoftext|",  "ΑΣ ς\x1cq\x85z", "w " * 3000, "Übergröße, ÉTÉ. ŉ ſ İstanbul ẞ ĳ Ångström! naïve? ñ; x² ½, «été» ª º µ ŀ", "e\u0301te\u0301. E\u0301"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text, add_special_tokens=False).ids + [2]


def test_words_equal_whole_texts(library):
    enc = S.WordEncoder(PATH, 2, cache=3)
    for block in (ODD, ODD[::-1]):
        ids, counts = enc.block(block)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library(t) for t in block]


def test_added_tokens_are_the_plain_librarys():
    ids, counts = S.WordEncoder(PATH, 2).block(["a <|endoftext|> b"])
    assert ids.tolist() == Tokenizer.from_file(PATH).encode("a <|endoftext|> b", add_special_tokens=False).ids + [2] == [320, 49407, 321, 2]


def test_round_trip_and_seek(spark, docs_of, library, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "FRAME_TOKENS", 50)
    rows = [(7 * i % 101, t) for i, t in enumerate(ODD * 9)] + [(None, "null id"), (500, None), (501, "same"), (501, "same")]
    store = S.Store.create(docs_of(rows), str(tmp_path / "s"), PATH, 2)
    got = store.read(spark).orderBy("start").collect()
    assert sum(f[2] for f in store.files) == len(rows) == len(got)
    expected = sorted(((-1 if i is None else i, library(t or "")) for i, t in rows), key=lambda r: r[0])
    assert [-1 if r.doc_id is None else r.doc_id for r in got] == [r[0] for r in expected]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids) for r in got) == sorted(expected)
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([len(r.ids) for r in got])])[:-1].tolist()
    d = {r.start: r for r in S.digests(store.read(spark)).collect()}
    for r in got:
        assert d[r.start].ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and d[r.start].n_tokens == len(r.ids)
    assert {r.doc_id for r in store.read(spark, [500, 14]).collect()} == {500, 14}


def test_damage_is_seen(spark, docs_of, tmp_path):
    store = S.Store.create(docs_of(["some text to damage"] * 3).coalesce(1), str(tmp_path / "s"), PATH, 2)
    name = os.path.join(store.folder, store.files[0][0])
    data = bytearray(open(name, "rb").read())
    at = data.rindex((S.SKIPPABLE).to_bytes(4, "little"))
    data[at + 16] ^= 1  # the checksum of the first frame
    open(name, "wb").write(data)
    with S._open(name)[0].open_input_file(name) as f, pytest.raises(ValueError, match="checksum"):
        list(S.FrameReader(f).frames())


def test_empty_table(spark, docs_of, tmp_path):
    store = S.Store.create(docs_of([]), str(tmp_path / "s"), PATH, 2)
    assert store.files == [] and store.read(spark).count() == 0


def test_attempts_do_not_share_a_file(spark, docs_of, tmp_path):
    """What a lost attempt leaves behind is in no manifest: two runs into one folder read back their own files each."""
    first = S.Store.create(docs_of(["one two"] * 4), str(tmp_path / "s"), PATH, 2)
    open(os.path.join(first.folder, "part-000000-dead.tokens.zst"), "wb").write(b"half a file")
    second = S.Store.create(docs_of(["three"] * 2), str(tmp_path / "s"), PATH, 2)
    assert not {f[0] for f in first.files} & {f[0] for f in second.files}
    assert (first.read(spark).count(), second.read(spark).count()) == (4, 2)
