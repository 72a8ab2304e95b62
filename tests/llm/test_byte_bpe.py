import hashlib
import random

import pytest

P = pytest.importorskip("public_tokenizers")
import tiktoken  # noqa: E402

from tessera.llm import byte_bpe  # noqa: E402

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.ranks(PATH).rank, special_tokens={})


def odd_texts():
    rnd = random.Random(7)
    fixed = ["", " ", "  a  b ", "\n\n x", "x \n y", "a\tb \t c", "日本語 テキスト", "🙂 🙂🙂  !!", "a" * 3000, " " * 50, "it's we'll  've", "<|endoftext|> a"]
    mixed = ["".join(rnd.choice("ab '\n\t .1é日🙂 sl") for _ in range(rnd.randrange(50))) for _ in range(400)]
    words = ["".join(rnd.choice("etaoinsrhd") for _ in range(rnd.randrange(60))) for _ in range(400)]
    return fixed + mixed + words


def test_block_equals_library(library):
    enc = byte_bpe.Encoder(PATH, P.PATTERN, cache=500)  # forgets on the way
    texts = odd_texts()
    for at in range(0, len(texts), 97):
        block = texts[at:at + 97]
        ids, counts = enc.block(block)
        start = 0
        for text, n in zip(block, counts):
            assert ids[start:start + n].tolist() == library.encode_ordinary(text)
            start += n


def test_rank_order_is_mended():
    r = byte_bpe.ranks(PATH)
    words = [b"tokenization", b"", b"x", b"aaaaaaa"]
    ids, counts = r.replay(words)
    ids, counts = r._mend(words, ids, counts, __import__("numpy").array([0, 3]))
    assert ids.tolist() == [i for w in words for i in r.one(w)] and counts.tolist() == [len(r.one(w)) for w in words]


def test_query_columns(docs_of, library):
    texts = [None, *odd_texts()[:60]]
    docs = docs_of(texts + ["same", "same"])
    got = {r.doc_id: r for r in byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(docs, PATH, P.PATTERN), PATH)).collect()}
    for i, t in enumerate(texts + ["same", "same"]):
        ids = library.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_empty_table(docs_of):
    out = byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(docs_of([]), PATH, P.PATTERN), PATH))
    assert out.count() == 0
