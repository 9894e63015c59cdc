import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tabsynth.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def true():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def texts():
    rnd = random.Random(5)
    alphabet = "abcdeést  \n\t'.,0189ßñ中文🙂\x1c\x85 ́ÀABC$%-_<|>"
    out = ["", " ", "a", "don't  stop\n\n x", "é" * 3000, "ab" * 4000, " " * 999, "<|endoftext|>", "0" * 777]
    out += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 80))) for _ in range(3000)]
    out += ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(50, 2000))) for _ in range(60)]
    out += ["".join(chr(rnd.choice([rnd.randint(1, 0x2FF), rnd.randint(0x300, 0xD7FF), rnd.randint(0x10000, 0x10FFFF)])) for _ in range(30)) for _ in range(500)]
    return out


def test_ids_equal_the_library(true):
    own = bpe.encode_texts(texts(), PATH, public_tokenizers.PATTERN)
    for x, ids in zip(texts(), own, strict=True):
        assert list(memoryview(ids).cast("I")) == true.encode_ordinary(x), repr(x[:80])
        assert bpe.encoder(PATH).decode(ids) == x.encode()


def test_tokens_of_the_vocabulary(true):
    enc = bpe.encoder(PATH)
    for t in list(enc.ranks)[:: 37]:
        assert enc.tokens(t + b"q") == true._encode_single_piece(t + b"q")


def test_documents(spark, true):
    rows = [(1, "Thé cat", "x"), (1, "Thé cat", "x"), (None, "a b", "y"), (2, None, "z"), (3, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN).collect(), key=str)
    assert len(got) == 5
    for r in got:
        x = {1: "Thé cat", None: "a b"}.get(r.doc_id, "")
        ids = b"".join(i.to_bytes(4, "little") for i in true.encode_ordinary(x))
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(x.encode()).hexdigest())
        assert r.ids == ids
    back = bpe.decode_documents(bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN), PATH)
    assert sorted((r.text for r in back.collect()), key=str) == sorted(["Thé cat", "Thé cat", "a b", "", ""])
    assert bpe.encode_documents(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
