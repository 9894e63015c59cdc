import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabsynth.llm import tokenfile
from tabsynth.llm.tokenfile import ByteIds, Segment, chunk_widths, read_token_files, round_trip, segment, segments, write_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, start long, n_tokens long, at long, crc long"


TOKENIZER = Tokenizer.from_file(PATH)
TOKENIZER.encode_special_tokens = True


def plain(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 40), max_size=30), min_size=1, max_size=60))
def test_any_ids_come_back(docs):
    ids = np.array([x for d in docs for x in d], np.uint32)
    s = Segment(memoryview(segment(list(range(len(docs))), [len(d) for d in docs], ids)))
    assert [s.document(k).tolist() for k in range(len(docs))] == docs
    assert [s[i] for i in range(len(ids))] == ids.tolist()


def test_random_access_in_a_long_segment():
    rnd = np.random.default_rng(1)
    ids = np.minimum(rnd.zipf(1.3, 20_000), 50_000).astype(np.uint32)
    data = segment([None], [len(ids)], ids)
    s = Segment(memoryview(data))
    assert s.doc_ids == [None]
    assert len(data) < 1.4 * len(ids)  # two bytes and more in fixed width
    for i in rnd.integers(0, len(ids), 300).tolist():
        assert s[i] == ids[i]
        assert (s.slice(i, min(i + 700, len(ids))) == ids[i : i + 700]).all()
    with pytest.raises(IndexError):
        s[len(ids)]


def test_one_id_is_read_from_few_bytes():
    """Everything but the bytes that an id's chunks, marks and ranks need may be lost."""
    ids = np.minimum(np.random.default_rng(4).zipf(1.3, 60_000), 50_000).astype(np.uint32)
    s = Segment(memoryview(segment([1], [len(ids)], ids)))
    assert len(s.levels) > 1
    i = int(np.flatnonzero(ids > 9_000)[1000])
    want = int(ids[i])
    blurred, at = [], i
    for k, (width, chunks, marks, directory) in enumerate(s.levels):
        keep = np.zeros(len(chunks), bool)
        keep[at * width // 8 : -(-(at + 1) * width // 8)] = True
        chunks = np.where(keep, chunks, 170).astype(np.uint8)
        if marks is not None:
            near = np.zeros(len(marks), bool)
            near[at // 512 * 64 : at // 8 + 1] = True
            entries = np.zeros(len(directory), bool)
            entries[at // 512] = True
            following = s._rank(k, at)
            marks, directory = np.where(near, marks, 85).astype(np.uint8), np.where(entries, directory, 9)
            at = following
        blurred.append((width, chunks, marks, directory))
    s.levels = blurred
    assert s[i] == want


def test_widths_are_the_cheapest():
    rnd = np.random.default_rng(2)
    ids = np.minimum(rnd.zipf(1.5, 3000), 4000).astype(np.uint32)

    def cost(widths):
        out, rest = 0.0, ids
        for k, w in enumerate(widths):
            out += len(rest) * (w + (1 + 32 / 512) * (k + 1 < len(widths)))
            rest = rest >> np.uint32(w)
            rest = rest[rest > 0]
        return out

    def ways(bits):
        return [[]] if bits == 0 else [[w, *r] for w in range(1, bits + 1) for r in ways(bits - w)]

    assert cost(chunk_widths(ids)) == min(map(cost, ways(int(ids.max()).bit_length())))


def test_units_are_encoded_as_texts_are():
    rnd = random.Random(5)
    alphabet = [" ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "a", "word", "It's", "'re", "12", "\xe9", "日本", "!", "...", "\xa0", "\u2003", "\x1c", "\x1f", "\x85", "\u200b", "<|endoftext|>", "\u3000", "\U0001d4b3", "'", "\x00", "\u180e", "\ufeff"]
    texts = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 14))) for _ in range(3000)] + [None, "", " ", "\n"]
    coder = ByteIds(PATH)
    for _ in range(2):  # unknown units, then known ones
        assert coder.encode(texts) == [array("I", plain(x)).tobytes() for x in texts]


def test_full_cache(monkeypatch):
    monkeypatch.setattr(tokenfile, "MAX_UNITS", 3)
    coder = ByteIds(PATH)
    for text in ("one two three four", "four five one", "one two"):
        assert coder.encode([text]) == [array("I", plain(text)).tobytes()]


def brute(rows):
    out, start = [], 0
    for key, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(r[1].encode()) if r[1] is not None else -1)):
        ids = array("I", [*plain(text), 2])
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def table():
    rows = [(i * 7 % 300, f"Text number {i}, it's here.\n\nAnd  more {i * i}" * (i % 3)) for i in range(300)]
    rows += [(None, "null"), (None, None), (5, "tie"), (5, "tie"), (5, "other"), (1000, "long words " * 20_000), (1001, "é" * 30_000), (-4, "")]
    return [(*r, 1, 2, 3, 4) for r in rows]


def test_round_trip_equals_brute_force(spark):
    found = round_trip(spark.createDataFrame(table(), SCHEMA), PATH, segment_ids=500)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(brute(table()), key=repr)


def test_files_are_in_order(spark, tmp_path):
    docs = spark.createDataFrame(table(), SCHEMA)
    write_token_files(docs, str(tmp_path / "out"), PATH, segment_ids=2000, file_bytes=60_000)
    files = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-"))
    assert len(files) > 3
    keys, numbers = [], []
    for p in files:
        for s in segments(p.read_bytes()):
            keys += s.doc_ids
            numbers.append((s.file, s.number))
    assert numbers == sorted(set(numbers))
    assert keys == [k for k, *_ in brute(table())]
    whole = {(r["doc_id"], r["start"]): r["ids"] for r in read_token_files(spark, str(tmp_path / "out"), keep_ids=True).collect()}
    assert whole[-4, min(s for k, s in whole if k == -4)] == array("I", [2]).tobytes()


def test_empty_table(spark):
    assert round_trip(spark.createDataFrame([], SCHEMA), PATH).count() == 0
