import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabsynth.llm import packing, wordbpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def fewest(lengths, room):
    """The fewest bins, by trying all."""
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= room:
                go(i + 1, bins[:k] + [bins[k] + lengths[i]] + bins[k + 1 :])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best


def test_bound_and_packing():
    rnd = random.Random(3)
    for _ in range(300):
        room = rnd.choice([10, 12, 30, 31])
        x = np.array([rnd.randint(1, room) for _ in range(rnd.randint(1, 8))])
        bins, offsets, used = packing.best_fit_decreasing(x, room)
        best, bound = fewest(sorted(x.tolist(), reverse=True), room), packing.lower_bound(x, room)
        assert bound <= best <= used
        for b in range(used):
            spans = sorted((offsets[i], offsets[i] + x[i]) for i in range(len(x)) if bins[i] == b)
            assert spans[0][0] == 0 and spans[-1][1] <= room and all(p[1] == q[0] for p, q in itertools.pairwise(spans))


def test_word_ids():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    rnd = random.Random(1)
    alphabet = "abcdeéstÀÉİΣσß'.,09 \n\t\x0b\x1c\x85 ́中🙂<|>%-"
    x = ["", "Don't STOP 's ''s", "<|endoftext|> a<|startoftext|>", "École naïve ẞ ǅ"] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(2000)]
    for _ in range(2):
        for text, ids in zip(x, wordbpe.word_ids(PATH).encode(x), strict=True):
            assert list(memoryview(ids).cast("I")) == t.encode(text, add_special_tokens=False).ids, repr(text)


def check(rows, room):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.offset + r.length))
    for spans in by.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= room and all(p[1] == q[0] for p, q in itertools.pairwise(spans))
    return len(by)


def test_documents(spark):
    t = Tokenizer.from_file(PATH)
    rows = [(1, "the cat sat " * 40, 1), (1, "the cat sat " * 40, 1), (2, None, 2), (3, "", 3), (None, "a b", 4), (4, "dog " * 3, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long")
    got = packing.pack_documents(docs, PATH, room=50).collect()
    check(got, 50)
    want = []
    for d, x, _ in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        want += [(str(d), k // 50, k, len(ids[k : k + 50]), zlib.crc32(np.array(ids[k : k + 50], "<u4").tobytes())) for k in range(0, len(ids), 50)]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def test_rounds_save_sequences(spark):
    pieces = spark.range(3000).select((F.xxhash64("id") % 60).alias("x"), "id").selectExpr("id doc_id", "0 piece", "40 + abs(x) length", "0L ids_crc32").cache()
    got = packing.pack_lengths(pieces, room=256, group_rows=100).collect()
    alone = packing.pack_lengths(pieces, room=256, group_rows=100, rounds=0).collect()
    assert len(got) == 3000 and check(got, 256) <= check(alone, 256)
    bound = packing.lower_bound(np.array([r.length for r in got]), 256)
    assert bound <= check(got, 256) <= 1.05 * bound


def test_equal_rows_spread_over_groups(spark):
    pieces = spark.range(50_000).selectExpr("7L doc_id", "0 piece", "100L length", "0L ids_crc32")
    packed = packing.pack_lengths(pieces, room=256, group_rows=1000, rounds=0)
    groups = packed.groupBy((F.col("sequence_id").bitwiseAND((1 << 58) - 1) / (1 << 24)).cast("long")).count().collect()
    assert packed.count() == 50_000 and len(groups) >= 40 and max(r["count"] for r in groups) < 2000


def test_small_caches_give_the_same_ids(monkeypatch):
    texts = [" ".join(f"w{i}x{j}" for i in range(40)) for j in range(30)]
    want = wordbpe.WordIds(PATH).encode(texts)
    monkeypatch.setattr(wordbpe, "MAX_WORDS", 50)
    monkeypatch.setattr(wordbpe, "MAX_PIECES", 60)
    small = wordbpe.WordIds(PATH)
    assert [small.encode([t])[0] for t in texts] == want and small.encode(texts) == want and len(small.words) <= 50
