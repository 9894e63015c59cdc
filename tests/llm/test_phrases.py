import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tabsynth.llm.phrases import ID_BITS, BurstTrie, Sieve, make_sieve, merge_runs, mine_phrases, word_hash

SCHEMA = "doc_id long, text string, lang string, rank long, phrase string, part int, f long, words long"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def brute(rows, least, top=2000):
    counts, words = {}, Counter()
    for text, lang in rows:
        mine = counts.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(str.maketrans(UPPER, LOWER))):
            ws = tuple(re.findall("[^ \t]+", piece))
            words[lang or "und"] += len(ws)
            mine.update(ws[i : i + k] for k in range(1, 5) for i in range(len(ws) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: n for p, n in f.items() if 2 <= len(p) and n >= least}
        inside = {}
        for p, n in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(n, inside.get(p[i : i + k], 0))
        found = []
        for p, a in candidates.items():
            if 100 * inside.get(p, 0) >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, words[lang], -score))
    return sorted(out)


def table(seed=1, docs=150):
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "New", "york", "city", "a", "é", "Ü", "x\x01y", "x", "\xa0", "naïve", "\x1c", *[f"w{i}" for i in range(40)]]
    weights = [30, 20, 9, 9, 6, 12, 5, 4, 3, 3, 2, 3, 2, *[1] * 40]
    rows = []
    for _ in range(docs):
        n = rnd.choice([0, 1, 5, 60, 200])
        ws = rnd.choices(vocabulary, weights, k=n)
        text = "".join(w + rnd.choice([" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "! ", "\x0b"]) for w in ws)
        if rnd.random() < 0.4:
            text += " New York city hall, new york City hall. the end of a the"
        rows.append((text, rnd.choice(["en", "en", "en", None, "de", "und"])))
    return [*rows, *rows[:20], (None, "en"), ("", None), ("word " * 30_000, "en"), ("y" * 100_000, "de")]


def framed(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "p", 2, 3, 4) for i, (t, lang) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("limits", [{}, {"burst": 8, "entries": 100, "most_words": 30, "part_bytes": 20_000, "sieve_bits": 1, "rank_rows": 20}])
def test_equals_brute_force(spark, limits):
    rows, top = table(), 2000 if not limits else 9
    found = mine_phrases(framed(spark, rows).repartition(3), least=8, top=top, **limits)
    assert sorted(map(tuple, found.collect())) == brute(rows, 8, top)


def test_empty_table_and_rare_phrases(spark):
    assert mine_phrases(framed(spark, [])).count() == 0
    assert mine_phrases(framed(spark, [("one two three", "en"), ("", "de")])).count() == 0


def test_trie_counts_bursts_and_spills():
    rnd = np.random.default_rng(3)
    trie, want, got, least = BurstTrie(burst=20), Counter(), Counter(), 0
    for _ in range(30):
        first = rnd.zipf(1.6, 500) % 50 + 1
        rest = (rnd.zipf(1.5, 500) % 40 + 1) << 2 * ID_BITS | (rnd.integers(1, 5, 500)) << ID_BITS
        trie.add(first, rest)
        want.update(zip(first.tolist(), rest.tolist(), strict=True))
        assert trie.entries == sum(len(x) if isinstance(x, Counter) else sum(map(len, x.values())) for x in trie.top.values())
        if trie.entries > 300:
            least += any(type(x) is dict for x in trie.top.values())
            a, b, n = trie.spill(150)
            assert trie.entries <= 150
            assert list(zip(a, b, strict=True)) == sorted(zip(a, b, strict=True))
            for w, r, c in zip(a.tolist(), b.tolist(), n.tolist(), strict=True):
                got[w, r] += c
            assert not set(a.tolist()) & set(trie.top)  # whole subtrees leave
    a, b, n = trie.spill()
    for w, r, c in zip(a.tolist(), b.tolist(), n.tolist(), strict=True):
        got[w, r] += c
    assert least
    assert got == want


def test_sieve_lets_all_frequent_words_through(spark):
    rows = [("en", f"word{i}") for i in range(3000)]
    sieve = Sieve(*make_sieve(spark.createDataFrame(rows, "lang string, phrase string")).value)
    known = np.array([word_hash(a, b.encode()) for a, b in rows], np.uint64)
    other = np.array([word_hash("de", b.encode()) for _, b in rows], np.uint64)
    assert sieve(known).all()
    assert sieve(other).mean() < 0.1


def test_merge():
    runs = pa.table({"phrases": [["a", "b c"], ["a", "é"], ["b c"]], "counts": [[1, 5], [2, 3], [1]]})
    assert merge_runs(runs, 3) == (["a", "b c", "é"], [3, 6, 3], 12)
