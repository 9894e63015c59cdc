import random

import public_tokenizers

from tabsynth.llm import unigram

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute(word, scores, unknown):
    best = [(0.0, 0)] + [None] * len(word)
    for e in range(1, len(word) + 1):
        tries = [(best[e - 1][0] + unknown, best[e - 1][1] - 1)]
        tries += [(best[s][0] + scores[word[s:e]], best[s][1] - 1) for s in range(e) if word[s:e] in scores]
        best[e] = max(tries)
    return -best[-1][1]


def test_counts_equal_brute_force(monkeypatch):
    scores, unknown = unigram.read_scores(PATH)
    trie = unigram.PrefixTrie(unigram.Vocabulary(scores, unknown))
    monkeypatch.setattr(unigram, "MAX_NODES", 500)
    rnd = random.Random(2)
    for _ in range(800):
        w = unigram.MARK + "".join(rnd.choice("theandingsouré中▁.") for _ in range(rnd.randint(0, 24)))
        assert trie.count(w) == trie.count(w) == brute(w, scores, unknown)
    long = unigram.MARK + "the" * 500
    assert trie.count(long) == brute(long, scores, unknown)


def test_documents(spark):
    docs = spark.createDataFrame([(1, "the cat\n the"), (1, "the cat\n the"), (2, None), (3, " \t"), (None, "cat")], "doc_id long, text string")
    scores, unknown = unigram.read_scores(PATH)
    n = {w: brute(unigram.MARK + w, scores, unknown) for w in ("the", "cat")}
    got = sorted((tuple(r) for r in unigram.count_tokens(docs, PATH).collect()), key=str)
    assert got == sorted([(1, 3, 2 * n["the"] + n["cat"])] * 2 + [(2, 0, 0), (3, 0, 0), (None, 1, n["cat"])], key=str)
    assert unigram.count_tokens(docs.limit(0), PATH).count() == 0
