import random

import numpy as np
from pyspark.sql import functions as F

from tabsynth.llm import jaccard as jc


def brute(rows, percent=80):
    sets = []
    for _, x in rows:
        w = (x or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 4)))
    texts = ["", None, " \n", "a b", "A  b", "a b c d", "a b c d e", "one", "x " * 30, "x " * 40]
    passage = " ".join(word() for _ in range(40))
    for _ in range(n):
        base = [word() for _ in range(rnd.randint(5, 120))]
        for _ in range(rnd.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = word()
            texts.append(rnd.choice([" ", "\n"]).join(w))
        if rnd.random() < 0.4:
            texts.append(" ".join(base[:30]) + " " + passage)
    hot = [word() for _ in range(150)]
    for _ in range(90):  # a large group of near copies, some of them far from most
        w = list(hot)
        for _ in range(rnd.choice([0, 1, 2, 3, 5, 9])):
            w[rnd.randrange(len(w))] = word()
        texts.append(" ".join(w))
    rnd.shuffle(texts)
    return [(i * 3, x) for i, x in enumerate(texts)]


def test_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jc, "SHORT", 8)
    for seed in (1, 2):
        rows = corpus(seed) + [(None, "a b c d e"), (3, "one two three four five"), (3, "one two three four five")]
        docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, n long, k string")
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jc.jaccard_components(docs).collect()), key=str)
        assert got == brute(rows)


def test_keep_one(spark):
    rows = [(4, "a b c d e f"), (2, "A b c d e f"), (9, "q"), (5, None), (6, ""), (None, "a b c d e f"), (2, "A b c d e f")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, k long")
    got = sorted((tuple(r) for r in jc.keep_one_of_each(docs).collect()), key=str)
    assert got == sorted([(2, "A b c d e f", 1), (9, "q", 1), (5, None, 1), (6, "", 1)], key=str)
    assert jc.keep_one_of_each(docs.limit(0)).count() == 0 and jc.jaccard_components(docs.limit(0)).count() == 0


def test_blocks_of_a_long_list_lose_no_pair(monkeypatch):
    monkeypatch.setattr(jc, "BLOCK", 4)
    rnd = np.random.default_rng(4)
    for _ in range(20):
        n = np.sort(rnd.integers(1, 300, 120))
        place = (rnd.random(120) * (n - jc.need(n, 80) + 1)).astype(np.int64)
        got = {(int(i), int(j)) for a, b in jc.block_pairs(n, place, 80) for i, j in zip(a, b, strict=True)}
        a, b = np.triu_indices(120, 1)
        ok = jc.fits(n[a], place[a], n[b], place[b], 80)
        assert got == set(zip(a[ok].tolist(), b[ok].tolist(), strict=True))


def test_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jc, "TILE", 16)  # tiles of blocks, not one for a hub
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(5))
    hot, rows = [word() for _ in range(120)], []
    for i in range(400):
        w = list(rows[rnd.randrange(len(rows))][1].split() if i and rnd.random() < 0.3 else hot)
        for _ in range(rnd.choice([0, 1, 2, 3, 4, 5, 6])):
            w[rnd.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, hot_ * n) for i, (hot_, n) in enumerate([("x ", 50_000), ("x ", 49_000), ("a" * 9000 + " ", 1), ("a" * 9001 + " ", 1), ("a" * 9000 + " ", 1)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jc.jaccard_components(docs).collect()), key=str)
    assert got == brute(rows) and len({c for _, _, c in got}) > 5


def test_columns_of_any_name(spark):
    names = ["k", "_k", "cid", "n", "row", "component", "f", "hub"]
    docs = spark.createDataFrame([(i, "a b c d e f", *range(8)) for i in range(3)], ", ".join(["doc_id long", "text string", *(f"`{n}` int" for n in names)]))
    assert [tuple(r) for r in jc.keep_one_of_each(docs).collect()] == [(0, "a b c d e f", *range(8))]


def test_texts_that_no_pair_names_are_not_shuffled(spark):
    docs = spark.range(20_000).select(F.xxhash64("id").alias("k"), F.col("id").cast("string").alias("text"))
    wanted = docs.where("text % 100 = 7").select("k")
    got = jc.sieved(docs, wanted, 200)
    assert got.columns == ["k", "text"] and got.join(wanted, "k", "left_semi").count() == 200
    assert got.count() < 1000 and jc.sieved(docs, wanted.limit(0), 0).count() == 0
    assert "hashpartitioning(k" not in got._jdf.queryExecution().executedPlan().toString()


def test_postings_of_a_bucket_hold_half_hashes(spark):
    h = np.array([5 + (1 << 40), 6 + (1 << 40)], np.uint64)
    sets = spark.createDataFrame([(1, 2, bytearray(h.tobytes()), None), (2, 2, bytearray(h.tobytes()), None)], "cid long, n long, prefix binary, hubs array<long>")
    rows = jc.bucketed(sets.coalesce(1), 1).toPandas()
    assert [len(x) for x in rows["hash"]] == [16] and jc.list_pairs(rows, 80).values.tolist() == [[1, 2]]
