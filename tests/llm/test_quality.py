import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tabsynth.llm import quality


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def texts():
    rnd = random.Random(4)
    out = ["", None, " \n\t", "a", "x " * 40, "a b c d e f g h " * 3, "a\n\na\n a\na", "é🙂 #*$%&|<>\x1c\x85 b", "one two\x0bthree\x0c"]
    for _ in range(120):
        w = [rnd.choice("ab") for _ in range(rnd.randint(0, 60))]
        out.append("".join(x + rnd.choice([" ", "\n", "  ", "\t", " # "]) for x in w))
    return out


def test_base_rules_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    got = {r[0]: tuple(r[1:]) for r in spark.createDataFrame(rows, "i int, text string").withColumn("w", quality.words(F.col("text"))).select("i", *[c.alias(k) for k, c in quality.base_rules(F.col("text"), F.col("w")).items()]).collect()}
    for i, x in rows:
        assert got[i] == brute(x), repr(x)


def test_verdicts(spark):
    rnd = random.Random(6)
    good, junk = [f"word{i}" for i in range(50)], [f"%%{i}##" for i in range(50)]
    make = lambda pool: " ".join(rnd.choice(pool) for _ in range(60))
    rows = [(i, make(good if i % 3 else junk), True) for i in range(90)] + [(500, None, True), (501, "", True), (None, make(good), True), (1, make(good), True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept boolean")
    trusted = spark.createDataFrame([(i, "x") for i in range(0, 60) if i % 3] + [(None, "y"), (1, "z")], "doc_id long, text string")
    got = quality.quality_verdicts(docs, trusted).collect()
    assert len(got) == len(rows)
    for r in got:
        n = len((r.text or "").split())
        assert r.n_words == n and r.base_failed == (n < 20)
        assert r.kept == (n >= 20 and "word" in r.text), r
    assert quality.quality_verdicts(docs.limit(0), trusted).count() == 0
    assert all(r.score == 0 for r in quality.quality_verdicts(docs, trusted.limit(0)).collect())


def test_junk_is_caught_at_two_sizes(spark):
    for sf, most in (("/root/testdata/sf0.01", 0.15), ("/root/testdata/sf0.1", 0.02)):
        docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
        labels = spark.read.parquet(f"{sf}/labels.parquet")
        verdicts = quality.quality_verdicts(docs, labels.where("quality = 1 and toxic = 0")).drop("text")
        rows = verdicts.where("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.count_if("kept").alias("kept"), F.count("*").alias("n")).collect()
        got = {r.quality: (r.kept, r.n) for r in rows}
        assert got[0][0] <= most * got[0][1] and got[1][0] >= 0.98 * got[1][1]


def test_scores_and_verdicts_equal_brute_force(spark):
    rnd = random.Random(8)
    pool = [f"w{i}" for i in range(80)] + ["É", "Straße", "W1"]
    rows = [(i, " ".join(rnd.choice(pool[i % 3 * 20 :]) for _ in range(rnd.choice([0, 5, 25, 40]))), 1) for i in range(60)] + [(90, "spam " * 30, 2), (91, None, 3)]
    rows += [(100 + i, " ".join(f"junk{rnd.randrange(9)}" for _ in range(30)), 4) for i in range(12)]
    names = ["_words", "found", "grams", "x", "t", "right_k", "row"]
    docs = spark.createDataFrame([(*r[:2], *range(7)) for r in rows], ", ".join(["doc_id long", "text string", *(f"{n} int" for n in names)]))
    trusted = set(range(0, 60, 4))
    got = quality.quality_verdicts(docs, spark.createDataFrame([(i, 1) for i in trusted], "doc_id long, k int")).collect()
    words = {i: (x or "").split() for i, x, *_ in rows}
    known = sorted({w for ws in words.values() for w in ws})
    h = {r.w: r.h for r in spark.createDataFrame([(w,) for w in known], "w string").select("w", F.xxhash64(F.lower("w")).alias("h")).collect()}
    pairs = sorted({(h[a], h[b]) for ws in words.values() for a, b in zip(ws, ws[1:], strict=False)})
    hp = {(r.a, r.b): r.h for r in spark.createDataFrame(pairs, "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}
    buckets = quality.FEWEST_BUCKETS
    grams = {i: [h[w] % buckets for w in ws] + [hp[h[a], h[b]] % buckets for a, b in zip(ws, ws[1:], strict=False)] for i, ws in words.items()}
    n = Counter(g for gs in grams.values() for g in gs)
    t = Counter(g for i in trusted for g in grams[i])
    share = sum(t.values()) / sum(n.values())
    score = {i: sum(round(math.log((t[g] - (i in trusted) + 1) / ((n[g] - 1) * share + 1)) * 1e6) for g in gs) / len(gs) / 1e6 if gs else 0.0 for i, gs in grams.items()}
    low, middle = np.quantile([round(score[i], 3) for i in trusted if len(words[i]) >= 20], [quality.QUANTILE, 0.5])
    assert len(got) == len(rows) and len({r.kept for r in got if not r.base_failed}) == 2
    for r in got:
        assert math.isclose(r.score, score[r.doc_id], abs_tol=2e-6)
        assert r.kept == (not r.base_failed and score[r.doc_id] >= low - (middle - low) / 4)
        assert tuple(r)[2:9] == tuple(range(7))
