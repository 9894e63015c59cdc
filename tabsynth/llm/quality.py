"""Quality rules: base rules, and a hashed n-gram log-likelihood ratio between two multinomials.

Trusted documents and the whole corpus each give a multinomial over buckets of hashed word uni- and bigrams. A document's score is
the mean of log(trusted / corpus) over its n-grams. The threshold is derived from the trusted documents' own
scores, so equal input gives equal verdicts. DataFrame functions only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsynth.llm.common import WORD, forget, written

#: Fixed value: the symbols that count.
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
#: Of the trusted documents' scores, for the threshold.
QUANTILE = 0.005
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Buckets of hashed n-grams: as many as there may be n-grams, within these bounds. So the table of counts that is broadcast has a proven bound.
FEWEST_BUCKETS, MOST_BUCKETS = 1 << 14, 1 << 20
#: Trusted documents that the trusted side counts at most: those whose keys have the smallest hashes. Their keys are broadcast.
MAX_TRUSTED = 100_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_window_words(hashes: Column, n: int = WINDOW) -> Column:
    """How many words lie in an n-word window that the text has twice or more. hashes: of its words."""

    def windows(h: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(h) - n + 1, F.lit(1)))
        return F.when(F.size(h) >= n, F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, n)))).otherwise(F.array().cast("array<bigint>"))

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, k + 1)["h"].eqNullSafe(x["h"])))
        starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
        step = lambda a, i: F.struct((a["n"] + i + n - F.greatest(i, a["end"])).alias("n"), (i + n).alias("end"))
        return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"]

    def count(w: Column) -> Column:
        pairs = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(pairs, covered))

    return let(let(hashes, windows), count).cast("long")


def repeated_lines(text: Column) -> Column:
    """How many lines with a word equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def ngram_buckets(found: Column, buckets: int) -> Column:
    """Buckets of the uni- and bigrams of a text's words."""

    def grams(h: Column) -> Column:
        one = F.transform(h, lambda x: F.pmod(x, F.lit(buckets)).cast("int"))
        pairs = F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0)))
        return F.concat(one, F.transform(pairs, lambda x, i: F.pmod(F.xxhash64(F.get(h, i), x), F.lit(buckets)).cast("int")))

    return let(F.transform(found, lambda w: F.xxhash64(F.lower(w))), grams)


def scored_texts(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", prior: float = 1.0, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """k, x (hash of the text), t (1: trusted), the base rules' figures, n_grams and score (mean log ratio) of each key and text.

    All documents count. Each n-gram is scored by the counts without itself, so trusted documents score like others of their kind. prior is
    added to the trusted count and to the one expected: with little evidence the ratio is near 1. Texts are never shuffled.
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 1
    buckets = min(MOST_BUCKETS, max(FEWEST_BUCKETS, 1 << math.ceil(math.log2(size / 4 + 1))))
    keys = trusted.select(F.col(key).alias("k")).where("k is not null").distinct().orderBy(F.xxhash64("k"), "k").limit(max_trusted).withColumn("t", F.lit(1))
    marked = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(keys), "k", "left").select("k", "text", F.coalesce("t", F.lit(0)).alias("t"))
    grams = marked.select("t", F.explode(ngram_buckets(words(F.col("text")), buckets)).alias("b"))
    counts = written(grams.groupBy("b").agg(F.sum("t").alias("in_t"), F.count(F.lit(1)).alias("in_n")), "buckets")
    sums = counts.agg(F.sum("in_t").alias("t"), F.sum("in_n").alias("n")).first()
    share = (sums["t"] or 0) / max(sums["n"] or 0, 1)
    # in whole millionths, so that the order of rows doesn't matter when they are summed
    ratio = lambda own: F.round(F.log((F.col("in_t") - own + prior) / ((F.col("in_n") - 1) * share + prior)) * 1e6).cast("long")
    ratios = written(counts.select("b", ratio(0).alias("r0"), F.when(F.col("in_t") > 0, ratio(1)).alias("r1")), "ratios")
    cut = marked.select("k", "t", F.xxhash64("text").alias("x"), "text", words(F.col("text")).alias("found"))  # a step of its own, so that texts are split once
    figures = cut.select("k", "x", "t", *[c.alias(n) for n, c in base_rules(F.col("text"), F.col("found")).items()], ngram_buckets(F.col("found"), buckets).alias("grams"))
    each = figures.select("k", "x", "t", *BASE, F.explode_outer("grams").alias("b"))  # figures are worked out once for each text, below the generator
    scored = each.join(F.broadcast(ratios), "b", "left").groupBy("k", "x", "t", *BASE)
    out = written(scored.agg(F.count("b").alias("n_grams"), F.coalesce(F.avg(F.when(F.col("t") == 1, F.col("r1")).otherwise(F.col("r0"))) / 1e6, F.lit(0.0)).alias("score")), "scores")
    forget(counts, ratios)
    return out


def trusted_threshold(scores: DataFrame) -> float:
    """The low quantile of the scores of the trusted documents with enough words, less a quarter of its distance to the median."""
    known = scores.where((F.col("t") == 1) & (F.col("n_words") >= MIN_WORDS))
    q = known.agg(F.percentile(F.round("score", 3), F.array(F.lit(QUANTILE), F.lit(0.5)))).first()[0]  # rounded: few distinct values
    return q[0] - (q[1] - q[0]) / 4 if q else 0.0


def base_rules(text: Column, found: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text and its words; null counts as empty."""
    body = F.coalesce(text, F.lit(""))
    return {
        "n_words": F.size(found).cast("long"),
        "word_chars": F.length(F.array_join(found, "")).cast("long"),
        "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": repeated_lines(body),
        "n_repeat_words": repeated_window_words(F.transform(found, lambda w: F.xxhash64(w))),
    }


def quality_verdicts(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", threshold: float | None = None) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed, kept.

    A document is kept if it passes the base rules and its score is at least the threshold (None: trusted_threshold). Null and
    empty texts have no words and fail the base rules. Repeated rows get equal verdicts, whatever the order. Without trusted
    documents every score is 0. Columns of these names in docs are replaced, all others stay, whatever they are called; trusted may have any others.
    """
    scores = scored_texts(docs, trusted, key, text)
    threshold = trusted_threshold(scores) if threshold is None else threshold
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    verdicts = scores.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))
    found = verdicts.select(F.col("k").alias("right_k"), F.col("x").alias("right_x"), *(added := [*BASE, "score", "base_failed", "kept"]))
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("x"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = rows.join(found, rows["k"].eqNullSafe(found["right_k"]) & (rows["x"] == found["right_x"]))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in added], *added)
