"""Exact Jaccard self-join of word-shingle sets, and the classes that its links make.

Equal sets become one class first. Then three steps find every link between classes, or what settles it:

1. Hubs. Classes with an equal least hash of their shingles (four hash functions) are compared with one of them, the
   hub: that with the smallest share of rare shingles, which is the most central. A class has four hubs at most, so these pairs grow as
   the classes do, however large a group of similar sets is. Of each pair whose similarity is a half or more, the
   shingles by which the set differs from its hub are kept.
2. Answers derived from a similar set's. With hub H, what sets lack of H (G) and have beyond H (E),
   |x & y| = |H| - |Gx| - |Gy| + |Gx & Gy| + |Ex & Ey|. So all pairs of one hub are settled exactly from short lists of differences. Two sets that
   both link to the hub are in its component already; the rest are compared in tiles of bounded size, of which those whose distances to the
   hub differ too much are skipped by the triangle inequality.
3. Prefix filter, for pairs that share no hub. Any one order of the shingles gives one, here: rarest first by a sketch of all documents' counts, then by
   hash. Index lists hold (class, size, place in the order) in blocks; a block meets another only if their sizes and places
   leave room for enough common shingles. Pairs whose counts in a few hundred hash cells rule a link out are dropped; the
   rest are compared as whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsynth.llm.common import forget, shuffle_partitions, written
from tabsynth.llm.components import connected_components

WORDS = 5
CELLS = 1 << 22  # of the sketch of shingle counts
SHORT = 48  # lists of at most this many classes are not cut into blocks
BLOCK = 32  # entries of a long list's block
HASHES = 4  # least hashes of a set: so many hubs at most
COVER = 50  # percent of similarity to a hub from which differences to it are kept
TILE = 2048  # sets of one hub that a task compares with as many
TALLY = 256  # hash cells that a set's shingles are counted in
BUCKET_POSTINGS = 300_000
GROUP_SHINGLES = 2_000_000
SIEVE_BITS = 16  # of the sieve for each text that is wanted
SIEVE_MOST = 1 << 27  # bits of a sieve: a fuller one lets more texts through, never fewer

_rnd = np.random.default_rng(20240101)
_BYTE = _rnd.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rnd.integers(1, 1 << 63, 1 << 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BYTE[_SPACE] = 0


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x + np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's distinct shingles, sorted, all texts in a row; and the number for each text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    first, last = (int(offsets[0]), int(offsets[-1])) if n else (0, 0)
    if last == first:
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[first:last]
    offsets = offsets - first
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    begins[edge] |= solid[edge]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    word = np.cumsum(begins) - 1
    word[: starts[0]] = 0
    place = (np.arange(len(data)) - starts[word]) & (len(_PLACE) - 1)
    h = mixed(np.add.reduceat(mixed(_BYTE[data]) * _PLACE[place] * solid, starts), 1)
    doc = np.searchsorted(offsets, starts, "right") - 1
    size = np.bincount(doc, minlength=n)
    take = np.arange(len(h))
    whole = np.concatenate([[True] * (len(h) - words + 1), [False] * min(len(h), words - 1)])[: len(h)] if len(h) >= words else np.zeros(len(h), bool)
    whole[whole] = doc[take[whole]] == doc[take[whole] + words - 1]
    at = np.flatnonzero(whole)
    sums = np.zeros(len(at), np.uint64)
    for j in range(words):
        sums += h[at + j] * _PLACE[j]
    few = np.flatnonzero((size > 0) & (size < words))  # the whole sequence is the one shingle
    begin = np.searchsorted(doc, few)
    short = np.zeros(len(few), np.uint64)
    for j in range(words - 1):
        more = size[few] > j
        short[more] += h[begin[more] + j] * _PLACE[j]
    s = mixed(np.concatenate([sums, short + size[few].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)]), 2)
    d = np.concatenate([doc[at], few])
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    return s[new], np.bincount(d[new], minlength=n)


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with some `most` bytes of text each."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size)
    at = 0
    while at < len(batch):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def need(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The fewest shingles that a set of n shares with any set it links to."""
    return -(-n * percent // 100)


def count_sketch(docs: DataFrame, words: int) -> np.ndarray:
    """How often shingles fall in each cell, over all documents; docs: key, text. Of fixed size, whatever the corpus."""
    block = 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.uint32)
        for batch in batches:
            for part in slices(batch, 1):
                np.add.at(cells, (shingle_sets(part.column(1), words)[0] & np.uint64(CELLS - 1)).astype(np.int64), 1)
        if cells.any():
            body = [np.minimum(cells[i : i + block], 65535).astype(np.uint16).tobytes() for i in range(0, CELLS, block)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(body)), pa.int32()), pa.array(body, pa.binary())], ["block", "cells"])

    def total(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(block, np.uint32)
        for x in rows["cells"]:
            out += np.frombuffer(x, np.uint16)
        return pd.DataFrame({"block": [key[0]], "cells": [out.tobytes()]})

    out = np.zeros(CELLS, np.uint32)
    for r in docs.mapInArrow(run, "block int, cells binary").groupBy("block").applyInPandas(total, "block int, cells binary").toLocalIterator():
        out[r["block"] * block : (r["block"] + 1) * block] = np.frombuffer(r["cells"], np.uint32)
    return out


def rarity(cells: np.ndarray) -> np.ndarray:
    """Class of each cell: 0 for what chance explains, then by powers of the square root of two. Any classes give right results."""
    middle = float(np.median(cells))
    floor = middle + 7 * math.sqrt(middle) + 12
    return np.where(cells > floor, 1 + np.clip(2 * np.log2(np.maximum(cells, 1) / floor), 0, 60), 0).astype(np.uint8)


def tallies(s: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Counts of each set's shingles by hash cell, a byte each; empty if one doesn't fit."""
    doc = np.repeat(np.arange(len(n)), n)
    counts = np.bincount(doc * TALLY + (s >> np.uint64(48)).astype(np.int64) % TALLY, minlength=len(n) * TALLY).reshape(-1, TALLY)
    return [b"" if c.max(initial=0) > 255 else c.astype(np.uint8).tobytes() for c in counts]


def may_link(n1: np.ndarray, t1: np.ndarray, n2: np.ndarray, t2: np.ndarray, percent: int) -> np.ndarray:
    """Whether tallies leave room for a link: no two sets share more than the sum of the lesser counts."""
    return np.minimum(t1, t2).sum(-1, dtype=np.int64) >= -(-percent * (n1 + n2) // (100 + percent))


def tally_matrix(raw: list[bytes]) -> np.ndarray:
    """Rows of counts; one without counts gets the most there can be, so that it rules nothing out."""
    return np.frombuffer(b"".join(x if x else b"\xff" * TALLY for x in raw), np.uint8).reshape(-1, TALLY)


def possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b whose tallies leave room for a link."""
    one, two = (classes.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.col("tally").alias(f"t{c}")) for c in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                a, b, n1, n2 = (part.column(i).to_numpy() for i in range(4))
                t1, t2 = part.column(4).to_pylist(), part.column(5).to_pylist()
                whole = np.array([not x or not y for x, y in zip(t1, t2, strict=True)])
                keep = whole | may_link(n1, tally_matrix(t1), n2, tally_matrix(t2), percent)
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ta", "tb").mapInArrow(run, "a long, b long")


def set_prefixes(docs: DataFrame, classes: np.ndarray, words: int, percent: int) -> DataFrame:
    """k, doc_id, n, d1, d2 (digest of the set), rare (millionths of rare shingles), least (hashes), tally and prefix (hashes in order). docs: k, text, doc_id."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared.value
        for batch in batches:
            for part in slices(batch, 1):
                s, n = shingle_sets(part.column(1), words)
                ends = np.cumsum(n)
                some = n > 0
                d1, d2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                if len(s):
                    d1[some] = np.add.reduceat(mixed(s, 11), (ends - n)[some])
                    d2[some] = np.add.reduceat(mixed(s, 12), (ends - n)[some])
                tally = tallies(s, n)
                doc = np.repeat(np.arange(len(n)), n)
                c = classes[(s & np.uint64(CELLS - 1)).astype(np.int64)]
                least, rare = np.zeros((len(n), HASHES), np.int64), np.zeros(len(n), np.int64)
                if len(s):
                    least[some] = np.stack([np.minimum.reduceat(mixed(s, 1000 + i), (ends - n)[some]).view(np.int64) for i in range(HASHES)], 1)
                    rare[some] = np.add.reduceat((c == 0).astype(np.int64), (ends - n)[some]) * 1_000_000 // n[some]
                s = s[np.argsort(doc * 64 + c, kind="stable")]
                keep = n - need(n, percent) + 1
                prefix = [s[e - k : e - k + p].tobytes() if k else b"" for e, k, p in zip(ends.tolist(), n.tolist(), keep.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(rare), pa.array(list(least), pa.list_(pa.int64())), pa.array(tally, pa.binary()), pa.array(prefix, pa.binary())], ["k", "doc_id", "n", "d1", "d2", "rare", "least", "tally", "prefix"])

    return docs.select("k", "text", "doc_id").mapInArrow(run, f"k long, doc_id {kind}, n long, d1 long, d2 long, rare long, least array<long>, tally binary, prefix binary")


def bucketed(sets: DataFrame, buckets: int) -> DataFrame:
    """Postings of sets (cid, n, prefix, hubs), packed: a row for each batch of sets and bucket of hashes.

    Within a bucket 32 bits of a hash are kept. Lists that these alone make one only add candidates, which whole texts settle.
    """
    names = ["bucket", "hash", "set", "place", "cid", "n", "hubs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            raw = batch.column(2).to_pylist()
            hubs = np.array([(y or [])[: HASHES + 1] + [-1] * (HASHES + 1 - len(y or [])) for y in batch.column(3).to_pylist()], np.int64).reshape(len(batch), -1)
            h = np.frombuffer(b"".join(raw), np.uint64)
            p = np.array([len(x) // 8 for x in raw])
            at = np.repeat(np.arange(len(p)), p)
            place = np.arange(len(h)) - np.repeat(np.cumsum(p) - p, p)
            b = (h >> np.uint64(33)).astype(np.int64) % buckets
            order = np.argsort(b, kind="stable")
            cut = np.searchsorted(b[order], np.arange(buckets + 1))
            out = []
            for k in np.flatnonzero(cut[1:] > cut[:-1]):
                mine = order[cut[k] : cut[k + 1]]
                used, local = np.unique(at[mine], return_inverse=True)
                out.append((int(k), h[mine].astype(np.uint32).tobytes(), local.astype(np.uint32).tobytes(), place[mine].astype(np.uint32).tobytes(), cid[used].tobytes(), n[used].tobytes(), hubs[used].tobytes() if (hubs[used] >= 0).any() else b""))
            cols = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names)

    return sets.select("cid", "n", "prefix", "hubs").mapInArrow(run, "bucket int, hash binary, set binary, place binary, cid binary, n binary, hubs binary")


def fits(n1: np.ndarray, p1: np.ndarray, n2: np.ndarray, p2: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes n1 <= n2 that share the shingle at places p1 and p2 could link."""
    least = -(-percent * (n1 + n2) // (100 + percent))
    room = 1 + np.minimum(p1, p2) + np.minimum(n1 - p1, n2 - p2) - 1
    # the smaller set needs only the shorter prefix, as sets of its size or more share more of it
    early = p1 <= n1 - (-(-2 * percent * n1 // (100 + percent)))
    return (100 * n1 >= percent * n2) & (room >= least) & early


def block_pairs(n: np.ndarray, place: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a long list's entries, ascending by n, that could link. Blocks whose best case falls short are skipped as a whole."""
    order = np.lexsort((place, np.log(n) // 0.1))  # blocks of like size and place
    starts = np.arange(0, len(n), BLOCK)
    n_, p_, rest_ = n[order], place[order], (n - place)[order]
    least_n, most_n = np.minimum.reduceat(n_, starts), np.maximum.reduceat(n_, starts)
    most_p, most_rest = np.maximum.reduceat(p_, starts), np.maximum.reduceat(rest_, starts)
    for i in range(len(starts)):
        j = np.arange(i, len(starts))
        room = np.minimum(most_p[i], most_p[j]) + np.minimum(most_rest[i], most_rest[j])
        j = j[(room * (100 + percent) >= percent * (least_n[i] + least_n[j])) & (100 * most_n[i] >= percent * least_n[j]) & (100 * most_n[j] >= percent * least_n[i])]
        mine = order[i * BLOCK : (i + 1) * BLOCK]
        others = np.concatenate([order[k * BLOCK : (k + 1) * BLOCK] for k in j]) if len(j) else order[:0]
        a, b = np.repeat(mine, len(others)), np.tile(others, len(mine))
        new = np.repeat(np.arange(len(mine)), len(others)) + i * BLOCK < np.tile(np.concatenate([np.arange(k * BLOCK, min((k + 1) * BLOCK, len(n))) for k in j]) if len(j) else np.arange(0), len(mine))
        a, b = np.minimum(a[new], b[new]), np.maximum(a[new], b[new])
        ok = fits(n[a], place[a], n[b], place[b], percent)
        yield a[ok], b[ok]


def list_pairs(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Pairs a, b of one bucket's lists that share no hub and could link."""
    h = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["hash"]])
    at = np.concatenate([[0], np.cumsum([len(x) // 8 for x in rows["cid"]])])
    who = np.concatenate([np.frombuffer(s, np.uint32).astype(np.int64) + i for s, i in zip(rows["set"], at, strict=False)])
    ids, sizes = (np.concatenate([np.frombuffer(x, np.int64) for x in rows[c]]) for c in ("cid", "n"))
    hubs = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, HASHES + 1) if x else np.full((len(c) // 8, HASHES + 1), -1) for x, c in zip(rows["hubs"], rows["cid"], strict=True)])
    place = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["place"]]).astype(np.int64)
    order = np.lexsort((ids[who], sizes[who], h))
    h, who, place = h[order], who[order], place[order]
    n = sizes[who]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    size = np.bincount(np.cumsum(new) - 1)
    begin = np.cumsum(size) - size
    small = np.repeat((size > 1) & (size <= SHORT), size)
    found = [np.zeros((0, 2), np.int64)]

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        x, y = np.minimum(who[a], who[b]), np.maximum(who[a], who[b])
        x, y = np.unique(np.stack([x, y], 1), axis=0).T if len(x) else (x, y)
        shared = np.zeros(len(x), bool)
        for i in range(HASHES + 1):
            shared |= ((hubs[x, i] >= 0)[:, None] & (hubs[x, i][:, None] == hubs[y])).any(1)
        found.append(np.stack([x[~shared], y[~shared]], 1))

    h1, at1 = h[small], np.flatnonzero(small)
    for gap in range(1, SHORT):
        same = np.flatnonzero((h1[gap:] == h1[:-gap]) & (100 * n[at1[:-gap]] >= percent * n[at1[gap:]])) if gap < len(h1) else []
        if not len(same):
            break  # sorted by size: wider gaps only differ more
        a, b = at1[same], at1[same + gap]
        ok = fits(n[a], place[a], n[b], place[b], percent)
        keep(a[ok], b[ok])
    for k in np.flatnonzero(size > SHORT):
        i, j = int(begin[k]), int(begin[k] + size[k])
        for a, b in block_pairs(n[i:j], place[i:j], percent):
            keep(a + i, b + i)
    pairs = np.unique(np.sort(ids[np.concatenate(found)], 1), axis=0)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def sieved(docs: DataFrame, wanted: DataFrame, number: int) -> DataFrame:
    """Rows of docs whose k wanted has, and a few others by chance, without a shuffle of docs. k: hashes; number: of wanted, about."""
    bits = 1 << min(SIEVE_MOST.bit_length() - 1, max(16, (number * SIEVE_BITS).bit_length()))
    cell = F.pmod("k", F.lit(bits)) + 1
    number_, place = F.bitmap_bucket_number(cell), F.bitmap_bit_position(cell)
    maps = wanted.select(number_.alias("_map"), place.alias("_place")).groupBy("_map").agg(F.bitmap_construct_agg("_place").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    hit = F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1
    return docs.withColumn("_map", number_).join(F.broadcast(maps), "_map").where(hit).select(*docs.columns)


def dealt(pairs: DataFrame) -> DataFrame:
    """g0, a, b of the pairs a, b: those of a set with many partners have several g0."""
    counts = pairs.groupBy("a").count().select("a", F.ceil(F.col("count") / 100).cast("int").alias("parts"))
    return pairs.join(counts, "a").select(F.xxhash64("a", F.pmod(F.xxhash64("b"), "parts")).alias("g0"), "a", "b")


def compare(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """a, b, common, total (shingles), linked of each pair, from whole texts; and of pairs that are COVER percent similar, what b lacks of a
    (gone) and has beyond it (extra). pairs: g0, a, b (dealt); classes: cid, k, n; docs: k, text.

    A group gets the texts that its pairs name, each once, and holds some GROUP_SHINGLES shingles; a set with many
    partners is dealt to several groups, so none is fuller than others. Texts that no pair names are left out before the rest is shuffled.
    """
    spark = pairs.sparkSession
    need_ = pairs.select("g0", F.explode(F.array("a", "b")).alias("cid")).distinct().join(classes.select("cid", "k", "n"), "cid")
    total, number = need_.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    groups = max(shuffle_partitions(spark), math.ceil(total / GROUP_SHINGLES))
    g = F.pmod(F.xxhash64("g0"), F.lit(groups)).cast("int").alias("g")
    wanted = need_.select(g, "cid", "k").distinct()
    texts = sieved(docs.select("k", "text"), need_, number).join(wanted, "k").select("g", "cid", F.lit(None).cast("long").alias("b"), "text")
    rows = texts.unionByName(pairs.select(g, F.col("a").alias("cid"), "b", F.lit(None).cast("string").alias("text")))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        is_pair = pc.is_valid(table.column("b"))
        own = table.filter(pc.invert(is_pair))
        sets: dict[int, np.ndarray] = {}
        for batch in own.select(["cid", "text"]).to_batches():
            for part in slices(batch, 1):
                s, n = shingle_sets(part.column(1), words)
                for c, x in zip(part.column(0).to_pylist(), np.split(s, np.cumsum(n)[:-1]), strict=True):
                    sets[c] = x
        pair = table.filter(is_pair)
        a, b = pair.column("cid").to_pylist(), pair.column("b").to_pylist()
        common, union, linked, gone, extra = [], [], [], [], []
        for s, t in zip((sets[x] for x in a), (sets[y] for y in b), strict=True):
            both = np.intersect1d(s, t, assume_unique=True)
            c, u = len(both), len(s) + len(t) - len(both)
            common.append(c)
            union.append(u)
            linked.append(100 * c >= percent * u)
            near = 100 * c >= COVER * u
            gone.append(np.setdiff1d(s, both, assume_unique=True).tobytes() if near else None)
            extra.append(np.setdiff1d(t, both, assume_unique=True).tobytes() if near else None)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "common": pa.array(common, pa.int64()), "total": pa.array(union, pa.int64()), "linked": pa.array(linked, pa.bool_()), "gone": pa.array(gone, pa.binary()), "extra": pa.array(extra, pa.binary())})

    return rows.groupBy("g").applyInArrow(run, "a long, b long, common long, total long, linked boolean, gone binary, extra binary")


def hub_pairs(classes: DataFrame) -> DataFrame:
    """a (hub), b of classes that have a least hash in common and sizes that allow COVER percent of similarity. classes: cid, n, rare, least."""
    keyed = classes.select("cid", "n", "rare", F.posexplode("least").alias("i", "v"))
    hubs = keyed.groupBy("i", "v").agg(F.min(F.struct("rare", F.xxhash64("cid").alias("x"), "cid", "n")).alias("hub"), F.count(F.lit(1)).alias("sets")).where("sets > 1")
    both = keyed.join(hubs.select("i", "v", F.col("hub.cid").alias("a"), F.col("hub.n").alias("na")), ["i", "v"])
    return both.where(f"a != cid and 100 * least(n, na) >= {COVER} * greatest(n, na)").select("a", F.col("cid").alias("b")).distinct()


def derived_links(answers: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """a, b that join all sets of each hub which link with one another, from their differences to the hub alone."""
    spark = answers.sparkSession
    size = F.octet_length
    near = answers.where("gone is not null").select(F.col("a").alias("hub"), F.col("b").alias("cid"), "gone", "extra", (~F.col("linked")).alias("open"), F.floor((1 - F.col("common") / F.col("total")) * 20).cast("int").alias("far"))
    hubs = near.groupBy("hub").agg(F.count(F.lit(1)).alias("members"), F.count_if("open").alias("n_open")).where("members > 1 and n_open > 0")
    near = near.join(hubs.join(classes.select(F.col("cid").alias("hub"), F.col("n").alias("h")), "hub"), "hub")
    few = F.pmod(F.xxhash64("hub"), F.lit(shuffle_partitions(spark)))
    fields = ["tile", "side", "hub", "h", "cid", "gone", "extra", "open"]
    small = near.where(f"members <= {TILE}").withColumns({"tile": few, "side": F.lit(0)}).select(*fields)
    # large groups: blocks of like distance to the hub, and tiles of two blocks that the triangle inequality doesn't rule out
    large = near.where(f"members > {TILE}")
    sized = large.groupBy("hub", "far").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("ys"), F.ceil(F.count_if("open") / TILE).cast("int").alias("xs"))
    reach = math.ceil((100 - percent) / 5) + 1
    x, y = sized.where("xs > 0").select("hub", F.col("far").alias("fx"), "xs"), sized.select("hub", F.col("far").alias("fy"), "ys")
    met = x.join(y, "hub").where(F.abs(F.col("fx") - F.col("fy")) <= reach)
    left = large.where("open").join(met, [large["hub"] == met["hub"], large["far"] == met["fx"]]).drop(met["hub"]).withColumns({"side": F.lit(1), "i": F.pmod(F.xxhash64("cid"), "xs").cast("int"), "j": F.explode(F.expr("sequence(0, ys - 1)"))})
    right = large.join(met, [large["hub"] == met["hub"], large["far"] == met["fy"]]).drop(met["hub"]).withColumns({"side": F.lit(2), "j": F.pmod(F.xxhash64("cid"), "ys").cast("int"), "i": F.explode(F.expr("sequence(0, xs - 1)"))})
    tiled = left.select("fx", "fy", "i", "j", *fields[1:]).unionByName(right.select("fx", "fy", "i", "j", *fields[1:])).withColumn("tile", F.xxhash64("hub", "fx", "fy", "i", "j")).select(*fields)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_numpy() for c in ("side", "hub", "h", "cid", "open")}
        order = np.argsort(columns["hub"], kind="stable")
        edges = [np.zeros((0, 2), np.int64)]
        for mine in np.split(order, np.flatnonzero(np.diff(columns["hub"][order])) + 1) if len(order) else []:
            part = table.take(pa.array(mine))
            side, open_, cid = columns["side"][mine], columns["open"][mine].astype(bool), columns["cid"][mine]
            x, y = np.flatnonzero((side == 1) | ((side == 0) & open_)), np.flatnonzero(side != 1)
            if len(x) and len(y):
                edges.append(forest(cid, x, y, linked_pairs(part.column("gone").to_pylist(), part.column("extra").to_pylist(), int(columns["h"][mine[0]]), x, y, cid, percent)))
        found = np.concatenate(edges)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return small.unionByName(tiled).groupBy("tile").applyInArrow(run, "a long, b long")


def linked_pairs(gone: list[bytes], extra: list[bytes], h: int, x: np.ndarray, y: np.ndarray, cid: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of x and y whose sets link, some at a time. gone, extra: each set's differences to a hub of h shingles."""
    r, e = np.array([len(v) // 8 for v in gone]), np.array([len(v) // 8 for v in extra])
    weight = 100 * r + percent * e  # (100 + percent) * overlap of differences >= both weights - (100 - percent) * h
    items = np.frombuffer(b"".join(v for pair in zip(gone, extra, strict=True) for v in pair), np.uint64)
    owner = np.repeat(np.arange(len(r)), r + e)
    _, code, count = np.unique(items, return_inverse=True, return_counts=True)
    common = count[code] > 1
    code, owner = np.unique(code[common], return_inverse=True)[1], owner[common]
    wide = int(code.max(initial=-1)) + 1
    at = np.searchsorted(owner, np.arange(len(r) + 1))

    def dense(rows: np.ndarray, lo: int, hi: int) -> np.ndarray:
        out = np.zeros((len(rows), hi - lo), np.float32)
        for k, i in enumerate(rows):
            c = code[at[i] : at[i + 1]]
            out[k, c[(c >= lo) & (c < hi)] - lo] = 1
        return out

    for b in range(0, len(y), TILE):
        ys = y[b : b + TILE]
        for a in range(0, len(x), 256):
            xs = x[a : a + 256]
            overlap = np.zeros((len(xs), len(ys)), np.float32)
            for lo in range(0, wide, 4096):
                overlap += dense(xs, lo, min(wide, lo + 4096)) @ dense(ys, lo, min(wide, lo + 4096)).T
            hit = (100 + percent) * overlap.astype(np.int64) >= weight[xs][:, None] + weight[ys] - (100 - percent) * h
            i, j = np.nonzero(hit & (cid[xs][:, None] != cid[ys]))
            yield xs[i], ys[j]


def forest(cid: np.ndarray, x: np.ndarray, y: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Edges (a, b) that hold together what the pairs do: one for each row at most."""
    root = np.arange(len(cid))
    for i, j in pairs:
        while len(i):
            a, b = root[i], root[j]
            differ = a != b
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root != root[root]).any():
                root = root[root]
    moved = np.flatnonzero(root != np.arange(len(cid)))
    return np.stack([cid[root[moved]], cid[moved]], 1)


def similar_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Row by row k (hash of id and text), doc_id, n and class (cid); and component by cid of the classes that link.

    Null and empty texts have class null.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.xxhash64(key, text).alias("k"), F.col(text).alias("text"), F.col(key).alias("doc_id"))
    order = rarity(count_sketch(keyed.select("k", "text"), words))
    sets = written(set_prefixes(keyed, order, words, percent), "sets")
    reps = sets.where("n > 0").groupBy("d1", "d2", "n").agg(F.min(F.struct("k", "rare", "least", "tally")).alias("r"))
    classes = written(reps.select("d1", "d2", "n", "r.*", F.monotonically_increasing_id().alias("cid")), "classes")
    rows = written(sets.select("k", "doc_id", "n", "d1", "d2").join(classes.select("d1", "d2", "n", "cid"), ["d1", "d2", "n"], "left").select("k", "doc_id", "n", "cid"), "rows")
    near = written(dealt(hub_pairs(classes)), "near")
    answers = written(compare(near, classes, keyed, words, percent), "answers")
    derived = written(derived_links(answers, classes, percent), "derived")
    covered = answers.where("gone is not null").select("a", "b")
    hubs = covered.select(F.col("b").alias("cid"), F.col("a").alias("hub")).union(covered.select("a", "a")).groupBy("cid").agg(F.collect_set("hub").alias("hubs"))
    # prefixes are shuffled by k alone: that serves the join and the repeated rows
    own = sets.select("k", "prefix").join(classes.select("k", "cid", "n").join(hubs, "cid", "left"), "k").dropDuplicates(["k", "cid"])
    postings = classes.agg(F.sum(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).first()[0] or 0
    buckets = max(shuffle_partitions(spark), math.ceil(postings / BUCKET_POSTINGS))
    found = bucketed(own, buckets).groupBy("bucket").applyInPandas(lambda r: list_pairs(r, percent), "a long, b long")
    lists = written(found.distinct(), "lists")
    forget(sets)
    pairs = written(dealt(possible(lists, classes, percent)), "pairs")
    rest = written(compare(pairs, classes, keyed, words, percent).where("linked").select("a", "b"), "rest")
    links = answers.where("linked").select("a", "b").union(derived).union(rest)
    parts = written(connected_components(links), "parts")
    forget(classes, near, answers, derived, lists, pairs, rest)
    return rows, parts


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of each row.

    Two rows link when 100 * common >= percent * union of their distinct shingles. Texts of fewer words have one
    shingle, the whole; null texts and those without words have none, link with nothing and are their own component.
    Repeated rows are rows of their own. Null ids never name a component that has another id. Empty tables give no rows.
    """
    rows, parts = similar_classes(docs, key, text, words, percent)
    least = rows.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("least"))
    parted = least.join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    named = parted.join(parted.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("cid", "component_id")
    out = rows.join(named, "cid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = 80) -> DataFrame:
    """docs without all but one row of each component: that with the smallest id (null last). Rows without words stay.

    Of rows that repeat both id and text one stays. Columns keep their names and values, whatever they are called.
    """
    rows, parts = similar_classes(docs, key, text, words, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k")).alias("f")
    heads = rows.where("cid is not null").groupBy("cid").agg(first).join(parts.withColumnRenamed("node", "cid"), "cid", "left")
    chosen = heads.groupBy(F.coalesce("component", "cid").alias("component")).agg(F.min("f").alias("f")).select(F.col("f.k").alias("k"))
    bare = rows.where("cid is null").select("k").distinct()
    marked = docs.select(F.xxhash64(key, text).alias("k"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return marked.join(chosen.union(bare), "k", "left_semi").dropDuplicates(["k"]).select("row.*")
