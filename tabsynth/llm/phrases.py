"""Frequent phrases of each language, scored by how much rarer their parts are apart than together.

A task counts the windows of its texts in a burst trie: under each first word's id lies a hash container of what follows, and
one that grows large bursts into containers for each second word. When the trie is full, whole subtrees leave it as sorted runs, one for
each language and prefix partition, as rows that Spark shuffles; each partition merges its runs. Words are counted first, then pairs of
frequent words, then triples and quadruples made of frequent pairs: a phrase is never more frequent than its parts, so the
others can't reach the least count. What is frequent reaches the next pass as a bitmap of hashes of at most 2^30 bits, which lets too much
through but never too little.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsynth.llm.common import shuffle_partitions, written

#: Bits of a word's id; entries of a container before it bursts; of a trie before subtrees leave it; words that a task knows at most.
ID_BITS, BURST, ENTRIES, MOST_WORDS = 21, 4_096, 400_000, 500_000
#: Ids counted together; bytes of text for each prefix partition; bits for each phrase in a sieve, and in all, as powers of two.
BLOCK_IDS, PART_BYTES, SIEVE_BITS, MOST_BITS, CHUNK_BITS = 600_000, 8 << 20, 16, 30, 19
# fixed: what ends a piece of text (the contract's class), as one byte that UTF-8 never has
ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"\xff" * 10)
RUNS = "lang string, part int, phrases array<string>, counts array<long>"


class BurstTrie:
    """Counts of windows (first word's id, ids of up to three more in one integer)."""

    def __init__(self, burst: int = BURST):
        self.burst, self.top, self.entries = burst, {}, 0

    def _into(self, box: Counter, keys: np.ndarray) -> None:
        self.entries -= len(box)
        box.update(keys.tolist())
        self.entries += len(box)

    def _split(self, node: dict, rest: np.ndarray) -> None:
        """rest, sorted, into the containers of its second words."""
        second = rest >> (2 * ID_BITS)
        cuts = [0, *(np.flatnonzero(np.diff(second)) + 1).tolist(), len(rest)]
        tail = rest & ((1 << 2 * ID_BITS) - 1)
        for a, b in zip(cuts, cuts[1:], strict=False):
            self._into(node.setdefault(int(second[a]), Counter()), tail[a:b])

    def add(self, first: np.ndarray, rest: np.ndarray) -> None:
        if not len(first):
            return
        order = np.lexsort((rest, first))
        first, rest = first[order], rest[order]
        cuts = [0, *(np.flatnonzero(np.diff(first)) + 1).tolist(), len(first)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            word = int(first[a])
            below = self.top.get(word)
            if below is None:
                below = self.top[word] = Counter()
            if type(below) is dict:
                self._split(below, rest[a:b])
                continue
            self._into(below, rest[a:b])
            if len(below) > self.burst:
                inner: dict[int, Counter] = {}
                for key, n in below.items():
                    inner.setdefault(key >> (2 * ID_BITS), Counter())[key & ((1 << 2 * ID_BITS) - 1)] = n
                self.top[word] = inner

    def spill(self, keep: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Takes the largest subtrees out until `keep` entries are left: first words, rests and counts, in order."""
        size = {w: len(x) if isinstance(x, Counter) else sum(map(len, x.values())) for w, x in self.top.items()}
        words, seconds, boxes = [], [], []
        for w in sorted(size, key=size.get, reverse=True):
            if self.entries <= keep:
                break
            below = self.top.pop(w)
            mine = {0: below} if isinstance(below, Counter) else below
            words += [w] * len(mine)
            seconds += mine
            boxes += mine.values()
            self.entries -= size[w]
        sizes = list(map(len, boxes))
        first = np.repeat(np.array(words, np.int64), sizes)
        rest = np.fromiter(chain.from_iterable(boxes), np.int64, len(first)) + np.repeat(np.array(seconds, np.int64) << 2 * ID_BITS, sizes)
        counts = np.fromiter(chain.from_iterable(x.values() for x in boxes), np.int64, len(first))
        order = np.lexsort((rest, first))
        return first[order], rest[order], counts[order]


def joined_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order."""
    mixed = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed + (b ^ (b >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, lang_seed(lang))


@cache
def lang_seed(lang: str) -> int:
    return xxhash.xxh32_intdigest(lang)


WHOLE = (1 << 64) - 1


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mixed = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return mixed >> np.uint64(64 - bits), (mixed ^ (mixed << np.uint64(bits))) >> np.uint64(64 - bits)


class Sieve:
    """Whether a phrase may be frequent. It never denies one that is."""

    def __init__(self, bits: int, marks: np.ndarray):
        self.bits, self.marks, self.bytes = bits, marks, memoryview(marks)

    def one(self, h: int) -> bool:
        """The same for one hash, without arrays."""
        h = (h ^ h >> 31) * 0x9E3779B97F4A7C15 & WHOLE
        at = h >> 64 - self.bits
        if not self.bytes[at >> 3] >> (at & 7) & 1:
            return False
        at = ((h ^ h << self.bits) & WHOLE) >> 64 - self.bits
        return self.bytes[at >> 3] >> (at & 7) & 1 > 0

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in _places(hashes, self.bits):
            out &= self.marks[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0
        return out


def make_sieve(frequent: DataFrame, sieve_bits: int = SIEVE_BITS) -> Broadcast:
    """The sieve of a written table (lang, phrase), of some sieve_bits bits for each row and 2^30 at most. It is merged chunk by chunk before it reaches the driver."""
    spark, most = frequent.sparkSession, MOST_BITS
    bits = min(most, max(CHUNK_BITS, int(max(1, frequent.count()) * sieve_bits - 1).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, np.ndarray] = {}
        for batch in batches:
            hashes = []
            for lang, phrase in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = [word_hash(lang, w.encode()) for w in phrase.split(" ")]
                hashes.append(words)
            for size in {len(h) for h in hashes}:
                some = np.array([h for h in hashes if len(h) == size], np.uint64)
                whole = some[:, 0]
                for k in range(1, size):
                    whole = joined_hash(whole, some[:, k])
                for at in _places(whole, bits):
                    for chunk in np.unique(at >> np.uint64(CHUNK_BITS)).tolist():
                        mine = at[at >> np.uint64(CHUNK_BITS) == chunk] & np.uint64((1 << CHUNK_BITS) - 1)
                        np.bitwise_or.at(chunks.setdefault(chunk, np.zeros(1 << CHUNK_BITS - 3, np.uint8)), mine >> np.uint64(3), np.uint8(1) << (mine & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(chunks), pa.int64()), pa.array([c.tobytes() for c in chunks.values()], pa.binary())], ["chunk", "marks"])

    def either(rows: pd.DataFrame) -> pd.DataFrame:
        marks = np.zeros(1 << CHUNK_BITS - 3, np.uint8)
        for x in rows["marks"]:
            marks |= np.frombuffer(x, np.uint8)
        return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "marks": [marks.tobytes()]})

    marked = frequent.select("lang", "phrase").mapInArrow(mark, "chunk long, marks binary").groupBy("chunk").applyInPandas(either, "chunk long, marks binary")
    marks = np.zeros(1 << bits - 3, np.uint8)
    step = 1 << CHUNK_BITS - 3
    for row in marked.toLocalIterator():
        marks[row["chunk"] * step : (row["chunk"] + 1) * step] = np.frombuffer(row["marks"], np.uint8)
    return spark.sparkContext.broadcast((bits, marks))


class _Words(dict):
    """Ids of a language's words; 0 for those that no sieve lets through."""

    def __init__(self, lang: str, book: _Book):
        super().__init__({b"\xff": 0})
        self.lang, self.at, self.book = lang, len(book.of), book

    def __missing__(self, word: bytes) -> int:
        self[word] = out = self.book.number(self.lang, self.at, word)
        return out


class _Book:
    """The words that a task has met, of all languages, by their ids. Id 0 is none."""

    def __init__(self, sieve: Sieve | None):
        self.sieve, self.known = sieve, 0
        self.words, self.langs, self.hashes = [b""], array("i", [0]), array("Q", [0])
        self.of: dict[str, _Words] = {}

    def number(self, lang: str, at: int, word: bytes) -> int:
        self.known += 1
        h = word_hash(lang, word)
        if self.sieve and not self.sieve.one(h):
            return 0
        self.words.append(word)
        self.langs.append(at)
        self.hashes.append(h)
        return len(self.words) - 1

    def ids(self, lang: str, text: bytes) -> list[int]:
        if lang not in self.of:
            self.of[lang] = _Words(lang, self)
        return list(map(self.of[lang].__getitem__, text.lower().translate(ENDS).replace(b"\xff", b" \xff ").split()))

    def runs(self, first: np.ndarray, rest: np.ndarray, counts: np.ndarray, sizes: tuple[int, ...], parts: int) -> Iterator[pa.RecordBatch]:
        """Sorted runs of the phrases with so many words, from windows in order: one row for each language and prefix partition."""
        if not len(first):
            return
        mask, words, hashes = (1 << ID_BITS) - 1, pa.array(self.words, pa.binary()).cast(pa.string()), np.array(self.hashes, np.uint64)
        names, lang_at = list(self.of), np.array(self.langs)
        phrases, numbers, which, part = [], [], [], []
        for size in sizes:
            # a window also counts for its first words: what begins alike stands together
            head = rest >> ID_BITS * (4 - size)
            starts = np.flatnonzero(np.concatenate([[True], (np.diff(first) != 0) | (np.diff(head) != 0)]))
            total = np.add.reduceat(counts, starts)
            cols = [first[starts], *[(head[starts] >> ID_BITS * (size - 2 - k)) & mask for k in range(size - 1)]]
            whole = cols[-1] > 0  # shorter windows have no such word
            cols, total = [c[whole] for c in cols], total[whole]
            mixed = hashes[cols[0]]
            for c in cols[1:3]:
                mixed = joined_hash(mixed, hashes[c])
            phrases.append(pc.binary_join_element_wise(*[words.take(pa.array(c)) for c in cols], " ") if size > 1 else words.take(pa.array(cols[0])))
            numbers.append(total)
            which.append(lang_at[cols[0]])
            part.append((mixed >> np.uint64(20)) % np.uint64(parts))
        group = np.concatenate(which).astype(np.int64) * parts + np.concatenate(part).astype(np.int64)
        table = pa.table({"group": pa.array(group), "phrase": pa.concat_arrays(phrases), "n": pa.array(np.concatenate(numbers))})
        table = table.take(pc.sort_indices(table, [("group", "ascending"), ("phrase", "ascending")])).combine_chunks()
        group = table["group"].to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]]).astype(np.int32)
        at, body = group[cuts[:-1]], [table[c].combine_chunks() for c in ("phrase", "n")]
        lists = [pa.ListArray.from_arrays(pa.array(cuts), b.chunk(0) if isinstance(b, pa.ChunkedArray) else b) for b in body]
        batch = pa.RecordBatch.from_arrays([pa.array([names[k] for k in (at // parts).tolist()], pa.string()), pa.array((at % parts).astype(np.int32)), *lists], ["lang", "part", "phrases", "counts"])
        for k in range(0, len(batch), 64):
            yield batch.slice(k, 64)


def _counter(sizes: tuple[int, ...], parts: int, known: Broadcast | None, pairs: Broadcast | None, burst: int, entries: int, most_words: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieves = [Sieve(*b.value) if b else None for b in (known, pairs)]
        book, trie, held = _Book(sieves[0]), BurstTrie(burst), []
        words = np.zeros(0, np.int64)  # single words need no trie below them: counts by id

        def block() -> None:
            nonlocal words
            ids = np.array(held, np.int64)
            held.clear()
            if sizes == (1,):
                more = np.bincount(ids, minlength=len(words))
                more[: len(words)] += words
                words = more
                return
            both = (ids[:-1] > 0) & (ids[1:] > 0)
            if sizes == (2,):
                trie.add(ids[:-1][both], ids[1:][both] << 2 * ID_BITS)
                return
            at = np.flatnonzero(both)
            h = np.array(book.hashes, np.uint64)
            both[at] = sieves[1](joined_hash(h[ids[at]], h[ids[at + 1]]))
            three = np.flatnonzero(both[:-1] & both[1:])
            four = np.append(both, False)[three + 2]
            last = np.where(four, np.append(ids, 0)[three + 3], 0)
            trie.add(ids[three], ids[three + 1] << 2 * ID_BITS | ids[three + 2] << ID_BITS | last)

        def all_runs() -> Iterator[pa.RecordBatch]:
            nonlocal words
            if sizes == (1,):
                words[:1] = 0
                first = np.flatnonzero(words)
                yield from book.runs(first, np.zeros(len(first), np.int64), words[first], sizes, parts)
                words = words[:0]
            else:
                yield from book.runs(*trie.spill(), sizes, parts)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                held += book.ids(lang, text.as_py())
                held.append(0)
                if len(held) > BLOCK_IDS:
                    block()
                    if book.known > most_words or len(book.words) >> ID_BITS:
                        yield from all_runs()
                        book = _Book(sieves[0])
                    elif trie.entries > entries:
                        yield from book.runs(*trie.spill(entries // 2), sizes, parts)
        block()
        yield from all_runs()

    return count


def merge_runs(table: pa.Table, least: int) -> tuple[list[str], list[int], int]:
    """Phrases with at least `least` occurrences in all runs, their counts, and the sum of all counts. The runs are brought into one order, in which equal phrases stand together."""
    phrases = pa.concat_arrays([c.flatten() for c in table["phrases"].chunks] or [pa.array([], pa.string())])
    counts = np.concatenate([c.flatten().to_numpy() for c in table["counts"].chunks] or [np.zeros(0, np.int64)])
    if not len(counts):
        return [], [], 0
    order = pc.sort_indices(phrases)
    phrases, counts = phrases.take(order), counts[order.to_numpy()]
    starts = np.flatnonzero(np.concatenate([[True], pc.not_equal(phrases[1:], phrases[:-1]).to_numpy(zero_copy_only=False)]))
    sums = np.add.reduceat(counts, starts)
    keep = np.flatnonzero(sums >= least)
    return phrases.take(pa.array(starts[keep])).to_pylist(), sums[keep].tolist(), int(counts.sum())


def _frequent(docs: DataFrame, sizes: tuple[int, ...], parts: int, least: int, words: Broadcast | None = None, pairs: Broadcast | None = None, **limits: int) -> DataFrame:
    """lang, phrase, f of phrases that occur least times. A null phrase has the sum of all counts of a prefix partition."""
    runs = docs.mapInArrow(_counter(sizes, parts, words, pairs, **limits), RUNS)

    def merge(table: pa.Table) -> pa.Table:
        found, numbers, total = merge_runs(table, least)
        lang = table["lang"][0].as_py()
        return pa.table({"lang": pa.array([lang] * (len(found) + 1), pa.string()), "phrase": pa.array([None, *found], pa.string()), "f": pa.array([total, *numbers], pa.int64())})

    return written(runs.groupBy("lang", "part").applyInArrow(merge, "lang string, phrase string, f long"), f"phrases-{sizes[0]}")


def frequent_phrases(docs: DataFrame, least: int = 30, text: str = "text", group: str = "lang", part_bytes: int = PART_BYTES, sieve_bits: int = SIEVE_BITS, burst: int = BURST, entries: int = ENTRIES, most_words: int = MOST_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases of 1 to 4 words that occur at least `least` times in their language; (lang, n): all words."""
    rows = docs.select(F.coalesce(F.col(group).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, min(shuffle_partitions(docs.sparkSession), size // 50_000), size // part_bytes)
    limits = {"burst": burst, "entries": entries, "most_words": most_words}
    ones = _frequent(rows, (1,), parts, least, **limits)
    known = make_sieve(ones.where("phrase is not null"), sieve_bits)
    twos = _frequent(rows, (2,), parts, least, known, **limits)
    more = _frequent(rows, (3, 4), parts, least, known, make_sieve(twos.where("phrase is not null"), sieve_bits), **limits)
    return ones.unionByName(twos).unionByName(more).where("phrase is not null"), ones.where("phrase is null").groupBy("lang").agg(F.sum("f").alias("n"))


def _part(words: Column, start: int | Column, length: int | Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def mine_phrases(docs: DataFrame, least: int = 30, top: int = 2000, cover: int = 80, rank_rows: int = 100_000, **counting) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of 2 to 4 words.

    a: the phrase's occurrences; l, r: those of its two parts at the cut that scores least, floor(2000000 a / (l + r)); n: all
    words of the language. A phrase inside a longer frequent one that has `cover` percent of its occurrences is left out. Null languages
    are `und`; null texts have no words; repeated rows count each; a language without frequent phrases has no rows; other
    columns are left out. Words and texts may have any length.
    """
    found, totals = frequent_phrases(docs, least, **counting)
    words = F.split("phrase", " ")
    phrases = written(found.where(F.size(words) > 1).withColumn("words", words), "candidates")
    # each way to cut a phrase in two; both parts are frequent
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.col("words"), 1, F.col("k")).alias("left"), _part(F.col("words"), F.col("k") + 1, F.size("words")).alias("right"))
    for side, n in (("left", "l"), ("right", "r")):
        cuts = cuts.join(found.select("lang", F.col("phrase").alias(side), F.col("f").alias(n)), ["lang", side])
    big = lambda c: F.col(c).cast("decimal(20,0)")  # noqa: E731 - products may pass 64 bits
    cuts = cuts.withColumns({"twice": F.lit(2_000_000).cast("decimal(7,0)") * big("a"), "apart": big("l") + big("r")}).withColumn("score", F.expr("cast(twice div apart as bigint)"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"), F.first("a").alias("a"))
    # the most occurrences of a longer phrase around each phrase
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("words") - m + 1), lambda s: _part(F.col("words"), s, m))))
    around = phrases.where(F.size("words") > 2).select("lang", F.explode(spans).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(around, ["lang", "phrase"], "left").where(F.coalesce(F.lit(100) * big("longer") < F.lit(cover) * big("a"), F.lit(True)))
    kept = written(kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score"), "scored")
    # a language's first ones are among the first of its parts
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    dealt = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(max(1, kept.count() // rank_rows))))
    few = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
