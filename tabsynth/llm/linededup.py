"""Substring deduplication by hashing lines, paragraphs or clauses.

Each text is cut into units, each unit is normalised and hashed, digests are grouped over the whole corpus, and of units
with equal digests the earliest ranked stays. The others are removed; what is removed and what is kept is
recorded by offsets into the original text.

A line or paragraph that holds a repeated passage only in part differs as a whole, so the finest unit is the clause: passages that begin and end
within lines still share their inner clauses. A unit of few words repeats by chance; its digest therefore covers its neighbours too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsynth.llm.common import shuffle_partitions

#: Where a unit ends. What separates it from the next one belongs to it.
ENDS = {"line": r"\n[\x20\x09-\x0D]*", "paragraph": r"\n[\x20\x09\x0B-\x0D]*\n[\x20\x09-\x0D]*", "clause": r"[.!?,;:][\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*"}
#: Units of fewer words are hashed with their neighbours. Clauses are short, so they need more.
MIN_WORDS, CLAUSE_WORDS = 4, 8
SPANS = "array<struct<start:int,stop:int>>"
#: Bytes of text whose units one group holds, about, and those of which one row of packed units is made.
GROUP_BYTES, PACK_BYTES = 48 << 20, 4 << 20


def spans_of(text: str, cut: re.Pattern) -> list[tuple[int, int]]:
    """Start and stop (code points) of each piece; together they are the text."""
    edges = [0, *(m.end() for m in cut.finditer(text)), len(text)]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b]


def units_of(text: str, cut: re.Pattern, min_words: int = MIN_WORDS) -> list[tuple[int, bytes]]:
    """Place and digest of each piece with a word. Case of A-Z and the kind and amount of ASCII white space don't count.

    The digest of a unit of fewer than min_words words covers the fewest units before it, and where those don't suffice
    after it, that make so many words; and which of them it is.
    """
    found = []
    for n, (a, b) in enumerate(spans_of(text, cut)):
        if words := text[a:b].encode().lower().split():
            found.append((n, len(words), b" ".join(words)))
    out = []
    for i, (n, size, norm) in enumerate(found):
        if size < min_words:
            j = k = i
            while size < min_words and j > 0:
                j -= 1
                size += found[j][1]
            while size < min_words and k < len(found) - 1:
                k += 1
                size += found[k][1]
            norm = b"\n".join([b"%d" % (i - j), *(x[2] for x in found[j : k + 1])])
        out.append((n, hashlib.md5(norm, usedforsecurity=False).digest()))
    return out


def ranks(ids: pa.Array, texts: np.ndarray) -> np.ndarray:
    """Rank of each document by id (null last), then hash of its text; equal ones have equal ranks."""
    both = pa.table({"id": ids, "t": texts})
    order = pc.sort_indices(both, sort_keys=[("id", "ascending"), ("t", "ascending")], null_placement="at_end").to_numpy()
    code = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)[order]
    step = np.zeros(len(order), np.int64)
    step[1:] = (code[1:] != code[:-1]) | (texts[order][1:] != texts[order][:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(step)
    return out


def later(digest: np.ndarray, rank: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first unit of each digest, and the units that are neither it nor the same unit of the same document."""
    order = np.lexsort((place, rank, digest[:, 1], digest[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (digest[order][1:] != digest[order][:-1]).any(1)
    first = order[new][np.cumsum(new) - 1]
    same = (rank[order] == rank[first]) & (place[order] == place[first])
    return order[new], order[~same]


def packed_units(docs: DataFrame, cut: str, min_words: int, groups: int) -> DataFrame:
    """Units, packed: a row for each few MB of text and group of digests. docs: doc_id, t, text.

    Of units with equal digests in the same few MB only the first is sent to its digest's group: so a group has a very
    frequent unit as often as there are such parts of the input, not as often as it occurs. The others are known to go, and are
    dealt by their documents (at, place).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["group", "ids", "texts", "digest", "unit_of", "unit", "gone_of", "gone"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(cut)
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False))
            edges = np.flatnonzero(np.diff(size // PACK_BYTES, prepend=0)).tolist()
            for lo, hi in zip([0, *edges], [*edges, len(batch)], strict=True):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                rank = ranks(part.column(0), part.column(1).to_numpy(zero_copy_only=False))
                _, kept = np.unique(rank, return_index=True)  # of equal rows one
                part, rank = part.take(pa.array(kept)), rank[kept]
                doc, place, digest = [], [], []
                for i, x in enumerate(part.column(2).to_pylist()):
                    for n, h in units_of(x or "", pattern, min_words):
                        doc.append(i)
                        place.append(n)
                        digest.append(h)
                if not doc:
                    continue
                doc, place, digest = np.array(doc), np.array(place), np.frombuffer(b"".join(digest), np.uint64).reshape(-1, 2)
                first, gone = later(digest, rank[doc], place)
                t = part.column(1).to_numpy(zero_copy_only=False)
                key = np.concatenate([digest[first, 0] >> np.uint64(20), t[doc[gone]].view(np.uint64) >> np.uint64(20)]) % np.uint64(groups)
                which = np.concatenate([first, gone])
                order = np.argsort(key, kind="stable")
                out = []
                for mine in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
                    used, local = np.unique(doc[which[mine]], return_inverse=True)
                    sent = mine < len(first)
                    a, b = which[mine[sent]], which[mine[~sent]]
                    out.append((int(key[mine[0]]), part.column(0).take(pa.array(used)), t[used].tobytes(), digest[a].tobytes(), local[sent].astype(np.uint32).tobytes(), place[a].astype(np.uint32).tobytes(), local[~sent].astype(np.uint32).tobytes(), place[b].astype(np.uint32).tobytes()))
                cols = list(zip(*out, strict=True))
                lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, cols[1])]).astype(np.int32), pa.concat_arrays(cols[1]))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), lists, *[pa.array(c, pa.binary()) for c in cols[2:]]], names)

    return docs.select("doc_id", "t", "text").mapInArrow(run, f"group int, ids array<{kind}>, texts binary, digest binary, unit_of binary, unit binary, gone_of binary, gone binary")


def repeated_units(units: DataFrame) -> DataFrame:
    """doc_id, t and places (packed) of units that aren't the first of their digest. units: packed_units.

    Rank: doc_id (null last), hash of the text, place. A document has a row for each group that holds such a unit of it.
    """
    kind = units.schema["ids"].dataType.elementType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        raw = {c: table.column(c).to_pylist() for c in table.column_names if c not in ("group", "ids")}
        join = lambda c, kind: np.frombuffer(b"".join(raw[c]), kind)
        ids, t = pc.list_flatten(table.column("ids")).combine_chunks(), join("texts", np.int64)
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        rank, base = ranks(ids, t), np.cumsum([0, *(len(x) // 8 for x in raw["texts"])])[:-1]
        of = lambda c: join(c, np.uint32).astype(np.int64) + np.repeat(base, [len(x) // 4 for x in raw[c]])
        doc, place = of("unit_of"), join("unit", np.uint32)
        gone = later(join("digest", np.uint64).reshape(-1, 2), rank[doc], place)[1]
        doc, place = np.concatenate([doc[gone], of("gone_of")]), np.concatenate([place[gone], join("gone", np.uint32)])
        order = np.argsort(rank[doc], kind="stable")
        starts = np.flatnonzero(np.diff(rank[doc][order], prepend=-1))
        places = [x.astype("<u4").tobytes() for x in np.split(place[order], starts[1:])] if len(order) else []
        head = doc[order][starts]
        return pa.table({"doc_id": ids.take(pa.array(head)), "t": pa.array(t[head]), "places": pa.array(places, pa.binary())})

    return units.groupBy("group").applyInArrow(run, f"doc_id {kind}, t long, places binary")


def without(text: str, cut: re.Pattern, places: set[int]) -> tuple[str, list[dict], list[dict]]:
    """The text without the units at places, and the offsets of what went and of what is kept. If the text's end went, what is kept ends without white space."""
    spans = spans_of(text, cut)
    gone, kept = [], []
    for n, (a, b) in enumerate(spans):
        if n in places:
            gone.append({"start": a, "stop": b})
        elif kept and kept[-1]["stop"] == a:
            kept[-1]["stop"] = b
        else:
            kept.append({"start": a, "stop": b})
    if len(spans) - 1 in places:
        while kept:
            kept[-1]["stop"] = kept[-1]["start"] + len(text[kept[-1]["start"] : kept[-1]["stop"]].rstrip(" \t\n\v\f\r"))
            if kept[-1]["stop"] > kept[-1]["start"]:
                break
            kept.pop()
    return "".join(text[k["start"] : k["stop"]] for k in kept), gone, kept


def drop_repeated_units(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "line", min_words: int | None = None) -> DataFrame:
    """docs with text cleaned, and n_removed, removed, kept_spans: offsets (code points) into the original text.

    All of a unit's occurrences count, also within a text. unit: line, paragraph or clause (ends at . ! ? , ; : before white
    space, or at a line's end). Null texts stay null and empty ones empty, with nothing removed. Rows
    that repeat both doc_id and text are one document: each gets the same cleaned text. A null doc_id ranks last.
    Columns of docs named n_removed, removed, kept_spans are replaced, all others stay, whatever they are called.
    """
    out = [c for c in docs.columns if c not in ("n_removed", "removed", "kept_spans")]
    cut, spark = ENDS[unit], docs.sparkSession
    min_words = min_words or (CLAUSE_WORDS if unit == "clause" else MIN_WORDS)
    others = [F.col(f"`{c}`") for c in out if c not in (key, text)] or [F.lit(1)]
    marked = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("t"), F.col(text).alias("text"), F.struct(*others).alias("row"))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    groups = max(shuffle_partitions(spark), -(-total // GROUP_BYTES))
    gone = repeated_units(packed_units(marked, cut, min_words, groups)).groupBy("doc_id", "t").agg(F.collect_list("places").alias("places"))
    gone = gone.withColumnsRenamed({"doc_id": "gone_id", "t": "gone_t"})
    joined = marked.join(gone, marked["doc_id"].eqNullSafe(gone["gone_id"]) & (marked["t"] == gone["gone_t"]), "left").select("doc_id", "row", "text", "places")
    pair = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(cut)
        for batch in batches:
            done = []
            for x, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if x is None or not p:
                    done.append((x, [], [{"start": 0, "stop": len(x)}] if x else []))
                else:
                    done.append(without(x, pattern, set(np.frombuffer(b"".join(p), "<u4").tolist())))
            cols = [batch.column(0), batch.column(1), pa.array([d[0] for d in done], pa.string()), pa.array([len(d[1]) for d in done], pa.int64()), pa.array([d[1] for d in done], pair), pa.array([d[2] for d in done], pair)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row", "text", "n_removed", "removed", "kept_spans"])

    kind, row = (joined.schema[c].dataType.simpleString() for c in ("doc_id", "row"))
    row = "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in joined.schema["row"].dataType) + ">"
    cleaned = joined.mapInArrow(run, f"doc_id {kind}, row {row}, text string, n_removed long, removed {SPANS}, kept_spans {SPANS}")
    place = {key: F.col("doc_id"), text: F.col("text")}
    return cleaned.select(*[place.get(c, F.col(f"row.`{c}`")).alias(c) for c in out], "n_removed", "removed", "kept_spans")
