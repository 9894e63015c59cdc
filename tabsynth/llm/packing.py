"""Best-fit packing of documents into sequences of bounded length, certified by lower bounds.

Pieces are dealt to groups of bounded size, and each group is packed best-fit decreasing. Dual feasible
functions give a lower bound of each group's sequence count. A group at its bound is done. The others give up
their looser sequences, exchange those pieces in regrouped rounds and are packed again, as long as that saves
sequences.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsynth.llm.common import shuffle_partitions, written

PIECE = "doc_id {key}, piece int, start long, length long, ids_crc32 long"


def best_fit_decreasing(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, and the number of bins. Ties keep their order."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(room + 1)]  # bins by the room they have left
    have, used = 0, 0  # have: bit r is set if a bin has r left
    for i in order.tolist():
        need = int(lengths[i])
        fitting = have >> need
        if fitting:
            left = need + (fitting & -fitting).bit_length() - 1
            b = free[left].pop()
            if not free[left]:
                have &= ~(1 << left)
        else:
            left, b, used = room, used, used + 1
        bins[i], offsets[i] = b, room - left
        if rest := left - need:
            free[rest].append(b)
            have |= 1 << rest
    return bins, offsets, used


def lower_bound(lengths: np.ndarray, room: int) -> int:
    """A number of bins that no packing goes below: the best of three families of dual feasible functions."""
    if not len(lengths):
        return 0
    sizes, counts = np.unique(lengths.astype(np.int64), return_counts=True)
    best = -(-int(sizes @ counts) // room)
    for cut in np.unique(np.minimum(sizes, room - sizes)[np.minimum(sizes, room - sizes) > 0]):  # large ones fill a bin, small ones are left out
        value = np.where(sizes > room - cut, room, np.where(sizes < cut, 0, sizes))
        best = max(best, -(-int(value @ counts) // room))
    for k in range(1, 33):  # staircase: sizes rounded to multiples of room / k
        whole = (k + 1) * sizes % room == 0
        value = np.where(whole, sizes * k, (k + 1) * sizes // room * room)  # in units of 1 / k
        best = max(best, -(-int(value @ counts) // (room * k)))
    for cut in np.unique(sizes[sizes * 2 <= room]):  # items counted in units of `cut`
        most = room // cut
        value = np.where(sizes * 2 > room, 2 * (most - (room - sizes) // cut), np.where(sizes * 2 == room, most, 2 * (sizes // cut)))
        best = max(best, -(-int(value @ counts) // int(2 * most)))
    return best


def cut_documents(docs: DataFrame, tokenizer: str, room: int = 4096, end_id: int = 1, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for) of each document's pieces of at most room ids."""
    schema = PIECE.format(key=docs.schema[key].dataType.simpleString()) + ", ids binary" * keep_ids
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tabsynth.llm.wordbpe import word_ids

        encode = word_ids(tokenizer).encode
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                rows, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, x in enumerate(encode(part.column(1).to_pylist())):
                    x += end
                    for k in range(0, len(x), 4 * room):
                        body = x[k : k + 4 * room]
                        rows.append(i)
                        piece.append(k // (4 * room))
                        start.append(k // 4)
                        length.append(len(body) // 4)
                        crc.append(zlib.crc32(body))
                        ids.append(body)
                cols = [part.column(0).take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.binary())] * keep_ids, names + ["ids"] * keep_ids)

    return docs.select(key, text).mapInArrow(run, schema)


def pack_lengths(pieces: DataFrame, room: int = 4096, group_rows: int = 20_000, rounds: int = 3) -> DataFrame:
    """pieces, which have a column length (1 to room), with sequence_id, offset and certified.

    certified: the sequence belongs to a group whose count of sequences equals its lower bound. A piece of length
    room is a sequence of its own, with a negative id. A group holds some group_rows pieces, so neither its memory nor its
    time grows with the input; groups are dealt by a hash of the row and of its place in the input, so rows that are equal spread over all of
    them. pieces is read more than once: pass a written table. Column names sequence_id, offset, certified, _g, _r are taken.
    """
    spark = pieces.sparkSession
    full = pieces.where(F.col("length") == room).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "certified": F.lit(True)})
    rest = pieces.where(F.col("length") < room)
    count = rest.count()
    if not count:
        return full
    groups = max(math.ceil(count / group_rows), min(2 * shuffle_partitions(spark), math.ceil(count / (group_rows // 10))))
    open_ = rest.withColumns({"_g": F.pmod(F.xxhash64(*rest.columns, F.monotonically_increasing_id()), F.lit(groups)), "sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long"), "certified": F.lit(False), "_r": F.lit(False)})
    closed = []
    for turn in range(rounds + 1):
        tried = written(open_.groupBy("_g").applyInPandas(_packer(room, turn), open_.schema), "packed")
        closed.append(tried.where("not _r"))
        loose = tried.where("_r")
        released = loose.count() if turn < rounds else 0
        merged = max(1, groups // 4, math.ceil(released / (2 * group_rows)))
        if not released or (merged >= groups and turn):
            closed.append(loose)
            break
        groups = merged
        # whole sequences move together, and to where the released ones of other groups come as well
        open_ = loose.withColumn("_g", F.pmod(F.xxhash64("_g", F.lit(turn)), F.lit(groups)))
    out = full
    for part in closed:
        out = out.unionByName(part.select(*out.columns))
    return out


def _packer(room: int, turn: int):
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        order = [c for c in ("doc_id", "piece", "ids_crc32") if c in rows]
        rows = rows.sort_values(["length", *order], ascending=[False] + [True] * len(order), kind="stable").reset_index(drop=True)
        lengths = rows["length"].to_numpy(np.int64)
        bins, offsets, used = best_fit_decreasing(lengths, room)
        bound = lower_bound(lengths, room)
        before = rows["sequence_id"].nunique() if turn else used + 1
        if used < before:  # else what they were in stays
            rows["sequence_id"] = (np.int64(turn) << 58) + (np.int64(key[0]) << 24) + bins
            rows["offset"] = offsets
        else:
            used = before
        rows["certified"] = used == bound
        rows["_r"] = False
        if used > bound or turn == 0:
            # the loosest sequences could be repacked: those with the most room, twice as many as the gap at least
            fill = rows.groupby("sequence_id")["length"].sum().sort_values(kind="stable")
            gap = used - bound
            give = fill.index[: max(1, 4 * gap, int((fill < room * 0.98).sum()) if gap else 1)]
            rows["_r"] = rows["sequence_id"].isin(give)
        return rows

    return pack


def pack_documents(docs: DataFrame, tokenizer: str, room: int = 4096, end_id: int = 1, key: str = "doc_id", text: str = "text", **packing) -> DataFrame:
    """Each piece's doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified.

    A null or empty text is one piece of the end id alone. Repeated rows are packed each, and a null doc_id like any
    other. Other columns of docs are left out. Empty tables give no rows.
    """
    return pack_lengths(written(cut_documents(docs, tokenizer, room, end_id, key, text), "pieces"), room, **packing).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")
