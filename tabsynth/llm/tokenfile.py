"""Token ids in files from which any token can be read alone.

Ids are kept in directly addressable codes: each id is cut into chunks, the first chunks of all ids stand side by side in
the first level, the second chunks of the ids that have one in the second, and so on. A bitmap for each level says which ids go on, and
a rank directory over it says where in the next level. The chunks' widths are those that make the segment smallest.

A file is one range of documents in ascending order of their ids, as a row of segments; each has some SEGMENT_IDS ids of whole documents
and can be read without the others. Spark's text sink writes the files, whose bytes are this format's own, and its
binary source reads them, so any store that Spark reaches can hold them.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsynth.llm.common import shared_path, shuffle_partitions, written
from tabsynth.ordered import running_sums

#: Ids of a segment, about; bytes of text in a file, about; bits between two entries of a rank directory; bits of a chunk at most.
SEGMENT_IDS, FILE_BYTES, RANK_BITS, MOST_BITS = 2_000_000, 64 << 20, 512, 16
MAGIC = b"DACs"
HEAD = struct.Struct("<4sQIIQIB")  # magic, bytes of the segment, file, segment, ids, documents, levels
LEVEL = struct.Struct("<BQ")  # width, chunks


def chunk_widths(ids: np.ndarray) -> list[int]:
    """The widths of the levels that take the fewest bits, bitmaps and directories included."""
    if not len(ids):
        return [1]
    most = max(1, int(ids.max()).bit_length())
    beyond = [len(ids), *[int(np.count_nonzero(ids >> np.uint32(k))) for k in range(1, most)]]
    mark = 1 + 32 / RANK_BITS
    best: dict[int, tuple[float, list[int]]] = {most: (0.0, [])}
    for at in range(most - 1, -1, -1):
        ways = []
        for width in range(1, min(MOST_BITS, most - at) + 1):
            rest, widths = best[at + width]
            ways.append((beyond[at] * (width + mark * (at + width < most)) + rest, [width, *widths]))
        best[at] = min(ways)
    return best[0][1]


def _packed(values: np.ndarray, width: int) -> bytes:
    bits = np.unpackbits(values.astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)[:, 16 - width :]
    return np.packbits(bits.reshape(-1)).tobytes()


def segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, file: int = 0, number: int = 0) -> bytes:
    """The documents' ids (unsigned 32-bit, one document after the other) as one segment."""
    widths = chunk_widths(ids)
    known = np.array([k is not None for k in doc_ids], np.uint8)
    body = [known.tobytes(), np.array([k or 0 for k in doc_ids], "<i8").tobytes(), np.array(lengths, "<u4").tobytes()]
    rest = ids
    for k, width in enumerate(widths):
        body += [LEVEL.pack(width, len(rest)), _packed(rest & np.uint32((1 << width) - 1), width)]
        if k + 1 < len(widths):
            rest = rest >> np.uint32(width)
            goes_on = rest > 0
            counts = np.add.reduceat(goes_on, np.arange(0, len(goes_on), RANK_BITS)) if len(goes_on) else np.zeros(0, np.int64)
            body += [np.packbits(goes_on).tobytes(), np.concatenate([[0], np.cumsum(counts)]).astype("<u4").tobytes()]
            rest = rest[goes_on]
    out = b"".join(body)
    return HEAD.pack(MAGIC, HEAD.size + len(out), file, number, len(ids), len(doc_ids), len(widths)) + out


class Segment:
    """Reads a segment in place. segment[i] is one id; slice(a, b) are some; none of it decodes what it isn't asked for."""

    def __init__(self, data: memoryview):
        magic, self.size, self.file, self.number, self.n_ids, self.n_docs, levels = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        known, keys = take("u1", self.n_docs), take("<i8", self.n_docs)
        self.doc_ids = [int(k) if x else None for k, x in zip(keys, known, strict=True)]
        self.starts = np.concatenate([[0], np.cumsum(take("<u4", self.n_docs), dtype=np.int64)])
        self.levels = []
        for k in range(levels):
            width, count = LEVEL.unpack_from(data, at)
            at += LEVEL.size
            chunks = take("u1", -(-width * count // 8))
            last = k + 1 == levels
            self.levels.append((width, chunks, None if last else take("u1", -(-count // 8)), None if last else take("<u4", -(-count // RANK_BITS) + 1)))

    @staticmethod
    def _bits(data: np.ndarray, a: int, b: int) -> np.ndarray:
        return np.unpackbits(data[a // 8 : -(-b // 8)])[a % 8 : a % 8 + b - a]

    def _rank(self, level: int, i: int) -> int:
        """How many of a level's first i ids go on."""
        _, _, marks, directory = self.levels[level]
        block = i // RANK_BITS
        return int(directory[block]) + int(self._bits(marks, block * RANK_BITS, i).sum())

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        out = shift = 0
        for level, (width, chunks, marks, _) in enumerate(self.levels):
            bits = int.from_bytes(chunks[i * width // 8 : -(-(i + 1) * width // 8)].tobytes(), "big")
            out |= (bits >> (-(i + 1) * width) % 8 & (1 << width) - 1) << shift
            shift += width
            if marks is None or not marks[i // 8] >> (7 - i % 8) & 1:
                return out
            i = self._rank(level, i)
        return out

    def slice(self, a: int, b: int) -> np.ndarray:
        """Ids a to b. In each level they, or those of them that reach it, stand side by side."""
        out, where, shift = np.zeros(b - a, np.uint32), np.arange(b - a), 0
        for level, (width, chunks, marks, _) in enumerate(self.levels):
            if a == b:
                break
            bits = self._bits(chunks, a * width, b * width).reshape(-1, width)
            out[where] |= (bits @ (1 << np.arange(width - 1, -1, -1, dtype=np.uint32))).astype(np.uint32) << np.uint32(shift)
            shift += width
            if marks is None:
                break
            where = where[self._bits(marks, a, b) > 0]
            a = self._rank(level, a)
            b = a + len(where)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.starts[k]), int(self.starts[k + 1]))


def segments(content: bytes) -> Iterator[Segment]:
    """A file's segments. The sink puts a line feed after each."""
    at = 0
    while at < len(content):
        found = Segment(memoryview(content)[at:])
        yield found
        at += found.size + 1


# fixed: the white space that the tokenizer's own pattern knows (Unicode's White_Space)
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
MAX_UNITS, JOINED = 900_000, 64


class _Known(dict):
    """Ids by key. Keys that aren't there are noted."""

    def __init__(self):
        super().__init__()
        self.missed: list[str] = []

    def __missing__(self, key: str) -> None:
        self.missed.append(key)


class ByteIds:
    """Ids of a byte-level tokenizer, with what a worker has already encoded kept.

    The tokenizer's pattern never matches across the end of a run of other characters than white space. So a text's units,
    white space and the run after it, are encoded each on its own; they repeat, and only new ones reach the tokenizer. Most
    units are a space and a word, so a word is the key of that unit; a line feed and a word is its own key, and any other unit has a
    carriage return before it. A text whose white space is single spaces and line feeds is cut into keys at its spaces.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.units = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+").findall
        self.simple = re.compile(f"[^{SPACES}]+").fullmatch
        self.rare_space = re.compile(f"[{SPACES.replace(' ', '')}]").search
        self.line = array("I", self._ids("\n")).tobytes()
        self.joins = array("I", self._ids("a\n b\nc")).tobytes() == b"".join(array("I", self._ids(x)).tobytes() for x in ("a", "\n", " b", "\n", "c")) and len(self.line) == 4
        self.marks = {c: array("I", self._ids(c)).tobytes() for c in ".,;:!?"}
        self.known = _Known()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _keys(self, text: str) -> list[str]:
        plain = not ("  " in text or "\n " in text or " \n" in text or "\n\n" in text or "\t" in text or "\r" in text or "\x0b" in text or "\x0c" in text)
        if plain and (text.isascii() or not self.rare_space(text.replace("\n", ""))):
            return ("\r" + text.replace("\n", " \n")).split(" ")
        return [u[1:] if u[0] == " " and self.simple(u[1:]) else u if u[0] == "\n" and self.simple(u[1:]) else "\r" + u for u in self.units(text)]

    def _new(self, keys: set[str]) -> dict[str, bytes]:
        """Ids of unknown keys. A mark after a letter is a piece of its own, and so is a line feed before a word: the rest may be known, and is encoded once for all."""
        known, marks, parts, todo = self.known, self.marks, {}, set()
        for k in keys:
            core, after, before = k, b"", b""
            if k[-1:] in marks and k[-2:-1].isalpha():
                core, after = k[:-1], marks[k[-1]]
            if core[:1] == "\n" and len(core) > 1:
                core, before = "\r" + core[1:], self.line
            if core not in known:
                todo.add(core)
            parts[k] = before, core, after
        out = self._encoded(list(todo))
        out.update([(k, before + (out[core] if core in out else known[core]) + after) for k, (before, core, after) in parts.items()])
        return out

    def _encoded(self, keys: list[str]) -> dict[str, bytes]:
        """A line feed between two units without one is a token of its own, so many go in one call."""
        units = {k: k[1:] if k[:1] == "\r" else k if k[:1] == "\n" else " " + k for k in keys}
        simple = [k for k in keys if self.simple(k if k[:1] not in "\r\n" else k[1:])] if self.joins else []
        simple = [k for k in simple if k[:1] != "\n"]
        out = {}
        parts = [simple[k : k + JOINED] for k in range(0, len(simple), JOINED)]
        for part, coded in zip(parts, self.tokenizer.encode_batch_fast(["\n".join([units[k] for k in p]) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(coded.ids, "<u4")
            cuts = np.flatnonzero(ids == np.frombuffer(self.line, "<u4")[0])
            if len(cuts) == len(part) - 1:
                data, ends = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
                start = 0
                for k, end in zip(part, ends, strict=True):
                    out[k] = data[start:end]
                    start = end + 4
        rest = [k for k in keys if k not in out]
        out.update((k, array("I", c.ids).tobytes()) for k, c in zip(rest, self.tokenizer.encode_batch_fast([units[k] for k in rest], add_special_tokens=False), strict=True))
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null is empty."""
        gc.disable()  # many tuples and lists come and go here, none of them in a cycle
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        known, out, again = self.known, [], []
        known.missed = missed = []
        look = known.__getitem__
        for x in texts:
            before, keys = len(missed), self._keys(x) if x else []
            found = list(map(look, keys))
            if len(missed) > before:
                again.append((len(out), keys, found))
                out.append(b"")
            else:
                out.append(b"".join(found))
        if missed:
            new = self._new(set(missed))
            for i, keys, found in again:
                out[i] = b"".join([new[k] if x is None else x for k, x in zip(keys, found, strict=True)])
            if len(known) < MAX_UNITS:  # the first ones are kept: frequent ones come early
                known.update(new)
        return out


_made: dict[str, ByteIds] = {}


def byte_ids(path: str) -> ByteIds:
    """The worker's tokenizer; made once for each worker."""
    if path not in _made:
        _made[path] = ByteIds(path)
    return _made[path]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text", segment_ids: int = SEGMENT_IDS, file_bytes: int = FILE_BYTES) -> None:
    """Writes the ids of all documents, each with the end id, in ascending order of the key, one file for each range of keys.

    A null key comes first; a null or empty text is the end id alone. Rows with one key are ordered by their texts' CRC and their
    place in the table, which also cut them into ranges, so a key that many rows share doesn't make one task. A document's ids are in one segment.
    """
    total = docs.agg(F.sum(F.octet_length(text)).alias("bytes"), F.count("*").alias("rows")).first()
    files = max(min(total["rows"], 2 * shuffle_partitions(docs.sparkSession)), -(-(total["bytes"] or 0) // file_bytes), 1)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.crc32(F.col(text).cast("binary")).alias("crc"), F.monotonically_increasing_id().alias("at"))
    end = end_id.to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, file, number = byte_ids(tokenizer), TaskContext.get().partitionId(), 0
        keys, parts, held = [], [], 0

        def done() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            return pa.RecordBatch.from_arrays([pa.array([segment(keys, [len(x) // 4 for x in parts], ids, file, number)], pa.binary())], ["value"])

        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                for k, x in zip(part.column(0).to_pylist(), coder.encode(part.column(1).to_pylist()), strict=True):
                    x += end
                    if keys and held + len(x) > 4 * segment_ids:
                        yield done()
                        keys, parts, held, number = [], [], 0, number + 1
                    keys.append(k)
                    parts.append(x)
                    held += len(x)
        if keys:
            yield done()

    by = ["doc_id", "crc", "at"]
    dealt = rows.repartitionByRange(files, *by).sortWithinPartitions(*by).select("doc_id", "text")
    dealt.mapInArrow(encode, "value binary").select(F.col("value").cast("string")).write.option("compression", "none").text(path)


def read_token_files(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids, if asked for) of each document in the files. start: ids of all documents before it."""
    schema = "doc_id long, at long, first long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for found in segments(content.as_buffer()):
                    bodies = [found.document(k).astype("<u4").tobytes() for k in range(found.n_docs)]
                    n = np.diff(found.starts)
                    at = np.full(found.n_docs, (found.file << 24) + found.number)
                    cols = [pa.array(found.doc_ids, pa.int64()), pa.array(at), pa.array(found.starts[:-1]), pa.array(n), pa.array([zlib.crc32(x) for x in bodies], pa.int64())]
                    names = ["doc_id", "at", "first", "n_tokens", "ids_crc32"]
                    yield pa.RecordBatch.from_arrays(cols + [pa.array(bodies, pa.binary())] * keep_ids, names + ["ids"] * keep_ids)

    spans = written(files.mapInArrow(decode, schema), "token-spans")
    ends = running_sums(written(spans.groupBy("at").agg(F.sum("n_tokens").alias("ids_in")), "token-segments"), [], "at", {"end": "ids_in"})
    starts = ends.select("at", (F.col("end") - F.col("ids_in")).alias("before"))
    names = ["doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"] + ["ids"] * keep_ids
    return spans.join(starts, "at").select(*names)


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes the documents' ids to files in the shared folder and returns what read_token_files finds there.

    Repeated rows are documents each; an empty table gives no rows; other columns are left out, so their names can't clash.
    """
    path = shared_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer, **options)
    return read_token_files(docs.sparkSession, path)
