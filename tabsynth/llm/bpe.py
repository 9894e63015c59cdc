"""Byte-level BPE by backtracking over longest matches.

The bytes of a piece are mapped to Latin-1 characters, so that an Aho-Corasick automaton of the vocabulary
finds all tokens in one pass. A token sequence is the one that the merges make exactly if each two adjacent
tokens are what the merges make of their joined bytes. So the encoder takes the longest match that is
compatible with the token before it, and steps back where none is. Each place in a piece fails at most once,
which makes the time linear in the piece's length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Entries that a worker keeps at most; beyond them pieces and pairs are worked out again.
MAX_PIECES, MAX_PAIRS = 400_000, 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The merges by their definition: the leftmost pair of lowest rank first. For short pieces."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class Encoder(dict):
    """Maps a piece (str) to its ids (little-endian unsigned 32-bit), which it keeps while there is room."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        super().__init__()
        self.ranks, self.token = ranks, {i: t for t, i in ranks.items()}
        self.size = {i: len(t) for i, t in self.token.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, i in ranks.items():
            if len(t) == 1 or merge(t, ranks) == [i]:  # others never come from merges, only as whole pieces
                self.found.add_word(t.decode("latin-1"), i)
        self.found.make_automaton()

    def fits(self, a: int, b: int) -> bool:
        """Whether the merges leave a and b side by side."""
        if (known := self.pairs.get((a, b))) is None:
            known = merge(self.token[a] + self.token[b], self.ranks) == [a, b]
            if len(self.pairs) < MAX_PAIRS:
                self.pairs[a, b] = known
        return known

    def tokens(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n, size = len(piece), self.size
        starts: list[list[int]] = [[] for _ in range(n)]
        for end, t in self.found.iter(piece.decode("latin-1")):
            starts[end - size[t] + 1].append(t)  # shorter ones end, and so come, first
        out: list[int] = []
        tried: list[int] = []
        dead = bytearray(n + 1)
        at, k = 0, len(starts[0]) - 1 if n else -1
        while at < n:
            here = starts[at]
            while k >= 0:
                t = here[k]
                if not dead[at + size[t]] and (not out or self.fits(out[-1], t)):
                    break
                k -= 1
            if k >= 0:
                out.append(t)
                tried.append(k)
                at += size[t]
                k = len(starts[at]) - 1 if at < n else -1
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte of the text")
                dead[at] = 1
                at -= size[out.pop()]
                k = tried.pop() - 1
        return out

    def __missing__(self, piece: str) -> bytes:
        ids = b"".join(t.to_bytes(4, "little") for t in self.tokens(piece.encode()))
        if len(self) < MAX_PIECES and len(piece) < 100:
            self[piece] = ids
        return ids

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, memoryview(ids).cast("I")))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a rank file; made once for each worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(read_ranks(path))
    return _encoders[path]


def encode_texts(texts: list[str | None], path: str, pattern: str) -> list[bytes]:
    import regex

    split, ids = regex.compile(pattern).findall, encoder(path).__getitem__
    return [b"".join(map(ids, split(x))) if x else b"" for x in texts]


def encode_documents(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (binary, unsigned 32-bit), row by row.

    Null and empty texts have no tokens. Repeated rows give repeated rows; empty tables give none. Other
    columns are left out. path must be readable on every executor, as the tokenizer files of an installation are.
    """
    schema = f"doc_id {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                ids = encode_texts(part.column(1).to_pylist(), path, pattern)
                decode = encoder(path).decode
                cols = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(decode(x)).hexdigest() for x in ids])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    cols, names = [*cols, pa.array(ids, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(key, text).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and the text that ids stand for. Null ids give null; bytes that aren't UTF-8 are replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            decode = encoder(path).decode
            texts = [None if x is None else decode(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(key, ids).mapInArrow(run, f"doc_id {encoded.schema[key].dataType.simpleString()}, text string")
