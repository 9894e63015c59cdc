"""Ids of a word-level BPE tokenizer, with what a worker has already encoded kept.

The tokenizer drops white space and never joins across it, so a text's ids are its words' ids in a row. Words
repeat far more often than texts, so only new words reach the tokenizer, many in one call.
"""

from __future__ import annotations

import itertools
import os
import re
from array import array

#: Entries that a worker keeps at most, from one task to the next. Frequent words come early, so the first ones stay.
MAX_WORDS, MAX_PIECES = 500_000, 300_000
#: Words that the pattern below splits as the tokenizer does: its own normalising changes only their case.
PLAIN = re.compile("[!-~À-įı-ɏ]+")
JOINED = 512


class WordIds:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        spec = json.loads(self.tokenizer.to_str())
        suffix = spec["model"]["end_of_word_suffix"]
        self.ends = {i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)}
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _new_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        out = {}
        parts = [pieces[at : at + JOINED] for at in range(0, len(pieces), JOINED)]
        # offsets aren't wanted, and leaving them out is faster
        for some, coded in zip(parts, self.tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            found, one = [], array("I")
            for i in coded.ids:
                one.append(i)
                if i in self.ends:
                    found.append(one.tobytes())
                    one = array("I")
            if one or len(found) != len(some):
                found = [array("I", self._encode(p)).tobytes() for p in some]
            out.update(zip(some, found, strict=True))
        return out

    def _new_words(self, words: set[bytes]) -> dict[bytes, bytes]:
        out, split = {}, {}
        for w in words:
            s = w.decode()
            if w.isalpha():  # ASCII letters, lower-case already: one piece
                split[w] = [s]
            elif w[-1:] in (b".", b",") and w[:-1].isalpha():
                split[w] = [s[:-1], s[-1]]
            elif PLAIN.fullmatch(s):
                split[w] = [s.lower()] if s.isalpha() else self.split(s.lower())
            else:
                out[w] = array("I", self._encode(s)).tobytes()
        fresh = list({p for ps in split.values() for p in ps if p not in self.pieces})
        got = self._new_pieces(fresh)
        known = self.pieces
        for w, ps in split.items():
            out[w] = b"".join([known[p] if p in known else got[p] for p in ps])
        room = MAX_PIECES - len(known)
        known.update((p, got[p]) for p in fresh[: max(room, 0)])
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null is empty."""
        split = [(x or "").encode().lower().split() for x in texts]
        known = self.words
        missing = {w for ws in split for w in ws if w not in known}
        if not missing:
            return [b"".join(map(known.__getitem__, ws)) for ws in split]
        new = self._new_words(missing)
        if len(known) + len(new) <= MAX_WORDS:
            known.update(new)
            return [b"".join(map(known.__getitem__, ws)) for ws in split]
        known.update(itertools.islice(new.items(), max(0, MAX_WORDS - len(known))))
        return [b"".join([known[w] if w in known else new[w] for w in ws]) for ws in split]


_made: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's tokenizer; made once for each worker."""
    if path not in _made:
        _made[path] = WordIds(path)
    return _made[path]
