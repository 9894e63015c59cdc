"""Token counts of a unigram tokenizer, by dynamic programming over a trie of the distinct pre-tokens.

The best segmentation of a string under a unigram model needs, at each of its ends, only the scores of its
prefixes. So the pre-tokens of a block of documents are put into a trie, each node's forward score is worked
out once, when the node is made, and pre-tokens that share a prefix share its scores. The token count of the
best segmentation stands at each node where a pre-token ends.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Nodes of a worker's trie; a fuller one is begun anew, which costs time but changes no count.
MAX_NODES = 800_000
#: Pre-tokens: runs without ASCII white space, each with the mark of a word's start before it.
MARK = "▁"
_split = re.compile(r"[^\x20\x09-\x0D]+").findall


class Vocabulary:
    """Scored pieces as an Aho-Corasick automaton: for each state, the pieces that end there."""

    def __init__(self, scores: dict[str, float], unknown: float):
        self.unknown = unknown
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, float]]] = [[]]
        for piece, score in scores.items():
            at = 0
            for c in piece:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                at = self.next[at][c]
            if piece:
                self.ends[at].append((len(piece), score))
        self.fail = [0] * len(self.next)
        level = list(self.next[0].values())
        while level:
            below = []
            for at in level:
                self.ends[at] = self.ends[at] + self.ends[self.fail[at]]
                for c, to in self.next[at].items():
                    self.fail[to] = self.step(self.fail[at], c)
                    below.append(to)
            level = below

    def step(self, at: int, c: str) -> int:
        while c not in self.next[at]:
            if not at:
                return 0
            at = self.fail[at]
        return self.next[at][c]


class PrefixTrie:
    """Pre-tokens with a forward score and a token count at each node. Ties go to fewer tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best: list[tuple[float, int]] = [(0.0, 0)]  # score, -tokens
        self.state = [0]
        self.terminal: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Tokens of word, which is inserted if it is new."""
        if (known := self.terminal.get(word)) is not None:
            return known
        if len(self.best) > MAX_NODES:
            self.clear()
        child, best, state, voc = self.child, self.best, self.state, self.vocabulary
        at, path, keep = 0, [0], len(word) <= 1000
        if not keep:  # a very long word shares little: its nodes are not kept
            return self._alone(word)
        for c in word:
            if (to := child.get((at, c))) is None:
                s = voc.step(state[at], c)
                score, tokens = best[at]
                found = (score + voc.unknown, tokens - 1)
                for size, piece in voc.ends[s]:
                    score, tokens = best[path[-size]]
                    if (x := (score + piece, tokens - 1)) > found:
                        found = x
                to = child[at, c] = len(best)
                best.append(found)
                state.append(s)
            at = to
            path.append(at)
        out = self.terminal[word] = -best[at][1]
        return out

    def _alone(self, word: str) -> int:
        voc, s, best = self.vocabulary, 0, [(0.0, 0)]
        for c in word:
            s = voc.step(s, c)
            score, tokens = best[-1]
            found = (score + voc.unknown, tokens - 1)
            for size, piece in voc.ends[s]:
                score, tokens = best[-size]
                found = max(found, (score + piece, tokens - 1))
            best.append(found)
        return -best[-1][1]


def read_scores(path: str, offset: float = 2.7) -> tuple[dict[str, float], float]:
    """Pieces of a sentencepiece file, scored by Zipf's rule: log of 1 / (rank + offset), normalised. Returns the scores
    and that of a character without a piece, which is below all."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))]
    total = math.log(sum(1 / (r + offset) for r in range(len(pieces))))
    scores = {p: -math.log(r + offset) - total for r, p in enumerate(pieces)}
    return scores, min(scores.values()) - 10.0


_tries: dict[str, PrefixTrie] = {}


def prefix_trie(path: str) -> PrefixTrie:
    if path not in _tries:
        _tries[path] = PrefixTrie(Vocabulary(*read_scores(path)))
    return _tries[path]


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_pretokens and n_tokens of each row under the unigram model of read_scores(path).

    No shuffle: each task works on its own rows, in blocks. Null and empty texts have 0 of both. Repeated rows
    give repeated rows, empty tables none; other columns are left out. path is a file on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = prefix_trie(path)
        for batch in batches:
            words, tokens = [], []
            for x in batch.column(1).to_pylist():
                counts = Counter(_split(x or ""))
                words.append(counts.total())
                tokens.append(sum(n * trie.count(MARK + w) for w, n in counts.items()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(key, text).mapInArrow(run, f"doc_id {docs.schema[key].dataType.simpleString()}, n_pretokens long, n_tokens long")
