"""Token counts by a linear longest-match automaton.

A vocabulary of word pieces (those that begin a word, and those that continue one) becomes a trie with two
roots. Every node has a failure link to the node that the longest match leads to once the pieces matched so far
are taken off, and the number of pieces taken off on the way. Counting a word then follows one link or edge per
character, without ever building a piece: the number is that of greedy longest-match-first word pieces. A word
that the vocabulary cannot spell is a single unknown token.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from pixelframe.llm.columns import take
from pixelframe.llm.workers import map_slices

_UNKNOWN = 1 << 40  # in a word's value beside its number of tokens
_DEAD = -1


class PieceCounter:
    """The automaton. Node 0 is the start of a word, node 1 the start of a later piece."""

    def __init__(self, first: set[str], later: set[str]):
        self.edges: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        for root, pieces in ((0, first), (1, later)):
            for piece in sorted(pieces - {""}):
                node = root
                for c in piece:
                    if c not in self.edges[node]:
                        self.edges[node][c] = len(self.edges)
                        self.edges.append({})
                        ends.append(False)
                    node = self.edges[node][c]
                ends[node] = True
        self.fail, self.popped = [_DEAD] * len(ends), [0] * len(ends)
        level = [0, 1]
        while level:
            following = []
            for up in level:
                for c, node in self.edges[up].items():
                    following.append(node)
                    if ends[node]:
                        self.fail[node], self.popped[node] = 1, 1
                        continue
                    at, taken = self.fail[up], self.popped[up]
                    while at != _DEAD and c not in self.edges[at]:
                        taken += self.popped[at]
                        at = self.fail[at]
                    if at != _DEAD:
                        self.fail[node], self.popped[node] = self.edges[at][c], taken
            level = following

    def count(self, word: str) -> int | None:
        """Number of pieces of a word that is not empty; None if it cannot be spelled."""
        edges, fail, popped = self.edges, self.fail, self.popped
        node = total = 0
        for c in word:
            while c not in edges[node]:
                total += popped[node]
                node = fail[node]
                if node == _DEAD:
                    return None
            node = edges[node][c]
        while node != 1:
            total += popped[node]
            node = fail[node]
            if node == _DEAD:
                return None
        return total


def pieces_of(path: str) -> tuple[set[str], set[str]]:
    """Pieces of a sentencepiece model that begin a word (without their mark), and those that do not."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))]
    pieces = [model.id_to_piece(i) for i in kept]
    mark = "▁"
    return {p[1:] for p in pieces if p.startswith(mark)}, {p for p in pieces if not p.startswith(mark)}


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(*pieces_of(path))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_tokens, n_unknown`` of the words between white space, one row per input row.

    ``n_tokens`` has unknown words as one token each. A null or blank text has none. Every worker reads the
    vocabulary at ``path``; each distinct word of a slice is counted once.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = counter(path).count
        texts = [t.split() if t else [] for t in batch.column(1).to_pylist()]
        values = {}
        for word in set().union(*texts):
            n = count(word)
            values[word] = 1 + _UNKNOWN if n is None else n
        totals = [sum(map(values.__getitem__, words)) for words in texts]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(list(map(len, texts)), pa.int64()),
                pa.array([t % _UNKNOWN for t in totals], pa.int64()),
                pa.array([t // _UNKNOWN for t in totals], pa.int64()),
            ],
            ["doc_id", "n_words", "n_tokens", "n_unknown"],
        )

    chosen = take(docs, doc_id=id_col, text=text_col)
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return map_slices(chosen, run, f"doc_id {kind}, n_words bigint, n_tokens bigint, n_unknown bigint", "text")
