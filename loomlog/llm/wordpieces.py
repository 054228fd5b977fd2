"""Greedy longest-match word-piece counts in linear time (the LinMaxMatch automaton of Song et al., 2021).

The vocabulary's pieces are a trie. A node's failure link leads where matching goes on once the longest piece at its start is
taken, and its count says how many pieces that takes; so a word is read once, each failed step pays for pieces already read,
and lengths come out without a piece ever being built. The automaton runs over the distinct words of a step of rows, all
words side by side, one character of each at a time; very long words go through one by one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import owners, picked, steps, words_of

#: Written before each word; a piece that begins with it can only begin a word.
START = "▁"
#: Words with more characters are read alone.
ALONE = 64


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces_of(path: str) -> list[str]:
    """The text pieces of a SentencePiece file, without its control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class LongestMatch:
    """The automaton of a vocabulary. Node 0 is the root; failure -1: the word has no pieces."""

    def __init__(self, pieces: Iterable[str]):
        children: list[dict[str, int]] = [{}]
        final = [False]
        for piece in pieces:
            node = 0
            for c in piece:
                node = children[node].setdefault(c, len(children))
                if node == len(children):
                    children.append({})
                    final.append(False)
            final[node] = node > 0
        failure, popped = np.full(len(children), -1, dtype=np.int64), np.zeros(len(children), dtype=np.int64)
        queue = [(0, c, n) for c, n in children[0].items()]
        for parent, c, node in queue:
            if final[node]:
                failure[node], popped[node] = 0, 1
            else:
                at, count = int(failure[parent]), int(popped[parent])
                while at >= 0 and c not in children[at]:
                    count, at = count + int(popped[at]), int(failure[at])
                if at >= 0:
                    failure[node], popped[node] = children[at][c], count
            queue += [(node, d, n) for d, n in children[node].items()]
        self.children, self.failure, self.popped = children, failure, popped
        letters = sorted({c for own in children for c in own})
        self.letters = np.full(0x110000, -1, dtype=np.int32)
        self.letters[[ord(c) for c in letters]] = np.arange(len(letters))
        self.width = len(letters)
        edges = sorted((node * self.width + int(self.letters[ord(c)]), to) for node, own in enumerate(children) for c, to in own.items())
        self.edges, self.targets = np.array([e[0] for e in edges], dtype=np.int64), np.array([e[1] for e in edges], dtype=np.int64)

    def count(self, word: str) -> int:
        """Pieces of the word; -1 if some part of it is in no piece."""
        node, total = 0, 0
        for c in word:
            while c not in self.children[node]:
                total += int(self.popped[node])
                node = int(self.failure[node])
                if node < 0:
                    return -1
            node = self.children[node][c]
        while node > 0:
            total += int(self.popped[node])
            node = int(self.failure[node])
        return total if node == 0 else -1

    def _step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        key = node * self.width + letter
        at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
        return np.where((letter >= 0) & (self.edges[at] == key), self.targets[at], -1)

    def counts(self, words: list[str]) -> np.ndarray:
        """count() of each word. The words must not be empty."""
        out = np.zeros(len(words), dtype=np.int64)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        for i in np.flatnonzero(sizes > ALONE).tolist():
            out[i] = self.count(words[i])
        order = np.flatnonzero(sizes <= ALONE)
        order = order[np.argsort(-sizes[order], kind="stable")]
        sizes = sizes[order]
        letters = self.letters[np.frombuffer("".join([words[i] for i in order.tolist()]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        begins = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        node, total = np.zeros(len(order), dtype=np.int64), np.zeros(len(order), dtype=np.int64)
        active = len(order)
        for position in range(int(sizes[0]) if len(sizes) else 0):
            active = int(np.searchsorted(-sizes, -position, side="left"))  # words longer than position come first
            letter = letters[begins[:active] + position]
            at = np.flatnonzero(node[:active] >= 0)
            while len(at):
                to = self._step(node[at], letter[at])
                hit = to >= 0
                node[at[hit]] = to[hit]
                at = at[~hit]
                total[at] += self.popped[node[at]]
                node[at] = self.failure[node[at]]
                at = at[node[at] >= 0]
        at = np.flatnonzero(node > 0)
        while len(at):
            total[at] += self.popped[node[at]]
            node[at] = self.failure[node[at]]
            at = at[node[at] > 0]
        out[order] = np.where(node == 0, total, -1)
        return out


@lru_cache(maxsize=2)
def automaton(path: str) -> LongestMatch:
    return LongestMatch(pieces_of(path))


COUNTS = "doc_id long, n_words long, n_tokens long, n_unknown long"


def _counter(path: str):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(path)
        for batch in steps(batches):
            words, offsets = words_of(batch.column("text"))
            n = len(offsets) - 1
            tokens, unknown = np.zeros(n), np.zeros(n)
            if len(words):
                coded = words.dictionary_encode()
                counts = machine.counts([START + w for w in coded.dictionary.to_pylist()])[coded.indices.to_numpy()]
                owner = owners(offsets)
                tokens, unknown = np.bincount(owner, weights=np.abs(counts), minlength=n), np.bincount(owner, weights=counts < 0, minlength=n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(tokens.astype(np.int64)), pa.array(unknown.astype(np.int64))], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return counted


def token_counts(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, n_tokens (pieces; a word with a part in no piece counts as one), n_unknown such words.

    Null and empty texts have no words. Rows keep their ids, null or repeated.
    """
    return picked(docs, doc_id=id, text=text).mapInArrow(_counter(path or vocabulary_path()), COUNTS)


def op2_longest_match(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
