"""Token counts: greedy longest-match pieces of words, counted by a linear automaton."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: What marks a piece that starts a word in a vocabulary of this kind.
START = "▁"


class Automaton:
    """Counts the pieces of a word in one pass over its bytes.

    A trie of all pieces, at word starts under START. Where the next byte does not fit, the
    failure link of a node leads to the node of what is left of the path after greedy
    longest matches are taken from its front, and `popped` has how many these are.
    Each single byte counts as a piece, so a match always exists and unknown characters
    cost one piece a byte (byte fallback).
    """

    def __init__(self, pieces: list[str], start: str = START) -> None:
        self.next: list[dict[int, int]] = [{}]
        final = [False]
        whole = {p.encode() for p in pieces if p} | {bytes([b]) for b in range(256)}
        for piece in sorted(whole):
            node = 0
            for byte in piece:
                if byte not in self.next[node]:
                    self.next[node][byte] = len(self.next)
                    self.next.append({})
                    final.append(False)
                node = self.next[node][byte]
            final[node] = True
        self.fail, self.popped = [0] * len(self.next), [0] * len(self.next)
        queue = [0]
        for node in queue:  # by depth, so that the links of shorter paths are there
            for byte, child in self.next[node].items():
                queue.append(child)
                if final[child]:
                    self.fail[child], self.popped[child] = 0, 1
                else:
                    at, n = self.fail[node], self.popped[node]
                    while byte not in self.next[at]:
                        n += self.popped[at]
                        at = self.fail[at]
                    self.fail[child], self.popped[child] = self.next[at][byte], n
        self.begin, self.begin_pieces = self._run(0, 0, start.encode())

    def _run(self, node: int, pieces: int, text: bytes) -> tuple[int, int]:
        for byte in text:
            while byte not in self.next[node]:
                pieces += self.popped[node]
                node = self.fail[node]
            node = self.next[node][byte]
        return node, pieces

    def count(self, word: bytes) -> int:
        """The number of pieces of START + word."""
        node, pieces = self._run(self.begin, self.begin_pieces, word)
        while node:
            pieces += self.popped[node]
            node = self.fail[node]
        return pieces


class _Counts(dict):
    """Piece counts of words, remembered up to a bound."""

    def __init__(self, automaton: Automaton, most: int = 1_000_000) -> None:
        super().__init__()
        self.automaton, self.most = automaton, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = n = self.automaton.count(word)
        return n


def sentencepiece_pieces(path: str) -> list[str]:
    """The pieces of a sentencepiece model, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not special(i)]


def token_counts(docs: DataFrame, pieces: list[str], *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_words, n_tokens), a row per row of docs.

    Words are parted by ASCII white space; each is cut, with the start mark before it, into the longest pieces from left to
    right. A null text counts 0; empty texts too. Repeated rows each get a row; other columns are ignored. The vocabulary
    goes to each task once; its size is fixed by the tokenizer.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_bytes", "n_words", "n_tokens")])
    sent = docs.sparkSession.sparkContext.broadcast(pieces)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(Automaton(sent.value))
        for batch in batches:
            for start, end, texts in slices(batch, "_bytes"):
                rows = []
                for value in texts:
                    words = (value or b"").split()
                    rows.append((len(value or b""), len(words), sum(map(counts.__getitem__, words))))
                ids = batch.column("doc_id").slice(start, end - start)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], schema=schema)

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("_bytes"))
    return own.mapInArrow(emit, "doc_id long, n_bytes long, n_words long, n_tokens long")
