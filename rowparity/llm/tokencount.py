"""Token counts of greedy word pieces by a linear longest-match automaton.

The vocabulary is a trie.  Where a piece can't be extended by the next byte,
the failure link leads to the node for what is left of the word's end after
the longest pieces have been cut off its front, and the link knows how many
pieces that popped.  So a word is read once, byte by byte, and its number of
pieces is the sum of popped counts; no piece is built.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words kept with their counts in a Python worker; then it starts afresh.
WORD_CACHE = 300_000


class Automaton:
    """Counts the pieces of words by longest match first.

    ``first`` are the pieces that may begin a word, ``later`` those that may
    follow.  A word that can't be covered counts as one unknown piece.
    """

    def __init__(self, first: list[bytes], later: list[bytes]):
        self.go: dict[int, int] = {}  # node * 256 + byte -> node
        ends: set[int] = set()
        parent: list[tuple[int, int]] = [(-1, 0), (-1, 0)]  # 0: a word's start; 1: after a piece
        for root, pieces in ((0, first), (1, later)):
            for piece in pieces:
                node = root
                for byte in piece:
                    key = node << 8 | byte
                    if key not in self.go:
                        self.go[key] = len(parent)
                        parent.append((node, byte))
                    node = self.go[key]
                if node > 1:
                    ends.add(node)
        self.fail, self.popped = [-1] * len(parent), [0] * len(parent)
        level = sorted(n for n in range(2, len(parent)) if parent[n][0] < 2)
        children: dict[int, list[int]] = {}
        for n in range(2, len(parent)):
            children.setdefault(parent[n][0], []).append(n)
        while level:
            for n in level:
                if n in ends:
                    self.fail[n], self.popped[n] = 1, 1
                    continue
                up, byte = parent[n]
                at, count = self.fail[up], self.popped[up]
                while at >= 0 and at << 8 | byte not in self.go:
                    count += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[n], self.popped[n] = self.go[at << 8 | byte], count
            level = [c for n in level for c in children.get(n, ())]

    def count(self, word: bytes) -> int:
        go, fail, popped = self.go, self.fail, self.popped
        node, n = 0, 0
        for byte in word:
            while (to := go.get(node << 8 | byte, -1)) < 0:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = to
        while node != 1:
            if fail[node] < 0:
                return 1 if word else 0
            n += popped[node]
            node = fail[node]
        return n


@lru_cache(maxsize=2)
def byte_automaton(path: str) -> Automaton:
    """The automaton of a file of byte pieces in ranks: those with a blank in front begin words."""
    with open(path, "rb") as lines:
        pieces = [base64.b64decode(line.split()[0]) for line in lines if line.strip()]
    return Automaton([p for p in pieces if p[:1] == b" "], [p for p in pieces if p[:1] != b" "])


class _Counts(dict):
    """Counts by word, looked up in the automaton when first asked for."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        self[word] = n = self.automaton.count(b" " + word)
        return n


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_words, n_tokens) of whole texts.

    Words are what is between ASCII white space, each with a blank in front.
    Null and empty texts have none.  Each row gets a row, repeated or not;
    other columns are not read.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches):
        counts = _Counts(byte_automaton(path))
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                words = text.split() if text else []
                out.append((len(text or b""), len(words), sum(map(counts.__getitem__, words))))
                if len(counts) > WORD_CACHE:
                    counts.clear()
            columns = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "n_bytes", "n_words", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_words long, n_tokens long")


def op8_longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
