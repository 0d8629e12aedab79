"""Best-fit packing by exact-complement hashing.

The plan depends on the histogram of lengths alone, which has at most
``capacity`` entries whatever the corpus is; so it is made on the driver with
multiplicities instead of documents.  Sums of one, two and three available
lengths are indexed in bit sets.  A gap is closed by a combination with
exactly its sum under the availability counts; where none is left, the largest
sum below it goes in, and again until nothing fits.  The plan comes out as
runs "the k-th to l-th piece of this length go to these sequences at this
offset", so placing the pieces is an equi-join on the length.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written

#: Ranks within a length are counted in so many parts, so that a length that
#: many pieces share is no single task.
RANK_PARTS = 256
#: The vocabulary whose words end at white space and whose texts are lower-cased; only its words are looked up.
VOCABULARY = "word_bpe_49k.json"
#: Bytes of words and ids kept in a Python worker; then it starts afresh.  A word counts its overhead too.
CACHE_BYTES, OVERHEAD = 200 << 20, 200
#: Marks whose ids stand for themselves after a letter.
CLOSING = (".", ",")
_cache: dict[str, bytes] = {}
_held = [0]


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _model(path: str):
    return _tokenizer(path).model


def _byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it is printable, else one after 255."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(other)) for b in range(256)]


_LETTERS = dict(enumerate(_byte_letters()))


def _plain(text: str) -> bool:
    """Whether str.lower() does what the tokenizer's own lower-casing and composing does."""
    return "<|" not in text and (text.isascii() or max(text) < "ɐ")


@lru_cache(maxsize=1 << 16)
def _closes(letter: str) -> bool:
    """Whether a mark behind this character begins a word: it is a letter, and stays one when composed and lower-cased."""
    return letter.isalpha() and unicodedata.normalize("NFC", letter).lower().isalpha()


def _encoded(words: list[str], path: str) -> Iterator[tuple[str, bytes]]:
    """The ids of each stretch of text without blanks.

    The vocabulary's pieces of a lower-case Latin word are those of its bytes,
    without the steps that find words in a text.
    """
    model, other = _model(path), []
    for word in words:
        if word.isalpha() and (word.isascii() or max(word) < "ɐ") and word.islower():
            letters = word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)
            yield word, array("I", [token.id for token in model.tokenize(letters)]).tobytes()
        else:
            other.append(word)
    for word, code in zip(other, _tokenizer(path).encode_batch_fast(other, add_special_tokens=False), strict=True):
        yield word, array("I", code.ids).tobytes()


def token_bytes(texts: list[str | None], path: str) -> Iterator[bytes]:
    """The little-endian unsigned 32-bit ids of each text, and a closing 0.

    The words of ``VOCABULARY`` end at white space, so its ids are looked up
    by the stretch between blanks and line ends, and only new stretches are
    encoded.  Texts are encoded whole by any other vocabulary.
    """
    if os.path.basename(path) != VOCABULARY:
        for code in _tokenizer(path).encode_batch_fast([t or "" for t in texts], add_special_tokens=False):
            yield array("I", code.ids).tobytes() + b"\0\0\0\0"
        return
    cache = _cache
    split = [((t.lower() if _plain(t) else t).replace("\n", " ").split(" ") if t else []) for t in texts]
    if _held[0] > CACHE_BYTES:
        cache.clear()
        _held[0] = 0
    new = set().union(*split).difference(cache)
    closed = {w for w in new if w[-1:] in CLOSING and _closes(w[-2:-1])}  # a letter and then a mark end two words
    wanted = (new - closed | {w[:-1] for w in closed} | set(CLOSING)).difference(cache)
    cache.update(_encoded(list(wanted), path))
    for word in closed:
        cache[word] = cache[word[:-1]] + cache[word[-1]]
    _held[0] += sum(OVERHEAD + 2 * len(w) + len(cache[w]) for w in wanted | closed)
    for words in split:
        yield b"".join(map(cache.__getitem__, words)) + b"\0\0\0\0"


def token_pieces(docs: DataFrame, capacity: int = 2048, path: str | None = None) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) of tokenised texts.

    A null or empty text has the closing id 0 alone.  A text with more than
    ``capacity`` ids is cut at multiples of it; no other is cut.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    width = 4 * capacity

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = []
                for doc, data in zip(batch.column(0).to_pylist(), token_bytes(batch.column(1).to_pylist(), path), strict=True):
                    for k, cut in enumerate(range(0, len(data), width)):
                        part = data[cut : cut + width]
                        rows.append((doc, k, cut // 4, len(part) // 4, zlib.crc32(part)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


class _Sums:
    """The lengths that are left, and bit sets of what one to three of them add up to."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = [0] * (capacity + 1)
        self.mask = (1 << (capacity + 1)) - 1
        for length, n in counts.items():
            self.left[length] = n
        self.one = sum(1 << k for k, n in enumerate(self.left) if n)
        self.fresh = False

    def _index(self) -> None:
        self.two = self.three = 0
        lengths = self.lengths()
        for a in lengths:
            self.two |= self.one << a
        self.two &= self.mask
        for a in lengths:
            self.three |= self.two << a
        self.three &= self.mask
        self.fresh = True

    def lengths(self) -> list[int]:
        return [k for k, n in enumerate(self.left) if n]

    def _can(self, parts: tuple[int, ...]) -> bool:
        return all(p > 0 and self.left[p] >= parts.count(p) for p in parts)

    def fill(self, gap: int) -> tuple[int, ...]:
        """One to three lengths with the largest sum up to ``gap``; few and long ones first."""
        low = (1 << (gap + 1)) - 1
        if self.left[gap]:
            return (gap,)
        if not self.fresh:
            self._index()
        options = (self.one | self.two | self.three) & low & ~1
        while options:
            total = options.bit_length() - 1
            if self.left[total]:
                return (total,)
            if self.two >> total & 1:
                for a in range(total - 1, (total - 1) // 2, -1):
                    if self._can((a, total - a)):
                        return (a, total - a)
            if self.three >> total & 1:
                for a in range(total - 2, 0, -1):
                    if self.left[a] and self.two >> (total - a) & 1:
                        rest = total - a
                        for b in range(min(a, rest - 1), (rest - 1) // 2, -1):
                            if self._can((a, b, rest - b)):
                                return (a, b, rest - b)
            options ^= 1 << total
        return ()

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            self.one &= ~(1 << length)
            self.fresh = False


def packing_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, last rank + 1, first sequence, offset, number within its sequence).

    Each step uses up a length, or all its sequences but a remainder, so the
    number of runs is bounded by the number of lengths, not of pieces.
    """
    sums, runs, sequence = _Sums(counts, capacity), [], 0
    used = dict.fromkeys(counts, 0)

    def emit(parts: list[int], times: int) -> None:
        nonlocal sequence
        offset = 0
        for k, p in enumerate(parts):
            runs.append((p, used[p], used[p] + times, sequence, offset, k))
            used[p] += times
            offset += p
        sequence += times

    for length in range(capacity, 0, -1):
        while sums.left[length]:
            parts, gap = [length], capacity - length
            sums.take(length, 1)
            while gap:
                more = sums.fill(gap)
                if not more:
                    break
                for p in more:
                    sums.take(p, 1)
                parts += more
                gap -= sum(more)
            again = min(sums.left[p] // parts.count(p) for p in set(parts))
            for p in set(parts):
                if again:
                    sums.take(p, again * parts.count(p))
            emit(parts, 1 + again)
    return runs


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id and offset.

    ``pieces`` is read three times: give a written table.  Lengths are 1 to
    ``capacity``.  Equal rows get places of their own.  An empty table gives
    an empty one; further columns stay, whatever their names.
    """
    spark = pieces.sparkSession
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    runs = spark.createDataFrame(
        packing_plan(counts, capacity),
        "run_length long, first_rank long, end_rank long, first_sequence long, run_offset long, nth int",
    )
    part = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_PARTS))
    dealt = pieces.withColumn("rank_part", part)
    sizes = dealt.groupBy("length", "rank_part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("rank_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "rank_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ranks_before"))
    within = Window.partitionBy("length", "rank_part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank_in", F.row_number().over(within) - 1).join(sizes, ["length", "rank_part"])
    ranked = ranked.withColumn("rank", F.col("ranks_before") + F.col("rank_in"))
    on = (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank"))
    placed = ranked.join(F.broadcast(runs), on)  # the runs are bounded by the capacity, see packing_plan
    return placed.select(
        *pieces.columns,
        (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"),
        F.col("run_offset").alias("offset"),
    )


def pack_documents(docs: DataFrame, capacity: int = 2048, path: str | None = None) -> DataFrame:
    """Tokenises, cuts and packs ``docs``; see ``token_pieces`` and ``pack``."""
    return pack(written(token_pieces(docs, capacity, path), "pieces"), capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 2048)
