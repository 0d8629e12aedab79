"""SimHash near-duplicates, found with Golay-code fuzzy hashing.

A fingerprint's 64 bits are cut into segments of 22, 21 and 21 bits, padded to
23.  The binary Golay code of length 23 is perfect: a word is within 3
errors of exactly one codeword, and within 4 of five on average.  Where two
fingerprints differ in at most 4 bits, some two of the segments differ in at
most 2 bits together.  Then one of these holds for the segments (i, j):

* one bit in each: the nearest codeword of one word is within 4 errors of the
  other word, in i and in j;
* two bits in one: the word halfway has a codeword within 3 errors, which is
  within 4 of both words; the other segment is equal.

So a fingerprint gets the keys (nearest in i, any within 4 in j) and (any
within 4 in i, nearest in j) for each of the three pairs, about 29 keys, and
no link is lost.  A key has 24 bits; candidates are verified bit by bit.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import dropped, written

#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the binary Golay code.
GENERATOR = 0b110001110101
#: Offset and length of the fingerprint's segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Members of a bucket that are compared as they are: cutting makes five rows of each, which pays for larger ones alone.
ONE_CELL = 64
#: Byte to its bits, one in each byte of a word, the first bit lowest.
_SPREAD = np.array([sum((b >> (7 - k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def _syndromes(words: np.ndarray) -> np.ndarray:
    """The remainders of 23-bit words by the generator."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


@lru_cache(maxsize=1)
def _errors() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error of weight 3 or less, and those of weight 4 (padded with -1)."""
    few = np.array([sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(23), n)])
    nearest = np.zeros(2048, np.int64)
    nearest[_syndromes(few)] = few
    four = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), 4)])
    by = _syndromes(four)
    order = np.argsort(by, kind="stable")
    counts = np.bincount(by, minlength=2048)
    table = np.full((2048, counts.max()), -1, np.int64)
    table[by[order], np.arange(len(four)) - np.repeat(np.cumsum(counts) - counts, counts)] = four[order]
    return nearest, table


def codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of 23-bit words: the nearest codeword, and those at distance 4 (padded with -1), as their upper 12 bits."""
    nearest, four = _errors()
    syndrome = _syndromes(words)
    error = four[syndrome]
    return (words ^ nearest[syndrome]) >> 11, np.where(error < 0, -1, (words[:, None] ^ error) >> 11)


def pair_keys(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the 24-bit keys of two words by their ``codewords``: nearest in one, any within 4 in the other."""
    (near, others), (near2, others2) = one, two
    index = np.arange(len(near))
    rows, keys = [index], [near << 12 | near2]
    for first, second in ((others, near2[:, None]), (near[:, None], others2)):
        both = np.where((first < 0) | (second < 0), -1, first << 12 | second)
        row, column = np.nonzero(both >= 0)
        rows.append(row)
        keys.append(both[row, column])
    return np.concatenate(rows), np.concatenate(keys)


def golay_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the keys of unsigned 64-bit fingerprints."""
    found = [codewords((fingerprints >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64)) for at, bits in SEGMENTS]
    rows, keys = zip(*(pair_keys(found[i], found[j]) for i, j in combinations(range(3), 2)), strict=True)
    return np.concatenate(rows), np.concatenate([tag << 24 | key for tag, key in enumerate(keys)])


def simhashes(texts: list[bytes], words: int = 4) -> np.ndarray:
    """The fingerprint of each text, as unsigned 64-bit numbers.

    Bits that are set in over half the XXH64 hashes (seed 42) of the text's
    shingles, repeats included; of the whole sequence where it has fewer
    words, and 0 where it has none.
    """
    digest, hashes, counts = xxhash.xxh64_digest, [], []
    for text in texts:
        found = text.lower().split()
        joined = b" ".join(found)
        n = len(found) - words + 1
        if n < 1:
            hashes.append(digest(joined, 42) if found else b"")
            counts.append(min(1, len(found)))
            continue
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
        hashes.append(b"".join([digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]))
        counts.append(n)
    out = np.zeros(len(texts), np.uint64)
    count = np.array(counts, np.int64)
    some = np.flatnonzero(count)
    if len(some):
        data = np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8)
        begin = np.concatenate(([0], np.cumsum(count[some])))
        blocks = -(-count[some] // 255)  # a byte of a word counts up to 255
        first = np.concatenate(([0], np.cumsum(blocks)))
        block = np.repeat(begin[:-1], blocks) + 255 * (np.arange(first[-1]) - np.repeat(first[:-1], blocks))
        sums = np.concatenate([np.add.reduceat(_SPREAD[data[a:b]], block[i:j] - a, axis=0) for i, j, a, b in _strips(block, len(data))])
        total = np.add.reduceat(sums.view(np.uint8).astype(np.int64), first[:-1], axis=0)
        bits = np.packbits(2 * total > count[some][:, None], axis=1)
        out[some] = np.ascontiguousarray(bits).view(">u8")[:, 0]
    return out


def _strips(block: np.ndarray, n: int, size: int = 256):
    """``block`` starts in strips: from, to; first and last row."""
    for i in range(0, len(block), size):
        j = min(i + size, len(block))
        yield i, j, block[i], n if j == len(block) else block[j]


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, text_key, fingerprint) of whole texts; the fingerprint is a signed long."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                found = simhashes([t or b"" for t in batch.column(2).to_pylist()], words)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["doc_id", "text_key", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").cast("binary"))
    return rows.mapInArrow(run, "doc_id long, text_key long, fingerprint long")


def _keyed(nodes: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            row, key = golay_keys(batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(key)], names=["fingerprint", "key"])

    return nodes.select("fingerprint").mapInArrow(run, "fingerprint long, key long")


def _mixed_cells(members: DataFrame, bits: int) -> DataFrame:
    """(key, piece, part, fingerprint, component, main) of cells with several components.

    A bucket of up to ``ONE_CELL`` members (n) is a cell.  Of a larger one,
    the fingerprint is cut into one piece more than bits may differ, so two
    close members are equal in a piece and share its cell.  main is the
    component with the most members in the cell.
    """
    ends = [64 * i // (bits + 1) for i in range(bits + 2)]
    parts = [F.shiftrightunsigned(F.shiftleft("fingerprint", 64 - b), 64 - b + a) for a, b in zip(ends, ends[1:])]
    parts = F.when(F.col("n") <= ONE_CELL, F.array(F.lit(0).cast("long"))).otherwise(F.array(*parts))
    cells = members.select("key", "fingerprint", "component", F.posexplode(parts).alias("piece", "part"))
    at = ["key", "piece", "part"]
    sizes = cells.groupBy(*at, "component").agg(F.count(F.lit(1)).alias("n"))
    mains = sizes.groupBy(*at).agg(F.count(F.lit(1)).alias("several"), F.max(F.struct("n", "component")).alias("most"))
    return cells.join(mains.where("several > 1").select(*at, F.col("most.component").alias("main")), at)


def linked(nodes: DataFrame, bits: int = 4) -> DataFrame:
    """(node, component) of the different fingerprints in ``nodes`` that have a link.

    A bucket's least and greatest member, by value and by a rotation of it,
    and the XOR of all, tell all its members if they are few; such buckets are
    verified where they are counted.  Of larger ones, each member is first
    held against the least and the greatest.  Buckets that then lie in one
    component are done.  Large others are cut into cells by pieces of the
    fingerprint, of which two close members share one; in a cell the members
    outside its main component are held against all.  So a large group of near
    copies makes no pairs within itself, and a bucket that strangers fill is
    divided further.
    """
    keyed = _keyed(nodes)
    turned = keyed.withColumn("turned", F.shiftleft("fingerprint", 29).bitwiseOR(F.shiftrightunsigned("fingerprint", 35)))
    back = lambda c: F.shiftrightunsigned(c, 29).bitwiseOR(F.shiftleft(c, 35))
    close = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= bits
    buckets = turned.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("fingerprint").alias("all"),
        F.min("fingerprint").alias("low"), F.max("fingerprint").alias("high"), F.min("turned").alias("low2"), F.max("turned").alias("high2"),
    ).where("n > 1")
    buckets = buckets.withColumn("known", F.array_distinct(F.array("low", "high", back("low2"), back("high2"))))
    missing = F.aggregate("known", F.col("all"), lambda s, x: s.bitwiseXOR(x))
    known = F.when(F.size("known") == F.col("n") - 1, F.concat("known", F.array(missing))).otherwise(F.col("known"))
    buckets = buckets.select("key", "n", "low", "high", known.alias("known")).withColumn("whole", F.size("known") == F.col("n"))
    pair = lambda x, i: F.transform(F.filter(F.col("known"), lambda y, j: (j > i) & close(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b")))
    buckets = buckets.withColumn("links", F.when(F.col("whole"), F.flatten(F.transform("known", pair))))
    buckets = written(buckets.where("not whole or size(links) > 0").select("key", "low", "high", "whole", "links"), "buckets")
    direct = buckets.where("whole").select(F.explode("links").alias("link")).select("link.a", "link.b")
    members = written(keyed.join(buckets.where("not whole").select("key", "low", "high"), "key"), "members")
    ends = [members.where(close(F.col("fingerprint"), F.col(end))).select(F.col("fingerprint").alias("a"), F.col(end).alias("b")) for end in ("low", "high")]
    first = components(direct.union(ends[0]).union(ends[1]))
    named = members.select("key", "fingerprint").join(first.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    named = written(named.withColumn("component", F.coalesce("component", "fingerprint")), "named")
    mixed = written(named.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high"),
    ).where("low <> high").select("key", "n"), "mixed")
    open_ = written(named.join(mixed, "key"), "open")
    cells = written(_mixed_cells(open_, bits), "cells")
    at = ["key", "piece", "part"]
    other = cells.where(F.col("component") != F.col("main")).select(*at, F.col("fingerprint").alias("b"), F.col("component").alias("other"))
    pairs = cells.withColumnRenamed("fingerprint", "a").join(other, at)
    pairs = pairs.where((F.col("component") != F.col("other")) & close(F.col("a"), F.col("b")))
    second = components(pairs.select(F.col("component").alias("a"), F.col("other").alias("b")))
    second = second.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    out = first.join(second, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    out = written(out.union(second.select("component", "whole")).distinct(), "linked")
    for table in (buckets, members, named, mixed, open_, cells):
        dropped(table)
    return out


def grouped(docs: DataFrame, words: int = 4, bits: int = 4) -> DataFrame:
    """``near_duplicates`` with component: one of the component's fingerprints, which tells components apart where ids don't."""
    each = written(fingerprints(docs, words), "fingerprints")
    nodes = written(each.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "nodes")
    links = linked(nodes, bits)
    named = nodes.join(links.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    named = written(named.select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("component")), "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    result = written(named.join(least, "component").select("fingerprint", "component", "component_id"), "components")
    return each.join(result, "fingerprint").select("doc_id", "text_key", "fingerprint", "component", "component_id")


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 4) -> DataFrame:
    """(doc_id, text_key, fingerprint, component_id) of every document.

    component_id is the least doc_id that links lead to, the document's own
    included; null ids count only where a component has no other.  Texts are
    lower-cased in A to Z and cut at ASCII white space.  Null, empty and blank
    texts have the fingerprint 0, which links like any other.  Equal rows get
    equal results; an empty table gives an empty one.
    """
    return grouped(docs, words, bits).drop("component")


def one_of_each(docs: DataFrame, words: int = 4, bits: int = 4) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the one with the least doc_id, null ids last.

    Of rows with that doc_id and different texts, and of equal rows, one stays.
    """
    return first_of_each(docs, grouped(docs, words, bits))


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The first row of ``docs`` of each component in ``found`` (doc_id, text_key, component)."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("least")
    first = found.groupBy("component").agg(least).select(F.col("least.doc_id").alias("first_id"), F.col("least.text_key").alias("first_key"))
    first = written(first, "first")
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id"), F.xxhash64("text").alias("key"))
    # keys before ids: many documents may have no id
    same = (rows["key"] == first["first_key"]) & rows["doc_id"].eqNullSafe(first["first_id"])
    kept = rows.join(first.hint("merge"), same, "left_semi").dropDuplicates(["doc_id", "key"])
    return kept.select(*(F.col("doc").getField(c).alias(c) for c in docs.columns))


def op7_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
