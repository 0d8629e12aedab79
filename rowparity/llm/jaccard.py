"""Groups of texts whose sets of word shingles are alike, by SimHash, Golay-code keys and exact verification.

A text's set is that of its five-word shingles (the whole sequence where it
has fewer words), hashed to 64 bits.  Its SimHash fingerprint has ``TABLES``
pairs of 23-bit words and ``CHECKED`` more bits; a bit is the sign of a sum of
weights of the shingles.  At a similarity of 0.8 two fingerprints differ in
about 0.15 of their bits, 9.7 of 64, beyond the 4 that op7's one fingerprint
reaches.  So each pair of words has op7's keys, 9.6 on average: the nearest
codeword in one word, any within 4 errors in the other.  A pair of texts that
differs in at most 2 bits of some pair of words shares a key by pigeonhole,
others often do: at 0.15 in 0.19 of the tables, so that about 3 pairs in a
million share none of all, and fewer above 0.8.

Texts that meet under a key are compared by the further bits where they
meet; ``MOST`` of 128 is over six deviations above what 0.8 makes differ.
A candidate pair is a link if the Jaccard similarity of its sets, counted
exactly, reaches the threshold.

Members of runs that hold many close texts aren't all paired: each is first
held against one or two others.  These members alone, one row each, then get
their keys a second time, and where they meet those from components that are
still apart are paired and verified after.  Of those, pairs that can't reach
the similarity are left out by their parity maps: a shingle flips one of
``BITS`` bits, so two maps differ in no more bits than the sets differ in
shingles.  The bound is exact, and it keeps texts that are alike, but not
enough, from being held against each other shingle by shingle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import dropped, written
from .simhash import codewords, first_of_each, pair_keys

#: Pairs of words in a fingerprint, and how many are taken in a round of a large input.
TABLES, ROUND = 64, 8
#: Further bits of a fingerprint, and the most that may differ between candidates.
CHECKED, MOST = 128, 44
#: Length of the sketch of a set whose projections are the fingerprint.
PLACES = 1024
#: Members of a run of equal keys that are compared as they are, and close pairs of it that are passed on.
RUN, CLOSE = 64, 3
#: Keys that are grouped together, about.
SLICE = 250_000
ENTRY = np.dtype([("key", "<u4"), ("node", "<i8"), ("low", "<u8"), ("high", "<u8")])
#: Bits of a parity map.
BITS = 2048
WORDS = BITS // 64
MEMBER = np.dtype([("node", "<i8"), ("component", "<i8"), ("n", "<i4"), ("map", "<u8", WORDS)])
MET = np.dtype([("key", "<u4"), ("node", "<i8")])
#: Pairs whose parity maps are compared at a time, and the words that are compared first.
AT_ONCE, HEAD = 16_384, 8
_random = np.random.default_rng(7)
_PLACE = _random.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit words over all bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, words: int = 5) -> np.ndarray:
    """The sorted, different hashes of a text's shingles; none where it has no words."""
    found = text.lower().split()
    digest = xxhash.xxh64_intdigest
    each = np.fromiter((digest(w, 42) for w in found), np.uint64, len(found))
    size = min(words, len(each))
    if not size:
        return each
    n = len(each) - size + 1
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total = total + _mixed(each[k : k + n] * _PLACE[k])
    return np.unique(_mixed(total))


@lru_cache(maxsize=1)
def _weights() -> np.ndarray:
    """Whole numbers, so that sums don't depend on their order."""
    return np.rint(np.random.default_rng(8).normal(0, 16, (PLACES, 46 * TABLES + CHECKED))).astype(np.float32)


def prints(sets: list[np.ndarray]) -> np.ndarray:
    """The SimHash fingerprints of sets, as rows of bytes.

    A shingle adds the weights of four places or takes them off, by its hash;
    with one place, two shingles of a short text would cancel out too often.
    """
    sketch = np.zeros((len(sets), PLACES), np.float32)
    for row, hashes in zip(sketch, sets, strict=True):
        for at in range(0, 64, 16):
            piece = (hashes >> np.uint64(at)).astype(np.int64)
            row += np.bincount(piece % PLACES, 1 - 2 * (piece >> 15 & 1), PLACES)
    return np.packbits(sketch @ _weights() > 0, axis=1)


def table_keys(found: np.ndarray, tables: range):
    """For each of ``tables``, (row, key) of the Golay keys of fingerprints (rows of bytes)."""
    bits, places = np.unpackbits(found, axis=1), 1 << np.arange(23)
    for table in tables:
        yield pair_keys(*(codewords(bits[:, at : at + 23] @ places) for at in (46 * table, 46 * table + 23)))


def _node(hashes: np.ndarray) -> int:
    return int(xxhash.xxh64_intdigest(hashes.tobytes(), 42)) - (1 << 63)


def signatures(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, text_key, node, n, print) of whole texts: node names the set, n is its size, print its fingerprint."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = [shingles(t or b"", words) for t in batch.column(2).to_pylist()]
                found = pa.array([row.tobytes() for row in prints(sets)], pa.binary())
                columns = [pa.array(map(_node, sets), pa.int64()), pa.array(map(len, sets), pa.int32()), found]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "text_key", "node", "n", "print"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").cast("binary"))
    return rows.mapInArrow(run, "doc_id long, text_key long, node long, n int, print binary")


def _entries(nodes: DataFrame, tables: range, slices: int) -> DataFrame:
    """(part, entries): the keys of the tables, packed with node and further bits, by table and range of keys."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                node = batch.column(0).to_numpy()
                found = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(node), -1)
                more = np.ascontiguousarray(found[:, -CHECKED // 8 :]).view("<u8")
                parts, packed = [], []
                for table, (row, key) in zip(tables, table_keys(found, tables), strict=True):
                    part = key * slices >> 24
                    order = np.argsort(part, kind="stable")
                    row, key, part = row[order], key[order], part[order]
                    each = np.empty(len(key), ENTRY)
                    each["key"], each["node"], each["low"], each["high"] = key, node[row], more[row, 0], more[row, 1]
                    starts = np.flatnonzero(np.diff(part, prepend=-1))
                    parts.extend((table * slices + part[starts]).tolist())
                    packed.extend(x.tobytes() for x in np.split(each, starts[1:]))
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(packed, pa.binary())], names=["part", "entries"])

    return nodes.select("node", "print").mapInArrow(run, "part long, entries binary")


def _differ(data: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return sum(np.bitwise_count(data[c][i] ^ data[c][j]).astype(np.int64) for c in ("low", "high"))


def _met(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries: pairs (a, b) of close nodes under one key, and the nodes of runs with more pairs than are told.

    The pairs of such a run connect each node with the least that is close, or
    in runs beyond ``RUN`` with the first and the last where these are close.
    """
    data = entries[np.lexsort((entries["node"], entries["key"]))]
    starts = np.flatnonzero(np.diff(data["key"].astype(np.int64), prepend=-1))
    sizes = np.diff(starts, append=len(data))
    run = np.repeat(np.arange(len(starts)), sizes)
    size, end = sizes[run], (starts + sizes)[run]
    one, two, index = [], [], np.flatnonzero((size > 1) & (size <= RUN))
    for gap in range(1, RUN):
        index = index[index + gap < end[index]]
        if not len(index):
            break
        close = index[_differ(data, index, index + gap) <= MOST]
        one.append(close)
        two.append(close + gap)
    one, two = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (one, two))
    several = np.bincount(run[one], minlength=len(starts))[run[one]] > CLOSE
    inner = np.unique(np.concatenate([one[several], two[several]]))
    least = np.full(len(data), len(data))
    np.minimum.at(least, two[several], one[several])
    star = np.flatnonzero(least < len(data))
    large = np.flatnonzero(size > RUN)
    pairs = [(one[~several], two[~several]), (least[star], star), (starts[run[large]], large), (large, end[large] - 1)]
    pairs[2:] = [(i[close], j[close]) for i, j in pairs[2:] for close in [_differ(data, i, j) <= MOST]]
    a, b = (data["node"][np.concatenate(x)] for x in zip(*pairs, strict=True))
    found = np.unique(np.stack([a, b], axis=1)[a != b], axis=0)
    return found, np.unique(data["node"][np.concatenate([inner, large])])


def candidates(nodes: DataFrame) -> DataFrame:
    """(run, a, b) of nodes (node, print): pairs that meet, without a run, and with run 0 each node a of runs with pairs left out."""

    def meet(table: pa.Table) -> pa.Table:
        entries = np.frombuffer(b"".join(table.column("entries").to_pylist()), ENTRY)
        pairs, left = _met(entries)
        none = lambda n: pa.nulls(n, pa.int64())
        ints = lambda x: pa.array(np.ascontiguousarray(x), pa.int64())
        columns = [(none(len(pairs)), ints(np.zeros_like(left))), (ints(pairs[:, 0]), ints(left)), (ints(pairs[:, 1]), none(len(left)))]
        return pa.table([pa.chunked_array(c) for c in columns], names=["run", "a", "b"])

    return _by_rounds(nodes, lambda tables, slices: _entries(nodes, tables, slices).groupBy("part").applyInArrow(meet, "run long, a long, b long"), "candidates")


def _by_rounds(nodes: DataFrame, meet: Callable[[range, int], DataFrame], name: str) -> DataFrame:
    """The different rows that ``meet`` makes of ranges of tables and the number of slices of their keys."""
    count = nodes.count()
    slices = -(-10 * max(count, 1) // SLICE)
    step = ROUND if count > 5_000 else TABLES
    found = [written(meet(range(at, at + step), slices), "met") for at in range(0, TABLES, step)]
    out = written(reduce(DataFrame.union, found).distinct(), name)
    for table in found:
        dropped(table)
    return out


def _member_entries(members: DataFrame, tables: range, slices: int) -> DataFrame:
    """(part, entries, members): like ``_entries``, with each part's members packed once beside their keys."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                each = np.empty(batch.num_rows, MEMBER)
                for k, name in enumerate(("node", "component", "n")):
                    each[name] = batch.column(k).to_numpy()
                found = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(each), -1)
                each["map"] = np.frombuffer(b"".join(batch.column(4).to_pylist()), "<u8").reshape(len(each), WORDS)
                parts, keys, packed = [], [], []
                for table, (row, key) in zip(tables, table_keys(found, tables), strict=True):
                    part = key * slices >> 24
                    for one in np.unique(part):
                        own = part == one
                        met = np.empty(own.sum(), MET)
                        met["key"], met["node"] = key[own], each["node"][row[own]]
                        parts.append(int(table * slices + one))
                        keys.append(met.tobytes())
                        packed.append(each[np.unique(row[own])].tobytes())
                columns = [pa.array(parts, pa.int64()), pa.array(keys, pa.binary()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "entries", "members"])

    return members.select("node", "component", "n", "print", "map").mapInArrow(run, "part long, entries binary, members binary")


def _may_reach(members: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the sets of members i and j, by their sizes and parity maps, can have the similarity."""
    n, m = members["n"][i].astype(np.int64), members["n"][j].astype(np.int64)
    out = np.minimum(n, m) >= similarity * np.maximum(n, m)
    # of n + m shingles, those that differ are at most (1 - s) / (1 + s); a millionth more against rounding
    most = (n + m) * ((1 - similarity) / (1 + similarity) + 1e-6)
    for words in (slice(HEAD), slice(WORDS)):
        maps, left = members["map"][:, words], np.flatnonzero(out)
        for some in (left[at : at + AT_ONCE] for at in range(0, len(left), AT_ONCE)):
            differ = np.bitwise_count(maps[i[some]] ^ maps[j[some]]).sum(axis=1, dtype=np.int64)
            out[some] = differ <= most[some]
    return out


def _apart(entries: np.ndarray, members: np.ndarray, similarity: float) -> np.ndarray:
    """The pairs (a, b) of members under one key that are of different components and may reach the similarity."""
    members = members[np.unique(members["node"], return_index=True)[1]]
    place = np.searchsorted(members["node"], entries["node"])
    order = np.lexsort((place, members["component"][place], entries["key"]))
    place, key = place[order], entries["key"][order].astype(np.int64)
    component = members["component"][place]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    sizes = np.diff(starts, append=len(key))
    # runs of the same members are one, and those within one component need no pairs
    names = np.add.reduceat(_mixed(members["node"][place].astype(np.uint64) * _PLACE[0]), starts)
    once = np.zeros(len(starts), bool)
    once[np.unique(np.stack([names, sizes.astype(np.uint64)], axis=1), axis=0, return_index=True)[1]] = True
    once &= component[starts] != component[starts + sizes - 1]
    first = np.flatnonzero((np.diff(key, prepend=-1) != 0) | (np.diff(component, prepend=0) != 0))
    other = np.repeat(np.append(first[1:], len(key)), np.diff(first, append=len(key)))  # where the next component begins
    end = np.repeat(starts + sizes, sizes)
    index = np.flatnonzero(np.repeat(once, sizes) & (other < end))
    other = other[index]
    found = [np.zeros((0, 2), np.int64)]
    while len(index):
        i, j = place[index], place[other]
        near = _may_reach(members, i, j, similarity)
        if near.any():
            found.append(np.stack([i[near], j[near]], axis=1))
        other = other + 1
        more = other < end[index]
        index, other = index[more], other[more]
    pairs = members["node"][np.unique(np.concatenate(found), axis=0)]
    return np.unique(np.sort(pairs, axis=1), axis=0)


def apart(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of members (node, component, n, print, map): pairs that meet, of different components, that may reach the similarity."""

    def meet(table: pa.Table) -> pa.Table:
        packed = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("entries", MET), ("members", MEMBER)))
        pairs = _apart(*packed, similarity)
        return pa.table([pa.array(np.ascontiguousarray(pairs[:, k]), pa.int64()) for k in (0, 1)], names=["a", "b"])

    return _by_rounds(members, lambda tables, slices: _member_entries(members, tables, slices).groupBy("part").applyInArrow(meet, "a long, b long"), "apart")


def parity_map(hashes: np.ndarray) -> np.ndarray:
    """For each of ``BITS`` places, whether an odd number of the set's shingles falls there; as 64-bit words."""
    odd = np.bincount((hashes >> np.uint64(7)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype(bool)).view("<u8")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = [shingles(t or b"", words) for t in batch.column(1).to_pylist()]
                sets = pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))
                maps = pa.array([parity_map(x).tobytes() for x in found], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), sets, maps], names=["node", "set", "map"])

    return texts.select("node", F.col("text").cast("string").cast("binary")).mapInArrow(run, "node long, set array<long>, map binary")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    one, two = (sets.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}")) for c in ("a", "b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.join(one, "a").join(two, "b").where(both >= similarity * (F.size("set_a") + F.size("set_b") - both)).select("a", "b")


def groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, text_key, component) of every document.

    Texts are lower-cased in A to Z and cut at ASCII white space; those with
    equal sets are one node, and links lead on.  Texts without words are alike.
    The pairs of ``candidates`` are verified first.  Of the runs with pairs
    left out, those that then lie in one component are done; in the others
    each pair from different components is verified.
    """
    each = written(signatures(docs, words), "signatures")
    nodes = each.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("print").alias("print"), F.min("text_key").alias("text_key"))
    nodes = written(nodes, "nodes")
    met = candidates(nodes)
    tested = met.where("run is null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    members = met.where("run is not null").select(F.col("a").alias("node"))
    wanted = tested.select(F.col("a").alias("node")).union(tested.select("b")).union(members).distinct()
    texts = docs.select(F.xxhash64("text").alias("text_key"), "text").join(wanted.join(nodes.select("node", "text_key"), "node"), "text_key").dropDuplicates(["node"])
    sets = written(_sets(texts, words), "sets")
    first = components(_alike(tested, sets, similarity))
    named = members.join(nodes.select("node", "n", "print"), "node").join(sets.select("node", "map"), "node").join(first, "node", "left")
    named = written(named.withColumn("component", F.coalesce("component", "node")), "named")
    pairs = apart(named, similarity)
    rest = written(_alike(pairs.join(tested, ["a", "b"], "left_anti"), sets, similarity), "rest")
    names = [first.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in")) for c in ("a", "b")]
    across = rest.join(names[0], "a", "left").join(names[1], "b", "left").select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b"))
    second = components(across)
    whole = second.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    out = first.join(whole, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    out = written(out.union(second).groupBy("node").agg(F.min("component").alias("component")), "linked")
    for table in (nodes, met, sets, named, pairs, rest):
        dropped(table)
    return each.join(out, "node", "left").select("doc_id", "text_key", F.coalesce("component", "node").alias("component"))


def without_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each of ``groups``: the one with the least doc_id, null ids last."""
    return first_of_each(docs, groups(docs, words, similarity))
