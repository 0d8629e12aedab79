"""Exact substring removal with a sparse suffix array, merged across tasks.

A byte goes if a string of ``width`` bytes that covers it also starts anywhere
else.  Every window of ``width`` bytes holds an anchor: the ``ANCHOR``-byte
string in it with the least hash, the leftmost of equals.  Equal windows have
equal anchors at equal places, so only anchors that occur twice can matter,
and runs of windows with one anchor ("segments") are handled together:

1. count segments by anchor hash; those that occur once are done with;
2. where all segments at an anchor are equal, all their windows repeat;
3. the other segments are the suffixes of the array.  Tasks sort those they
   hold by the text from the anchor on, front-code the sorted runs (length of
   the prefix shared with the one before, then the rest) and exchange them by
   anchor.  A loser tree merges the runs; it compares two suffixes only beyond
   the prefix both are known to share with the last winner.  The merged order
   has the common-prefix lengths, whose intervals at depth ``width - r``,
   crossed with those of the text before the anchor at depth ``r``, are the
   sets of equal windows that start ``r`` bytes before the anchor.

Full suffix arrays would exchange each byte's suffix; anchors are about one
byte in 75.  The answer is the same.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import dropped, row_key, same_row, written

#: Bytes of an anchor.
ANCHOR = 50
#: Bytes that are hashed together; longer texts go in overlapping pieces.
BLOCK = 1 << 20
#: Suffixes of an exchanged part, on average.
PART = 20_000
#: Anchors with more different segments than this are split by window.
HOT_ANCHOR = 50_000

_POSITION = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15
_tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value for each byte; the powers of the base and of its inverse modulo 2^64."""
    if n not in _tables:
        values = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        up, down = (np.full(n, x % (1 << 64), np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        _tables[n] = values, np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _tables[n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _segments(data: np.ndarray, ends: np.ndarray, width: int):
    """Of texts in one buffer that end at ``ends``: anchor hash, variant hash, start, bytes to the anchor, windows."""
    anchor, n = ANCHOR, len(data)
    values, up, down = _powers(BLOCK + (1 << 17))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * up[:n], out=sums[1:])
    h = _mixed((sums[anchor:] - sums[:-anchor]) * down[: n - anchor + 1])
    least = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
    span, have = width - anchor + 1, 1
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    at = (least & _POSITION).astype(np.int64)
    lengths = np.diff(ends, prepend=0)
    end = np.repeat(ends, lengths)[: len(at)]
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (end[1:] != end[:-1]))))
    stop = np.minimum(np.append(first[1:], len(at)), end[first] - width + 1)
    good = stop > first
    first, stop = first[good], stop[good]
    to_anchor, windows = at[first] - first, stop - first
    content = (sums[stop - 1 + width] - sums[first]) * down[first]
    variant = _mixed(content ^ _mixed((to_anchor.astype(np.uint64) << np.uint64(32)) | windows.astype(np.uint64)))
    return h[at[first]].view(np.int64), variant.view(np.int64), first, to_anchor, windows


def _segment_rows(docs: DataFrame, width: int) -> DataFrame:
    """(anchor, variant, doc_id, text_key, start, to_anchor, windows) of every segment."""

    def run(batches):
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            rows, held, size = [], [], 0
            for row, text in enumerate(batch.column(2).to_pylist()):
                for at in range(0, max(0, len(text or b"") - width + 1), BLOCK // 2):
                    piece = text[at : at + BLOCK // 2 + width - 1]
                    held.append((row, at, piece))
                    size += len(piece)
                    if size >= BLOCK // 2:
                        rows.append(found(held))
                        held, size = [], 0
            if held:
                rows.append(found(held))
            for row, anchor, variant, start, to_anchor, windows in rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(variant), ids.take(pa.array(row)), keys.take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (start, to_anchor, windows))],
                    names=["anchor", "variant", "doc_id", "text_key", "start", "to_anchor", "windows"],
                )

    def found(held):
        data = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
        ends = np.cumsum([len(p) for _, _, p in held])
        anchor, variant, first, to_anchor, windows = _segments(data, ends, width)
        piece = np.searchsorted(ends, first, "right")
        row, shift = np.array([r for r, _, _ in held]), np.array([at for _, at, _ in held])
        return row[piece], anchor, variant, first - np.concatenate(([0], ends[:-1]))[piece] + shift[piece], to_anchor, windows

    schema = "anchor long, variant long, doc_id long, text_key long, start long, to_anchor long, windows long"
    return docs.select(F.col("doc_id").cast("long"), "text_key", F.col("text").cast("binary")).mapInArrow(run, schema)


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """The length of the common prefix, of which ``known`` bytes need no look."""
    end = min(len(a), len(b))
    if a[known:end] == b[known:end]:
        return end
    low, high = known, end
    while high - low > 1:  # equal up to low, different before high
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def front_coded(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """For sorted strings, the prefix that each shares with the one before, and the rest."""
    shared, rest, before = [], [], b""
    for s in strings:
        shared.append(k := common_prefix(before, s))
        rest.append(s[k:])
        before = s
    return shared, rest


def merged(runs: list[tuple[list[int], list[bytes]]]):
    """Front-coded sorted runs in one order: (run, string, prefix shared with the one before).

    A loser tree: each inner node keeps the run that lost there and how much
    its string shares with the string that won.  Of two strings, the one that
    shares more with the last winner is the lesser, without a look at either;
    only for equal lengths are the bytes beyond them compared.
    """
    k = 1
    while k < len(runs):
        k *= 2
    place, now = [0] * k, [rest[0] if rest else None for _, rest in runs] + [None] * (k - len(runs))
    tree = [(-1, 0)] * k

    def play(a, b):
        """(winner, loser); each is a run and what it shares with the last winner."""
        (i, x), (j, y) = a, b
        if now[i] is None:
            return b, a
        if now[j] is None or x > y:
            return a, b
        if y > x:
            return b, a
        both = common_prefix(now[i], now[j], x)
        if now[i][both : both + 1] < now[j][both : both + 1] or (len(now[i]) == both == len(now[j]) and i < j):
            return a, (j, both)
        return b, (i, both)

    def build(node):
        if node >= k:
            return node - k, 0
        winner, tree[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    best = build(1)
    while now[best[0]] is not None:
        run, share = best
        yield run, now[run], share
        place[run] += 1
        shared, rest = runs[run]
        if place[run] < len(rest):
            share = shared[place[run]]
            now[run] = now[run][:share] + rest[place[run]]
        else:
            now[run], share = None, 0
        best, node = (run, share), (run + k) // 2
        while node:
            best, tree[node] = play(best, tree[node])
            node //= 2


def _runs(candidates: DataFrame, parts: int, width: int) -> DataFrame:
    """Sorted front-coded runs, a row for each part and group of candidates."""

    def run(batches):
        held: dict[int, list] = {}
        n = 0
        for batch in batches:
            for row in batch.to_pylist():
                text = row["text"]
                for c in row["found"]:
                    x = c["start"] + c["to_anchor"]
                    right = text[x : c["start"] + c["windows"] - 1 + width]
                    held.setdefault(c["anchor"] % parts, []).append((right, text[c["start"] : x], c["anchor"], c["variant"], c["windows"]))
                    n += 1
            if n >= 2 * PART:
                yield coded(held)
                held, n = {}, 0
        if held:
            yield coded(held)

    def coded(held):
        rows = {name: [] for name in ("part", "shared", "rest", "left", "anchor", "variant", "windows")}
        for part, found in held.items():
            found.sort(key=lambda x: x[0])
            shared, rest = front_coded([x[0] for x in found])
            for name, value in zip(rows, (part, shared, rest, *(list(x) for x in list(zip(*found, strict=True))[1:])), strict=True):
                rows[name].append(value)
        return pa.RecordBatch.from_pydict(rows, schema=arrow)

    whole, text = pa.list_(pa.int64()), pa.list_(pa.binary())
    arrow = pa.schema([("part", pa.int64()), ("shared", whole), ("rest", text), ("left", text), ("anchor", whole), ("variant", whole), ("windows", whole)])
    schema = "part long, shared array<long>, rest array<binary>, left array<binary>, anchor array<long>, variant array<long>, windows array<long>"
    return candidates.mapInArrow(run, schema)


def _merge_part(table: pa.Table, width: int) -> pa.Table:
    """The windows, as (anchor, variant, first, last), that repeat among a part's suffixes."""
    rows = table.to_pylist()
    at = [0] * len(rows)
    lefts, where, share = [], [], []
    for run, _, lcp in merged([(r["shared"], r["rest"]) for r in rows]):
        k = at[run]
        at[run] += 1
        r = rows[run]
        where.append((r["anchor"][k], r["variant"][k], r["windows"][k]))
        lefts.append(r["left"][k])
        share.append(lcp)
    n = len(where)
    anchor, variant, windows = (np.array(x, np.int64) for x in zip(*where, strict=True))
    right = np.array(share, np.int64)
    right[0] = -1
    block = np.cumsum(right < ANCHOR)
    backward = [x[::-1] for x in lefts]
    order = sorted(range(n), key=lambda i: (block[i], backward[i]))
    left = np.full(n, -1, np.int64)  # in that order, with the one before; -1 where a block begins
    for k in range(1, n):
        if block[order[k]] == block[order[k - 1]]:
            left[k] = common_prefix(backward[order[k - 1]], backward[order[k]])
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    reach = np.array([len(x) for x in lefts], np.int64)
    out = []
    for low in range(0, width - ANCHOR + 1, 16):
        back = np.arange(low, min(low + 16, width - ANCHOR + 1))
        same_right = np.cumsum(right[:, None] < width - back[None, :], axis=0)
        same_left = np.cumsum(left[:, None] < back[None, :], axis=0)[place]
        key = same_right * (n + 1) + same_left
        valid = (back[None, :] <= reach[:, None]) & (back[None, :] > (reach - windows)[:, None])
        key[~valid] = -1
        by = np.argsort(key, axis=0, kind="stable")
        sorted_key = np.take_along_axis(key, by, axis=0)
        equal = (sorted_key[1:] == sorted_key[:-1]) & (sorted_key[1:] >= 0)
        edge = np.zeros((1, len(back)), bool)
        twice = np.concatenate((equal, edge)) | np.concatenate((edge, equal))
        flags = np.empty_like(twice)
        np.put_along_axis(flags, by, twice, axis=0)
        out.append(flags)
    flags = np.concatenate(out, axis=1)[:, ::-1]  # now by increasing start
    padded = np.zeros((n, flags.shape[1] + 2), np.int8)
    padded[:, 1:-1] = flags
    step = np.diff(padded, axis=1)
    who, first = np.nonzero(step == 1)
    _, last = np.nonzero(step == -1)
    shift = reach[who] - (width - ANCHOR)
    return pa.table({"anchor": anchor[who], "variant": variant[who], "first": first + shift, "last": last - 1 + shift})


def _hot_windows(candidates: DataFrame, width: int) -> DataFrame:
    """As ``_merge_part``, for anchors with very many segments: counted window by window, so that no task holds them."""

    def run(batches):
        for batch in batches:
            held: list[tuple] = []
            for row in batch.to_pylist():
                for c in row["found"]:
                    windows = (row["text"][c["start"] + k : c["start"] + k + width] for k in range(c["windows"]))
                    held += [(c["anchor"], c["variant"], k, hashlib.md5(w).digest()) for k, w in enumerate(windows)]
                    if len(held) >= PART:
                        yield table(held)
                        held = []
            yield table(held)

    def table(rows):
        return pa.RecordBatch.from_pylist([dict(zip(fields.names, r, strict=True)) for r in rows], schema=fields)

    fields = pa.schema([("anchor", pa.int64()), ("variant", pa.int64()), ("first", pa.int64()), ("digest", pa.binary())])
    each = written(candidates.mapInArrow(run, "anchor long, variant long, first long, digest binary"), "windows")
    twice = each.groupBy("digest").agg(F.countDistinct("anchor", "variant", "first").alias("n")).where("n > 1")
    twice = written(twice.select("digest"), "windows-twice")
    return each.join(twice, "digest").select("anchor", "variant", "first", F.col("first").alias("last"))


def repeated_ranges(docs: DataFrame, width: int = 200) -> DataFrame:
    """(doc_id, text_key, ranges) of texts with windows that occur twice.

    ``ranges`` has the byte ranges (from, to) which such windows cover,
    unsorted and overlapping.
    """
    spark = docs.sparkSession
    texts = docs.select(*row_key(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counted = _segment_rows(texts, width).groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("variant").alias("low"), F.max("variant").alias("high"))
    repeated = written(counted.where("n > 1").select("anchor", (F.col("low") != F.col("high")).alias("several")), "anchors")
    found = written(_segment_rows(texts, width).join(repeated, "anchor"), "segments")
    dropped(repeated)

    variants = found.where("several").groupBy("anchor", "variant").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "text_key", "start", "to_anchor", "windows")).alias("at")
    )
    variants = written(variants.select("anchor", "variant", "n", "at.*"), "variants")
    hot = written(variants.groupBy("anchor").count().where(F.col("count") > HOT_ANCHOR).select("anchor"), "hot-anchors")
    n, any_hot = variants.count(), not hot.isEmpty()

    def candidates(rows: DataFrame) -> DataFrame:
        by_text = rows.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("anchor", "variant", "start", "to_anchor", "windows")).alias("found"))
        return texts.join(by_text, same_row(texts, by_text)).select(F.col("text").cast("binary").alias("text"), "found")

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // PART + 1)
    usual = variants.join(hot, "anchor", "left_anti") if any_hot else variants
    runs = _runs(candidates(usual), parts, width)
    schema = "anchor long, variant long, first long, last long"
    twice = runs.repartition(parts, "part").groupBy("part").applyInArrow(lambda t: _merge_part(t, width), schema)
    if any_hot:
        twice = twice.unionByName(_hot_windows(candidates(variants.join(hot, "anchor", "left_semi")), width))
    twice = twice.unionByName(variants.where("n > 1").select("anchor", "variant", F.lit(0).cast("long").alias("first"), (F.col("windows") - 1).alias("last")))
    twice = written(twice, "repeats")

    columns = ["doc_id", "text_key", (F.col("start") + F.col("first")).alias("from"), (F.col("start") + F.col("last") + width).alias("to")]
    plain = found.where("not several").select("doc_id", "text_key", F.col("start").alias("from"), (F.col("start") + F.col("windows") - 1 + width).alias("to"))
    matched = found.where("several").join(twice, ["anchor", "variant"]).select(*columns)
    return plain.unionByName(matched).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("from", "to")).alias("ranges"))


def _spans(ranges) -> list[tuple[int, int]]:
    """Overlapping and touching ranges joined."""
    spans: list[list[int]] = []
    for a, b in sorted((r["from"], r["to"]) for r in ranges):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    return [(a, b) for a, b in spans]


def remove_repeats(docs: DataFrame, width: int = 200, whole: bool = True) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and if ``whole`` kept and spans.

    ``kept`` has the bytes that are left, ``spans`` the removed byte ranges;
    without ``whole`` texts don't come back from the workers.  A null text
    counts as empty; texts shorter than ``width`` stay as they are, and those
    of any length are hashed in overlapping pieces.  Of several equal rows
    each gets a row; they repeat each other, so all go.  Columns other than
    doc_id and text are not read; an empty table gives an empty one.
    """
    texts = docs.select(*row_key(), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    ranges = repeated_ranges(docs, width).withColumnsRenamed({"doc_id": "range_id", "text_key": "range_key"})
    same = F.col("doc_id").eqNullSafe(F.col("range_id")) & (F.col("text_key") == F.col("range_key"))
    joined = texts.join(ranges, same, "left")

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                text, spans = row["text"], _spans(row["ranges"] or ())
                edges = [0, *(x for span in spans for x in span), len(text)]
                parts = [text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
                kept = b"".join(parts)
                found = (row["doc_id"], len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
                values = dict(zip(fields.names, found, strict=False))
                if whole:
                    values |= {"kept": kept, "spans": [{"from": a, "to": b} for a, b in spans]}
                out.append(values)
            yield pa.RecordBatch.from_pylist(out, schema=fields)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    if whole:
        schema += ", kept binary, spans array<struct<from:long,to:long>>"
        fields += [("kept", pa.binary()), ("spans", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))]
    fields = pa.schema(fields)
    return joined.select(F.col("doc_id").cast("long"), "text", "ranges").mapInArrow(run, schema)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 200 bytes that repeat."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), 200, whole=False)


ORACLE_OP4 = """
with d as (
  select doc_id, encode(coalesce(text, '')) b, strlen(coalesce(text, '')) n from documents
), w as (
  select doc_id, i, md5(b[i + 1 : i + 200]) m from (select doc_id, b, unnest(range(0, n - 199)) i from d where n >= 200)
), r as (
  select doc_id, i, true hit from w where m in (select m from w group by m having count(*) > 1)
), e as (
  select doc_id, j, hex(b[j + 1 : j + 1]) x from (select doc_id, b, unnest(range(0, n)) j from d)
), c as (
  select e.doc_id, j, x, bool_or(hit) over (partition by e.doc_id order by j rows between 199 preceding and current row) is not null gone
  from e left join r on r.doc_id = e.doc_id and r.i = e.j
), s as (
  select *, gone and not coalesce(lag(gone) over (partition by doc_id order by j), false) opens from c
), g as (
  select doc_id, count(*) filter (where gone) n_removed, count(*) filter (where opens) n_spans,
    sha256(unhex(coalesce(string_agg(x, '' order by j) filter (where not gone), ''))) kept_sha256
  from s group by doc_id
)
select d.doc_id, n n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans,
  coalesce(kept_sha256, sha256(unhex(''))) kept_sha256
from d left join g using (doc_id)
"""
