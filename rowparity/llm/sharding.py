"""Shards along a Hilbert curve through several metadata columns.

Each column is quantised to a power of two of steps; the steps of a row are a cell,
and the cells are ordered by their index on a Hilbert curve, so neighbours on
the curve are near each other in every dimension.  The sorted rows are cut
into runs of equal length.  Files written so have narrow ranges of all these
columns at once, which a reader can prune by.

Ranks over the whole table need no global sort: cells are few (2^18 at most),
the rows of a cell are dealt by a hash into parts of about ``PART_ROWS`` rows,
and the counts of cells and parts give each part's first rank.  A cell with a
third of all rows is many parts.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import dropped, ranked, written

DIMENSIONS = ("lang", "source", "n_chars")
#: Cells of the curve for each shard at least, so that a shard is a run of several; bits of a cell's index at most.
CELLS, MOST_BITS = 16, 18
#: Rows that are ranked together.
PART_ROWS = 1_000_000
#: Rows of a written file.
FILE_ROWS = 1_000_000


def hilbert_index(steps: list[int], bits: int) -> int:
    """The place of a cell on the Hilbert curve, by Skilling's transposition."""
    x, n = list(steps), len(steps)
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(n):
            if x[i] & level:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[i]) & low
                x[0] ^= swap
                x[i] ^= swap
        level >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, level = 0, 1 << (bits - 1)
    while level > 1:
        if x[n - 1] & level:
            flip ^= level - 1
        level >>= 1
    x = [v ^ flip for v in x]
    index = 0
    for bit in range(bits - 1, -1, -1):
        for v in x:
            index = index << 1 | (v >> bit & 1)
    return index


def bits_for(shards: int, dimensions: int) -> int:
    """Bits of each dimension."""
    return max(1, min(-(-(CELLS * shards - 1).bit_length() // dimensions), MOST_BITS // dimensions))


def steps(docs: DataFrame, name: str, bits: int) -> Column:
    """The step of a dimension that a row lies in, from 0 to 2^bits - 1, in the order of its values.

    A value's step is where the rows with lesser values end, as a share of
    all: exact, whatever the partitioning.  Strings go by their bytes, whole.
    Nulls are the least.  The driver holds the least value of each step.
    """
    value = docs[f"`{name}`"]
    counts = docs.where(value.isNotNull()).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    values = ranked(counts, ["value"])
    total = values.agg(F.sum("n").alias("total"))
    step = F.floor(F.col("rank") * (1 << bits) / F.col("total"))
    least = values.join(F.broadcast(total)).groupBy(step.alias("step")).agg(F.min("value").alias("value")).orderBy("step").collect()
    dropped(values)
    kind = docs.schema[name].dataType
    reached = [F.when(value >= F.lit(row["value"]).cast(kind), F.lit(int(row["step"]))).otherwise(0) for row in least]
    return F.coalesce(F.greatest(F.lit(0), F.lit(0), *reached), F.lit(0))


def _ranked_rows(docs: DataFrame, shards: int, dimensions: tuple[str, ...], *more: Column) -> DataFrame:
    """(doc_id, size, text_crc32, cell, shard, slot, *more)."""
    bits = bits_for(shards, len(dimensions))
    place = F.lit(0)
    for name in dimensions:
        place = place * (1 << bits) + steps(docs, name, bits)
    text = docs["text"].cast("string")
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        place.cast("int").alias("place"), *more,
    )
    grid = list(product(range(1 << bits), repeat=len(dimensions)))
    order = docs.sparkSession.createDataFrame([(k, hilbert_index(c, bits)) for k, c in enumerate(grid)], "place int, cell int")
    # at most a row for each cell of the curve
    cells = rows.groupBy("place").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(order), "place")
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = cells.select("place", "cell", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("total"))
    cells = written(cells, "cells")
    rows = rows.join(F.broadcast(cells), "place")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(17)), 1 + F.floor(F.col("n") / PART_ROWS)))
    counts = rows.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("in_part"))
    inside = Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("cell", "part", F.coalesce(F.sum("in_part").over(inside), F.lit(0)).alias("inside"))
    nth = F.row_number().over(Window.partitionBy("cell", "part").orderBy("doc_id", "text_crc32", "size")) - 1
    rows = rows.withColumn("nth", nth).join(starts, ["cell", "part"]).withColumn("rank", F.col("before") + F.col("inside") + F.col("nth"))
    # the shards' lengths are total div shards, and one more in the first total mod shards
    short, longer = F.expr(f"total div {shards}"), F.expr(f"total % {shards}")
    first = F.expr(f"rank div (total div {shards} + 1)")
    rest = F.expr(f"total % {shards} + (rank - total % {shards} * (total div {shards} + 1)) div greatest(total div {shards}, 1)")
    rows = rows.withColumn("shard", F.when(F.col("rank") < longer * (short + 1), first).otherwise(rest).cast("int"))
    start = F.col("shard") * short + F.least(F.col("shard"), longer)
    return rows.withColumn("slot", F.col("rank") - start).drop("place", "n", "before", "total", "part", "nth", "inside", "rank")


def sharded(docs: DataFrame, shards: int = 40, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """(doc_id, size, text_crc32, cell, shard, slot) of every document.

    Counts of shards differ by one at most; slots count from 0 without gaps.
    A null text has the size 16 and the CRC of nothing; long texts are read
    whole.  Rows that are equal in id and text share whatever two places they
    get.  With fewer rows than shards some shards stay empty; an empty table
    gives an empty one.  Other columns of ``docs`` may have any names.
    """
    return _ranked_rows(docs, shards, dimensions)


def write_shards(docs: DataFrame, path: str, shards: int = 40, dimensions: tuple[str, ...] = DIMENSIONS) -> None:
    """Writes ``docs`` as Parquet below ``path``, a folder for each shard, its files runs along the curve.

    Every row is written once.  A file holds about ``FILE_ROWS`` rows, so a
    shard is as many tasks as files.  The folders are named by ``shard``, or
    ``shard_`` where ``docs`` has such a column.
    """
    name = "shard"
    while name in (c.lower() for c in docs.columns):
        name += "_"
    rows = _ranked_rows(docs, shards, dimensions, F.struct("*").alias("doc"))
    rows = rows.withColumn("file", F.floor(F.col("slot") / FILE_ROWS)).repartition("shard", "file").sortWithinPartitions("shard", "slot")
    rows.select(*(F.col("doc").getField(c).alias(c) for c in docs.columns), F.col("shard").alias(name)).write.partitionBy(name).parquet(path)


def op2_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards whose counts differ by one at most."""
    out = sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
