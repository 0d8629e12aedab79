"""Interval sets: merging, and keeping or leaving out records that overlap them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge(intervals: DataFrame) -> DataFrame:
    """(contig, start, end) of the islands of half-open intervals; touching ones join."""
    order = Window.partitionBy("contig").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("opens", (before.isNull() | (F.col("start") > before)).cast("int"))
    marked = marked.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("contig", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def _overlapping(records: DataFrame, intervals: DataFrame, bin_size: int, how: str) -> DataFrame:
    """Semi or anti join on overlap with merged intervals.

    An interval answers for the starts from the end of the one before it up to
    its own end: the first that can overlap a record which starts there.  So a
    record meets one interval at most, by (contig, bin of its start).
    """
    before = F.coalesce(F.lag("end").over(Window.partitionBy("contig").orderBy("start")), F.lit(0))
    bins = F.sequence(F.floor(F.col("since") / bin_size), F.floor((F.col("end") - 1) / bin_size))
    each = intervals.withColumn("since", before).where("end > since").withColumn("bin", F.explode(bins)).alias("i")
    rows = records.alias("r")
    start, end = F.col("r.start"), F.col("r.end")
    same = (F.col("r.contig") == F.col("i.contig")) & (F.floor(start / bin_size) == F.col("i.bin"))
    meets = (start >= F.col("i.since")) & (start < F.col("i.end")) & (F.col("i.start") < end)
    return rows.join(each, same & meets, how)


def allowed(records: DataFrame, include: DataFrame | None, exclude: DataFrame | None, bin_size: int = 16_384) -> DataFrame:
    """Records (contig, start, end, ...) that overlap ``include`` and don't overlap ``exclude``.

    Unplaced records (no contig, or a start below 0) pass only where there is
    no include set.
    """
    if include is not None:
        records = _overlapping(records, merge(include), bin_size, "left_semi")
    if exclude is not None:
        records = _overlapping(records, merge(exclude), bin_size, "left_anti")
    return records


def parse_region(text: str) -> tuple[str, int, int]:
    """"contig:first-last", counted from 1 with both ends, as a half-open interval from 0."""
    contig, _, span = text.rpartition(":")
    first, _, last = span.replace(",", "").partition("-")
    if not contig or not first.isdigit() or not last.isdigit() or not 1 <= int(first) <= int(last):
        raise ValueError(f"not a region: {text!r}")
    return contig, int(first) - 1, int(last)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(contig, start, end) of a BED file, without comments and track lines; bad lines raise."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|track\b|browser\b|$)"))
    cells = F.split("value", r"\s+")
    rows = lines.select(cells[0].alias("contig"), F.get(cells, 1).cast("long").alias("start"), F.get(cells, 2).cast("long").alias("end"), "value")
    good = F.coalesce((F.col("start") >= 0) & (F.col("end") > F.col("start")), F.lit(False))
    return rows.select("contig", "start", F.when(good, F.col("end")).otherwise(F.raise_error(F.concat(F.lit("not a BED line: "), "value"))).alias("end"))
