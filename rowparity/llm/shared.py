"""Small helpers of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import dropped, new_path, shared_folder, written

__all__ = ["dropped", "new_path", "ranked", "row_key", "same_row", "shared_folder", "written"]


def row_key() -> list:
    """Columns that tell documents apart: the id and a hash of the text.

    Rows equal in both have equal texts, so an operator gives them the same
    result and need not tell them apart.
    """
    return [F.col("doc_id"), F.xxhash64("text").alias("text_key")]


def same_row(a: DataFrame, b: DataFrame):
    """The join condition on ``row_key``; a null id equals a null id."""
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])


def ranked(groups: DataFrame, by: list[str]) -> DataFrame:
    """``groups`` with rank: the sum of ``n`` over the groups before each in the order of ``by``.

    Groups are dealt by ranges; the driver's part is a row for each partition.
    """
    parts = groups.repartitionByRange(*by).sortWithinPartitions(*by).select("*", F.spark_partition_id().alias("part"))
    parts = written(parts, "groups")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = parts.groupBy("part").agg(F.sum("n").alias("n"))
    starts = sizes.select("part", before(Window.orderBy("part")).alias("start"))
    within = parts.select("*", before(Window.partitionBy("part").orderBy(*by)).alias("inside"))
    found = within.join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + F.col("inside"))
    found = written(found.drop("part", "start", "inside"), "ranks")
    dropped(parts)
    return found
