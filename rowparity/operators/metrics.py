"""Distributions of metrics on two sides, and how far they moved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BINS, LEAST, TOP = 32, 0.01, 6


def histograms(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """(metric, bucket, n) of bucketed columns, in one pass; null buckets are skipped."""
    parts = [F.struct(F.lit(name).alias("metric"), value.cast("double").alias("bucket")) for name, value in metrics.items()]
    return df.select(F.inline(F.array(*parts))).where("bucket is not null").groupBy("metric", "bucket").agg(F.count(F.lit(1)).alias("n"))


def distances(left: DataFrame, right: DataFrame) -> DataFrame:
    """(metric, n_left, n_right, distance): total variation of two tables of ``histograms``.

    Metrics with an empty side are left out.
    """
    both = left.select("metric", "bucket", F.col("n").alias("a"), F.lit(0).cast("long").alias("b")).union(right.select("metric", "bucket", F.lit(0).cast("long"), "n"))
    both = both.groupBy("metric", "bucket").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sums = both.groupBy("metric").agg(F.sum("a").alias("n_left"), F.sum("b").alias("n_right")).where("n_left > 0 and n_right > 0")
    each = both.join(sums, "metric")
    return each.groupBy("metric", "n_left", "n_right").agg((F.sum(F.abs(F.col("a") / F.col("n_left") - F.col("b") / F.col("n_right"))) / 2).alias("distance"))


def shifts(left: DataFrame, right: DataFrame, least: float = LEAST, n: int = TOP) -> DataFrame:
    """The metrics that moved most; ties by name."""
    return distances(left, right).where(F.col("distance") >= least).orderBy(F.desc("distance"), "metric").limit(n)


def medians(histogram: DataFrame) -> DataFrame:
    """(metric, median): the mean of the lower and the upper median over the counts."""
    return histogram.groupBy("metric").agg(F.percentile("bucket", 0.5, F.col("n")).alias("median"))


def bins(histogram: DataFrame, most: int = BINS) -> DataFrame:
    """(metric, bin, low, high, n) of at most ``most`` runs of consecutive different buckets."""
    nth = F.row_number().over(Window.partitionBy("metric").orderBy("bucket")) - 1
    size = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("metric")) / F.lit(float(most)))
    return histogram.withColumn("bin", F.floor(nth / size).cast("long")).groupBy("metric", "bin").agg(F.min("bucket").alias("low"), F.max("bucket").alias("high"), F.sum("n").alias("n"))
