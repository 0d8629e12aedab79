"""Bottom-k sketches of distinct digests, and what they estimate."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 512


def kmv(digests: DataFrame, size: int = SIZE) -> DataFrame:
    """The ``size`` least different digests of a column ``h``; a task keeps no more before the merge."""

    def least(batches):
        kept = pa.array([], pa.string())
        for batch in batches:
            both = pc.unique(pa.concat_arrays([kept, batch.column(0).cast(pa.string())]))
            kept = both.take(pc.array_sort_indices(both)[:size])
        yield pa.RecordBatch.from_arrays([kept], names=["h"])

    found = digests.select("h").where("h is not null").mapInArrow(least, "h string")
    return found.distinct().orderBy("h").limit(size)


def cardinality(sketch: DataFrame, size: int = SIZE) -> DataFrame:
    """(n): exact below ``size`` digests, else estimated from the greatest one's leading 52 bits."""
    part = F.conv(F.substring(F.max("h"), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    return sketch.agg(F.when(F.count(F.lit(1)) < size, F.count(F.lit(1)).cast("double")).otherwise((size - 1) / part).alias("n"))


def _overlap(left: DataFrame, right: DataFrame, size: int) -> DataFrame:
    both = left.select("h", F.lit(1).alias("a"), F.lit(0).alias("b")).union(right.select("h", F.lit(0), F.lit(1)))
    least = both.groupBy("h").agg(F.max("a").alias("a"), F.max("b").alias("b")).orderBy("h").limit(size)
    return least.agg(F.count(F.lit(1)).alias("sampled"), F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("shared"))


def containment(left: DataFrame, right: DataFrame, size: int = SIZE) -> DataFrame:
    """(sampled, shared, containment) of two sketches: the intersection's share of the smaller set.

    Exact while the union is smaller than the sketch.  Two empty sets contain
    each other; an empty and another don't.
    """
    counts = cardinality(left, size).withColumnRenamed("n", "n_a").crossJoin(cardinality(right, size).withColumnRenamed("n", "n_b"))
    rows = _overlap(left, right, size).crossJoin(counts)  # one row each
    j = F.col("shared") / F.greatest(F.col("sampled"), F.lit(1))
    least = F.least("n_a", "n_b")
    share = F.least(F.lit(1.0), j * (F.col("n_a") + F.col("n_b")) / (1 + j) / F.greatest(least, F.lit(1.0)))
    value = F.when(F.greatest("n_a", "n_b") == 0, 1.0).when(least == 0, 0.0).otherwise(share)
    return rows.select("sampled", "shared", value.alias("containment"))


def exact_containment(left: DataFrame, right: DataFrame) -> DataFrame:
    """(n_a, n_b, shared, containment) from the whole sets of ``h``."""
    both = left.select("h", F.lit(1).alias("a"), F.lit(0).alias("b")).union(right.select("h", F.lit(0), F.lit(1)))
    sets = both.groupBy("h").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    rows = sets.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for n, c in (("n_a", F.col("a")), ("n_b", F.col("b")), ("shared", F.col("a") * F.col("b")))))
    least = F.least("n_a", "n_b")
    return rows.withColumn("containment", F.when(F.greatest("n_a", "n_b") == 0, 1.0).when(least == 0, 0.0).otherwise(F.col("shared") / F.greatest(least, F.lit(1))))


def relationship(overlap: Column, equal: Column, empty: Column) -> Column:
    """The label of two tables' relation."""
    # fixed values: the labels and their limits
    return (
        F.when(empty, "empty datasets")
        .when(equal, "identical logical records")
        .when(overlap >= 0.98, "likely the same dataset")
        .when(overlap >= 0.20, "related datasets")
        .otherwise("different datasets")
    )
