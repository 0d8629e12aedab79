"""Similarity of many tables at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def similarities(digests: DataFrame) -> DataFrame:
    """(a, b, shared, similarity) of every pair a < b of tables (``name``, ``h``).

    The similarity is the shared digests' share of the smaller set, scaled by
    the tables' sizes.  Digests are counted by table first; a digest joins
    tables, of which there are few, not records.
    """
    counts = digests.groupBy("name", "h").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("name").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("records"))
    names = counts.groupBy("h").agg(F.array_sort(F.collect_list("name")).alias("names"))
    pair = F.flatten(F.transform("names", lambda x, i: F.transform(F.filter("names", lambda y, j: j > i), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    shared = names.select(F.explode(pair).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("shared"))
    one, two = (sizes.select(F.col("name").alias(s), F.col("kinds").alias(f"kinds_{s}"), F.col("records").alias(f"records_{s}")) for s in "ab")
    every = one.join(two, F.col("a") < F.col("b")).join(shared, ["a", "b"], "left").fillna(0, ["shared"])  # pairs of tables
    value = F.col("shared") / F.least("kinds_a", "kinds_b") * F.least("records_a", "records_b") / F.greatest("records_a", "records_b")
    return every.select("a", "b", "shared", value.alias("similarity"))


def means(pairs: DataFrame) -> DataFrame:
    """(name, mean): the mean similarity of each table to the others."""
    both = pairs.select(F.col("a").alias("name"), "similarity").union(pairs.select("b", "similarity"))
    return both.groupBy("name").agg(F.avg("similarity").alias("mean"))


def outliers(pairs: DataFrame, below: float = 0.15) -> DataFrame:
    """The tables whose mean lies more than ``below`` under the median of the means."""
    found = means(pairs)
    return found.crossJoin(found.agg(F.median("mean").alias("middle"))).where(F.col("mean") < F.col("middle") - below).select("name", "mean")  # one row


def order(names: list[str], value: dict[tuple[str, str], float]) -> list[str]:
    """The tables in the order of average-linkage clusters, so that like ones are neighbours.

    ``total`` holds the sums of similarities between clusters.  The two with
    the greatest mean, the first such pair, become one, whose sums are those
    of its parts; of its two arrangements the one with likelier neighbours at
    the seam is taken.
    """
    n = len(names)
    like = np.array([[1.0 if a == b else value[min(a, b), max(a, b)] for b in names] for a in names], float).reshape(n, n)
    total, chains = like.copy(), [[k] for k in range(n)]
    while len(chains) > 1:
        size = np.array(list(map(len, chains)), float)
        mean = np.where(np.triu(np.ones_like(total), 1) > 0, total / np.outer(size, size), -np.inf)
        i, j = np.unravel_index(np.argmax(mean), mean.shape)
        one, two = chains[i], chains[j]
        joined = two + one if like[one[-1], two[0]] < like[two[-1], one[0]] else one + two
        keep = [k for k in range(len(chains)) if k not in (i, j)]
        merged = total[i] + total[j]
        grown = np.zeros((len(keep) + 1, len(keep) + 1))
        grown[:-1, :-1] = total[np.ix_(keep, keep)]
        grown[-1, :-1] = grown[:-1, -1] = merged[keep]
        total, chains = grown, [*(chains[k] for k in keep), joined]
    return [names[k] for chain in chains for k in chain]
