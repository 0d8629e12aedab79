"""Differences of structure: schemas, and named sets of definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def schema_rows(df: DataFrame) -> DataFrame:
    """(name, value): the table's columns and their types."""
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "name string, value string")


def differences(first: DataFrame, second: DataFrame) -> DataFrame:
    """(name, change): names added, removed or changed between two tables (name, value)."""
    a, b = first.select("name", F.col("value").alias("a"), F.lit(True).alias("in_a")), second.select("name", F.col("value").alias("b"), F.lit(True).alias("in_b"))
    both = a.join(b, "name", "fullouter")
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select("name", change.alias("change")).where("change is not null")


def messages(label: str, found: DataFrame, most: int = 10) -> list[str]:
    """Sentences on differences; long lists are cut at ``most`` names."""
    names: dict[str, list[str]] = {}
    for row in found.orderBy("name").collect():
        names.setdefault(row["change"], []).append(row["name"])
    return [f"{label} {change}: {', '.join(names[change][:most])}" for change in ("added", "removed", "changed") if change in names]


def compatible(first: dict[str, int], second: dict[str, int]) -> bool:
    """Whether two reference definitions (contig to length) share four fifths of their names, and no length differs."""
    shared, union = first.keys() & second.keys(), first.keys() | second.keys()
    return not union or (len(shared) / len(union) >= 0.8 and all(first[c] == second[c] for c in shared))
