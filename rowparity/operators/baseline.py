"""Hash-only baselines: what a set of tables looked like, without their records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fingerprint import VALUES, fingerprints


def schema_digest(df: DataFrame, fields: list[str]) -> str:
    """The structure: names and types of the fields, in order."""
    import hashlib

    return hashlib.sha256("\n".join(f"{f}:{df.schema[f].dataType.simpleString()}" for f in fields).encode()).hexdigest()


def create(tables: dict[tuple[str, str], DataFrame], fields: list[str]) -> DataFrame:
    """(sample, stage, structure, name, n, sums and XORs): a baseline of several tables."""
    found = None
    for (sample, stage), df in tables.items():
        part = fingerprints(df, fields).select(F.lit(sample).alias("sample"), F.lit(stage).alias("stage"), F.lit(schema_digest(df, fields)).alias("structure"), "name", *VALUES)
        found = part if found is None else found.unionByName(part)
    return found


def validated(found: DataFrame) -> DataFrame:
    """``found`` if it is a baseline; else what is wrong with it raises.

    Values may not be missing, as they are where a line can't be read; each
    stage has one structure, each field once, and the record.
    """
    missing = F.lit(False)
    for c in ("sample", "stage", "structure", "name", *VALUES):
        missing = missing | F.col(c).isNull()
    stages = found.groupBy("sample", "stage").agg(
        F.bool_or(missing).alias("missing"), (F.count("name") > F.count_distinct("name")).alias("repeated"),
        (F.count_distinct("structure") > 1).alias("structures"), F.bool_or(F.col("name") == "record").alias("whole"),
    )
    faults = F.concat_ws(
        ", ", F.when(F.col("missing"), "missing values"), F.when(F.col("repeated"), "repeated fields"),
        F.when(F.col("structures"), "several structures"), F.when(~F.coalesce("whole", F.lit(False)), "no record"),
    ).alias("faults")
    rows = stages.select("sample", "stage", faults).orderBy(F.col("faults") == "", "sample", "stage").limit(1).collect()
    if not rows:
        raise ValueError("the baseline is empty")
    if rows[0]["faults"]:
        raise ValueError(f"the baseline's {rows[0]['sample']} / {rows[0]['stage']} has {rows[0]['faults']}")
    return found


def check(before: DataFrame, after: DataFrame) -> DataFrame:
    """(sample, stage, passed, changed_fields): a full outer comparison of two baselines.

    It passes if the records' fingerprints and the structures are equal; a
    stage that one baseline lacks fails.  Changed fields say where to look.
    """
    values = F.struct("structure", *VALUES)
    sides = [df.select("sample", "stage", "name", values.alias(side)) for df, side in ((before, "a"), (after, "b"))]
    both = sides[0].join(sides[1], ["sample", "stage", "name"], "fullouter")
    equal = F.col("a").eqNullSafe(F.col("b"))
    return both.groupBy("sample", "stage").agg(
        F.coalesce(F.bool_and(F.when(F.col("name") == "record", equal)), F.lit(False)).alias("passed"),
        F.array_sort(F.collect_set(F.when((F.col("name") != "record") & ~equal, F.col("name")))).alias("changed_fields"),
    )
