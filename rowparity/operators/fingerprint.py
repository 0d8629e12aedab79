"""Order-independent fingerprints of tables.

A lane is 48 bits of a digest.  A fingerprint is the count, the sums of the
halves of each lane and the XOR of the lanes: partial and final aggregation of
longs, whatever the order and the partitioning.  A field has one lane, the
record two.  Sums of 24-bit halves stay below 2^63 for 10^12 records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canon import field_digest, joined_digest, lane

LANES = 2
VALUES = ["n", *(f"{kind}_{k}" for k in range(LANES) for kind in ("high", "low", "xor"))]


def digests(df: DataFrame, fields: list[str], *more: Column) -> DataFrame:
    """The digest of each field as d0, d1, ..., of the record as record, and ``more``."""
    each = df.select(*more, *(field_digest(df, f).alias(f"d{i}") for i, f in enumerate(fields)))
    return each.select("*", joined_digest([F.col(f"d{i}") for i in range(len(fields))]).alias("record"))


def aggregates(fields: list[str]) -> list[Column]:
    """Over the lanes of ``lanes``: the fingerprints of all names, and the count n."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for name in [*(f"d{i}_0" for i in range(len(fields))), "record_0", "record_1"]:
        value = F.col(name)
        parts = {"high": F.sum(F.shiftright(value, 24)), "low": F.sum(value.bitwiseAND(F.lit(0xFFFFFF))), "xor": F.bit_xor(value)}
        aggs += [F.coalesce(part, F.lit(0)).alias(f"{kind}_{name}") for kind, part in parts.items()]
    return aggs


def lanes(found: DataFrame, fields: list[str], *more: str) -> DataFrame:
    """The lanes of ``digests``, and the columns ``more`` of it."""
    own = [lane(F.col(f"d{i}"), 0).alias(f"d{i}_0") for i in range(len(fields))]
    return found.select(*more, *own, *(lane(F.col("record"), k).alias(f"record_{k}") for k in range(LANES)))


def rows(fields: list[str]) -> Column:
    """The row of ``aggregates`` as an array of structs (name, n, high_0, ...), the record's last."""

    def one(name: str, column: str, count: int) -> Column:
        values = [(F.col(f"{kind}_{column}_{k}") if k < count else F.lit(0).cast("long")).alias(f"{kind}_{k}") for k in range(LANES) for kind in ("high", "low", "xor")]
        return F.struct(F.lit(name).alias("name"), F.col("n"), *values)

    return F.array(*(one(f, f"d{i}", 1) for i, f in enumerate(fields)), one("record", "record", LANES))


def fingerprints(df: DataFrame, fields: list[str]) -> DataFrame:
    """(name, n, high_0, low_0, xor_0, ...): a row for each field and one for the record, in one pass.

    An empty table has the count 0, sums 0 and XORs 0.
    """
    return lanes(digests(df, fields), fields).agg(*aggregates(fields)).select(F.inline(rows(fields)))


def compare(left: DataFrame, right: DataFrame, fields: list[str]) -> DataFrame:
    """(name, equal) of each field's values and of the records, as multisets."""
    sides = [fingerprints(df, fields).select("name", F.struct(*VALUES).alias(side)) for df, side in ((left, "a"), (right, "b"))]
    return sides[0].join(sides[1], "name").select("name", (F.col("a") == F.col("b")).alias("equal"))
