"""Buckets and labels of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_div(value: Column, step: float) -> Column:
    """Division rounded down, also below zero."""
    return F.floor(value / F.lit(step)).cast("long")


def bucket(value: Column, step: int, most: int) -> Column:
    """The least multiple of ``step`` in the value's bucket, at most ``most``; null stays null."""
    return F.when(value.isNotNull(), F.least(F.lit(most).cast("long"), floor_div(value, step) * step))


def half_even(value: Column, parts: int) -> Column:
    """The value rounded, half to even, to the nearest of ``parts`` in one."""
    return F.bround(value * parts) / parts


def slug(text: Column) -> Column:
    """Lower-case words joined by dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def value_text(value: Column) -> Column:
    """A value in a transition label; null is missing."""
    return F.coalesce(value.cast("string"), F.lit("missing"))


def list_text(values: Column) -> Column:
    """A list in a transition label, joined by slashes, with a dot for null."""
    return F.coalesce(F.array_join(values, "/", "."), F.lit("missing"))


def transition(name: str, first: Column, second: Column) -> Column:
    """The label "name: first → second"."""
    return F.concat(F.lit(f"{name}: "), value_text(first), F.lit(" → "), value_text(second))


def flag_states(flags: Column) -> Column:
    """The states that the bits of an alignment record's flags say, by label."""
    bit = lambda n: flags.bitwiseAND(F.lit(n)) != 0
    return F.create_map(
        F.lit("mapping status"), F.when(bit(4), "unmapped").otherwise("mapped"),
        F.lit("alignment class"), F.when(bit(0x800), "supplementary").when(bit(0x100), "secondary").otherwise("primary"),
        F.lit("duplicate flag"), F.when(bit(0x400), "set").otherwise("clear"),
        F.lit("QC status"), F.when(bit(0x200), "failed").otherwise("passed"),
        F.lit("strand"), F.when(bit(0x10), "reverse").otherwise("forward"),
    )


def six_digits(value: Column) -> Column:
    """A number with six significant digits, short: 0.25, 1e-05, 1.5e+06; null stays null."""
    text = F.format_string("%.5e", value.cast("double"))
    power = F.substring_index(text, "e", -1)
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    fixed = bare(text.try_cast("decimal(38,10)").cast("string"))
    short = F.when(power.try_cast("int").between(-4, 5), fixed).otherwise(F.concat(bare(F.substring_index(text, "e", 1)), F.lit("e"), power))
    return F.when(value.isNotNull(), short)
