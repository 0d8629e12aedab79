"""Canonical text of typed values, and digests of it.

Two values have one canonical text if and only if they are equal and of one
kind: 1, "1" and true differ, null differs from everything, an int equals a
long, -0.0 equals 0.0, NaN equals NaN, and the order of a map's entries
doesn't matter.  Strings carry their length, so fields can't run together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def canonical(value: Column, kind: T.DataType) -> Column:
    """The canonical text of a column of the type ``kind``."""
    if isinstance(kind, T.NullType):
        return F.lit("n")
    if isinstance(kind, T.BooleanType):
        text = F.when(value, "b1").otherwise("b0")
    elif isinstance(kind, _INTEGERS):
        text = F.concat(F.lit("i"), value.cast("string"))
    elif isinstance(kind, T.DecimalType):
        text = F.concat(F.lit("d"), value.cast("string"))
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        number = value.cast("double")
        text = F.concat(F.lit("f"), F.when(number == 0, F.lit("0.0")).otherwise(number.cast("string")))
    elif isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        text = F.concat(F.lit("s"), F.length(value).cast("string"), F.lit(":"), value)
    elif isinstance(kind, T.BinaryType):
        text = F.concat(F.lit("x"), F.hex(value))
    elif isinstance(kind, T.DateType):
        text = F.concat(F.lit("D"), F.unix_date(value).cast("string"))
    elif isinstance(kind, T.TimestampType):
        text = F.concat(F.lit("T"), F.unix_micros(value).cast("string"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.concat_ws(",", F.transform(value, lambda x: canonical(x, kind.elementType))), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entry = T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
        text = F.concat(F.lit("{"), F.concat_ws(",", F.array_sort(F.transform(F.map_entries(value), lambda x: canonical(x, entry)))), F.lit("}"))
    elif isinstance(kind, T.StructType):
        parts = [canonical(value.getField(f.name), f.dataType) for f in kind.fields]
        text = F.concat(F.lit("("), F.concat_ws(",", *parts), F.lit(")")) if parts else F.lit("()")
        return F.when(value.isNull(), "n").otherwise(text)
    else:
        text = F.concat(F.lit("o"), value.cast("string"))
    return F.coalesce(text, F.lit("n"))


def field_digest(df: DataFrame, name: str, bits: int = 128) -> Column:
    """The digest of one field: MD5, or SHA-256 with 256 bits."""
    text = canonical(df[f"`{name}`"], df.schema[name].dataType).cast("binary")
    return F.md5(text) if bits == 128 else F.sha2(text, bits)


def record_digest(df: DataFrame, fields: list[str], bits: int = 128) -> Column:
    """The digest of a record: of its fields' digests, in order."""
    return joined_digest([field_digest(df, f, bits) for f in fields], bits)


def joined_digest(digests: list[Column], bits: int = 128) -> Column:
    """The digest of a record from those of its fields."""
    joined = F.concat(*digests).cast("binary")
    return F.md5(joined) if bits == 128 else F.sha2(joined, bits)


def lane(digest: Column, k: int) -> Column:
    """The k-th 48 bits of a hex digest, as a long."""
    return F.conv(F.substring(digest, 1 + 12 * k, 12), 16, 10).cast("long")


def limb(digest: Column, k: int) -> Column:
    """The k-th 32 bits of a hex digest, as a long."""
    return F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long")
