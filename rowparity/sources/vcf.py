"""VCF text as tables, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.buckets import six_digits


def header(spark: SparkSession, path: str) -> DataFrame:
    """(section, name, value) of the header's definitions, and the sample names."""
    lines = spark.read.text(path).where(F.col("value").startswith("#"))
    defined = lines.where(F.col("value").rlike(r"^##(contig|INFO|FORMAT|FILTER)=<"))
    get = lambda key: F.regexp_extract("value", rf"[<,]{key}=([^,>]*)", 1)
    section = F.lower(F.regexp_extract("value", r"^##(\w+)=", 1))
    detail = F.when(section == "contig", get("length")).otherwise(F.concat_ws(":", get("Number"), get("Type")))
    names = lines.where(F.col("value").startswith("#CHROM")).select(F.posexplode(F.split("value", "\t")).alias("k", "name")).where("k > 8")
    return defined.select(section.alias("section"), get("ID").alias("name"), detail.alias("value")).union(names.select(F.lit("sample"), "name", F.col("k").cast("string")))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records (contig, pos, stop, identifiers, alleles, quality, filters, info, samples) of plain or gzipped VCF.

    info maps keys to texts (flags to "true"), a text being all that follows
    the first "="; of a key that a record repeats the last value counts.
    samples maps names to structs of the FORMAT values and whether the
    genotype is phased.
    """
    names = [r["name"] for r in header(spark, path).where("section = 'sample'").orderBy(F.col("value").cast("int")).collect()]
    cells = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != "")).select(cells.alias("c"))
    none = lambda c: F.when(c != ".", c)
    info = _info(F.split(F.get("c", F.lit(7)), ";"))
    keys = F.split(F.get("c", F.lit(8)), ":")

    def sample(k: int):
        values = F.split(F.get("c", F.lit(9 + k)), ":")
        zipped = F.zip_with(keys, values, lambda a, b: F.struct(a.alias("key"), b.alias("value")))
        return F.struct(F.map_from_entries(zipped).alias("values"), F.contains(F.get(values, F.lit(0)), F.lit("|")).alias("phased"))

    samples = F.create_map(*(x for k, name in enumerate(names) for x in (F.lit(name), sample(k)))) if names else F.create_map().cast("map<string,struct<values:map<string,string>,phased:boolean>>")
    pos, ref = F.get("c", F.lit(1)).cast("long"), F.get("c", F.lit(3))
    other = F.filter(F.split(F.get("c", F.lit(4)), ","), lambda x: x != ".")
    filters = F.filter(F.split(F.get("c", F.lit(6)), ";"), lambda x: x != ".")
    return rows.select(
        F.get("c", F.lit(0)).alias("contig"), pos.alias("pos"), F.coalesce(F.element_at(info, "END").cast("long"), pos + F.length(ref) - 1).alias("stop"),
        none(F.get("c", F.lit(2))).alias("identifiers"), F.concat(F.array(ref), other).alias("alleles"), none(F.get("c", F.lit(5))).cast("double").alias("quality"),
        F.array_sort(filters).alias("filters"), info.alias("info"), samples.alias("samples"),
    )


def _info(entries: Column) -> Column:
    """INFO entries as a map; empty entries and "." are none."""
    name = lambda x: F.substring_index(x, "=", 1)
    last = F.filter(
        entries,
        lambda x, i: ~name(x).isin(".", "") & ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda y: name(y) == name(x)),
    )
    value = lambda x: F.when(F.contains(x, F.lit("=")), F.substring(x, F.length(name(x)) + 2, F.length(x))).otherwise("true")
    return F.map_from_entries(F.transform(last, lambda x: F.struct(name(x).alias("key"), value(x).alias("value"))))


def genotypes(records: DataFrame) -> DataFrame:
    """Records (contig, pos, alleles, samples) with samples as maps of names to allele numbers; null where one is missing."""
    numbers = lambda gt: F.transform(F.split(gt, r"[/|]"), lambda x: x.try_cast("int"))
    calls = F.transform_values("samples", lambda _, s: numbers(F.coalesce(F.element_at(s["values"], "GT"), F.lit("."))))
    return records.select("contig", "pos", "alleles", calls.alias("samples"))


def split_alleles(records: DataFrame) -> DataFrame:
    """A row for each alternate allele."""
    return records.select(*(c for c in records.columns if c != "alleles"), F.explode(F.slice("alleles", 2, F.size("alleles"))).alias("alt"), F.col("alleles")[0].alias("ref")).withColumn("alleles", F.array("ref", "alt")).drop("ref", "alt")


def write(records: DataFrame, path: str) -> None:
    """Writes records as VCF text without samples: a header in each part file is left to the reader's ``header``."""
    entry = lambda e: F.when(e["value"] == "true", e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"]))
    info = F.array_join(F.transform(F.array_sort(F.map_entries("info")), entry), ";")
    dot = lambda c: F.when(c.isNull() | (c == ""), ".").otherwise(c)
    others = F.array_join(F.slice("alleles", 2, F.size("alleles")), ",")
    line = F.concat_ws("\t", "contig", F.col("pos").cast("string"), dot(F.col("identifiers")), F.col("alleles")[0], dot(others), dot(F.col("quality").cast("string")), dot(F.array_join("filters", ";")), dot(info))
    records.select(line.alias("value")).write.text(path)


def _values(keys: Column, values: Column) -> Column:
    return F.transform(keys, lambda k: F.coalesce(F.element_at(values, k), F.lit(".")))


def lines(records: DataFrame, samples: list[str]) -> DataFrame:
    """(value): records as lines of VCF with the columns of ``samples``, in place order; genotypes come first."""
    entry = lambda e: F.when(e["value"] == "true", e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"]))
    dot = lambda c: F.when(c.isNull() | (c == ""), ".").otherwise(c)
    info = F.array_join(F.transform(F.array_sort(F.map_entries("info")), entry), ";")
    cells = ["contig", F.col("pos").cast("string"), dot(F.col("identifiers")), F.col("alleles")[0], dot(F.array_join(F.slice("alleles", 2, F.size("alleles")), ",")), dot(six_digits(F.col("quality"))), dot(F.array_join("filters", ";")), dot(info)]
    if samples:
        named = F.array_sort(F.array_distinct(F.flatten(F.transform(F.map_values("samples"), lambda s: F.map_keys(s["values"])))))
        keys = F.concat(F.filter(named, lambda k: k == "GT"), F.filter(named, lambda k: k != "GT"))
        cells.append(dot(F.array_join(keys, ":")))
        cells += [dot(F.array_join(_values(keys, F.element_at("samples", n)["values"]), ":")) for n in samples]
    return records.orderBy("contig", "pos", "alleles").select(F.concat_ws("\t", *cells).alias("value"))


def header_text(spark: SparkSession, path: str) -> list[str]:
    """The lines of the header."""
    return [r["value"] for r in spark.read.text(path).where(F.col("value").startswith("#")).collect()]
