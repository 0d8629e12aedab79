"""Manifests of comparisons: reading, checking, and pairing two trees of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("sample", "stage", "before", "after")
SUFFIXES = (".vcf.gz", ".vcf.bgz", ".vcf", ".bcf", ".bam", ".cram", ".parquet", ".csv")
OPTIONAL = ("profile", "reference", "normalize")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a tab-separated manifest; missing or unknown columns, empty cells and repeated (sample, stage) raise."""
    rows = spark.read.option("sep", "\t").option("header", True).option("comment", "#").csv(path)
    if missing := [c for c in REQUIRED if c not in rows.columns]:
        raise ValueError(f"manifest is missing columns: {', '.join(missing)}")
    if unknown := [c for c in rows.columns if c not in REQUIRED + OPTIONAL]:
        raise ValueError(f"manifest has unknown columns: {', '.join(unknown)}")
    if not rows.where(" or ".join(f"{c} is null" for c in REQUIRED)).isEmpty():
        raise ValueError("manifest has empty cells")
    twice = rows.groupBy("sample", "stage").count().where("count > 1").orderBy("sample", "stage").first()
    if twice:
        raise ValueError(f"duplicate sample and stage: {twice['sample']}, {twice['stage']}")
    return rows


def pair(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, sample, stage, status) of two listings (path) of relative paths "stage/sample.suffix"."""
    a, b = before.select("path", F.lit(True).alias("in_before")), after.select("path", F.lit(True).alias("in_after"))
    both = a.join(b, "path", "fullouter")
    name = F.regexp_replace(F.substring_index("path", "/", -1), rf"({'|'.join(x.replace('.', '[.]') for x in SUFFIXES)})$", "")
    status = F.when(F.col("in_after").isNull(), "missing after").when(F.col("in_before").isNull(), "missing before").otherwise("paired")
    return both.select("path", name.alias("sample"), F.split_part("path", F.lit("/"), F.lit(1)).alias("stage"), status.alias("status"))
