"""Left-normalisation of variants against a reference in chunks.

A variant is trimmed and moved left while its alleles end alike.  The
reference is a table (contig, chunk, sequence) of chunks of equal length, so a
variant joins only the chunk before its own and its own; one that reaches the
start of what it sees takes another round further left.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written

CHUNK = 10_000


def read_fasta(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """(contig, chunk, sequence) of a FASTA file; a contig's lines are split at their ">" heads."""
    whole = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    head, body = F.substring_index("value", "\n", 1), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n", ""), r"\s", "")
    rows = whole.select(F.split_part(F.regexp_replace(head, r"\s+", " "), F.lit(" "), F.lit(1)).alias("contig"), F.upper(body).alias("s"))
    n = F.ceil(F.length("s") / chunk).cast("int")
    cut = rows.where(F.length("s") > 0).select("contig", "s", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    return cut.select("contig", F.col("chunk").cast("long").alias("chunk"), F.substring("s", F.col("chunk") * chunk + 1, F.lit(chunk)).alias("sequence"))


def shifted(pos: int, ref: str, alt: str, start: int, text: str) -> tuple[int, str, str, bool]:
    """(pos, ref, alt, stuck): moved left within ``text``, whose first base is at ``start``.

    stuck says that it would move on, but the text doesn't reach further.
    """
    while ref[-1] == alt[-1] and ref != alt:
        if len(ref) > 1 and len(alt) > 1:
            ref, alt = ref[:-1], alt[:-1]
            continue
        if pos <= start:
            return pos, ref, alt, pos > 1
        base = text[pos - 1 - start]
        pos, ref, alt = pos - 1, base + ref[:-1], base + alt[:-1]
    while len(ref) > 1 and len(alt) > 1 and ref[0] == alt[0]:
        pos, ref, alt = pos + 1, ref[1:], alt[1:]
    return pos, ref, alt, False


def left_normalized(records: DataFrame, reference: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``records`` (contig, pos, ref, alt, ...) with pos, ref and alt in their leftmost form.

    One alternate allele a row.  Symbolic alleles and variants without a
    reference stay as they are.
    """
    plain = (F.col("ref").rlike("^[ACGTNacgtn]+$") & F.col("alt").rlike("^[ACGTNacgtn]+$"))
    others = [c for c in records.columns if c not in ("pos", "ref", "alt")]
    schema = ", ".join([*(f"`{c}` {records.schema[c].dataType.simpleString()}" for c in others), "pos long, ref string, alt string, stuck boolean"])
    done = records.where(~plain | plain.isNull()).select(*others, F.col("pos").cast("long").alias("pos"), "ref", "alt")
    rows = records.where(plain)

    def move(batches):
        for df in batches:
            moved = [shifted(p, r.upper(), a.upper(), s, t) if t else (p, r, a, False) for p, r, a, s, t in zip(df.pos, df.ref, df.alt, df.start, df.text, strict=True)]
            yield pd.concat([df[others].reset_index(drop=True), pd.DataFrame(moved, columns=["pos", "ref", "alt", "stuck"])], axis=1)

    while True:
        seen = rows.withColumn("__chunk", F.floor((F.col("pos") - 1) / chunk).cast("long"))
        one, two = (reference.select(F.col("contig").alias(f"c{k}"), (F.col("chunk") + k).alias(f"k{k}"), F.col("sequence").alias(f"s{k}")) for k in (0, 1))
        for k, part in enumerate((one, two)):
            seen = seen.join(part, (F.col("contig") == F.col(f"c{k}")) & (F.col("__chunk") == F.col(f"k{k}")), "left")
        start = F.when(F.col("s1").isNull(), F.col("__chunk") * chunk + 1).otherwise((F.col("__chunk") - 1) * chunk + 1)
        seen = seen.select(*others, F.col("pos").cast("long").alias("pos"), "ref", "alt", start.cast("long").alias("start"), F.when(F.col("s0").isNotNull(), F.concat(F.coalesce("s1", F.lit("")), "s0")).alias("text"))
        moved = written(seen.mapInPandas(move, schema), "moved")
        done = done.unionByName(moved.where("not stuck").drop("stuck"))
        rows = moved.where("stuck").drop("stuck")
        if rows.isEmpty():
            return done
