"""Changes and coverage along a numeric position, in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import floor_div, six_digits

WINDOW = 1_000_000


def windows(left: DataFrame, right: DataFrame, changes: DataFrame, width: int = WINDOW) -> DataFrame:
    """(contig, window, n_left, n_right, changes) over all windows of any of the three.

    Each table has contig and position; rows without a place are left out.
    One union and one aggregation.
    """
    parts = []
    for k, df in enumerate((left, right, changes)):
        ones = [F.lit(int(j == k)).cast("long").alias(n) for j, n in enumerate(("n_left", "n_right", "changes"))]
        parts.append(df.where("contig is not null and position >= 0").select("contig", floor_div(F.col("position"), width).alias("window"), *ones))
    rows = parts[0].union(parts[1]).union(parts[2])
    return rows.groupBy("contig", "window").agg(*(F.sum(c).alias(c) for c in ("n_left", "n_right", "changes")))


def density(counts: DataFrame, width: int = WINDOW, lengths: DataFrame | None = None) -> DataFrame:
    """Adds start, end (not beyond the contig's length), fraction = changes / max(1, n_left + n_right) and coverage_log2."""
    out = counts.withColumns({"start": F.col("window") * width, "end": (F.col("window") + 1) * width})
    if lengths is not None:
        out = out.join(lengths.select("contig", F.col("length").alias("__length")), "contig", "left").withColumn("end", F.least("end", F.coalesce("__length", "end"))).drop("__length")
    return out.withColumns({
        "fraction": F.col("changes") / F.greatest(F.lit(1), F.col("n_left") + F.col("n_right")),
        "coverage_log2": F.log2((F.col("n_right") + 1) / (F.col("n_left") + 1)),
    })


def contigs(counts: DataFrame) -> DataFrame:
    """As ``density``, by contig."""
    sums = counts.groupBy("contig").agg(*(F.sum(c).alias(c) for c in ("n_left", "n_right", "changes")))
    return sums.withColumns({
        "fraction": F.col("changes") / F.greatest(F.lit(1), F.col("n_left") + F.col("n_right")),
        "coverage_log2": F.log2((F.col("n_right") + 1) / (F.col("n_left") + 1)),
    })


def top(counts: DataFrame, n: int = 20) -> DataFrame:
    """The windows with the most changes; ties by contig and window."""
    return counts.where("changes > 0").orderBy(F.desc("changes"), "contig", "window").limit(n)


def bedgraph(rows: DataFrame, value: str) -> DataFrame:
    """Lines of a bedGraph track, sorted."""
    text = F.concat_ws(" ", "contig", F.col("start").cast("string"), F.col("end").cast("string"), six_digits(F.col(value)))
    return rows.orderBy("contig", "start").select(text.alias("value"))


def write_tracks(counts: DataFrame, path: str, width: int = WINDOW, lengths: DataFrame | None = None) -> None:
    """Writes the tracks of ``windows`` below ``path``: density, rate and coverage as bedGraph, and a summary by contig.

    The rate is at most 1, the density counts changes.  A track has a line
    for each window, so it is sorted into one file.
    """
    rows = density(counts, width, lengths)
    rows = rows.withColumns({"rate": F.least(F.lit(1.0), "fraction"), "density": F.col("changes").cast("double")})
    for value in ("density", "rate", "coverage_log2"):
        bedgraph(rows, value).coalesce(1).write.text(f"{path}/{value}.bedGraph")
    contigs(counts).orderBy(F.desc("changes"), "contig").coalesce(1).write.option("sep", "\t").option("header", True).csv(f"{path}/contig-summary.tsv")


def igv_batch(places: list[tuple[str, int]], files: list[str], genome: str, reach: int = 100) -> str:
    """A script for a genome browser that visits each place (from 0); without places it raises."""
    if not places:
        raise ValueError("no places to visit")
    lines = ["new", f"genome {genome}", *(f"load {f}" for f in files)]
    return "\n".join([*lines, *(f"goto {c}:{max(1, p + 1 - reach)}-{p + 1 + reach}" for c, p in places)]) + "\n"


def bed(places: DataFrame) -> DataFrame:
    """(value): lines of a BED track with the number of changes of a status at each place, sorted.

    ``places`` has contig, position and status.
    """
    counts = places.where("contig is not null and position >= 0").groupBy("contig", "position", "status").agg(F.count(F.lit(1)).alias("n"))
    text = F.concat_ws("\t", "contig", F.col("position").cast("string"), (F.col("position") + 1).cast("string"), F.concat("status", F.lit(";x"), F.col("n").cast("string")))
    return counts.orderBy("contig", "position", "status").select(text.alias("value"))
