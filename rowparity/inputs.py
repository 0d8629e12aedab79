"""Two paths as a comparison: by their kind, the tables, keys, fields, labels and differences of structure."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

from . import genomics
from .cache import cached
from .compare import Comparison, compare
from .genomics import Options


@dataclass
class Pair:
    """What ``compare`` needs of two inputs."""

    left: DataFrame
    right: DataFrame
    keys: list[str]
    fields: list[str] | None
    labels: Callable[[DataFrame], Column] | None = None
    structure: list[str] | None = None
    kind: str | None = None
    contigs: dict[str, int | None] | None = None

    def compare(self, names: tuple[str, str] = ("first", "second"), explain: bool = True, use: Callable[[DataFrame], None] | None = None, examples: int = 0) -> Comparison:
        by: dict[str, int] = {}

        def seen(found: DataFrame) -> None:
            if self.kind:
                by.update(genomics.attribution(found, self.kind))
            if use:
                use(found)

        out = compare(
            self.left, self.right, self.keys, self.fields, explain, names=names, labels=self.labels, structure=self.structure,
            use=seen if self.kind or use else None, examples=examples,
        )
        out.attribution = by
        if explain and self.kind and not out.content_equal:
            out.shifts = genomics.shifts(self.left, self.right, self.kind, self.fields)
        return out


def load(spark: SparkSession, path: str, cache: str | None = None) -> DataFrame:
    """A table by its suffix; Parquet if it has none that is known.

    Decoded alignments and variants are kept in the folder ``cache``.
    """
    name = path.rstrip("/").lower()
    if genomics.kind_of(path):
        if cache:
            return cached(spark, cache, path, lambda: genomics.read(spark, path))
        return genomics.read(spark, path)
    if name.endswith(".cram"):
        raise ValueError(f"{path}: CRAM isn't supported; convert it to BAM")
    if name.endswith(".csv"):
        return spark.read.option("header", True).csv(path)
    if name.endswith(".json"):
        return spark.read.json(path)
    if name.endswith(".orc"):
        return spark.read.orc(path)
    return spark.read.parquet(path)


def lengths(*structures: dict[str, dict[str, object]]) -> dict[str, int]:
    """The greatest length of each contig in some headers, of those that have one."""
    out: dict[str, int] = {}
    for found in structures:
        for name, n in found.get("contig", {}).items():
            if n not in (None, ""):
                out[name] = max(out.get(name, 0), int(n))
    return out


def pair(spark: SparkSession, first: str, second: str, keys: list[str] | None = None, fields: list[str] | None = None, profile: str = "strict", options: Options = Options(), cache: str | None = None) -> Pair:
    """Two inputs of one kind; plain tables need ``keys`` and have no profiles.

    Keys or fields that are given go before those of the kind.
    """
    kind, other = genomics.kind_of(first), genomics.kind_of(second)
    if kind != other:
        raise ValueError(f"{first} and {second} are files of different kinds")
    if kind is None:
        if not keys:
            raise ValueError("--keys is needed for this kind of file")
        return Pair(load(spark, first), load(spark, second), keys, fields)
    headers = [genomics.structure(spark, p) for p in (first, second)]
    sides = [genomics.prepare(load(spark, p, cache), kind, options, genomics.vcf_numbers(h)) for p, h in zip((first, second), headers, strict=True)]
    compared = fields or genomics.fields_for(kind, profile)
    return Pair(*sides, keys or genomics.KEYS[kind], compared, lambda found: genomics.labels(found, compared), genomics.structure_messages(*headers), kind, lengths(*headers))
