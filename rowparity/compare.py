"""Comparing two tables: the verdict, and what explains it."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.canon import record_digest
from .operators import fingerprint, headers, match, sketch

#: Logarithm of the digests that a sketch keeps; up to so many different ones shares are exact, beyond within some 2 %.
SKETCH = 12


@dataclass
class Comparison:
    """What ``compare`` found; ``details`` are there if it was asked to explain."""

    first: str
    second: str
    n_left: int
    n_right: int
    content_equal: bool
    structure_equal: bool
    changed_fields: list[str]
    overlap: float
    similarity: float
    relation: str
    identical: int | None = None
    modified: int | None = None
    left_only: int | None = None
    right_only: int | None = None
    field_changes: dict[str, int] = field(default_factory=dict)
    transitions: dict[str, int] = field(default_factory=dict)
    structure: list[str] = field(default_factory=list)
    shifts: list[dict] = field(default_factory=list)
    attribution: dict[str, int] = field(default_factory=dict)
    examples: list[dict] = field(default_factory=list)

    @property
    def equivalent(self) -> bool:
        return self.content_equal and self.structure_equal

    def to_dict(self) -> dict:
        out = asdict(self) | {"equivalent": self.equivalent}
        out["only_in_first"], out["only_in_second"] = out.pop("left_only"), out.pop("right_only")
        return out

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2, sort_keys=True)


def labels(first: str, second: str) -> tuple[str, str]:
    """Names for two paths: without the suffix of the format and one of processing; parents tell equal names apart."""
    formats = r"\.(vcf\.gz|vcf\.bgz|vcf|bcf|bam|cram|parquet|csv)$"
    steps = r"\.(merged|sorted|deduplicated|dedup|markdup|aligned)$"
    parts = [p.rstrip("/").split("/") for p in (first, second)]
    names = [re.sub(steps, "", re.sub(formats, "", p[-1])) for p in parts]
    if names[0] != names[1]:
        return names[0], names[1]
    longer = ["/".join([*p[-2:-1], n]) for p, n in zip(parts, names, strict=True)]
    return (longer[0], longer[1]) if longer[0] != longer[1] else (f"{names[0]} (A)", f"{names[1]} (B)")


def _scan(df: DataFrame, keys: list[str], fields: list[str], side: int) -> DataFrame:
    """One row, in one pass: the fingerprints of all fields and the record, and sketches of the keys and records."""
    found = fingerprint.digests(df, fields, record_digest(df, keys).alias("key"))
    found = fingerprint.lanes(found, fields, "key", "record")
    sketches = [F.theta_sketch_agg(c, F.lit(SKETCH)).alias(name) for c, name in (("key", "identity"), ("record", "content"))]
    row = found.agg(*fingerprint.aggregates(fields), *sketches)
    return row.select(F.lit(side).alias("side"), "n", "identity", "content", fingerprint.rows(fields).alias("names"))


def _containment(a: float, b: float, both: float) -> float:
    """The intersection's share of the smaller set; two empty sets contain each other."""
    if not max(a, b):
        return 1.0
    return min(1.0, both / min(a, b)) if min(a, b) else 0.0


def compare(
    left: DataFrame, right: DataFrame, keys: list[str], fields: list[str] | None = None, explain: bool = False,
    transitions: list[Column] | None = None, names: tuple[str, str] = ("first", "second"),
    labels: Callable[[DataFrame], Column] | None = None, structure: list[str] | None = None, use: Callable[[DataFrame], None] | None = None,
    examples: int = 0,
) -> Comparison:
    """Compares two tables by ``keys`` over ``fields`` (all shared columns).

    Equal fingerprints end the work: all records are identical and nothing is
    matched.  Fields of one side alone, or of another type, are differences
    of structure, unless ``structure`` names those.  ``labels`` makes an array
    of transitions from the changes, instead of ``transitions``; ``use`` is
    called with the changes before they are let go.  The first ``examples``
    changes in the order of the keys are part of what is found.
    """
    shared = [c for c in left.columns if c in right.columns]
    fields = fields or shared
    if structure is None:
        structure = headers.messages("Columns", headers.differences(headers.schema_rows(left), headers.schema_rows(right)))
    sides = [_scan(df, keys, fields, side) for side, df in enumerate((left, right))]
    found = sides[0].union(sides[1]).agg(*(F.max(F.when(F.col("side") == k, F.struct("names", "n", "identity", "content"))).alias(c) for k, c in enumerate("ab")))
    estimate = lambda c: F.theta_sketch_estimate(c)
    shares = {f"{what}_{part}": value for what in ("identity", "content") for part, value in (
        ("a", estimate(F.col(f"a.{what}"))), ("b", estimate(F.col(f"b.{what}"))), ("both", estimate(F.theta_intersection(f"a.{what}", f"b.{what}"))))}
    row = found.select(F.col("a.names").alias("left"), F.col("b.names").alias("right"), *(v.alias(n) for n, v in shares.items())).first()
    n_left, n_right = row["left"][-1]["n"], row["right"][-1]["n"]
    same = [a == b for a, b in zip(row["left"], row["right"], strict=True)]
    equal = same[-1]
    overlap = _containment(row["identity_a"], row["identity_b"], row["identity_both"])
    share = min(n_left, n_right) / max(n_left, n_right) if max(n_left, n_right) else 1.0
    similarity = _containment(row["content_a"], row["content_b"], row["content_both"]) * share
    relation = left.sparkSession.range(1).select(sketch.relationship(F.lit(overlap), F.lit(equal), F.lit(not n_left and not n_right))).first()[0]
    changed = [f for f, s in zip(fields, same) if not s]
    out = Comparison(*names, n_left, n_right, equal, not structure, changed, overlap, similarity, relation, structure=structure)
    if explain and equal:
        out.identical, out.modified, out.left_only, out.right_only = n_left, 0, 0, 0
        if use:
            use(match.changes(left, right, keys, fields, large=False))
    elif explain:
        *counts, large = match.totals_and_large(left, right, keys, fields).first()
        out.identical, out.modified, out.left_only, out.right_only = counts
        found = match.changes(left, right, keys, fields, large).persist()
        others = [f for f in fields if f not in keys]
        out.field_changes = {r["field"]: r["n"] for r in match.field_changes(found, others).collect()}
        moves = labels(found) if labels else transitions if transitions is not None else [F.when(match.differs(found, f), F.lit(f"{f.replace('_', ' ')} changed")) for f in others]
        if labels or moves:
            out.transitions = {r["label"]: r["n"] for r in match.transitions(found, moves).orderBy(F.desc("n"), "label").collect()}
        if examples:
            out.examples = [json.loads(r["example"]) for r in match.examples(found, keys, others, examples).collect()]
        if use:
            use(found)
        found.unpersist()
    return out
