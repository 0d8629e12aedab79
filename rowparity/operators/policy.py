"""Acceptance policies over the summaries of many comparisons, as columns."""

from __future__ import annotations

import fnmatch
import json
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Policy:
    """Limits of a comparison; None is no limit."""

    max_modified: int | None = 0
    max_only: int | None = 0
    max_modified_fraction: float | None = None
    max_only_fraction: float | None = None
    min_overlap: float = 0.0
    allow_structural_differences: bool = False
    fail_transitions: tuple[str, ...] = ()
    deny_transitions: tuple[str, ...] = ()
    allow_fields: tuple[str, ...] | None = None
    deny_fields: tuple[str, ...] = ()
    allow_transitions: tuple[str, ...] = ()
    transition_default: str = "allow"
    severity: str = "error"


@dataclass(frozen=True)
class Rule:
    name: str
    match: dict[str, str]
    settings: dict


@dataclass(frozen=True)
class Document:
    """Defaults, and rules that override them in order."""

    defaults: dict = field(default_factory=dict)
    rules: tuple[Rule, ...] = ()


COUNTS = ("max_modified", "max_only")
SHARES = ("max_modified_fraction", "max_only_fraction", "min_overlap")
LISTS = ("fail_transitions", "deny_transitions", "allow_fields", "deny_fields", "allow_transitions")
CHOICES = {"severity": ("error", "warning", "info"), "transition_default": ("allow", "fail")}
MATCH = ("sample", "stage", "kind", "profile")


def _object(value: object, what: str, known: tuple[str, ...] | None = None) -> dict:
    """A JSON object; names beyond the known ones raise."""
    if not isinstance(value, dict):
        raise ValueError(f"{what} is an object")
    if known is not None and (unknown := set(value) - set(known)):
        raise ValueError(f"{what}: unknown {', '.join(sorted(unknown))}")
    return value


def _setting(name: str, value: object) -> object:
    """A setting of the right type and range; true and false are no numbers."""
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if name in COUNTS and not (value is None or number and isinstance(value, int) and value >= 0):
        raise ValueError(f"{name} is a count or null")
    if name in SHARES and not (number and 0 <= value <= 1 or value is None and name != "min_overlap"):
        raise ValueError(f"{name} lies between 0 and 1")
    if name == "allow_structural_differences" and not isinstance(value, bool):
        raise ValueError(f"{name} is true or false")
    if name in LISTS:
        if value is None and name == "allow_fields":
            return None
        if not isinstance(value, list) or not all(isinstance(x, str) and x.strip() for x in value):
            raise ValueError(f"{name} is a list of texts")
        return tuple(value)
    if name in CHOICES and value not in CHOICES[name]:
        raise ValueError(f"{name} is {' or '.join(CHOICES[name])}")
    return value


def _settings(values: object, what: str) -> dict:
    known = tuple(f.name for f in fields(Policy))
    return {k: _setting(k, v) for k, v in _object(values, what, known).items()}


def _rule(value: object, nth: int) -> Rule:
    what = f"rule {nth}"
    said = _object(value, what, ("name", "match", "set"))
    name = said.get("name")
    if not isinstance(name, str) or not name.strip():
        raise ValueError(f"{what} needs a name")
    match = _object(said.get("match"), f"{what}: match", MATCH)
    if not match or not all(isinstance(x, str) and x for x in match.values()):
        raise ValueError(f"{what}: match has one text at least")
    settings = _settings(said.get("set"), f"{what}: set")
    if not settings:
        raise ValueError(f"{what}: set has one setting at least")
    return Rule(name, dict(match), settings)


def load(text: str) -> Document:
    """A policy document from JSON; unknown names, bad types and values, and repeated or empty rules raise."""
    data = _object(json.loads(text), "a policy document", ("version", "defaults", "rules"))
    if data.get("version") != 1 or isinstance(data["version"], bool):
        raise ValueError("a policy document has version 1")
    if not isinstance(data.get("rules", []), list):
        raise ValueError("rules is a list")
    rules = tuple(_rule(r, nth) for nth, r in enumerate(data.get("rules", []), 1))
    if len({r.name for r in rules}) < len(rules):
        raise ValueError("names of rules differ from each other")
    return Document({"transition_default": "fail"} | _settings(data.get("defaults", {}), "defaults"), rules)


def resolve(base: Policy, document: Document | None, **item: str) -> tuple[Policy, tuple[str, ...]]:
    """The item's policy, and the names of the rules that match it: all their patterns do, whatever the case."""
    if document is None:
        return base, ()
    policy, names = replace(base, **document.defaults), []
    for rule in document.rules:
        if all(fnmatch.fnmatchcase(item.get(k, "").casefold(), v.casefold()) for k, v in rule.match.items()):
            policy, names = replace(policy, **rule.settings), [*names, rule.name]
    return policy, tuple(names)


def _like(label: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a label matches a glob or holds its text, whatever the case."""
    found = F.lit(False)
    for p in patterns:
        found = found | F.lower(label).rlike(fnmatch.translate(p.lower()).replace(r"\Z", "$").replace(r"\z", "$")) | F.contains(F.lower(label), F.lit(p.lower()))
    return found


def _percent(value: Column | float) -> Column:
    return F.format_string("%.1f%%", (value if isinstance(value, Column) else F.lit(value)) * 100)


def evaluate(rows: DataFrame, policy: Policy) -> DataFrame:
    """Adds violations (texts, once each, in a fixed order) and passed.

    ``rows`` has n_left, n_right, modified, left_only, right_only, overlap,
    structure_equal, changed_fields (array) and transitions (map of label to
    count).  Violations of severity warning or info don't fail.
    """
    only = F.col("left_only") + F.col("right_only")
    modified_part = F.col("modified") / F.greatest(F.lit(1), F.least("n_left", "n_right"))
    only_part = only / F.greatest(F.lit(1), F.col("n_left") + F.col("n_right"))
    number = lambda c: F.format_number(c, 0)
    tests: list[Column] = []
    if policy.max_modified is not None:
        tests.append(F.when(F.col("modified") > policy.max_modified, F.concat(F.lit("modified records "), number(F.col("modified")), F.lit(f" exceed {policy.max_modified:,}"))))
    if policy.max_modified_fraction is not None:
        tests.append(F.when(modified_part > policy.max_modified_fraction, F.concat(F.lit("modified fraction "), _percent(modified_part), F.lit(f" exceed {policy.max_modified_fraction:.1%}"))))
    if policy.max_only is not None:
        tests.append(F.when(only > policy.max_only, F.concat(F.lit("sample-only records "), number(only), F.lit(f" exceed {policy.max_only:,}"))))
    if policy.max_only_fraction is not None:
        tests.append(F.when(only_part > policy.max_only_fraction, F.concat(F.lit("sample-only fraction "), _percent(only_part), F.lit(f" exceed {policy.max_only_fraction:.1%}"))))
    tests.append(F.when(F.col("overlap") < policy.min_overlap, F.concat(F.lit("identity overlap "), _percent(F.col("overlap")), F.lit(f" is below {policy.min_overlap:.1%}"))))
    if not policy.allow_structural_differences:
        tests.append(F.when(~F.col("structure_equal"), F.lit("structural header differs")))
    listed = lambda names: F.array(*(F.lit(n) for n in names)).cast("array<string>")
    denied = F.array_sort(F.array_intersect("changed_fields", listed(policy.deny_fields)))
    tests.append(F.when(F.size(denied) > 0, F.concat(F.lit("forbidden changed fields: "), F.array_join(denied, ", "))))
    if policy.allow_fields is not None:
        other = F.array_sort(F.array_except("changed_fields", listed(policy.allow_fields)))
        tests.append(F.when(F.size(other) > 0, F.concat(F.lit("unexpected changed fields: "), F.array_join(other, ", "))))
    deny = policy.fail_transitions + policy.deny_transitions

    def judged(entry: Column) -> Column:
        label, times = entry["key"], number(entry["value"])
        which = F.coalesce(*(F.when(_like(label, (p,)), F.lit(p)) for p in deny)) if deny else F.lit(None).cast("string")
        said = F.when(which.isNotNull(), F.concat(F.lit("forbidden transition '"), which, F.lit("' occurred "), times, F.lit(" times")))
        if policy.transition_default == "fail":
            said = said.when(~_like(label, policy.allow_transitions), F.concat(F.lit("unapproved transition '"), label, F.lit("' occurred "), times, F.lit(" times")))
        return said

    moves = F.transform(F.array_sort(F.map_entries("transitions")), judged)
    all_ = F.array_distinct(F.filter(F.concat(F.array(*tests), moves), lambda x: x.isNotNull()))
    out = rows.withColumn("violations", all_)
    return out.withColumn("passed", F.lit(policy.severity != "error") | (F.size("violations") == 0))


def earliest_divergence(rows: DataFrame) -> DataFrame:
    """(sample, stage): the first stage, by position, that isn't equivalent, whatever the policy says."""
    return rows.where("not equivalent").groupBy("sample").agg(F.min_by("stage", "position").alias("stage"))


def transition_totals(rows: DataFrame, n: int = 100) -> DataFrame:
    """(label, n) summed over comparisons; the ``n`` most frequent, ties by label."""
    return rows.groupBy("label").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "label").limit(n)


def status_grid(rows: DataFrame, stages: list[str]) -> DataFrame:
    """A row for each sample, a column for each stage."""
    return rows.groupBy("sample").pivot("stage", stages).agg(F.first("status"))


def first_of(rows: DataFrame, by: str, n: int) -> DataFrame:
    """The first ``n`` rows of each group in ``by``."""
    order = F.row_number().over(Window.partitionBy(by).orderBy("position"))
    return rows.withColumn("__nth", order).where(F.col("__nth") <= n).drop("__nth")
