"""The multiset match of two tables by an identity key.

Both sides are one tagged union, aggregated by (key, record digest), or by the
values themselves where changes are wanted: equal records cancel by
multiplicity, map-side first, so a key or record that many rows share is a few
counts before anything is shuffled.  What is left of a key is paired until one
side is used up (modified); the rest is one-sided.  Keys may be null and need
not be unique.

Keys and fields travel under names of their own, so columns may have any names.

Residual records of a key are paired by one rule, whatever their number: first
those that differ in one field, then in two, and so on; sets of fields of one
size in the order of the fields, and within a set by the records' places (see
``_place``).  A table so wide that a size has too many sets (``FIELD_SETS``)
pairs what is left then by place alone.  Keys with few residual records are
paired where they are grouped; for the others each set of fields is an
aggregate of its own, whose ranks are dealt into parts, so no task holds a
key.  Both ways give the same pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.canon import canonical, joined_digest, record_digest
from ..storage import dropped, written

#: Residual records of a key that are paired where they are grouped; a matter of the plan, not of the result.
TOGETHER = 64
#: Sets of different fields that are told apart.
FIELD_SETS = 1024
#: Parts that a group's ranks are dealt into.
PARTS = 64


def _rest(keys: list[str], fields: list[str]) -> list[str]:
    return [f for f in fields if f not in keys]


def _tagged(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(key, digest, n_left, n_right) of every different record of a key."""
    sides = []
    for side, df in enumerate((left, right)):
        key = F.struct(*(df[f"`{k}`"].alias(f"k{i}") for i, k in enumerate(keys))).alias("key")
        sides.append(df.select(key, record_digest(df, fields).alias("digest"), F.lit(1 - side).cast("long").alias("l"), F.lit(side).cast("long").alias("r")))
    return sides[0].union(sides[1]).groupBy("key", "digest").agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"))


def _flat(field: str, keys: list[str], others: list[str]) -> str:
    """The name of a key or field among the columns of ``_residuals``."""
    return f"k{keys.index(field)}" if field in keys else f"f{others.index(field)}"


def _residuals(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(k0, ..., f0, ..., n) of the records that don't cancel; n is how many more the left has, below 0 if the right has more.

    Records are told apart by their values, so most are never digested.  Where
    the two sides have a column in two types, the values of the union don't
    tell 1 from "1": the digest of the record as it was is then one more column.
    """
    others = _rest(keys, fields)
    mixed = any(left.schema[c].dataType != right.schema[c].dataType for c in [*keys, *fields])
    sides = []
    for df, n in ((left, 1), (right, -1)):
        columns = [df[f"`{c}`"].alias(_flat(c, keys, others)) for c in [*keys, *others]]
        if mixed:
            columns.append(record_digest(df, fields).alias("digest"))
        sides.append(df.select(*columns, F.lit(n).cast("long").alias("n")))
    both = sides[0].union(sides[1])
    return both.groupBy(*both.columns[:-1]).agg(F.sum("n").alias("n")).where("n <> 0")


def by_key(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(key, identical, rest_left, rest_right) of each key, a struct of k0, k1, ..."""
    same = F.least("n_left", "n_right")
    return _tagged(left, right, keys, fields).groupBy("key").agg(
        F.sum(same).alias("identical"),
        F.sum(F.col("n_left") - same).alias("rest_left"),
        F.sum(F.col("n_right") - same).alias("rest_right"),
    )


def _large() -> Column:
    """Whether a key's residual records are too many to be grouped."""
    return F.col("rest_left") + F.col("rest_right") > TOGETHER


def _sums() -> list[Column]:
    pairs = F.least("rest_left", "rest_right")
    named = {
        "identical": F.col("identical"), "modified": pairs,
        "left_only": F.col("rest_left") - pairs, "right_only": F.col("rest_right") - pairs,
    }
    return [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for n, c in named.items()]


def totals(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row: identical, modified, left_only, right_only.

    identical + modified + left_only is the left side's count, and likewise
    for the right.  Empty sides give zeros.
    """
    return by_key(left, right, keys, fields).agg(*_sums())


def totals_and_large(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """``totals`` with large: whether ``changes`` has a key that isn't grouped."""
    return by_key(left, right, keys, fields).agg(*_sums(), F.coalesce(F.bool_or(_large()), F.lit(False)).alias("large"))


def residual_counts(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row: left_rest and right_rest, the records left after cancelling."""
    same = F.least("n_left", "n_right")
    sums = {"left_rest": F.col("n_left") - same, "right_rest": F.col("n_right") - same}
    found = _tagged(left, right, keys, fields)
    return found.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()))


def _place(digest: Column, copy: Column) -> Column:
    """Where a residual record stands among those of its key and side: by part, digest and copy."""
    part = F.pmod(F.xxhash64(digest, copy), F.lit(PARTS)).cast("int")
    return F.struct(part.alias("part"), digest.alias("digest"), copy.alias("copy"))


def _levels(n: int) -> int:
    """Sizes of sets of ``n`` fields that are told apart."""
    total = 0
    for size in range(1, n + 1):
        total += comb(n, size)
        if total > FIELD_SETS:
            return size - 1
    return n


def _paired_together(rest: DataFrame, n: int, told: Callable[[Column], tuple[Column, list[Column]]]) -> DataFrame:
    """(key, before, after) of the residual records (k0, ..., record, is_left, copy[, digest]) of keys with few.

    ``told`` gives the digest and the marks of such a row.  Only keys that have
    a choice of pairs need them, so they are made after the grouping.
    """
    levels = _levels(n)
    ks = [c for c in rest.columns if c[0] == "k"]
    item = F.struct("copy", *(c for c in ("digest",) if c in rest.columns), "record")
    sides = {"lefts": F.col("is_left"), "rights": ~F.col("is_left")}
    group = rest.groupBy(*ks).agg(*(F.collect_list(F.when(c, item)).alias(name) for name, c in sides.items()))

    def known(x: Column) -> Column:
        digest, marks = told(x)
        return F.struct(_place(digest, x["copy"]).alias("place"), F.array(*marks).cast("array<string>").alias("marks"))

    def pair(left: Column, i: Column, right: Column, j: Column) -> Column:
        which = F.concat(F.lit(""), *(F.when(left["marks"][k] == right["marks"][k], "1").otherwise("0") for k in range(n)))  # in the order of the sets' fields
        size = F.length(F.translate(which, "1", ""))
        near = size <= levels
        return F.struct(
            F.when(near, size).otherwise(levels + 1).alias("size"), F.when(near, which).otherwise("").alias("which"),
            left["place"].alias("first"), right["place"].alias("second"), i.cast("int").alias("i"), j.cast("int").alias("j"),
        )

    # an array of one, as a name for what is made once
    both = F.array(F.struct(F.transform("lefts", known).alias("l"), F.transform("rights", known).alias("r")))
    both = F.flatten(F.transform(both, lambda s: F.flatten(F.transform(s["l"], lambda x, i: F.transform(s["r"], lambda y, j: pair(x, i, y, j))))))
    none = F.array().cast("array<int>")
    start = F.struct(none.alias("used_left"), none.alias("used_right"))

    def take(state: Column, p: Column) -> Column:
        free = ~F.array_contains(state["used_left"], p["i"]) & ~F.array_contains(state["used_right"], p["j"])
        more = F.struct(
            F.concat(state["used_left"], F.array(p["i"])).alias("used_left"), F.concat(state["used_right"], F.array(p["j"])).alias("used_right")
        )
        return F.when(free, more).otherwise(state)

    single = (F.size("lefts") <= 1) & (F.size("rights") <= 1)
    group = group.withColumn("taken", F.when(~single, F.aggregate(F.array_sort(both), start, take)))
    record = lambda items, k: F.get(items, k)["record"]
    nothing = F.lit(None).cast(rest.schema["record"].dataType)
    row = lambda a, b: F.struct(a.alias("before"), b.alias("after"))
    modified = F.zip_with("taken.used_left", "taken.used_right", lambda i, j: row(record(F.col("lefts"), i), record(F.col("rights"), j)))
    free = lambda items, used: F.filter(items, lambda x, k: ~F.array_contains(used, k.cast("int")))
    alone = [
        F.transform(free(F.col("lefts"), F.col("taken.used_left")), lambda x: row(x["record"], nothing)),
        F.transform(free(F.col("rights"), F.col("taken.used_right")), lambda x: row(nothing, x["record"])),
    ]
    one = F.array(row(record(F.col("lefts"), F.lit(0)), record(F.col("rights"), F.lit(0))))
    found = F.when(single, one).otherwise(F.concat(modified, *alone))
    return group.select(F.struct(*ks).alias("key"), F.explode(found).alias("p")).select("key", "p.before", "p.after")


def _paired_in_steps(rows: DataFrame, n: int) -> DataFrame:
    """As ``_paired_together``, a set of fields at a time, of (key_digest, key, is_left, record, marks, place)."""
    rest = written(rows, "residuals")
    done = []
    every = tuple(range(n))
    levels = _levels(n)
    sizes = [list(combinations(every, size)) for size in range(1, levels + 1)]
    for sets in [*sizes, [every]] if levels < n else sizes:
        keys = [F.struct(F.lit(at).alias("at"), _block(n, free).alias("block")) for at, free in enumerate(sets)]
        blocks = rest.select("is_left", F.explode(F.array(*keys)).alias("b")).groupBy("b.at", "b.block")
        shared = blocks.agg(F.bool_or("is_left").alias("l"), F.bool_or(~F.col("is_left")).alias("r")).where("l and r")
        for at in sorted(r["at"] for r in shared.select("at").distinct().collect()):
            result = written(_step(rest, _block(n, sets[at])), "step")
            done.append(result.where("first is not null and second is not null").select("key", F.col("first.record").alias("before"), F.col("second.record").alias("after")))
            one = result.where("first is null or second is null").select("key", F.coalesce("first", "second").alias("x"), F.col("first").isNotNull().alias("is_left"))
            old, rest = rest, written(one.select("key", "is_left", "x.*"), "residuals")
            dropped(old)
    nothing = F.lit(None).cast(rows.schema["record"].dataType)
    record = lambda is_left: F.when(F.col("is_left") == F.lit(is_left), F.col("record")).otherwise(nothing)
    out = rest.select("key", record(True).alias("before"), record(False).alias("after"))
    return reduce(DataFrame.union, done, out)


def _block(n: int, free: tuple[int, ...]) -> Column:
    """Names the records of a key that agree in all fields but those in ``free``."""
    return F.md5(F.concat(F.col("key_digest"), *(F.col("marks")[k] for k in range(n) if k not in free)).cast("binary"))


def _step(rest: DataFrame, block: Column) -> DataFrame:
    """(key, first, second): the i-th left with the i-th right record of each block, and those without another."""
    rows = rest.withColumn("block", block).withColumn("part", F.col("place.part"))
    counts = rows.groupBy("block", "is_left", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("block", "is_left").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # PARTS rows at most
    counts = counts.select("block", "is_left", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    nth = F.row_number().over(Window.partitionBy("block", "is_left", "part").orderBy("place"))
    ranked = rows.withColumn("nth", nth).join(counts, ["block", "is_left", "part"])
    ranked = ranked.select("block", (F.col("offset") + F.col("nth")).alias("rank"), "is_left", "key", F.struct("key_digest", "place", "marks", "record").alias("x"))
    sides = [ranked.where(F.col("is_left") == F.lit(s)).select("block", "rank", F.col("key").alias(f"key_{s}"), F.col("x").alias(name)) for s, name in ((True, "first"), (False, "second"))]
    both = sides[0].join(sides[1], ["block", "rank"], "fullouter")
    return both.select(F.coalesce("key_True", "key_False").alias("key"), "first", "second")


def changes(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], large: bool | None = None) -> DataFrame:
    """A row for each change: (*keys, status, <field>_before, <field>_after ...).

    status is modified, left_only or right_only.  The records that don't cancel
    are written first, so each side is read once.  ``large`` says whether some
    key has too many of them to be grouped, as ``totals_and_large`` finds it;
    else they are counted.  Columns that would have one name in the result
    raise.
    """
    others = _rest(keys, fields)
    names = [*keys, "status", *(f"{f}_{when}" for f in others for when in ("before", "after"))]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError(f"rename columns: two of the result's would have one name ({', '.join(names)})")
    rest = written(_residuals(left, right, keys, fields), "residuals")
    ks = [f"k{i}" for i in range(len(keys))]
    if large is None:
        most = rest.groupBy(*ks).agg(F.sum(F.abs("n")).alias("n")).agg(F.max("n")).first()[0]
        large = (most or 0) > TOGETHER
    fs = [f"f{i}" for i in range(len(others))]
    kinds = {f.name: f.dataType for f in rest.schema.fields}
    mixed = "digest" in rest.columns

    def told(x: Column | None = None) -> tuple[Column, list[Column]]:
        digests = {k: _mark(F.col(k), kinds[k]) for k in ks} | {f: _mark(x["record"][f] if x is not None else F.col("record")[f], kinds[f]) for f in fs}
        whole = (x["digest"] if x is not None else F.col("digest")) if mixed else joined_digest([digests[_flat(f, keys, others)] for f in fields])
        return whole, [digests[f] for f in fs]

    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.abs("n"))).alias("copy")
    rest = rest.select(*ks, F.struct(*fs, F.lit(True).alias("present")).alias("record"), (F.col("n") > 0).alias("is_left"), "n", *(["digest"] if mixed else []))
    if large:
        rest = rest.withColumn("key", F.struct(*ks))
        rest = rest.withColumn("key_digest", record_digest(rest, ["key"]))
        count = lambda is_left: F.sum(F.when(F.col("is_left") == F.lit(is_left), F.abs("n")).otherwise(0))
        sizes = rest.groupBy("key_digest").agg(count(True).alias("rest_left"), count(False).alias("rest_right")).where(_large())
        few = rest.join(sizes, "key_digest", "left_anti").drop("key", "key_digest")
        many = rest.join(sizes, "key_digest")
        two_sided = (F.col("rest_left") > 0) & (F.col("rest_right") > 0)
        nothing = F.lit(None).cast(rest.schema["record"].dataType)
        record = lambda is_left: F.when(F.col("is_left") == F.lit(is_left), F.col("record")).otherwise(nothing)
        alone = many.where(~two_sided).select("key", record(True).alias("before"), record(False).alias("after"), copies).drop("copy")
        digest, marks = told()
        many = many.where(two_sided).select("*", copies)
        many = many.select("key_digest", "key", "is_left", "record", F.array(*marks).cast("array<string>").alias("marks"), _place(digest, F.col("copy")).alias("place"))
        out = alone.union(_paired_in_steps(many, len(others))).union(_paired_together(few.select("*", copies), len(others), told))
    else:
        out = _paired_together(rest.select("*", copies), len(others), told)
    status = F.when(F.col("before").isNotNull() & F.col("after").isNotNull(), "modified").when(F.col("before").isNotNull(), "left_only").otherwise("right_only")
    value = [F.col(when)[f"f{i}"].alias(f"{f}_{when}") for when in ("before", "after") for i, f in enumerate(others)]
    return out.select(*(F.col("key")[f"k{i}"].alias(k) for i, k in enumerate(keys)), status.alias("status"), *value)


def _mark(value: Column, kind: T.DataType) -> Column:
    return F.md5(canonical(value, kind).cast("binary"))


def changed(field: str) -> Column:
    """Whether a field of a modified pair differs."""
    return ~F.col(f"{field}_before").eqNullSafe(F.col(f"{field}_after"))


def differs(found: DataFrame, field: str) -> Column:
    """As ``changed``, also for types without an order, such as maps."""
    kind = found.schema[f"{field}_before"].dataType
    if "map<" not in kind.simpleString():
        return changed(field)
    return canonical(F.col(f"{field}_before"), kind) != canonical(F.col(f"{field}_after"), kind)


def field_changes(found: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n): in how many modified pairs each field differs; fields that never do are absent."""
    names = F.explode(F.filter(F.array(*(F.when(differs(found, f), F.lit(f)) for f in fields)), lambda x: x.isNotNull()))
    return found.where("status = 'modified'").select(names.alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def transitions(found: DataFrame, labels: list[Column] | Column) -> DataFrame:
    """(label, n) of the labels, null where there is no change, over the modified pairs; one column is an array of them."""
    names = F.explode(F.filter(labels if isinstance(labels, Column) else F.array(*labels), lambda x: x.isNotNull()))
    return found.where("status = 'modified'").select(names.alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def map_transitions(name: str, before: Column, after: Column) -> Column:
    """Labels of keys added to, removed from or changed in a map."""
    one, two = (F.coalesce(m, F.create_map().cast("map<string,string>")) for m in (before, after))
    say = lambda what, keys: F.transform(keys, lambda k: F.concat(F.lit(f"{name} {what}: "), k))
    both = F.array_intersect(F.map_keys(one), F.map_keys(two))
    return F.concat(
        say("added", F.array_except(F.map_keys(two), F.map_keys(one))),
        say("removed", F.array_except(F.map_keys(one), F.map_keys(two))),
        say("value changed", F.filter(both, lambda k: ~F.element_at(one, k).eqNullSafe(F.element_at(two, k)))),
    )


def ledger(found: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(status, identity, changed_fields, first, second) as text, for a difference table."""
    names = F.array_join(F.filter(F.array(*(F.when(differs(found, f), F.lit(f)) for f in fields)), lambda x: x.isNotNull()), ",")
    text = lambda suffix: F.concat_ws("|", *(F.coalesce(F.col(f"{f}_{suffix}").cast("string"), F.lit("null")) for f in fields))
    return found.select(
        "status",
        F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys)).alias("identity"),
        F.when(F.col("status") == "modified", names).otherwise("").alias("changed_fields"),
        F.when(F.col("status") != "right_only", text("before")).otherwise("").alias("first"),
        F.when(F.col("status") != "left_only", text("after")).otherwise("").alias("second"),
    )


def write_ledger(table: DataFrame, path: str, force: bool = False, compression: str = "none") -> None:
    """Writes a ledger as tab-separated text; refuses to replace one without ``force``."""
    table.write.mode("overwrite" if force else "error").option("sep", "\t").option("header", True).option("compression", compression).csv(path)


def write_changes(found: DataFrame, keys: list[str], fields: list[str], path: str) -> None:
    """Writes the records behind ``changes`` as four Parquet tables below ``path``, in the columns of the source.

    only-in-first, only-in-second, modified-first and modified-second.
    """
    found = found.persist()
    for status, suffix, name in (("left_only", "before", "only-in-first"), ("right_only", "after", "only-in-second"), ("modified", "before", "modified-first"), ("modified", "after", "modified-second")):
        found.where(F.col("status") == status).select(*keys, *(F.col(f"{f}_{suffix}").alias(f) for f in fields)).write.parquet(f"{path}/{name}")
    found.unpersist()


def examples(found: DataFrame, keys: list[str], fields: list[str], most: int) -> DataFrame:
    """(example): the first changes by key as JSON, with status, key, and the records before and after.

    Names that begin with an underscore are left out.
    """
    shown = [f for f in fields if not f.startswith("_")]
    record = lambda suffix: F.struct(*(F.col(f"{f}_{suffix}").alias(f) for f in shown)) if shown else F.lit(None).cast("string")
    both = [
        F.when(F.col("status") != absent, record(side)).alias(side) for absent, side in (("right_only", "before"), ("left_only", "after"))
    ]
    key = F.struct(*(F.col(k) for k in keys if not k.startswith("_"))) if any(not k.startswith("_") for k in keys) else F.lit(None).cast("string")
    text = F.to_json(F.struct("status", key.alias("key"), *both), {"ignoreNullFields": "false"})
    return found.select(*keys, text.alias("example")).orderBy(*keys, "example").limit(most).select("example")
