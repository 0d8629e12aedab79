import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rowparity.functions.canon import canonical, record_digest
from rowparity.operators import fingerprint, match

SCHEMA = "k int, a string, b int"
FIELDS = ["k", "a", "b"]


def brute(left, right):
    groups = {}
    for side, rows in ((0, left), (1, right)):
        for row in rows:
            groups.setdefault(row[0], (Counter(), Counter()))[side][row] += 1
    out = [0, 0, 0, 0]
    for one, two in groups.values():
        same = (one & two).total()
        a, b = one.total() - same, two.total() - same
        out = [x + y for x, y in zip(out, (same, min(a, b), a - min(a, b), b - min(a, b)), strict=True)]
    return out


def table(r, n):
    return [(r.choice([None, *range(12)]), r.choice(["x", "y", "", None]), r.choice([1, 2, None])) for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    left, right = table(r, r.choice([0, 40, 150])), table(r, r.choice([0, 60, 150]))
    a, b = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    row = match.totals(a, b, ["k"], FIELDS).first()
    assert [row.identical, row.modified, row.left_only, row.right_only] == brute(left, right)
    assert row.identical + row.modified + row.left_only == len(left) and row.identical + row.modified + row.right_only == len(right)
    back = match.totals(b, a, ["k"], FIELDS).first()
    assert [back.identical, back.modified, back.left_only, back.right_only] == [row.identical, row.modified, row.right_only, row.left_only]
    found = Counter(x.status for x in match.changes(a, b, ["k"], FIELDS).collect())
    assert [found[s] for s in ("modified", "left_only", "right_only")] == brute(left, right)[1:]


def test_pairs_are_the_most_alike(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], SCHEMA)
    b = spark.createDataFrame([(1, "x", 9), (1, "y", 8)], SCHEMA)
    found = match.changes(a, b, ["k"], FIELDS).collect()
    assert sorted((r.a_before, r.a_after, r.b_before, r.b_after) for r in found) == [("x", "x", 1, 9), ("y", "y", 2, 8)]
    assert {(r.field, r.n) for r in match.field_changes(match.changes(a, b, ["k"], FIELDS), ["a", "b"]).collect()} == {("b", 2)}


def test_both_ways_of_pairing_give_the_same_pairs(spark, monkeypatch):
    r = random.Random(5)
    rows = [[(r.choice([None, 1]), r.choice("abc"), r.randint(0, 6), r.choice([None, "p", "q"])) for _ in range(n)] for n in (40, 50)]
    a, b = (spark.createDataFrame(x, "k int, a string, b int, c string") for x in rows)
    found = []
    for together in (1000, 2):
        monkeypatch.setattr(match, "TOGETHER", together)
        found.append(Counter(tuple(x) for x in match.changes(a, b, ["k"], a.columns).collect()))
    assert found[0] == found[1] and found[0].total() > 20
    # no two records that are left over, one on each side, are as alike as a pair of one different field
    alone = [[x for x in found[0] if x[1] == s] for s in ("left_only", "right_only")]
    assert not any(x[0] == y[0] and sum(x[2 + k * 2] != y[3 + k * 2] for k in range(3)) < 2 for x in alone[0] for y in alone[1])


def test_many_residual_records_of_one_key(spark):
    n = 20_000
    a = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("a"), F.lit("x").alias("b"))
    b = a.withColumn("b", F.when(F.col("a") % 2 == 0, "y").otherwise(F.lit("x"))).where("a <> 1 and a <> 2")
    found = match.changes(a, b, ["k"], ["k", "a", "b"]).groupBy("status", F.expr("a_before = a_after").alias("same")).count().collect()
    assert {(r.status, r.same): r["count"] for r in found} == {("modified", True): n // 2 - 1, ("left_only", None): 2}


def test_changes_read_each_side_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(row):
        read.add(1)
        return row

    left = [(k, x, n) for k in range(40) for x, n in (("x", 1), ("y", 2), ("z", 3))]
    right = [(k, x, n + (k % 3 == 0)) for k, x, n in left if x != "z" or k % 5]
    a, b = (spark.createDataFrame(spark.sparkContext.parallelize(rows, 3).map(seen), SCHEMA) for rows in (left, right))
    found = Counter(r.status for r in match.changes(a, b, ["k"], FIELDS).collect())
    assert [found[s] for s in ("modified", "left_only", "right_only")] == brute(left, right)[1:]
    assert read.value == len(left) + len(right)


def test_records_cancel_by_values_and_kinds(spark, monkeypatch):
    plans = []

    def kept(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return match_written(df, name)

    match_written = match.written
    monkeypatch.setattr(match, "written", kept)
    a = spark.createDataFrame([(1, "x", 1), (1, "x", 1), (2, None, 2), (None, "z", 3)], SCHEMA)
    b = spark.createDataFrame([(1, "x", 1), (2, None, 4), (None, "z", 3), (3, "y", None)], SCHEMA)
    counts = lambda left, right: Counter(r.status for r in match.changes(left, right, ["k"], FIELDS).collect())
    assert counts(a, b) == {"left_only": 1, "modified": 1, "right_only": 1}
    assert len(plans) == 1 and "md5" not in plans[0]
    # 1 and "1" differ, though a union has one type for both
    assert counts(a, b.withColumn("b", F.col("b").cast("string"))) == {"left_only": 1, "modified": 3, "right_only": 1}


def test_columns_may_have_any_names(spark):
    names = ["n", "side", "digest", "l", "r", "n_left", "k_left", "key", "record", "present", "f0", "k0", "place", "a.b"]
    schema = "k int, " + ", ".join(f"`{c}` bigint" for c in names)
    big = 9007199254740993
    one = [(1, *(big + k for k in range(len(names)))), (1, *([None] * len(names)))]
    two = [(1, *(big + k + 100 * (c == "n") for k, c in enumerate(names))), (1, *([7] * len(names)))]
    a, b = spark.createDataFrame(one, schema), spark.createDataFrame(two, schema)
    found = match.changes(a, b, ["k"], ["k", *names])
    rows = {r["n_before"]: r.asDict() for r in found.collect()}
    assert rows[big]["n_after"] == big + 100 and all(rows[big][f"{c}_after"] == big + k for k, c in enumerate(names) if c != "n")
    assert all(rows[None][f"{c}_after"] == 7 for c in names)
    with pytest.raises(ValueError, match="one name"):
        match.changes(a.withColumnRenamed("k", "status"), b.withColumnRenamed("k", "status"), ["status"], ["status", "n"])


def test_a_table_equals_itself_in_any_order(spark):
    rows = table(random.Random(9), 200)
    a = spark.createDataFrame(rows, SCHEMA)
    b = spark.createDataFrame(rows[::-1], SCHEMA).repartition(5)
    assert match.totals(a, b, ["k"], FIELDS).first().identical == 200
    assert all(r.equal for r in fingerprint.compare(a, b, FIELDS).collect())
    assert match.changes(a, b, ["k"], FIELDS).isEmpty()


def test_swapped_values_change_the_record_alone(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], SCHEMA)
    b = spark.createDataFrame([(1, "y", 1), (2, "x", 1)], SCHEMA)
    assert {r.name: r.equal for r in fingerprint.compare(a, b, FIELDS).collect()} == {"k": True, "a": True, "b": True, "record": False}


def test_canonical_text_tells_values_and_kinds_apart(spark):
    row = spark.sql(
        "select 1 i, 1L l, '1' s, true b, cast(null as int) n, 'n' t, double('nan') nan, -0.0D z, 0.0D y, map('a',1,'b',2) m, map('b',2,'a',1) w,"
        " array('a,b') one, array('a','b') two, struct('a', cast(null as string)) p, struct(cast(null as string), 'a') q, date'2020-01-01' d, 1.50BD dec, X'01' x, array() e"
    )
    out = row.select(*(canonical(F.col(f.name), f.dataType).alias(f.name) for f in row.schema.fields)).first()
    assert out.i == out.l and out.z == out.y and out.m == out.w
    different = [out[c] for c in ("i", "s", "b", "n", "t", "nan", "z", "m", "one", "two", "p", "q", "d", "dec", "x", "e")]
    assert len(set(different)) == len(different) and None not in different


def test_nulls_and_bounds_don_t_run_together(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("ab", "c"), ("a", "bc"), (None, None), ("", "")], "x string, y string")
    assert df.select(record_digest(df, ["x", "y"]).alias("h")).distinct().count() == 6


def test_empty_tables_have_fingerprints(spark):
    empty = spark.createDataFrame([], SCHEMA)
    rows = fingerprint.fingerprints(empty, FIELDS).collect()
    assert len(rows) == 4 and all(r.n == r.high_0 == r.xor_1 == 0 for r in rows)


def test_map_transitions_and_ledger(spark, tmp_path):
    df = spark.sql("select map('NM','0','X','1') a, map('NM','1','RG','q') b union all select null, map('NM','1')")
    labels = df.select(F.array_sort(match.map_transitions("tag", F.col("a"), F.col("b"))).alias("t")).collect()
    assert sorted(map(tuple, (r.t for r in labels))) == [("tag added: NM",), ("tag added: RG", "tag removed: X", "tag value changed: NM")]
    a, b = spark.createDataFrame([(1, "x", 1)], SCHEMA), spark.createDataFrame([(1, "y", 1), (2, None, 3)], SCHEMA)
    table_ = match.ledger(match.changes(a, b, ["k"], FIELDS), ["k"], ["a", "b"])
    match.write_ledger(table_, str(tmp_path / "ledger"), compression="gzip")
    back = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "ledger"))
    assert {(r.status, r.identity, r.changed_fields) for r in back.collect()} == {("modified", "1", "a"), ("right_only", "2", None)}
    with pytest.raises(Exception, match="already exists"):
        match.write_ledger(table_, str(tmp_path / "ledger"))
