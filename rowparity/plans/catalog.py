"""Queries and their SQL by name.

Queries on pairs compare a base table with a version of it that a fixed rule
has changed; ``ORDERS`` and ``LINES`` are the same rules in SQL.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import buckets
from ..functions.canon import lane, record_digest
from ..operators import baseline, fingerprint, headers, identity, match, matrix, metrics, policy, regions, sketch, tracks
from ..sources import manifest

QUERIES = {}
ORACLES = {}
PROFILES = {"strict": ["k", "st", "p", "g"], "core": ["k", "st", "p"], "status": ["k", "st"]}

ORDERS = """
with l as (select o_orderkey k, o_orderstatus st, cast(o_totalprice as decimal(18,2)) p, o_custkey g
  from orders where o_orderkey % 97 <> 0),
r as (select o_orderkey + (case when o_orderkey % 89 = 0 then 10000000 else 0 end) k,
  case when o_orderkey % 31 = 0 then 'X' else o_orderstatus end st,
  cast(case when o_orderkey % 53 = 0 then o_totalprice + 1 else o_totalprice end as decimal(18,2)) p, o_custkey g from orders)
"""
LINES = """
with l as (select l_orderkey o, l_linenumber nr, l_returnflag rf, cast(l_quantity as bigint) q, l_partkey pos
  from lineitem where l_partkey % 83 <> 0),
r as (select l_orderkey o, l_linenumber nr, case when l_partkey % 29 = 0 then 'Z' else l_returnflag end rf,
  cast(case when l_suppkey % 17 = 0 then l_quantity + 1 else l_quantity end as bigint) q, l_partkey pos
  from lineitem where l_partkey % 79 <> 0)
"""


def orders(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = spark.read.parquet(f"{d}/orders.parquet")
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    money = lambda c: c.cast("decimal(18,2)").alias("p")
    left = t.where(k % 97 != 0).select(k.alias("k"), F.col("o_orderstatus").alias("st"), money(price), F.col("o_custkey").alias("g"))
    right = t.select(
        (k + F.when(k % 89 == 0, 10000000).otherwise(0)).alias("k"),
        F.when(k % 31 == 0, "X").otherwise(F.col("o_orderstatus")).alias("st"),
        money(F.when(k % 53 == 0, price + 1).otherwise(price)), F.col("o_custkey").alias("g"),
    )
    return left, right


def lines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    part = F.col("l_partkey")
    names = lambda rf, q: [F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("nr"), rf.alias("rf"), q.cast("long").alias("q"), part.alias("pos")]
    left = t.where(part % 83 != 0).select(*names(F.col("l_returnflag"), F.col("l_quantity")))
    right = t.where(part % 79 != 0).select(*names(F.when(part % 29 == 0, "Z").otherwise(F.col("l_returnflag")), F.when(F.col("l_suppkey") % 17 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))))
    return left, right


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


CORE = PROFILES["core"]

TOTALS = """,
u as (select 1 a, 0 b, * from l union all select 0, 1, * from r),
c as (select {key}, {rest}, sum(a) na, sum(b) nb from u group by all),
g as (select {key}, sum(least(na, nb)) i, sum(na - least(na, nb)) rl, sum(nb - least(na, nb)) rr from c group by {key})
select cast(sum(i) as bigint) identical, cast(sum(least(rl, rr)) as bigint) modified,
  cast(sum(rl - least(rl, rr)) as bigint) left_only, cast(sum(rr - least(rl, rr)) as bigint) right_only from g
"""


@query(ORDERS.replace(", o_custkey g", "") + TOTALS.format(key="k", rest="st, p"))
def diff_totals_orders(spark, d):
    return match.totals(*orders(spark, d), ["k"], CORE)


@query(LINES.replace(", l_partkey pos", "") + TOTALS.format(key="o, nr", rest="rf, q"))
def diff_totals_lineitem_multiset(spark, d):
    return match.totals(*lines(spark, d), ["o", "nr"], ["o", "nr", "rf", "q"])


@query(ORDERS + "select k, st, p from l intersect all select k, st, p from r")
def identical_rows(spark, d):
    left, right = orders(spark, d)
    return left.select(*CORE).intersectAll(right.select(*CORE))


@query(ORDERS + "select k, st, p from l except all select k, st, p from r")
def only_left_rows(spark, d):
    left, right = orders(spark, d)
    return left.select(*CORE).exceptAll(right.select(*CORE))


@query(ORDERS + "select k, st, p from r except all select k, st, p from l")
def only_right_rows(spark, d):
    left, right = orders(spark, d)
    return right.select(*CORE).exceptAll(left.select(*CORE))


CHANGED = """,
m as (select l.k, l.st st1, r.st st2, l.p p1, r.p p2, l.g g1, r.g g2 from l join r on l.k = r.k and (l.st, l.p) is distinct from (r.st, r.p))
"""


@query(ORDERS + CHANGED + "select k, st1 st_before, st2 st_after, p1 p_before, p2 p_after from m")
def modified_pairs(spark, d):
    return match.changes(*orders(spark, d), ["k"], CORE).where("status = 'modified'").drop("status")


@query(ORDERS + CHANGED + """
select 'st' field, count(*) n from m where st1 <> st2 union all select 'p', count(*) from m where p1 <> p2""")
def field_change_counts(spark, d):
    return match.field_changes(match.changes(*orders(spark, d), ["k"], CORE), ["st", "p"])


@query(LINES + """,
u as (select 'l' s, * from l union all select 'r', * from r),
c as (select o, nr, rf, q, count(*) filter (where s = 'l') a, count(*) filter (where s = 'r') b from u group by o, nr, rf, q),
g as (select o, nr, sum(a - least(a, b)) rl, sum(b - least(a, b)) rr from c group by o, nr)
select case k when 0 then 'modified' when 1 then 'left_only' else 'right_only' end status,
  cast(sum(case k when 0 then least(rl, rr) when 1 then rl - least(rl, rr) else rr - least(rl, rr) end) as bigint) n
from g, (select unnest([0, 1, 2]) k) group by k""")
def change_status_counts_multiset(spark, d):
    found = match.changes(*lines(spark, d), ["o", "nr"], ["o", "nr", "rf", "q"])
    return found.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(ORDERS + CHANGED + "select concat('status: ', st1, ' → ', st2) as label, count(*) n from m where st1 <> st2 group by all")
def status_transitions(spark, d):
    found = match.changes(*orders(spark, d), ["k"], CORE)
    return match.transitions(found, [F.when(match.changed("st"), buckets.transition("status", F.col("st_before"), F.col("st_after")))])


@query(ORDERS + CHANGED + "select st1 first, count(*) filter (where st2 = 'X') as to_x, count(*) filter (where st2 <> 'X') as to_other from m where st1 <> st2 group by st1")
def transition_matrix(spark, d):
    found = match.changes(*orders(spark, d), ["k"], CORE).where(match.changed("st") & (F.col("status") == "modified"))
    grid = found.groupBy(F.col("st_before").alias("first")).pivot("st_after", ["X", "F", "O", "P"]).count().fillna(0)
    return grid.select("first", F.col("X").alias("to_x"), (F.col("F") + F.col("O") + F.col("P")).alias("to_other"))


@query(ORDERS + """,
j as (select coalesce(l.k, r.k) k, l.k is not null in_l, r.k is not null in_r, l.st st1, r.st st2, l.p p1, r.p p2 from l full join r on l.k = r.k)
select case when in_l and in_r then 'modified' when in_l then 'left_only' else 'right_only' end status, cast(k as varchar) as identity,
  case when in_l and in_r then concat_ws(',', case when st1 <> st2 then 'st' end, case when p1 <> p2 then 'p' end) else '' end changed_fields,
  case when in_l then st1 || '|' || p1 else '' end as first, case when in_r then st2 || '|' || p2 else '' end as second
from j where not (in_l and in_r and st1 = st2 and p1 = p2)""")
def difference_ledger(spark, d):
    return match.ledger(match.changes(*orders(spark, d), ["k"], CORE), ["k"], ["st", "p"])


DIGESTS = """
with f as (select md5('i' || l_orderkey) a, md5('i' || l_linenumber) b, md5('s' || length(l_returnflag) || ':' || l_returnflag) c,
  md5('d' || cast(l_extendedprice as decimal(18,2))) e from lineitem),
h as (select *, md5(a || b || c || e) rec from f)
"""
LANE = "cast('0x' || substr({0}, {1}, 12) as bigint)"


def _printed(column: str, lanes: int) -> str:
    """SQL of a fingerprint's values."""
    out = []
    for k in range(lanes):
        value = LANE.format(column, 1 + 12 * k)
        out += [f"cast(sum({value} >> 24) as bigint) high_{k}", f"cast(sum({value} & 16777215) as bigint) low_{k}", f"bit_xor({value}) xor_{k}"]
    if lanes == 1:
        out += ["0::bigint high_1", "0::bigint low_1", "0::bigint xor_1"]
    return ", ".join(out)


NAMES = {"l_orderkey": "a", "l_linenumber": "b", "l_returnflag": "c", "price": "e", "record": "rec"}


def _lineitem(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    return t.select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))


@query(DIGESTS + " union all ".join(f"select '{n}' as name, count(*) n, {_printed(c, 1 + (n == 'record'))} from h" for n, c in NAMES.items()))
def fingerprint_fields(spark, d):
    df = _lineitem(spark, d)
    return fingerprint.fingerprints(df, df.columns)


@query(DIGESTS + f"select count(*) n, {_printed('rec', 2)} from h")
def fingerprint_record(spark, d):
    df = _lineitem(spark, d)
    return fingerprint.fingerprints(df, df.columns).where("name = 'record'").drop("name")


def _same_sql(named: dict[str, str], one: str, two: str) -> str:
    """SQL of whether columns of two tables are equal as multisets, by name."""
    differ = "exists (select * from (select {c} from {a} except all select {c} from {b}))"
    each = (f"select '{n}' as name, not {differ.format(c=c, a=one, b=two)} and not {differ.format(c=c, a=two, b=one)} equal" for n, c in named.items())
    return " union all ".join(each)


@query(ORDERS + _same_sql({"k": "k", "st": "st", "p": "p", "record": "k, st, p"}, "l", "r"))
def changed_fields(spark, d):
    return fingerprint.compare(*orders(spark, d), CORE)


ITEMS = {n: n for n in ("l_orderkey", "l_linenumber", "l_returnflag", "price")} | {"record": "l_orderkey, l_linenumber, l_returnflag, price"}


@query(
    "with a as (select *, cast(l_extendedprice as decimal(18,2)) price from lineitem),"
    " b as (select * replace (case when l_orderkey % 3 = 0 then 'Q' else l_returnflag end as l_returnflag) from a order by price) "
    + _same_sql(ITEMS, "a", "b")
)
def equivalence_shuffled(spark, d):
    df = _lineitem(spark, d)
    other = df.withColumn("l_returnflag", F.when(F.col("l_orderkey") % 3 == 0, "Q").otherwise(F.col("l_returnflag")))
    return fingerprint.compare(df, other.repartition(7, "l_linenumber").sortWithinPartitions(F.desc("price")), df.columns)


@query(LINES + """,
once as (select o, nr, pos from (select 0 side, * from l union all select 1, * from r) group by all having count(*) = 2 and count(distinct side) = 2)
select o, nr, pos, l.rf rf_before, r.rf rf_after, l.q q_before, r.q q_after from l join r using (o, nr, pos) join once using (o, nr, pos)
where (l.rf <> r.rf) <> (l.q <> r.q)""")
def residual_pairing(spark, d):
    """Orders whose lines are told apart by likeness alone: the pairs of lines that differ in one field."""
    left, right = lines(spark, d)
    line = ["o", "nr", "pos"]
    found = match.changes(left, right, ["o"], ["o", "rf", "q", "nr", "pos"])
    one = (F.col("rf_before") != F.col("rf_after")).cast("int") + (F.col("q_before") != F.col("q_after")).cast("int")
    found = found.where((F.col("nr_before") == F.col("nr_after")) & (F.col("pos_before") == F.col("pos_after")) & (one == 1))
    found = found.select("o", F.col("nr_before").alias("nr"), F.col("pos_before").alias("pos"), "rf_before", "rf_after", "q_before", "q_after")
    sides = [df.select(*line, F.lit(k).alias("side")) for k, df in enumerate((left, right))]
    once = sides[0].union(sides[1]).groupBy(*line).agg(F.count("side").alias("n"), F.sum("side").alias("m")).where("n = 2 and m = 1")
    return found.join(once, line, "left_semi")


def _profile_sql(fields):
    named = ", ".join(fields)
    return ORDERS + f", a as (select {named} from l except all select {named} from r), b as (select {named} from r except all select {named} from l) select (select count(*) from a) left_rest, (select count(*) from b) right_rest"


def _profile(name, spark, d):
    return match.residual_counts(*orders(spark, d), ["k"], PROFILES[name])


for _name, _fields in PROFILES.items():
    QUERIES[f"profile_{_name}"] = partial(_profile, _name)
    QUERIES[f"profile_{_name}"].__name__ = f"profile_{_name}"
    ORACLES[f"profile_{_name}"] = _profile_sql(_fields)

EVENTS = """
with l as (select event_id k, user_id u, event_type t, cast(props->>'$.k' as bigint) v from events),
r as (select event_id k, user_id u, event_type t, case when event_id % 13 = 0 then null else cast(props->>'$.k' as bigint) + (case when event_id % 7 = 0 then 1 else 0 end) end v,
  event_id % 5 = 0 extra from events)
"""


def events(spark, d):
    t = spark.read.parquet(f"{d}/events.parquet")
    value = F.get_json_object("props", "$.k").cast("long")
    pairs = lambda v, extra: F.map_filter(F.create_map(F.lit("k"), v.cast("string"), F.lit("x"), F.when(extra, "1")), lambda _, x: x.isNotNull()).alias("m")
    k = F.col("event_id")
    left = t.select(k.alias("k"), "user_id", "event_type", pairs(value, F.lit(False)))
    right = t.select(k.alias("k"), "user_id", "event_type", pairs(F.when(k % 13 != 0, value + F.when(k % 7 == 0, 1).otherwise(0)), k % 5 == 0))
    return left, right


@query(EVENTS + """
select label, count(*) n from (
  select 'props added: x' as label from r where extra
  union all select 'props removed: k' from l join r using (k) where l.v is not null and r.v is null
  union all select 'props value changed: k' from l join r using (k) where l.v <> r.v) group by label""")
def props_key_diff(spark, d):
    left, right = events(spark, d)
    both = left.select("k", F.col("m").alias("a")).join(right.select("k", F.col("m").alias("b")), "k")
    return both.select(F.explode(match.map_transitions("props", F.col("a"), F.col("b"))).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(EVENTS + "select count(*) filter (where l.v is distinct from r.v) modified, count(*) filter (where l.v is not distinct from r.v) as identical from l join r using (k)")
def ignore_map_keys(spark, d):
    sides = [df.withColumn("m", F.map_filter("m", lambda k, _: k != "x")) for df in events(spark, d)]
    return match.totals(*sides, ["k"], ["k", "user_id", "event_type", "m"]).select("modified", "identical")


KEYS = ORDERS + ", a as (select distinct md5(cast(k as varchar)) h from l), b as (select distinct md5(cast(k as varchar)) h from r)"


def _keys(spark, d):
    return [df.select(F.md5(F.col("k").cast("string")).alias("h")) for df in orders(spark, d)]


@query(KEYS + "select h from a order by h limit 512")
def identity_kmv(spark, d):
    return sketch.kmv(_keys(spark, d)[0])


@query(KEYS + """,
s as (select h from a order by h limit 512), t as (select h from b order by h limit 512),
u as (select h, max(x) x, max(y) y from (select h, 1 x, 0 y from s union all select h, 0, 1 from t) group by h order by h limit 512),
j as (select count(*) sampled, cast(sum(x * y) as bigint) shared from u),
e as (select 511 / (cast(('0x' || substr((select max(h) from s), 1, 13)) as bigint) / 4503599627370496.0::double) na, 511 / (cast(('0x' || substr((select max(h) from t), 1, 13)) as bigint) / 4503599627370496.0::double) nb)
select sampled, shared, round(least(1.0, (shared::double / sampled) * (na + nb) / (1 + shared::double / sampled) / least(na, nb)), 6) containment from j, e""")
def kmv_containment(spark, d):
    out = sketch.containment(*(sketch.kmv(x) for x in _keys(spark, d)))
    return out.withColumn("containment", F.round("containment", 6))


@query(KEYS + "select (select count(*) from a) n_a, (select count(*) from b) n_b, count(*) shared, round(count(*)::double / least((select count(*) from a), (select count(*) from b)), 6) containment from a join b using (h)")
def exact_containment(spark, d):
    return sketch.exact_containment(*_keys(spark, d)).withColumn("containment", F.round("containment", 6))


@query(ORDERS + """, a as (select distinct k, st, p from l), b as (select distinct k, st, p from r),
v as (select round((select count(*) from (select * from a intersect select * from b))::double / least((select count(*) from a), (select count(*) from b))
  * least((select count(*) from l), (select count(*) from r)) / greatest((select count(*) from l), (select count(*) from r)), 6) similarity)
select similarity, case when similarity >= 0.98 then 'likely the same dataset' when similarity >= 0.2 then 'related datasets' else 'different datasets' end relation from v""")
def content_similarity(spark, d):
    left, right = orders(spark, d)
    both = sketch.exact_containment(*(df.select(record_digest(df, CORE).alias("h")) for df in (left, right)))
    sizes = left.agg(F.count(F.lit(1)).alias("a")).crossJoin(right.agg(F.count(F.lit(1)).alias("b")))  # one row each
    out = both.crossJoin(sizes).select(F.round(F.col("containment") * F.least("a", "b") / F.greatest("a", "b"), 6).alias("similarity"))
    return out.select("similarity", sketch.relationship(F.col("similarity"), F.lit(False), F.lit(False)).alias("relation"))


SPANS = "s as (select r_name contig, unnest([0, 100, 150, 150, 400]) as a, unnest([100, 120, 200, 180, 450]) as b from region)"


def _spans(spark, d):
    spans = F.array(*(F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end")) for a, b in ((0, 100), (100, 120), (150, 200), (150, 180), (400, 450))))
    return spark.read.parquet(f"{d}/region.parquet").select(F.col("r_name").alias("contig"), F.inline(spans))


@query("select r_name contig, unnest([0, 150, 400])::bigint as start, unnest([120, 200, 450])::bigint as \"end\" from region")
def interval_merge(spark, d):
    return regions.merge(_spans(spark, d))


def _placed(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("contig"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + 3).alias("end"))


def _flag_spans(spark):
    return spark.createDataFrame([("A", 10, 40), ("A", 35, 60), ("R", 100, 101), ("R", 0, 5)], "contig string, start long, end long")


FLAGS = "with s(contig, a, b) as (values ('A', 10, 40), ('A', 35, 60), ('R', 100, 101), ('R', 0, 5)) select l_orderkey, l_linenumber, l_returnflag contig, l_partkey as start, l_partkey + 3 as \"end\" from lineitem where {0} exists (select 1 from s where contig = l_returnflag and a < l_partkey + 3 and b > l_partkey)"


@query(FLAGS.format(""))
def region_include(spark, d):
    return regions.allowed(_placed(spark, d), _flag_spans(spark), None)


@query(FLAGS.format("not"))
def region_exclude(spark, d):
    return regions.allowed(_placed(spark, d), None, _flag_spans(spark))


WINDOWS = LINES + """,
c as (select contig, pos from (select rf contig, pos from l where pos % 7 = 0 union all select rf, pos from r where pos % 11 = 0)),
u as (select rf contig, pos, 1 a, 0 b, 0 c from l union all select rf, pos, 0, 1, 0 from r union all select contig, pos, 0, 0, 1 from c),
w as (select contig, cast(floor(pos / 50.0) as bigint) as "window", cast(sum(a) as bigint) n_left, cast(sum(b) as bigint) n_right, cast(sum(c) as bigint) changes from u group by all)
"""


def _windows(spark, d):
    left, right = (df.select(F.col("rf").alias("contig"), F.col("pos").alias("position")) for df in lines(spark, d))
    return tracks.windows(left, right, left.where("position % 7 = 0").union(right.where("position % 11 = 0")), 50)


@query(WINDOWS + 'select contig, "window", n_left, n_right, changes, "window" * 50 as start, ("window" + 1) * 50 as "end", round(changes::double / greatest(1, n_left + n_right), 6) fraction from w')
def window_density(spark, d):
    return tracks.density(_windows(spark, d), 50).drop("coverage_log2").withColumn("fraction", F.round("fraction", 6))


@query(WINDOWS + 'select contig, "window", round(log2((n_right + 1)::double / (n_left + 1)), 6) coverage_log2 from w')
def coverage_ratio(spark, d):
    return tracks.density(_windows(spark, d), 50).select("contig", "window", F.round("coverage_log2", 6).alias("coverage_log2"))


@query(WINDOWS + "select contig, cast(sum(n_left) as bigint) n_left, cast(sum(n_right) as bigint) n_right, cast(sum(changes) as bigint) changes, round(sum(changes)::double / greatest(1, sum(n_left) + sum(n_right)), 6) fraction, round(log2((sum(n_right) + 1)::double / (sum(n_left) + 1)), 6) coverage_log2 from w group by contig")
def contig_stats(spark, d):
    out = tracks.contigs(_windows(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in ("fraction", "coverage_log2")})


@query(WINDOWS + 'select * from w where changes > 0 order by changes desc, contig, "window" limit 20')
def top_windows(spark, d):
    return tracks.top(_windows(spark, d), 20)


METRICS = """
with m as (select 'discount' metric, round_even(l_discount * 20, 0) / 20 bucket, l_partkey % 2 side from lineitem
  union all select 'quantity', least(40, floor(l_quantity / 5) * 5), l_partkey % 2 from lineitem
  union all select 'returned', case when l_returnflag = 'R' then 1 else 0 end, l_partkey % 2 from lineitem where l_shipdate is not null),
h as (select side, metric, cast(bucket as double) bucket, count(*) n from m group by all)
"""


def _metrics(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    which = {
        "discount": buckets.half_even(F.col("l_discount"), 20),
        "quantity": buckets.bucket(F.col("l_quantity"), 5, 40),
        "returned": F.when(F.col("l_shipdate").isNotNull(), F.when(F.col("l_returnflag") == "R", 1).otherwise(0)),
    }
    return [metrics.histograms(t.where(F.col("l_partkey") % 2 == side), which) for side in (0, 1)]


@query(METRICS + "select metric, bucket, n from h where side = 0")
def metric_histogram(spark, d):
    return _metrics(spark, d)[0]


@query(METRICS + """,
t as (select metric, sum(n) filter (where side = 0) a, sum(n) filter (where side = 1) b from h group by metric),
j as (select metric, bucket, coalesce(sum(n) filter (where side = 0), 0) a, coalesce(sum(n) filter (where side = 1), 0) b from h group by metric, bucket)
select metric, cast(t.a as bigint) n_left, cast(t.b as bigint) n_right, round(sum(abs(j.a::double / t.a - j.b::double / t.b)) / 2, 6) distance from j join t using (metric) group by metric, t.a, t.b""")
def tv_distance(spark, d):
    return metrics.distances(*_metrics(spark, d)).withColumn("distance", F.round("distance", 6))


@query(METRICS + "select metric, median(bucket) as median from (select metric, bucket, unnest(range(n)) from h where side = 0) group by metric")
def weighted_median(spark, d):
    return metrics.medians(_metrics(spark, d)[0])


@query("""
with h as (select l_partkey::double bucket, count(*) n from lineitem group by 1),
i as (select *, row_number() over (order by bucket) - 1 k, count(*) over () total from h)
select 'part' metric, cast(floor(k / ceil(total / 32.0)) as bigint) bin, min(bucket) low, max(bucket) high, cast(sum(n) as bigint) n from i group by bin""")
def histogram_bins(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    return metrics.bins(metrics.histograms(t, {"part": F.col("l_partkey")}))


@query(METRICS + "select side, round(sum(n) filter (where bucket = 1)::double / sum(n), 6) rate from h where metric = 'returned' group by side")
def rate_shift(spark, d):
    parts = [h.where("metric = 'returned'").agg(F.round(F.sum(F.when(F.col("bucket") == 1, F.col("n"))) / F.sum("n"), 6).alias("rate")).select(F.lit(side).cast("long").alias("side"), "rate") for side, h in enumerate(_metrics(spark, d))]
    return parts[0].union(parts[1])


@query(ORDERS + """,
j as (select coalesce(r.g, l.g) g from l full join r on l.k = r.k where l.k is null or r.k is null or (l.st, l.p) is distinct from (r.st, r.p))
select c_mktsegment segment, count(*) n from j join customer on c_custkey = g group by 1""")
def group_attribution(spark, d):
    found = match.changes(*orders(spark, d), ["k"], PROFILES["strict"])
    changed = found.select(F.coalesce("g_after", "g_before").alias("c_custkey"))
    groups = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return changed.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n")).join(groups, "c_custkey").groupBy("segment").agg(F.sum("n").alias("n"))


STAGES = ORDERS + """,
u as (select 1 a, 0 b, k, st, p from l union all select 0, 1, k, st, p from r),
c as (select k, k % 4 as sample, st, p, sum(a) nl, sum(b) nr from u group by all),
g as (select k, sample, sum(least(nl, nr)) i, sum(nl) nl, sum(nr) nr, sum(nl - least(nl, nr)) rl, sum(nr - least(nl, nr)) rr from c group by all),
s as (select sample, sum(nl) n_left, sum(nr) n_right, sum(least(rl, rr)) modified, sum(rl - least(rl, rr)) left_only, sum(rr - least(rl, rr)) right_only from g group by sample)
"""


def _stages(spark, d):
    found = match.by_key(*orders(spark, d), ["k"], CORE)
    pairs = F.least("rest_left", "rest_right")
    sums = {
        "n_left": F.col("identical") + F.col("rest_left"), "n_right": F.col("identical") + F.col("rest_right"),
        "modified": pairs, "left_only": F.col("rest_left") - pairs, "right_only": F.col("rest_right") - pairs,
    }
    return found.groupBy((F.col("key.k0") % 4).alias("sample")).agg(*(F.sum(c).alias(n) for n, c in sums.items()))


POLICY = policy.Policy(
    max_modified=180, max_only=120, max_modified_fraction=0.05, min_overlap=0.9885, allow_fields=("st",), deny_fields=("st",),
    deny_transitions=("status: o → *",), transition_default="fail", allow_transitions=("price*",),
)


@query(STAGES + """,
m as (select l.k % 4 as sample, l.st st1, r.st st2, l.p p1, r.p p2 from l join r on l.k = r.k where (l.st, l.p) is distinct from (r.st, r.p)),
t as (select sample, label, count(*) n from (select sample, concat('status: ', st1, ' → ', st2) as label from m where st1 <> st2
  union all select sample, 'price changed' from m where p1 <> p2) group by all),
said as (select sample, list(case when label like 'status: O → %' then 'forbidden transition ''status: o → *'' occurred ' || format('{:,}', n) || ' times'
  when label not like 'price%' then 'unapproved transition ''' || label || ''' occurred ' || format('{:,}', n) || ' times' end order by label) moves from t group by sample),
f as (select sample, bool_or(st1 <> st2) st, bool_or(p1 <> p2) p from m group by sample),
o as (select sample, shared::double / least(a, b) overlap from (select coalesce(l.k, r.k) % 4 as sample, count(l.k) a, count(r.k) b,
  count(*) filter (where l.k is not null and r.k is not null) shared from l full join r on l.k = r.k group by 1)),
v as (select s.*, overlap, st, p, moves, modified::double / greatest(1, least(n_left, n_right)) share, s.left_only + s.right_only as only_one
  from s join o using (sample) left join f using (sample) left join said using (sample)),
w as (select sample, list_filter([
  case when modified > 180 then 'modified records ' || format('{:,}', modified::bigint) || ' exceed 180' end,
  case when share > 0.05 then 'modified fraction ' || printf('%.1f', 100 * share) || '% exceed 5.0%' end,
  case when only_one > 120 then 'sample-only records ' || format('{:,}', only_one::bigint) || ' exceed 120' end,
  case when overlap < 0.9885 then 'identity overlap ' || printf('%.1f', 100 * overlap) || '% is below 98.9%' end,
  case when sample = 2 then 'structural header differs' end,
  case when st then 'forbidden changed fields: st' end, case when p then 'unexpected changed fields: p' end] || coalesce(moves, []),
  lambda x: x is not null) violations from v)
select cast(sample as bigint) as sample, violations, len(violations) = 0 passed from w""")
def policy_eval(spark, d):
    left, right = orders(spark, d)
    sample = (F.col("k") % 4).alias("sample")
    found = match.changes(left, right, ["k"], CORE).where("status = 'modified'")
    status, price = match.changed("st"), match.changed("p")
    names = [F.when(status, buckets.transition("status", F.col("st_before"), F.col("st_after"))), F.when(price, F.lit("price changed"))]
    each = found.select(sample, F.explode(F.filter(F.array(*names), lambda x: x.isNotNull())).alias("label"))
    moves = each.groupBy("sample", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("sample")
    moves = moves.agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("transitions"))
    fields = found.select(sample, F.explode(F.array(F.when(status, "st"), F.when(price, "p"))).alias("field")).groupBy("sample")
    fields = fields.agg(F.collect_set("field").alias("changed_fields"))
    sides = [df.select("k").distinct().select(sample, "k", F.lit(name).alias("side")) for df, name in ((left, "a"), (right, "b"))]
    keys = sides[0].union(sides[1]).groupBy("sample", "k")
    keys = keys.agg(F.count_if(F.col("side") == "a").alias("a"), F.count_if(F.col("side") == "b").alias("b"))
    overlap = keys.groupBy("sample").agg((F.sum(F.col("a") * F.col("b")) / F.least(F.sum("a"), F.sum("b"))).alias("overlap"))
    rows = _stages(spark, d).join(overlap, "sample").join(fields, "sample", "left").join(moves, "sample", "left")
    rows = rows.withColumns({
        "structure_equal": F.col("sample") != 2,
        "changed_fields": F.coalesce("changed_fields", F.array().cast("array<string>")),
        "transitions": F.coalesce("transitions", F.create_map().cast("map<string,bigint>")),
    })
    return policy.evaluate(rows, POLICY).select("sample", "violations", "passed")


@query("""
with s as (select o_custkey % 5 as sample, o_orderstatus stage, ascii(o_orderstatus) as place, count(*) filter (where o_orderkey % 31 = 0) n
  from orders group by all)
select sample, min_by(stage, place) stage from s where n > 0 group by sample""")
def earliest_divergence(spark, d):
    t = spark.read.parquet(f"{d}/orders.parquet")
    rows = t.groupBy((F.col("o_custkey") % 5).alias("sample"), F.col("o_orderstatus").alias("stage")).agg((F.count_if(F.col("o_orderkey") % 31 == 0) == 0).alias("equivalent"))
    return policy.earliest_divergence(rows.withColumn("position", F.ascii("stage")))


@query(ORDERS + CHANGED + """
select label, count(*) n from (select concat('status: ', st1, ' → ', st2) as label from m where st1 <> st2 union all select 'price changed' from m where p1 <> p2)
group by label order by n desc, label limit 100""")
def transition_totals(spark, d):
    found = match.changes(*orders(spark, d), ["k"], CORE)
    labels = [F.when(match.changed("st"), buckets.transition("status", F.col("st_before"), F.col("st_after"))), F.when(match.changed("p"), F.lit("price changed"))]
    return policy.transition_totals(match.transitions(found, labels))


CHANGED_COPY = """
with a as (select o_orderkey k, o_orderstatus st, cast(o_totalprice as decimal(18,2)) p from orders where o_orderkey % 97 <> 0),
b as (select k, case when k % 31 = 0 then 'X' else st end st, cast(case when k % 53 = 0 then p + 1 else p end as decimal(18,2)) p from a)
"""


@query(CHANGED_COPY + f""", e as ({_same_sql({"k": "k", "st": "st", "p": "p", "record": "k, st, p"}, "a", "b")})
select 'a' as sample, 'first' stage, true passed, []::varchar[] changed_fields
union all select 'a', 'second', bool_or(equal) filter (where name = 'record'), list(name order by name) filter (where name <> 'record' and not equal) from e
union all select 'b', 'first', false, list(name order by name) filter (where name <> 'record') from e""")
def baseline_check(spark, d):
    """A stage that is as it was, one that has changed, and one that the second baseline lacks: all its fields differ."""
    left, _ = orders(spark, d)
    status = F.when(F.col("k") % 31 == 0, "X").otherwise(F.col("st"))
    price = F.when(F.col("k") % 53 == 0, F.col("p") + 1).otherwise(F.col("p")).cast("decimal(18,2)")
    changed = left.withColumns({"st": status, "p": price})
    before = baseline.create({("a", "first"): left, ("a", "second"): left, ("b", "first"): left}, CORE)
    after = baseline.create({("a", "first"): left.repartition(3), ("a", "second"): changed}, CORE)
    return baseline.check(before, after)


@query("""
with a as (select column_name as name, column_type as kind from (describe select * from orders)),
b as (select column_name as name, column_type as kind
  from (describe select * exclude (o_custkey) replace (cast(o_orderkey as varchar) as o_orderkey), 1 extra from orders))
select name, case when a.kind is null then 'added' when b.kind is null then 'removed' else 'changed' end as change
from a full join b using (name) where a.kind is distinct from b.kind""")
def header_diff(spark, d):
    t = spark.read.parquet(f"{d}/orders.parquet")
    other = t.drop("o_custkey").withColumns({"o_orderkey": F.col("o_orderkey").cast("string"), "extra": F.lit(1)})
    return headers.differences(headers.schema_rows(t), headers.schema_rows(other))


@query("""
with p as (select 'stage' || (c_custkey % 3) || '/sample' || c_custkey || '.vcf.gz' path, c_custkey k from customer)
select path, 'sample' || k as sample, 'stage' || (k % 3) as stage,
  case when k % 10 = 0 then 'missing before' when k % 11 = 0 then 'missing after' else 'paired' end status from p where not (k % 10 = 0 and k % 11 = 0)""")
def manifest_pairing(spark, d):
    k = F.col("c_custkey")
    t = spark.read.parquet(f"{d}/customer.parquet").select(k, F.concat(F.lit("stage"), (k % 3).cast("string"), F.lit("/sample"), k.cast("string"), F.lit(".vcf.gz")).alias("path"))
    return manifest.pair(t.where(k % 10 != 0), t.where(k % 11 != 0))


CALLS = """
with c as (select 'u' || (user_id % 6) as sample, event_id % 200 as locus, event_type genotype from events),
a as (select * from c where sample < 'u3'), b as (select sample, locus, case when locus % 9 = 0 then 'other' else genotype end genotype from c),
n as (select distinct a.sample "first", b.sample "second" from a, b),
j as (select a.sample "first", b.sample "second", count(*) shared, count(*) filter (where a.genotype = b.genotype) matches from a join b using (locus) group by all),
p as (select "first", "second", coalesce(shared, 0) shared, coalesce(matches, 0) matches, round(coalesce(matches, 0)::double / greatest(coalesce(shared, 0), 1), 6) concordance from n left join j using ("first", "second"))
"""


def _concordance(spark, d):
    calls = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("u"), (F.col("user_id") % 6).cast("string")).alias("sample"), (F.col("event_id") % 200).alias("locus"), F.col("event_type").alias("genotype"))
    other = calls.withColumn("genotype", F.when(F.col("locus") % 9 == 0, "other").otherwise(F.col("genotype")))
    return identity.concordance(calls.where("sample < 'u3'"), other).withColumn("concordance", F.round("concordance", 6))


@query(CALLS + "select * from p")
def call_concordance(spark, d):
    return _concordance(spark, d)


@query(CALLS + "select \"first\", \"second\", case when shared < 20 then 'insufficient calls' when concordance >= 0.98 then 'match' when concordance >= 0.9 then 'possible match' else 'mismatch' end status from p")
def pair_status(spark, d):
    return _concordance(spark, d).select("first", "second", identity.status(F.col("shared"), F.col("concordance")).alias("status"))


@query(CALLS.replace("\nwith c as", "\nwith recursive c as") + """,
o as (select *, row_number() over (order by concordance desc, shared desc, "second", "first") nr from p),
g as (select 0::bigint nr, []::varchar[] used_a, []::varchar[] used_b, []::bigint[] taken
  union all
  select nr, case when free then list_append(used_a, "first") else used_a end, case when free then list_append(used_b, "second") else used_b end,
    case when free then list_append(taken, nr) else taken end
  from (select o.nr, used_a, used_b, taken, "first", "second", not list_contains(used_a, "first") and not list_contains(used_b, "second") free
    from g join o on o.nr = g.nr + 1)),
e as (select * from g order by nr desc limit 1)
select "first", "second", shared, concordance from o, e where list_contains(taken, o.nr)
union all select "first", arg_min("second", o.nr), arg_min(shared, o.nr), arg_min(concordance, o.nr) from o, e
  where not list_contains(used_a, "first") group by 1""")
def best_match(spark, d):
    rows = identity.best_matches(_concordance(spark, d))
    schema = "first string, second string, shared long, concordance double"
    return spark.createDataFrame([(r["first"], r["second"], r["shared"], r["concordance"]) for r in rows], schema)


SOURCES = """
with t as (select source as name, md5(text) h from documents), c as (select name, h, count(*) n from t group by all),
s as (select name, count(*) kinds, sum(n) records from c group by name),
p as (select x.name a, y.name b, x.kinds ka, y.kinds kb, x.records ra, y.records rb from s x join s y on x.name < y.name),
j as (select x.name a, y.name b, count(*) shared from c x join c y on x.h = y.h and x.name < y.name group by all),
v as (select a, b, coalesce(shared, 0) shared, coalesce(shared, 0)::double / least(ka, kb) * least(ra, rb) / greatest(ra, rb) similarity from p left join j using (a, b)),
m as (select name, avg(similarity) as mean from (select a as name, similarity from v union all select b, similarity from v) group by name)
"""


def _similarities(spark, d):
    return matrix.similarities(spark.read.parquet(f"{d}/documents.parquet").select(F.col("source").alias("name"), F.md5("text").alias("h")))


@query(SOURCES + "select a, b, shared, round(similarity, 6) similarity from v")
def similarity_matrix(spark, d):
    return _similarities(spark, d).withColumn("similarity", F.round("similarity", 6))


UNLIKE = SOURCES.replace(
    "select source as name, md5(text) h from documents",
    """select 'copy' || n as name, md5(text) h from documents, (select unnest([0, 1, 2, 3]) n) where n = 0 or doc_id % (10 * n) <> 0
  union all select 'other', md5(text || '.') from documents""",
)


@query(UNLIKE + "select name, round(mean, 6) as mean from m where mean < (select median(mean) from m) - 0.15")
def matrix_outliers(spark, d):
    """Four copies with some rows left out, and a table that is unlike them."""
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    copies = t.select("text", "doc_id", F.explode(F.array(*map(F.lit, range(4)))).alias("n"))
    copies = copies.where((F.col("n") == 0) | (F.col("doc_id") % F.when(F.col("n") > 0, 10 * F.col("n")) != 0))
    digests = copies.select(F.concat(F.lit("copy"), F.col("n").cast("string")).alias("name"), F.md5("text").alias("h"))
    other = t.select(F.lit("other").alias("name"), F.md5(F.concat("text", F.lit("."))).alias("h"))
    return matrix.outliers(matrix.similarities(digests.union(other))).withColumn("mean", F.round("mean", 6))


@query(SOURCES + "select name, round(mean, 6) as mean from m")
def matrix_means(spark, d):
    return matrix.means(_similarities(spark, d)).withColumn("mean", F.round("mean", 6))


@query("""
with t as (select md5(text) h, count(*) n, min(doc_id) first_id from documents group by 1)
select h, n, first_id from t where n > 1""")
def duplicate_documents(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet")
    return t.groupBy(F.md5("text").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("""
with l as (select doc_id, text from documents), r as (select doc_id, case when doc_id % 41 = 0 then text || '!' else text end text from documents where doc_id % 43 <> 0)
select count(*) filter (where r.text = l.text) as identical, count(*) filter (where r.text <> l.text) modified, count(*) filter (where r.doc_id is null) left_only, 0::bigint right_only
from l left join r using (doc_id)""")
def document_diff(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    k = F.col("doc_id")
    return match.totals(t, t.where(k % 43 != 0).withColumn("text", F.when(k % 41 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))), ["doc_id"], ["doc_id", "text"])


@query("""
with reads as (select p_partkey k, 'chr' || (p_partkey % 3) contig, (p_partkey * 7) % 500 as start, p_size % 41 mq from part where p_size % 41 >= 20),
sites as (select n_nationkey, 'chr' || (n_nationkey % 3) contig, 20 * n_nationkey + 5 pos from nation),
hits as (select contig, pos, k, pos - 1 - start off from reads join sites using (contig) where pos - 1 between start and start + 7 and not pos - 1 - start between 4 and 5)
select contig, pos::bigint pos, 'A' as ref, 'C' as alt, count(*) depth, count(*) filter (where k % 4 = 0) alt_depth,
  case when count(*) filter (where k % 4 = 0)::double / count(*) < 0.2 then '0/0' when count(*) filter (where k % 4 = 0)::double / count(*) > 0.8 then '1/1' else '0/1' end genotype
from hits group by contig, pos""")
def pileup_calls(spark, d):
    k = F.col("p_partkey")
    # four matches, a deletion of two, two matches, a clip of one
    ops = F.array(*(F.struct(F.lit(op).alias("op"), F.lit(n).alias("len")) for op, n in ((0, 4), (2, 2), (0, 2), (4, 1))))
    reads = spark.read.parquet(f"{d}/part.parquet").select(
        F.concat(F.lit("chr"), (k % 3).cast("string")).alias("contig"), (k * 7 % 500).alias("start"), (F.col("p_size") % 41).alias("mapping_quality"),
        ops.alias("cigar"), F.repeat(F.when(k % 4 == 0, "C").otherwise("A"), 7).alias("sequence"), F.array_repeat(F.lit(30), 7).alias("qualities"),
    )
    n = F.col("n_nationkey")
    sites = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("chr"), (n % 3).cast("string")).alias("contig"), (20 * n + 5).cast("long").alias("pos"), F.lit("A").alias("ref"), F.lit("C").alias("alt"))
    return identity.pileup(reads, sites, 1)


@query("""
select o_orderkey k, flags, case when flags & 4 <> 0 then 'unmapped' else 'mapped' end mapping, case when flags & 2048 <> 0 then 'supplementary' when flags & 256 <> 0 then 'secondary' else 'primary' end kind,
  case when flags & 1024 <> 0 then 'set' else 'clear' end duplicate, case when flags & 512 <> 0 then 'failed' else 'passed' end qc, case when flags & 16 <> 0 then 'reverse' else 'forward' end strand
from (select o_orderkey, cast(o_orderkey % 4096 as integer) flags from orders)""")
def flag_states(spark, d):
    t = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 4096).cast("int").alias("flags"))
    states = buckets.flag_states(F.col("flags"))
    names = {"mapping": "mapping status", "kind": "alignment class", "duplicate": "duplicate flag", "qc": "QC status", "strand": "strand"}
    return t.select("k", "flags", *(states[label].alias(n) for n, label in names.items()))


@query("select c_custkey, 'customer-' || lpad(cast(c_custkey as varchar), 9, '0') slug from customer where regexp_matches(c_name, '^Customer#[0-9]{9}$') union all select c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') from customer where not regexp_matches(c_name, '^Customer#[0-9]{9}$')")
def safe_slugs(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", buckets.slug(F.col("c_name")).alias("slug"))


@query(ORDERS + "select cast(sum(" + LANE.format("md5('i' || k)", 1) + " >> 24) as bigint) total from l")
def lane_sums(spark, d):
    left, _ = orders(spark, d)
    digest = F.md5(F.concat(F.lit("i"), F.col("k").cast("string")))
    return left.select(F.shiftright(lane(digest, 0), 24).alias("x")).agg(F.sum("x").alias("total"))
