from pyspark.sql import functions as F

from rowparity.batch import Batch, Item, judge
from rowparity.compare import compare
from rowparity.operators.policy import Policy


def test_a_denied_transition_beyond_the_100_most_frequent(spark):
    values = [f"v{k:03}" for k in range(120) for _ in range(2)] + ["rare"]
    a = spark.createDataFrame([(k, "old") for k in range(len(values))], "k int, v string")
    b = spark.createDataFrame(list(enumerate(values)), "k int, v string")
    result = compare(a, b, ["k"], explain=True, transitions=[F.concat(F.lit("v: "), "v_before", F.lit(" → "), "v_after")])
    assert len(result.transitions) == 121 and result.transitions["v: old → rare"] == 1
    violations, passed = judge(spark, result, Policy(deny_transitions=("rare",)))
    assert not passed and any("rare" in v for v in violations)
    assert len(Batch([Item("s", "t", result, violations, passed, (), 0.0)]).transitions) == 100
