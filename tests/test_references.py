"""References that a listing lacks are counted before they meet it."""

from tidewake.operators.crosswalk import unlisted_references


def test_values_are_counted_below_the_join(spark):
    rows = spark.createDataFrame([("a;b;",), ("b; ;c",), (None,), ("b",)], "refs string")
    listed = spark.createDataFrame([("a",), ("a",), (None,)], "id string")
    found = unlisted_references(rows, "refs", listed, "id")
    assert sorted(map(tuple, found.collect())) == [("b", 3), ("c", 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate") < plan.index("Generate")
