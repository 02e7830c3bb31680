"""Relations on small tables with nulls and ties."""

from clausula.operators import relations as R


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_relations(spark):
    t = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", 3, "x"), (None, 4, "z"), (None, 5, "z")], "k string, n int, o string")
    known = spark.createDataFrame([("a", 0), ("a", 0), (None, 0)], "k string, other int")
    assert rows(R.repeats(t, ["k"], "n")) == [("a", 2, "y"), ("a", 2, "y"), (None, 5, "z")]
    assert rows(R.repeat_counts(t, ["k"])) == [("a", 2), (None, 1)]
    assert rows(R.unresolved(t, known, ["k"])) == [("b", 3, "x"), (None, 4, "z"), (None, 5, "z")]
    assert rows(R.resolved(t, known, ["k"])) == [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y")]
    assert rows(R.first_of(t, ["k"], "n")) == [("a", 1, "x"), ("b", 3, "x"), (None, 4, "z")]
    assert rows(R.shared_members(t, ["o"], "k")) == [("x", 2)]
    assert rows(R.union_of(t.select("k"), known.select("k"))) == [("a",), ("b",), (None,)]
    assert rows(R.common_to(t.select("k"), known.select("k"))) == [("a",), (None,)]
    bounds = spark.createDataFrame([("a", 2, 2), ("b", 0, None)], "k string, lower int, upper int")
    assert rows(R.outside_bounds(t, bounds, "k", "n").select("k", "n")) == [("a", 1)]
    assert rows(R.score(R.coverage(t, ["k"], low=t.n < 2), "low", 2)) == [("a", 1, 3, 0.33), ("b", 0, 1, 0.0), (None, 0, 2, 0.0)]
    assert R.repeats(t.limit(0), ["k"], "n").count() == 0
