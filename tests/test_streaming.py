import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from clausula.operators.constraints import Constraint
from clausula.streaming import occurrences as O


def events(spark, small, tmp_path, files=3):
    df = spark.read.parquet(f"{small}/events.parquet").orderBy("ts")
    parts = df.withColumn("_part", F.ntile(files).over(Window.orderBy("ts"))).collect()
    for k in range(1, files + 1):  # one after the other, as the stream reads files in the order of their times
        rows = [tuple(r)[:-1] for r in parts if r["_part"] == k]
        spark.createDataFrame(rows, df.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
    return df, O.read_events(spark, f"{tmp_path}/in", df.schema, files=1)


def test_validated_stream_is_the_table(spark, small, tmp_path):
    table, stream = events(spark, small, tmp_path)
    rules = [Constraint("value", "max", 60.0, "VALUE_MAX"), Constraint("event_type", "enumValues", ("click", "view"), "TYPE")]
    O.write_table(O.validated(stream, rules), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").groupBy("verdict").count().collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, O.validated(table, rules).groupBy("verdict").count().collect()))


def test_aggregation_drops_or_revises(spark, small, tmp_path):
    table, stream = events(spark, small, tmp_path)
    a = O.Aggregation(("event_type",), "ts", "tumbling", "1 day")
    want = {(r.event_type, r.window_start): r.n for r in O.aggregated(table, a, {"n": F.count("*")}).collect()}
    O.write_table(O.aggregated(stream, a, {"n": F.count("*")}), f"{tmp_path}/out", f"{tmp_path}/cp", a.mode).awaitTermination()
    got = {(r.event_type, r.window_start): r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(got) > 0.5 * len(want) and all(want[k] == n for k, n in got.items())  # the last windows stay open
    r = O.Aggregation(("event_type",), "ts", "tumbling", "1 day", late="revise", lateness="60 days")
    O.write_table(O.aggregated(stream, r, {"n": F.count("*")}), f"{tmp_path}/rev", f"{tmp_path}/cp2", r.mode).awaitTermination()
    last = spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/rev").groupBy("event_type", "window_start").agg(F.max_by("n", "batch").alias("n")).collect()
    assert {(x.event_type, x.window_start): x.n for x in last} == want


def test_first_seen_and_state(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", "2024-01-01 00:00:00"), ("a", "x", "2024-01-01 00:01:00"), ("a", "y", "2024-01-01 00:02:00"), ("b", "z", "2024-01-01 00:03:00")], "k string, v string, ts string").withColumn("ts", F.to_timestamp("ts"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = O.read_events(spark, f"{tmp_path}/in", rows.schema)
    O.write_table(O.first_seen(stream, ["k", "v"], "ts"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert {(r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {("a", "x"), ("a", "y"), ("b", "z")}
    O.write_table(O.state_changes(stream, "k", "ts", "v"), f"{tmp_path}/st", f"{tmp_path}/cp2", "update").awaitTermination()
    got = spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/st").collect()
    assert {(r.key, r.before, r.after) for r in got} == {("a", None, "x"), ("a", "x", "y"), ("b", None, "z")}
