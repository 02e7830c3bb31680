"""Queries of differential runs: orders are cases, their lines expected findings, and three adapters answer most of them right, by rules on the keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausula.operators import differential
from clausula.plans.tables import load

ADAPTERS = {"a": 11, "b": 13, "c": 17}  # each adapter errs on keys by a modulus of its own


def _run(spark, sf):
    """Cases, expected findings, answers, findings, adapters. Of the keys modulo an adapter's number: 1 no answer, 2 another state, 3 a finding less (the least line number), 4 one more, 5 an answer twice; 6 a case that is none."""
    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderstatus").alias("state")).distinct()
    lines = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.concat(F.lit("/l/"), F.col("l_linenumber").cast("string")).alias("pointer"), F.col("l_returnflag").alias("code"), "l_linenumber")
    adapters = spark.createDataFrame([(a,) for a in ADAPTERS], "adapter string")
    m = F.create_map(*[F.lit(x) for pair in ADAPTERS.items() for x in pair])
    each = F.explode(F.array(*map(F.lit, ADAPTERS))).alias("adapter")
    err = F.col("case_id") % m[F.col("adapter")]
    answers = o.select("case_id", "state", each).withColumn("err", err).where("err <> 1")
    answers = answers.withColumn("times", F.explode(F.when(F.col("err") == 5, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    answers = answers.select("adapter", F.when(F.col("err") == 6, -F.col("case_id")).otherwise(F.col("case_id")).alias("case_id"), F.when(F.col("err") == 2, "X").otherwise(F.col("state")).alias("state"))
    found = lines.select("*", each).withColumn("err", err).where("NOT (err = 3 AND l_linenumber = 1)").select("adapter", "case_id", "pointer", "code")
    more = o.select("case_id", each).withColumn("err", err).where("err = 4").select("adapter", "case_id", F.lit("/extra").alias("pointer"), F.lit("E").alias("code"))
    return o, lines.select("case_id", "pointer", "code"), answers, found.unionByName(more), adapters


def differential_report(spark, sf) -> DataFrame:
    r = differential.run(*_run(spark, sf))
    return r.select("adapter", "case_id", "status", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"))


def differential_accounts(spark, sf) -> DataFrame:
    """Against thresholds: a needs no match, c more than there are cases; b has none, and d is no adapter."""
    return differential.accounts(differential.run(*_run(spark, sf)), spark.createDataFrame([("a", 0), ("c", 1 << 40), ("d", 0)], "adapter string, least long"))


def differential_disagreements(spark, sf) -> DataFrame:
    _, _, answers, findings, _ = _run(spark, sf)
    return differential.disagreements(answers.where("case_id >= 0").distinct(), findings)


QUERIES: dict[str, Callable] = {f.__name__: f for f in (differential_report, differential_accounts, differential_disagreements)}
_BASE = f"""
WITH o AS (SELECT DISTINCT o_orderkey AS case_id, o_orderstatus AS state FROM orders),
s AS (SELECT case_id, adapter, state, case_id % modulus AS err FROM o, (VALUES {', '.join(f"('{a}', {m})" for a, m in ADAPTERS.items())}) x(adapter, modulus)),
f AS (SELECT DISTINCT l_orderkey AS case_id, '/l/' || l_linenumber || ' ' || l_returnflag AS finding, l_linenumber FROM lineitem),
gone AS (SELECT case_id, string_agg(finding, ',' ORDER BY finding) AS missing FROM f WHERE l_linenumber = 1 GROUP BY 1),
r AS (
  SELECT adapter, case_id, CASE err WHEN 1 THEN 'unanswered' WHEN 6 THEN 'unanswered' WHEN 5 THEN 'repeated' WHEN 2 THEN 'state' WHEN 3 THEN CASE WHEN missing IS NULL THEN 'matched' ELSE 'findings' END WHEN 4 THEN 'findings' ELSE 'matched' END AS status,
    CASE WHEN err = 3 THEN coalesce(missing, '') ELSE '' END AS missing, CASE WHEN err = 4 THEN '/extra E' ELSE '' END AS extra
  FROM s LEFT JOIN gone USING (case_id)
  UNION ALL SELECT adapter, -case_id, 'unknown', '', '' FROM s WHERE err = 6)"""
SQL: dict[str, str] = {
    "differential_report": _BASE + " SELECT * FROM r",
    "differential_accounts": _BASE + """,
n AS (SELECT adapter, count(*) FILTER (WHERE status = 'matched') AS matched, count(*) FILTER (WHERE status <> 'matched') AS unmet, count(*) AS total FROM r WHERE status <> 'unknown' GROUP BY 1)
SELECT adapter, matched, unmet, total, least, coalesce(matched >= least, false) AS passed FROM n FULL JOIN (VALUES ('a', 0), ('c', 1099511627776), ('d', 0)) t(adapter, least) USING (adapter)""",
    "differential_disagreements": _BASE + """,
v AS (SELECT s.case_id, adapter, CASE WHEN err = 2 THEN 'X' WHEN err = 3 AND missing IS NOT NULL THEN 'less' WHEN err = 4 THEN 'more' ELSE '' END AS verdict FROM s LEFT JOIN gone USING (case_id) WHERE err NOT IN (1, 6))
SELECT case_id, count(DISTINCT verdict) AS verdicts, count(DISTINCT adapter) AS adapters FROM v GROUP BY 1 HAVING count(DISTINCT verdict) > 1""",
}
