"""Differential runs: what adapters say of cases against what is expected of them, and against each other.

An answer is a row (adapter, case_id, pointer, code) a finding, and a row (adapter, case_id, state) a case. All comparisons are outer joins on
the case, so cases that nobody answers and answers to no case stay in sight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sets(findings: DataFrame, *keys: str) -> DataFrame:
    """Findings of each key as a sorted set of `pointer code`."""
    return findings.groupBy(*keys).agg(F.array_sort(F.collect_set(F.concat_ws(" ", F.coalesce("pointer", F.lit("")), "code"))).alias("found"))


def run(cases: DataFrame, expected: DataFrame, answers: DataFrame, findings: DataFrame, adapters: DataFrame) -> DataFrame:
    """adapter, case_id, status, missing, extra: a row an adapter and case, and a row an answer that is to no case.

    cases: case_id, state; expected: case_id, pointer, code; answers: adapter, case_id, state; findings: adapter, case_id, pointer, code;
    adapters: adapter. status: matched, state (another state), findings (other findings: missing and extra ones are listed), unanswered, repeated (several answers to one case), unknown
    (an answer of no adapter or to no case).
    """
    slots = _slots(cases, adapters)
    said = answers.groupBy("adapter", "case_id").agg(F.min("state").alias("state"), F.count("*").alias("_n"))
    x = slots.join(said, ["adapter", "case_id"], "full")
    x = x.join(_sets(expected, "case_id").withColumnRenamed("found", "_want"), "case_id", "left").join(_sets(findings, "adapter", "case_id").withColumnRenamed("found", "_got"), ["adapter", "case_id"], "left")
    none = F.array().cast("array<string>")
    missing, extra = F.array_except(F.coalesce("_want", none), F.coalesce("_got", none)), F.array_except(F.coalesce("_got", none), F.coalesce("_want", none))
    status = (
        F.when(F.col("_slot").isNull(), "unknown").when(F.col("_n").isNull(), "unanswered").when(F.col("_n") > 1, "repeated").when(~F.col("state").eqNullSafe(F.col("_state")), "state")
        .when((F.size(missing) > 0) | (F.size(extra) > 0), "findings").otherwise("matched")
    )
    compared = status.isin("findings", "state")
    return x.select("adapter", "case_id", status.alias("status"), F.when(compared, missing).otherwise(none).alias("missing"), F.when(compared, extra).otherwise(none).alias("extra"))


def _slots(cases: DataFrame, adapters: DataFrame) -> DataFrame:
    """Each case once for each adapter: every case carries the list of adapters, which is a registry's, and is exploded by it."""
    names = [r.adapter for r in adapters.select("adapter").distinct().orderBy("adapter").collect()]  # a registry: a row a program
    return cases.select("case_id", F.col("state").alias("_state"), F.explode(F.array(*map(F.lit, names)).cast("array<string>")).alias("adapter"), F.lit(True).alias("_slot"))


def accounts(report: DataFrame, thresholds: DataFrame) -> DataFrame:
    """adapter, matched, unmet, total, least, passed: counts of a report against thresholds (adapter, least: matched cases); an adapter without a threshold and a threshold without an adapter do not pass."""
    n = report.where("status <> 'unknown'").groupBy("adapter").agg(F.count_if(F.col("status") == "matched").alias("matched"), F.count_if(F.col("status") != "matched").alias("unmet"), F.count("*").alias("total"))
    return n.join(thresholds.select("adapter", "least"), "adapter", "full").select("adapter", "matched", "unmet", "total", "least", F.coalesce(F.col("matched") >= F.col("least"), F.lit(False)).alias("passed"))


def unmet(report: DataFrame, register: DataFrame) -> DataFrame:
    """adapter, case_id, status, kind: cases that do not match, as declared or new divergences, and register rows (adapter, case_id) that nothing needs: stale."""
    bad = report.where("status NOT IN ('matched', 'unknown')").select("adapter", "case_id", "status")
    known = register.select("adapter", "case_id", F.lit(True).alias("_known")).distinct()
    return bad.join(known, ["adapter", "case_id"], "full").select("adapter", "case_id", "status", F.when(F.col("status").isNull(), "stale").when(F.col("_known"), "declared").otherwise("new").alias("kind"))


def disagreements(answers: DataFrame, findings: DataFrame) -> DataFrame:
    """case_id, verdicts, adapters: cases on which adapters that answer differ, with the number of different verdicts (state and findings)."""
    x = answers.join(_sets(findings, "adapter", "case_id"), ["adapter", "case_id"], "left")
    verdict = F.struct("state", F.coalesce("found", F.array().cast("array<string>")).alias("found"))
    return x.groupBy("case_id").agg(F.count_distinct(verdict).alias("verdicts"), F.count_distinct("adapter").alias("adapters")).where("verdicts > 1")
