"""Package graphs: versions that meet constraints, resolution in rounds, cycles and exports."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausula.functions import scalars as S
from clausula.operators import closure
from clausula.plans.tables import cut


def candidates(packages: DataFrame, constraints: DataFrame) -> DataFrame:
    """Versions (identity, version, ord) that meet every constraint (identity, range) on their identity."""
    need = constraints.groupBy("identity").agg(F.count_distinct("range").alias("needed"))
    ok = packages.join(constraints.select("identity", "range").distinct(), "identity").where(S.satisfies("version", "range"))
    met = ok.groupBy("identity", "version", "ord").agg(F.count_distinct("range").alias("met"))
    return met.join(need, "identity").where("met = needed").select("identity", "version", "ord")


def top_version(packages: DataFrame) -> DataFrame:
    """The highest version of each identity; of equal ones the first declared."""
    nth = F.row_number().over(Window.partitionBy("identity").orderBy(S.version_key("version").desc(), F.col("ord")))
    return packages.withColumn("_nth", nth).where("_nth = 1").select("identity", "version", "ord")


def resolve(packages: DataFrame, imports: DataFrame, roots: DataFrame, rounds: int | None = None) -> DataFrame:
    """identity, version, status of all packages that the roots need.

    packages: identity, version, ord; imports: identity, version, target, range; roots: identity,
    range. Each round selects the highest version that meets all constraints seen so far, and takes
    the selected versions' imports, until the selection stays. A selection that comes back after
    others, so that none stays, is an error, as are more rounds than `rounds`, if given. status: resolved, or conflict where no
    version meets all constraints, or missing where there is none.
    """
    want, before = cut(roots.select("identity", "range").distinct(), "wanted"), None
    seen = set()
    for n in itertools.count():
        if n == rounds:
            raise ValueError(f"the selection still changes after {rounds} rounds")
        chosen = cut(top_version(candidates(packages, want)), "chosen")
        sign = chosen.agg(F.count("*"), F.bit_xor(F.xxhash64("identity", "version"))).first()
        more = imports.join(chosen.select("identity", "version"), ["identity", "version"]).select(F.col("target").alias("identity"), "range")
        want = cut(roots.select("identity", "range").unionByName(more).distinct(), "wanted")
        if sign == before:
            break
        if sign in seen:
            raise ValueError("no selection stays: the imports lead round")
        seen.add(sign)
        before = sign
    known = packages.select("identity", F.lit(True).alias("known")).distinct()
    out = want.select("identity").distinct().join(chosen, "identity", "left").join(known, "identity", "left")
    status = F.when(F.col("version").isNotNull(), "resolved").when(F.col("known"), "conflict").otherwise("missing")
    return out.select("identity", "version", status.alias("status"))


def package_cycles(imports: DataFrame) -> DataFrame:
    """Cycles of imports (identity, target), each once, from its least member."""
    return closure.cycles(imports.select(F.col("identity").alias("src"), F.col("target").alias("dst")))


def unresolved_imports(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """Imported names (target, name) that no package exports (identity, name)."""
    e = exports.select(F.col("identity").alias("target"), "name").distinct()
    return imports.join(e, ["target", "name"], "left_anti")


def mint_collisions(names: DataFrame, key: str, name: str) -> DataFrame:
    """Names that several keys mint: name, n, first (the least key)."""
    return names.groupBy(name).agg(F.count_distinct(key).alias("n"), F.min(key).alias("first")).where("n > 1")
