"""Shards of a growing table, kept by size-tiered compaction under a versioned manifest.

append() writes arrivals as small immutable Parquet shards. compact() takes shards of like size (a
tier is a power of FANOUT of the least size), and where a tier has FANOUT or more of them, merges
runs of them to files of up to the target size; merged files fall into higher tiers, until no tier
is full. Each step ends with one commit: a new manifest version, put in place by a rename that fails
if another writer has put that version first, and is then tried again on top of it. A version says
what it adds and removes; every SNAPSHOT-th lists all shards, so a commit writes what it changes.
Readers see one version. vacuum() removes files that no kept version lists.

A merge reads each run's files in one task and writes one file; nothing shuffles. Runs are bounded
by the target. MERGES runs make up one job, so that plans stay small; JOBS jobs of a round run side
by side, and the round is one commit. The driver handles shard names and sizes only.

Defined results: rows and columns come back as they were appended, in no fixed order, nulls, empty
texts and repeated rows included. Appending an empty table commits a version with no new shard.
All appends to one store must have one schema.
"""

from __future__ import annotations

import dataclasses
import functools
import json
import math
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LEAST, FANOUT, TARGET, MERGES = 64 << 10, 4, 64 << 20, 64
JOBS, SNAPSHOT = 16, 16


class Conflict(RuntimeError):
    """Another writer committed the version, and the shards to replace are gone."""


@dataclasses.dataclass(frozen=True)
class Shard:
    name: str  # below the store's folder
    bytes: int
    rows: int


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._jvm = jvm

    # Manifests

    def _names(self, folder: str) -> list[str]:
        p = self._path(f"{self.root}/{folder}")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n in self._names("_manifest") if n.startswith("v") and n.endswith(".json")]

    def _version(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/_manifest/v{version:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _steps(self, version: int) -> list[dict]:
        """A version and those that it builds on, from a whole listing onwards."""
        steps = [self._version(version)]
        while not steps[-1]["whole"]:
            steps.append(self._version(steps[-1]["version"] - 1))
        return steps[::-1]

    def manifest(self, version: int | None = None) -> tuple[int, StructType | None, list[Shard]]:
        """Version (0: nothing committed), schema and shards."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return 0, None, []
        shards: dict[str, Shard] = {}
        for step in self._steps(version):
            for name in step["remove"]:
                del shards[name]
            shards |= {s["name"]: Shard(**s) for s in step["add"]}
        return version, StructType.fromJson(step["schema"]) if step["schema"] else None, list(shards.values())

    def commit(self, schema: StructType | None, add: list[Shard], remove: set[str] = frozenset(), tries: int = 20, whole: bool = False) -> int:
        """Put the next version in place, on top of whatever version is the last by then. whole: as a listing of all shards."""
        for _ in range(tries):
            version, old, shards = self.manifest()
            if not remove <= {s.name for s in shards}:
                raise Conflict("shards to replace are no longer listed")
            schema = schema or old
            step = {"version": version + 1, "schema": schema and schema.jsonValue(), "whole": whole or version % SNAPSHOT == 0}
            listed = [s for s in shards if s.name not in remove] + add if step["whole"] else add
            text = json.dumps(step | {"add": [dataclasses.asdict(s) for s in listed], "remove": [] if step["whole"] else sorted(remove)})
            own = self._path(f"{self.root}/_manifest/.{self._jvm.java.util.UUID.randomUUID().toString()}.tmp")
            out = self._fs.create(own, False)
            out.write(bytearray(text.encode()))
            out.close()
            try:
                # FileContext's rename without the overwrite option fails if the target is there.
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf)
                options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                context.rename(own, self._path(f"{self.root}/_manifest/v{version + 1:012d}.json"), options)
                return version + 1
            except Exception as e:
                self._fs.delete(own, False)
                if "FileAlreadyExists" not in str(e):
                    raise
                time.sleep(0.05)
        raise Conflict("too many other commits")

    # Shards

    def _listed(self, folder: str, schema: StructType) -> list[Shard]:
        """Shards that a job has written below a folder, with their rows from the files' footers."""
        try:
            rows = self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.root}/{folder}")
            got = rows.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).count().collect()  # a row a shard
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise
        mark = f"/{folder}/"
        return sorted((Shard(folder + "/" + r["path"].split(mark, 1)[1], r["size"], r["count"]) for r in got), key=lambda s: s.name)

    def append(self, df: DataFrame, by: str | None = None) -> list[int]:
        """Write df as new shards and commit them. by: a column that tells arrivals apart; each is a commit of its own."""
        folder = f"data/{self._jvm.java.util.UUID.randomUUID().toString()}"
        schema = df.drop(by).schema if by else df.schema
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.root}/{folder}")
        shards = self._listed(folder, schema)
        arrivals: dict[str, list[Shard]] = {}
        for s in shards:
            arrivals.setdefault(s.name.rsplit("/", 1)[0], []).append(s)
        return [self.commit(schema, group) for _, group in sorted(arrivals.items())] or [self.commit(schema, [])]

    @staticmethod
    def tier(size: int) -> int:
        return max(0, int(math.log(max(size, 1) / LEAST, FANOUT))) if size > LEAST else 0

    def plan(self, shards: list[Shard], target: int = TARGET) -> list[list[Shard]]:
        """Runs of shards to merge: of tiers that hold FANOUT shards or more, each run within the target."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if 2 * s.bytes < target:
                tiers.setdefault(self.tier(s.bytes), []).append(s)
        runs = []
        for _, group in sorted(tiers.items()):
            if len(group) < FANOUT:
                continue
            run: list[Shard] = []
            for s in sorted(group, key=lambda s: s.name):
                if run and sum(x.bytes for x in run) + s.bytes > target:
                    runs.append(run)
                    run = []
                run.append(s)
            runs.append(run)
        return [r for r in runs if len(r) > 1]

    def compact(self, target: int = TARGET) -> int:
        """Merge until no tier is full; the last version."""
        while True:
            version, schema, shards = self.manifest()
            runs = self.plan(shards, target)
            if not runs:
                return version
            with ThreadPoolExecutor(JOBS) as pool:
                merged = list(pool.map(lambda i: self._merge(schema, runs[i : i + MERGES]), range(0, len(runs), MERGES)))
            self.commit(schema, [s for job in merged for s in job], {s.name for run in runs for s in run})

    def _merge(self, schema: StructType, runs: list[list[Shard]]) -> list[Shard]:
        """One job: a file for each run."""
        folder = f"data/{self._jvm.java.util.UUID.randomUUID().toString()}"
        parts = [self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.name}" for s in run]).coalesce(1) for run in runs]
        functools.reduce(DataFrame.unionAll, parts).write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        return self._listed(folder, schema)

    def vacuum(self, keep: int = 1) -> None:
        """Remove older versions than the last `keep` and those that they build on, and shards that none of these lists. Not while a writer is at work.

        The last version becomes a whole listing first, if it is none.
        """
        versions = self.versions()
        if versions and not self._version(versions[-1])["whole"]:
            versions.append(self.commit(None, [], whole=True))
        first = self._steps(versions[-keep:][0])[0]["version"] if versions else 0
        live = {s.name for v in versions if v >= first for s in self.manifest(v)[2]}
        for v in [v for v in versions if v < first]:
            self._fs.delete(self._path(f"{self.root}/_manifest/v{v:012d}.json"), False)
        data = self._path(f"{self.root}/data")
        if self._fs.exists(data):
            files = self._fs.listFiles(data, True)
            while files.hasNext():
                p = files.next().getPath()
                if p.toString().split(f"{self._path(self.root).toUri().getPath()}/", 1)[1] not in live:
                    self._fs.delete(p, False)

    def read(self, version: int | None = None) -> DataFrame:
        _, schema, shards = self.manifest(version)
        if not shards:
            return self.spark.createDataFrame([], schema or StructType())
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.name}" for s in shards])


def sharded(docs: DataFrame, root: str, arrivals: int = 8, target: int = TARGET) -> Store:
    """A store to which docs came in so many arrivals, compacted after the last."""
    store = Store(docs.sparkSession, root)
    by = "arrival"
    while by in {c.lower() for c in docs.columns}:
        by += "_"
    store.append(docs.withColumn(by, F.pmod(F.xxhash64("doc_id"), F.lit(arrivals))), by)
    store.compact(target)
    store.vacuum()
    return store


def placed(store: Store) -> DataFrame:
    """One row per row of the last version: doc_id, text_md5, shard (its number in the manifest), listed (the shard has as many rows as the manifest says)."""
    spark, (_, _, shards) = store.spark, store.manifest()
    rows = store.read()
    names = spark.createDataFrame([(f"/{s.name}", i, s.rows) for i, s in enumerate(shards)], "name string, shard int, listed_rows long")
    at = F.concat(F.lit("/data/"), F.substring_index(F.col("_metadata.file_path"), "/data/", -1))
    found = rows.select(F.col("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), at.alias("name"))
    counts = rows.select(at.alias("name")).groupBy("name").count().join(names, "name").select("name", "shard", (F.col("count") == F.col("listed_rows")).alias("listed"))
    return found.join(counts, "name", "left").select("doc_id", "text_md5", "shard", F.coalesce("listed", F.lit(False)).alias("listed"))
