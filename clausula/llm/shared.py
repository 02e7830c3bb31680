"""What the operators share: the shared folder, written intermediate tables, and plain column views of inputs."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where it is unset (a local session, as in tests) is a folder of this machine set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = have.get() if have.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="clausula-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/clausula/{label}-{uuid.uuid4().hex}"


def files_for(rows: int, each: int) -> int:
    """Files that hold so many rows: one for each `each` of them, and some for small tables."""
    return max(8, -(-rows // each))


def written(df: DataFrame, label: str, compression: str = "zstd", files: int | None = None) -> DataFrame:
    """df as a table in the shared folder, so that later plans start from files and not from its lineage. files: at most so many, where
    the rows are known to be few for the number of shuffle partitions (each file costs its task several calls of the file system)."""
    path = scratch(df.sparkSession, label)
    df = df if files is None else df.coalesce(files)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int, path: str, compression: str = "zstd") -> DataFrame:
    """df as a table at path in buckets of a column, so that grouping by it needs no shuffle of these rows. The catalog keeps no entry."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    df.write.option("compression", compression).option("path", path).bucketBy(buckets, key).saveAsTable(name, format="parquet")
    found = spark.table(name)
    found.schema, found._jdf.queryExecution().analyzed()
    spark.sql(f"DROP TABLE {name}")
    return found


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path by Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def apart(docs: DataFrame, prefix: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with columns of an operator's own prefix (in any case) under other names, and a function that selects the columns of docs again."""
    names, taken = [], {c.lower() for c in docs.columns}
    for i, c in enumerate(docs.columns):
        new = c
        if c.lower().startswith(prefix):
            new = f"kept_{i}"
            while new in taken:
                new += "_"
            taken.add(new)
        names.append(new)
    return docs.toDF(*names), lambda df: df.select(*[F.col(f"`{new}`").alias(c) for c, new in zip(docs.columns, names)])


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator needs, under fixed names; a null text becomes empty."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def hand_back() -> None:
    """Give the memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim is not None:
        trim(0)


def tidy(rows: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """rows, for mapInArrow. Python workers outlive their tasks and share an executor's memory with the stages that follow, so a task that ends hands back what it freed."""

    @functools.wraps(rows)
    def run(*args):
        try:
            yield from rows(*args)
        finally:
            hand_back()

    return run
