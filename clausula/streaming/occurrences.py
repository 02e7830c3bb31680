"""Streams of occurrences: validation, declared aggregation and late data.

A declared aggregation names grouping keys, a window, aggregate semantics and a late-data policy:
`drop` waits for a watermark and gives each window once; `revise` gives a window again when late
rows change it (update mode).
"""

from __future__ import annotations

import dataclasses

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clausula.operators.constraints import Constraint, admitted


@dataclasses.dataclass(frozen=True)
class Aggregation:
    keys: tuple[str, ...]
    time: str
    window: str  # tumbling, sliding or session
    size: str
    slide: str | None = None
    lateness: str = "1 hour"
    late: str = "drop"

    def window_column(self) -> Column:
        t = F.col(self.time)
        if self.window == "session":
            return F.session_window(t, self.size)
        return F.window(t, self.size, self.slide) if self.window == "sliding" else F.window(t, self.size)

    @property
    def mode(self) -> str:
        return "append" if self.late == "drop" else "update"


def read_events(spark: SparkSession, folder: str, schema, time: str = "ts", files: int = 1) -> DataFrame:
    """A stream of a folder's Parquet files, so many a batch; the time as an instant, which watermarks need."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    return raw.withColumn(time, F.col(time).cast("timestamp"))


def validated(stream: DataFrame, rules: list[Constraint], required: list[str] = ()) -> DataFrame:
    """Each row with its verdict; stateless, for streams and tables alike."""
    return admitted(stream, rules, required)


def aggregated(df: DataFrame, a: Aggregation, measures: dict[str, Column]) -> DataFrame:
    """Keys, window_start, window_end and measures. A stream gets a watermark; a table is grouped as it is."""
    df = df.withWatermark(a.time, a.lateness) if df.isStreaming else df.withColumn(a.time, F.col(a.time).cast("timestamp"))
    out = df.groupBy(*a.keys, a.window_column().alias("w")).agg(*[c.alias(n) for n, c in measures.items()])
    return out.select(*a.keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *measures)


def first_seen(stream: DataFrame, keys: list[str], time: str, within: str = "1 hour") -> DataFrame:
    """Rows of keys not seen within the watermark."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def state_changes(stream: DataFrame, key: str, time: str, value: str, lateness: str = "1 hour") -> DataFrame:
    """key, at, before, after: a row whenever a key's value differs from its last one in event time. State is one value a key."""

    def changes(k, batches, state: GroupState):
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values([time, value])
        out = []
        for at, v in zip(rows[time], rows[value]):
            if v != last:
                out.append((k[0], at, last, v))
                last = v
        state.update((last,))
        yield pd.DataFrame(out, columns=["key", "at", "before", "after"])

    kept = stream.select(F.col(key).cast("string").alias("key"), time, F.col(value).cast("string").alias(value)).withWatermark(time, lateness)
    return kept.groupBy("key").applyInPandasWithState(changes, "key string, at timestamp, before string, after string", "last string", "update", GroupStateTimeout.NoTimeout)


def write_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Run over what is there and stop. Append mode writes Parquet; in update mode each batch is written as it came, with its number."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        return writer.format("parquet").option("path", path).outputMode("append").start()
    return writer.outputMode(mode).foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/batch={n}")).start()
