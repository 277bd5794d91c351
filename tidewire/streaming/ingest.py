"""Structured Streaming forms of ingestion, prior state and expiring deduplication, and their batch predicates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LOOK_BACK_MS = 120_000


def landing(spark: SparkSession, folder: str, schema, per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files that land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def dedup_stream(stream: DataFrame, key: str, ts: str, late: str = "120 seconds") -> DataFrame:
    """First arrival per key, with state kept for the look-back only."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, ts: str, group: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts with late data (an extension)."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), group).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), group, "n")


def prior_state(stream: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """(key, ts, value, prior): each row with the value its key had before, across micro-batches."""
    kind = dict(stream.dtypes)[key]

    def fold(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (last,) = state.get if state.exists else (None,)
        rows = pd.concat(list(frames)).sort_values(ts, kind="stable")
        prior = rows[value].shift(1)
        prior.iloc[0] = last
        state.update((float(rows[value].iloc[-1]),))
        yield pd.DataFrame({key: k[0], ts: rows[ts], value: rows[value], "prior": prior.astype(float)})

    return stream.select(key, ts, value).groupBy(key).applyInPandasWithState(fold, f"`{key}` {kind}, `{ts}` timestamp, `{value}` double, prior double", "last double", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, path: str, checkpoint: str, latest_of: list[str] | None = None) -> DataFrame:
    """Runs a stream over all that is there into a Parquet table, then stops; gives the table.

    Rows are appended. With `latest_of` (the columns that tell results apart) every micro-batch adds the results that it changed, and
    the latest of each counts. A batch that is run again after a failure replaces its own files.
    """
    spark, kind = stream.sparkSession, stream.schema
    if latest_of is None:
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(kind).parquet(path)

    def add(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/_part={number}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    changed = spark.read.parquet(path).drop("_part")
    rest = [c for c in kind.names if c not in latest_of]
    newest = changed.groupBy(*latest_of).agg(F.max(F.struct("_batch", *rest)).alias("x"))
    return newest.select(*(c if c in latest_of else F.col(f"x.{c}").alias(c) for c in kind.names))


def to_ingest(df: DataFrame, seen: DataFrame, epoch: str, key: str, mark: tuple[int, str]) -> DataFrame:
    """Rows beyond the (epoch, id) mark, and rows up to 120 s before it that were not ingested yet."""
    newer = F.struct(F.col(epoch).alias("e"), F.col(key).cast("string").alias("k")) > F.struct(F.lit(mark[0]).cast("long").alias("e"), F.lit(mark[1]).alias("k"))
    late = F.col(epoch) >= mark[0] - LOOK_BACK_MS
    known = df.where(~newer & late).join(seen.select(key), key, "left_anti")
    return df.where(newer).unionByName(known)


def backfill_windows(df: DataFrame, ts: str, anchor: str, days: int = 7, horizon: int = 90, most: int = 300) -> DataFrame:
    """(window, first, last, n, runs): backwards windows of some days up to a horizon, and the runs each takes at `most` rows a run."""
    age = F.datediff(F.lit(anchor).cast("date"), F.col(ts).cast("date"))
    return df.where((age >= 0) & (age < horizon)).groupBy(F.floor(age / days).cast("long").alias("window")).agg(F.min(F.col(ts)).alias("first"), F.max(F.col(ts)).alias("last"), F.count("*").alias("n"), F.ceil(F.count("*") / most).cast("long").alias("runs"))
