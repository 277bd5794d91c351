"""Sinks: overwrite, evolving append, insert-if-absent and upsert of Parquet tables, JSON logs, metrics rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from tidewire.operators.alerting import insert_new, latest


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, or None where there is none yet."""
    try:
        return spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def overwrite(df: DataFrame, path: str, partitions: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def append(df: DataFrame, path: str, partitions: tuple[str, ...] = ()) -> None:
    """Appends; new columns are allowed (readers merge schemas), nothing is rewritten."""
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def create_empty(spark: SparkSession, path: str, schema: str) -> None:
    if read_or_none(spark, path) is None:
        spark.createDataFrame([], schema).write.parquet(path)


def insert_if_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Appends the rows whose key is not there, so that a repeated run adds nothing."""
    there = read_or_none(df.sparkSession, path)
    fresh = df if there is None else insert_new(there, df, keys)
    append(fresh, path)


#: Parts of an upserted table; a key's rows are all in one.
PARTS = 64


def upsert(df: DataFrame, path: str, keys: list[str], updated: str, created: str | None = None, parts: int = PARTS) -> str:
    """Latest row per key. The table is partitioned by a hash of the key, and only the parts that the batch touches are rewritten.

    What becomes of these parts is written beside the table first, so a run that dies before the swap leaves the table as it was. Returns the path.
    """
    spark = df.sparkSession
    new = df.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
    there = read_or_none(spark, path)
    whole = there is None or "_part" not in there.columns
    if there is not None and whole:
        there = there.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
    elif there is not None:
        # at most `parts` numbers
        there = there.where(F.col("_part").isin([r[0] for r in new.select("_part").distinct().collect()]))
    merged = new if there is None else there.unionByName(new, allowMissingColumns=True)
    staged = f"{path.rstrip('/')}-staged-{uuid.uuid4().hex[:8]}"
    latest(merged, keys, updated, created).write.parquet(staged)
    done = spark.read.parquet(staged).repartition("_part")
    done.write.mode("overwrite").option("partitionOverwriteMode", "static" if whole else "dynamic").partitionBy("_part").parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return path


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("_part")


def append_typed(df: DataFrame, path: str, schema: str) -> None:
    """Appends under a fixed schema: its columns in its order, cast to its types; a column that the rows lack is an error."""
    kinds = StructType.fromDDL(schema)
    append(df.select(*(F.col(f.name).cast(f.dataType) for f in kinds)), path)


def append_json(df: DataFrame, root: str, partitions: tuple[str, ...] = ("signal_type", "dt")) -> None:
    df.write.mode("append").partitionBy(*partitions).json(root)


def run_output(df: DataFrame, root: str, run_id: str, form: str = "parquet") -> None:
    """Appends a run's rows under its id, as `parquet` or as `csv` with a header."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").format(form).option("header", True).save(root)


def backfill(df: DataFrame, candidates: DataFrame, key: str, column: str) -> DataFrame:
    """Fills a blank column from candidates by key, leaving filled values."""
    c = candidates.select(key, F.col(column).alias("_new"))
    blank = F.trim(F.coalesce(column, F.lit(""))) == ""
    return df.join(c, key, "left").withColumn(column, F.when(blank & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col(column))).drop("_new")
