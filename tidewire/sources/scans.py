"""Scans: Hive-partitioned Parquet, ranges and windows, delimited dimensions, JSON logs, the latest file."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contract of the silver table.
SILVER = (
    "press_release_id string, company_name string, category string, release_date string, release_ts_utc string, ingested_at string, "
    "title string, full_text string, source string, source_url string, parser_version int, schema_version int"
)


def scan(spark: SparkSession, root: str, columns: list[str] | None = None, filters: dict | None = None, order: list | None = None, limit: int | None = None) -> DataFrame:
    """A Parquet root; filters are equality or membership on any column and prune partitions; a limit has an order."""
    df = spark.read.parquet(root)
    for c, v in (filters or {}).items():
        df = df.where(F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
    if order or limit is not None:
        df = df.orderBy(*(order or df.columns))
    if limit is not None:
        df = df.limit(limit)
    return df.select(*columns) if columns else df


def date_range(df: DataFrame, first: str, last: str, column: str = "release_date") -> DataFrame:
    """Inclusive range of ISO dates; a range prunes partitions as a list of days would."""
    return df.where(F.col(column).between(first, last))


def time_window(df: DataFrame, start: str, end: str, column: str) -> DataFrame:
    """Half-open window in UTC; what cannot be parsed is outside."""
    t = F.try_to_timestamp(F.col(column).cast("string"))
    return df.where((t >= F.lit(start).cast("timestamp")) & (t < F.lit(end).cast("timestamp")))


def window_query(spark: SparkSession, table: str, start: str, end: str, limit: int | None = None) -> DataFrame:
    """The same by SQL with named parameters, newest first."""
    df = spark.sql(f"SELECT * FROM {table} WHERE published_utc >= timestamp(:start) AND published_utc < timestamp(:end) ORDER BY published_utc DESC", args={"start": start, "end": end})
    return df.limit(limit) if limit is not None else df


def companies(spark: SparkSession, path: str) -> DataFrame:
    """A `;`-delimited dimension with a header; values are trimmed and blank names dropped."""
    df = spark.read.option("header", True).option("sep", ";").csv(path)
    return df.select(*(F.trim(c).alias(c.strip().lower()) for c in df.columns)).where(F.coalesce(F.col("name"), F.lit("")) != "")


def csv_ids(spark: SparkSession, path: str, column: str) -> DataFrame:
    return spark.read.option("header", True).csv(path).select(F.col(column).cast("string")).distinct()


def json_log(spark: SparkSession, root: str, schema: str, kind: str | None = None) -> DataFrame:
    """JSON lines partitioned by `signal_type` (and day)."""
    df = spark.read.schema(schema).option("basePath", root).json(root)
    return df.where(F.col("signal_type") == kind) if kind else df


def newest(df: DataFrame, key: str, value, dated: str) -> DataFrame:
    """The newest record of a key."""
    return df.where(F.col(key) == value).orderBy(F.col(dated).desc()).limit(1)


def latest_run(spark: SparkSession, root: str, pattern: str = "*") -> str | None:
    """The newest file below a root, by modification time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    row = files.agg(F.max(F.struct("modificationTime", "path")).alias("x")).first()
    return row.x.path if row and row.x else None


def config(spark: SparkSession, path: str) -> dict:
    """A JSON or YAML document; a list of `{key: ...}` becomes a dictionary by key. Read through Spark, so any store will do."""
    text = "\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())
    if path.endswith((".yml", ".yaml")):
        import yaml

        blob = yaml.safe_load(text)
    else:
        blob = json.loads(text)
    items = blob.get("events", blob) if isinstance(blob, dict) else blob
    return {x["key"]: x for x in items} if isinstance(items, list) else items
