"""Session defaults, and where intermediate results go on a cluster."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", name: str = "tidewire", **conf) -> SparkSession:
    """A session with the settings the engine expects; `conf` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.master(master).appName(name)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` with checkpoint() in the shared folder (`spark.checkpoint.dir`; one of our own where unset)."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or f"{df.sparkSession.conf.get('spark.sql.warehouse.dir')}/_shared"
        context.setCheckpointDir(folder)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Write `df` as compressed files in the shared folder and read it back: unlike a checkpoint's, the shuffles before it can be released."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    path = f"{folder.rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Shuffle files go when the driver collects the plans that made them; between rounds that is asked for, else they pile up."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
