"""Exact deduplication: by id, content, signature and same-day title, each with a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.text import col, dedup_key, text_or_empty


def content_hash(title, body) -> Column:
    return F.sha1(dedup_key(F.concat(text_or_empty(title), F.lit(" "), text_or_empty(body))))


def signature(title, body, head: int = 800) -> Column:
    return F.sha1(dedup_key(F.concat(text_or_empty(title), F.lit(" || "), F.substring(text_or_empty(body), 1, head))))


def keep_newest(df: DataFrame, keys: list, ts: str, tie: str) -> DataFrame:
    """One row per key: the newest; rows without time count as newer than all, then the larger tie value wins."""
    order = Window.partitionBy(*keys).orderBy(F.col(ts).desc_nulls_first(), F.col(tie).desc())
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def keep_oldest(df: DataFrame, keys: list, ts: str, tie: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col(ts).asc_nulls_last(), F.col(tie).asc())
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def same_day_key(company, title, ts) -> list[Column]:
    return [F.lower(F.trim(text_or_empty(company))), F.lower(F.trim(text_or_empty(title))), F.date_trunc("DAY", col(ts))]


def dedup(df: DataFrame, key: str = "doc_id", title: str = "title", body: str = "body", company: str = "company", ts: str = "ts") -> DataFrame:
    """Id, then content, then signature (newest of each stays), then company, title and day (oldest stays)."""
    df = keep_newest(df, [F.col(key)], ts, key)
    df = keep_newest(df, [content_hash(title, body)], ts, key)
    df = keep_newest(df, [signature(title, body)], ts, key)
    return keep_oldest(df, same_day_key(company, title, ts), ts, key)


def authority(source_type) -> Column:
    s = F.lower(text_or_empty(source_type))
    return F.when(s.isin("exchange", "regulator"), 3).when(s == "issuer_pr", 2).otherwise(1)


def light_dedup(df: DataFrame, key: str = "doc_id", cluster: str = "cluster_id", title: str = "title", source_type: str = "source_type") -> DataFrame:
    """One row per cluster (else title, else id): the source with most authority, then the smallest id."""
    bucket = F.coalesce(F.col(cluster).cast("string"), F.nullif(F.lower(F.trim(text_or_empty(title))), F.lit("")), F.col(key).cast("string"))
    order = Window.partitionBy(bucket).orderBy(authority(source_type).desc(), F.col(key))
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def alert_id(event_id) -> Column:
    return F.substring(F.sha2(F.concat(F.lit("guidance_alert_"), col(event_id).cast("string")), 256), 1, 16)


def stable_id(*parts) -> Column:
    return F.concat(F.lit("auto_"), F.substring(F.md5(F.concat_ws("||", *(text_or_empty(p) for p in parts))), 1, 16))


def feed_item_id(*parts) -> Column:
    """A short hash of the first of id, guid, link and title that is filled."""
    first = F.coalesce(*(F.nullif(F.trim(text_or_empty(p)), F.lit("")) for p in parts), F.lit(""))
    return F.substring(F.sha2(first, 256), 1, 16)


def within_ttl(df: DataFrame, key: str, ts: str, days: int = 7) -> DataFrame:
    """The first row of a key, and again each first row once the time to live has run out since the last kept one.

    What is kept depends on what was kept before, so the times of a key are folded in order.
    """
    order = Window.partitionBy(key).orderBy(ts)
    spread = df.withColumn("_gap", F.col(ts).cast("long") - F.lag(F.col(ts).cast("long")).over(order))
    times = df.groupBy(key).agg(F.array_sort(F.collect_set(F.col(ts).cast("long"))).alias("_t"))
    zero = F.array().cast("array<long>")
    kept = F.aggregate("_t", zero, lambda a, x: F.when((F.size(a) == 0) | (x - F.try_element_at(a, F.lit(-1)) >= days * 86400), F.concat(a, F.array(x))).otherwise(a))
    return spread.drop("_gap").join(times.select(key, kept.alias("_kept")), key).where(F.array_contains("_kept", F.col(ts).cast("long"))).drop("_kept")
