"""A feed of press releases derived from the test tables, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.session import table

TITLES = (
    "Interim report January-June 2024",
    "Weekly market update and summary",
    "Please confirm your subscription",
    "Company receives order worth EUR 20m from customer",
    "Invitation to presentation of the Q2 report",
    "Notice of annual general meeting 2024",
    "Board proposes dividend of SEK 2 per share",
    "Acme AB acquires Beta Ltd for EUR 40m",
    "Moody's affirms issuer rating, outlook stable",
    "John Smith appointed as CEO of the group",
    "Company launches new product platform",
    "Managers' transaction in the share",
    "Security alert for your account",
    "Company issues bond issue of EUR 300m",
    "Results of phase II clinical trial presented",
    "Share buyback programme update",
    "Stock quote notification closing prices",
    "First day of trading on First North",
    "Company hit by ransomware cyber attack",
    "Company raises guidance for FY2024",
    "Notification of major holdings",
    "General corporate information",
    "Union announces strike at plant",
    "Rights issue fully subscribed",
)
BODIES = (
    "The board proposes a dividend and the record date follows.",
    "We expect revenue of EUR 1,700-1,790 million in FY2024.",
    "Monday opening price 10 and volume 300.",
    "The order includes delivery to the customer of units.",
    "Repurchase of own shares continues under the buyback programme.",
    "We expect an operating margin of 12-13% for FY2024.",
    "The rights issue and private placement were subscribed.",
    "Net sales and operating profit rose in the quarter.",
    "The senior unsecured notes have a maturity of five years.",
    "The union and the employees reached an agreement.",
    "No obligation to update.",
)
KINDS = ("issuer_pr", "exchange", "wire", "regulator")


def press(spark, sf_dir) -> DataFrame:
    """doc_id, title, body, company, release_date, ts, source_type, lang: titles and leads by id over the documents' texts."""
    pick = lambda words, of: F.element_at(F.array(*map(F.lit, words)), (of % len(words) + 1).cast("int"))
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        pick(TITLES, i).alias("title"),
        F.concat(pick(BODIES, F.floor(i / 5)), F.lit(" "), F.col("text")).alias("body"),
        F.col("source").alias("company"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (i % 30).cast("int")), "yyyy-MM-dd").alias("release_date"),
        F.timestamp_seconds(F.lit(1704067200) + (i * 7919 % 43200) * 60).alias("ts"),
        pick(KINDS, F.floor(i / 3)).alias("source_type"),
        "lang",
    )


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


#: The same as a common table expression.
PRESS = f"""press AS (
  SELECT doc_id, {_sql_list(TITLES)}[doc_id % {len(TITLES)} + 1] AS title, {_sql_list(BODIES)}[doc_id // 5 % {len(BODIES)} + 1] || ' ' || text AS body,
         source AS company, CAST(CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS DATE) AS VARCHAR) AS release_date,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id * 7919 % 43200) AS ts, {_sql_list(KINDS)}[doc_id // 3 % {len(KINDS)} + 1] AS source_type, lang
  FROM documents)"""
