"""Scans, sinks, keyed inserts and ingestion predicates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewire.functions import numbers, text
from tidewire.operators import alerting, dedup
from tidewire.plans.press import PRESS, press
from tidewire.plans.registry import query
from tidewire.session import table
from tidewire.sources import scans, sinks
from tidewire.streaming import ingest


def _folder(spark, name):
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:8]}"


@query("SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'view') AND user_id = 7")
def scan_filter_columns(spark, sf_dir):
    return scans.scan(spark, f"{sf_dir}/events.parquet", ["event_id", "event_type", "value"], {"event_type": ["click", "view"], "user_id": 7})


@query(f"WITH {PRESS} SELECT doc_id, company, release_date FROM press WHERE company IN ('src1', 'src2') AND release_date = '2024-01-02'")
def scan_partition_filter(spark, sf_dir):
    """Writes a Hive-partitioned copy and scans two of its partitions."""
    root = _folder(spark, "press")
    sinks.overwrite(press(spark, sf_dir).select("doc_id", "company", "release_date"), root, ("company", "release_date"))
    df = scans.scan(spark, root, None, {"company": ["src1", "src2"], "release_date": "2024-01-02"})
    return df.select("doc_id", "company", F.date_format("release_date", "yyyy-MM-dd").alias("release_date"))


@query(f"WITH {PRESS} SELECT doc_id, release_date FROM press WHERE release_date BETWEEN '2024-01-10' AND '2024-01-12'")
def scan_date_range(spark, sf_dir):
    return scans.date_range(press(spark, sf_dir), "2024-01-10", "2024-01-12").select("doc_id", "release_date")


@query("SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-06 12:00:00'")
def time_window_scan(spark, sf_dir):
    return scans.time_window(table(spark, sf_dir, "events"), "2024-01-05 00:00:00", "2024-01-06 12:00:00", "ts").select("event_id", "value")


@query("SELECT event_id, ts AS published_utc FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-04' ORDER BY ts DESC, event_id LIMIT 1000000")
def named_parameter_query(spark, sf_dir):
    table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("published_utc")).createOrReplaceTempView("published")
    return scans.window_query(spark, "published", "2024-01-03 00:00:00", "2024-01-04 00:00:00")


@query("SELECT event_id, ts, value FROM events ORDER BY value DESC, event_id LIMIT 20")
def recent_topn(spark, sf_dir):
    return scans.scan(spark, f"{sf_dir}/events.parquet", ["event_id", "ts", "value"], None, [F.col("value").desc(), F.col("event_id")], 20)


@query("SELECT trim(n_name) AS name, trim(r_name) AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE trim(n_name) <> ''")
def company_dimension(spark, sf_dir):
    """Round trip through a `;`-delimited file."""
    path = _folder(spark, "companies")
    table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("region")).write.option("header", True).option("sep", ";").csv(path)
    return scans.companies(spark, path)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS signal_type FROM events WHERE event_type = 'error'")
def json_log_scan(spark, sf_dir):
    root = _folder(spark, "log")
    events = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("event_type").alias("signal_type"))
    sinks.append_json(events, root, ("signal_type",))
    return scans.json_log(spark, root, "event_id long, k long, signal_type string", "error")


@query("SELECT event_id, user_id, ts FROM events WHERE user_id = 3 QUALIFY row_number() OVER (ORDER BY ts DESC, event_id DESC) = 1")
def newest_lookup(spark, sf_dir):
    return table(spark, sf_dir, "events").where("user_id = 3").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(1).select("event_id", "user_id", "ts")


@query("SELECT o_custkey, o_orderstatus, max(o_orderdate) AS updated, min(o_orderdate) AS created FROM orders GROUP BY o_custkey, o_orderstatus")
def upsert_latest(spark, sf_dir):
    """Two batches merged by key: the latest row stays, with the key's first creation time."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", F.col("o_orderdate").alias("updated"), F.col("o_orderdate").alias("created"))
    path = _folder(spark, "upsert")
    sinks.overwrite(orders.where("o_custkey % 2 = 0"), path)
    return sinks.read_upserted(spark, sinks.upsert(orders, path, ["o_custkey", "o_orderstatus"], "updated", "created")).distinct()


@query("SELECT doc_id FROM documents")
def insert_if_new(spark, sf_dir):
    """The same batch twice and an overlapping one: every id is there once."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id"), _folder(spark, "insert")
    for batch in (docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 = 0"), docs):
        sinks.insert_if_new(batch, path, ["doc_id"])
    return spark.read.parquet(path)


@query("SELECT doc_id, CAST(NULL AS VARCHAR) AS lang FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, lang FROM documents WHERE doc_id % 2 = 1")
def append_with_new_column(spark, sf_dir):
    docs, path = table(spark, sf_dir, "documents"), _folder(spark, "evolve")
    sinks.overwrite(docs.where("doc_id % 2 = 0").select("doc_id"), path)
    sinks.append(docs.where("doc_id % 2 = 1").select("doc_id", "lang"), path)
    return sinks.read_or_none(spark, path).select("doc_id", "lang")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def not_ingested_anti(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN n_name ELSE s_name END AS company_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def backfill_left_update(spark, sf_dir):
    blank = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.when(F.col("s_suppkey") % 4 == 0, "  ").otherwise(F.col("s_name")).alias("company_name"))
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("company_name"))
    return sinks.backfill(blank, names, "s_nationkey", "company_name").select("s_suppkey", "company_name")


@query(f"WITH {PRESS} SELECT doc_id, substr(sha256('guidance_alert_' || CAST(doc_id AS VARCHAR)), 1, 16) AS alert_id, 'auto_' || substr(md5(title || '||' || release_date), 1, 16) AS stable_id, substr(sha256(company), 1, 16) AS item_id FROM press")
def stable_ids(spark, sf_dir):
    return press(spark, sf_dir).select("doc_id", dedup.alert_id("doc_id").alias("alert_id"), dedup.stable_id("title", "release_date").alias("stable_id"), dedup.feed_item_id(F.lit(" "), "company", "title").alias("item_id"))


@query("""
SELECT event_id FROM events
WHERE (epoch_ms(ts), CAST(event_id AS VARCHAR)) > (1705276800000, '500')
   OR (epoch_ms(ts) >= 1705276800000 - 120000 AND NOT ((epoch_ms(ts), CAST(event_id AS VARCHAR)) > (1705276800000, '500')) AND event_id % 2 = 1)
""")
def watermark_and_look_back(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("epoch"))
    return ingest.to_ingest(events, events.where("event_id % 2 = 0"), "epoch", "event_id", (1705276800000, "500")).select("event_id")


@query("""
SELECT CAST(floor(date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') / 7) AS BIGINT) AS "window", min(ts) AS first, max(ts) AS last, count(*) AS n, CAST(ceil(count(*) / 300) AS BIGINT) AS runs
FROM events WHERE date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') BETWEEN 0 AND 89 GROUP BY 1
""")
def backfill_windows(spark, sf_dir):
    return ingest.backfill_windows(table(spark, sf_dir, "events"), "ts", "2024-01-31")


@query("SELECT event_id, user_id, CAST(floor(epoch(ts) - epoch(lag(ts) OVER w)) AS BIGINT) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY gap > 86400")
def idle_gap(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.timestamp_diff("SECOND", F.lag("ts").over(w), F.col("ts"))
    return table(spark, sf_dir, "events").withColumn("gap", seconds).where("gap > 86400").select("event_id", "user_id", "gap")


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT user_id, floor(epoch(ts))::BIGINT AS t FROM events),
kept AS (
  SELECT user_id, min(t) AS t FROM e GROUP BY user_id
  UNION ALL
  SELECT k.user_id, (SELECT min(e.t) FROM e WHERE e.user_id = k.user_id AND e.t >= k.t + 7 * 86400) AS t FROM kept k WHERE k.t IS NOT NULL)
SELECT e.event_id, e.user_id FROM events e JOIN kept k ON e.user_id = k.user_id AND floor(epoch(e.ts))::BIGINT = k.t
""")
def ttl_dedup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return dedup.within_ttl(e, "user_id", "ts").select("event_id", "user_id")


@query("""
SELECT * FROM (VALUES ('1,750', 1750.0::DOUBLE), ('1.700', 1700.0), ('2,5', 2.5), ('1,234.56', 1234.56), ('1.234,56', 1234.56), ('12', 12.0), ('-3,5', -3.5), ('1 700', 1700.0), ('n/a', NULL)) AS t(s, v)
""")
def number_parse(spark, sf_dir):
    s = ["1,750", "1.700", "2,5", "1,234.56", "1.234,56", "12", "-3,5", "1 700", "n/a"]
    return spark.createDataFrame([(x,) for x in s], "s string").select("s", numbers.parse_number("s").alias("v"))


@query("""
SELECT * FROM (VALUES ('Q2 2024 report', 'Q2-2024'), ('H1 2023', 'H1-2023'), ('outlook FY2025', 'FY2025'), ('full-year outlook', 'FY-UNKNOWN'), ('next quarter', 'PERIOD-UNKNOWN'), ('none', 'UNKNOWN')) AS t(s, period)
""")
def fiscal_period(spark, sf_dir):
    s = ["Q2 2024 report", "H1 2023", "outlook FY2025", "full-year outlook", "next quarter", "none"]
    return spark.createDataFrame([(x,) for x in s], "s string").select("s", numbers.fiscal_period("s").alias("period"))


@query("SELECT o_orderkey, round(o_totalprice, 2) AS v FROM orders")
def number_parse_prices(spark, sf_dir):
    """Every order's price in four ways to write it."""
    english = F.format_number("o_totalprice", 2)
    european, plain = F.translate(english, ",.", ".,"), F.translate(english, ",", "")
    way = F.col("o_orderkey") % 4
    s = F.when(way == 0, english).when(way == 1, european).when(way == 2, F.translate(plain, ".", ",")).otherwise(F.translate(english, ",", " "))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(numbers.parse_number(s), 2).alias("v"))


_PERIOD = r"""CASE WHEN regexp_extract(low, '\bq([1-4])[\s\-/,]*(?:of\s+)?(20\d{2})\b', 1) <> '' THEN 'Q' || regexp_extract(low, '\bq([1-4])[\s\-/,]*(?:of\s+)?(20\d{2})\b', 1) || '-' || regexp_extract(low, '\bq([1-4])[\s\-/,]*(?:of\s+)?(20\d{2})\b', 2)
  WHEN regexp_extract(low, '\bh([12])[\s\-/,]*(?:of\s+)?(20\d{2})\b', 1) <> '' THEN 'H' || regexp_extract(low, '\bh([12])[\s\-/,]*(?:of\s+)?(20\d{2})\b', 1) || '-' || regexp_extract(low, '\bh([12])[\s\-/,]*(?:of\s+)?(20\d{2})\b', 2)
  WHEN regexp_extract(low, '\b(?:fy|full[- ]year|fiscal year|hel[aå]r(?:et)?)?\s*-?(20\d{2})\b', 1) <> '' THEN 'FY' || regexp_extract(low, '\b(?:fy|full[- ]year|fiscal year|hel[aå]r(?:et)?)?\s*-?(20\d{2})\b', 1)
  WHEN regexp_matches(low, 'full[- ]year|hel[aå]r|\bfy\b|fiscal year') THEN 'FY-UNKNOWN'
  WHEN regexp_matches(low, '\bquarter|\bkvartal|\bhalf[- ]year|\bhalv[aå]r|\bq[1-4]\b|\bh[12]\b|\bperiod') THEN 'PERIOD-UNKNOWN' ELSE 'UNKNOWN' END"""


@query(f"WITH {PRESS} SELECT doc_id, {_PERIOD} AS period FROM (SELECT doc_id, lower(title || ' ' || body) AS low FROM press)")
def fiscal_period_texts(spark, sf_dir):
    """Titles and whole texts of the feed."""
    return press(spark, sf_dir).select("doc_id", numbers.fiscal_period(F.concat("title", F.lit(" "), "body")).alias("period"))


@query("SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-') AS slug, len(regexp_extract_all(lower(text), '[a-z0-9åäöæøéèüïóáç\\-]+')) AS n_tokens FROM documents")
def slug_and_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.slugify("text").alias("slug"), F.size(text.tokens("text")).cast("long").alias("n_tokens"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'Mail' END AS company FROM supplier")
def sender_company(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    sender = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit('"'), F.col("s_name"), F.lit('" <ir@news.mail.com>'))).otherwise("ir@news.mail.com")
    return s.select("s_suppkey", text.company_of_sender(sender).alias("company"))


@query(f"WITH {PRESS} SELECT doc_id, trim(regexp_replace(title, '(?i)\\b(?:acme ab|acme)\\b', ' ', 'g')) AS masked FROM press".replace("trim(regexp_replace(title,", "trim(regexp_replace(regexp_replace(title,").replace("' ', 'g')) AS masked", "' ', 'g'), '\\s+', ' ', 'g')) AS masked"))
def company_mask(spark, sf_dir):
    return press(spark, sf_dir).select("doc_id", text.mask_company("title", F.lit("Acme AB")).alias("masked"))


@query("SELECT DISTINCT event_id, ts FROM events")
def stream_dedup(spark, sf_dir):
    """Arrivals drained through a stream; the result equals the distinct ids of the batch."""
    events, folder = table(spark, sf_dir, "events"), _folder(spark, "landing")
    events.select("event_id", F.col("ts").cast("timestamp").alias("ts")).repartition(4).write.parquet(folder)
    stream = ingest.landing(spark, folder, spark.read.parquet(folder).schema)
    kept = ingest.drain(ingest.dedup_stream(stream, "event_id", "ts", "60 days"), _folder(spark, "drained"), _folder(spark, "checkpoint"))
    return kept.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_hourly_counts(spark, sf_dir):
    folder = _folder(spark, "landing")
    table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts")).write.parquet(folder)
    stream = ingest.landing(spark, folder, spark.read.parquet(folder).schema)
    counted = ingest.drain(ingest.windowed_counts(stream, "ts", "event_type"), _folder(spark, "drained"), _folder(spark, "checkpoint"), ["start", "event_type"])
    return counted.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def _with_prior(spark, sf_dir):
    folder = _folder(spark, "landing")
    table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.coalesce("value", F.lit(0.0)).alias("value")).write.parquet(folder)
    stream = ingest.landing(spark, folder, spark.read.parquet(folder).schema)
    return ingest.drain(ingest.prior_state(stream, "user_id", "ts", "value"), _folder(spark, "drained"), _folder(spark, "checkpoint"))


@query("SELECT user_id, count(*) AS n, count(*) - 1 AS with_prior FROM events GROUP BY user_id")
def stream_prior_state(spark, sf_dir):
    return _with_prior(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.count("prior").alias("with_prior"))


@query("""
WITH e AS (SELECT user_id, ts, coalesce(value, 0) AS value, count(*) OVER (PARTITION BY user_id, ts) AS same FROM events),
p AS (SELECT *, lag(value) OVER w AS prior, lag(same) OVER w AS before FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT user_id, ts, value, prior FROM p WHERE same = 1 AND coalesce(before, 1) = 1
""")
def stream_prior_values(spark, sf_dir):
    """Every event with the value its user had before it; events of one user at one moment have no order and are left out, as is what follows them."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts")
    rows = _with_prior(spark, sf_dir).withColumn("same", F.count("*").over(Window.partitionBy("user_id", "ts")))
    rows = rows.withColumn("before", F.lag("same").over(w)).where("same = 1 AND coalesce(before, 1) = 1")
    return rows.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "value", "prior")


@query("SELECT DISTINCT n_name AS id FROM nation")
def csv_projection(spark, sf_dir):
    """Ids from one column of a CSV file."""
    root = _folder(spark, "csv")
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.option("header", True).csv(root)
    return scans.csv_ids(spark, root, "n_name").withColumnRenamed("n_name", "id")


@query("SELECT r_name AS key, CAST(r_regionkey AS BIGINT) AS weight FROM region")
def config_by_key(spark, sf_dir):
    """A JSON list of settings, written through Spark and read back as a dictionary by key."""
    path = _folder(spark, "config")
    item = F.to_json(F.struct(F.col("r_name").alias("key"), F.col("r_regionkey").alias("weight")))
    table(spark, sf_dir, "region").agg(F.concat(F.lit("["), F.array_join(F.collect_list(item), ","), F.lit("]")).alias("value")).coalesce(1).write.text(path)
    settings = scans.config(spark, path)
    return spark.createDataFrame([(k, int(v["weight"])) for k, v in settings.items()], "key string, weight long")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= 10")
def overwrite_table(spark, sf_dir):
    """The second write replaces the first."""
    nations, path = table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), _folder(spark, "over")
    sinks.overwrite(nations.where("n_nationkey < 10"), path)
    sinks.overwrite(nations.where("n_nationkey >= 10"), path)
    return spark.read.parquet(path)


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation")
def create_then_append(spark, sf_dir):
    """An empty typed table is created once, then rows are appended under its schema, cast where they differ."""
    path, nations = _folder(spark, "typed"), table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("id"), F.col("n_name").alias("name"))
    for rows in (nations.where("id < 10"), nations.where("id >= 10")):
        sinks.create_empty(spark, path, "id long, name string")
        sinks.append_typed(rows, path, "id long, name string")
    return spark.read.parquet(path)


@query("SELECT 'run-1' AS run_id, count(*) AS n_rows FROM nation UNION ALL SELECT 'run-2', count(*) FROM region")
def metrics_rows(spark, sf_dir):
    path = _folder(spark, "metrics")
    for run, name in (("run-1", "nation"), ("run-2", "region")):
        sinks.append(table(spark, sf_dir, name).agg(F.lit(run).alias("run_id"), F.count("*").alias("n_rows")), path)
    return spark.read.parquet(path)


@query("SELECT 'a' AS run_id, n_name AS name FROM nation UNION ALL SELECT 'b', r_name FROM region")
def run_output_csv(spark, sf_dir):
    """Two runs' rows as CSV files below one root, each under its id."""
    root = _folder(spark, "runs")
    for run, name in (("a", "nation"), ("b", "region")):
        sinks.run_output(table(spark, sf_dir, name).select(F.col(f"{name[0]}_name").alias("name")), root, run, "csv")
    return spark.read.option("header", True).csv(root).select("run_id", "name")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'bn' WHEN o_orderkey % 4 = 1 THEN 'k' WHEN o_orderkey % 4 = 2 THEN 'm' END AS scale,
  o_totalprice * CASE o_orderkey % 4 WHEN 0 THEN 1000.0 WHEN 1 THEN 0.001 ELSE 1.0 END AS millions FROM orders
""".replace("* CASE o_orderkey % 4 WHEN 0 THEN 1000.0 WHEN 1 THEN 0.001 ELSE 1.0 END", "* CASE o_orderkey % 4 WHEN 0 THEN 1000.0 ELSE 1.0 END / CASE o_orderkey % 4 WHEN 1 THEN 1000.0 ELSE 1.0 END"))
def values_in_millions(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    scale = F.when(k == 0, "bn").when(k == 1, "k").when(k == 2, "m")
    return table(spark, sf_dir, "orders").select("o_orderkey", scale.alias("scale"), numbers.to_millions("o_totalprice", scale).alias("millions"))


@query("""
SELECT doc_id, CASE WHEN trim(title) <> '' THEN 'passage: [TITLE] ' || trim(title) || chr(10) || chr(10) || trim(body) ELSE 'passage: ' || trim(body) END AS passage,
  'query: category: ' || company || '. description: ' || release_date AS question FROM press
""".replace("SELECT", f"WITH {PRESS} SELECT", 1))
def prompts(spark, sf_dir):
    """What a passage and a category read as to an embedding model."""
    p = press(spark, sf_dir)
    return p.select("doc_id", text.passage("title", "body").alias("passage"), text.category_query("company", F.col("release_date").cast("string")).alias("question"))
