"""Text clean-up, links, snippets, frequencies, mails, and the guidance job with its sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.functions import text
from tidewire.operators import guidance, metrics
from tidewire.plans.press import press
from tidewire.plans.q_scans import _folder
from tidewire.plans.registry import query
from tidewire.session import table
from tidewire.sources import html, scans


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN 'https://base.example/' || page_id ELSE 'view ' || page_id END AS link FROM pages""")
def url_resolution(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    url = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise("  ")
    base = F.when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://base.example/"), F.col("page_id").cast("string")))
    return p.select("page_id", text.first_filled(url, base, F.concat(F.lit("view "), F.col("page_id").cast("string"))).alias("link"))


@query("""WITH p AS (SELECT doc_id, trim(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1]) AS para FROM documents),
h AS (SELECT doc_id, para, substr(para, 1, 350) AS head FROM p),
c AS (SELECT *, length(head) - coalesce(nullif(strpos(reverse(head), '.'), 0), length(head) + 1) + 1 AS dot, length(head) - coalesce(nullif(strpos(reverse(head), ' '), 0), length(head) + 1) + 1 AS gap FROM h)
SELECT doc_id, coalesce(CASE WHEN length(para) <= 350 THEN para WHEN dot >= 210 THEN substr(head, 1, dot) WHEN gap >= 210 THEN substr(head, 1, gap - 1) ELSE head END, '') AS snippet FROM c""")
def snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.snippet("text").alias("snippet"))


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, 'https?://\\S+|www\\.\\S+', ' ', 'g'), '\\S+@\\S+\\.\\S+', ' ', 'g'), '[\\s\\x{A0}]+', ' ', 'g')) AS plain FROM documents""")
def link_removal(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.strip_links("text", whole_words=True).alias("plain"))


@query(r"""SELECT p_partkey, 'Write to (' || repeat(' ', 1) || '), or see' AS plain FROM part""")
def address_removal(spark, sf_dir):
    """An address goes, the brackets around it stay."""
    said = F.concat(F.lit("Write  to (ir."), F.col("p_partkey").cast("string"), F.lit("@mail-1.acme.com), or see https://acme.com/a?b=(c)"))
    return table(spark, sf_dir, "part").select("p_partkey", text.strip_links(said).alias("plain"))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'reports' WHEN 1 THEN 'News: , wins' ELSE 'Nordseax AB grows' END AS masked FROM supplier""")
def company_forms_mask(spark, sf_dir):
    """A name in other cases and spacings, with a legal form behind it; a longer word is another name."""
    k = F.col("s_suppkey") % 3
    said = F.when(k == 0, "NORD-SEA A/S reports").when(k == 1, "News: Nord  Sea, Ltd , wins").otherwise("Nordseax AB grows")
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.mask_company_forms(said, F.lit("Nord Sea")).alias("masked"))


@query("""SELECT doc_id, CASE WHEN lang IS NULL THEN 'und' WHEN lang IN ('en', 'sv', 'da', 'fi') THEN lang ELSE lang || '-xx' END AS code FROM documents""")
def language_codes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.language_code(F.concat(F.upper("lang"), F.lit("-XX"))).alias("code"))


@query("""SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9åäöæøéèüïóáç\\-]+')) AS word FROM documents) GROUP BY word ORDER BY n DESC, word LIMIT 50""")
def token_frequency(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(text.tokens("text")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "word").limit(50)


@query("""SELECT doc_id, regexp_replace(text, '[0-9]+', '#', 'g') AS masked FROM documents""")
def number_masking(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[0-9]+", "#").alias("masked"))


@query("""SELECT doc_id, list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')), lambda w: NOT list_contains(['with', 'that', 'this', 'from'], w)))[1:5]::VARCHAR AS words FROM documents""".replace("list_sort(", "array_to_string(list_sort(").replace("[1:5]::VARCHAR", "[1:5], ' ')"))
def stop_word_removal(spark, sf_dir):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))
    kept = F.array_except(words, F.array(*map(F.lit, ("with", "that", "this", "from"))))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(F.array_sort(kept), 1, 5), " ").alias("words"))


@query("""SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (
  SELECT user_id, s, count(*) AS n FROM (SELECT user_id, ts, sum(new::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
    SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 HOUR, true) AS new FROM events)) GROUP BY user_id, s) GROUP BY user_id""")
def user_sessions(spark, sf_dir):
    """Session windows with a gap of six hours (an extension)."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    n = e.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return n.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("SELECT page_id, 'Acme ' || page_id AS sender, 'Page ' || page_id AS subject FROM pages")
def mail_parts(spark, sf_dir):
    """Pages as mails: written as messages, read as files and taken apart."""
    p = table(spark, sf_dir, "pages")
    head = F.concat(F.lit('From: "Acme '), F.col("page_id"), F.lit('" <ir@acme.com>\r\nSubject: Page '), F.col("page_id"), F.lit("\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"))
    raw = p.select(F.col("page_id").cast("string").alias("path"), F.encode(F.concat(head, "html"), "utf-8").alias("content"))
    m = html.mails(raw)
    return m.select(F.col("path").cast("long").alias("page_id"), text.company_of_sender("sender").alias("sender"), "subject")


@query(r"""SELECT item_id, regexp_replace(text, '^[\x09-\x0D\x1C-\x20]+|[\x09-\x0D\x1C-\x20]+$', '', 'g') AS body FROM benchmark""")
def mail_bodies(spark, sf_dir):
    """Texts as mails of three parts, an attachment and a marked-up form before the plain one, which is what is read."""
    b = table(spark, sf_dir, "benchmark")
    part = "\r\n--cut\r\nContent-Type: {}; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n{}\r\n"

    def coded(c):
        return F.regexp_replace(F.base64(F.encode(c, "utf-8")), r"\s", "")

    raw = F.concat(
        F.lit("From: ir@acme.com\r\nSubject: x\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=cut\r\n"),
        F.lit(part.format("text/plain", "Content-Disposition: attachment\r\n")), coded(F.lit("not this")),
        F.lit(part.format("text/html", "")), coded(F.lit("<p>nor this</p>")),
        F.lit(part.format("text/plain", "")), coded(F.col("text")), F.lit("\r\n--cut--\r\n"),
    )
    m = html.mails(b.select(F.col("item_id").cast("string").alias("path"), F.encode(raw, "utf-8").alias("content")))
    return m.select(F.col("path").cast(b.schema["item_id"].dataType).alias("item_id"), F.col("text").alias("body"))


@query("SELECT 1 AS newest")
def latest_run(spark, sf_dir):
    """The newest of two written runs."""
    root = _folder(spark, "runs")
    for run in (2, 1):  # the later one has the smaller name
        table(spark, sf_dir, "region").coalesce(1).write.parquet(f"{root}/run={run}")
    return spark.range(1).select(F.when(F.lit(scans.latest_run(spark, root, "*.parquet") or "").contains("run=1"), 1).otherwise(0).alias("newest"))


@query()
def guidance_job(spark, sf_dir):
    """Extraction, comparison, score, logs and the current state."""
    paths = [_folder(spark, x) for x in ("versions", "events", "current")]
    return guidance.job(press(spark, sf_dir), *paths)


@query("SELECT o_custkey, o_orderkey, round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 4) AS change FROM orders")
def change_since_last(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") - F.lag("o_totalprice").over(w), 4).alias("change"))


@query("SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS rank FROM documents) WHERE rank <= 2")
def longest_per_source(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("n", F.length("text"))
    return metrics.top_n(d, "source", [F.col("n").desc(), F.col("doc_id")], 2).select("source", "doc_id", F.col("rank").cast("long").alias("rank"))
