"""Evaluation against labels, summaries, sweeps, timing, pools and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import metrics
from tidewire.plans.q_feed import _LABELLED, guesses
from tidewire.plans.registry import query
from tidewire.session import table

_PAIRS = f"WITH {_LABELLED}, p AS (SELECT *, CASE WHEN prob > 0.5 THEN 1 ELSE 0 END AS pred FROM guess)"


def _pairs(spark, sf_dir):
    return guesses(spark, sf_dir).withColumn("pred", F.when(F.col("prob") > 0.5, 1).otherwise(0))


@query("SELECT source, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM documents GROUP BY source")
def source_share(spark, sf_dir):
    return metrics.shares(table(spark, sf_dir, "documents"), "source")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3")
def rule_coverage(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "event_type").limit(3)


@query(f"{_PAIRS} SELECT truth, count(*) FILTER (pred = 0) AS \"0\", count(*) FILTER (pred = 1) AS \"1\" FROM p GROUP BY truth")
def confusion(spark, sf_dir):
    return metrics.confusion(_pairs(spark, sf_dir), "truth", "pred", [0, 1])


_CLASSES = f"""{_PAIRS}, c AS (SELECT DISTINCT truth AS class FROM p UNION SELECT pred FROM p),
n AS (SELECT class, count(*) FILTER (truth = class) AS support, count(*) FILTER (pred = class) AS predicted, count(*) FILTER (truth = class AND pred = class) AS tp FROM c CROSS JOIN p GROUP BY class),
m AS (SELECT class, support, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall FROM n),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM m)"""


@query(f"{_CLASSES} SELECT class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def prf_by_class(spark, sf_dir):
    m = metrics.by_class(_pairs(spark, sf_dir), "truth", "pred")
    return m.select("class", "support", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(f"{_CLASSES} SELECT (SELECT count(*) FROM p) AS n, (SELECT round(avg((truth = pred)::INTEGER), 6) FROM p) AS accuracy, round(avg(f1), 6) AS f1_macro, round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM f")
def macro_f1(spark, sf_dir):
    m = metrics.overall(_pairs(spark, sf_dir), "truth", "pred")
    return m.select("n", *(F.round(c, 6).alias(c) for c in ("accuracy", "f1_macro", "f1_weighted")))


@query(f"""{_PAIRS}, cuts AS (SELECT unnest([0.0, 0.04, 0.08, 0.12, 0.16]) AS cut)
SELECT cut::DOUBLE AS cut, count(*) FILTER (margin >= cut) AS kept, round(coalesce(count(*) FILTER (margin >= cut AND truth = pred) / nullif(count(*) FILTER (margin >= cut), 0), 0), 6) AS precision,
  round(count(*) FILTER (margin >= cut AND truth = pred) / count(*) FILTER (truth = pred), 6) AS recall, round(count(*) FILTER (margin >= cut) / count(*), 6) AS share FROM p CROSS JOIN cuts GROUP BY cut""")
def threshold_sweep(spark, sf_dir):
    s = metrics.sweep(_pairs(spark, sf_dir).withColumn("ok", F.col("truth") == F.col("pred")), "margin", "ok", [0.0, 0.04, 0.08, 0.12, 0.16])
    return s.select("cut", "kept", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "share")))


_GRID = f"""{_PAIRS}, a AS (SELECT unnest(range(17)) / 100.0 AS cut_a), b AS (SELECT unnest(range(11)) / 10.0 AS cut_b),
grid AS (SELECT cut_a::DOUBLE AS cut_a, cut_b::DOUBLE AS cut_b, count(*) FILTER (margin >= cut_a AND prob >= cut_b) AS kept,
  coalesce(count(*) FILTER (margin >= cut_a AND prob >= cut_b AND truth = pred) / nullif(count(*) FILTER (margin >= cut_a AND prob >= cut_b), 0), 0) AS precision,
  count(*) FILTER (margin >= cut_a AND prob >= cut_b AND truth = pred) / count(*) FILTER (truth = pred) AS recall, count(*) FILTER (margin >= cut_a AND prob >= cut_b) / count(*) AS share
  FROM p CROSS JOIN a CROSS JOIN b GROUP BY ALL)"""


def _grid(spark, sf_dir):
    rows = _pairs(spark, sf_dir).withColumn("ok", F.col("truth") == F.col("pred"))
    return metrics.sweep_grid(rows, "margin", "prob", "ok", [i / 100 for i in range(17)], [i / 10 for i in range(11)])


@query(f"{_GRID} SELECT cut_a, cut_b, kept, round(precision, 6) AS precision, round(recall, 6) AS recall, round(share, 6) AS share FROM grid")
def threshold_grid(spark, sf_dir):
    """Seventeen cuts of the margin by eleven of the probability."""
    return _grid(spark, sf_dir).select("cut_a", "cut_b", "kept", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "share")))


@query(f"{_GRID} SELECT cut_a, cut_b, kept FROM grid WHERE kept > 0 ORDER BY precision >= 0.6 DESC, CASE WHEN precision >= 0.6 THEN kept END DESC NULLS LAST, precision DESC, kept DESC, cut_a, cut_b LIMIT 1")
def target_precision(spark, sf_dir):
    return metrics.best_cuts(_grid(spark, sf_dir), 0.6).select("cut_a", "cut_b", "kept")


@query("""SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 4) AS mean, round(stddev_samp(l_quantity), 4) AS std, min(l_quantity) AS least, round(quantile_cont(l_quantity, 0.1), 4) AS p10, round(quantile_cont(l_quantity, 0.25), 4) AS p25,
  round(quantile_cont(l_quantity, 0.5), 4) AS p50, round(quantile_cont(l_quantity, 0.75), 4) AS p75, round(quantile_cont(l_quantity, 0.9), 4) AS p90, max(l_quantity) AS most FROM lineitem GROUP BY l_returnflag""")
def describe_by_group(spark, sf_dir):
    d = metrics.describe(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity")
    return d.select("l_returnflag", "n", "least", "most", *(F.round(c, 4).alias(c) for c in ("mean", "std", "p10", "p25", "p50", "p75", "p90")))


@query(f"{_PAIRS} SELECT lang, round(avg((truth = pred)::INTEGER), 6) AS accuracy FROM p GROUP BY lang")
def per_lang_accuracy(spark, sf_dir):
    return _pairs(spark, sf_dir).groupBy("lang").agg(F.round(F.avg((F.col("truth") == F.col("pred")).cast("int")), 6).alias("accuracy"))


@query(f"""{_PAIRS} SELECT count(*) AS n, round(avg(prob), 6) AS mean_prob, round(quantile_cont(margin, 0.1), 6) AS margin_p10, round(avg(locked::INTEGER), 6) AS locked_share, count(*) FILTER (truth <> pred) AS conflicts FROM p""")
def run_summary(spark, sf_dir):
    return _pairs(spark, sf_dir).agg(
        F.count("*").alias("n"), F.round(F.avg("prob"), 6).alias("mean_prob"), F.round(F.percentile("margin", F.lit(0.1)), 6).alias("margin_p10"),
        F.round(F.avg(F.col("locked").cast("int")), 6).alias("locked_share"), F.count_if(F.col("truth") != F.col("pred")).alias("conflicts"),
    )


@query("""WITH m AS (SELECT doc_id, source, (doc_id * 37 % 1000) / 10000.0 AS margin FROM documents),
b AS (SELECT *, CASE WHEN margin < 0.015 THEN 0 WHEN margin < 0.035 THEN 1 WHEN margin < 0.07 THEN 2 ELSE 3 END AS b, least(10, count(*) OVER (PARTITION BY source)) AS k FROM m),
i AS (SELECT *, row_number() OVER (PARTITION BY source, b ORDER BY margin, doc_id) AS i, greatest(1, round(k * CASE b WHEN 0 THEN 0.40 WHEN 1 THEN 0.35 WHEN 2 THEN 0.20 ELSE 0.05 END)) AS q FROM b)
SELECT source, doc_id, margin::DOUBLE AS margin, CASE b WHEN 0 THEN 'hard' WHEN 1 THEN 'mid' WHEN 2 THEN 'easy' ELSE 'very_easy' END AS band FROM i
QUALIFY row_number() OVER (PARTITION BY source ORDER BY (i > q)::INTEGER, b, margin, doc_id) <= k""")
def margin_bands_pool(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("doc_id") * 37 % 1000 / 10000.0).cast("double").alias("margin"))
    return metrics.labelling_pool(d, "source", "margin", "doc_id")


@query("SELECT hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1")
def hour_histogram(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("n"))


_LOCAL = "(ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Stockholm'"


@query(f"""WITH l AS (SELECT hour({_LOCAL}) * 60 + minute({_LOCAL}) AS m, dayname({_LOCAL}) AS weekday FROM events)
SELECT weekday, CASE WHEN m >= 1050 AND m < 1320 THEN 'evening' WHEN m >= 1320 OR m < 360 THEN 'late_night' WHEN m < 450 THEN 'early' WHEN m < 540 THEN 'pre_market' ELSE 'market' END AS "window", count(*) AS n FROM l GROUP BY ALL""")
def market_windows(spark, sf_dir):
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Europe/Stockholm")
    return table(spark, sf_dir, "events").groupBy(F.date_format(local, "EEEE").alias("weekday"), metrics.market_window(local).alias("window")).agg(F.count("*").alias("n"))


@query("""SELECT s.slot::INTEGER AS slot, count(e.event_id) AS n FROM range(48) s(slot) LEFT JOIN events e ON (hour(e.ts) * 60 + minute(e.ts)) // 30 = s.slot GROUP BY s.slot""")
def halfhour_zero_fill(spark, sf_dir):
    return metrics.half_hours(table(spark, sf_dir, "events"), "ts")


@query("SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 5")
def top_n_per_group(spark, sf_dir):
    return metrics.top_n(table(spark, sf_dir, "documents"), "source", [F.col("n_chars").desc(), F.col("doc_id")], 5).select("source", "doc_id", "n_chars")


@query("SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= 20")
def seeded_sample_per_group(spark, sf_dir):
    return metrics.hash_sample(table(spark, sf_dir, "documents"), "lang", "doc_id", 20).select("lang", "doc_id")


@query(f"{_PAIRS} SELECT doc_id, round((prob < 0.6)::INTEGER + 0.5 * (margin < 0.06)::INTEGER + 0.25 * locked::INTEGER, 6) AS uncertainty FROM p ORDER BY uncertainty DESC, doc_id LIMIT 50")
def review_queue(spark, sf_dir):
    u = (F.col("prob") < 0.6).cast("int") + 0.5 * (F.col("margin") < 0.06).cast("int") + 0.25 * F.col("locked").cast("int")
    return _pairs(spark, sf_dir).select("doc_id", F.round(u.cast("double"), 6).alias("uncertainty")).orderBy(F.col("uncertainty").desc(), "doc_id").limit(50)


@query("SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_orderkey ORDER BY revenue DESC, l_orderkey LIMIT 100")
def top_revenue(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")).orderBy(F.col("revenue").desc(), "l_orderkey").limit(100)


@query()
def kmeans_select(spark, sf_dir):
    """Silhouette of k-means for some k: which number of clusters to take."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    e = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")).cache()
    judge = ClusteringEvaluator(distanceMeasure="cosine")
    rows = [(k, float(judge.evaluate(KMeans(k=k, seed=7, distanceMeasure="cosine", maxIter=10).fit(e).transform(e)))) for k in (5, 10, 15)]
    e.unpersist()
    return spark.createDataFrame(rows, "k int, silhouette double")
