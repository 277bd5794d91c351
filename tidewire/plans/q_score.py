"""Similarity, fusion, neighbours, consensus, TF-IDF, guidance comparison and score."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import vectors as V
from tidewire.operators import guidance, scoring
from tidewire.plans.press import press
from tidewire.plans.registry import query
from tidewire.session import table

_CENTROIDS = """cells AS (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding) AS x FROM embeddings),
means AS (SELECT label, i, avg(x::DOUBLE) AS x FROM cells GROUP BY label, i),
cents AS (SELECT label, list(x ORDER BY i) AS c, sqrt(sum(x * x)) AS n FROM means GROUP BY label)"""
_SIMS = f"""{_CENTROIDS},
sims AS (SELECT e.vec_id, c.label, list_cosine_similarity(e.embedding::DOUBLE[], c.c) AS s FROM embeddings e CROSS JOIN cents c)"""


def _sims(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return scoring.similarities(e, "vec_id", "embedding", scoring.centroids(e, "embedding", "label"))


@query(f"WITH {_CENTROIDS} SELECT label, i, round(x / n, 6) AS x FROM means JOIN cents USING (label)")
def centroid(spark, sf_dir):
    c = scoring.centroids(table(spark, sf_dir, "embeddings"), "embedding", "label")
    return c.select("label", F.posexplode("centroid").alias("p", "v")).select("label", (F.col("p") + 1).cast("long").alias("i"), F.round("v", 6).alias("x"))


@query(f"WITH {_SIMS} SELECT vec_id, label, round(s, 6) AS cosine FROM sims")
def cosine_doc_cat(spark, sf_dir):
    return _sims(spark, sf_dir).select("vec_id", F.explode(F.arrays_zip("labels", "sims")).alias("x")).select("vec_id", F.col("x.labels").alias("label"), F.round("x.sims", 6).alias("cosine"))


_FUSED = f"""{_SIMS},
stat AS (SELECT *, avg(s) OVER d AS m, stddev_pop(s) OVER d AS sd, avg(s * s * s) OVER d AS m3, stddev_pop(s * s * s) OVER d AS sd3 FROM sims WINDOW d AS (PARTITION BY vec_id)),
z AS (SELECT vec_id, label, greatest(-8, least(8, (s - m) / (sd + 1e-8))) AS za, greatest(-8, least(8, (s * s * s - m3) / (sd3 + 1e-8))) AS zb FROM stat),
ex AS (SELECT *, exp((za - max(za) OVER d) / 0.6) AS ea, exp((zb - max(zb) OVER d) / 0.8) AS eb FROM z WINDOW d AS (PARTITION BY vec_id)),
pr AS (SELECT vec_id, label, ea / sum(ea) OVER d AS pa, eb / sum(eb) OVER d AS pb FROM ex WINDOW d AS (PARTITION BY vec_id)),
fused AS (SELECT *, 0.6 * pa + 0.4 * pb AS p FROM pr)"""


def _fused(spark, sf_dir):
    sims = _sims(spark, sf_dir).withColumn("cubes", F.transform("sims", lambda x: x * x * x))
    return scoring.fuse(sims, "sims", "cubes")


@query(f"WITH {_FUSED} SELECT vec_id, label, round(p, 6) AS p FROM fused")
def softmax_fusion(spark, sf_dir):
    return _fused(spark, sf_dir).select("vec_id", F.explode(F.arrays_zip("labels", "p")).alias("x")).select("vec_id", F.col("x.labels").alias("label"), F.round("x.p", 6).alias("p"))


@query(f"""WITH {_FUSED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, label) AS r FROM fused)
SELECT vec_id, any_value(label) FILTER (r = 1) AS best, round(max(p) FILTER (r = 1), 6) AS prob, round(max(p) FILTER (r = 1) - max(p) FILTER (r = 2), 6) AS margin,
  arg_max(label, pa) = arg_max(label, pb) AS agree, round(-sum(pa * ln(greatest(pa, 1e-12))), 6) AS entropy FROM ranked GROUP BY vec_id""")
def top_margin_entropy(spark, sf_dir):
    f = _fused(spark, sf_dir)
    return f.select("vec_id", F.col("labels")[F.col("best")].alias("best"), F.round("prob", 6).alias("prob"), F.round("margin", 6).alias("margin"), "agree", F.round("entropy_a", 6).alias("entropy"))


@query(f"WITH {_FUSED} SELECT vec_id, label FROM fused QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, label) <= 3")
def top3_categories(spark, sf_dir):
    return _fused(spark, sf_dir).select("vec_id", F.explode(F.transform("top3", lambda i: F.col("labels")[i])).alias("label"))


_KNN = """knn AS (SELECT a.vec_id, b.vec_id AS other, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c, a.label = b.label AS same FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY c DESC, b.vec_id) <= 5)"""


@query(f"WITH {_KNN} SELECT vec_id, other, round(c, 5) AS cosine FROM knn")
def knn_join(spark, sf_dir):
    return scoring.neighbours(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 5).select("vec_id", "other", F.round("cosine", 5).alias("cosine"))


@query(f"WITH {_KNN} SELECT vec_id, round(avg(same::INTEGER), 6) AS share FROM knn GROUP BY vec_id")
def knn_consistency(spark, sf_dir):
    return scoring.consistency(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", 5).select("vec_id", F.round("share", 6).alias("share"))


@query(f"""WITH {_FUSED},
member AS (SELECT vec_id, vec_id // 4 AS grp, greatest(0.1, 0.7 * CASE WHEN vec_id % 3 = 0 THEN 0.5 ELSE (vec_id % 10) / 10.0 END + 0.3 * (vec_id % 100 + 1) / (SELECT avg(vec_id % 100 + 1) FROM embeddings)) AS w FROM embeddings),
g AS (SELECT grp, label, sum(w * p) / sum(w) AS p FROM fused JOIN member USING (vec_id) GROUP BY grp, label)
SELECT grp, label, round(p / sum(p) OVER (PARTITION BY grp), 6) AS p FROM g""")
def group_consensus(spark, sf_dir):
    v = F.col("vec_id")
    f = _fused(spark, sf_dir).withColumn("grp", F.floor(v / 4)).withColumn("conf", F.when(v % 3 == 0, None).otherwise((v % 10) / 10.0)).withColumn("len", v % 100 + 1)
    c = scoring.consensus(f, "grp", "vec_id", "p", "conf", "len")
    labels = f.agg(F.max("labels").alias("labels"))
    return c.crossJoin(F.broadcast(labels)).select("grp", F.explode(F.arrays_zip("labels", "p")).alias("x")).select("grp", F.col("x.labels").alias("label"), F.round("x.p", 6).alias("p"))


_TFIDF = """toks AS (SELECT doc_id, lang, regexp_extract_all(lower(translate(substr(text, 1, 100000), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY')), '[a-z0-9_]{2,}') AS w FROM documents),
terms AS (SELECT doc_id, lang, unnest(w) AS term FROM toks UNION ALL SELECT doc_id, lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM toks),
counts AS (SELECT lang, doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
size AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
kept AS (SELECT c.lang, term, count(*) AS df, any_value(n) AS n FROM counts c JOIN size s ON c.lang IS NOT DISTINCT FROM s.lang GROUP BY c.lang, term
  HAVING count(*) >= CASE WHEN any_value(n) < 50 THEN 1 WHEN any_value(n) < 200 THEN 2 ELSE 3 END AND count(*) <= CASE WHEN any_value(n) <= 3 THEN any_value(n) ELSE greatest(3, floor(0.70 * any_value(n))) END),
raw AS (SELECT c.lang, doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS x FROM counts c JOIN kept k USING (lang, term)),
weights AS (SELECT lang, doc_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY lang, doc_id)) AS weight FROM raw)"""


@query(f"WITH {_TFIDF} SELECT doc_id, term, round(weight, 6) AS weight FROM weights QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) <= 3")
def tfidf_topterms(spark, sf_dir):
    from tidewire.operators import metrics

    w = scoring.tfidf(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", 2, top=3)
    return metrics.top_n(w, "doc_id", [F.round("weight", 9).desc(), F.col("term")], 3).select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query(f"WITH {_TFIDF} SELECT a.doc_id, b.doc_id AS other, round(sum(a.weight * b.weight), 6) AS cosine FROM weights a JOIN weights b ON a.lang = b.lang AND a.term = b.term WHERE a.doc_id % 50 = 0 GROUP BY 1, 2")
def tfidf_cosine(spark, sf_dir):
    """Every fiftieth document as a query against all."""
    return scoring.tfidf_cosine(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", F.expr("doc_id % 50 = 0"), 2, digits=6)


@query()
def tfidf_topterms_trigrams(spark, sf_dir):
    """As `tfidf_topterms`, over one to three words."""
    from tidewire.operators import metrics

    w = scoring.tfidf(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", top=3)
    return metrics.top_n(w, "doc_id", [F.round("weight", 9).desc(), F.col("term")], 3).select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query()
def tfidf_cosine_trigrams(spark, sf_dir):
    """As `tfidf_cosine`, over one to three words."""
    return scoring.tfidf_cosine(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", F.expr("doc_id % 50 = 0"), digits=6)


@query()
def guidance_extract(spark, sf_dir):
    return guidance.candidates(press(spark, sf_dir))


# every order is a statement of its customer's total price
_STATED = """stated AS (SELECT o_custkey AS company, 'FY2024' AS period, 'revenue' AS metric, 'reported' AS basis, CASE WHEN o_custkey % 3 = 0 THEN 'pct' ELSE 'ccy' END AS unit, CASE WHEN o_custkey % 3 = 0 THEN 'margin' ELSE 'level' END AS metric_kind,
  o_totalprice / CASE WHEN o_custkey % 3 = 0 THEN 10000 ELSE 1 END AS value_low, o_totalprice / CASE WHEN o_custkey % 3 = 0 THEN 10000 ELSE 1 END * 1.1 AS value_high, o_orderdate AS ts, o_orderkey AS doc_id, 0 AS ordinal FROM orders),
prev AS (SELECT *, lag(value_low) OVER w AS ol, lag(value_high) OVER w AS oh FROM stated WINDOW w AS (PARTITION BY company, period, metric, basis ORDER BY ts, doc_id)),
comp AS (SELECT *, (ol + oh) / 2 AS old_mid, (value_low + value_high) / 2 AS new_mid, CASE WHEN unit = 'pct' THEN (value_low + value_high) / 2 - (ol + oh) / 2 END AS delta_pp,
  CASE WHEN unit = 'ccy' AND ol IS NOT NULL THEN ((value_low + value_high) / 2 - (ol + oh) / 2) / abs((ol + oh) / 2) * 100 END AS delta_pct, CASE WHEN ol IS NOT NULL THEN greatest(0, (oh - ol) - (value_high - value_low)) END AS tight FROM prev)"""


def _stated(spark, sf_dir):
    pct = F.col("o_custkey") % 3 == 0
    low = F.col("o_totalprice") / F.when(pct, 10000).otherwise(1)
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("company"), F.lit("FY2024").alias("period"), F.lit("revenue").alias("metric"), F.lit("reported").alias("basis"), F.when(pct, "pct").otherwise("ccy").alias("unit"),
        F.when(pct, "margin").otherwise("level").alias("metric_kind"), low.alias("value_low"), (low * 1.1).alias("value_high"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("ordinal"),
        F.lit("raise").alias("verb_text"),
    )


@query(f"WITH {_STATED} SELECT doc_id, round(delta_pp, 3) AS delta_pp, round(delta_pct, 3) AS delta_pct, round(tight, 4) AS range_tightened FROM comp")
def prior_lag_compare(spark, sf_dir):
    c = guidance.compare_with_previous(_stated(spark, sf_dir))
    return c.select("doc_id", F.round("delta_pp", 3).alias("delta_pp"), F.round("delta_pct", 3).alias("delta_pct"), F.round("range_tightened", 4).alias("range_tightened"))


_SCORED = f"""{_STATED},
scored AS (SELECT *, coalesce(CASE WHEN unit = 'pct' THEN delta_pp ELSE delta_pct END, 0) AS delta, old_mid IS NULL AS first FROM comp),
verbed AS (SELECT *, CASE WHEN first THEN 'initiate' WHEN abs(delta) < CASE WHEN unit = 'pct' THEN 0.3 ELSE 2.0 END THEN 'reaffirm' WHEN delta > 0 THEN 'raise' ELSE 'lower' END AS verb,
  first OR abs(delta) >= CASE WHEN unit = 'pct' THEN 1.5 ELSE 5.0 END AS significant, least(1.0, 0.82 + 0.15 * least(1.0, abs(delta) / CASE WHEN unit = 'pct' THEN 3.0 ELSE 10.0 END)) AS sig_score FROM scored)"""


@query(f"WITH {_SCORED} SELECT doc_id, verb, significant, round(sig_score, 6) AS sig_score FROM verbed")
def significance_score(spark, sf_dir):
    s = guidance.score(guidance.compare_with_previous(_stated(spark, sf_dir)))
    return s.select("doc_id", "verb", "significant", F.round("sig_score", 6).alias("sig_score"))


@query(f"WITH {_SCORED} SELECT company, count(*) AS n_versions, count(*) FILTER (significant) AS n_events FROM verbed GROUP BY company")
def versions_and_events(spark, sf_dir):
    s = guidance.score(guidance.compare_with_previous(_stated(spark, sf_dir)))
    v = guidance.versions(s).groupBy("company").agg(F.countDistinct("version_id").alias("n_versions"))
    e = guidance.events(s).groupBy("company").agg(F.countDistinct("event_id").alias("n_events"))
    return v.join(e, "company", "left").select("company", "n_versions", F.coalesce("n_events", F.lit(0)).alias("n_events"))


@query(f"WITH {_SCORED} SELECT doc_id, company, round(max(sig_score), 6) AS score, count(*) AS n_items, 'FY2024' AS period, 'revenue ' || any_value(verb) AS summary, substr(sha256('guidance_alert_' || CAST(doc_id AS VARCHAR)), 1, 16) AS alert_id FROM verbed WHERE significant GROUP BY doc_id, company")
def alert_rollup(spark, sf_dir):
    return guidance.alerts(guidance.score(guidance.compare_with_previous(_stated(spark, sf_dir)))).withColumn("score", F.round("score", 6))


@query(f"""WITH RECURSIVE {_STATED}, seq AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY ts, doc_id) AS r, (value_low + value_high) / 2 AS mid FROM stated),
walk AS (
  SELECT company, doc_id, r, unit, mid, CAST(NULL AS DOUBLE) AS prior, mid AS now FROM seq WHERE r = 1
  UNION ALL
  SELECT s.company, s.doc_id, s.r, s.unit, s.mid, w.now AS prior,
    CASE WHEN (s.unit = 'pct' AND abs(s.mid - w.now) >= 1.5) OR (s.unit = 'ccy' AND abs((s.mid - w.now) / abs(w.now) * 100) >= 5) THEN s.mid ELSE w.now END
  FROM walk w JOIN seq s ON s.company = w.company AND s.r = w.r + 1)
SELECT doc_id, round(prior, 4) AS prior_mid FROM walk""")
def state_fold(spark, sf_dir):
    """Prior state that moves only on significant statements."""
    f = guidance.fold_state(_stated(spark, sf_dir))
    return f.select("doc_id", F.round((F.col("prior.value_low") + F.col("prior.value_high")) / 2, 4).alias("prior_mid"))


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS length, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings")
def vector_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm("embedding"), 5).alias("length"), F.round(V.total(F.transform("embedding", lambda x: x.cast("double"))), 5).alias("total"))
