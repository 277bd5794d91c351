"""Language votes, stand-in embeddings, debiasing, clusters, topics, grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import vectors as V
from tidewire.operators import modeling, scoring
from tidewire.plans.q_feed import _LABELLED, guesses
from tidewire.plans.q_score import _CENTROIDS
from tidewire.plans.registry import query
from tidewire.session import table

_VOTES = ", ".join(f"({i}, '{lang}', {list(ws)})" for i, (lang, ws) in enumerate(modeling.STOP_WORDS.items()))


@query(f"""WITH lang_words(i, lang, ws) AS (VALUES {_VOTES}),
w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(substr(text, 1, 1200)), '[a-z0-9åäöæøéèüïóáç\\-]+')) AS w FROM documents),
v AS (SELECT doc_id, lang_words.lang AS language, len(list_intersect(w, ws)) AS n FROM w CROSS JOIN lang_words QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, lang_words.lang DESC) = 1)
SELECT doc_id, CASE WHEN n > 0 THEN language ELSE 'und' END AS language, CASE WHEN n > 0 THEN round(1 - exp(-n / 10.0), 4) ELSE 0 END AS confidence FROM v""")
def language_votes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", modeling.language_votes(F.col("text")).alias("l")).select("doc_id", "l.language", "l.confidence")


@query("""WITH w AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9åäöæøéèüïóáç\\-]+')) AS n FROM documents)
SELECT doc_id, count(*) AS n_chunks, sum(least(384, n - pos + 1)) AS n_words FROM (SELECT doc_id, n, unnest(range(1, greatest(n - 32, 1) + 1, 352)) AS pos FROM w) GROUP BY doc_id""")
def text_chunks(spark, sf_dir):
    c = modeling.chunks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return c.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.size("words")).alias("n_words"))


@query()
def chunked_embedding(spark, sf_dir):
    """Vectors of chunks, averaged by their numbers of words."""
    c = modeling.chunks(table(spark, sf_dir, "documents"), "doc_id", "text")
    c = c.select("doc_id", F.size("words").alias("n"), modeling.hashed_embedding(F.array_join("words", " "), 16).alias("v"))
    return modeling.weighted_mean(c, "doc_id", "v", "n")


@query("SELECT vec_id, true AS unit_length FROM embeddings")
def all_but_the_top(spark, sf_dir):
    return modeling.all_but_the_top(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").select("vec_id", (F.abs(V.norm("vector") - 1) < 1e-9).alias("unit_length"))


@query()
def diverse_subset(spark, sf_dir):
    return modeling.diverse_subset(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, 5)


@query()
def cluster_diagnostics(spark, sf_dir):
    """Size and cosines to the centre of each of ten clusters."""
    found = modeling.clustered(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 10)
    return modeling.cluster_diagnostics(found)


@query(f"""WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
x AS (SELECT vec_id, label, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM u),
m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY label, i), w AS (SELECT i, avg(x) AS w FROM x GROUP BY i),
d AS (SELECT vec_id, label, sum((x - m) * (x - m)) AS d2 FROM x JOIN m USING (label, i) GROUP BY vec_id, label),
s AS (SELECT label, count(*) AS size, avg(sqrt(d2)) AS spread, sum(d2) AS within FROM d GROUP BY label),
g AS (SELECT a.label AS a, b.label AS b, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS gap FROM m a JOIN m b ON a.i = b.i AND a.label <> b.label GROUP BY a.label, b.label),
db AS (SELECT avg(r) AS davies_bouldin FROM (SELECT g.a, max((p.spread + q.spread) / gap) AS r FROM g JOIN s p ON p.label = g.a JOIN s q ON q.label = g.b GROUP BY g.a)),
bt AS (SELECT sum(size * d2) AS between_, (SELECT sum(within) FROM s) AS within, (SELECT sum(size) FROM s) AS n, (SELECT count(*) FROM s) AS k FROM s JOIN (SELECT label, sum((m - w) * (m - w)) AS d2 FROM m JOIN w USING (i) GROUP BY label) USING (label)),
nn AS (SELECT a.vec_id, a.label = b.label AS same FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) = 1)
SELECT round(davies_bouldin, 6) AS davies_bouldin, round((between_ / (k - 1)) / (within / (n - k)), 4) AS calinski_harabasz, (SELECT round(avg(same::INTEGER), 6) FROM nn) AS neighbour_rate FROM db, bt""")
def cluster_quality(spark, sf_dir):
    """The labels taken as clusters."""
    found = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("cluster"), V.unit("embedding").alias("vector"))
    q = modeling.cluster_quality(found, "vec_id")
    return q.select(F.round("davies_bouldin", 6).alias("davies_bouldin"), F.round("calinski_harabasz", 4).alias("calinski_harabasz"), F.round("neighbour_rate", 6).alias("neighbour_rate"))


@query()
def topic_hints(spark, sf_dir):
    return modeling.topic_hints(table(spark, sf_dir, "documents"), "doc_id", "text", 3)


@query(f"""WITH {_CENTROIDS}, cl AS (SELECT vec_id % 7 AS cluster, unnest(range(1, 65)) AS i, unnest(embedding) AS x FROM embeddings),
cm AS (SELECT cluster, list(x ORDER BY i) AS v FROM (SELECT cluster, i, avg(x::DOUBLE) AS x FROM cl GROUP BY cluster, i) GROUP BY cluster),
p AS (SELECT cluster, label, list_cosine_similarity(v, c) AS cosine FROM cm CROSS JOIN cents)
SELECT cluster, label, round(cosine, 6) AS cosine, round(cosine - lead(cosine) OVER w, 6) AS margin FROM p QUALIFY row_number() OVER w = 1 WINDOW w AS (PARTITION BY cluster ORDER BY cosine DESC, label)""".replace(" QUALIFY row_number() OVER w = 1 WINDOW w AS (PARTITION BY cluster ORDER BY cosine DESC, label)", " WINDOW w AS (PARTITION BY cluster ORDER BY cosine DESC, label) QUALIFY row_number() OVER w = 1"))
def cluster_to_category(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    clusters = scoring.centroids(e.withColumn("cluster", F.col("vec_id") % 7), "embedding", "cluster").select(F.col("label").alias("cluster"), F.col("centroid").alias("vector"))
    out = modeling.nearest_category(clusters, scoring.centroids(e, "embedding", "label"))
    return out.select("cluster", "label", F.round("cosine", 6).alias("cosine"), F.round("margin", 6).alias("margin"))


@query(f"""WITH {_LABELLED}, g AS (SELECT a.alpha, c.cut FROM (SELECT unnest([0.2, 0.5, 0.8]) AS alpha) a CROSS JOIN (SELECT unnest([0.3, 0.5]) AS cut) c),
r AS (SELECT alpha, cut, truth = 1 AS t, alpha::DOUBLE * prob::DOUBLE + (1 - alpha::DOUBLE) * margin >= cut::DOUBLE AS p FROM guess CROSS JOIN g),
n AS (SELECT alpha, cut, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn FROM r GROUP BY ALL)
SELECT alpha::DOUBLE AS alpha, cut::DOUBLE AS cut, round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 6) AS f1_macro FROM n""")
def parameter_grid(spark, sf_dir):
    return modeling.grid_search(guesses(spark, sf_dir), "truth", "prob", "margin", [0.2, 0.5, 0.8], [0.3, 0.5]).withColumn("f1_macro", F.round("f1_macro", 6))


@query("""SELECT '[' || string_agg('{"cluster":' || cluster || ',"label":' || label || '}', ',' ORDER BY cluster, label) || ']' AS mapping FROM (SELECT DISTINCT vec_id % 3 AS cluster, label FROM embeddings WHERE vec_id % 2 = 0)""")
def reviewed_mapping(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 3).alias("cluster"), "label", (F.col("vec_id") % 2 == 0).alias("ok"))
    return modeling.reviewed_mapping(e, "cluster", "label", "ok")
