"""Embeddings without a model, debiasing, language votes, clusters and topics, subsets, parameter grids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import vectors as V
from tidewire.functions.text import tokens

#: Frequent words by which a language is told.
STOP_WORDS = {
    "en": ("the", "and", "of", "to", "in", "is", "that", "for", "with", "on"),
    "sv": ("och", "att", "det", "som", "en", "för", "på", "är", "av", "med"),
    "da": ("og", "det", "at", "en", "den", "til", "er", "af", "for", "ikke"),
    "fi": ("ja", "on", "ei", "se", "että", "oli", "hän", "mutta", "ovat", "kun"),
    "fr": ("le", "la", "les", "de", "et", "des", "un", "une", "est", "que"),
    "de": ("der", "die", "und", "das", "den", "von", "zu", "mit", "ist", "ein"),
    "es": ("el", "la", "de", "que", "los", "en", "del", "las", "por", "con"),
}


def language_votes(c, head: int = 1200) -> Column:
    """(language, confidence): most stop words among the first characters' words; none gives `und` and zero."""
    def told(w):
        return V.bind(_count(w), lambda best: F.struct(F.when(best.n > 0, best.lang).otherwise("und").alias("language"), F.when(best.n > 0, F.round(1 - F.exp(-best.n / 10.0), 4)).otherwise(0.0).alias("confidence")))

    def _count(w):
        each = [F.struct(F.size(F.array_intersect(F.array_distinct(w), F.array(*map(F.lit, ws)))).alias("n"), F.lit(lang).alias("lang")) for lang, ws in STOP_WORDS.items()]
        return F.array_max(F.array(*each))

    return V.bind(tokens(F.substring(c, 1, head)), told)


def hashed_embedding(c, size: int = 64) -> Column:
    """A deterministic vector of a text: signed hashed words, length one (a stand-in where no model is at hand)."""

    @F.arrow_udf("array<double>")
    def sums(words: pa.Array) -> pa.Array:
        known = words.flatten().dictionary_encode()
        h = np.array([xxhash.xxh64_intdigest(w.as_buffer(), 42) for w in known.dictionary], np.uint64).view(np.int64)
        at, sign = h % size, np.where(h >= 0, 1.0, -1.0)
        codes, owner = known.indices.to_numpy(), pc.list_parent_indices(words).to_numpy()
        cells = np.bincount(owner * size + at[codes], sign[codes], minlength=len(words) * size).astype(float)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * size), pa.array(cells))

    return V.unit(sums(tokens(c)))


def chunks(df: DataFrame, key: str, text: str, size: int = 384, overlap: int = 32) -> DataFrame:
    """(key, chunk, words): runs of `size` words that overlap, so that long texts are embedded whole."""

    def runs(w):
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - overlap, F.lit(1)), F.lit(size - overlap))
        return F.transform(starts, lambda at: F.slice(w, at, size))

    # cut within the row: after explode every run would carry the whole text's words
    return df.select(key, F.posexplode(V.bind(tokens(text), runs)).alias("chunk", "words"))


def weighted_mean(df: DataFrame, key: str, vector: str, weight: str, unit: bool = True) -> DataFrame:
    """(key, vector): weighted mean of a key's vectors, of length one with `unit`; zeros where all weights are zero (a text without words)."""
    mean = F.coalesce(F.try_divide(F.sum(F.col("w") * F.col("x")), F.sum("w")), F.lit(0.0))
    cells = df.select(key, F.col(weight).alias("w"), F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(mean.alias("x"))
    whole = cells.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    mean = F.transform("v", lambda s: s.x)
    return whole.select(key, (V.unit(mean) if unit else mean).alias("vector"))


def all_but_the_top(df: DataFrame, key: str, vector: str, k: int = 2) -> DataFrame:
    """(key, vector): without the mean and the k strongest directions, length one."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    rows = df.select(key, F.col(vector).cast("array<double>").alias("v"))
    dense = rows.select(array_to_vector("v").alias("features"))
    mean = [float(x) for x in dense.select(Summarizer.mean(F.col("features")).alias("m")).first().m]
    axes = PCA(k=k, inputCol="features", outputCol="p").fit(dense).pc.toArray().T  # k vectors: the model, not the data
    centred = F.zip_with("v", F.array(*map(F.lit, mean)), lambda a, b: a - b)

    def without(v, axis):
        a = F.array(*(F.lit(float(x)) for x in axis))
        return V.bind(v, lambda u: V.bind(V.dot(u, a), lambda d: F.zip_with(u, a, lambda x, y: x - d * y)))

    out = centred
    for axis in axes:
        out = without(out, axis)
    return rows.select(key, V.unit(out).alias("vector"))


def diverse_subset(df: DataFrame, key: str, vector: str, clusters: int, each: int, seed: int = 7) -> DataFrame:
    """Some rows of each cluster, in the order of a hash of the key."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    features = df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    found = KMeans(k=clusters, seed=seed, maxIter=10).fit(features).transform(features)
    order = Window.partitionBy("prediction").orderBy(F.md5(F.col(key).cast("string")), key)
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= each).select(key, F.col("prediction").alias("cluster"))


def clustered(df: DataFrame, key: str, vector: str, k: int, seed: int = 7) -> DataFrame:
    """(key, vector, cluster, centre): k-means by cosine; vectors and centres have length one."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.select(key, V.unit(vector).alias("vector")).withColumn("features", array_to_vector("vector"))
    model = KMeans(k=k, seed=seed, distanceMeasure="cosine", maxIter=10).fit(rows)
    centres = F.array(*(F.array(*map(F.lit, map(float, c))) for c in model.clusterCenters()))  # the model: k vectors
    found = model.transform(rows).select(key, "vector", F.col("prediction").alias("cluster"))
    return found.withColumn("centre", V.unit(F.get(centres, F.col("cluster"))))


def cluster_diagnostics(found: DataFrame) -> DataFrame:
    """(cluster, size, mean, p10, p50, p90) of the members' cosines to their centre."""
    c = found.select("cluster", V.dot("vector", "centre").alias("c"))
    a = c.groupBy("cluster").agg(F.count("*").alias("size"), F.avg("c").alias("mean"), F.percentile("c", F.array(*map(F.lit, (0.1, 0.5, 0.9)))).alias("p"))
    return a.select("cluster", "size", "mean", *(F.col("p")[i].alias(n) for i, n in enumerate(("p10", "p50", "p90"))))


def cluster_quality(found: DataFrame, key: str) -> DataFrame:
    """One row: davies_bouldin, calinski_harabasz (of squared distances) and neighbour_rate, the share of rows whose nearest other row is in their cluster."""
    from tidewire.operators.scoring import neighbours

    def squared(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)

    means = weighted_mean(found.withColumn("one", F.lit(1.0)), "cluster", "vector", "one", unit=False).withColumnRenamed("vector", "mean")
    whole = weighted_mean(found.withColumn("one", F.lit(1.0)).withColumn("all", F.lit(0)), "all", "vector", "one", unit=False).select(F.col("vector").alias("whole"))
    rows = found.join(F.broadcast(means), "cluster")  # one row for each cluster
    each = rows.groupBy("cluster", "mean").agg(F.count("*").alias("size"), F.avg(F.sqrt(squared("vector", "mean"))).alias("spread"), F.sum(squared("vector", "mean")).alias("within"))
    a, b = each.alias("a"), each.alias("b")
    gap = F.sqrt(squared("a.mean", "b.mean"))
    worst = a.join(b, F.col("a.cluster") != F.col("b.cluster")).groupBy("a.cluster").agg(F.max((F.col("a.spread") + F.col("b.spread")) / gap).alias("r")).agg(F.avg("r").alias("davies_bouldin"))
    sums = each.crossJoin(whole).agg(F.sum(F.col("size") * squared("mean", "whole")).alias("between"), F.sum("within").alias("within"), F.sum("size").alias("n"), F.count("*").alias("k"))
    ch = sums.select(((F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))).alias("calinski_harabasz"))
    near = neighbours(found, key, "vector", 1).select(key, "other").join(found.select(key, "cluster"), key).join(found.select(F.col(key).alias("other"), F.col("cluster").alias("c")), "other")
    rate = near.agg(F.avg((F.col("cluster") == F.col("c")).cast("double")).alias("neighbour_rate"))
    return worst.crossJoin(ch).crossJoin(rate)


def topic_hints(df: DataFrame, key: str, text: str, topics: int = 5, words: int = 8, seed: int = 7) -> DataFrame:
    """(topic, terms): the strongest words of each topic."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    bags = df.select(key, F.filter(tokens(text), lambda w: F.length(w) > 3).alias("words"))
    counted = CountVectorizer(inputCol="words", outputCol="features", vocabSize=5000, minDF=2.0).fit(bags)
    model = LDA(k=topics, seed=seed, maxIter=5).fit(counted.transform(bags))
    vocabulary = F.array(*map(F.lit, counted.vocabulary))
    return model.describeTopics(words).select("topic", F.transform("termIndices", lambda i: F.element_at(vocabulary, i + 1)).alias("terms"))


def nearest_category(clusters: DataFrame, cats: DataFrame) -> DataFrame:
    """(cluster, label, cosine, margin): the category nearest to each centroid, and its lead over the next."""
    pairs = clusters.crossJoin(cats.select("label", "centroid")).select("cluster", "label", V.cosine("vector", "centroid").alias("cosine"))
    order = Window.partitionBy("cluster").orderBy(F.col("cosine").desc(), "label")
    ranked = pairs.withColumn("r", F.row_number().over(order)).withColumn("margin", F.col("cosine") - F.lead("cosine").over(order))
    return ranked.where("r = 1").select("cluster", "label", "cosine", "margin")


def grid_search(df: DataFrame, truth: str, head_a: str, head_b: str, alphas: list[float], cuts: list[float]) -> DataFrame:
    """(alpha, cut, f1_macro) of a two-class decision for every pair of parameters, in one pass over the scores."""
    grid = F.array(*(F.struct(F.lit(a).alias("alpha"), F.lit(c).alias("cut")) for a in alphas for c in cuts))
    each = df.select(truth, head_a, head_b, F.explode(grid).alias("g")).select("g.*", (F.col(truth) == 1).alias("t"), (F.col("g.alpha") * F.col(head_a) + (1 - F.col("g.alpha")) * F.col(head_b) >= F.col("g.cut")).alias("p"))
    n = each.groupBy("alpha", "cut").agg(*(F.count_if((F.col("t") == t) & (F.col("p") == p)).alias(name) for name, t, p in (("tp", True, True), ("fp", False, True), ("fn", True, False), ("tn", False, False))))
    f1 = lambda hit: F.coalesce(F.try_divide(2.0 * F.col(hit), 2.0 * F.col(hit) + F.col("fp") + F.col("fn")), F.lit(0.0))
    return n.select("alpha", "cut", ((f1("tp") + f1("tn")) / 2).alias("f1_macro"))


def reviewed_mapping(df: DataFrame, cluster: str, label: str, accepted: str) -> DataFrame:
    """One row with the accepted cluster -> label mapping as JSON, in order of cluster."""
    pairs = df.where(F.col(accepted)).select(F.col(cluster).alias("cluster"), F.col(label).alias("label")).distinct()
    return pairs.agg(F.to_json(F.array_sort(F.collect_list(F.struct("cluster", "label")))).alias("mapping"))
