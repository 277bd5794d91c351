"""Queries that SQL cannot express, against numpy and plain Python."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

from tidewire.operators import modeling
from tidewire.plans import catalog


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _unit(m):
    n = np.linalg.norm(m, axis=-1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def _embeddings(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").orderBy("vec_id").collect()
    return [r.vec_id for r in rows], np.array([r.embedding for r in rows], float), [r.label for r in rows]


def test_chunked_embedding(spark, sf_dir):
    got = {r.doc_id: np.array(r.vector) for r in catalog.QUERIES["chunked_embedding"](spark, sf_dir).collect()}
    for r in _table(spark, sf_dir, "documents").limit(60).collect():
        w = re.findall(r"[a-z0-9åäöæøéèüïóáç\-]+", (r.text or "").lower())
        total = np.zeros(16)
        for at in range(0, max(len(w) - 32, 1), 352):
            v = np.zeros(16)
            for x in w[at : at + 384]:
                h = xxhash.xxh64_intdigest(x.encode(), 42)
                h -= (h >> 63) << 64
                v[h % 16] += 1 if h >= 0 else -1
            total += _unit(v) * len(w[at : at + 384])
        assert np.allclose(got[r.doc_id], _unit(total), atol=1e-9), r.doc_id


def test_all_but_the_top(spark, sf_dir):
    ids, m, _ = _embeddings(spark, sf_dir)
    centred = m - m.mean(axis=0)
    axes = np.linalg.svd(centred, full_matrices=False)[2][:2]
    expected = _unit(centred - centred @ axes.T @ axes)
    got = {r.vec_id: r.vector for r in modeling.all_but_the_top(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding").collect()}
    assert np.allclose([got[i] for i in ids], expected, atol=1e-6)


def _silhouette(m, labels):
    distance, out = 1 - m @ m.T, []
    for i, c in enumerate(labels):
        by = {k: [j for j in range(len(labels)) if labels[j] == k and j != i] for k in set(labels)}
        if not by[c]:
            out.append(0.0)
            continue
        a, b = distance[i, by[c]].mean(), min(distance[i, js].mean() for k, js in by.items() if k != c)
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_clusters(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    ids, m, _ = _embeddings(spark, sf_dir)
    m = _unit(m)
    scores = {r.k: r.silhouette for r in catalog.QUERIES["kmeans_select"](spark, sf_dir).collect()}
    for k in (5, 10):
        rows = {r.vec_id: r for r in modeling.clustered(e, "vec_id", "embedding", k).collect()}
        labels = [rows[i].cluster for i in ids]
        # every row is in the cluster of its nearest centre
        centres = {r.cluster: np.array(r.centre) for r in rows.values()}
        names = sorted(centres)
        assert [names[j] for j in (m @ np.stack([centres[n] for n in names]).T).argmax(axis=1)] == labels
        assert abs(scores[k] - _silhouette(m, labels)) < 1e-4
    out = {r.cluster: r for r in catalog.QUERIES["cluster_diagnostics"](spark, sf_dir).collect()}
    for c in set(labels):
        cosines = [float(m[i] @ centres[c]) for i in range(len(ids)) if labels[i] == c]
        assert out[c].size == len(cosines) and abs(out[c].mean - np.mean(cosines)) < 1e-9
        assert np.allclose([out[c].p10, out[c].p50, out[c].p90], np.percentile(cosines, [10, 50, 90]))


def test_diverse_subset(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    of = defaultdict(list)
    for r in modeling.diverse_subset(e, "vec_id", "embedding", 8, 10**9).collect():
        of[r.cluster].append(r.vec_id)
    assert sum(map(len, of.values())) == e.count() and len(of) == 8
    first = {c: sorted(ids, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))[:5] for c, ids in of.items()}
    got = Counter((r.vec_id, r.cluster) for r in catalog.QUERIES["diverse_subset"](spark, sf_dir).collect())
    assert got == Counter((i, c) for c, ids in first.items() for i in ids)


def test_topic_hints(spark, sf_dir):
    words = Counter()
    for r in _table(spark, sf_dir, "documents").collect():
        words.update({w for w in re.findall(r"[a-z0-9åäöæøéèüïóáç\-]+", (r.text or "").lower()) if len(w) > 3})
    out = catalog.QUERIES["topic_hints"](spark, sf_dir).collect()
    assert sorted(r.topic for r in out) == [0, 1, 2] and all(len(set(r.terms)) == 8 and all(words[t] >= 2 for t in r.terms) for r in out)


def _number(s):
    s = re.sub(r"[\s\xa0\u2009\u202f']", "", s or "").replace("−", "-").replace("–", "-")
    kinds = [c for c in ",." if c in s]
    if len(kinds) == 2:
        decimal = max(kinds, key=s.rindex)
        s = s.replace("," if decimal == "." else ".", "").replace(decimal, ".")
    elif kinds:
        s = re.sub("[,.]", "", s) if re.fullmatch(r"[+-]?\d{1,3}([.,]\d{3})+", s) else s.replace(",", ".")
    return float(s) if re.fullmatch(r"[+-]?(\d+(\.\d*)?|\.\d+)", s) else None


def test_number_parse(spark):
    from pyspark.sql import functions as F

    from tidewire.functions import numbers

    said = ["1,750", "1.700", "2,5", "1,234.56", "1.234,56", "12", "-3,5", "1 700", "n/a", None, "", "1.2.3", "1,234,567", "−4", "7.", ".5", "1,23,4"]
    df = spark.createDataFrame([(s,) for s in said], "s string").select("s", numbers.parse_number(F.col("s")).alias("v"))
    assert {r.s: r.v for r in df.collect()} == {s: _number(s) for s in said}


def test_number_parse_prices_and_periods(spark, sf_dir):
    assert all(v is None or math.isfinite(v) for r in catalog.QUERIES["number_parse_prices"](spark, sf_dir).collect() for v in r.asDict().values() if isinstance(v, float) or v is None)
    for r in catalog.QUERIES["fiscal_period_texts"](spark, sf_dir).collect():
        assert re.fullmatch(r"Q[1-4]-20\d\d|H[12]-20\d\d|FY20\d\d|FY-UNKNOWN|PERIOD-UNKNOWN|UNKNOWN", r.period)


def test_chunked_embedding_of_no_words(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, ""), (3, "***"), (4, "word")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.vector for r in catalog.QUERIES["chunked_embedding"](spark, str(tmp_path)).collect()}
    assert got.keys() == {1, 2, 3, 4} and all(got[i] == [0.0] * 16 for i in (1, 2, 3)) and sum(map(abs, got[4])) == 1
