"""TF-IDF over one to three words of whole texts against brute force."""

import math
import re
from collections import Counter

from tidewire.plans import catalog

ACCENTS = str.maketrans("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def _weights(rows):
    """{(lang, doc_id): {term: weight}}"""
    counts, by = {}, {}
    for r in rows:
        w = re.findall("[a-z0-9_]{2,}", (r.text or "").lower().translate(ACCENTS))
        counts[r.lang, r.doc_id] = Counter(" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))
        by.setdefault(r.lang, []).append(r.doc_id)
    out = {}
    for lang, ids in by.items():
        n, df = len(ids), Counter(t for i in ids for t in counts[lang, i])
        least = 1 if n < 50 else 2 if n < 200 else 3
        most = n if n <= 3 else max(least, math.floor(0.7 * n))
        idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items() if least <= d <= most}
        for i in ids:
            x = {t: c * idf[t] for t, c in counts[lang, i].items() if t in idf}
            length = math.sqrt(sum(v * v for v in x.values()))
            out[lang, i] = {t: v / length for t, v in x.items()}
    return out


def test_trigrams(spark, sf_dir):
    weights = _weights(spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    top = {(i, t): v for (_, i), x in weights.items() for t, v in sorted(x.items(), key=lambda p: (-round(p[1], 9), p[0]))[:3]}
    got = {(r.doc_id, r.term): r.weight for r in catalog.QUERIES["tfidf_topterms_trigrams"](spark, sf_dir).collect()}
    assert got.keys() == top.keys() and all(abs(got[k] - top[k]) < 2e-6 for k in got)
    cosine = {(i, j): sum(v * y.get(t, 0) for t, v in x.items()) for (lang, i), x in weights.items() if i % 50 == 0 for (other, j), y in weights.items() if other == lang and x.keys() & y.keys()}
    got = {(r.doc_id, r.other): r.cosine for r in catalog.QUERIES["tfidf_cosine_trigrams"](spark, sf_dir).collect()}
    assert got.keys() == cosine.keys() and all(abs(got[k] - cosine[k]) < 2e-6 for k in got)


def test_terms_stay_in_their_blocks(spark, monkeypatch):
    """Many blocks: equal to brute force, no term is shuffled, and `top` keeps every possible one of the heaviest."""
    import random
    from types import SimpleNamespace

    from tidewire.operators import scoring

    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["été", "ÅR", "x", "naïve_1", "日本", "K2"]
    rows = [(i, rng.choice(["en", "sv", None]), " ".join(rng.choices(vocabulary, k=rng.randrange(0, 60)))) for i in range(260)]
    rows += [(900, "en", None), (901, "sv", ""), (902, "en", "w1, w1;w2\nw1"), (903, "da", "alone"), (904, "da", "alone again"), (905, "en", "w3 " * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    expected = {(*k, t): v for k, x in _weights([SimpleNamespace(doc_id=i, lang=g, text=t) for i, g, t in rows if g]).items() for t, v in x.items()}
    monkeypatch.setattr(scoring, "TEXT_BLOCK", 4000)
    weights = scoring.tfidf(docs, "doc_id", "text", "lang")
    got = {(r.lang, r.doc_id, r.term): r.weight for r in weights.collect()}
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)
    plan = weights._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "term" in x]
    some = {(r.lang, r.doc_id, r.term): r.weight for r in scoring.tfidf(docs, "doc_id", "text", "lang", top=2).collect()}
    assert some.items() <= got.items() and len(some) < len(got)
    for lang, i in {k[:2] for k in got}:
        mine = sorted((-round(v, 9), k[2]) for k, v in got.items() if k[:2] == (lang, i))[:2]
        assert {t for _, t in mine} <= {k[2] for k in some if k[:2] == (lang, i)}
    assert scoring.tfidf(docs.where("false"), "doc_id", "text", "lang").count() == 0


def test_pairs_are_not_shuffled(spark, sf_dir, monkeypatch):
    """Many blocks and chunks of queries: equal to brute force, and neither pairs nor terms meet in a shuffle."""
    import random
    from types import SimpleNamespace

    from pyspark.sql import functions as F

    from tidewire.operators import scoring

    for name in ("tfidf_cosine", "tfidf_cosine_trigrams"):
        plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and ("other" in x or "term" in x)]
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["été", "ÅR", "x", "naïve_1", "日本", "K2"]
    rows = [(i, rng.choice(["en", "sv", "fi", None]), " ".join(rng.choices(vocabulary, k=rng.randrange(0, 60)))) for i in range(-10, 390)]
    rows += [(900, "en", None), (905, "sv", ""), (None, "en", "w1, w1;w2\nw1"), (910, "da", "alone"), (911, "da", "alone again"), (915, "en", "w3 " * 9000), (920, "no", "none"), (921, "no", None), (922, "is", "unasked")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    weights = _weights([SimpleNamespace(doc_id=i, lang=g, text=t) for i, g, t in rows if g])
    expected = {(i, j): sum(v * y.get(t, 0) for t, v in x.items()) for (lang, i), x in weights.items() if i is not None and i % 5 == 0 for (its, j), y in weights.items() if its == lang and x.keys() & y.keys()}
    monkeypatch.setattr(scoring, "TEXT_BLOCK", 3000)
    for most in (1, 2):
        monkeypatch.setattr(scoring, "QUERY_BLOCKS", most)
        got = [((r.doc_id, r.other), r.cosine) for r in scoring.tfidf_cosine(docs, "doc_id", "text", "lang", F.expr("doc_id % 5 = 0")).collect()]
        assert len(got) == len(expected) and all(abs(v - expected[k]) < 1e-9 for k, v in got)
    none = scoring.tfidf_cosine(docs, "doc_id", "text", "lang", F.lit(False))
    assert none.count() == 0 and none.columns == ["doc_id", "other", "cosine"]
    assert scoring.tfidf_cosine(docs.where("false"), "doc_id", "text", "lang", F.lit(True)).count() == 0


def test_plain_letters():
    from tidewire.functions.text import plain_letters

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x11000)]))
    assert plain_letters(every).lower() == every.translate(str.maketrans("àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY")).lower()


def test_products(monkeypatch):
    """Dense and sparse products, in any steps, are those of the matrices."""
    import numpy as np
    import pyarrow as pa

    from tidewire.operators import scoring

    rng = np.random.default_rng(1)
    a, b = (rng.random((n, 70)) * (rng.random((n, 70)) < rng.random(70) ** 3) for n in (37, 23))
    a[:, 3] = 0
    (term, text), (place, query) = np.nonzero(a.T), np.nonzero(b.T)
    q = scoring._Queries(pa.array(range(23)), np.arange(70, dtype=np.uint64), [(0, 0, 23, slice(0, len(place)))], place.astype(np.int32), query.astype(np.int32), b[query, place])
    for common, step, width in ((0, 1 << 20, 1024), (2, 1, 1024), (1 / 20, 50, 3)):
        for name, v in (("_COMMON", common), ("_STEP", step), ("_ASKING", width)):
            monkeypatch.setattr(scoring, name, v)
        got = scoring._products(text, term.astype(np.int32), a[text, term], 37, q.tiles[0], q)
        assert np.allclose(got, a @ b.T, atol=1e-12) and ((got > 0) == (a @ b.T > 0)).all()
