"""Mentions by names that travel with the tasks and by the join agree, and the texts of the former are not shuffled."""

import random

from tests.test_mentions import _by_force
from tidewire.operators import matching


def test_both_ways(spark, monkeypatch):
    r = random.Random(5)
    words = ["alfa", "beta", "gamma", "delta", "group", "the", "eta"]
    texts = [(i, " ".join(r.choice([*words, "x", "y", "z"]) for _ in range(r.randrange(14)))) for i in range(150)] + [(900, None), (901, "")]
    names = sorted({" ".join(r.sample(words, r.randrange(1, 6))) for _ in range(40)})
    t, n = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(x,) for x in names], "name string")
    out = matching.mentions(t, n, "id", "text")
    got = [tuple(x) for x in out.collect()]
    assert len(got) == len(set(got)) and set(got) == _by_force(texts, names)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(matching, "MOST_NAMES", 3)
    assert {tuple(x) for x in matching.mentions(t, n, "id", "text").collect()} == set(got)


def test_repeated_keys(spark):
    t = spark.createDataFrame([(1, "alfa"), (1, "the alfa")], "id long, text string")
    assert [tuple(x) for x in matching.mentions(t, spark.createDataFrame([("Alfa",)], "name string"), "id", "text").collect()] == [(1, "Alfa")]
