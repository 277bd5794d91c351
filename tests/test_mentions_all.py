"""Names from every text, and many names of one word, against brute force."""

import random
import re

from tests.test_mentions import _by_force
from tidewire.functions.text import TOKEN
from tidewire.operators import matching
from tidewire.plans import catalog


def test_names_of_every_text(spark, sf_dir):
    """Each text that begins with two different words gives a name, whatever its id."""
    documents = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    names = {r.n_name for r in spark.read.parquet(f"{sf_dir}/nation.parquet").collect()}
    for _, text in documents:
        begin = list(dict.fromkeys(re.findall(TOKEN, (text or "").lower())))[:2]
        if len(begin) == 2:
            names.add(" ".join(begin))
    got = [(r.doc_id, r.company) for r in catalog.QUERIES["company_mentions_texts"](spark, sf_dir).collect()]
    assert len(got) == len(set(got)) and set(got) == _by_force(documents, names)


def test_long_names_and_small_steps(spark, monkeypatch):
    """Names of one to seven words, looked up in pairs or not, texts in any steps."""
    r = random.Random(8)
    words = ["alfa", "beta", "gamma", "delta", "group", "the", "eta", "zeta", "åre", "k2"]
    texts = [(i, " ".join(r.choice([*words, "x", "y", "z", "."]) for _ in range(r.randrange(25)))) for i in range(250)] + [(900, None), (901, ""), (902, "Alfa alfa alfa"), (903, "the group")]
    names = sorted({" ".join(r.sample(words, r.randrange(1, 8))) for _ in range(60)} | {"Alfa", "...", "The Group"})
    t, n = spark.createDataFrame(texts, "id long, text string").repartition(3), spark.createDataFrame([(x,) for x in names], "name string")
    for some in (names, [x for x in names if " " in x], [x for x in names if len(x.split()) > 3]):
        expected = _by_force(texts, some)
        for paired, step, held in ((16, 1 << 20, 1000), (3, 7, 5), (1, 100, 1)):
            for name, v in (("_PAIRED", paired), ("_STEP", step), ("_HELD", held)):
                monkeypatch.setattr(matching, name, v)
            got = [tuple(x) for x in matching.mentions(t, n.where(n.name.isin(some)), "id", "text").collect()]
            assert len(got) == len(set(got)) and set(got) == expected
    assert matching.mentions(t, n.where("false"), "id", "text").count() == 0
    assert matching.mentions(t, n, "id", "text", 100).count() == 0
