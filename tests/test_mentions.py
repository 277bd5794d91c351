"""Company mentions against brute force over every position of a text."""

import re

from tidewire.functions.text import TOKEN
from tidewire.operators import matching
from tidewire.plans import catalog


def _by_force(texts, names):
    """A run of a text as long as the name, around one of its own words, has half of the name's words, and no other name has more there."""
    found = set()
    split = {n: list(dict.fromkeys(re.findall(TOKEN, n.lower()))) for n in names}
    for key, text in texts:
        t = re.findall(TOKEN, (text or "").lower())
        for i, w in enumerate(t):
            share = {}
            for name, words in split.items():
                first = max(i + 1 - len(words), 0)
                if w in words and w not in matching.GENERIC:
                    share[name] = len(set(words) & set(t[first : first + 2 * len(words) - 1])) / len(words)
            found |= {(key, n) for n, s in share.items() if s >= 0.5 and s == max(share.values())}
    return found


def test_either_half_of_a_name(spark):
    texts = [(1, "Volvo rose today"), (2, "new cars today"), (3, "nothing"), (4, None), (5, "The Alfa one two three four Beta"), (6, "Gamma and Alfa")]
    names = ["Volvo Cars", "Alfa Beta Gamma", "The Group"]
    out = matching.mentions(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(n,) for n in names], "name string"), "id", "text")
    got = {(r.id, r.company) for r in out.collect()}
    assert got == _by_force(texts, names) == {(1, "Volvo Cars"), (2, "Volvo Cars"), (6, "Alfa Beta Gamma")}


def test_whole_texts(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    names = {r.n_name for r in spark.read.parquet(f"{sf_dir}/nation.parquet").collect()}
    for r in documents:
        begin = list(dict.fromkeys(re.findall(TOKEN, (r.text or "").lower())))[:2]
        if r.doc_id % 100 == 0 and len(begin) == 2:
            names.add(" ".join(begin))
    got = {(r.doc_id, r.company) for r in catalog.QUERIES["company_mentions_texts"](spark, sf_dir).collect()}
    assert got and got == _by_force([(r.doc_id, r.text) for r in documents], names)
