"""Every registered query of the engine runs, and equals its SQL where it has one."""

import pytest

from tests.oracle import assert_same
from tidewire.plans import catalog

#: Queries without SQL, and the tests that compare them with a plain computation.
BY_HAND = {
    "rule_engine": "test_rule_engine.py", "guidance_extract": "test_guidance.py", "guidance_job": "test_guidance.py", "html_pages": "test_html_pages.py", "tfidf_topterms_trigrams": "test_tfidf.py",
    "tfidf_cosine_trigrams": "test_tfidf.py", "company_mentions_texts": "test_mentions.py", "chunked_embedding": "test_models.py", "diverse_subset": "test_models.py", "topic_hints": "test_models.py",
    "kmeans_select": "test_models.py", "cluster_diagnostics": "test_models.py"
}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    if name in catalog.ORACLES:
        assert_same(df, catalog.ORACLES[name], sf_dir)
    else:
        assert name in BY_HAND
        assert df.count() > 0 or name.startswith("guidance")  # a small feed may hold no guidance


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
