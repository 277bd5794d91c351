"""TF-IDF against its SQL where a share of texts and a letter are easily taken wrong."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.oracle import assert_same
from tidewire.plans import catalog


@pytest.mark.parametrize("name", ["tfidf_topterms", "tfidf_cosine"])
def test_exact_share_and_dotted_i(spark, tmp_path, name):
    """63 of 90 texts are 70 % (as doubles 0.7 * 90 is less than 63); a capital İ is an i."""
    rows = [(i, "en", "common" if i < 63 else "other") for i in range(90)]
    rows += [(100 + i, "tr", t) for i, t in enumerate(["İstanbul istanbul", "İİ ii KİM", "kim İ x", "rest", "rest again"])]
    ids, langs, texts = zip(*rows)
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "lang": list(langs), "text": list(texts)}), f"{tmp_path}/documents.parquet")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    assert_same(df, catalog.ORACLES[name], str(tmp_path))
