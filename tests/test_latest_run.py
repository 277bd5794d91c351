from pyspark.sql import functions as F

from tidewire.plans import catalog
from tidewire.sources import scans


def _oldest(spark, root, pattern="*"):
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    return files.agg(F.min(F.struct("modificationTime", "path")).alias("x")).first().x.path


def test_query_tells_the_newest_from_the_oldest(spark, sf_dir, monkeypatch):
    assert catalog.QUERIES["latest_run"](spark, sf_dir).first().newest == 1
    monkeypatch.setattr(scans, "latest_run", _oldest)
    assert catalog.QUERIES["latest_run"](spark, sf_dir).first().newest == 0
