"""Quality rules: exact heuristics, and boosted trees over document statistics where they pass.

The trees are fitted on a bounded labelled sample, may only fall in the features that mark junk
(capitals, symbols, exclamations, repetition), and are flattened into node arrays, so a batch
of documents is scored in a few vectorised steps a tree.

Cases: null and empty texts count zero and fail the base rule; texts of any length are read whole; a score equal to the threshold
is kept; repeated rows are judged each and alike; no documents give no rows; no or one-sided labels keep whatever passes the base
rule where most labels are good, or none are given (a constant verdict); other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewire.llm import _stats, _trees

SAMPLE = 6000
THRESHOLD = 0.3
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> _trees.Trees:
    x, y = _stats.labelled_sample(documents, labels, label, sample)
    return _trees.fit(x, y, n_trees=60, depth=3, monotone=list(_stats.FEATURES.values()))


def verdicts(documents: DataFrame, model: _trees.Trees) -> DataFrame:
    """Per document: doc_id, the exact counts, base_failed, kept, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = _stats.table_of(batch.column("text"))
            failed = (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"])
            score = model.score(_stats.matrix(stats))
            made = [pa.array(np.asarray(stats[k], np.int64)) for k in _stats.COUNTS]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *made, pa.array(failed), pa.array(~failed & (score >= THRESHOLD)), pa.array(score)],
                names=["doc_id", *_stats.COUNTS, "base_failed", "kept", "score"],
            )

    kind = dict(documents.dtypes)["doc_id"]
    counts = ", ".join(f"{k} long" for k in _stats.COUNTS)
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {counts}, base_failed boolean, kept boolean, score double")
