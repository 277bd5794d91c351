"""Connected components of a graph given by its links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.session import cut


def _star(links: DataFrame) -> DataFrame:
    """Tie every vertex's larger neighbours, then its smaller ones, to the smallest it sees."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    up = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
    floor = up.groupBy("a").agg(F.min("b").alias("m"))
    down = up.join(floor, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
    return down.where("a > b").distinct()


#: Links that one task ties together in its memory; a larger graph is tied in rounds of shuffles until so few are left.
MOST_AT_ONCE = 100_000


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of whole components -> (a, b) with b the smallest vertex that a reaches, for each other a."""
    of = [[batch.column(x).to_numpy(zero_copy_only=False) for x in "ab"] for batch in batches]
    if not of:
        return
    names, ends = np.unique(np.concatenate([x for pair in zip(*of) for x in pair]), return_inverse=True)
    x, y = ends.reshape(2, -1)
    root = np.arange(len(names))
    while len(x):
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while (root != (up := root[root])).any():
            root = up
        open_ = root[x] != root[y]
        x, y = x[open_], y[open_]
    low = np.flatnonzero(root != np.arange(len(root)))
    yield pa.RecordBatch.from_arrays([pa.array(names[low]), pa.array(names[root[low]])], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(a, b) links between longs -> (a, b) with b the smallest vertex that a reaches, for each a that has a smaller one.

    Large-star and small-star rounds until nothing changes, or until one task can tie what is left; each round shuffles the links by
    vertex with map-side minima and is checkpointed in the shared folder. Null and self links drop out.
    """
    links = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(state) == seen or not state[0]:
            return links
        if state[0] <= MOST_AT_ONCE:
            return cut(links.coalesce(1).mapInArrow(_at_once, links.schema))
        seen = tuple(state)
        links = cut(_star(links))
