"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every run of `window` benchmark words (or a whole shorter item) is a pattern. For each pattern
length, a shift table over hashed word blocks tells how many start positions a block rules out;
blocks are looked at only every `m - B + 1` words, so ruled-out stretches cost one lookup. What
remains must have a shift of zero, its suffix block selects a bucket of patterns, and the words
themselves are compared.

A benchmark of at most `SHARD_BYTES` of text travels with the tasks, patterns and all. Of a larger one only the shift tables do, whose
size is fixed; documents are still read once, each position that the tables leave open is a candidate with its words, and candidates meet
the patterns in a join on the hash of the whole window, where the words are compared. Nothing but candidates is written.

Cases: null and word-less texts have no words and are clean; null or word-less items never occur;
repeated items count once by id, a null id counts as the empty id; repeated documents are judged
each, whatever their id, null too; texts of any length are read whole; an empty benchmark leaves all documents clean, no documents give no rows;
other columns, whatever their names, are ignored or kept.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions import spans as T
from tidewire.llm._shared import fresh, stored

WINDOW = 10
SHARD_BYTES = 4 << 20
_TABLE_BITS = 20

#: Lower-cases A-Z; word bytes are letters, digits and every byte of a non-ASCII character.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = T.lut(bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256)))


class ShiftTable:
    """Wu-Manber's shift table for patterns of `m` words: how many starts a hashed block of words rules out."""

    def __init__(self, m: int, shift: np.ndarray | None = None):
        self.m, self.block = m, min(2, m)
        self.step = m - self.block + 1
        self.shift = np.full(1 << _TABLE_BITS, self.step, np.uint8) if shift is None else shift

    def add(self, hashes: np.ndarray) -> None:
        """Takes in patterns, one row of word hashes each."""
        for j in range(self.step):
            np.minimum.at(self.shift, self._slot(_combine(hashes[:, j : j + self.block])), np.uint8(self.step - 1 - j))

    @staticmethod
    def _slot(block_hashes: np.ndarray) -> np.ndarray:
        return (block_hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def candidates(self, hashes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash of the last block) of what the table leaves open; texts are hashes[off[i]:off[i+1]]."""
        n, m = len(hashes), self.m
        if n < m:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        blocks = _combine_runs(hashes, self.block, np.arange(0, n - m + 1, self.step) + m - self.block)
        shift = self.shift[self._slot(blocks)].astype(np.int64)
        looked = np.arange(0, n - m + 1, self.step)
        open_ = shift < self.step
        first, skip = looked[open_], shift[open_]
        width = self.step - skip
        starts = np.repeat(first + skip, width) + (np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width))
        starts = starts[starts <= n - m]
        suffix = _combine_runs(hashes, self.block, starts + m - self.block)
        possible = self.shift[self._slot(suffix)] == 0
        starts, suffix = starts[possible], suffix[possible]
        text = np.searchsorted(off, starts, side="right") - 1
        inside = starts + m <= off[text + 1]
        return starts[inside], suffix[inside]


class PatternTable(ShiftTable):
    """All patterns of `m` words, with buckets by the hash of their last block."""

    def __init__(self, m: int, patterns: dict[tuple[bytes, ...], set[str]]):
        super().__init__(m)
        self.patterns, self.items = list(patterns), list(patterns.values())
        hashes = _hash_words([w for p in self.patterns for w in p]).reshape(-1, m)
        self.add(hashes)
        self.suffix = np.unique(_combine(hashes[:, m - self.block :]))
        self.by_whole = defaultdict(list)
        for i, h in enumerate(_combine(hashes).tolist()):
            self.by_whole[h].append(i)

    def find(self, hashes: np.ndarray, off: np.ndarray, word_at) -> Iterator[tuple[int, int]]:
        """(first word, pattern) of each occurrence."""
        starts, suffix = self.candidates(hashes, off)
        at = np.minimum(np.searchsorted(self.suffix, suffix), len(self.suffix) - 1)
        starts = starts[self.suffix[at] == suffix]
        for i, h in zip(starts.tolist(), _combine_runs(hashes, self.m, starts).tolist()):
            for p in self.by_whole.get(h, ()):
                if all(word_at(i + j) == w for j, w in enumerate(self.patterns[p])):
                    yield i, p


def _combine(columns: np.ndarray) -> np.ndarray:
    out = np.zeros(len(columns), np.uint64)
    factor = 1
    for j in range(columns.shape[1]):
        factor = factor * 0xC2B2AE3D27D4EB4F % (1 << 64)
        out += columns[:, j] * np.uint64(factor | 1)
    return T.mix(out)


def _combine_runs(hashes: np.ndarray, k: int, starts: np.ndarray) -> np.ndarray:
    return _combine(hashes[starts[:, None] + np.arange(k)])


def _hash_words(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return T.span_hashes(data, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)


def split_words(text: str | None) -> list[bytes]:
    data = _LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    w = T.words(data, np.array([0, len(data)]), _WORD)
    return [data[s:e].tobytes() for s, e in zip(w.starts, w.ends)]


def patterns_of(text: str | None, window: int = WINDOW) -> list[tuple[bytes, ...]]:
    """The patterns of an item: all runs of `window` words, or the whole of a shorter one."""
    w = split_words(text)
    m = min(window, len(w))
    return [tuple(w[i : i + m]) for i in range(len(w) - m + 1 if w else 0)]


def compile_patterns(items: list[tuple[object, str | None]], window: int = WINDOW) -> list[PatternTable]:
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        for p in patterns_of(text, window):
            by_length[len(p)][p].add("" if item is None else str(item))
    return [PatternTable(m, dict(p)) for m, p in sorted(by_length.items())]


def _read(s: T.Slice):
    """Lower-cased bytes, words and word hashes of a slice."""
    data = _LOWER[s.data]
    w = T.words(data, s.offsets, _WORD)
    return data, w, T.span_hashes(data, w.starts, w.ends)


def _occurrences(tables: list[PatternTable], s: T.Slice):
    """Words of a slice, and (table, first word, pattern) of each occurrence."""
    data, w, hashes = _read(s)

    def word_at(i):
        return data[w.starts[i] : w.ends[i]].tobytes()

    return w, [(t, i, p) for t in tables for i, p in t.find(hashes, w.off, word_at)]


def _summary(tables: list[PatternTable]):
    """Per document: counts and digest of what occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, n_hit, found = [], [], []
            for s in T.slices(batch.column("text")):
                w, seen = _occurrences(tables, s)
                edge, items = np.zeros(len(w.starts) + 1, np.int32), defaultdict(set)
                for t, i, p in seen:
                    edge[i] += 1
                    edge[i + t.m] -= 1
                    items[int(np.searchsorted(w.off, i, side="right")) - 1] |= t.items[p]
                covered = np.concatenate([[0], np.cumsum(np.cumsum(edge)[:-1] > 0)])
                counts += w.counts.tolist()
                n_hit += (covered[w.off[1:]] - covered[w.off[:-1]]).tolist()
                found += [sorted(items.get(i, ())) for i in range(len(s))]
            digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array(digest, pa.string()), pa.array([h > 0 for h in n_hit], pa.bool_())],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return run


def _rows_without_hits(tables: list[PatternTable]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for s in T.slices(batch.column("text")):
                w, seen = _occurrences(tables, s)
                for _, i, _ in seen:
                    keep[s.first + int(np.searchsorted(w.off, i, side="right")) - 1] = False
            yield batch.filter(pa.array(keep))

    return run


# --- a benchmark that does not fit into a task ---------------------------------------------------

#: Tasks that the shift tables of a large benchmark are made in.
_MAKERS = 16


def _pattern_rows(window: int):
    """Items -> m, hash, words and item id of each pattern."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                found = patterns_of(text, window)
                if found:
                    m = len(found[0])
                    whole = _combine(_hash_words([w for p in found for w in p]).reshape(-1, m))
                    name = "" if item is None else str(item)
                    yield pa.RecordBatch.from_arrays([pa.array([m] * len(found), pa.int32()), pa.array(whole.view(np.int64)), pa.array([b" ".join(p).decode() for p in found]), pa.array([name] * len(found))], names=["m", "whole", "words", "item"])

    return run


def _shift_tables(window: int):
    """Items -> one shift table for each length of their patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, ShiftTable] = {}
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = patterns_of(text, window)
                if found:
                    m = len(found[0])
                    made.setdefault(m, ShiftTable(m)).add(_hash_words([w for p in found for w in p]).reshape(-1, m))
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int32()), pa.array([t.shift.tobytes() for t in made.values()], pa.binary())], names=["m", "shift"])

    return run


def _open_windows(tables: list[ShiftTable]):
    """Texts -> their number of words, and the windows that the shift tables leave open."""
    kind = pa.list_(pa.struct([("m", pa.int32()), ("start", pa.int32()), ("whole", pa.int64()), ("words", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, left = [], []
            for s in T.slices(batch.column("text")):
                data, w, hashes = _read(s)
                own: list[list[dict]] = [[] for _ in range(len(s))]
                for t in tables:
                    starts, _ = t.candidates(hashes, w.off)
                    for i, h in zip(starts.tolist(), _combine_runs(hashes, t.m, starts).view(np.int64).tolist()):
                        text = int(np.searchsorted(w.off, i, side="right")) - 1
                        words = b" ".join(data[w.starts[j] : w.ends[j]].tobytes() for j in range(i, i + t.m)).decode()
                        own[text].append({"m": t.m, "start": i - int(w.off[text]), "whole": h, "words": words})
                counts += w.counts.tolist()
                left += own
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "key", "twin")), pa.array(counts, pa.int64()), pa.array(left, kind)], names=["doc_id", "key", "twin", "n_words", "left"])

    return run


def _joined(documents: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, twin, n_words) of every document, and (key, twin, n_hit, items) of the texts in which a pattern occurs."""
    items = benchmark.select("item_id", F.col("text"))
    shift: dict[int, np.ndarray] = {}
    for row in items.repartition(_MAKERS).mapInArrow(_shift_tables(window), "m int, shift binary").toLocalIterator():
        made = np.frombuffer(row.shift, np.uint8)
        shift[row.m] = np.minimum(shift[row.m], made) if row.m in shift else made.copy()
    tables = [ShiftTable(m, t) for m, t in sorted(shift.items())]
    text = F.coalesce("text", F.lit(""))
    docs = documents.select("doc_id", F.xxhash64(text).alias("key"), F.xxhash64(text, F.lit("twin")).alias("twin"), text.alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    seen = stored(docs.mapInArrow(_open_windows(tables), f"doc_id {kind}, key long, twin long, n_words long, left array<struct<m: int, start: int, whole: long, words: string>>"))
    patterns = items.mapInArrow(_pattern_rows(window), "m int, whole long, words string, item string").groupBy("m", "whole", "words").agg(F.collect_set("item").alias("items"))
    left = seen.select("key", "twin", F.explode("left").alias("c")).select("key", "twin", "c.*")
    hits = left.join(patterns, ["m", "whole", "words"])
    span = F.struct(F.col("start").alias("a"), (F.col("start") + F.col("m")).alias("b"))
    of = hits.groupBy("key", "twin").agg(F.sort_array(F.collect_set(span)).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))

    def more(x, s):
        return F.struct(F.greatest(x.to, s.b).alias("to"), (x.n + F.greatest(F.lit(0), s.b - F.greatest(x.to, s.a))).alias("n"))

    covered = F.aggregate("spans", F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")), more, lambda x: x.n.cast("long"))
    return seen.drop("left"), stored(of.select("key", "twin", covered.alias("n_hit"), "items"))


def _fits(benchmark: DataFrame) -> bool:
    return (benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= SHARD_BYTES


def _tables(benchmark: DataFrame, window: int) -> list[PatternTable]:
    return compile_patterns([tuple(r) for r in benchmark.select("item_id", "text").collect()], window)


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    if _fits(benchmark):
        kind = documents.schema["doc_id"].dataType.simpleString()
        return documents.select("doc_id", "text").mapInArrow(_summary(_tables(benchmark, window)), f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
    seen, hits = _joined(documents, benchmark, window)
    n_hit, items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return seen.join(hits, ["key", "twin"], "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean_documents(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents (all columns) in which no pattern occurs."""
    if _fits(benchmark):
        return documents.mapInArrow(_rows_without_hits(_tables(benchmark, window)), documents.schema)
    _, hits = _joined(documents, benchmark, window)
    k, t = fresh(documents, "key", "twin")
    hits = hits.select(F.col("key").alias(k), F.col("twin").alias(t))
    text = F.coalesce("text", F.lit(""))
    return documents.join(hits, (F.xxhash64(text) == F.col(k)) & (F.xxhash64(text, F.lit("twin")) == F.col(t)), "left_anti")
