"""Whole-text statistics of documents, computed over Arrow batches with numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewire.functions import spans as T
from tidewire.llm._shared import fresh

#: Fixed value: the symbols that count as such.
SYMBOLS = b"#*$%&|<>"

#: Exact counts, as the quality rules define them.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Statistics that the models see -> sign of a monotonic effect on quality (0: free).
FEATURES = {
    "log_words": 0,
    "mean_word_chars": 0,
    "upper_share": -1,
    "digit_share": 0,
    "symbol_share": -1,
    "exclaim_share": -1,
    "stop_share": 0,
    "dup_line_share": -1,
    "repeat_share": -1,
    "distinct_share": 0,
    "short_share": 0,
    "words_per_line": 0,
}

_CLASSES = {
    "space": T.SPACE,
    "continuation": bytes(range(0x80, 0xC0)),
    "symbol": SYMBOLS,
    "upper": bytes(range(65, 91)),
    "letter": bytes(range(65, 91)) + bytes(range(97, 123)),
    "digit": bytes(range(48, 58)),
    "exclaim": b"!?",
    "stop": b".,;:",
    "newline": b"\n",
}
_MATRIX = np.stack([T.lut(x) for x in _CLASSES.values()], axis=1).astype(np.int64)


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def _duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and lines with a word."""
    if b"\n" not in text:
        return 0, int(bool(text.strip()))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines)), len(lines)


def measure(s: T.Slice) -> dict[str, np.ndarray]:
    """COUNTS as long and FEATURES as double, for each text of a slice."""
    n = len(s)
    histogram = np.stack([np.bincount(s.data[a:b], minlength=256) for a, b in zip(s.offsets, s.offsets[1:])])
    c = dict(zip(_CLASSES, (histogram @ _MATRIX).T))
    w = T.words(s.data, s.offsets)
    n_words, owner = w.counts, w.owner()
    hashes = T.span_hashes(s.data, w.starts, w.ends)
    salt = T.mix(owner.astype(np.uint64) + np.uint64(1))

    grams = T.gram_hashes(hashes, 5)
    starts = np.flatnonzero(owner[: len(grams)] == owner[4:]) if len(grams) else np.zeros(0, np.int64)
    again = starts[_repeated(grams[starts] ^ salt[starts])]
    covered = T.cover(again, 5, len(owner))
    # distinct words: the first of each equal run, given back to its text
    order = np.argsort(hashes ^ salt, kind="stable")
    ordered = (hashes ^ salt)[order]
    first = np.ones(len(ordered), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    distinct = np.bincount(owner[order[first]], minlength=n)

    lines = np.array([_duplicate_lines(s.raw(i)) for i in range(n)], np.int64).reshape(n, 2)
    size = s.offsets[1:] - s.offsets[:-1]
    word_chars = size - c["space"] - c["continuation"]
    short = np.bincount(owner[(w.ends - w.starts) <= 3], minlength=n)
    repeat = np.bincount(owner[covered], minlength=n)

    def share(x, of):
        return x / np.maximum(of, 1)

    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": c["symbol"],
        "n_dup_lines": lines[:, 0],
        "n_repeat_words": repeat,
        "log_words": np.log1p(n_words),
        "mean_word_chars": share(word_chars, n_words),
        "upper_share": share(c["upper"], c["letter"]),
        "digit_share": share(c["digit"], word_chars),
        "symbol_share": share(c["symbol"], n_words),
        "exclaim_share": share(c["exclaim"], n_words),
        "stop_share": share(c["stop"], n_words),
        "dup_line_share": share(lines[:, 0], lines[:, 1]),
        "repeat_share": share(repeat, n_words),
        "distinct_share": share(distinct, n_words),
        "short_share": share(short, n_words),
        "words_per_line": share(n_words, lines[:, 1]),
    }


def table_of(column: pa.Array) -> dict[str, np.ndarray]:
    """`measure` over a whole column."""
    parts = [measure(s) for s in T.slices(column)]
    if not parts:
        return {k: np.zeros(0, np.int64 if k in COUNTS else np.float64) for k in (*COUNTS, *FEATURES)}
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def matrix(stats: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([np.asarray(stats[k], np.float64) for k in FEATURES], axis=1).reshape(-1, len(FEATURES))


def append(documents: DataFrame, columns: dict[str, str], compute: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]) -> tuple[DataFrame, dict[str, str]]:
    """`documents` with the columns that `compute` makes of the statistics; gives also their names, which clash with none."""
    names = dict(zip(columns, fresh(documents, *columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = compute(table_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(made[k]) for k in names)], names=[*batch.schema.names, *names.values()])

    schema = StructType(list(documents.schema.fields))
    for k, kind in columns.items():
        schema = schema.add(names[k], kind)
    return documents.mapInArrow(run, schema), names


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most `most` labelled documents outside the held-out fifth.

    The sample is fixed by a hash of doc_id. Null labels and ids drop out, repeated labels count as
    the smallest, and of repeated documents one is taken.
    """
    known = labels.where(F.col(label).isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    known = known.groupBy("doc_id").agg(F.min(label).cast("double").alias("label"))
    # at most `most` rows of two numbers: the size of the broadcast is bounded by the parameter
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    stats, names = append(found, dict.fromkeys(FEATURES, "double"), lambda x: {k: np.asarray(x[k], np.float64) for k in FEATURES})
    rows = stats.groupBy("doc_id", "label").agg(F.min(F.struct(*names.values())).alias("x")).select("doc_id", "label", "x.*").toArrow()
    x = np.stack([rows[names[k]].to_numpy() for k in FEATURES], axis=1) if rows.num_rows else np.zeros((0, len(FEATURES)))
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    return x[order], rows["label"].to_numpy()[order]
