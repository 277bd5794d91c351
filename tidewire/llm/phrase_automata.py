"""Substring dedup with repeated-phrase automata.

A window is `WINDOW` words. A window recurs if its words also start at any other place.

1. Confirm. Equal texts are looked at once, with their number of copies. Word `GRAM`-grams are hashed and each
   window elects its smallest (the last of equals) as its anchor; equal windows elect equal anchors,
   so a window can only recur if its anchor does. Anchors are counted, then the windows that elected
   a recurring one (by 96 bits of hash). Both counts combine before they shuffle, so no phrase is hot.
2. Compile. Of each recurring window one occurrence represents it: the text with the smallest key
   that holds it, so neighbours mostly have the same one. Runs of such windows are the confirmed passages. They are dealt to
   shards by the place they were taken from, `SHARD` windows each on average, and a task compiles a
   shard's passages with pyahocorasick: one pattern for each window, one symbol for each word.
3. Stream. Every stretch of a text in which a window recurs is sent to the shards that hold one of its windows' passages,
   and streamed through the automaton there; what it locates are the spans to remove. A stretch is
   cut at cells of `CELL` window starts, and a shard that many cells ask for is copied for every
   `HOT` of them, so a copy costs no more than the cells that it serves.
4. Spans are gathered per text, and the covered words are removed.

Hashes only select what is compiled and where it is sought; the automata compare words.

Cases: null and word-less texts have no words; repeated rows count as occurrences of each other's
windows; texts under `window` words have no window and are kept; no documents give no rows; texts are told apart by 128 bits of
hash, whatever their id; other columns, whatever their names, are ignored or kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions import spans as T
from tidewire.llm._shared import Scratch, fresh, stored

WINDOW = 35
GRAM = 16
#: Window starts of a cell, the unit in which texts are sent to shards (bits of a long).
CELL = 64
#: Recurring windows that an automaton is compiled for, on average.
SHARD = 1024
#: log2 of the window starts of a text whose passages stay together.
TOGETHER = 10
#: Cells that are streamed through one copy of a shard.
HOT = 512

KEY = ["key", "twin"]


def _elected(hashes: np.ndarray, off: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, the gram position each elects, all gram hashes) of the texts hashes[off[i]:off[i+1]]."""
    grams = T.gram_hashes(hashes, gram)
    span = window - gram + 1
    n = len(grams) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), grams
    # 40 bits of hash, then the position from the right: the minimum tells where it stands
    place = np.uint64((1 << 24) - 1)
    rank = (grams & ~place) | (place - np.arange(len(grams), dtype=np.uint64) % (place + np.uint64(1)))
    best, width = rank, 1
    while 2 * width <= span:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    best = np.minimum(best[:n], best[span - width : span - width + n])
    starts = np.arange(n)
    owner = np.searchsorted(off, starts, side="right") - 1
    inside = starts + window <= off[owner + 1]
    starts = starts[inside]
    offset = (place - (best[inside] & place)).astype(np.int64)
    size = int(place) + 1
    at = starts - starts % size + offset
    return starts, np.where(at < starts, at + size, at), grams


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """Values in order of their owners (0 to n - 1) as one list for each."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def _anchors(window: int, gram: int):
    """Texts -> their number of words, the digest of all words, and the anchors with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, places, counts, digests = [], [], [], []
            for s in T.slices(batch.column("text")):
                w = T.words(s.data, s.offsets)
                _, at, grams = _elected(T.span_hashes(s.data, w.starts, w.ends), w.off, window, gram)
                at = np.unique(at)
                owner = np.searchsorted(w.off, at, side="right") - 1
                lists.append(_lists(grams[at].view(np.int64), owner, len(s)))
                places.append(_lists((at - w.off[owner]).astype(np.int32), owner, len(s)))
                counts.append(w.counts)
                digests += [hashlib.sha256(b" ".join(s.raw(i).split())).hexdigest() for i in range(len(s))]
            if counts:
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("doc_id", *KEY)), pa.array(np.concatenate(counts)), pa.array(digests), pa.concat_arrays(lists), pa.concat_arrays(places)],
                    names=["doc_id", *KEY, "n_words", "whole", "anchors", "places"],
                )

    return run


def _windows(window: int, gram: int):
    """Texts with the places of their recurring anchors -> one row for each window that elected one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            carried = [batch.column(c).to_numpy() for c in (*KEY, "copies")]
            places = batch.column("places")
            ends, flat = np.cumsum(places.value_lengths().to_numpy()), places.flatten().to_numpy()
            for s in T.slices(batch.column("text")):
                w = T.words(s.data, s.offsets)
                hashes = T.span_hashes(s.data, w.starts, w.ends)
                starts, at, grams = _elected(hashes, w.off, window, gram)
                own = slice(int(ends[s.first - 1]) if s.first else 0, int(ends[s.last - 1]))
                text = np.searchsorted(ends, np.arange(own.start, own.stop), side="right") - s.first
                recurring = np.zeros(len(grams) + 1, bool)
                recurring[w.off[text] + flat[own]] = True
                starts = starts[recurring[at]]
                whole, check = T.gram_hashes(hashes, window)[starts], T.gram_hashes(T.mix(hashes), window)[starts]
                owner = np.searchsorted(w.off, starts, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x[s.first + owner]) for x in carried), pa.array((starts - w.off[owner]).astype(np.int32)), pa.array(whole.view(np.int64)), pa.array(check.astype(np.uint32).view(np.int32))],
                    names=[*KEY, "copies", "start", "hash", "check"],
                )

    return run


def _runs(positions: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, last) of each run of consecutive integers of a sorted array."""
    if len(positions):
        cuts = np.flatnonzero(np.diff(positions) != 1) + 1
        yield from zip(positions[np.concatenate([[0], cuts])].tolist(), positions[np.concatenate([cuts - 1, [-1]])].tolist())


def _pieces(window: int):
    """Texts with their cells -> what they send to shards: passages (to every copy) and stretches to search (to one copy)."""
    columns = ["shard", "salt", "stretch", *KEY, "begin", "words"]
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.string()]

    def of(text: str, cells: list[dict]) -> Iterator[tuple]:
        w = text.encode().split()
        asked: dict[tuple[int, int], list[int]] = {}
        confirmed: dict[tuple[int, int], list[np.ndarray]] = {}
        for c in sorted(cells, key=lambda c: c["cell"]):
            asked.setdefault((c["shard"], c["salt"]), []).append(c["cell"])
            if c["own"]:
                bits = np.unpackbits(np.array([c["own"]], "<i8").view(np.uint8), bitorder="little")
                confirmed.setdefault((c["shard"], c["salts"]), []).append(np.flatnonzero(bits) + c["cell"] * CELL)
        for (shard, salts), starts in confirmed.items():
            for a, b in _runs(np.concatenate(starts)):
                for salt in range(salts):
                    yield shard, salt, False, a, b" ".join(w[a : b + window])
        for (shard, salt), of_copy in asked.items():
            for a, b in _runs(np.array(of_copy)):
                yield shard, salt, True, a * CELL, b" ".join(w[a * CELL : (b + 1) * CELL + window - 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for key, twin, text, cells in zip(*(batch.column(c).to_pylist() for c in (*KEY, "text", "cells"))):
                for shard, salt, stretch, begin, words in of(text, cells):
                    rows.append((shard, salt, stretch, key, twin, begin, words))
                    size += len(words)
                    if size > T.SLICE_BYTES:
                        yield _batch(rows, columns, kinds)
                        rows, size = [], 0
            if rows:
                yield _batch(rows, columns, kinds)

    return run


def _batch(rows: list[tuple], columns: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    of = list(zip(*rows)) or [[] for _ in columns]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()).cast(k) if k == pa.string() else pa.array(x, k) for x, k in zip(of, kinds)], names=columns)


class PassageAutomaton:
    """An Aho-Corasick automaton of all windows of some passages, each word a symbol."""

    def __init__(self, window: int):
        import ahocorasick

        self.window, self.symbols, self.automaton, self.made = window, {}, ahocorasick.Automaton(ahocorasick.STORE_LENGTH), False

    def _symbol(self, word: str) -> str:
        n = len(self.symbols) + 1
        return self.symbols.setdefault(word, chr(n if n < 0xD800 else n + 0x800))  # code points, but for the surrogates

    def add(self, passage: str) -> None:
        said = "".join(map(self._symbol, passage.split(" ")))
        for i in range(len(said) - self.window + 1):
            self.automaton.add_word(said[i : i + self.window])

    def spans(self, words: str) -> list[list[int]]:
        """What occurrences of windows cover, as (begin, end) runs."""
        if not len(self.automaton):
            return []
        if not self.made:
            self.automaton.make_automaton()
            self.made = True
        out: list[list[int]] = []
        for last, length in self.automaton.iter("".join([self.symbols.get(x, "\0") for x in words.split(" ")])):
            a, b = last - length + 1, last + 1
            if out and a <= out[-1][1]:
                out[-1][1] = b
            else:
                out.append([a, b])
        return out


def _locate(window: int):
    """Shards, each with its passages first: the spans that occurrences cover in the stretches."""
    columns = [*KEY, "begin", "end"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, automaton = None, None
        for batch in batches:
            rows = []
            for *of, stretch, key, twin, begin, words in zip(*(batch.column(c).to_pylist() for c in ("shard", "salt", "stretch", *KEY, "begin", "words"))):
                if of != shard:
                    shard, automaton = of, PassageAutomaton(window)
                if stretch:
                    rows += [(key, twin, begin + a, begin + b) for a, b in automaton.spans(words)]
                else:
                    automaton.add(words)
            yield _batch(rows, columns, kinds)

    return run


def _keyed(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents.select("doc_id", F.xxhash64(text).alias("key"), F.xxhash64(text, F.lit("twin")).alias("twin"), text.alias("text"))


def _routes(windows: DataFrame, scratch: Scratch) -> DataFrame:
    """Of each text with a recurring window: its cells, the shards (with their copies) that they meet and the windows that they give them."""
    # where a window stands: 40 bits of its text's key and 24 of its start; a clash only puts two texts' passages together
    place = F.shiftleft(F.shiftright("key", 24), 24).bitwiseOR(F.col("start").cast("long").bitwiseAND(F.lit((1 << 24) - 1)))
    counted = windows.groupBy("hash", "check").agg(F.sum("copies").alias("n"), F.min(place).alias("first"))
    recurring = scratch.store(counted.where("n > 1").select("hash", "check", "first"))
    shards = recurring.count() // SHARD + 1
    shard = F.pmod(F.xxhash64(F.shiftright("first", TOGETHER)), F.lit(shards)).alias("shard")
    own = F.when(place == F.col("first"), F.expr(f"shiftleft(1L, start % {CELL})")).otherwise(F.lit(0).cast("long"))
    met = windows.join(recurring, ["hash", "check"]).select(*KEY, shard, F.floor(F.col("start") / CELL).cast("int").alias("cell"), own.alias("own"))
    cells = scratch.store(met.groupBy(*KEY, "shard", "cell").agg(F.bit_or("own").alias("own")))
    # stored, its size is known: a small table is broadcast and the cells stay where they are
    hot = scratch.store(cells.groupBy("shard").agg(F.ceil(F.count("*") / HOT).cast("int").alias("salts")).where("salts > 1"))
    salts = F.coalesce("salts", F.lit(1))
    salt = F.pmod(F.xxhash64(*KEY, F.floor(F.col("cell") / CELL)), salts).cast("int")
    dealt = cells.join(hot, "shard", "left").select(*KEY, F.struct("shard", "cell", "own", salts.alias("salts"), salt.alias("salt")).alias("c"))
    return dealt.groupBy(*KEY).agg(F.collect_list("c").alias("cells"))


def _located(documents: DataFrame, scratch: Scratch, window: int, gram: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is known of each document (doc_id, key, twin, n_words, whole: digest of all words), the distinct texts that may lose words (key, twin, text), and spans of words to remove."""
    docs = _keyed(documents)
    seen = stored(docs.mapInArrow(_anchors(window, gram), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, twin long, n_words long, whole string, anchors array<long>, places array<int>"))
    each = seen.where(F.size("anchors") > 0).select(*KEY, F.explode(F.arrays_zip("anchors", "places")).alias("x")).select(*KEY, F.col("x.anchors").alias("anchor"), F.col("x.places").alias("place"))
    recurring = scratch.store(each.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    places = each.join(recurring, "anchor").groupBy(*KEY).agg(F.collect_set("place").alias("places"))
    # copies meet once a partition before they are shuffled, and only texts with a recurring anchor are written
    texts = docs.groupBy(*KEY).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    texts = scratch.bucketed(texts.join(places, KEY), *KEY)
    windows = scratch.store(texts.mapInArrow(_windows(window, gram), "key long, twin long, copies long, start int, hash long, check int"))
    pieces = texts.join(_routes(windows, scratch), KEY).mapInArrow(_pieces(window), "shard long, salt int, stretch boolean, key long, twin long, begin int, words string")
    shards = pieces.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "stretch")
    spans = shards.mapInArrow(_locate(window), "key long, twin long, begin int, end int").groupBy(*KEY).agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    return seen, texts, spans


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with spans -> number of removed words and what is kept."""
    for batch in batches:
        removed, kept = [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            w = text.encode().split()
            drop = np.zeros(len(w), bool)
            for s in spans:
                drop[s["begin"] : s["end"]] = True
            removed.append(int(drop.sum()))
            kept.append(b" ".join(x for x, gone in zip(w, drop.tolist()) if not gone).decode())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[*KEY, "n_removed", "kept"])


def _shortened(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(key, twin, n_removed, kept) of the texts that lose words."""
    return texts.join(spans, KEY).select(*KEY, "text", "spans").mapInArrow(_removed, "key long, twin long, n_removed long, kept string")


def digests(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    scratch = Scratch(documents.sparkSession)
    seen, texts, spans = _located(documents, scratch, window, gram)
    lost = stored(_shortened(texts, spans).select(*KEY, "n_removed", F.sha2("kept", 256).alias("kept")))
    scratch.clear()
    joined = seen.select("doc_id", *KEY, "n_words", "whole").join(lost, KEY, "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", "whole").alias("kept_sha256"))


def without_repeats(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The documents (all columns); texts that repeat lose the covered words, others stay as they are."""
    scratch = Scratch(documents.sparkSession)
    _, texts, spans = _located(documents, scratch, window, gram)
    k, t, kept = fresh(documents, *KEY, "kept")
    lost = stored(_shortened(texts, spans).select(F.col("key").alias(k), F.col("twin").alias(t), F.col("kept").alias(kept)))
    scratch.clear()
    text = F.coalesce("text", F.lit(""))
    joined = documents.join(lost, (F.xxhash64(text) == F.col(k)) & (F.xxhash64(text, F.lit("twin")) == F.col(t)), "left")
    return joined.withColumn("text", F.coalesce(kept, "text")).select(*(F.col(f"`{c}`") for c in documents.columns))
