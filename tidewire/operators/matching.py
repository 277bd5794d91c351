"""Company mentions in texts: tokens block the candidates, a set ratio decides; tickers match exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.text import text_or_empty, tokens

#: Words that name no company by themselves.
GENERIC = ("ab", "publ", "asa", "as", "oyj", "oy", "plc", "ltd", "limited", "inc", "group", "holding", "holdings", "international", "global", "nordic", "technology", "technologies", "bank", "capital", "energy", "the", "and", "of")
THRESHOLD = 90
#: Parts that the texts of one word are dealt over.
SALT = 16
#: Names that travel with every task; more meet the texts in a join.
MOST_NAMES = 300_000
#: Surroundings of a word whose companies a task remembers.
_HELD = 200_000
#: Words of a name that are looked up in pairs; a word of a longer name is looked at wherever it stands.
_PAIRED = 16
#: Words of texts that are looked at together.
_STEP = 1 << 18


def set_ratio(a: Column, b: Column) -> Column:
    """Similarity 0..100 of two token arrays, the best of: common words against either whole, and the wholes against each other."""
    common = F.array_sort(F.array_intersect(a, b))
    rest = lambda x: F.concat(common, F.array_sort(F.array_except(x, common)))

    def ratio(x, y):
        s, t = F.array_join(x, " "), F.array_join(y, " ")
        n = F.length(s) + F.length(t)
        return F.when(n > 0, 100.0 * (1 - F.levenshtein(s, t) / n)).otherwise(100.0)

    some = F.size(common) > 0
    return F.greatest(F.when(some, ratio(common, rest(a))).otherwise(0.0), F.when(some, ratio(common, rest(b))).otherwise(0.0), ratio(rest(a), rest(b)))


def mentions(texts: DataFrame, companies: DataFrame, key: str, text: str, threshold: int = THRESHOLD) -> DataFrame:
    """(key, company): companies of which a text has at least half the words, in a run as long as the name, similar enough.

    A word of a text names the companies whose names are most completely there: one with the whole name goes before one with half.

    Every word of a name that is not generic is looked up, so no half of a name is missed. Up to MOST_NAMES names go to the texts, which
    are read once and not shuffled; more meet them in a join.
    """
    names = companies.select(F.col("name").alias("company"), F.array_distinct(tokens("name")).alias("words")).distinct()
    table = names.limit(MOST_NAMES + 1).toArrow()
    if table.num_rows > MOST_NAMES:
        return _joined(texts, names, key, text, threshold)
    found = _looked_up(texts, table, key, text, threshold)
    repeated = texts.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return found if repeated.isEmpty() else found.distinct()


def _looked_up(texts: DataFrame, names, key: str, text: str, threshold: int) -> DataFrame:
    """`mentions`, once for each text, of names (company, words) that travel with the tasks.

    What a run shares with a name is a part of it, so its set ratio is 100 wherever it has a word in common. A word without a second one of
    a name beside it names, wherever it stands, the same companies (`alone`), which are added to a text once; where a second one may be
    near (`met`), the run is looked at.
    """
    companies, split = names.column("company"), [set(w) for w in names.column("words").to_pylist()]
    vocabulary = sorted(set().union(*split))
    number = {w: i for i, w in enumerate(vocabulary)}
    size, words = len(vocabulary), [frozenset(map(number.get, w)) for w in split]
    own = np.array([w not in GENERIC and threshold < 100 for w in vocabulary] + [False])  # the last is that of other words
    one, two, met, lengthy = {}, {}, {}, {}
    for c, name in enumerate(words):
        for w in name:
            if own[w]:
                if len(name) <= 2:
                    (one if len(name) == 1 else two).setdefault(w, []).append(c)
                if len(name) > _PAIRED:
                    lengthy.setdefault(w, []).append(c)
                elif len(name) > 1:
                    for x in name - {w}:
                        met.setdefault(w * size + x, []).append(c)
    alone = {w: np.array(c, np.int32) for w, c in (two | one).items()}
    pairs = np.array(sorted(met), np.int64)
    long_named = np.isin(np.arange(size + 1), list(lengthy))
    longest = max(map(len, words), default=1) or 1
    reach = min(longest, _PAIRED)

    def here(run: tuple, at: int) -> tuple[bool, tuple]:
        """Whether the word at `at` names those that it names alone, and which others."""
        w = run[at]
        share = {}
        for c in {*lengthy.get(w, ())}.union(*(met.get(w * size + x, ()) for x in {*run} - {w, -1})):
            n = len(words[c])
            first = max(at + 1 - n, 0)
            share[c] = len(words[c].intersection(run[first : first + 2 * n - 1])) / n
        best = 1.0 if w in one else max(share.values(), default=0.0)
        best = max(best, 0.5)
        return w in one or best == 0.5, tuple(c for c, x in share.items() if x == best)

    def look(known: np.ndarray, ends: np.ndarray, held: dict) -> tuple[dict, dict]:
        """Of each text the words that name companies alone, and the other companies."""
        place = np.flatnonzero(own[known])
        row = np.searchsorted(ends, place, side="right") - 1
        w, begin, end = known[place], ends[row], ends[row + 1]
        near = long_named[w] | (place - begin < reach - 1)
        for d in (d for d in range(1 - reach, reach) if d and len(pairs)):
            at = place + d
            inside = (at >= begin) & (at < end)
            x = np.where(inside, known[np.where(inside, at, 0)], -1)
            pair = np.where(x < 0, -1, w * size + x)
            near |= pairs[np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)] == pair
        by_word: dict[int, set] = {}
        others: dict[int, set] = {}
        for r, x in zip(*(v.tolist() for v in np.divmod(np.unique(row[~near] * size + w[~near]), size))):
            by_word.setdefault(r, set()).add(x)
        some = np.flatnonzero(near)
        every = known.tolist()
        for i, r, low, high in zip(place[some].tolist(), row[some].tolist(), begin[some].tolist(), end[some].tolist()):
            first = max(i + 1 - longest, low)
            k = (*every[first : min(first + 2 * longest - 1, high)], i - first)
            if k not in held:
                if len(held) >= _HELD:
                    held.clear()
                is_alone, more = here(k[:-1], i - first)
                held[k] = (is_alone, more) if more else is_alone
            is_alone, more = held[k] if isinstance(held[k], tuple) else (held[k], ())
            if is_alone:
                by_word.setdefault(r, set()).add(every[i])
            if more:
                others.setdefault(r, set()).update(more)
        return by_word, others

    def run(batches):
        held: dict = {}
        named, listed = companies.combine_chunks(), pa.array(vocabulary, pa.string())
        mark = np.zeros(len(named), bool)
        for batch in batches:
            t = batch.column(1)
            values, ends = t.values, t.offsets.to_numpy().astype(np.int64)
            of, at, many, low = [], [], 0, 0
            while low < len(t):
                high = min(max(int(np.searchsorted(ends, ends[low] + _STEP, side="right")) - 1, low + 1), len(t))
                known = pc.fill_null(pc.index_in(values[ends[low] : ends[high]], value_set=listed), -1).to_numpy().astype(np.int64)
                by_word, others = look(known, ends[low : high + 1] - ends[low], held)
                for r in sorted(by_word.keys() | others.keys()):
                    for x in by_word.get(r, ()):
                        if x in alone:
                            mark[alone[x]] = True
                    mark[list(others.get(r, ()))] = True
                    found = np.flatnonzero(mark)
                    mark[found] = False
                    of.append(np.full(len(found), low + r, np.int32))
                    at.append(found)
                    many += len(found)
                    if many > 100_000:
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(of))), named.take(pa.array(np.concatenate(at)))], names=[key, "company"])
                        of, at, many = [], [], 0
                low = high
            if many:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(of))), named.take(pa.array(np.concatenate(at)))], names=[key, "company"])

    kind = dict(texts.dtypes)[key]
    return texts.select(key, tokens(text).alias("t")).mapInArrow(run, f"`{key}` {kind}, company string")


def _joined(texts: DataFrame, names: DataFrame, key: str, text: str, threshold: int) -> DataFrame:
    """`mentions` by a join that carries words only, frequent ones dealt over SALT parts; each text is then looked at once for each company it met."""
    generic = F.array(*map(F.lit, GENERIC))
    block = names.select("company", "words", F.array_except("words", generic).alias("own"))
    dealt = block.select("*", F.explode("own").alias("word")).select("*", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    each = texts.select(key, F.explode(F.array_distinct(tokens(text))).alias("word")).withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALT)).cast("int"))
    met = each.join(dealt, ["word", "salt"]).select(key, "company", "words", "own").distinct()
    both = met.join(texts.select(key, tokens(text).alias("t")), key)

    def run(i):
        return F.slice("t", F.greatest(i + 1 - F.size("words") + 1, F.lit(1)), F.size("words") * 2 - 1)

    def overlap(i):
        return F.size(F.array_intersect("words", run(i))) / F.size("words")

    def similar(i):
        return F.array_contains("own", F.get("t", i)) & (overlap(i) >= 0.5) & (set_ratio(F.col("words"), F.array_distinct(F.array_intersect(run(i), "words"))) > threshold)

    at = F.filter(F.sequence(F.lit(0), F.size("t") - 1), similar)
    found = both.select(key, "company", F.explode(F.transform(at, lambda i: F.struct(i.alias("i"), overlap(i).alias("share")))).alias("x")).select(key, "company", "x.*")
    best = F.max("share").over(Window.partitionBy(key, "i"))
    return found.withColumn("best", best).where("share = best").select(key, "company").distinct()


def tickers(texts: DataFrame, companies: DataFrame, key: str, text: str) -> DataFrame:
    """(key, company) by capital words of two to five letters that are a symbol."""
    found = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text_or_empty(text), F.lit(r"\b[A-Z]{2,5}\b"), F.lit(0)))).alias("symbol"))
    return found.join(companies.select("symbol", F.col("name").alias("company")), "symbol").select(key, "company").distinct()
