"""Secret scans over a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams that any match must
contain. Documents are indexed in blocks (one Arrow slice each): for every trigram that some query
names, its postings are a bitmap over the block's documents, taken from the lower-cased bytes.
Queries intersect and unite postings, and only the candidates left are matched with the rule
itself. A rule without mandatory trigrams scans every text. Blocks hold whole documents, so
nothing is shuffled and an index is never larger than its block. Nothing of it is kept: a scan indexes all bytes again, once for
all rules, since rules change more often than a scan is repeated.

Cases: null texts count as empty and have no secrets; texts of any length are read whole, one that is longer than a block is a block of its own;
spans that begin together are in the order of the rules; repeated rows are returned each; no documents give no rows; other columns,
whatever their names, are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewire.functions import spans as T


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    check: Callable[[re.Match], bool] | None = None
    ignore_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


#: The three base kinds, in the order in which they are listed.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)

#: Public formats of issued credentials.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("url", r"://[^\s/:@]{1,64}:[^\s/:@]{1,64}@"),
)

#: Most strings that a part of an expression is spelled out into.
MOST_STRINGS = 64


# A query is True (no constraint), a trigram (bytes), or ("and" | "or", [queries]).
def _and(queries):
    queries = [q for q in queries if q is not True]
    return True if not queries else queries[0] if len(queries) == 1 else ("and", queries)


def _or(queries):
    queries = list(queries)
    return True if not queries or any(q is True for q in queries) else queries[0] if len(queries) == 1 else ("or", queries)


def _of_strings(strings: set[str]):
    def one(s: str):
        b = s.lower().encode()
        return _and(dict.fromkeys(b[i : i + 3] for i in range(len(b) - 2)))

    return _or(one(s) for s in sorted(strings))


class _Deriver:
    """Reads an expression from left to right; `open` are the strings that the latest part can be."""

    def __init__(self):
        self.open, self.found = {""}, []

    def close(self):
        self.found.append(_of_strings(self.open))
        self.open = {""}

    def extend(self, strings: set[str]):
        if len(self.open) * len(strings) > MOST_STRINGS:
            self.close()
        if len(strings) > MOST_STRINGS:
            self.found.append(_of_strings(strings))
            return
        self.open = {a + b for a in self.open for b in strings}

    def read(self, items):
        for op, arg in items:
            strings = exact([(op, arg)])
            if strings is not None:
                self.extend(strings)
                continue
            self.close()
            if op is C.SUBPATTERN:
                self.read(arg[3])
            elif op is C.BRANCH:
                self.found.append(_or(_derive(x) for x in arg[1]))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] > 0:
                self.read(arg[2])
            elif op is C.ATOMIC_GROUP:
                self.read(arg)
            self.close()


def exact(items) -> set[str] | None:
    """All strings that the items match, if they are few."""
    out = {""}
    for op, arg in items:
        if op is C.LITERAL:
            one = {chr(arg)}
        elif op is C.IN:
            one = set()
            for kind, value in arg:
                if kind is C.LITERAL:
                    one.add(chr(value))
                elif kind is C.RANGE and value[1] - value[0] < 8:
                    one |= {chr(c) for c in range(value[0], value[1] + 1)}
                else:
                    return None
        elif op is C.SUBPATTERN:
            one = exact(arg[3])
        elif op is C.BRANCH:
            parts = [exact(x) for x in arg[1]]
            one = None if None in parts else set().union(*parts)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] <= 1:
            one = exact(arg[2])
            one = None if one is None else one | ({""} if arg[0] == 0 else set())
        elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            one = {""}
        else:
            return None
        if one is None or len(out) * len(one) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in one}
    return out


def _derive(items):
    d = _Deriver()
    d.read(items)
    d.close()
    return _and(d.found)


def trigram_query(pattern: str):
    """The Boolean query of an expression; True if it has no mandatory trigrams."""
    return _derive(list(_parser.parse(pattern)))


def trigrams(query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams, query[1]))


class BlockIndex:
    """Postings of a vocabulary of trigrams over the documents of one block."""

    def __init__(self, s: T.Slice, vocabulary: dict[bytes, int], slots: np.ndarray):
        self.n, self.vocabulary = len(s), vocabulary
        self.postings = np.zeros((len(vocabulary), self.n), bool)
        if len(s.data) < 3:
            return
        low = _LOWER[s.data].astype(np.uint32)
        ids = slots[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
        at = np.flatnonzero(ids)
        text = np.searchsorted(s.offsets, at, side="right") - 1
        inside = at + 3 <= s.offsets[text + 1]
        self.postings[ids[at[inside]].astype(np.int64) - 1, text[inside]] = True

    def ask(self, query) -> np.ndarray:
        """Which documents can match."""
        if query is True:
            return np.ones(self.n, bool)
        if isinstance(query, bytes):
            return self.postings[self.vocabulary[query]]
        parts = [self.ask(q) for q in query[1]]
        return (np.logical_and if query[0] == "and" else np.logical_or).reduce(parts)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def vocabulary_of(queries) -> tuple[dict[bytes, int], np.ndarray]:
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(set(), *map(trigrams, queries))))}
    slots = np.zeros(1 << 24, np.uint8 if len(vocabulary) < 255 else np.uint16)
    for t, i in vocabulary.items():
        slots[int.from_bytes(t, "big")] = i + 1
    return vocabulary, slots


def spans_of(text: str, rule: Rule, compiled: re.Pattern) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches; failing ones are dropped and not tried again."""
    return [m.span() for m in compiled.finditer(text) if rule.check is None or rule.check(m)]


def scan(documents: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, base: tuple[str, ...] = tuple(r.kind for r in BASE)) -> DataFrame:
    """Per document: doc_id, n_<kind> of each base kind, base_sha256, spans (all kinds, by start, then kind as listed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [trigram_query(r.pattern) for r in rules]
        compiled = [r.compiled() for r in rules]
        vocabulary, slots = vocabulary_of(queries)
        for batch in batches:
            counts: list[list[int]] = [[] for _ in base]
            digests, spans = [], []
            for s in T.slices(batch.column("text")):
                index = BlockIndex(s, vocabulary, slots)
                candidate = np.stack([index.ask(q) for q in queries])
                for i in range(len(s)):
                    found = []
                    text = None
                    for k in np.flatnonzero(candidate[:, i]).tolist():
                        text = s.raw(i).decode() if text is None else text
                        found += [(a, k, b) for a, b in spans_of(text, rules[k], compiled[k])]
                    found.sort()
                    for n, kind in zip(counts, base):
                        n.append(sum(rules[k].kind == kind for _, k, _ in found))
                    said = [f"{rules[k].kind}:{a}:{b}" for a, k, b in found]
                    own = [x for x, (_, k, _) in zip(said, found) if rules[k].kind in base]
                    digests.append(hashlib.sha256(",".join(own).encode()).hexdigest())
                    spans.append(",".join(said))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(n, pa.int64()) for n in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in base), "base_sha256", "spans"],
            )

    kind = dict(documents.dtypes)["doc_id"]
    counts = ", ".join(f"n_{k} long" for k in base)
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {counts}, base_sha256 string, spans string")
