"""Priority-ordered classification rules, each a Boolean column and a result, and the scored lexicon behind them.

One pass over Arrow batches gives each text's normal form, its cues and its lexicon hits; everything after it is columns of the
same row, so classifying shuffles and joins nothing. A rule that fires first decides; the chain is one `coalesce`, so later rules are
not evaluated for decided rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewire.functions.vectors import bind
from tidewire.operators import cues as C
from tidewire.operators import vocabulary as V


@dataclass(frozen=True)
class Rule:
    priority: float
    name: str
    condition: Column
    cid: str | Column
    confidence: float | Column
    lock: bool | Column


_HIT = pa.struct([("cid", pa.string()), ("kind", pa.string()), ("term", pa.string())])
_CUES = pa.struct([(n, pa.bool_()) for n in C.NAMES])
_MADE = {
    "t": (pa.string(), "string"), "x": (pa.string(), "string"), "cues": (_CUES, f"struct<{', '.join(f'{n}: boolean' for n in C.NAMES)}>"),
    "hits": (pa.list_(_HIT), "array<struct<cid: string, kind: string, term: string>>"),
}


def examined(df: DataFrame, title: str = "title", body: str = "body", cues: bool = True, lexicon: dict | None = None, by_tokens: bool = False) -> DataFrame:
    """Adds `_t` and `_x` (title, and title and body, in normal form), `_cues` and the lexicon's `_hits`, where asked for.

    `by_tokens`: texts are only put in lower case, and words end where the tokenizer ends them.
    """
    names = ["t", "x", *["cues"] * cues, *["hits"] * (lexicon is not None)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = C.Cues() if cues else None
        terms, named = C.lexicon_terms(lexicon or {}, by_tokens)
        form = C.lowered if by_tokens else C.norm
        by_bit = {bit: {"cid": cid, "kind": kind, "term": term} for bit, cid, kind, term in named}
        for batch in batches:
            titles, bodies = batch.column(title).to_pylist(), batch.column(body).to_pylist()
            made = {"t": [form(t) for t in titles], "x": [form(f"{t or ''} {b or ''}") for t, b in zip(titles, bodies)]}
            if cues:
                made["cues"] = [dict(zip(C.NAMES, of.of(t, b))) for t, b in zip(titles, bodies)]
            if lexicon is not None:
                made["hits"] = [[by_bit[bit] for bit in C.bits_of(terms.find(x))] if named else [] for x in made["x"]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(made[n], _MADE[n][0]) for n in names)], names=[*batch.schema.names, *(f"_{n}" for n in names)])

    schema = StructType(list(df.schema.fields))
    for n in names:
        schema = schema.add(f"_{n}", StructType.fromDDL(f"c {_MADE[n][1]}")["c"].dataType)
    return df.mapInArrow(run, schema)


def _rules() -> list[Rule]:
    """All rules over the columns that `examined` adds."""
    t, x = F.col("_t"), F.col("_x")
    cue = {n: F.col(f"_cues.{n}") for n in C.NAMES}
    rules = []

    def add(priority, name, condition, cid, confidence, lock=False):
        rules.append(Rule(priority, name, condition, cid, confidence, lock))

    def has(text, pattern):
        return text.rlike(f"(?U){pattern}")

    add(-100, "invitation routing", has(t, rf"\b{V.INVITE}\b.*?\b(?:{V.EARNINGS_TIME}|{V.EARNINGS_NOUNS})\b.*?\b{V.EVENT_NOUNS}\b"), "earnings_report", 0.80)
    add(-99.9, "invitation routing", has(t, rf"\b{V.MARKETS_DAY}\b") | has(t, rf"\b{V.INVESTOR_MEETING}\b"), V.OTHER, 0.80)
    add(-90, "agm notice/outcome", has(x, V.AGM_NOTICE) | has(x, V.AGM_OUTCOME), "agm_egm_governance", 0.90, True)
    add(-89.9, "agm notice/outcome", has(t, V.AGM_SHORT), "agm_egm_governance", 0.80)
    add(-80, "legal regulatory compliance events", cue["flagged"] | (cue["holding"] & has(x, V.HOLDING_PERCENT)), "legal_regulatory_compliance", 0.90, True)
    patent = has(x, V.PATENT_NUMBER)
    add(-79.9, "regulatory approval/patent", cue["approval"] | patent, "legal_regulatory_compliance", F.when(patent, 0.92).otherwise(0.90), True)
    add(-70, "agency + rating action/noun", cue["rated"], "credit_ratings", 0.90, True)
    add(-65, "MAR Article 19 / PDMR", cue["pdmr"] | cue["market_abuse"], "pdmr_managers_transactions", 0.95, True)
    add(-50, "debt security + currency/amount", has(x, V.DEBT) & has(x, V.CURRENCY_AMOUNT), "debt_bond_issue", 0.90, True)
    add(-45.1, "admission/delisting routing", cue["venue"] & has(x, V.DELISTING), "admission_delisting", 0.88)
    add(-45, "admission/delisting routing", cue["venue"] & has(x, V.LISTING), "admission_listing", 0.88)
    add(-40, "orders/contracts + context", cue["ordered"], "orders_contracts", 0.85)
    add(-35, "role + move + name", cue["moved"], "personnel_management_change", 0.90, True)
    add(-32, "mna", cue["mna"], "mna", 0.90, True)
    add(-28, "mna", has(x, V.MNA_CORE) & ~has(x, V.BUYBACK), "mna", 0.87)
    add(120.0, "hi_sig_earnings_v1", cue["earnings_title"] | cue["earnings_near"], "earnings_report", 0.85, True)
    launch = cue["launch_title"] | cue["launch_title_and_body"] | cue["launch_body"]
    sure = F.when(cue["launch_title"], 0.85).when(cue["launch_title_and_body"], 0.80).otherwise(0.78)
    add(120.1, "hi_sig_product_launch_partnership_v5", launch & ~has(x, V.LAUNCH_VETO), "product_launch_partnership", sure, True)
    add(120.2, "hi_sig_rd_clinical_update_v3", cue["clinical"] | cue["congress"], "rd_clinical_update", F.when(cue["clinical"], 0.83).otherwise(0.81))
    add(200, "recall/cyber cues", cue["recall"] | cue["cyber"], "incidents_controversies", 0.80)
    return rules


def _as_column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _first(extra: list[Rule] = ()) -> Column:
    rules = sorted([*_rules(), *extra], key=lambda r: r.priority)
    return F.coalesce(*(F.when(r.condition, F.struct(F.lit(r.name).alias("name"), _as_column(r.cid).alias("cid"), _as_column(r.confidence).cast("double").alias("confidence"), _as_column(r.lock).alias("lock"))) for r in rules))


def apply_rules(df: DataFrame, title: str = "title", body: str = "body", extra: list[Rule] = ()) -> DataFrame:
    """Adds rule: (name, cid, confidence, lock) of the first rule that fires, or null. `extra` rules take part by priority."""
    return examined(df, title, body).withColumn("rule", _first(extra)).drop("_t", "_x", "_cues")


# --- scored lexicon ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Weights:
    """Weights, penalties and thresholds of the lexicon score.

    `must_any_once`: any number of must_any hits counts once. `hard_exclude`: a class with an excluded term scores nothing.
    `by_strength`: a competitor's penalty grows with its hits (up to `hit_cap`), else each counts one; `pairs` multiplies the
    penalty of a (class, competitor).
    """

    must_all: float = 2.2
    must_any: float = 1.3
    any: float = 1.0
    context: float = 0.3
    must_any_once: bool = True
    hard_exclude: bool = True
    alpha: float = 0.28
    hit_cap: float = 5.0
    least_competitor: float = 8.0
    by_strength: bool = True
    pairs: dict[tuple[str, str], float] = field(default_factory=dict)
    boost: float = 0.5
    review_score: float = 1.2
    review_terms: int = 2


BOOSTED = {"debt_bond_issue": V.CURRENCY_AMOUNT, "capital_raise_rights_issue": V.CURRENCY_AMOUNT, "equity_actions_non_buyback": "total number of shares and votes"}


def load_lexicon(path: str) -> dict[str, dict[str, list[str]]]:
    """A lexicon from JSON: class -> terms (a list counts as `any`) or kind -> terms."""
    with open(path, encoding="utf-8") as f:
        blob = json.load(f)
    return {cid: {"any": x} if isinstance(x, list) else x for cid, x in blob.get("lexicon", blob).items() if isinstance(x, (list, dict))}


def lexicon_hits(df: DataFrame, lexicon: dict, key: str = "doc_id", title: str = "title", body: str = "body", by_tokens: bool = False) -> DataFrame:
    """(key, cid, kind, term) of every term that a text has."""
    found = examined(df.select(key, title, body), title, body, cues=False, lexicon=lexicon, by_tokens=by_tokens)
    return found.select(key, F.explode("_hits").alias("h")).select(key, "h.cid", "h.kind", "h.term")


def _scores(hits: Column, x: Column, lexicon: dict, w: Weights) -> Column:
    """Of each class with a hit that passes its gates: cid, base, strength, strong, terms. All must_all, any of must_any, none of exclude."""
    need = F.create_map(*(F.lit(v) for cid, kinds in lexicon.items() for v in (cid, len(set(map(C.norm, kinds.get("must_all", [])))))))
    gated = F.array(*(F.lit(cid) for cid, kinds in lexicon.items() if kinds.get("must_any"))).cast("array<string>")
    boosted = F.array_compact(F.array(*(F.when(x.rlike(f"(?U){p}"), F.lit(c)) for c, p in BOOSTED.items() if c in lexicon))).cast("array<string>")

    def counts(cid):
        def n(kind):
            return F.size(F.filter(hits, lambda h: (h.cid == cid) & (h.kind == kind))).cast("long")

        return F.struct(cid.alias("cid"), *(n(k).alias(k) for k in ("must_all", "must_any", "any", "context", "exclude")))

    def passes(c):
        excluded = (c["exclude"] > 0) if w.hard_exclude else F.lit(False)
        return ~excluded & (c.must_all >= need[c.cid]) & (~F.array_contains(gated, c.cid) | (c.must_any > 0))

    def score(boosts):
        def one(c):
            fired = F.least(c.must_any, F.lit(1).cast("long"))
            plain = w.must_all * c.must_all + w.any * c["any"] + w.context * c.context
            return F.struct(
                c.cid.alias("cid"),
                (plain + w.must_any * (fired if w.must_any_once else c.must_any) + F.when(F.array_contains(boosts, c.cid), w.boost).otherwise(0.0)).alias("base"),
                (F.least(F.lit(w.hit_cap), plain + fired) if w.by_strength else F.lit(1.0)).alias("strength"),
                (c["any"] + c.must_all + fired).alias("strong"), (c["any"] + c.must_all + c.must_any + c.context).alias("terms"),
            )

        return one

    of = F.transform(F.array_distinct(F.transform(hits, lambda h: h.cid)), counts)
    return F.when(F.size(hits) > 0, bind(boosted, lambda b: F.filter(F.transform(F.filter(of, passes), score(b)), lambda s: s.base > 0)))


def lexicon_scores(df: DataFrame, lexicon: dict, w: Weights = Weights(), key: str = "doc_id", title: str = "title", body: str = "body") -> DataFrame:
    """(key, cid, base, strength, strong, terms) for classes that pass their gates and score."""
    found = examined(df.select(key, title, body), title, body, cues=False, lexicon=lexicon)
    return found.select(key, F.explode(_scores(F.col("_hits"), F.col("_x"), lexicon, w)).alias("s")).select(key, "s.*")


def _decided(s: Column, w: Weights, competitors: dict) -> Column:
    """(cid, score, needs_review, confidence) from a document's class scores: the best after competitors' penalties."""
    against = F.create_map(*(x for cid, c in competitors.items() if c for x in (F.lit(cid), F.array(*map(F.lit, c)))))
    rank = F.create_map(*(x for i, c in enumerate(V.TIE_BREAK) for x in (F.lit(c), F.lit(i))))
    times = F.create_map(*(F.lit(x) for (a, b), m in w.pairs.items() for x in (f"{a}|{b}", float(m)))) if w.pairs else None

    def rivals(one):
        return F.filter(s, lambda o: F.array_contains(F.coalesce(F.try_element_at(against, one.cid), F.array().cast("array<string>")), o.cid))

    def final(one):
        def more(a, o):
            factor = F.lit(1.0) if times is None else F.coalesce(F.try_element_at(times, F.concat(one.cid, F.lit("|"), o.cid)), F.lit(1.0))
            return a + w.alpha * o.strength * factor

        penalty = F.aggregate(F.filter(rivals(one), lambda o: o.base > w.least_competitor), F.lit(0.0), more)
        return F.struct((-F.greatest(F.lit(0.0), one.base - penalty)).alias("neg"), F.coalesce(F.try_element_at(rank, one.cid), F.lit(10000)).alias("tie"), one.cid.alias("cid"), one.strong.alias("strong"), F.size(rivals(one)).alias("rivals"))

    terms = F.coalesce(F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a + x.terms), F.lit(0))

    def decision(best):
        score = F.coalesce(-best.neg, F.lit(0.0))
        confidence = F.greatest(F.lit(0.20), F.least(F.lit(0.85), 0.60 + 0.06 * F.least(F.lit(3), best.strong) - 0.08 * F.least(F.lit(3), best.rivals)))
        return F.struct(
            F.when(score > 0, best.cid).otherwise(V.OTHER).alias("cid"), score.alias("score"),
            ((score < w.review_score) & (terms <= w.review_terms)).alias("needs_review"), F.when(score > 0, confidence).otherwise(0.20).alias("confidence"),
        )

    return bind(F.when(F.size(s) > 0, F.element_at(F.array_sort(F.transform(s, final)), 1)), decision)


def classify_lexicon(df: DataFrame, lexicon: dict, w: Weights = Weights(), key: str = "doc_id", title: str = "title", body: str = "body", competitors: dict = V.COMPETITORS, by_tokens: bool = False) -> DataFrame:
    """(key, cid, score, needs_review, confidence): the best class after competitors' penalties; no class is `other`."""
    found = examined(df.select(key, title, body), title, body, cues=False, lexicon=lexicon, by_tokens=by_tokens)
    scored = found.select(key, _scores(F.col("_hits"), F.col("_x"), lexicon, w).alias("s"))
    return scored.select(key, _decided(F.col("s"), w, competitors).alias("d")).select(key, "d.*")


def classify(df: DataFrame, lexicon: dict = V.LEXICON, key: str = "doc_id", title: str = "title", body: str = "body", w: Weights = Weights()) -> DataFrame:
    """(key, rule, cid, confidence, lock, needs_review): the first rule that fires, else the lexicon."""
    found = examined(df.select(key, title, body), title, body, lexicon=lexicon).select(key, "_x", "_hits", _first().alias("rule"))
    scored = found.select(key, "rule", F.when(F.col("rule").isNull(), _scores(F.col("_hits"), F.col("_x"), lexicon, w)).alias("s"))
    decided = scored.select(key, "rule", F.when(F.col("rule").isNull(), _decided(F.col("s"), w, V.COMPETITORS)).alias("d"))
    return decided.select(
        key, F.coalesce("rule.name", F.lit("keywords+exclusions")).alias("rule"), F.coalesce("rule.cid", "d.cid").alias("cid"), F.coalesce("rule.confidence", "d.confidence").alias("confidence"),
        F.coalesce("rule.lock", F.lit(False)).alias("lock"), (F.col("rule").isNull() & F.col("d.needs_review")).alias("needs_review"),
    )
