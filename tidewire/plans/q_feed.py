"""The feed run: gates, deduplication, rules, lexicon, decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions.text import alternation, fold, hits, near, tokens
from tidewire.operators import dedup, gates, matching, metrics, rules
from tidewire.operators import vocabulary as V
from tidewire.plans.press import PRESS, press
from tidewire.plans.registry import query
from tidewire.session import table
from tidewire.sources import html


def _q(pattern: str) -> str:
    """A pattern as an SQL string."""
    return "'" + pattern.replace("'", "''") + "'"


_SKIP = f"""gated AS (
  SELECT *, (regexp_matches(lower(title), {_q(gates.any_word(gates.SUBSCRIPTION_TITLE))}) OR regexp_matches(lower(title), {_q(gates.QUOTE_PREFIX)})
     OR regexp_matches(lower(title), {_q(gates.any_part(gates.ACCOUNT))}) OR regexp_matches(lower(title || ' ' || body), {_q(gates.any_part(gates.SUBSCRIPTION_TEXT))}))
     AND NOT regexp_matches(lower(title), {_q(gates.any_part(gates.REAL_NEWS))}) AS skip FROM press)"""
_NEWS = f"""(regexp_matches(lower(body), {_q(gates.QUOTE_BODY)}) OR ((regexp_matches(lower(title), {_q(gates.any_word(gates.NEWSLETTER))}) OR regexp_matches(lower(title), {_q(gates.any_word(gates.QUOTE_TITLE))}))
   AND NOT regexp_matches(lower(title), {_q(gates.any_word(gates.REPORT_TITLE))})))"""


@query(f"WITH {PRESS}, {_SKIP} SELECT doc_id, skip FROM gated")
def gate_housekeeping(spark, sf_dir):
    return gates.housekeeping(press(spark, sf_dir)).select("doc_id", "skip")


@query(f"""WITH {PRESS}, {_SKIP} SELECT doc_id, CASE WHEN regexp_matches(lower(title), {_q(gates.QUOTE_PREFIX)}) THEN 'quote' WHEN regexp_matches(lower(title), {_q(gates.any_part(gates.ACCOUNT))}) THEN 'account'
  WHEN regexp_matches(lower(title), {_q(gates.any_word(gates.SUBSCRIPTION_TITLE))}) THEN 'subscription_title' ELSE 'subscription_text' END AS reason FROM gated WHERE skip""")
def gate_reason(spark, sf_dir):
    return gates.housekeeping(press(spark, sf_dir)).where("skip").select("doc_id", F.col("skip_reason").alias("reason"))


@query(f"WITH {PRESS} SELECT doc_id, {_NEWS} AS gated FROM press")
def gate_newsletter(spark, sf_dir):
    return gates.newsletter(gates.housekeeping(press(spark, sf_dir))).select("doc_id", F.col("gate_newsletter").alias("gated"))


@query(f"WITH {PRESS}, {_SKIP} SELECT count(*) AS total, count(*) FILTER (skip) AS skipped, count(*) FILTER (NOT skip) AS kept FROM gated")
def gate_stats(spark, sf_dir):
    return gates.stats(gates.housekeeping(press(spark, sf_dir)), "skip")


@query("SELECT doc_id, lang FROM documents WHERE CAST(doc_id AS VARCHAR) IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)")
def labelled_semi(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return gates.only_labelled(d, table(spark, sf_dir, "labels"), "doc_id", "doc_id")


@query("SELECT doc_id FROM documents WHERE lower(lang) IN ('fr', 'de') OR n_chars > 20000")
def select_classes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("big", F.col("n_chars") > 20000).withColumn("tags", F.array("lang"))
    return gates.select_class(d, ["FR", "de"], ["big"], [], ["tags"]).select("doc_id")


@query(f"WITH {PRESS} SELECT doc_id FROM press WHERE NOT regexp_matches(lower(title || ' ' || body), {_q(gates.any_part(gates.SYSTEM_MAIL))}) AND length(body) >= 40")
def system_mail_filter(spark, sf_dir):
    return gates.not_system_mail(press(spark, sf_dir)).select("doc_id")


@query(f"""WITH {PRESS} SELECT doc_id, regexp_matches(lower(title || ' ' || body), {_q(alternation(V.FINANCIAL, portable=True))}) AS financial FROM press""")
def term_presence(spark, sf_dir):
    p = press(spark, sf_dir)
    x = F.concat_ws(" ", "title", "body")
    return p.select("doc_id", fold(x).rlike(alternation(V.FINANCIAL)).alias("financial"))


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)
SELECT doc_id, len(list_filter(range(1, len(w) + 1), lambda i: w[i] = 'the' AND list_contains(w[greatest(i - 3, 1):i + 3], 'with'))) > 0 AS near FROM t""")
def token_proximity(spark, sf_dir):
    """`the` within three words of `with`, in either order."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    d = table(spark, sf_dir, "documents").select("doc_id", words.alias("w"))

    def close(i):
        first = F.greatest(i - 3, F.lit(1))
        return (F.try_element_at("w", i) == "the") & F.array_contains(F.slice("w", first, i + 4 - first), "with")

    return d.select("doc_id", F.exists(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1))), close).alias("near"))


@query("SELECT doc_id, regexp_matches(lower(text), '(?:^|[^a-z0-9_åäöæøéèüïóáç])(?:the[a-z0-9_]*(?:[^a-z0-9_åäöæøéèüïóáç]+[a-z0-9_åäöæøéèüïóáç]+){0,2}?[^a-z0-9_åäöæøéèüïóáç]+with[a-z0-9_]*|with[a-z0-9_]*(?:[^a-z0-9_åäöæøéèüïóáç]+[a-z0-9_åäöæøéèüïóáç]+){0,2}?[^a-z0-9_åäöæøéèüïóáç]+the[a-z0-9_]*)') AS near FROM documents")
def stem_proximity(spark, sf_dir):
    """Words that begin with `the` and `with`, at most two words between them."""
    return table(spark, sf_dir, "documents").select("doc_id", near("text", ["the"], ["with"], 2).alias("near"))


_LEX = {
    "function_words": {"must_any": ["the", "les", "die"], "any": ["with", "for", "this", "des", "und"], "context": ["that", "are"], "exclude": ["worthless"]},
    "copula": {"any": ["is", "was", "be", "est", "sind"], "context": ["it"]},
    "insult": {"any": ["idiot", "moron", "stupid", "clown"], "context": ["you"]},
}
_RIVALS = {"function_words": ["copula", "insult"], "copula": ["function_words"]}
_TERMS = [(c, k, t) for c, ks in _LEX.items() for k, ts in ks.items() for t in ts]
_LEX_SQL = "lex(cid, kind, term) AS (VALUES " + ", ".join(f"('{c}', '{k}', '{t}')" for c, k, t in _TERMS) + ")"
_HITS = f"""{_LEX_SQL},
toks AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_åäöæøéèüïóáç]+')) AS term FROM documents),
hits AS (SELECT t.doc_id, l.cid, l.kind, l.term FROM toks t JOIN lex l USING (term))"""


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("title"), F.col("text").alias("body"))


@query(f"WITH {_HITS} SELECT * FROM hits")
def lexicon_hits(spark, sf_dir):
    return rules.lexicon_hits(_texts(spark, sf_dir), _LEX, by_tokens=True)


_SCORES = f"""{_HITS},
n AS (SELECT doc_id, cid, count(*) FILTER (kind = 'must_any') AS m, count(*) FILTER (kind = 'any') AS a, count(*) FILTER (kind = 'context') AS c, count(*) FILTER (kind = 'exclude') AS e FROM hits GROUP BY ALL),
base AS (SELECT doc_id, cid, 1.0 * a + 0.3 * c + 1.3 * least(m, 1) AS base, least(5.0, 1.0 * a + 0.3 * c + least(m, 1)) AS strength, a + least(m, 1) AS strong, a + m + c AS terms
  FROM n WHERE e = 0 AND (cid <> 'function_words' OR m > 0)),
live AS (SELECT * FROM base WHERE base > 0),
rivals(cid, rival) AS (VALUES {", ".join(f"('{c}', '{r}')" for c, rs in _RIVALS.items() for r in rs)}),
final AS (SELECT b.doc_id, b.cid, b.strong, greatest(0.0, b.base - coalesce(sum(CASE WHEN o.base > 2.0 THEN 0.28 * o.strength END), 0)) AS score, count(o.cid) AS n_rivals
  FROM live b LEFT JOIN rivals r ON r.cid = b.cid LEFT JOIN live o ON o.doc_id = b.doc_id AND o.cid = r.rival GROUP BY b.doc_id, b.cid, b.strong, b.base),
best AS (SELECT * FROM final QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, cid) = 1),
total AS (SELECT doc_id, sum(terms) AS terms FROM live GROUP BY doc_id)"""


@query(f"""WITH {_SCORES}
SELECT d.doc_id, CASE WHEN coalesce(b.score, 0) > 0 THEN b.cid ELSE 'other_corporate_update' END AS cid, round(coalesce(b.score, 0), 6) AS score,
  coalesce(b.score, 0) < 1.2 AND coalesce(t.terms, 0) <= 2 AS needs_review,
  round(CASE WHEN coalesce(b.score, 0) > 0 THEN greatest(0.20, least(0.85, 0.60 + 0.06 * least(3, b.strong) - 0.08 * least(3, b.n_rivals))) ELSE 0.20 END, 6) AS confidence
FROM documents d LEFT JOIN best b USING (doc_id) LEFT JOIN total t USING (doc_id)""")
def keyword_score(spark, sf_dir):
    out = rules.classify_lexicon(_texts(spark, sf_dir), _LEX, rules.Weights(least_competitor=2.0), competitors=_RIVALS, by_tokens=True)
    return out.select("doc_id", "cid", F.round("score", 6).alias("score"), "needs_review", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {PRESS} SELECT doc_id,
  CASE WHEN regexp_matches(lower(title || ' ' || body), {_q(V.DEBT)}) AND regexp_matches(lower(title || ' ' || body), {_q(V.CURRENCY_AMOUNT)}) THEN 'debt_bond_issue'
       WHEN regexp_matches(lower(title || ' ' || body), {_q(V.MNA_CORE)}) AND NOT regexp_matches(lower(title || ' ' || body), {_q(V.BUYBACK)}) THEN 'mna' ELSE 'none' END AS cid FROM press""")
def rules_in_priority(spark, sf_dir):
    """Two of the rules, alone, in their order."""
    x = fold(F.concat_ws(" ", "title", "body"))
    debt = x.rlike(V.DEBT) & x.rlike(V.CURRENCY_AMOUNT)
    mna = x.rlike(V.MNA_CORE) & ~x.rlike(V.BUYBACK)
    return press(spark, sf_dir).select("doc_id", F.when(debt, "debt_bond_issue").when(mna, "mna").otherwise("none").alias("cid"))


@query()
def rule_engine(spark, sf_dir):
    """All rules and the lexicon behind them."""
    return rules.classify(press(spark, sf_dir))


_LABELLED = """guess AS (SELECT l.doc_id, l.quality AS truth, CASE WHEN d.n_chars > 3000 THEN 0.9 WHEN d.n_chars > 1000 THEN 0.7 ELSE 0.4 END AS prob, (d.doc_id % 10) / 50.0 AS margin,
  d.doc_id % 3 = 0 AS locked, d.lang FROM labels l JOIN documents d USING (doc_id))"""


def guesses(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    prob = F.when(F.col("n_chars") > 3000, 0.9).when(F.col("n_chars") > 1000, 0.7).otherwise(0.4)
    return d.select("doc_id", F.col("quality").alias("truth"), prob.alias("prob"), ((F.col("doc_id") % 10) / 50.0).alias("margin"), (F.col("doc_id") % 3 == 0).alias("locked"), "lang")


@query(f"WITH {_LABELLED} SELECT doc_id, CASE WHEN prob >= 0.6 AND margin >= 0.05 THEN 'auto_assign' WHEN prob >= 0.6 THEN 'needs_review_margin' ELSE 'needs_review_low_sim' END AS decision FROM guess")
def decision_three_way(spark, sf_dir):
    return guesses(spark, sf_dir).select("doc_id", gates.three_way("prob", "margin", 0.6, 0.05).alias("decision"))


@query(f"""WITH {_LABELLED} SELECT doc_id, CASE WHEN NOT locked AND (prob < 0.5 OR margin < 0.04) THEN 'other_corporate_update' ELSE 'q' || truth END AS cid,
  CASE WHEN NOT locked AND (prob < 0.5 OR margin < 0.04) THEN 'abstain_gate' WHEN locked THEN 'rules' ELSE 'ml' END AS decided_by FROM guess""")
def abstain_gate(spark, sf_dir):
    g = guesses(spark, sf_dir).select("doc_id", F.concat(F.lit("q"), "truth").alias("cid"), F.when(F.col("locked"), "rules").otherwise("ml").alias("decided_by"), "prob", "margin")
    return gates.abstain(g, 0.5, 0.04, require_agreement=False).select("doc_id", "cid", "decided_by")


@query(f"""WITH {_LABELLED}, r AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 'other_corporate_update' ELSE 'dividend' END AS rcid FROM guess),
f AS (SELECT *, CASE WHEN locked THEN rcid <> 'other_corporate_update' WHEN doc_id % 5 = 0 THEN false ELSE rcid <> 'other_corporate_update' AND prob >= 0.75 END AS fin FROM r)
SELECT doc_id, CASE WHEN fin THEN rcid ELSE 'mna' END AS cid, CASE WHEN fin THEN 'rules' ELSE 'ml' END AS decided_by FROM f""")
def rules_first(spark, sf_dir):
    g = guesses(spark, sf_dir).withColumn("rcid", F.when(F.col("doc_id") % 4 == 0, V.OTHER).otherwise("dividend")).withColumn("review", F.col("doc_id") % 5 == 0)
    final = gates.rules_final("rcid", "prob", "locked", "review")
    cid, by = gates.final_label("rcid", final, F.lit("mna"))
    return g.select("doc_id", cid.alias("cid"), by.alias("decided_by"))


@query(f"""WITH {PRESS}, {_SKIP},
kept AS (SELECT * FROM gated WHERE NOT skip AND NOT {_NEWS}),
one AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY lower(trim(company)), lower(trim(title)), date_trunc('day', ts) ORDER BY ts, doc_id) = 1),
cls AS (SELECT doc_id, CASE WHEN regexp_matches(lower(title || ' ' || body), {_q(V.DEBT)}) AND regexp_matches(lower(title || ' ' || body), {_q(V.CURRENCY_AMOUNT)}) THEN 'debt_bond_issue'
  WHEN regexp_matches(lower(title || ' ' || body), {_q(V.MNA_CORE)}) AND NOT regexp_matches(lower(title || ' ' || body), {_q(V.BUYBACK)}) THEN 'mna' ELSE 'other_corporate_update' END AS cid FROM one)
SELECT cid, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM cls GROUP BY cid""")
def feed_classes(spark, sf_dir):
    """Flagship: how many releases of each class remain after gates and deduplication?"""
    p = gates.newsletter(gates.housekeeping(press(spark, sf_dir))).where("NOT skip AND NOT gate_newsletter")
    p = dedup.keep_oldest(p, dedup.same_day_key("company", "title", "ts"), "ts", "doc_id")
    x = fold(F.concat_ws(" ", "title", "body"))
    cid = F.when(x.rlike(V.DEBT) & x.rlike(V.CURRENCY_AMOUNT), "debt_bond_issue").when(x.rlike(V.MNA_CORE) & ~x.rlike(V.BUYBACK), "mna").otherwise(V.OTHER)
    return metrics.shares(p.select(cid.alias("cid")), "cid")


@query("""SELECT doc_id, array_to_string(list_filter(['the', 'with', 'les', 'und', 'para'], lambda t: list_contains(regexp_extract_all(lower(text), '[a-z0-9_åäöæøéèüïóáç]+'), t)), ',') AS found FROM documents""")
def ordered_term_hits(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(hits("text", ["the", "with", "les", "und", "para"]), ",").alias("found"))


@query()
def html_pages(spark, sf_dir):
    return html.pages(table(spark, sf_dir, "pages"))


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) <> '' AS titled FROM pages""")
def html_titles(spark, sf_dir):
    return html.pages(table(spark, sf_dir, "pages")).select("page_id", F.col("title").isNotNull().alias("titled"))


@query("SELECT s_suppkey, n_name AS company FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def company_mentions(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    texts = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat(F.lit("Report from "), "n_name", F.lit(" today")).alias("text"))
    return matching.mentions(texts, nation.select(F.col("n_name").alias("name")), "s_suppkey", "text")


@query()
def company_mentions_texts(spark, sf_dir):
    """Whole texts against the nations' names and the pairs of words that all texts begin with."""
    documents = table(spark, sf_dir, "documents")
    begin = F.slice(F.array_distinct(tokens("text")), 1, 2)
    pairs = documents.where(F.size(begin) == 2).select(F.array_join(begin, " ").alias("name"))
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).unionByName(pairs).distinct()
    return matching.mentions(documents, names, "doc_id", "text")


@query("""SELECT c_custkey, 'Acme' AS company FROM customer WHERE c_custkey % 3 = 0""")
def ticker_mentions(spark, sf_dir):
    names = spark.createDataFrame([("ACM", "Acme"), ("BETA", "Beta")], "symbol string, name string")
    texts = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "shares of ACM rose").otherwise("Acm fell").alias("text"))
    return matching.tickers(texts, names, "c_custkey", "text")
