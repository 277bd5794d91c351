"""Personal data by fixed expressions and bootstrapped contextual extraction (DataFrame functions only).

Fixed expressions find e-mail addresses, IP addresses, card and phone numbers; they are the seeds.
The words around each seed and around each other identifier-like token (letters, digits and
joiners, with four digits or more) give lexical patterns: the last two words of the `BEFORE` code points before it, and the
last of these with the first word of the `AFTER` code points behind it (a bound of the pattern, not of the text). Patterns and instances form a
graph that is scored in rounds: a pattern's confidence is the mean confidence of the distinct
instances seen in it, an instance's is that of its best confident pattern, seeds stay at one.
Identifiers that stand in a confident pattern are added as spans of kind `context`.

The graph has one edge per distinct (pattern, instance), counted with map-side combining; only short
strings are shuffled, never texts.

Offsets come from running sums in log-many steps and contexts from chunks of the text, so a text of any number of
identifiers takes time in proportion (but for a logarithm).

Offsets are code points, ends exclusive. Cases: null and empty texts have no spans; repeated rows are
returned each (their context counts once, since instances are distinct); no documents give no
rows; other columns are ignored or kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm._shared import between, chunks, cut, fresh, running, stored

#: The base kinds in their order, each as an expression that cannot backtrack.
#: They find what the plain forms find leftmost without overlap: `\G` lets an e-mail begin where the
#: last one ended, and the looks behind keep a number from beginning inside another.
KINDS = ("email", "ip", "card", "phone")
CONTEXT = "context"
_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"[A-Za-z0-9](?<![A-Za-z0-9._/+@-][A-Za-z0-9])(?:(?<=[0-9])|(?=[A-Za-z._/+@-]*+[0-9]))[A-Za-z0-9_/+@-]*+(?:\.[A-Za-z0-9_/+@-]++)*+"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

#: Code points before and after a span in which its lexical patterns are sought.
BEFORE, AFTER = 48, 32
ROUNDS = 3
CONFIDENT = 0.8
SUPPORT = 3
_SPAN = "array<struct<begin:long,end:long,hit:string>>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _hits(text: Column, pattern: str, possible: Column) -> Column:
    """All matches of an expression, sought only where they are possible."""
    return F.when(possible, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _placed(docs: DataFrame, text: Column, patterns: dict[str, str]) -> DataFrame:
    """Puts the spans of all matches in place of the matches: what lies between them is measured by splitting, and the lengths are summed."""
    some = {k: F.size(k) > 0 for k in patterns}
    long = F.array().cast("array<long>")

    def lengths(k, p):
        gaps = F.slice(F.transform(F.split(text, p, -1), lambda x: F.length(x).cast("long")), 1, F.size(k))
        return F.when(some[k], F.zip_with(k, gaps, lambda h, g: g + F.length(h))).otherwise(long)

    def spans(k):
        return F.zip_with(k, f"{k}_ends", lambda h, e: F.struct((e - F.length(h)).alias("begin"), e.alias("end"), h.alias("hit")))

    docs = docs.select("*", *(lengths(k, p).alias(f"{k}_lengths") for k, p in patterns.items()))
    docs = docs.select("*", *(F.when(some[k], running(F.col(f"{k}_lengths"))).otherwise(long).alias(f"{k}_ends") for k in patterns))
    return docs.select("doc_id", "key", "text", *(F.when(some[k], spans(k)).otherwise(_none()).alias(k) for k in patterns))


def _none() -> Column:
    return F.array().cast(_SPAN)


_PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "tokens": TOKEN}


def _spanned(docs: DataFrame) -> DataFrame:
    """Adds the spans of each kind and of identifier-like tokens to (doc_id, key, text).

    Matches come first, in a projection of their own; most texts have none and go no further.
    """
    text = F.col("text")
    number = text.rlike("[0-9]")
    need = {"email": F.contains(text, F.lit("@")), "ip": number, "card": number, "phone": F.contains(text, F.lit("+")), "tokens": number}
    docs = _placed(docs.select("*", *(_hits(text, p, need[k]).alias(k) for k, p in _PATTERNS.items())), text, _PATTERNS)
    return docs.select(
        "doc_id", "key", "text", "email",
        F.filter("ip", lambda s: s.hit.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")).alias("ip"),
        F.filter("card", lambda s: F.call_function("luhn_check", _digits(s.hit))).alias("card"),
        F.filter("phone", lambda s: F.length(_digits(s.hit)).between(9, 15)).alias("phone"),
        F.filter("tokens", lambda s: (F.length(s.hit) >= 6) & (F.length(_digits(s.hit)) >= 4)).alias("tokens"),
    )


def _context(pieces: Column, s: Column) -> Column:
    """Lexical patterns of a span: the two words before it, and the words next to it, from what lies BEFORE and AFTER it."""
    before = F.regexp_extract_all(F.lower(between(pieces, F.greatest(s.begin - BEFORE, F.lit(0)), s.begin)), F.lit(r"[\p{L}_:=]+"), F.lit(0))
    after = F.regexp_extract(F.lower(between(pieces, s.end, s.end + AFTER)), r"[\p{L}_]+", 0)

    def patterns(w):
        last = F.element_at(w, -1)
        return F.when(F.size(w) >= 2, F.array(F.concat_ws(" ", F.element_at(w, -2), last, F.lit("_")), F.concat_ws(" ", last, F.lit("_"), after))).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(before), patterns)[0]


def _apart(docs: DataFrame) -> DataFrame:
    """Adds `free`, the tokens that overlap no base span, by two running extremes over all of them in order."""
    events = F.sort_array(F.concat(
        F.transform("base", lambda s: F.struct(s.begin.alias("begin"), s.end.alias("end"), F.lit(False).alias("token"), s.hit.alias("hit"))),
        F.transform("tokens", lambda s: F.struct(s.begin.alias("begin"), s.end.alias("end"), F.lit(True).alias("token"), s.hit.alias("hit"))),
    ))
    mixed = (F.size("base") > 0) & (F.size("tokens") > 0)
    docs = docs.withColumn("events", F.when(mixed, events))
    reached = running(F.transform("events", lambda e: F.when(e.token, F.lit(0).cast("long")).otherwise(e.end)), F.greatest)
    coming = running(F.transform("events", lambda e: F.when(e.token, F.lit(1 << 62)).otherwise(e.begin)), F.least, back=True)
    docs = docs.withColumns({"reached": F.when(mixed, reached), "coming": F.when(mixed, coming)})
    alone = F.filter(F.arrays_zip("events", "reached", "coming"), lambda z: z.events.token & (z.reached <= z.events.begin) & (z.coming >= z.events.end))
    free = F.transform(alone, lambda z: F.struct(z.events.begin.alias("begin"), z.events.end.alias("end"), z.events.hit.alias("hit")))
    return docs.withColumn("free", F.when(mixed, free).otherwise(F.col("tokens")))


def _examined(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, key (a hash of the text), spans by kind and occurrences with their patterns."""
    text = F.coalesce("text", F.lit(""))
    docs = documents.select("doc_id", F.xxhash64(text).alias("key"), text.alias("text"))
    docs = _apart(_spanned(docs).withColumn("base", F.concat(*KINDS)))
    docs = docs.withColumn("pieces", F.when((F.size("base") > 0) | (F.size("free") > 0), chunks(F.col("text"))))

    def seen(spans, seed):
        return F.transform(spans, lambda s: F.struct(s.begin.alias("begin"), s.end.alias("end"), F.lower(s.hit).alias("instance"), F.lit(seed).alias("seed"), _context(F.col("pieces"), s).alias("patterns")))

    bare = [F.transform(k, lambda s: F.struct(s.begin.alias("begin"), s.end.alias("end"))).alias(k) for k in KINDS]
    return docs.select("doc_id", "key", *bare, F.concat(seen("base", True), seen("free", False)).alias("occurrences"))


def confident_patterns(examined: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT, support: int = SUPPORT) -> DataFrame:
    """(pattern, confidence) of the patterns to trust after `rounds` of scoring the pattern-instance graph."""
    each = examined.select(F.explode("occurrences").alias("o")).select("o.instance", "o.seed", F.explode("o.patterns").alias("pattern"))
    edges = cut(each.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    seeds = edges.groupBy("instance").agg(F.max("seed").alias("seed"))
    instances = seeds.select("instance", F.col("seed").cast("double").alias("c"))
    patterns = None
    for _ in range(rounds):
        scored = edges.join(instances, "instance").groupBy("pattern").agg(F.avg("c").alias("confidence"), F.sum("c").alias("known"))
        patterns = cut(scored.where((F.col("confidence") >= confident) & (F.col("known") >= support)).select("pattern", "confidence"))
        best = edges.where("not seed").join(patterns, "pattern").groupBy("instance").agg(F.max("confidence").alias("b"))
        instances = seeds.join(best, "instance", "left").select("instance", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("b", F.lit(0.0))).alias("c"))
    return patterns


def _discovered(examined: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, key) -> context spans, for the texts that have any; equal texts of one id are one."""
    free = examined.select("doc_id", "key", F.explode(F.filter("occurrences", lambda o: ~o.seed)).alias("o")).select("doc_id", "key", "o.begin", "o.end", F.explode("o.patterns").alias("pattern"))
    found = free.join(patterns.select("pattern"), "pattern").select(F.col("doc_id").alias("d"), F.col("key").alias("k"), F.struct("begin", "end").alias("s"))
    return found.groupBy("d", "k").agg(F.sort_array(F.collect_set("s")).alias(CONTEXT))


def find(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, key, and the sorted spans of each kind, `context` last."""
    examined = stored(_examined(documents))
    found = _discovered(examined, confident_patterns(examined))
    joined = examined.drop("occurrences").join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    return joined.select("doc_id", "key", *KINDS, F.coalesce(CONTEXT, F.array().cast("array<struct<begin:long,end:long>>")).alias(CONTEXT))


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans."""

    def one(kind):
        return F.transform(kind, lambda s: F.concat(F.lit(f"{kind}:"), s.begin.cast("string"), F.lit(":"), s.end.cast("string")))

    def said(kinds):
        return F.array_join(F.concat(*map(one, kinds)), ",")

    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(said(KINDS), 256).alias("base_sha256"), said((*KINDS, CONTEXT)).alias("spans"))


def redact(documents: DataFrame) -> DataFrame:
    """The documents (all columns) with every span replaced by `<KIND>`; n_chars, if there, follows the text.

    Texts without digit, @ and + have no spans and go past the join.
    """
    row_key, spans, d, k, reached, pieces = fresh(documents, "row_key", "spans", "span_doc", "span_key", "reached", "pieces")
    found = find(documents)

    def marked(kind):
        return F.transform(kind, lambda s: F.struct(s.begin.alias("begin"), s.end.alias("end"), F.lit(f"<{kind.upper()}>").alias("mark")))

    every = F.concat(*map(marked, (*KINDS, CONTEXT)))
    marks = found.select(F.col("doc_id").alias(d), F.col("key").alias(k), F.sort_array(every).alias(spans)).where(F.size(spans) > 0)
    marks = stored(marks.groupBy(d, k).agg(F.first(spans).alias(spans)))
    possible = F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False))
    some = documents.where(possible).withColumn(row_key, F.xxhash64("text")).join(marks, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(row_key) == F.col(k)), "left")
    # a span's part of the new text: what stands since the furthest end before it, and its mark, if it begins there or later
    ends = running(F.transform(spans, lambda s: s.end), F.greatest)
    some = some.withColumn(reached, F.when(F.col(spans).isNotNull(), F.concat(F.array(F.lit(0).cast("long")), ends))).withColumn(pieces, F.when(F.col(spans).isNotNull(), chunks(F.col("text"))))

    def part(s, i):
        at = F.get(F.col(reached), i)
        return F.when(s.begin >= at, F.concat(between(F.col(pieces), at, s.begin), s.mark)).otherwise(F.lit(""))

    rest = between(F.col(pieces), F.element_at(reached, -1), F.length("text").cast("long"))
    new = F.concat(F.array_join(F.transform(spans, part), ""), rest)
    some = some.withColumn("text", F.when(F.col(spans).isNotNull(), new).otherwise(F.col("text")))
    if "n_chars" in documents.columns:
        some = some.withColumn("n_chars", F.when(F.col(spans).isNotNull(), F.length("text").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    columns = [F.col(f"`{c}`") for c in documents.columns]
    return documents.where(~possible).select(*columns).unionByName(some.select(*columns))
