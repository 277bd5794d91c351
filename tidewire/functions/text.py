"""Text functions as Spark columns: normalising, tokens, term and proximity matching."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as letters of a token besides a-z and 0-9.
NORDIC = "åäöæøéèüïóáç"
TOKEN = f"[a-z0-9{NORDIC}\\-]+"
_EDGE = f"[a-z0-9_{NORDIC}]"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))


def collapse(c) -> Column:
    """White space, no-break spaces too, to single spaces; ends trimmed."""
    return F.trim(F.regexp_replace(text_or_empty(c), r"[\s\x{A0}]+", " "))


def fold(c) -> Column:
    """Curly quotes and long dashes to plain ones, lower case, collapsed white space."""
    plain = F.lower(text_or_empty(c))
    for fancy, simple in zip("‘’“”–—", "''\"\"--"):  # byte searches; translate() would look every character up
        plain = F.replace(plain, F.lit(fancy), F.lit(simple))
    return collapse(plain)


def tokens(c) -> Column:
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(TOKEN), F.lit(0))


def strip_separators(c) -> Column:
    """Runs of five or more rule characters to a space; collapsed."""
    return collapse(F.regexp_replace(text_or_empty(c), r"[-_*=]{5,}", " "))


#: Fixed value: an e-mail address within a text.
ADDRESS = r"\b[\w\.-]+@[\w\.-]+\.\w+\b"


def strip_links(c, whole_words: bool = False) -> Column:
    """Without URLs and e-mail addresses; with `whole_words` an address takes what is joined to it along."""
    bare = F.regexp_replace(text_or_empty(c), r"https?://\S+|www\.\S+", " ")
    return collapse(F.regexp_replace(bare, r"\S+@\S+\.\S+" if whole_words else f"(?U){ADDRESS}", " "))


def alternation(terms, stems: bool = False, portable: bool = False) -> str:
    """A pattern of any of the terms as whole words (`stems`: words that begin with one); no term matches nothing.

    Looking around for the words' edges is ten times as fast as matching them, but not every SQL engine can
    (`portable`).
    """
    terms = sorted({t for t in terms if t}, key=lambda t: (-len(t), t))
    if not terms:
        return "[^\\s\\S]"
    body = "|".join(re.escape(t).replace("\\ ", "\\s+").replace("\\-", "-").replace("\\'", "'").replace("\\&", "&").replace("/", "/") for t in terms)
    if portable:
        return f"(?:^|[^a-z0-9_{NORDIC}])(?:{body})" + ("" if stems else f"(?:$|[^a-z0-9_{NORDIC}])")
    return f"(?<!{_EDGE})(?:{body})" + ("" if stems else f"(?!{_EDGE})")


def has_any(c, terms, stems: bool = False) -> Column:
    """Whether the lower-cased text has any term; one compiled pattern for all of them."""
    return folded_has(F.lower(text_or_empty(c)), terms, stems)


def folded_has(c: Column, terms, stems: bool = False) -> Column:
    """The same for a text that is in lower case already."""
    return c.rlike(alternation(terms, stems))


def folded_term(c: Column, term: str) -> Column:
    """Whether a lower-case text has one term; a byte search for its first word settles most texts."""
    return c.contains(term.lower().split()[0]) & c.rlike(alternation([term.lower()]))


def hits(c, terms) -> Column:
    """The terms that the lower-cased text has, in the given order."""
    low = F.lower(text_or_empty(c))
    return F.filter(F.array(*(F.when(folded_term(low, t), F.lit(t)) for t in terms)), lambda x: x.isNotNull())


def near_pattern(left, right, words: int, stems: bool = True) -> str:
    """A pattern of a left and a right term with at most `words` words between them, in either order."""

    def group(terms):
        return "(?:" + "|".join(re.escape(t).replace("\\ ", "\\s+").replace("\\-", "-") for t in sorted(terms, key=lambda t: (-len(t), t))) + ")"

    tail = f"{_EDGE}*" if stems else ""
    gap = f"(?:[^a-z0-9_{NORDIC}]+{_EDGE}+){{0,{words}}}?[^a-z0-9_{NORDIC}]+"
    a, b = group(left) + tail, group(right) + tail
    return f"(?<!{_EDGE})(?:{a}{gap}{b}|{b}{gap}{a})"


def near(c, left, right, words: int, stems: bool = True) -> Column:
    """Whether both kinds of terms stand close; texts without one of them are settled by a plain search first."""
    return folded_near(F.lower(text_or_empty(c)), left, right, words, stems)


def folded_near(c: Column, left, right, words: int, stems: bool = True) -> Column:
    """The same for a text that is in lower case already."""
    return c.rlike(alternation(left, stems)) & c.rlike(alternation(right, stems)) & c.rlike(near_pattern(left, right, words, stems))


def slugify(c) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text_or_empty(c))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def snippet(c, most: int = 350, least: int = 40) -> Column:
    """The first paragraph with text, cut at a sentence end or space where possible."""
    first = F.trim(F.element_at(F.filter(F.split(text_or_empty(c), "\n"), lambda p: F.trim(p) != ""), 1))
    head = F.substring(first, 1, most)
    floor = max(least, int(0.6 * most))

    def last(pattern):
        return F.length(F.regexp_extract(head, f"(?s)^(.*{pattern})", 1))

    sentence, space = last("\\."), last(" ")
    end = F.when(sentence >= floor, sentence).when(space >= floor, space - 1).otherwise(F.lit(most))
    return F.coalesce(F.when(F.length(first) <= most, first).otherwise(F.substr(head, F.lit(1), end)), F.lit(""))


def first_filled(*columns) -> Column:
    """The first column that is neither null nor blank."""
    return F.coalesce(*(F.when(F.trim(text_or_empty(c)) != "", col(c)) for c in columns), F.lit(""))


#: Latin letters with marks and what is left of them without marks.
_MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


_PAIRS = tuple(zip(_MARKED, _PLAIN))


def plain_letters(text: str) -> str:
    """`unaccent` of a Python string; replaced letter by letter, which takes a twentieth of what str.translate does."""
    if not text.isascii():
        for marked, plain in _PAIRS:
            text = text.replace(marked, plain)
    return text


def plain_lower(text: str) -> str:
    """`plain_letters` in lower case; İ becomes i alone, as in SQL, and not i with a mark behind it."""
    return plain_letters(text).replace("İ", "i").lower()


def unaccent(c) -> Column:
    """Common Latin letters without their marks (ø, æ and ß are letters of their own and stay)."""
    text = text_or_empty(c)
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.translate(text, _MARKED, _PLAIN))


def dedup_key(c) -> Column:
    """The normal form that duplicates share: no marks, lower case, white space collapsed, then symbols dropped."""
    low = F.lower(unaccent(c))
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"\s+", " "), r"[^a-z0-9_ æøß\-]", ""))


def company_of_sender(c) -> Column:
    """`Name <a@b.tld>` -> Name; without a name the capitalised domain's first label."""
    name = F.trim(F.regexp_extract(text_or_empty(c), r'^\s*"?([^"<]*?)"?\s*<', 1))
    domain = F.initcap(F.regexp_extract(text_or_empty(c), r"@(?:[a-z0-9-]+\.)*?([a-z0-9-]+)\.[a-z]+>?\s*$", 1))
    return first_filled(name, domain)


def mask_company(text, company) -> Column:
    """The text without the company's name and without its first word (two letters or more), as whole words in any case."""
    name = F.trim(text_or_empty(company))
    quoted = F.regexp_replace(name, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    first = F.regexp_extract(quoted, r"^([^\s]{2,})", 1)
    either = F.when(first != "", F.concat(F.lit(r"(?i)\b(?:"), quoted, F.lit("|"), first, F.lit(r")\b"))).otherwise(F.lit(r"[^\s\S]"))
    return collapse(F.regexp_replace(text_or_empty(text), either, " "))


def passage(title, body, prefix: bool = True) -> Column:
    """A release as an embedding model reads it: `[TITLE] title`, a blank line and the body."""
    t, b = F.trim(text_or_empty(title)), F.trim(text_or_empty(body))
    said = F.when(t != "", F.concat(F.lit("[TITLE] "), t, F.lit("\n\n"), b)).otherwise(b)
    return F.concat(F.lit("passage: "), said) if prefix else said


def category_query(name, description, prefix: bool = True) -> Column:
    """A category as an embedding model reads it."""
    said = F.concat(F.lit("category: "), text_or_empty(name), F.lit(". description: "), text_or_empty(description))
    return F.concat(F.lit("query: "), said) if prefix else said


#: Legal forms that follow a company's name.
LEGAL_FORMS = (
    "a/s", "ab", "asa", "oyj", "oy", "gmbh", "ag", "sa", "sas", "bv", "nv", "plc", "ltd", "ltda", "inc", "inc.", "corp", "corp.", "co", "co.", "llc", "llp",
    "pte", "kk", "k.k.", "s.p.a.", "spa", "s.a.b.", "sarl", "s.a.r.l.", "s.r.o.", "sro", "se", "aps", "as", "a/b",
)


def mask_company_forms(text, company) -> Column:
    """The text without the company's name, however it is spaced, hyphenated or cased, and without a legal form behind it."""
    name = F.regexp_replace(F.trim(text_or_empty(company)), r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    loose = F.regexp_replace(name, r"\s+|-", r"[\\s-]+")
    forms = "|".join(re.escape(f) for f in sorted(LEGAL_FORMS, key=len, reverse=True))
    pattern = F.when(name != "", F.concat(F.lit(r"(?iU)\b"), loose, F.lit(rf"(?:,?\s+(?:{forms})(?!\w))?(?!\w)"))).otherwise(F.lit(r"[^\s\S]"))
    return collapse(F.regexp_replace(text_or_empty(text), pattern, " "))


def language_code(c) -> Column:
    """A language's code without its region where it is one that texts are kept in; none is `und`."""
    code = F.lower(F.coalesce(col(c), F.lit("und")))
    head = F.substring(code, 1, 2)
    return F.when(head.isin("sv", "fi", "da", "en"), head).otherwise(code)
