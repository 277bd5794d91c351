"""Numbers, periods and values in texts, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import col, text_or_empty


def parse_number(c) -> Column:
    """A number with either thousands or decimal separators of either kind; null where there is none.

    Of two kinds the later one is decimal. Of one kind, groups of three after a first group of up to three
    are thousands (so `1,750` and `1.700` are whole), anything else is decimal (`2,5`).
    """
    s = F.regexp_replace(text_or_empty(c), r"[\s\x{A0}\x{2009}\x{202F}']", "")
    s = F.translate(s, "−–", "--")
    comma, dot = F.instr(F.reverse(s), ","), F.instr(F.reverse(s), ".")
    both = F.when(comma < dot, F.translate(s, ".", "")).otherwise(F.translate(s, ",", ""))
    both = F.translate(both, ",", ".")
    thousands = s.rlike(r"^[+-]?\d{1,3}(?:[.,]\d{3})+$")
    one = F.when(thousands, F.regexp_replace(s, "[.,]", "")).otherwise(F.translate(s, ",", "."))
    plain = F.when((comma > 0) & (dot > 0), both).otherwise(one)
    return F.when(plain.rlike(r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)$"), plain).try_cast("double")


def to_millions(value, scale) -> Column:
    """A value with a scale word or letter, in millions; without one it is taken as millions."""
    s = F.lower(F.trim(text_or_empty(scale)))
    v = col(value)
    return (
        F.when(s.isin("bn", "b", "billion", "billions", "miljard", "miljarder", "mdr", "mrd", "milliard"), v * 1000.0)
        .when(s.isin("k", "thousand", "tusen", "t"), v / 1000.0)
        .otherwise(v)
    )


def fiscal_period(c) -> Column:
    """Qn-YYYY, Hn-YYYY, FYYYYY, FY-UNKNOWN, PERIOD-UNKNOWN or UNKNOWN, from the text's first such expression."""
    low = F.lower(text_or_empty(c))

    def get(pattern, group):
        return F.regexp_extract(low, pattern, group)

    quarter, half = r"\bq([1-4])[\s\-/,]*(?:of\s+)?(20\d{2})\b", r"\bh([12])[\s\-/,]*(?:of\s+)?(20\d{2})\b"
    year = r"\b(?:fy|full[- ]year|fiscal year|hel[aå]r(?:et)?)?\s*-?(20\d{2})\b"
    return (
        F.when(get(quarter, 1) != "", F.concat(F.lit("Q"), get(quarter, 1), F.lit("-"), get(quarter, 2)))
        .when(get(half, 1) != "", F.concat(F.lit("H"), get(half, 1), F.lit("-"), get(half, 2)))
        .when(get(year, 1) != "", F.concat(F.lit("FY"), get(year, 1)))
        .when(low.rlike(r"full[- ]year|hel[aå]r|\bfy\b|fiscal year"), F.lit("FY-UNKNOWN"))
        .when(low.rlike(r"\bquarter|\bkvartal|\bhalf[- ]year|\bhalv[aå]r|\bq[1-4]\b|\bh[12]\b|\bperiod"), F.lit("PERIOD-UNKNOWN"))
        .otherwise(F.lit("UNKNOWN"))
    )


def basis(c) -> Column:
    low = F.lower(text_or_empty(c))
    return (
        F.when(low.rlike(r"constant currenc|currency[- ]adjusted|\bcc\b|fx[- ]neutral|valutajuster"), F.lit("cc_fx"))
        .when(low.rlike(r"\borganic|organisk|like[- ]for[- ]like"), F.lit("organic"))
        .otherwise(F.lit("reported"))
    )
