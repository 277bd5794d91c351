"""Gates and decisions: which press releases go on, and who decides their class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.text import collapse, col, strip_separators, text_or_empty

# The phrases that mark subscription mail, account mail, quote mail and real news.
SUBSCRIPTION_TITLE = (
    r"opt[-\s]?in",
    "(?:thank you|thanks).{0,30}subscrib",
    "you(?:'re| are) subscribed",
    "registered your subscription",
    "subscription (?:confirmed|confirmation)",
    "activate (?:your )?(?:release )?subscription",
    "confirm (?:your )?subscription",
    "verify (?:your )?subscription",
)
SUBSCRIPTION_TEXT = (
    "confirm(?: your| the)? (?:subscription|registration|email)",
    "verify (?:your )?(?:subscription|request)",
    "welcome(?: as)?(?: a)? subscriber",
    "subscription (?:confirmed|confirmation)",
    "activate(?: your)? (?:subscription|registration|email)",
    "manage(?: your)? subscriptions",
    "bekräfta din prenumeration",
    "verifiera din prenumeration",
    "välkommen som prenumerant",
    "bekräfta e-postadressen",
    "aktivera.*prenumeration",
    "hantera dina prenumerationer",
    "avsluta prenumeration",
    "aktiver.*(?:abonnement|release)",
    "bekræft registrering",
    "nyhedsservice",
)
ACCOUNT = ("security alert", "privacy checkup", "privacy settings", "google account", "welcome to google", "your new google account")
QUOTE_PREFIX = "^stock quote notification"
REAL_NEWS = (
    "cancels?", "announc(?:es|ed|ing)?", "enters", "agrees", "acquire", "acquisition", "appoints?", "earnings", r"q[1-4]\b",
    "interim report", "dividend", "guidance", "rights issue", "capital raise", "orders?", "contract", "partnership",
    "incident", "strike", "industrial action",
)
NEWSLETTER = (
    "newsletter", r"news\s*letter", r"weekly\s+(?:update|summary|wrap|overview|report)", r"weekly\s+summary\s+alert",
    r"week(?:ly)?\s+in\s+review", r"monthly\s+(?:update|summary|newsletter|report)", r"market\s+(?:update|summary|wrap|review)",
    r"investor\s+newsletter",
)
QUOTE_TITLE = (
    r"stock\s+quote", r"price\s+update", r"daily\s+prices?", r"closing\s+prices?", r"end\s+of\s+day\s+(?:stock|price)", r"eod\s+prices?", r"quote\s+summary",
)
QUOTE_BODY = r"(?s)(?:monday|tuesday|wednesday|thursday|friday).{0,160}?(?:opening\s+price|last\s+trade|percent\s+change|day\s+high|day\s+low|volume)"
# `first`, `second` and `third` stand alone here, so any title that has one of them counts as a report.
REPORT_TITLE = (
    r"interim\s+report", r"half[-\s]?year(?:\s+report)?", r"year[-\s]?end(?:\s+report)?", r"full[-\s]?year(?:\s+report)?", r"annual\s+report",
    r"q[1-4]\b", "first", "second", "third", r"fourth\s+quarter", r"quarterly\s+(?:report|results?)", r"results\s+(?:for|q[1-4])",
)


def any_word(patterns) -> str:
    return r"\b(?:" + "|".join(patterns) + r")\b"


def any_part(patterns) -> str:
    return "(?:" + "|".join(patterns) + ")"


def _low(c) -> Column:
    return F.lower(text_or_empty(c))


def housekeeping(df: DataFrame, title: str = "title", body: str = "body") -> DataFrame:
    """Adds title_clean, body_clean, skip and skip_reason (null where not skipped)."""
    df = df.withColumn("title_clean", strip_separators(title)).withColumn("body_clean", strip_separators(body))
    t, x = _low("title_clean"), F.lower(F.concat_ws(" ", "title_clean", "body_clean"))
    subscription_title, quote, account = t.rlike(any_word(SUBSCRIPTION_TITLE)), t.rlike(QUOTE_PREFIX), t.rlike(any_part(ACCOUNT))
    text, news = x.rlike(any_part(SUBSCRIPTION_TEXT)), t.rlike(any_part(REAL_NEWS))
    df = df.withColumn("skip", (subscription_title | quote | account | text) & ~news)
    reason = F.when(quote, "quote").when(account, "account").when(subscription_title, "subscription_title").otherwise("subscription_text")
    return df.withColumn("skip_reason", F.when(F.col("skip"), reason))


def newsletter(df: DataFrame, title: str = "title_clean", body: str = "body_clean") -> DataFrame:
    """Adds gate_newsletter: a quote table in the body, or a newsletter or quote title that names no report."""
    t = _low(title)
    looks = t.rlike(any_word(NEWSLETTER)) | t.rlike(any_word(QUOTE_TITLE))
    return df.withColumn("gate_newsletter", _low(body).rlike(QUOTE_BODY) | (looks & ~t.rlike(any_word(REPORT_TITLE))))


def stats(df: DataFrame, flag: str) -> DataFrame:
    """total, skipped and kept rows in one pass."""
    return df.agg(F.count("*").alias("total"), F.count_if(F.col(flag)).alias("skipped"), F.count_if(~F.col(flag)).alias("kept"))


def only_labelled(df: DataFrame, labels: DataFrame, key: str, label_key: str) -> DataFrame:
    """Rows whose id (as text) is labelled, one row per id."""
    ids = labels.select(F.col(label_key).cast("string").alias("_id"))
    found = df.join(ids, df[key].cast("string") == ids["_id"], "left_semi")
    first = Window.partitionBy(key).orderBy(*(F.col(c) for c in found.columns if c != key))
    return found.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def rules_final(cid, confidence, lock, needs_review, threshold: float = 0.75) -> Column:
    """Whether the rules alone decide: locked rules for any real class, else a confident class not under review."""
    c = col(cid)
    return (
        F.when(col(lock), F.coalesce(c, F.lit("")) != "other_corporate_update")
        .when(col(needs_review), False)
        .otherwise(~F.coalesce(c, F.lit("")).isin("", "other_corporate_update") & (col(confidence) >= threshold))
    )


def three_way(probability, margin, least_probability: float, least_margin: float) -> Column:
    p, m = col(probability), col(margin)
    return F.when((p >= least_probability) & (m >= least_margin), "auto_assign").when(p >= least_probability, "needs_review_margin").otherwise("needs_review_low_sim")


def abstain(df: DataFrame, least_probability: float, least_margin: float, require_agreement: bool = True) -> DataFrame:
    """Machine decisions that are unsure (or whose heads disagree) become `other`, decided by the gate."""
    unsure = (F.col("prob") < least_probability) | (F.col("margin") < least_margin)
    if require_agreement:
        unsure = unsure | ~F.col("agree")
    gate = (F.col("decided_by") == "ml") & (F.col("cid") != "other_corporate_update") & unsure
    return df.withColumns({"cid": F.when(gate, "other_corporate_update").otherwise(F.col("cid")), "decided_by": F.when(gate, "abstain_gate").otherwise(F.col("decided_by"))})


def final_label(rule_cid, rules_decide, ml_cid) -> tuple[Column, Column]:
    """(class, who decided)."""
    return F.when(col(rules_decide), col(rule_cid)).otherwise(col(ml_cid)), F.when(col(rules_decide), "rules").otherwise("ml")


def select_class(df: DataFrame, wanted: list[str], flags: list[str] = (), labels: list[str] = (), lists: list[str] = ()) -> DataFrame:
    """Rows of a class: any boolean flag, any label column equal to a wanted name, or any list column that has one."""
    names = [w.lower() for w in wanted]
    keep = F.lit(False)
    for c in flags:
        keep = keep | F.coalesce(F.col(c), F.lit(False))
    for c in labels:
        keep = keep | _low(c).isin(names)
    for c in lists:
        keep = keep | F.coalesce(F.exists(c, lambda x: F.lower(x).isin(names)), F.lit(False))
    return df.where(keep)


#: Titles and bodies of system mail.
SYSTEM_MAIL = ("undeliverable", "out of office", "automatic reply", "delivery status notification", "password reset", "verification code", "unsubscribe confirmation")


def not_system_mail(df: DataFrame, title: str = "title", body: str = "body", least_chars: int = 40) -> DataFrame:
    both = F.lower(F.concat_ws(" ", text_or_empty(title), text_or_empty(body)))
    return df.where(~both.rlike(any_part(SYSTEM_MAIL)) & (F.length(collapse(body)) >= least_chars))
