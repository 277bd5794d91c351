from pyspark.sql import functions as F

from tidewire.functions import text
from tidewire.operators import dedup, gates, rules
from tidewire.sources import html


def _press(spark, titles, body=""):
    return spark.createDataFrame([(i, t, body) for i, t in enumerate(titles)], "doc_id long, title string, body string")


def test_rules_by_title(spark):
    expected = {
        "Interim report January-June 2024": "earnings_report",
        "Company receives order worth EUR 20m from customer": "orders_contracts",
        "Invitation to presentation of the Q2 report": "earnings_report",
        "Notice of annual general meeting 2024": "agm_egm_governance",
        "Acme AB acquires Beta Ltd for EUR 40m": "mna",
        "Moody's affirms issuer rating, outlook stable": "credit_ratings",
        "John Smith appointed as CEO of the group": "personnel_management_change",
        "Company launches new product platform": "product_launch_partnership",
        "Managers' transaction in the share": "pdmr_managers_transactions",
        "Company issues bond issue of EUR 300m": "debt_bond_issue",
        "Results of phase II clinical trial presented": "rd_clinical_update",
        "First day of trading on First North": "admission_listing",
        "Company hit by ransomware cyber attack": "incidents_controversies",
        "Notification of major holdings": "legal_regulatory_compliance",
        "General corporate information": "other_corporate_update",
    }
    out = {r.doc_id: r.cid for r in rules.classify(_press(spark, list(expected))).collect()}
    assert [out[i] for i in range(len(expected))] == list(expected.values())


def test_newsletter_gate_lets_a_bare_first_through(spark):
    df = _press(spark, ["Weekly market update", "First weekly market update", "Weekly market update Q2"])
    out = {r.doc_id: r.gate_newsletter for r in gates.newsletter(gates.housekeeping(df)).collect()}
    assert out == {0: True, 1: False, 2: False}


def test_quote_table_is_gated_whatever_the_title(spark):
    df = _press(spark, ["Interim report"], "Monday opening price 10")
    assert gates.newsletter(gates.housekeeping(df)).first().gate_newsletter


def test_housekeeping_allows_news_and_counts(spark):
    df = gates.housekeeping(_press(spark, ["Please confirm your subscription", "Confirm your subscription: dividend", None]))
    assert gates.stats(df, "skip").first().asDict() == {"total": 3, "skipped": 1, "kept": 2}


def test_dedup_is_idempotent(spark):
    rows = [(1, "A", "x", "c", 1), (2, "a", "X", "c", 2), (3, "B", "y", "c", 3), (4, "B", "z", "c", 3), (5, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, title string, body string, company string, t long").withColumn("ts", F.timestamp_seconds("t"))
    once = dedup.dedup(df)
    assert sorted(r.doc_id for r in once.collect()) == sorted(r.doc_id for r in dedup.dedup(once).collect()) == [2, 3, 5]


def test_text_functions(spark):
    row = spark.range(1).select(
        text.slugify(F.lit("  Ab c!d ")).alias("slug"), text.collapse(F.lit("a  b\n")).alias("flat"), text.has_any(F.lit("The S&P index"), ["s&p"]).alias("term"),
        text.has_any(F.lit("other"), ["the"]).alias("part"), text.near(F.lit("launches a new product"), ["launch"], ["product"], 2).alias("near"), text.near(F.lit("launch one two three product"), ["launch"], ["product"], 2).alias("far"),
        text.snippet(F.lit("\n\nOne. Two")).alias("snippet"),
    ).first()
    assert (row.slug, row.flat, row.term, row.part, row.near, row.far, row.snippet) == ("ab-c-d", "a b", True, False, True, False, "One. Two")


def test_html_cascade():
    page = '<html><head><title>T</title><script type="application/ld+json">{"datePublished": "2024-01-02", "publisher": {"name": " Acme "}}</script></head><body><nav>menu</nav><div><p>Body text</p></div></body></html>'
    assert html.page_meta(page) == {"title": "T", "company_name": "Acme", "release_time_text": "2024-01-02"}
    assert html.main_text(page) == "Body text"
    assert html.page_meta('<main>September 29, 2025 08:00 ET | Source: Beta Corp | more</main>') == {"title": None, "company_name": "Beta Corp", "release_time_text": "September 29, 2025 08:00 ET"}
    assert html.main_text("") == "" and html.strip_tags("a &amp; <b>b</b><script>x</script>") == "a & b"


def test_mail_prefers_plain_text():
    raw = b'From: "Acme" <ir@acme.com>\r\nSubject: Hi\r\nContent-Type: multipart/alternative; boundary=b\r\n\r\n--b\r\nContent-Type: text/html\r\n\r\n<p>html</p>\r\n--b\r\nContent-Type: text/plain\r\n\r\nplain\r\n--b--\r\n'
    assert html.mail_body(raw)[2] == "plain"
