from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewell.functions import numbers as N
from tidewell.functions import rules as R
from tidewell.functions import text as T
from tidewell.functions import timefn as X
from tidewell.functions import url as U


def each(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_text(spark):
    assert each(spark, T.squash, ["  a b\t\nc ", None, ""]) == ["a b c", "", ""]
    assert each(spark, T.slug, ["First  Bank & Trust!", "--", None, "Ünï 日本"]) == ["first-bank-trust", "unknown", "unknown", "ünï-日本"]
    assert each(spark, T.job_title, ["Job Title: Teller  II", "title - x", "Title"]) == ["Teller II", "x", "Title"]
    assert each(spark, T.match_text, ["C++ & .NET/C#  dev-ops"]) == ["c++ .net c# dev-ops"]
    assert each(spark, T.identity_tokens, ["The First National Bank of Ely"]) == [["first", "ely"]]
    assert each(spark, T.meaningful_words, ["azure about azure cloud using linux"]) == [["azure", "cloud", "linux"]]
    assert each(spark, lambda c: T.merge_notes(c, F.lit("b; c")), ["a;  b;;a", None]) == ["a; b; c", "b; c"]
    assert each(spark, T.recipients, ["B@x.io, a@x.io; b@x.io", "bad", ""]) == [["b@x.io", "a@x.io"], None, []]
    assert each(spark, T.safe_cell, ["=1+1", " @x", "ok", "javascript:alert(1)", None]) == ["'=1+1", "' @x", "ok", "'javascript:alert(1)", ""]
    assert each(spark, lambda c: T.longest_phrase(c, ("oops", "page not found")), ["Oops. Page not found", "Troops", None]) == ["page not found", "", ""]
    assert each(spark, T.description, ["short", "x" * 50]) == ["", "x" * 50]
    assert [tuple(r) for r in each(spark, T.title_and_location, ["Teller - Ely Location", "Teller"])] == [("Teller", "Ely"), ("Teller", "")]


def test_numbers(spark):
    assert each(spark, N.half_even, [24.5, 31.75, 62.5, None], "double") == [24, 32, 62, None]
    assert each(spark, N.half_up, [2.5, -0.5], "double") == [3, 0]
    assert each(spark, N.money, [95000.0, 1234.5], "double") == ["95,000", "1,234.50"]
    assert each(spark, N.confidence, ["High", "medium", "LOW", "77", "?", None]) == [90, 65, 35, 77, 0, 0]
    assert each(spark, N.number, ["1,250.5", "abc", None]) == [1250.5, None, None]
    assert each(spark, N.period, ["annual", "hour", "weekly", "x"]) == ["year", "hour", "week", "unknown"]
    show = lambda lo, hi, per, cur="USD", text="": N.pay_display(F.lit(text), F.lit(lo).cast("double"), F.lit(hi).cast("double"), F.lit(per), F.lit(cur))
    row = spark.range(1).select(show(95000, 125000, "year").alias("a"), show(None, None, "").alias("b"), show(20, None, "hourly", "CAD").alias("c"), show(None, 9.5, "week").alias("d"), show(1, 2, "", text="Competitive").alias("e"), show(None, None, "", text="Not Listed").alias("f")).first()
    assert tuple(row) == ("$95,000 - $125,000 per year", "Pay not posted", "From CAD 20 per hour", "Up to $9.50", "Competitive", "Pay not posted")


def test_time(spark):
    now = F.lit("2024-01-05 15:00:00").cast("timestamp")
    due = lambda zone, at, last="", days=None: X.due(now, F.lit(zone), F.lit(at), days, F.lit(last))
    row = spark.range(1).select(due("America/Denver", "08:00").alias("a"), due("America/Denver", "08:01").alias("b"), due("America/Denver", "07:00", "2024-01-05").alias("c"), due("UTC", "07:00", "", F.array(F.lit("Mon"))).alias("d")).first()
    assert tuple(row) == (True, False, False, False)
    assert each(spark, X.is_clock, ["07:30", "24:00", "7:30", None]) == [True, False, False, False]
    assert each(spark, lambda c: X.within_days(c, 7, now), ["2024-01-01T00:00:00+00:00", "2023-01-01", "soon", None]) == [True, False, False, False]
    assert [str(x)[:10] for x in each(spark, lambda c: X.posted(c, now), ["2024-01-02", "Aug 17, 2026", "on 1/3/2024", "3 days ago", "whenever"])] == ["2024-01-02", "2026-08-17", "2024-01-03", "2024-01-02", "None"]
    assert each(spark, lambda c: X.elapsed_seconds(c, F.lit("2024-01-01T00:00:02.345Z")), ["2024-01-01T00:00:00Z", "2025-01-01T00:00:00Z", "x"]) == [2.34, 0.0, 0.0]


def test_urls(spark):
    assert each(spark, U.canonical, ["HTTPS://WWW.Ex.com:443?a=1#x", "ex.com/a", "http://ex.com:8080/", "ftp://x/y", "http://u:p@h/", "", None, "http://h:99999/"]) == ["https://www.ex.com/?a=1", "https://ex.com/a", "http://ex.com:8080/", None, None, None, None, None]
    assert each(spark, U.domain_key, ["https://www.Bank.com:8080/x", "bank.com", ""]) == ["bank.com:8080", "bank.com", ""]
    assert each(spark, U.registered_domain, ["https://a.b.co.uk/x", "jobs.bank.com", "localhost"]) == ["b.co.uk", "bank.com", "localhost"]
    assert each(spark, U.platform, ["https://x.wd5.myworkdayjobs.com/a", "https://notlever.co", "jobs.lever.co/x", ""]) == ["Workday", "", "Lever", ""]
    assert each(spark, U.disallowed, ["https://www.yelp.com/x", "https://bank.com/a.PDF", "https://bank.com/reviews", "https://bank.com"]) == [True, True, True, False]
    assert each(spark, U.requisition, ["https://x.com/a?jobId=77", "https://x.com/jobs/req-123", "https://x.com/jobs/teller"]) == ["77", "req-123", ""]
    assert each(spark, U.segments, ["https://x.com/About/History.html?x", "x.com"]) == [["about", "history"], []]
    assert each(spark, U.public_shape, ["https://bank.com", "http://127.0.0.1/", "http://localhost", "http://a:b@bank.com"]) == [True, False, False, False]
    name = spark.createDataFrame([("First Bank", "https://www.firstbank.com"), ("Ely Credit Union", "https://elycu.org"), ("Ely Bank", "https://other.com")], "n string, u string")
    assert [r[0] for r in name.select(U.matches_company("n", "u")).collect()] == [True, True, False]
    assert each(spark, lambda c: U.company_id(c, F.lit(""), F.lit("My Bank"), F.lit("CO")), ["https://www.my.bank", ""]) == ["company-my-bank", "company-my-bank-co"]


def test_crawl_stays_in_the_domain(spark):
    links = spark.createDataFrame([("http://a.com/", "http://a.com/b"), ("http://a.com/b", "http://a.com/c"), ("http://a.com/", "http://x.com/"), ("http://a.com/c", "http://a.com/d"), ("http://a.com/b", "http://a.com/")], "src string, dst string")
    seeds = spark.createDataFrame([("a", "http://a.com/")], "site string, url string")
    got = U.crawl(links, seeds, depth=2, most=3).orderBy("rank").collect()
    assert [(r.url, r.depth) for r in got] == [("http://a.com/", 0), ("http://a.com/b", 1), ("http://a.com/c", 2)]


PAY = [
    ("Salary range $80,000-$105,000 annually", (80000, 105000, "annual", "USD")), ("Pay: $24.50 to $31.75 per hour", (24, 32, "hourly", "USD")), ("Compensation USD 90k–110k per year", (90000, 110000, "annual", "USD")),
    ("Hourly rate 28 to 34 USD", (28, 34, "hourly", "USD")), ("Salary: £55,000 - £65,000 annually", (55000, 65000, "annual", "GBP")), ("We offer a 401(k) match", None), ("10 years of experience", None), ("25 percent travel", None), (None, None),
]


@pytest.mark.parametrize(("text", "want"), PAY)
def test_pay(spark, text, want):
    p = each(spark, R.pay, [text])[0]
    assert (None if p.low is None else (p.low, p.high, p.period, p.currency)) == want


def test_structured_pay(spark):
    df = spark.createDataFrame([('{"currency":"CAD","value":{"minValue":70000,"maxValue":90000,"unitText":"YEAR"}}',)], "j string")
    assert tuple(df.select(R.structured_pay(F.parse_json("j")).alias("p")).first().p) == (70000, 90000, "annual", "CAD")


def test_roles_and_titles(spark):
    cases = [("Operations Director", "", "MGR"), ("Team Lead", "direct reports", "MGR"), ("Branch Operations", "Manages a team", "MGR"), ("Security Analyst", "", "IC"), ("Chief Risk Officer", "", "EXEC"), ("", "x", "UNKNOWN"), ("Teller", "", "IC"), ("Oddity", "", "UNKNOWN")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, d string, want string")
    assert all(r.got == r.want for r in df.select("want", R.role_type("t", "d")["type"].alias("got")).collect())
    assert each(spark, R.valid_structured_title, ["CFO", "Collector", "Paralegal", "Apply Now", "2 days ago", "General Employment Application"]) == [True, True, True, False, False, False]
    assert each(spark, R.title_rejection, ["Bank Teller", "", "abc", "Careers", "Apply now today", "3 days ago", "job menu", "view more", "Zanzibar"]) == [
        "unknown", "blank title", "too short", "navigation/button label", "boilerplate text", "posted date text", "generic navigation words only", "generic navigation words only", "not enough real job title signal",
    ]


def test_destinations_and_texts(spark):
    assert each(spark, R.destination_reason, ["#top", "mailto:a@b.c", "https://www.facebook.com/x", "https://b.com/", "https://b.com/about/careers/teller-1", "https://b.com/locations", "https://b.com/x/teller", ""]) == [
        "in-page anchor, not a posting URL", "mailto: link, not a posting URL", "social/aggregator link (facebook.com)", "site root, not a posting URL", "", "branch/ATM link", "", "",
    ]
    assert each(spark, R.text_reason, ["a@b.co", "https://x", "(555) 123-4567", "Oops, page not found", "Find an ATM", "We're hiring", "Troop Manager"]) == [
        "email address, not a job title", "bare URL, not a job title", "phone number, not a job title", 'error/placeholder page text ("page not found")', 'marketing call to action ("find an atm")', "marketing sentence, not a job title", "",
    ]
    assert each(spark, R.work_type, ["Hybrid or remote", "On-site", "x", None]) == ["Remote", "Onsite", "Not Listed", "Not Listed"]
    assert each(spark, lambda c: R.work_type(c, R.WORK_TYPE_ORDER["csod"]), ["Hybrid or remote"]) == ["Hybrid"]
    assert each(spark, lambda c: R.collector(c, F.lit("UKG Ready")), ["https://x.hrmdirect.com", "https://b.com"]) == ["ClearCompany", "UKG Ready"]


def test_match(spark):
    resume = "cloud security engineer with 8 years of azure automation and powershell experience."
    df = spark.createDataFrame([("Cloud Security Engineer", "Azure cloud security automation and PowerShell", "Remote"), ("Baker", "Flour ovens morning", ""), ("", "", "")], "t string, d string, w string")
    got = [r.m for r in df.select(R.match(F.lit(resume), "t", "d", "w").alias("m")).collect()]
    assert (got[0].score, got[0].label) == (100, "Strong Match") and got[1].score == 12 and got[1].label == "Low Match" and got[2].matched == []
