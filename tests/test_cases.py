"""Column functions on fixed texts, with results as worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewell.functions import numbers as N
from tidewell.functions import rules as R
from tidewell.functions import text as T
from tidewell.functions import timefn as X
from tidewell.functions import url as U

CASES = []


def cases(name, doc, pairs, f, kind="string"):
    CASES.append(pytest.param(pairs, f, kind, id=name))


joined = lambda f: lambda c: F.array_join(f(c), "|")

cases("text_notes", "Notes merged with others, each once.", [("a;  b;;a", "a; b; c"), (None, "b; c"), ("c", "c; b")], lambda c: T.merge_notes(c, F.lit("b; c")))
cases("text_descriptions", "Descriptions shorter than 40 characters are none.", [("short", ""), ("x" * 50, "x" * 50), (None, "")], T.description)
cases("text_identity_tokens", "Words that tell a company.", [("The First National Bank of Ely", "first|ely"), (None, "")], joined(T.identity_tokens))
cases("text_longest_phrase", "The longest of the phrases that stand as whole words.", [("Oops. Page not found", "page not found"), ("Troops", ""), (None, "")], lambda c: T.longest_phrase(c, ("oops", "page not found")))
cases("text_recipients", "Recipients, each once; null where one is no address.", [("B@x.io, a@x.io; b@x.io", "b@x.io|a@x.io"), ("bad", None), ("", "")], joined(T.recipients))
cases("text_safe_cells", "Cells that a spreadsheet would run are quoted.", [("=1+1", "'=1+1"), (" @x", "' @x"), ("ok", "ok"), ("javascript:alert(1)", "'javascript:alert(1)"), (None, "")], T.safe_cell)
cases("url_registered_domain", "The domain below its public suffix.", [("https://a.b.co.uk/x", "b.co.uk"), ("jobs.bank.com", "bank.com"), ("localhost", "localhost")], U.registered_domain)
cases("url_site_root", "Scheme and host.", [("https://a.com/x?y", "https://a.com/"), ("b.org", "https://b.org/")], U.site_root)
cases("url_disallowed", "Documents, listings and sites that are no company's own.", [("https://www.yelp.com/x", True), ("https://bank.com/a.PDF", True), ("https://bank.com/reviews", True), ("https://bank.com", False)], U.disallowed, "boolean")
cases("url_safe_link", "Links that a mail may hold.", [("https://a.b/c", "https://a.b/c"), ("javascript:x", ""), (None, "")], U.safe_link)
cases("time_clock", "HH:MM as a clock shows it.", [("07:30", True), ("24:00", False), ("7:30", False), (None, False)], X.is_clock, "boolean")
cases("time_elapsed", "Seconds to a fixed end, never below 0.", [("2024-01-01T00:00:00Z", 2.34), ("2025-01-01T00:00:00Z", 0.0), ("x", 0.0)], lambda c: X.elapsed_seconds(c, F.lit("2024-01-01T00:00:02.345Z")), "double")
cases(
    "time_posted", "A posting's free date text.", [("2024-01-02", "2024-01-02"), ("Aug 17, 2026", "2026-08-17"), ("on 1/3/2024", "2024-01-03"), ("3 days ago", "2024-01-02"), ("whenever", None)],
    lambda c: F.date_format(X.posted(c, F.lit("2024-01-05 15:00:00").cast("timestamp")), "yyyy-MM-dd"),
)
cases("time_suppressed", "Switched on after today's time: today counts as done.", [("07:00", "2024-01-05"), ("09:00", "")], lambda c: X.suppressed_on_enable(F.lit("2024-01-05 15:00:00").cast("timestamp"), F.lit("America/Denver"), c))
cases("number_confidence", "Confidence words and numbers.", [("High", 90), ("medium", 65), ("LOW", 35), ("77", 77), ("?", 0), (None, 0)], N.confidence, "bigint")
cases("number_strict", "Numbers as they are written.", [("1,250.5", 1250.5), ("abc", None), (None, None)], N.number, "double")
cases("work_types", "Remote, hybrid or on site.", [("Hybrid or remote", "Remote"), ("On-site", "Onsite"), ("x", "Not Listed"), (None, "Not Listed")], R.work_type)


@pytest.mark.parametrize("pairs, f, kind", CASES)
def test_case(spark, pairs, f, kind):
    df = spark.createDataFrame([(k, None if x is None else str(x)) for k, (x, _) in enumerate(pairs)], "k int, x string")
    got = [r[0] for r in df.orderBy("k").select(f(F.col("x")).cast(kind)).collect()]
    assert got == [want for _, want in pairs]


def test_pay_is_worked_out_once(spark):
    """The plan of the pay cases holds each pay pattern once, not once for every field and place that reads it."""
    from tidewell.functions import rules as R
    from tidewell.plans.registry import QUERIES

    plan = QUERIES["pay_bounds"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert plan.count(R.PAY_SIGNED) == 1 and plan.count(R.PAY_NAMED) == 1
