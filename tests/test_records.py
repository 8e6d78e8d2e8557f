"""States, posting URLs and generic boards by hand; changes of records on tables of odd rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import rules as R
from tidewell.functions import status as S
from tidewell.functions import url as U
from tidewell.operators import records as K
from tidewell.plans import records
from tidewell.sources import generic


def each(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_every_id_key_and_anchor(spark):
    keys = [f"https://x.com/a?{k.upper()}=Ab-{i}&z=1" for i, k in enumerate(U.ID_KEYS)]
    assert each(spark, U.requisition, keys) == [f"Ab-{i}" for i in range(len(keys))]
    anchors = [f"https://x.com/{a}/req-{i}" for i, a in enumerate(U.ID_ANCHORS)]
    assert each(spark, U.requisition, anchors) == [f"req-{i}" for i in range(len(anchors))]
    assert each(spark, U.requisition, ["https://x.com/a?gh_jid=1", "https://x.com/a?jid=1", "https://x.com/a?posting=1", "https://x.com/jobs/jobs/12", "https://x.com/about/12", None]) == ["", "", "", "12", "", ""]
    assert each(spark, U.posting_slug, ["https://x.com/careers/commercial-lender", "https://x.com/careers/teller-1", "https://x.com/careers/teller", "https://x.com/careers/join-us"]) == ["commercial-lender", "", "", ""]


def test_vendor_shapes_and_boards(spark):
    good = {
        "greenhouse.io": "https://boards.greenhouse.io/a/jobs/1", "lever.co": "https://jobs.lever.co/a/0a1b2c3d-0000-1111-2222-333344445555", "csod.com": "https://a.csod.com/ux/requisition/9", "saashr.com": "https://x.saashr.com/ta/a",
        "workforcenow.adp.com": "https://workforcenow.adp.com/x?JOBID=3", "smartrecruiters.com": "https://jobs.smartrecruiters.com/A/123456789",
    }
    assert each(spark, U.detail_vendor, list(good.values())) == list(good)
    assert each(spark, U.detail_vendor, ["boards.greenhouse.io/a/jobs/1", "https://greenhouse.io/jobs/x", "https://evilgreenhouse.io/jobs/1", None]) == ["", "", "", ""]
    host = "https://jobs.dayforcehcm.com"
    assert each(spark, U.canonical_board, [f"{host}/acme/Portal/jobs/12", f"{host}/fr-CA/acme/P", f"{host}:444/acme/P", "http://jobs.dayforcehcm.com/a/b", " x ", None]) == [f"{host}/en-US/acme/Portal", f"{host}/fr-CA/acme/P", f"{host}:444/acme/P", "http://jobs.dayforcehcm.com/a/b", "x", ""]


def test_metadata_signals(spark):
    got = each(spark, R.metadata_signals, ["Location: Austin, TX", "hourly pay", "$20 per hour", "nothing", None, "Req #: 12"])
    assert got == [["labelled metadata (location)", "city/state location"], ["employment type"], ["published pay"], [], [], ["labelled metadata (req #)"]]


def test_states(spark):
    assert each(spark, S.city_state, ["Teller, Austin, TX", "none", None]) == ["Austin, TX", "", ""]
    assert each(spark, S.json_strings, ['["a", 1, "b"]', "{", None, '"a"']) == [["a", "b"], [], [], []]
    assert each(spark, lambda c: S.page_numbers(c.cast("int"), F.lit(20)), ["1", "10", "20"]) == [[1, 2, 3, 4, 20], [1, 9, 10, 11, 20], [1, 17, 18, 19, 20]]
    assert each(spark, lambda c: U.careers_context(c, F.lit(""), F.lit("Join our team")), ["https://x.com/careers/", "https://x.com/a"]) == ['careers URL segment ("careers")', 'careers page title ("Join our team")']


LIST = """<html><title>Careers</title><body><nav><a href="/careers/old-role">Old Role Manager</a></nav><h2>Current Openings</h2><ul>
<li><a href="/careers/loan-officer">Loan Officer</a> Austin, TX Full-time</li><li><a href="/careers/loan-officer">Loan Officer</a></li><li><a href="/files/teller.pdf">Bank Teller</a></li></ul>
<h2>About</h2><p><a href="/careers/how-to-apply">How To Apply Guide</a></p></body></html>"""
ITEM = """<script type="application/ld+json">{"@type":"JobPosting","title":"Branch Manager","url":"https://b.com/jobs/7","jobLocation":{"address":{"addressLocality":"Ely","addressRegion":"MN"}}}</script><a href="/jobs/8">Teller II</a>"""


def test_generic_board(spark):
    pages = spark.createDataFrame([(1, "https://b.com/work", LIST), (2, "https://b.com/jobs", ITEM), (3, "https://b.com/x", "<p>There are no open positions.</p>"), (4, "https://b.com/y", None), (5, "https://b.com/z", "Page not found")], "page_id bigint, url string, html string")
    found = generic.candidates(pages)
    rows = {(r.page_id, r.ord): (r.title, r.accepted, r.reason, r.location) for r in found.collect()}
    assert rows[1, 0][1:3] == (False, "inside <nav> site chrome")
    assert rows[1, 1] == ("Loan Officer", True, "job list with posting metadata", "Loan Officer Austin, TX") and rows[1, 2][1:3] == (False, "duplicate job URL")
    assert rows[1, 3][1:3] == (True, "job description document") and not rows[1, 4][1]
    assert rows[2, None] == ("Branch Manager", True, "structured posting data", "Ely, MN") and (2, 0) not in rows
    doubt = {r.page_id: (r.saved, r.doubt) for r in generic.verdicts(pages, found).collect()}
    assert doubt[1] == (2, "") and doubt[3] == (0, "") and "no recognizable job-list" in doubt[4][1] and "error/placeholder" in doubt[5][1]


def test_changes_on_empty_tables(spark):
    companies = spark.createDataFrame([], "id string, name string, normalizedName string, createdAt string, companyDescription string, officialWebsite string, careersPageUrl string, jobBoardUrl string, websiteVerified boolean, jobBoardDiscoveryMethod string, searchStatus string, lastChecked string")
    new = spark.createDataFrame([("a", " First  Bank ", "", None, "1"), ("b", "first bank", "", "x", "2"), ("c", None, "", "", "3")], "id string, name string, companyWebsite string, jobBoardUrl string, createdAt string")
    got = {r.id: (r.outcome, r.duplicateOf, r.jobBoardDiscoveryMethod) for r in K.create(companies, new).collect()}
    assert got == {"a": ("created", None, "Not Found"), "b": ("duplicate", "a", "Manual"), "c": ("invalid", None, "Not Found")}
    assert K.update(companies, new.withColumns({"companyDescription": F.lit(""), **{c: F.lit("") for c in K.URLS}})).count() == 0
    assert K.facet_totals(spark.createDataFrame([], "b string, s string, n bigint"), "b", "s", "n").count() == 0


def test_facet_options_are_summed_once(spark):
    """Line items go to the operator as they are: its two aggregates and the orders with a large item are all there is to hold."""
    df = records.facet_totals(spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 3
