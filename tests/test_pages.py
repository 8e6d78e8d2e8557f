"""JSON-LD of any depth, values assigned in scripts, and feeds: declared, well-known, broken."""

from __future__ import annotations

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.functions import pages as P
from tidewell.sources import feeds


def nest(depth, kind):
    value = {"@type": kind, "title": f"T{depth}"}
    for k in range(depth):
        value = [[value], {"@graph": [value]}, {"itemListElement": [{"@type": "ListItem", "item": value}]}, {"@graph": value}][k % 4]
    return value


def test_postings_of_any_depth(spark):
    texts = [json.dumps(nest(d, k)) for d, k in ((0, "JobPosting"), (4, "Job Posting"), (12, ["Thing", "JobPosting"]), (300, "https://schema.org/JobPosting"))]
    texts += ['{"@graph": {"@graph": {"@graph": [] }}}', "{broken", "", "[" * 100_000, json.dumps([{"@type": "JobPosting", "title": "T1"}, {"@type": "Person", "item": {"@type": "JobPosting", "title": "T2"}}])]
    df = spark.createDataFrame([(k, [t]) for k, t in enumerate(texts)] + [(90, []), (91, None)], "page_id bigint, json_ld array<string>")
    got = {}
    for r in P.job_postings(df).select("page_id", F.try_variant_get("item", "$.title", "string").alias("t")).collect():
        got.setdefault(r.page_id, []).append(r.t)
    assert got == {0: ["T0"], 1: ["T4"], 2: ["T12"], 3: ["T300"], 8: ["T1", "T2"]}


@pytest.mark.parametrize(
    "script, want",
    [
        ('x; window.pageData = {"a": [1, {"b": "}]"}], "c": "say \\"{\\" "}; run({});', {"a": [1, {"b": "}]"}], "c": 'say "{" '}),
        ("window.pageData=[1, 2, [3]] ; var y = {", [1, 2, [3]]), ('window.pageData = "a \\\\ { b";', "a \\ { b"), ("window.pageData = -1.5e3;", -1500.0), ("window.pageData = true && x", True),
        ('window.pageData = {"a": 1', None), ('window.pageData = {"a": "b', None), ("window.pageData = {a: 1};", None), ("window.pageData = call({});", None), ("other = {}", None), ("", None), (None, None),
        ('window.pageData = {"first": 1}; window.pageData = {"second": 2};', {"first": 1}), ('window.pageData = {"deep": ' + "[" * 200 + "]" * 200 + "}", {"deep": eval("[" * 90 + "]" * 90)}),
    ],
)
def test_assigned_values(spark, script, want):
    if want and isinstance(want, dict) and "deep" in want:
        want = {"deep": json.loads("[" * 200 + "]" * 200)}
    df = spark.createDataFrame([(script,)], "s string").select(F.to_json(P.assigned_json("s", r"window\.pageData\s*=\s*")).alias("v"))
    got = df.first().v
    assert (json.loads(got) if got is not None else None) == want


RSS = '<?xml version="1.0"?><rss version="2.0"><channel><title>Jobs</title><item><title>Teller</title></item></channel></rss>'
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><title>Jobs</title><entry><title>Cook</title><id>1</id></entry></feed>'


def test_feeds(spark):
    link = lambda href, kind="application/rss+xml", rel="alternate": f'<link rel="{rel}" type="{kind}" href="{href}">'
    pages = [
        (1, "a", 0, "https://a.com/x", link("/f1") + link("/f2", "application/atom+xml", "Home Alternate")), (2, "a", 1, "https://a.com/careers", link("/f3")), (3, "b", 0, "https://b.com", link("/f", "text/html")),
        (4, "c", 0, "https://c.com/?q=1", link("/rss")), (5, "d", 0, None, None), (6, "e", 0, "https://e.com", link("/f")),
    ]
    bodies = [("https://a.com/f1", RSS[:-20]), ("https://a.com/f2", ATOM), ("https://a.com/f3", RSS), ("https://b.com/jobs/rss", RSS), ("https://b.com/rss.xml", "<html><body>no feed</body></html>"), ("https://c.com/rss", ""), ("https://c.com/careers/feed", '<rss version="2.0"><channel><title>Empty</title></channel></rss>'), ("https://e.com/f", None), ("https://e.com/feed", "<rss></rss>")]
    df = spark.createDataFrame(pages, "page_id bigint, site string, n int, url string, html string")
    landed = spark.createDataFrame(bodies, "url string, body string")
    got = {r.site: (r.url, r.found, r.tried) for r in feeds.find(df, landed, "site", "n").collect()}
    assert got == {"a": ("https://a.com/f2", True, 12), "b": ("https://b.com/jobs/rss", True, 9), "c": ("https://c.com/careers/feed", True, 9), "d": ("", False, 0), "e": ("", False, 10)}
    order = [r.url for r in feeds.candidates(df, "site", "n").where("site = 'a'").orderBy("ord").collect()]
    assert order[:4] == ["https://a.com/f1", "https://a.com/f2", "https://a.com/f3", "https://a.com/feed"] and len(order) == 12


def test_few_pages_are_held_at_once():
    """A batch of any size is parsed a few pages at a time, all of them and in order."""
    given = [pa.RecordBatch.from_pydict({"page_id": list(range(at, at + n))}) for at, n in ((0, 1000), (1000, 1), (1001, 0), (1001, 64))]
    got = list(P.few(iter(given)))
    assert max(b.num_rows for b in got) <= P.PAGES_AT_ONCE
    assert [x for b in got for x in b.column(0).to_pylist()] == list(range(1065))
