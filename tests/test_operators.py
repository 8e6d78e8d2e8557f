from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewell.functions import pages as P
from tidewell.functions import rules as R
from tidewell.operators import diff, discovery, merge, paging, runs
from tidewell.sources import documents, workbooks
from tidewell.streaming.digest import Digest


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


# Retention: what a company's outcome does to its stored rows
CASES = [
    ({"a": "failed", "b": "success"}, {"old-a", "new-b"}), ({"a": "partial", "b": "success"}, {"old-a", "new-a", "new-b"}), ({"a": "skipped"}, {"old-a", "old-b"}), ({"a": "success"}, {"new-a", "old-b"}), ({}, {"old-a", "old-b"}),
    ({"a": "limited", "b": "disabled"}, {"old-a", "old-b"}),
]


@pytest.mark.parametrize(("outcomes", "want"), CASES)
def test_retention(spark, outcomes, want):
    schema = "id string, company_id string, ord bigint"
    old = spark.createDataFrame([("old-a", "a", 1), ("old-b", "b", 2)], schema)
    new = spark.createDataFrame([("new-a", "a", 3), ("new-b", "b", 4)], schema)
    oc = spark.createDataFrame(list(outcomes.items()), "company_id string, outcome string")
    assert {r.id for r in merge.replace_scope(old, new, oc, F.col("id"), "ord").collect()} == want


def test_empty_success_prunes(spark):
    schema = "id string, company_id string, ord bigint"
    old = spark.createDataFrame([("old-a", "a", 1), ("old-b", "b", 2)], schema)
    oc = spark.createDataFrame([("a", "success")], "company_id string, outcome string")
    assert {r.id for r in merge.replace_scope(old, old.limit(0), oc, F.col("id"), "ord").collect()} == {"old-b"}


def test_prune_archives_applied(spark):
    jobs = spark.createDataFrame([("1", "a", "Open"), ("2", "a", "Open"), ("3", "a", "Open"), ("4", "b", "Open")], "id string, company_id string, status string")
    keep = jobs.where("id = '1'")
    apps = spark.createDataFrame([("2",), ("2",)], "job_id string")
    assert rows(merge.prune(jobs, keep, apps, jobs.where("company_id = 'a'")), "id") == [("a", "1", "Open"), ("a", "2", "Archived"), ("b", "4", "Open")] or rows(merge.prune(jobs, keep, apps, jobs.where("company_id = 'a'")), "id") == [("1", "a", "Open"), ("2", "a", "Archived"), ("4", "b", "Open")]


def test_prune_joins_once(spark):
    """One join for the scope and one for all that is said of an id; a null id is never missing, an id counts wherever its rows are, what is kept and applied for stays as it is."""
    jobs = spark.createDataFrame([("1", "a", "Open"), (None, "a", "Open"), ("2", "a", "Open"), ("2", "b", "Open"), ("3", "a", "Open"), ("3", "b", "Open"), ("4", "a", "Open")], "id string, company_id string, status string")
    apps = spark.createDataFrame([("1",), ("2",), ("9",), (None,)], "job_id string")
    got = merge.prune(jobs, jobs.where("id = '1' or id is null"), apps, jobs.where("company_id = 'a'"))
    assert sorted(str(tuple(r[c] for c in jobs.columns)) for r in got.collect()) == sorted(map(str, [("1", "a", "Open"), (None, "a", "Open"), ("2", "a", "Archived"), ("2", "b", "Archived")]))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2


def test_upsert_keeps_first_seen(spark):
    s = spark.createDataFrame([("1", "x", "2020"), ("2", "y", "2021")], "id string, v string, first_seen string")
    n = spark.createDataFrame([("2", None, "2030"), ("3", "z", "2031")], s.schema)
    assert rows(merge.upsert(s, n, "id", ["first_seen"]), "id") == [("1", "x", "2020"), ("2", None, "2021"), ("3", "z", "2031")]
    assert rows(merge.overlay(s, n, "id"), "id") == [("1", "x", "2020"), ("2", "y", "2030"), ("3", "z", "2031")]


def test_protected_update(spark):
    s = spark.createDataFrame([("1", "", "keep"), ("2", "old", "old")], "id string, a string, b string")
    f = spark.createDataFrame([("1", "new", "no", ["x"]), ("2", "new", "", ["a", "b"])], "id string, a string, b string, allowed array<string>")
    assert rows(merge.protected_update(s, f, "id", ["a", "b"]), "id") == [("1", "new", "keep"), ("2", "new", "old")]


def test_repaired_ids(spark):
    df = spark.createDataFrame([(1, "j", "Analyst"), (2, "j", "Manager"), (3, "j", "Manager"), (4, "k", "x")], "ord int, id string, title string")
    got = [r.repaired_id for r in merge.repair_ids(df, "id", F.col("title"), "ord").orderBy("ord").collect()]
    assert got[0] == "j" and got[1].startswith("j--") and got[2] == got[1] + "-2" and got[3] == "k"


def test_company_fold_depends_on_order(spark):
    cols = "ord int, company_id string, company_name string, city string, state string, official_website string, careers_page_url string, job_board_url string, last_checked string, confidence int, notes string"
    a = (1, "a", "Ely Bank", "", "CO", "https://www.ely.com", "", "", "", 35, "one")
    b = (2, "b", "Ely Bank Inc", "Ely", "CO", "http://ely.com/x", "", "https://board", "", 10, "two; one")
    c = (3, "c", "Ely", "Rome", "CO", "https://ely.com", "https://c", "", "2024", 90, "")
    one = merge.fold_companies(spark.createDataFrame([a, b, c], cols), "ord").collect()
    assert len(one) == 1
    r = one[0]
    assert (r.company_id, r.company_name, r.city, r.job_board_url, r.careers_page_url, r.confidence, r.notes, r.n_rows) == ("b", "Ely Bank Inc", "Ely", "https://board", "https://c", 90, "one; two", 3)
    other = merge.fold_companies(spark.createDataFrame([(*((9,) + x[1:]),) if x is b else x for x in (a, b, c)], cols), "ord").first()
    assert other.company_id == "b" and other.notes == "one; two"


def test_identity_groups(spark):
    df = spark.createDataFrame([(1, "Ely Bank", "ely.com"), (2, "ELY  bank", ""), (3, "Two", "a.com"), (4, "two", "b.com"), (5, "Two", "")], "i int, n string, d string")
    assert [r.group_key for r in merge.identity_groups(df, "n", "d").orderBy("i").collect()] == ["ely bank", "ely bank", "two|a.com", "two|b.com", "two|"]


def test_constraints(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, None)], "k int, fk int")
    with pytest.raises(ValueError):
        merge.assert_unique(df, "k")
    merge.assert_unique(df, "k", "fk")
    merge.assert_references(df, "fk", spark.createDataFrame([(1,), (2,)], "id int"), "id")
    with pytest.raises(ValueError):
        merge.assert_references(df, "fk", spark.createDataFrame([(1,)], "id int"), "id")


def test_paging(spark):
    df = spark.range(30).select("id", F.format_string("Company %02d", "id").alias("name"))
    order = [F.lower("name"), F.asc("id")]
    assert [r.id for r in paging.page_of(df, order, 99, 25).collect()] == list(range(25, 30))
    assert len(paging.page_of(df, order, 1, 7).collect()) == 25
    assert tuple(paging.bounded_count(df, 10).first()) == (10, True) and tuple(paging.bounded_count(df, 40).first()) == (30, False)


def test_refresh_counts(spark):
    b = spark.createDataFrame([(1, "a", "open"), (2, "b", "open"), (3, "c", "open")], "k int, t string, s string")
    a = spark.createDataFrame([(1, "a", "open"), (2, "B", "closed"), (4, "d", "open")], b.schema)
    assert tuple(diff.refresh_counts(b, a, "k", ["t", "s"], "s").first()) == (1, 1, 1, 1)


def test_match_status(spark):
    now = R.fingerprint(F.lit("t"), F.lit("d"))
    result = lambda status, version, text="t", algo="2": F.struct(F.lit(status).alias("status"), F.lit(version).alias("version"), R.fingerprint(F.lit(text), F.lit("d")).alias("fingerprint"), F.lit(algo).alias("algorithm"))
    got = spark.range(1).select(*(R.match_status(r, F.lit(v), now, "2").alias(f"c{i}") for i, (r, v) in enumerate([
        (result("Matched", "v"), "v"), (result("Matched", "old"), "v"), (result("Matched", "v", "other"), "v"), (result("Failed", "v"), "v"), (result("Matched", "v", algo="1"), "v"), (result("Matched", "v"), None)]))).first()
    assert tuple(got) == ("Matched", "Needs Rematch", "Needs Rematch", "Match Failed", "Needs Rematch", "Not Matched")


# The digest: baseline, then changes once, failures keep the checkpoint


def test_digest(spark, tmp_path):
    sent, broken = [], []

    def send(df, batch):
        if broken:
            raise OSError("no mail")
        sent.append((batch, sorted((r.change_type, r.id) for r in df.collect())))

    d = Digest(spark, f"file://{tmp_path}/state", ["id"], send)
    open_ = lambda *ids: spark.createDataFrame([(i, "t") for i in ids], "id string, title string")
    assert d.batch(open_("stays", "removed"), 0) == "Baseline"
    broken.append(1)
    with pytest.raises(OSError):
        d.batch(open_("stays", "paid"), 1)
    broken.clear()
    assert d.batch(open_("stays", "paid", "unpaid"), 2) == "Sent"
    assert d.batch(open_("stays", "paid", "unpaid"), 2) == "Already Delivered"
    assert d.batch(open_("stays", "paid", "unpaid").withColumn("title", F.lit("other")), 3) == "Skipped - No Changes"
    assert sent == [(2, [("added", "paid"), ("added", "unpaid"), ("removed", "removed")])]


def test_digest_as_a_stream(spark, tmp_path):
    sent = []
    src = tmp_path / "in"
    d = Digest(spark, f"file://{tmp_path}/state", ["id"], lambda df, b: sent.append(sorted((r.change_type, r.id) for r in df.collect())))
    for k, ids in enumerate((["a", "b"], ["b", "c"])):
        spark.createDataFrame([(i,) for i in ids], "id string").coalesce(1).write.mode("append").parquet(str(src))
        d.start(spark.readStream.schema("id string").parquet(str(src)), f"{tmp_path}/ck").awaitTermination()
        assert len(sent) == k
    assert sent == [[("added", "c"), ("removed", "a")]]


# Sources


def test_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("c1", "Ely Bank", "=evil", "High"), ("", "Two & <Co>", "", "")], "id string, name string, notes string, confidence string")
    for c in workbooks.COMPANY_SHEET.values():
        if c not in df.columns:
            df = df.withColumn(c, F.lit(""))
    path = f"file://{tmp_path}/companies.xlsx"
    workbooks.write_workbook(df, path, workbooks.COMPANY_SHEET)
    got = workbooks.read_companies(spark, path).orderBy("row").collect()
    assert [(r.id, r.name, r.notes, r.confidence, r.country) for r in got] == [("c1", "Ely Bank", "'=evil", 90, "United States"), ("company-two-co-unknown", "Two & <Co>", "", 0, "United States")]
    assert workbooks.read_intake(spark, path).count() == 2
    workbooks.write_workbook(df, path, {"Other": "id"})
    with pytest.raises(Exception, match="Company Name"):
        workbooks.read_intake(spark, path).collect()
    with pytest.raises(ValueError):
        workbooks.check_archive(b"not a zip")


def test_json_imports(spark, tmp_path):
    (tmp_path / "both.json").write_text('﻿{"companies":[{"name":"A"}],"jobs":[{"title":"T"},{"title":"U"}]}', encoding="utf-8")
    (tmp_path / "companies.json").write_text('[{"name":"B"}]')
    (tmp_path / "jobs.json").write_text('[{"title":"T","id":"j1","payMin":10,"rawData":[1]},3,{"title":"U","rawData":{"a":1}}]')
    (tmp_path / "bad.json").write_text("{no json")
    companies, jobs = documents.split_import(documents.read_payloads(spark, f"file://{tmp_path}/*.json"))
    assert companies.count() == 2 and jobs.count() == 5
    got = documents.read_jobs(spark, f"file://{tmp_path}/jobs.json").orderBy("ord").collect()
    assert [(r.title, r.payMin, r.rawData) for r in got] == [("T", 10.0, "{}"), ("U", None, '{"a":1}')]
    assert documents.read_jobs(spark, f"file://{tmp_path}/bad.json").count() == 0
    deep = spark.createDataFrame([("[" * 65 + "]" * 65,), ('["' + "[" * 99 + '"]',)], "t string")
    assert [r[0] for r in deep.select(documents.nesting_ok("t")).collect()] == [False, True]
    with pytest.raises(ValueError):
        documents.enforce_record_limit(spark.range(6), spark.range(5), most=10)


def test_board_completeness(spark):
    pages = spark.createDataFrame([("a", 1, '{"total":3,"jobs":[{"id":"1"},{"id":"2"}]}'), ("a", 2, '{"total":3,"jobs":[{"id":"3"}]}'), ("b", 1, '{"total":5,"jobs":[{"id":"1"}]}'), ("c", 1, '{"total":0,"jobs":[]}')], "company_id string, page_no int, payload string")
    postings, verdict = documents.feature_pages(pages, "jobs", "total", "id")
    assert postings.count() == 4
    assert {r.company_id: r.complete for r in verdict.collect()} == {"a": True, "b": False, "c": True}


def test_backup(spark, tmp_path):
    path = f"file://{tmp_path}/b"
    documents.backup({"one": spark.range(5), "two": spark.range(3)}, path)
    assert documents.validate_backup(spark, path).count() == 0
    spark.range(4).write.mode("overwrite").parquet(f"{path}/one")
    assert [r.name for r in documents.validate_backup(spark, path).collect()] == ["one"]
    listing = spark.createDataFrame([("a", 1, True), ("b", 2, True), ("c", 3, False), ("d", 4, True)], "name string, created_at int, valid boolean")
    assert {r.name for r in documents.stale_backups(listing, 2).collect()} == {"a", "c"}


# Pages and discovery

PAGE = """<html><head><title>Jobs &amp; more</title><meta name="description" content="d"><script type="application/ld+json">{"@graph":[{"@type":"JobPosting","title":"Teller"},{"@type":"Organization"}]}</script></head>
<body><header class="top"><a href="/login">Log in</a></header><h1>Careers</h1><div class="job-list"><a href="/jobs/teller-1042">Bank Teller</a> Department: Retail <a href="mailto:a@b.c">mail</a></div><footer><a href="/privacy">Privacy</a></footer></body></html>"""


def test_page_evidence(spark):
    pages = spark.createDataFrame([(1, "https://b.com/careers", PAGE), (2, None, None)], "page_id bigint, url string, html string")
    flat = P.flatten(pages)
    one = flat.where("page_id = 1").first()
    assert (one.title, one.h1, one.description) == ("Jobs & more", "Careers", "d") and [x.url for x in one.links] == ["https://b.com/login", "https://b.com/jobs/teller-1042", "https://b.com/privacy"]
    links = P.links(pages)
    v = R.evidence(F.col("label"), F.col("url"), P.chrome_reason("around"), P.in_job_list("around"), R.metadata_signals(F.lit("Department: Retail")), F.lit(False), F.col("page_url"))
    got = {r.label: (r.v.accepted, r.v.reason) for r in links.select("label", v.alias("v")).collect()}
    assert got["Bank Teller"] == (True, "requisition id in the URL") and not got["Log in"][0] and not got["Privacy"][0] and got["Log in"][1] == "inside <header> site chrome"
    assert [r[0] for r in P.job_postings(flat).select(F.try_variant_get("item", "$.title", "string")).collect()] == ["Teller"]


def test_website_and_board_picks(spark):
    page = "Ely Bank online banking checking savings loans mortgage careers contact ely"
    s = spark.range(1).select(discovery.website_score(F.lit("Ely Bank"), F.lit("https://elybank.com"), F.lit(page), F.lit("Ely"), F.lit("")).alias("s")).first().s
    assert s.verified and s.confidence == "High" and s.score == 18 + 12 + 30 + 18 + 5
    bad = spark.range(1).select(discovery.website_score(F.lit("Ely Bank"), F.lit("https://yelp.com/ely"), F.lit(page), F.lit(""), F.lit("")).alias("s")).first().s
    assert not bad.verified and bad.score == 0
    c = spark.createDataFrame([("a", 1, 2, "https://x.com/careers", 60, "", False), ("a", 2, 1, "https://y.com", 56, "", False), ("a", 1, 1, "https://z.com", 10, "", False), ("b", 1, 1, "https://q.com", 10, "", False)], "k string, stage int, ord int, url string, score int, platform string, rejected boolean")
    assert [(r.k, r.url) for r in discovery.best_board(c, "k", "stage", "ord").collect()] == [("a", "https://x.com/careers")]
    w = spark.createDataFrame([("a", 1, "u1", 40, "Medium", True), ("a", 2, "u2", 70, "High", True), ("a", 3, "u3", 99, "High", True)], "k string, ord int, url string, score int, confidence string, verified boolean")
    assert discovery.best_website(w, "k", "ord").first().url == "u2"


def test_runs(spark):
    schema = "id string, job_key string, status string, started_at string, completed_at string, runtime_seconds double, progress_current int, progress_total int, progress_verb string, progress_unit string, error string"
    df = spark.createDataFrame([(f"r{k}", "j", "Completed" if k % 2 else "Failed", f"2024-01-{k + 1:02d}T00:00:00Z", "", float(k), 5, 8, "Checked", "companies", "") for k in range(10)] + [("s", "j", "Skipped", "2024-02-01T00:00:00Z", "", None, 0, 0, "", "", "")], schema)
    one = runs.statistics(df).first()
    assert one.average_runtime == 5.0 and one.last_run.id == "r9"
    shown = runs.snapshot(df.where("id = 'r1'"), F.lit("2024-01-03 00:00:00")).first()
    assert (shown.progress_percent, shown.progress_text) == (62, "Checked 5 of 8 companies")
    failed = runs.interrupted(df.withColumn("status", F.when(F.col("id") == "r1", "Running").otherwise(F.col("status"))), "2024-01-02T00:01:00Z").where("id = 'r1'").first()
    assert (failed.status, failed.runtime_seconds) == ("Failed", 60.0)
    due = spark.createDataFrame([("a", "d1"), ("a", "d1"), ("b", "d1")], "job_key string, local_date string")
    assert runs.claims(due, due.where("job_key = 'b'")).count() == 1
    plan = runs.import_plan(spark.createDataFrame([("a", "a"), ("b", "b"), ("c--1", "c")], "id string, original string"), spark.createDataFrame([("a",)], "id string"), "id", "original")
    assert {r.id: r.action for r in plan.collect()} == {"a": "update", "b": "create", "c--1": "update-id"}


def test_vendor_boards(spark):
    from tidewell.sources import boards

    page = lambda *jobs, total=None: '{"success":true,"data":{"jobCount":%d,"jobs":[%s]}}' % (len(jobs) if total is None else total, ",".join(jobs))
    job = lambda i, title, sub="bank": '{"id":%d,"title":"%s","subdomain":"%s","jobLocation":"Ely, NV"}' % (i, title, sub)
    pages = spark.createDataFrame([("full", 1, page(job(1, "Teller"), job(2, "Apply Now"), job(3, "Risk  Analyst"))), ("cut", 1, page(job(1, "Teller"), total=4)), ("alien", 1, page(job(1, "Teller"), job(2, "Banker", "other"))), ("empty", 1, page())], "company_id string, page_no int, payload string")
    jobs, verdict = boards.postings(pages, "ApplicantPro", tenant="bank")
    assert sorted((r.company_id, r.title, r.location, r.id) for r in jobs.collect()) == [("full", "Risk Analyst", "Ely, NV", "job-applicantpro-full-3"), ("full", "Teller", "Ely, NV", "job-applicantpro-full-1")]
    assert {r.company_id: (r.complete, r.foreign) for r in verdict.collect()} == {"full": (True, False), "cut": (False, False), "alien": (True, True), "empty": (True, False)}
    rows = spark.createDataFrame([("Teller", "Pay: $20 to $25 per hour", "", None, None, "unknown", "UNKNOWN"), ("Chief Officer", "", "$90,000 - $95,000 a year", 1.0, 2.0, "x", "IC")], "title string, description string, pay_text string, pay_min double, pay_max double, pay_period string, role_type string")
    assert [tuple(r)[3:] for r in boards.enrich(rows).collect()] == [(20.0, 25.0, "hourly", "IC"), (90000.0, 95000.0, "annual", "IC")]


def test_pay_query_reads_whole_documents(spark, tmp_path):
    from tidewell.plans.queries import QUERIES

    texts = ["plain words " * 60 + "Salary range $80,000-$105,000 annually", "Pay: $24.50 to $31.75 per hour", "no pay here", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = rows(QUERIES["pay_extract"](spark, f"file://{tmp_path}").select("doc_id", "low", "high", "period"), "doc_id")
    assert got == [(0, 80000, 105000, "annual"), (1, 24, 32, "hourly"), (2, None, None, "unknown"), (3, None, None, "unknown")]
