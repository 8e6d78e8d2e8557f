"""Filling in companies: fields that are missing or invalid, domains, related pages, the flow's steps, what is replaced, groups and their outcomes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewell.operators import company_info as C

FULL = {
    "official_website": "https://www.elybank.com", "careers_page_url": "https://www.elybank.com/careers", "job_board_url": "https://ely.wd5.myworkdayjobs.com/jobs", "job_platform": "Workday", "city": "Ely", "state": "NV",
    "company_description": "A bank that has served its town for a hundred years.", "industry": "Banking", "known_website": "", "company_website": "",
}
COLUMNS = "id string, group_key string, name string, " + ", ".join(f"{f} string" for f in FULL) + ", website_verified boolean"
EVIDENCE = "group_key string, field string, value string, source string, rank int, accepted boolean, lists_jobs boolean, failed boolean"


def company(i, group="g", verified=True, **changes):
    return (i, group, "Ely Bank", *(FULL | changes).values(), verified)


def found(group, field, value, rank=1, source="page", accepted=True, lists_jobs=False, failed=False):
    return (group, field, value, source, rank, accepted, lists_jobs, failed)


def refreshed(spark, companies, evidence):
    rows = C.refresh(spark.createDataFrame(companies, COLUMNS), spark.createDataFrame(evidence, EVIDENCE)).collect()
    return {r.id: r for r in rows}


def test_missing_and_invalid(spark):
    cases = [
        (company("0"), []), (company("1", verified=False), ["official_website"]), (company("2", official_website="https://facebook.com/ely"), ["official_website"]), (company("3", official_website="not a url"), ["official_website"]),
        (company("4", job_platform="Greenhouse"), ["job_platform"]), (company("5", job_platform="Indeed", city="N/A", industry="x"), ["job_platform", "city", "industry"]), (company("6", company_description="short"), ["company_description"]),
        (company("7", careers_page_url="https://www.indeed.com/cmp/ely", job_board_url=None), ["careers_page_url", "job_board_url"]), (company("8", state=None), ["state"]),
    ]
    df = C.judged(spark.createDataFrame([c for c, _ in cases], COLUMNS), "bad").select("id", C.missing("bad").alias("m"))
    assert {r.id: r.m for r in df.collect()} == {c[0]: m for c, m in cases}


def test_rules_are_worked_out_once_a_record(spark):
    """What refresh gives reads verdicts that are there, and looks at no URL again for each of its joins."""
    df = C.refresh(spark.createDataFrame([company("0", city="")], COLUMNS), spark.createDataFrame([found("g", "city", "Ely")], EVIDENCE))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "credit card application" not in plan and "regexp_extract" not in plan and df.count() == 1


def test_domains(spark):
    rows = [
        company("0", known_website="elybank.com", company_website="http://jobs.elybank.com"), company("1", known_website="https://other.com"), company("2", official_website="https://facebook.com/x", known_website="ely.org"),
        company("3", official_website="", known_website=None), company("4", verified=False, official_website="https://ely.wd5.myworkdayjobs.com", company_website="https://ely.com/a"),
    ]
    df = spark.createDataFrame(rows, COLUMNS).select("id", F.array_join(F.array_sort(C.plausible_domains()), ","), C.plausible_domain(), C.confirmed_domain(), C.preferred_website())
    assert {r[0]: tuple(r[1:]) for r in df.collect()} == {
        "0": ("elybank.com", "elybank.com", "elybank.com", "https://www.elybank.com"), "1": ("elybank.com,other.com", "", "", "https://www.elybank.com"), "2": ("ely.org", "ely.org", "ely.org", "https://ely.org"),
        "3": ("", "", "", ""), "4": ("ely.com", "ely.com", "", "https://ely.com/a"),
    }


@pytest.mark.parametrize(
    "candidate, final, heading, text, confirmed, reason",
    [
        ("https://elybank.com/careers", "https://elybank.com/careers", "", "", False, ""), ("https://elybank.com/x", "https://elybank.com/x", "Join our team", "", False, ""),
        ("https://elybank.com/x", "https://elybank.com/x", "About", "we lend money", False, "Rejected a company-related URL that was not confirmed as a careers or jobs page."),
        ("https://boards.greenhouse.io/ely", "https://boards.greenhouse.io/ely", "", "", True, ""), ("https://boards.greenhouse.io/ely", "https://boards.greenhouse.io/ely", "", "", False, "Rejected a careers or job-board result that could not be related to the company."),
        ("https://boards.greenhouse.io/e", "https://boards.greenhouse.io/e", "", "Ely: current openings", False, ""), ("https://www.indeed.com/ely", "https://www.indeed.com/ely", "", "", True, "Rejected a generic third-party job aggregator or unrelated URL."),
        ("https://elybank.com/careers", "https://www.linkedin.com/ely", "", "", True, "Rejected a URL that redirected to a third-party job aggregator or unrelated page."), ("nope", "nope", "", "", True, "Rejected a malformed careers or job-board URL."),
        ("https://elybank.com/careers", None, "", "", True, "Could not validate https://elybank.com/careers"),
    ],
)
def test_related_urls(spark, candidate, final, heading, text, confirmed, reason):
    df = spark.createDataFrame([(candidate, final, heading, text)], "c string, f string, h string, t string")
    got = df.select(C.related_url(F.col("c"), F.col("f"), F.lit("Ely Bank"), F.lit("https://www.elybank.com"), F.col("h"), F.col("t"), F.lit(confirmed)).alias("v")).first().v
    assert tuple(got) == (reason == "", reason)


def test_steps_of_the_flow(spark):
    companies = [
        company("platform", "platform", job_platform=""), company("nosite", "nosite", city="", verified=False), company("down", "down", city="", verified=False), company("city", "city", city="tbd"), company("board", "board", job_board_url="", job_platform=""),
        company("own", "own", job_board_url="", job_platform="", careers_page_url=""), company("vendor", "vendor", job_board_url="", job_platform="", careers_page_url=""), company("full", "full"), company("alone", "alone", state=""),
    ]
    site = lambda g: found(g, "official_website", FULL["official_website"], source="search")
    evidence = [
        found("nosite", "city", "Rome"), found("down", "official_website", "", accepted=False, failed=True), site("city"), found("city", "city", "Rome", 2), found("city", "city", "Ely", 1, accepted=False), found("city", "state", "CO"),
        site("board"), found("board", "job_board_url", "https://jobs.lever.co/ely", 3), found("board", "job_board_url", "https://boards.greenhouse.io/ely", 2), site("own"), found("own", "careers_page_url", "https://elybank.com/jobs", lists_jobs=True),
        site("vendor"), found("vendor", "careers_page_url", "https://jobs.lever.co/ely"), found("vendor", "job_board_url", "https://boards.greenhouse.io/ely", 3),
    ]
    r = refreshed(spark, companies, evidence)
    assert set(r) == {c[0] for c in companies} - {"full"}
    assert (r["platform"].step, r["platform"].after.job_platform, r["platform"].after.search_status, r["platform"].outcome) == ("platform of the saved board", "Workday", "Completed", "updated")
    assert (r["nosite"].step, r["nosite"].outcome, r["nosite"].after.city) == ("no confirmed site", "no_information_found", "") and r["down"].outcome == "failed"
    assert (r["city"].after.city, r["city"].after.state, r["city"].replaced, r["city"].message) == ("Rome", "NV", ["city"], "Updated Headquarters city.")
    assert (r["board"].after.job_board_url, r["board"].after.job_platform) == ("https://boards.greenhouse.io/ely", "Greenhouse")
    assert (r["own"].after.job_board_url, r["own"].after.job_platform, {f.field: f.source for f in r["own"].found}["job_board_url"]) == ("https://elybank.com/jobs", C.OWN_SITE, "careers page: page")
    assert (r["vendor"].after.job_board_url, r["vendor"].after.careers_page_url) == ("https://jobs.lever.co/ely",) * 2
    assert (r["alone"].outcome, r["alone"].after.search_status) == ("no_information_found", "Partial")


def test_groups_and_replacements(spark):
    companies = [
        company("a", city="", official_website="https://old.com"), company("b", city="Elko", official_website="https://old.com/", verified=False), company("c", city="", official_website="https://third.com"), company("d"),
        company("s1", "same", verified=False), company("s2", "same", verified=False, official_website="https://www.elybank.com/"),
    ]
    evidence = [found("g", "official_website", "https://new.com"), found("g", "city", "Ely"), found("same", "official_website", FULL["official_website"])]
    r = refreshed(spark, companies, evidence)
    assert set(r) == {"a", "b", "c", "s1", "s2"}
    # the merged record is b's (as many valid fields as d's, smaller id): its site, which a writes without the slash, and its city are what the evidence replaces
    assert [r[k].after.official_website for k in "abc"] == ["https://new.com", "https://new.com", "https://third.com"] and [r[k].after.city for k in "abc"] == ["Ely", "Ely", "Ely"]
    assert [r[k].replaced for k in "abc"] == [["official_website", "city"], ["official_website", "city"], ["city"]] and {r[k].outcome for k in "abc"} == {"updated"} and "3 duplicate records" in r["a"].message
    assert (r["s1"].after.website_verified, r["s2"].after.website_verified, r["s2"].after.official_website) == (True, False, "https://www.elybank.com/")
    empty = C.refresh(spark.createDataFrame([], COLUMNS), spark.createDataFrame([], EVIDENCE))
    assert empty.count() == 0
