"""Filling in what is missing of companies from landed evidence.

Evidence is rows: for a group of records (one company), a field, a value, where it comes from and its rank. Per field the accepted value of the
lowest rank wins, with its source, in one aggregate; what depends on another field (nothing without a confirmed site, a
board that is the careers page, a platform that follows from the board) is decided on that one row. Then every record of the group is
updated: blanks are filled, and a value stands unless it is clearly invalid or is the very one that the evidence replaces.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U
from . import discovery as D

# ---- Fixed values ----
LABELS = {
    "official_website": "Company website", "careers_page_url": "Careers page", "job_board_url": "Job-board URL", "job_platform": "Job-board platform", "city": "Headquarters city", "state": "Headquarters state",
    "company_description": "Company description", "industry": "Industry",
}
FIELDS = tuple(LABELS)
URLS = ("official_website", "careers_page_url", "job_board_url")
PLACEHOLDERS = ("", "unknown", "n/a", "na", "none", "not available", "tbd", "-")
NO_PLATFORM = ("indeed", "linkedin", "ziprecruiter")
SITE_FIELDS = ("official_website", "known_website", "company_website")
OWN_SITE = "Company Careers Site"
PURPOSE_SIGNALS = ("career", "jobs", "employment", "open positions", "join our team")
PURPOSE_PHRASES = ("apply for this job", "career opportunities", "current openings", "job openings", "open positions", "search jobs", "search and apply", "view all jobs")
JOB_INDICATORS = ("job title", "department", "location", "apply for this job", "submit application", "view all jobs", "job openings", "current openings", "search jobs")


def _value(c: str, of: str = "") -> Column:
    return F.trim(T.blank(F.col(f"{of}{c}")))


def aggregator(url: Column) -> Column:
    return U.in_domains(U.host(url), D.AGGREGATORS) & U.public_shape(url)


def clearly_invalid(field: str, of: str = "", h: dict[str, Column] | None = None) -> Column:
    """A saved value that cannot be right: no public URL, someone else's site, a placeholder, a platform that the board contradicts, too short. Blank URLs are not invalid, only missing.
    ``h``: the hosts of URLS, where they are at hand."""
    v, at = _value(field, of), (h or {}).get(field)
    low = F.lower(v)
    if field == "official_website":
        return F.when(~U.public_shape(v, at), v != "").otherwise(U.disallowed(v, at) | (U.platform(v, h=at) != ""))
    if field in ("careers_page_url", "job_board_url"):
        return F.when(~U.public_shape(v, at), v != "").otherwise(D.board_rejection(v, at) != "")  # aggregators are among what it rejects
    if field == "job_platform":
        said = F.lower(U.platform(_value("job_board_url", of), h=(h or {}).get("job_board_url")))
        return low.isin(*PLACEHOLDERS, *NO_PLATFORM) | (F.length(v) < 2) | (said != "") & (low != said)
    return low.isin(*PLACEHOLDERS) | (F.length(v) < (40 if field == "company_description" else 2))


def judged(df: DataFrame, out: str, of: str = "", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """df with ``out``: an array of those of ``fields`` that are clearly invalid. URLs are looked at once here, their hosts in a step of their own, and rules read the array."""
    urls = [f for f in URLS if f in fields or f == "job_board_url" and "job_platform" in fields]
    hosts = {f: f"_host_{of}{f}" for f in urls}
    df = df.withColumns({c: U.host(_value(f, of)) for f, c in hosts.items()})
    h = {f: F.col(c) for f, c in hosts.items()}
    return df.withColumn(out, F.array_compact(F.array(*(F.when(clearly_invalid(f, of, h), F.lit(f)) for f in fields)))).drop(*hosts.values())


def invalid(bad: str, field: str) -> Column:
    return F.array_contains(bad, field)


def missing(bad: str, of: str = "") -> Column:
    """The fields that are blank or (by ``bad``, see ``judged``) clearly invalid, the site also while it is not verified."""
    lacks = {f: (_value(f, of) == "") | invalid(bad, f) for f in FIELDS}
    lacks["official_website"] = lacks["official_website"] | ~F.coalesce(F.col(f"{of}website_verified"), F.lit(False))
    return F.array_compact(F.array(*(F.when(t, F.lit(f)) for f, t in lacks.items())))


def plausible_domains(of: str = "") -> Column:
    """The distinct first-party domains among a record's three site fields: public, no listing, no aggregator, no platform."""

    def one(c: str) -> Column:
        v = _value(c, of)
        url = F.when(v.contains("://"), v).otherwise(F.concat(F.lit("https://"), v))
        good = (v != "") & U.public_shape(url) & ~U.disallowed(url) & ~aggregator(url) & (U.platform(url) == "")
        return F.when(good, F.nullif(U.registered_domain(url), F.lit("")))

    return F.array_distinct(F.array_compact(F.array(*map(one, SITE_FIELDS))))


def plausible_domain(of: str = "") -> Column:
    """The only plausible domain, '' if there is none or more than one."""
    found = plausible_domains(of)
    return F.when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise("")


def confirmed_domain(of: str = "") -> Column:
    return F.when(F.coalesce(F.col(f"{of}website_verified"), F.lit(False)), plausible_domain(of)).otherwise("")


def preferred_website(of: str = "") -> Column:
    """The first of a record's three site fields that may be its own, with a scheme; ''."""

    def one(c: str) -> Column:
        v = _value(c, of)
        url = F.when(v.contains("://"), v).otherwise(F.concat(F.lit("https://"), v))
        return F.when(U.public_shape(url) & ~U.disallowed(url) & (U.platform(url) == ""), url)

    return F.coalesce(*map(one, SITE_FIELDS), F.lit(""))


def careers_purpose(url: Column, prominent: Column, text: Column) -> Column:
    """A page is there for careers: by its platform, its path, its title and headings, or what it says."""
    by_path = F.lower(U.path(url)).rlike(r"/(?:careers?|jobs?|employment|openings|opportunities)(?:/|$|-)")
    return (U.platform(url) != "") | by_path | T.contains_any(F.lower(T.blank(prominent)), PURPOSE_SIGNALS) | T.contains_any(F.lower(T.squash(text)), PURPOSE_PHRASES)


def related_url(candidate: Column, final_url: Column, company: Column, official: Column, prominent: Column, text: Column, confirmed: Column) -> Column:
    """struct(accepted, reason) of a careers page or board that was fetched (final_url null: it was not), for a company with that official site.

    Accepted is a page of the site's domain, one whose text names the company and jobs, or, from a confirmed source, a platform or a URL
    that looks like the company's; and it must be there for careers.
    """
    low = F.lower(T.squash(text))
    named = F.exists(T.identity_tokens(company), lambda w: low.contains(w)) & T.contains_any(low, JOB_INDICATORS)
    same = (T.blank(official) != "") & (U.registered_domain(official) == U.registered_domain(final_url))
    related = same | named | confirmed & ((U.platform(final_url) != "") | U.matches_company(company, final_url))
    foreign = lambda u: aggregator(u) | (D.board_rejection(u) != "")
    reason = (
        F.when(~U.public_shape(candidate), "Rejected a malformed careers or job-board URL.").when(foreign(candidate), "Rejected a generic third-party job aggregator or unrelated URL.")
        .when(final_url.isNull(), F.concat(F.lit("Could not validate "), candidate)).when(foreign(final_url), "Rejected a URL that redirected to a third-party job aggregator or unrelated page.")
        .when(~related, "Rejected a careers or job-board result that could not be related to the company.")
        .when(~careers_purpose(final_url, prominent, text), "Rejected a company-related URL that was not confirmed as a careers or jobs page.").otherwise("")
    )
    return F.struct((reason == "").alias("accepted"), reason.alias("reason"))


def resolve(evidence: DataFrame) -> DataFrame:
    """A row for each group with evidence (group_key, field, value, source, rank, accepted, lists_jobs): for every field struct(value, source, lists_jobs) of the accepted
    row with the lowest rank (equal ranks: the smallest source and value), boards apart by rank 1 (saved) and later ones."""
    good = F.col("accepted") & (T.blank("value") != "")
    at = F.struct("rank", "source", "value")
    best = lambda test: F.min_by(F.struct("value", "source", F.coalesce("lists_jobs", F.lit(False)).alias("lists_jobs")), F.when(test, at))
    of = lambda f: good & (F.col("field") == f)
    names = ("official_website", "careers_page_url", "city", "state", "company_description", "industry")
    return evidence.groupBy("group_key").agg(
        *(best(of(f)).alias(f) for f in names), best(of("job_board_url") & (F.col("rank") <= 1)).alias("saved_board"), best(of("job_board_url") & (F.col("rank") > 1)).alias("found_board"),
        F.bool_or((F.col("field") == "official_website") & F.col("failed")).alias("failed"),
    )


def discover(groups: DataFrame, evidence: DataFrame) -> DataFrame:
    """groups (group_key, requested, and the merged record's fields) with ``found``: array<struct<field, value, source>>, ``failed`` and the ``step`` at which it ended.

    A platform that the saved board shows needs no site. Without a confirmed site nothing else is taken.
    """
    r = judged(groups, "bad", fields=("job_board_url",)).join(resolve(evidence).select("group_key", F.struct("*").alias("e")), "group_key", "left")
    e = lambda f, x="value": F.col(f"e.{f}.{x}")
    board = _value("job_board_url")
    r = r.withColumn("shown", U.platform(board))
    shown = F.col("shown")
    short = F.array_contains("requested", "job_platform") & (board != "") & (shown != "") & ~aggregator(board)
    r = r.withColumn("short", short).withColumn("open", F.when(F.col("short"), F.array_remove("requested", "job_platform")).otherwise(F.col("requested")))
    step = F.when(F.size("requested") == 0, "nothing requested").when(F.size("open") == 0, "platform of the saved board").when(e("official_website").isNull(), "no confirmed site").otherwise("evidence")
    on = F.col("step") == "evidence"
    asks = lambda *fields: F.arrays_overlap("open", F.array(*map(F.lit, fields)))
    r = r.withColumn("step", step)
    careers = F.when(on & asks("careers_page_url", "job_board_url", "job_platform"), F.col("e.careers_page_url"))
    r = r.withColumn("careers", careers)
    own = F.struct(F.col("careers.value").alias("value"), F.concat(F.lit("careers page: "), F.col("careers.source")).alias("source"), F.col("careers.lists_jobs").alias("lists_jobs"))
    chosen = F.coalesce(
        F.when(~invalid("bad", "job_board_url"), F.col("e.saved_board")), F.when(F.col("careers").isNotNull() & (U.platform(F.col("careers.value")) != ""), own), F.col("e.found_board"), F.when(F.col("careers.lists_jobs"), own),
    )
    r = r.withColumn("board", F.when(on & asks("job_board_url", "job_platform"), chosen))
    item = lambda f, test, value, source: F.when(test, F.struct(F.lit(f).alias("field"), value.alias("value"), source.alias("source")))
    r = r.withColumn("platform", U.platform(F.col("board.value")))
    platform = F.col("platform")
    found = F.array_compact(F.array(
        item("official_website", on, e("official_website"), e("official_website", "source")),
        *(item(f, on & asks(f) & e(f).isNotNull(), e(f), e(f, "source")) for f in ("city", "state", "company_description", "industry")),
        item("careers_page_url", F.col("careers").isNotNull(), F.col("careers.value"), F.col("careers.source")),
        item("job_board_url", F.col("board").isNotNull(), F.col("board.value"), F.col("board.source")),
        F.coalesce(item("job_platform", F.col("board").isNotNull(), F.when(platform != "", platform).otherwise(OWN_SITE), F.col("board.source")), item("job_platform", F.col("short"), shown, F.lit("saved board"))),
    ))
    return r.select(*groups.columns, found.alias("found"), (F.coalesce("e.failed", F.lit(False)) & (F.col("step") == "no confirmed site")).alias("failed"), "step")


def kept(df: DataFrame) -> DataFrame:
    """df, run once and held on the executors' disks until nothing refers to it: what is read twice is not worked out twice."""
    return df.localCheckpoint(storageLevel=StorageLevel.DISK_ONLY)


def refresh(companies: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row for each record that lacked something: (group_key, id, after: its fields, website_verified and search_status as saved, changed, replaced, remaining, found, outcome, message).

    companies: id, group_key, name, FIELDS, website_verified. The records of a group share one discovery, made for the record with most valid fields (then the
    smallest id), its blanks filled from the others. outcome and message are the group's: 'updated', 'failed', 'no_information_found' or 'unchanged'. Groups without
    evidence are reported as well; records that lack nothing are not.
    """
    valid = sum((F.when(~invalid("bad", f) & (_value(f) != ""), 1).otherwise(0) for f in FIELDS), F.lit(0))
    at = F.struct((-valid).alias("rank"), F.col("id").cast("string").alias("id"))
    record = kept(judged(companies.repartition("id"), "bad").withColumn("lacks", missing("bad"))).withColumn("at", at)  # dealt over tasks, whatever the files; the rules run once a record
    first = lambda f: F.coalesce(F.min_by(f, F.when(_value(f) != "", F.col("at"))), F.lit("")).alias(f)
    merged = record.groupBy("group_key").agg(*(first(f) for f in FIELDS), F.array_sort(F.array_distinct(F.flatten(F.collect_set("lacks")))).alias("requested"), F.count_if(F.size("lacks") > 0).alias("selected"))
    found = discover(merged.where("selected > 0"), evidence).select("group_key", "requested", "found", "failed", "step", "selected", F.struct(*FIELDS).alias("m"))
    r = record.where(F.size("lacks") > 0).join(found, "group_key")

    trimmed = lambda c: F.regexp_replace(c, "/+$", "")
    new = {f: F.get(F.filter("found", _is(f)), F.lit(0)).getField("value") for f in FIELDS}
    r = r.withColumns({f"new_{f}": F.coalesce(c, F.lit("")) for f, c in new.items()})
    marked = {f: (_value(f, "m.") != "") & (F.col(f"new_{f}") != "") & (trimmed(_value(f, "m.")) != trimmed(F.col(f"new_{f}"))) for f in FIELDS}
    asked = lambda f: F.array_contains("requested", f) & (F.col(f"new_{f}") != "") & (_value(f) != "") & invalid("bad", f)
    source = lambda f: marked[f] & (trimmed(_value(f)) != "") & (trimmed(_value(f)) == trimmed(_value(f, "m.")))
    allowed = {f: (marked[f] | asked(f)) & (invalid("bad", f) | source(f)) for f in FIELDS}
    r = r.withColumns({f"may_{f}": c for f, c in allowed.items()})
    r = r.withColumns({f"after_{f}": F.when((F.col(f"new_{f}") != "") & ((_value(f) == "") | F.col(f"may_{f}")), F.col(f"new_{f}")).otherwise(F.coalesce(F.col(f), F.lit(""))) for f in FIELDS})
    site = F.col("new_official_website")
    verified = F.coalesce("website_verified", F.lit(False)) | (site != "") & ((_value("official_website") == "") | (site == _value("official_website")) | F.col("may_official_website"))
    r = r.withColumn("after_website_verified", verified)
    differs = [F.when(T.blank(f) != F.col(f"after_{f}"), F.lit(f)) for f in FIELDS] + [F.when(F.coalesce("website_verified", F.lit(False)) != F.col("after_website_verified"), F.lit("website_verified"))]
    r = judged(r, "bad_after", "after_")
    r = r.withColumns({"left": missing("bad_after", "after_"), "changed": F.array_sort(F.array_compact(F.array(*differs))), "replaced": F.array_compact(F.array(*(F.when(F.col(f"may_{f}"), F.lit(f)) for f in FIELDS)))})
    r = r.withColumns({"remaining": F.array_intersect("left", "requested"), "search_status": F.when(F.size("left") == 0, "Completed").otherwise("Partial")})

    r = kept(r.select("group_key", "id", "selected", "failed", "step", "found", "changed", "replaced", "remaining", "search_status", *(f"after_{f}" for f in (*FIELDS, "website_verified"))))
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))  # noqa: E731  few distinct sets of fields, however many records
    r = r.join(r.groupBy("group_key").agg(every("changed").alias("g_changed"), every("remaining").alias("g_remaining")), "group_key")
    outcome = F.when(F.size("g_changed") > 0, "updated").when(F.col("failed"), "failed").when(F.size("g_remaining") > 0, "no_information_found").otherwise("unchanged")
    label = F.create_map(*(F.lit(x) for f in (*LABELS.items(), ("website_verified", "Website verified")) for x in f))
    named = lambda c: F.array_join(F.transform(c, lambda f: F.try_element_at(label, f)), ", ")
    still = F.when(F.size("g_remaining") > 0, F.concat(F.lit(" Still missing "), named("g_remaining"), F.lit("."))).otherwise("")
    message = (
        F.when(outcome == "updated", F.concat(F.lit("Updated "), named("g_changed"), F.lit("."), still)).when(outcome == "failed", "The company could not be reviewed; existing information was preserved.")
        .when(outcome == "no_information_found", "No additional high-confidence information was found; existing information was preserved.").otherwise("Confirmed available information; no saved values needed to change.")
    )
    more = F.when(F.col("selected") > 1, F.concat(F.lit(" One lookup safely covered "), F.col("selected").cast("string"), F.lit(" duplicate records."))).otherwise("")
    after = F.struct(*(F.col(f"after_{f}").alias(f) for f in FIELDS), F.col("after_website_verified").alias("website_verified"), "search_status")
    return r.select("group_key", "id", after.alias("after"), "changed", "replaced", "remaining", "found", "step", outcome.alias("outcome"), F.concat(message, more).alias("message"))


def _is(field: str):
    return lambda x: x.getField("field") == field
