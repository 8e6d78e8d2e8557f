"""Vendor board protocols as a table: where a landed API page keeps its listing, its declared total and a posting's fields.

All vendors share one plan (explode, completeness against the declared total, de-duplication by vendor id, title gate, projection); what
differs is data. A page of a vendor with a tenant check counts for nothing if any of its rows belongs to another tenant.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..functions import url as U
from .documents import feature_pages


@dataclass(frozen=True)
class Vendor:
    """JSON paths below a page (listing, total) and below a posting (the rest); most: rows a board may have."""

    listing: str
    total: str
    id: str
    title: str
    posted: str = ""
    text: str = ""
    location: str = ""
    tenant: str = ""
    skip: str = ""
    most: int = 1000


#: The vendors' own field names.
VENDORS = {
    "ADP": Vendor("jobRequisitions", "meta.totalNumber", "itemID", "requisitionTitle", "postDate", "requisitionDescription", most=500),
    "Workday": Vendor("jobPostings", "total", "externalPath", "title", "postedOn", location="locationsText"),
    "UKG": Vendor("opportunities", "totalCount", "Id", "Title", "PostedDate", "BriefDescription"),
    "UKG Ready": Vendor("job_requisitions", "_paging.total", "id", "job_title", text="job_description", most=2000),
    "Paycom": Vendor("jobPostingPreviews", "jobPostingPreviewsCount", "jobId", "jobTitle", "postedOn", "description"),
    "Cornerstone": Vendor("data.requisitions", "data.totalCount", "requisitionId", "displayJobTitle", "postingEffectiveDate", "externalDescription"),
    "Dayforce": Vendor("jobPostings", "maxCount", "jobPostingId", "jobTitle", "postingStartTimestampUTC", "jobDescription"),
    "ApplicantPro": Vendor("data.jobs", "data.jobCount", "id", "title", "startDateRef", location="jobLocation", tenant="subdomain", most=2000),
    "isolved Hire": Vendor("data.jobs", "data.jobCount", "id", "title", "startDateRef", location="jobLocation", tenant="subdomain", most=2000),
    "Paylocity": Vendor("Jobs", "", "JobId", "JobTitle", "PublishedDate", "Description", skip="IsInternal", most=5000),
}


def _field(path: str) -> Column:
    return T.squash(F.try_variant_get("item", f"$.{path}", "string")) if path else F.lit("")


def postings(api_pages: DataFrame, vendor: str, tenant: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(jobs, verdict) of landed pages (company_id, page_no, payload).

    verdict: seen, declared, complete, foreign, over (more rows than the vendor's limit). Jobs of incomplete, foreign or overfull boards are
    not returned: a board is all or nothing. A vendor that declares no total is complete with what it lists.
    """
    v = VENDORS[vendor]
    items, found = feature_pages(api_pages, v.listing, v.total or v.listing, v.id)
    if not v.total:
        found = found.withColumn("complete", F.lit(True))
    if v.tenant and tenant:
        alien = items.groupBy("company_id").agg(F.bool_or(F.lower(_field(v.tenant)) != tenant.lower()).alias("foreign"))
        found = found.join(alien, "company_id", "left")
    else:
        found = found.withColumn("foreign", F.lit(False))
    verdict = found.withColumns({"foreign": F.coalesce("foreign", F.lit(False)), "over": F.col("rows") > v.most})
    good = verdict.where("complete AND NOT foreign AND NOT over").select("company_id")
    rows = items.join(good, "company_id", "left_semi")
    if v.skip:
        rows = rows.where(~F.coalesce(F.try_variant_get("item", f"$.{v.skip}", "boolean"), F.lit(False)))
    title = T.job_title(_field(v.title))
    jobs = rows.where(R.valid_structured_title(title) & (F.col("posting_id") != "")).groupBy("company_id", "posting_id").agg(F.min_by(F.struct("item", "page_no", "at"), F.struct("page_no", "at")).alias("_r")).select("company_id", "posting_id", "_r.item")
    key = F.concat_ws("-", F.lit(vendor), "company_id", "posting_id")
    text = _field(v.text)
    return jobs.select(
        U.job_id(key).alias("id"), "company_id", "posting_id", title.alias("title"), T.blank(_field(v.location)).alias("location"), _field(v.posted).alias("posted_date"), text.alias("description"), F.substring(text, 1, 360).alias("description_snippet"),
        F.lit(vendor).alias("job_platform"), R.work_type(F.concat_ws(" ", title, text), R.WORK_TYPE_ORDER.get(vendor.lower(), ("remote", "hybrid", "onsite"))).alias("work_type"), R.pay(text).alias("pay"), R.role_type(title, text).alias("role"),
    ), verdict


def enrich(jobs: DataFrame) -> DataFrame:
    """Stored postings re-read: pay from the pay text, else from the description where both bounds are missing; a role where it is unknown."""
    p, r = R.pay(F.coalesce(F.nullif(T.blank("pay_text"), F.lit("")), T.blank("description"))), R.role_type("title", "description")
    lacks = F.col("pay_min").isNull() & F.col("pay_max").isNull()
    named = T.blank("pay_text") != ""
    fill = (lacks | named) & p.getField("low").isNotNull()
    return jobs.withColumns({
        "pay_min": F.when(fill, p.getField("low")).otherwise(F.col("pay_min")), "pay_max": F.when(fill, p.getField("high")).otherwise(F.col("pay_max")), "pay_period": F.when(fill, p.getField("period")).otherwise(F.col("pay_period")),
        "role_type": F.when(T.blank("role_type").isin("", "UNKNOWN"), r.getField("type")).otherwise(F.col("role_type")),
    })


def valid_record(structured: Column) -> Column:
    """The gate for stored postings: a title that holds, a URL, a destination that is no other page, and some content."""
    some = (T.blank("description") != "") | (T.blank("location") != "") | (T.blank("posted_date") != "") | F.col("pay_min").isNotNull()
    title = R.valid_title("title") | (structured & R.valid_structured_title("title"))
    return title & (T.blank("source_url") != "") & (structured | (R.destination_reason("source_url") == "")) & some
