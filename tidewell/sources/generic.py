"""Boards without an interface of their own: postings from landed pages.

A page with JobPosting data gives those; any other gives its links, each judged by its label, its destination, what stands around it and
above it. Every candidate comes out with its verdict, so what was rejected can be read like what was kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import pages as P
from ..functions import rules as R
from ..functions import status as S
from ..functions import text as T
from ..functions import url as U


def candidates(pages: DataFrame) -> DataFrame:
    """(page_id, ord, title, url, location, pay, accepted, reason) for every link of the pages (page_id, url, html) and every JobPosting item.

    On pages with JobPosting items the links do not count. Of links with one URL on a page the first that is accepted is kept.
    """
    flat = P.flatten(pages)
    items = P.job_postings(flat)
    value = lambda *paths: F.coalesce(*(F.nullif(T.squash(F.try_variant_get("item", p, "string")), F.lit("")) for p in paths), F.lit(""))
    place = "$.jobLocation.address.address"
    title = T.job_title(value("$.title"))
    city = F.concat_ws(", ", *(F.nullif(value(f"{place}{k}"), F.lit("")) for k in ("Locality", "Region")))
    urls = flat.select("page_id", F.col("url").alias("page_url"))
    named = items.join(urls, "page_id").select(
        "page_id", F.lit(None).cast("int").alias("ord"), title.alias("title"), F.coalesce(F.nullif(value("$.url"), F.lit("")), U.position_anchor("page_url", title)).alias("url"), city.alias("location"),
        value("$.description").alias("near"), F.when(R.valid_structured_title(title), F.struct(F.lit(True).alias("accepted"), F.lit("structured posting data").alias("reason"))).otherwise(F.struct(F.lit(False).alias("accepted"), R.title_rejection(title).alias("reason"))).alias("v"),
    )
    context = U.careers_context("url", "h1", "title") != ""
    links = flat.join(items.select("page_id").distinct(), "page_id", "left_anti").select("page_id", F.col("url").alias("page_url"), context.alias("careers"), F.posexplode("links").alias("ord", "l")).select("page_id", "page_url", "careers", "ord", "l.*")
    label = T.job_title("label")
    listed = P.in_job_list("around") | (F.col("section") != "")
    verdict = R.evidence(label, F.col("url"), P.chrome_reason("around"), listed, R.metadata_signals("near"), F.lit(False), F.col("page_url"), F.lower("url").rlike(r"\.pdf($|\?)"), F.col("careers"))
    judged = links.select("page_id", "ord", label.alias("title"), "url", S.city_state("near").alias("location"), "near", verdict.alias("v"))
    bad_title = F.col("v.accepted") & ~R.valid_title("title")
    judged = judged.withColumn("v", F.when(bad_title, F.struct(F.lit(False).alias("accepted"), R.title_rejection("title").alias("reason"))).otherwise(F.col("v")))
    turn = F.row_number().over(W.partitionBy("page_id", "url", "v.accepted").orderBy("ord"))
    again = judged.withColumn("v", F.when(F.col("v.accepted") & (turn > 1), F.struct(F.lit(False).alias("accepted"), F.lit("duplicate job URL").alias("reason"))).otherwise(F.col("v")))
    return again.unionByName(named).select("page_id", "ord", "title", "url", "location", R.pay("near").alias("pay"), "v.accepted", "v.reason")


def verdicts(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(page_id, saved, rejected, doubt) of every page: ``doubt`` says why a page that gave no posting does not prove that there is none."""
    counts = found.groupBy("page_id").agg(F.count_if("accepted").alias("saved"), F.count_if(~F.col("accepted")).alias("rejected"))
    flat = P.flatten(pages).select("page_id", "text", F.exists("links", lambda x: P.in_job_list(x.getField("around"))).alias("listed"))
    met = pages.select("page_id", "url", "html").join(flat, "page_id").join(counts, "page_id", "left").fillna(0, ["saved", "rejected"])
    doubt = S.zero_doubt("url", R.soft_404("text"), P.says_none("text"), P.unrendered("html", "text"), F.when(F.col("listed"), "job list").otherwise(""))
    return met.select("page_id", "saved", "rejected", F.when(F.col("saved") > 0, "").otherwise(doubt).alias("doubt"))
