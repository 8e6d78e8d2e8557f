"""Queries over landed pages and evidence: cards, script values, feeds, registered domains, what is filled in of companies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pages as P
from ..operators import company_info as C
from ..operators import domains, runs
from ..sources import cards, feeds
from .queries import query, t


@query()
def page_cards(spark, sf):
    """Every card of every page with its title, link and signals; the tests hold it against a plain tree."""
    return cards.cards(t(spark, sf, "pages")).select("page_id", "ord", "title", "href", "location", "document", "signal", F.length("text").cast("bigint").alias("n_chars"))


@query("""SELECT page_id, CASE WHEN json_valid(v) THEN json_extract_string(v, '$') END AS value, length(v) AS n_raw FROM (SELECT page_id, regexp_extract(html, 'var\\s+t\\s*=\\s*("(?:[^"\\\\]|\\\\.)*")', 1) AS v FROM pages)""")
def script_values(spark, sf):
    """The value that a page's script assigns to t."""
    value = P.assigned_json("html", r"var\s+t\s*=\s*")
    return t(spark, sf, "pages").select("page_id", F.try_variant_get(value, "$", "string").alias("value"), F.coalesce(F.length(F.to_json(value)), F.lit(0)).cast("bigint").alias("n_raw"))


_PATHS = ", ".join(f"'{p}'" for p in ("/feed", "/rss", "/rss.xml", "/jobs/rss", "/jobs/feed", "/careers/rss", "/careers/feed", "/employment/rss", "/employment/feed"))


@query(f"""WITH b AS (SELECT DISTINCT page_id % 50 AS company, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS base FROM pages)
SELECT DISTINCT company, base || path AS url, 'well-known' AS how FROM b, (SELECT unnest([{_PATHS}]) AS path) WHERE base <> ''""")
def feed_candidates(spark, sf):
    """Where the feeds of fifty companies may be, by their pages (none of which declares one)."""
    return feeds.candidates(t(spark, sf, "pages").withColumn("company", F.col("page_id") % 50), "company", "page_id").select("company", "url", "how")


@query("""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM pages), l AS (SELECT page_id, host, string_split(host, '.') AS p FROM h)
SELECT page_id, CASE WHEN len(p) > 3 AND (host LIKE '%.example.com' OR host LIKE '%.example.org') AND NOT host LIKE '%.keep.example.org' THEN array_to_string(p[-4:], '.') WHEN host LIKE '%.example.com' OR host LIKE '%.example.org' THEN host
 WHEN len(p) > 2 AND host LIKE '%.net' THEN array_to_string(p[-2:], '.') WHEN host LIKE '%.com' OR host LIKE '%.org' OR host LIKE '%.net' THEN array_to_string(p[-2:], '.') ELSE host END AS registered_domain FROM l""")
def registered_domains(spark, sf):
    """By five rules: com, org, net, and any label below example.com and example.org as a suffix of its own."""
    rules = spark.createDataFrame([("com", False, False), ("org", False, False), ("net", False, False), ("example.com", True, False), ("example.org", True, False)], "suffix string, wild boolean, exempt boolean")
    return domains.registered_domains(t(spark, sf, "pages"), F.col("url"), rules).select("page_id", "registered_domain")


@query("""WITH r AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'https://www.site' || c_custkey || '.com/' ELSE 'https://www.facebook.com/x' END AS site, c_custkey % 6 = 4 AS verified, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'x' ELSE 'Ely' END AS city,
 CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'https://acme.wd5.myworkdayjobs.com/b' END AS board, CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'Greenhouse' ELSE 'Workday' END AS platform FROM customer),
b AS (SELECT *, site = '' OR site LIKE '%facebook%' AS site_bad, length(city) < 2 AS city_bad, platform = '' OR (board <> '' AND platform <> 'Workday') AS platform_bad FROM r),
n AS (SELECT *, site_bad OR NOT verified AS ms, board = '' AS mb FROM b),
d AS (SELECT *, platform_bad AND board <> '' AS short FROM n WHERE ms OR mb OR platform_bad OR city_bad),
o AS (SELECT *, ms OR mb OR city_bad OR (platform_bad AND NOT short) AS goes_on, k % 11 <> 0 AS has_site FROM d),
e AS (SELECT *, CASE WHEN goes_on AND has_site THEN 'https://www.site' || k || '.com' ELSE '' END AS new_site, CASE WHEN goes_on AND has_site AND city_bad AND k % 13 <> 0 THEN 'Rome' ELSE '' END AS new_city,
 CASE WHEN goes_on AND has_site AND (mb OR (platform_bad AND NOT short)) AND k % 2 = 0 THEN 'https://boards.greenhouse.io/acme' ELSE '' END AS new_board FROM o),
f AS (SELECT *, CASE WHEN new_board <> '' THEN 'Greenhouse' WHEN short THEN 'Workday' ELSE '' END AS new_platform FROM e),
a AS (SELECT *, CASE WHEN new_site <> '' AND site_bad THEN new_site ELSE site END AS a_site, verified OR (new_site <> '' AND site_bad) AS a_verified, CASE WHEN new_city <> '' THEN new_city ELSE city END AS a_city, CASE WHEN new_board <> '' AND board = '' THEN new_board ELSE board END AS a_board,
 CASE WHEN new_platform <> '' AND (platform = '' OR platform <> new_platform) THEN new_platform ELSE platform END AS a_platform FROM f),
z AS (SELECT *, a_site = '' OR a_site LIKE '%facebook%' OR NOT a_verified AS rs, a_board = '' AS rb, a_platform = '' OR (a_board LIKE '%workday%' AND a_platform <> 'Workday') OR (a_board LIKE '%greenhouse%' AND a_platform <> 'Greenhouse') AS rp, length(a_city) < 2 AS rc FROM a)
SELECT k AS id, a_site AS official_website, a_city AS city, a_board AS job_board_url, a_platform AS job_platform, a_verified AS website_verified, CASE WHEN rs OR rb OR rp OR rc THEN 'Partial' ELSE 'Completed' END AS search_status,
 CASE WHEN a_site <> site OR a_city <> city OR a_board <> board OR a_platform <> platform OR a_verified <> verified THEN 'updated' WHEN (rs AND ms) OR (rb AND mb) OR (rp AND platform_bad) OR (rc AND city_bad) THEN 'no_information_found' ELSE 'unchanged' END AS outcome FROM z""")
def company_refresh(spark, sf):
    """Records with gaps, what evidence fills, and how each ended. A site that differs by a slash at its end stays as it is."""
    k = F.col("c_custkey")
    text = lambda *cases: F.coalesce(*(F.when(test, F.lit(v) if isinstance(v, str) else v) for test, v in cases), F.lit(""))
    companies = t(spark, sf, "customer").select(
        k.alias("id"), k.cast("string").alias("group_key"), F.col("c_name").alias("name"), text((k % 3 == 1, F.concat(F.lit("https://www.site"), k.cast("string"), F.lit(".com/"))), (k % 3 == 2, "https://www.facebook.com/x")).alias("official_website"),
        (k % 6 == 4).alias("website_verified"), text((k % 5 == 1, "x"), (k % 5 > 1, "Ely")).alias("city"), F.lit("CO").alias("state"), text((k % 4 > 0, "https://acme.wd5.myworkdayjobs.com/b")).alias("job_board_url"),
        text((k % 7 == 1, "Greenhouse"), (k % 7 > 1, "Workday")).alias("job_platform"), F.lit("https://acme.com/careers").alias("careers_page_url"), F.lit("A bank that has served its town for a hundred years.").alias("company_description"), F.lit("Banking").alias("industry"),
    )
    row = lambda field, test, value, rank: t(spark, sf, "customer").where(test).select(k.cast("string").alias("group_key"), F.lit(field).alias("field"), value.alias("value"), F.lit("page").alias("source"), F.lit(rank).alias("rank"))
    evidence = row("official_website", k % 11 != 0, F.concat(F.lit("https://www.site"), k.cast("string"), F.lit(".com")), 1).unionByName(row("city", k % 13 != 0, F.lit("Rome"), 1)).unionByName(row("job_board_url", k % 2 == 0, F.lit("https://boards.greenhouse.io/acme"), 3))
    flags = {"accepted": F.lit(True), "lists_jobs": F.lit(False), "failed": F.lit(False)}
    return C.refresh(companies, evidence.withColumns(flags)).select("id", *(F.col(f"after.{c}").alias(c) for c in ("official_website", "city", "job_board_url", "job_platform", "website_verified", "search_status")), "outcome")


@query("""WITH RECURSIVE e AS (SELECT user_id % 300 AS run, event_id, (['Queued', 'Running', 'Running', 'Cancelling', 'Completed', 'Failed', 'Unknown', 'Skipped', 'Running', 'Cancelled'])[CAST(event_id * 7 % 10 AS INTEGER) + 1] AS s,
 CAST(event_id % 100 AS INTEGER) AS progress, row_number() OVER (PARTITION BY user_id % 300 ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id % 300) AS n FROM events),
f AS (SELECT DISTINCT run, n, CAST(0 AS BIGINT) AS i, '' AS status, CAST(NULL AS INTEGER) AS progress, CAST(0 AS BIGINT) AS refused FROM e
 UNION ALL SELECT f.run, f.n, e.i, CASE WHEN ok THEN e.s ELSE f.status END, CASE WHEN ok THEN e.progress ELSE f.progress END, f.refused + CASE WHEN ok THEN 0 ELSE 1 END
 FROM f JOIN e ON e.run = f.run AND e.i = f.i + 1, LATERAL (SELECT (f.status = '' AND e.s IN ('Queued', 'Running', 'Skipped')) OR (f.status = 'Queued' AND e.s IN ('Running', 'Cancelling', 'Cancelled', 'Failed'))
  OR (f.status = 'Running' AND e.s IN ('Running', 'Cancelling', 'Completed', 'Failed', 'Cancelled')) OR (f.status = 'Cancelling' AND e.s IN ('Cancelling', 'Cancelled', 'Completed', 'Failed')) AS ok) x)
SELECT run, status, progress, n AS n_events, refused AS n_refused FROM f WHERE i = n""")
def run_states(spark, sf):
    """Runs folded from their event log; what may not follow is refused."""
    k = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, ("Queued", "Running", "Running", "Cancelling", "Completed", "Failed", "Unknown", "Skipped", "Running", "Cancelled"))), (k * 7 % 10 + 1).cast("int"))
    log = t(spark, sf, "events").select((F.col("user_id") % 300).alias("run"), "event_id", status.alias("status"), (k % 100).cast("int").alias("progress"))
    return runs.fold_events(log, "run", "event_id", "status", ("progress",)).select("run", "status", F.col("last.progress").alias("progress"), "n_events", "n_refused")
