"""Queries for states, record changes and posting URLs, each beside its SQL.

Where the driver's tables hold no such values (vendor URLs, labels of pages), fixed examples are dealt over their rows by key, so that
every branch is reached.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import rules as R
from ..functions import status as S
from ..functions import url as U
from ..operators import discovery as D
from ..operators import paging
from ..operators import records as K
from .queries import query, t


def q(s: str) -> str:
    """A SQL literal."""
    return "'" + s.replace("'", "''") + "'"


def dealt(values: tuple[str, ...], key: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def dealt_sql(values: tuple[str, ...], key: str) -> str:
    return f"([{', '.join(map(q, values))}])[CAST({key} % {len(values)} AS INTEGER) + 1]"


# ---- posting URLs -----------------------------------------------------------------------------------------------------------

#: # becomes the row's key.
URLS = (
    "https://x.com/a?jobId=#", "https://x.com/a?page=2&REQ_ID=R-#&x=1", "https://x.com/a?posting_id=A%20#", "https://x.com/a?jobcode=#", "https://x.com/a?JVI=j#", "https://x.com/a?gh_jid=#", "https://x.com/jobs/teller-#.html",
    "https://x.com/opportunities/#", "https://x.com/requisitions/REQ_#", "https://x.com/vacancies/branch-manager", "https://x.com/careers/jobs/#", "https://x.com/careers/employee-benefits", "https://x.com/about/#", "x.com/jobs/#",
    "https://boards.greenhouse.io/acme/jobs/#", "https://jobs.lever.co/acme/01234567-89ab-cdef-0123-456789abcdef#", "https://a.wd5.myworkdayjobs.com/en/job/x_#", "https://c-a.icims.com/jobs/#/x", "https://notgreenhouse.io/jobs/#",
    "https://recruiting.ultipro.com/a/OpportunityDetail?opportunityId=#", "https://workforcenow.adp.com/x?jobId=#", "https://jobs.smartrecruiters.com/acme/74399990#", "https://jobs.smartrecruiters.com/acme/1", "https://a.bamboohr.com/careers/#",
    "https://secure.saashr.com/ta/x.jobs", "https://a.hrmdirect.com/employment/job-opening.php?req=#", "https://jobs.dayforcehcm.com/en-US/acme/PORTAL/jobs/#", "https://jobs.dayforcehcm.com/acme/PORTAL", "http://jobs.dayforcehcm.com/acme/PORTAL",
    "https://jobs.dayforcehcm.com:443/fr-CA/acme/P-1/", "https://jobs.dayforcehcm.com/", " https://recruiting.paylocity.com/recruiting/jobs/Details/#/x ", "",
)


def _url(key: str) -> Column:
    return F.replace(dealt(URLS, key), F.lit("#"), F.col(key).cast("string"))


#: What the SQL looks for, as the tracked source states it: query keys, anchors, careers segments, vendors' shapes. Fixed values, written out here and not taken from the library.
_KEYS = ("jobid", "job_id", "reqid", "req_id", "requisitionid", "requisition_id", "postingid", "posting_id", "jobcode", "job_code", "jvi", "jobreqid", "opportunityid", "vacancyid")
_ANCHORS = (
    "job", "jobs", "career", "careers", "opening", "openings", "opportunity", "opportunities", "position", "positions", "posting", "postings", "requisition", "requisitions", "vacancy", "vacancies", "apply", "employment",
)
_CAREERS = (
    "career", "careers", "job", "jobs", "employment", "opening", "openings", "opportunity", "opportunities", "join-our-team", "join-us", "work-with-us", "workhere", "work-here", "hiring", "recruiting", "recruitment", "vacancy", "vacancies",
    "positions", "apply",
)
_SHAPES = (
    ("greenhouse.io", r"/jobs/\d+"), ("lever.co", r"/[^/]+/[0-9a-f]{8}-[0-9a-f-]{27,}"), ("myworkdayjobs.com", r"/job/"), ("icims.com", r"/jobs/\d+"), ("applicantpro.com", r"/jobs/\d+"), ("isolvedhire.com", r"/jobs/\d+"),
    ("ultipro.com", r"/opportunitydetail"), ("workforcenow.adp.com", r"/recruitment/recruitment\.html|jobid="), ("recruiting.adp.com", r"/srccar/public/"), ("paycomonline.net", r"/viewjobdetails|/jobs/\d+"),
    ("recruitingbypaycor.com", r"/career/jobintroduction"), ("paylocity.com", r"/details/\d+"), ("jobs.dayforcehcm.com", r"/jobs/\d+"), ("csod.com", r"/requisition/\d+|/jobdetails"), ("hrmdirect.com", r"/employment/job-opening\.php"),
    ("applytojob.com", r"/apply/"), ("jazzhr.com", r"/apply/"), ("smartrecruiters.com", r"/\d{9,}"), ("jobvite.com", r"/job/"), ("bamboohr.com", r"/careers/\d+"), ("successfactors.com", r"/job/"), ("oraclecloud.com", r"/job/"),
    ("saashr.com", r"/ta/|/jobdetail"),
)


def _requisition_sql() -> str:
    keys = " ".join(f"WHEN regexp_extract(qs, '(?i)(?:^|&){k}=([^&]+)', 1) <> '' THEN url_decode(regexp_extract(qs, '(?i)(?:^|&){k}=([^&]+)', 1))" for k in _KEYS)
    anchors, away = ", ".join(map(q, _ANCHORS)), ", ".join(map(q, (*_ANCHORS, *_CAREERS)))
    vendor = " ".join(f"WHEN (h = '{d}' OR suffix(h, '.{d}')) AND regexp_matches(route || '?' || qs, {q('(?i)' + p)}) THEN '{d}'" for d, p in _SHAPES)
    board = "regexp_extract(route, '(?i)^/(?:([A-Za-z]{2,3}(?:-[A-Za-z]{2})?)/)?([A-Za-z0-9_-]+)/([A-Za-z0-9_-]+)(?:/jobs/[0-9]+)?/?$', "
    return f"""WITH u AS (SELECT p_partkey, trim(replace({dealt_sql(URLS, "p_partkey")}, '#', CAST(p_partkey AS VARCHAR))) AS url FROM part),
v AS (SELECT *, CASE WHEN contains(url, '://') THEN url ELSE 'https://' || url END AS full_url FROM u),
w AS (SELECT *, regexp_extract(full_url, '^[a-z]+://([^/?#]*)', 1) AS authority, regexp_extract(full_url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS route, regexp_extract(full_url, '^[^?#]*\\?([^#]*)', 1) AS qs FROM v),
s AS (SELECT *, CASE WHEN contains(url, '://') THEN regexp_extract(authority, '^([^:]*)', 1) ELSE '' END AS h,
 list_filter(list_transform(string_split(route, '/'), lambda x: regexp_replace(lower(trim(x)), '\\.(html?|aspx?|php|jsp|cfm)$', '')), lambda x: x <> '') AS seg FROM w),
b AS (SELECT *, list_filter(list_transform(seg, lambda x, i: CASE WHEN i > 1 AND seg[i - 1] IN ({anchors}) AND x NOT IN ({away}) THEN x END), lambda x: x IS NOT NULL) AS behind FROM s),
c AS (SELECT *, list_filter(behind, lambda x: regexp_matches(x, '[0-9]') AND regexp_matches(x, '^[A-Za-z0-9][A-Za-z0-9._-]{{1,63}}$')) AS numbered FROM b)
SELECT p_partkey, CASE {keys} ELSE coalesce(numbered[1], '') END AS requisition,
 coalesce(list_filter(behind, lambda x: NOT regexp_matches(x, '[0-9]') AND regexp_matches(x, '^[a-z0-9]+(?:-[a-z0-9]+)+$'))[1], '') AS slug, CASE {vendor} ELSE '' END AS vendor,
 CASE WHEN suffix(url, '') AND regexp_matches(url, '^https://jobs\\.dayforcehcm\\.com(:443)?(/|$)') AND {board}0) <> '' THEN 'https://jobs.dayforcehcm.com/' || coalesce(nullif({board}1), ''), 'en-US') || '/' || {board}2) || '/' || {board}3) ELSE url END AS board FROM c"""


@query(_requisition_sql())
def posting_urls(spark, sf):
    """What a posting's URL says: requisition id, slug, vendor by its shape, and the board's root."""
    u = t(spark, sf, "part").select("p_partkey", _url("p_partkey").alias("url"))
    return u.select("p_partkey", U.requisition("url").alias("requisition"), U.posting_slug("url").alias("slug"), U.detail_vendor("url").alias("vendor"), U.canonical_board("url").alias("board"))


LABELS = ("Bank Teller", "Contact us", "a@b.com", "https://b.com", "555-123-4567", "We are hiring", "Loan Officer, Austin, TX", "Page not found", "", "Branch Manager")
TARGETS = (
    "https://b.com/jobs/teller-104", "https://b.com/careers/commercial-lender", "https://www.facebook.com/x", "#top", "mailto:a@b.c", "https://b.com/", "https://b.com/locations", "https://boards.greenhouse.io/a/jobs/7",
    "https://b.com/careers/teller-role", "https://b.com/files/teller", "",
)
CHROME = ("", "", "", "inside <header> site chrome")
SAID = ("Department: Retail", "", "Full-time in Austin, TX", "$20 per hour", "nothing")
_KEY = "o_orderkey"


def _evidence_sql() -> str:
    text = """CASE WHEN label = '' THEN '' WHEN regexp_matches(label, '^[^@\\s]+@[^@\\s]+\\.[A-Za-z]{2,}$') THEN 'email address, not a job title' WHEN regexp_matches(label, '(?i)^(?:https?://|www\\.)\\S+$') THEN 'bare URL, not a job title'
 WHEN regexp_matches(label, '^[-+().\\s\\d]{7,}$') THEN 'phone number, not a job title' WHEN label = 'Page not found' THEN 'error/placeholder page text ("page not found")' WHEN label = 'Contact us' THEN 'marketing call to action ("contact us")'
 WHEN label = 'We are hiring' THEN 'marketing sentence, not a job title' ELSE '' END"""
    place = """CASE WHEN target = '' THEN '' WHEN target[1] = '#' THEN 'in-page anchor, not a posting URL' WHEN starts_with(target, 'mailto:') THEN 'mailto: link, not a posting URL'
 WHEN contains(target, 'facebook.com') THEN 'social/aggregator link (facebook.com)' WHEN target = 'https://b.com/' THEN 'site root, not a posting URL' WHEN target = 'https://b.com/locations' THEN 'branch/ATM link' ELSE '' END"""
    return f"""WITH c AS (SELECT o_orderkey, {dealt_sql(LABELS, _KEY)} AS label, {dealt_sql(TARGETS, f"({_KEY} // 10)")} AS target, {dealt_sql(CHROME, f"({_KEY} // 110)")} AS chrome,
 {dealt_sql(SAID, "(o_orderkey // 7)")} AS said, o_orderkey % 7 < 3 AS in_list, o_orderkey % 53 > 47 AS structured, o_orderkey % 53 < 10 AS document, o_orderstatus = 'F' AS careers FROM orders),
v AS (SELECT *, {text} AS by_text, {place} AS by_place, said NOT IN ('', 'nothing') AS known, target IN ('https://b.com/careers/commercial-lender', 'https://b.com/careers/teller-role') AS slug FROM c)
SELECT o_orderkey, CASE WHEN chrome <> '' THEN chrome WHEN by_text <> '' THEN by_text WHEN by_place <> '' THEN by_place WHEN structured THEN 'structured posting data' WHEN contains(target, 'greenhouse.io') THEN 'greenhouse.io posting URL'
 WHEN target = 'https://b.com/jobs/teller-104' THEN 'requisition id in the URL' WHEN in_list AND known THEN 'job list with posting metadata' WHEN slug AND in_list THEN 'posting slug in a job list'
 WHEN slug AND known AND careers THEN 'posting slug with metadata on a careers page' WHEN document AND (in_list OR careers) THEN 'job description document'
 ELSE 'missing evidence: ' || concat_ws(', ', CASE WHEN NOT in_list THEN 'job list' END, CASE WHEN NOT known THEN 'posting metadata' END, 'requisition id') END AS reason,
 chrome = '' AND by_text = '' AND by_place = '' AND (structured OR contains(target, 'greenhouse.io') OR target = 'https://b.com/jobs/teller-104' OR (in_list AND known) OR (slug AND (in_list OR (known AND careers))) OR (document AND (in_list OR careers))) AS accepted FROM v"""


@query(_evidence_sql())
def evidence_cases(spark, sf):
    """The evidence verdict over every combination of labels, targets and surroundings."""
    k = F.col("o_orderkey")
    o = t(spark, sf, "orders").withColumns({"k7": F.floor(k / 7), "k10": F.floor(k / 10), "k110": F.floor(k / 110)})
    c = o.select("o_orderkey", "o_orderstatus", dealt(LABELS, "o_orderkey").alias("label"), dealt(TARGETS, "k10").alias("target"), dealt(CHROME, "k110").alias("chrome"), dealt(SAID, "k7").alias("said"))
    v = R.evidence(F.col("label"), F.col("target"), F.col("chrome"), k % 7 < 3, R.metadata_signals("said"), k % 53 > 47, F.lit("https://b.com/careers"), k % 53 < 10, F.col("o_orderstatus") == "F")
    return c.select("o_orderkey", v.alias("v")).select("o_orderkey", "v.reason", "v.accepted")


#: Board, the platform that its URL shows, and who collects it, as the tracked source decides. Fixed values, written out here and not taken from the library.
ROUTED = (
    ("https://a.workforcenow.adp.com/x", "ADP Workforce Now", "Generic"), ("https://a.recruiting.adp.com/x", "ADP Recruiting", "Generic"), ("https://a.myworkdayjobs.com/x", "Workday", "Workday"), ("https://a.wd1.myworkdayjobs.com/x", "Workday", "Workday"),
    ("https://a.wd5.myworkdayjobs.com/x", "Workday", "Workday"), ("https://a.greenhouse.io/x", "Greenhouse", "Greenhouse"), ("https://a.boards.greenhouse.io/x", "Greenhouse", "Greenhouse"), ("https://a.lever.co/x", "Lever", "Lever"),
    ("https://a.jobs.lever.co/x", "Lever", "Lever"), ("https://a.icims.com/x", "ICIMS", "ICIMS"), ("https://a.paylocity.com/x", "Paylocity", "Paylocity"), ("https://a.ukg.com/x", "UKG", "UKG"), ("https://a.ultipro.com/x", "UKG", "UKG"),
    ("https://a.adp.com/x", "ADP Workforce Now", "ADP"), ("https://a.bamboohr.com/x", "BambooHR", "Generic"), ("https://a.smartrecruiters.com/x", "SmartRecruiters", "Generic"), ("https://a.jobvite.com/x", "Jobvite", "Generic"),
    ("https://a.paycomonline.net/x", "Paycom", "Paycom"), ("https://a.recruitingbypaycor.com/x", "Paycor", "Paycor"), ("https://a.applicantpro.com/x", "ApplicantPro", "ApplicantPro"), ("https://a.saashr.com/x", "UKG Ready", "UKG Ready"),
    ("https://a.oraclecloud.com/x", "Oracle Recruiting", "Generic"), ("https://a.successfactors.com/x", "SAP SuccessFactors", "Generic"), ("https://a.isolvedhire.com/x", "isolved Hire", "isolved Hire"), ("https://a.jazzhr.com/x", "JazzHR", "Generic"),
    ("https://a.clearcompany.com/x", "ClearCompany", "Generic"), ("https://a.hrmdirect.com/x", "ClearCompany", "ClearCompany"), ("https://a.paycor.com/x", "Paycor", "Paycor"), ("https://a.app.joinhandshake.com/x", "Handshake", "Generic"),
    ("https://a.jobs.dayforcehcm.com/x", "Dayforce", "Dayforce"), ("https://a.csod.com/x", "Cornerstone", "Cornerstone"), ("https://workforcenow.adp.com/m?cid=1&ccId=2", "ADP Workforce Now", "ADP"), ("jobs.lever.co/acme", "Lever", "Lever"), ("https://example.com/jobs", "", ""), ("", "", ""),
)
BOARDS = tuple(url for url, _, _ in ROUTED)
#: Stored names, and who collects a board whose URL shows no platform.
BY_NAME = (("", "Generic"), ("Dayforce", "Dayforce"), ("UKG Ready", "UKG Ready"), ("iCIMS", "ICIMS"), ("unknown", "Generic"), ("ADP Workforce Now", "ADP"))
STORED = tuple(name for name, _ in BY_NAME)


def _route_sql() -> str:
    of = lambda k: dealt_sql(tuple(r[k] for r in ROUTED), "s_suppkey")
    named = dealt_sql(tuple(c for _, c in BY_NAME), "(s_suppkey // 35)")
    return f"SELECT s_suppkey, {of(1)} AS platform, CASE WHEN {of(2)} <> '' THEN {of(2)} ELSE {named} END AS collector FROM supplier"


@query(_route_sql())
def board_routes(spark, sf):
    """Platform and collector of boards of all vendors."""
    b = t(spark, sf, "supplier").withColumn("k", F.floor(F.col("s_suppkey") / 35)).select("s_suppkey", dealt(BOARDS, "s_suppkey").alias("url"), dealt(STORED, "k").alias("stored"))
    return b.select("s_suppkey", U.platform("url").alias("platform"), R.collector("url", "stored").alias("collector"))


# ---- states -----------------------------------------------------------------------------------------------------------------

FILTERS = ("All application statuses", "Not applied", "Not interested", "Applied", "Interview")


@query(f"""WITH a AS (SELECT o_orderkey, o_orderstatus = 'F' AS applied, o_orderkey % 7 = 0 AS away, CASE WHEN o_orderkey % 3 = 0 THEN 'Interview' WHEN o_orderkey % 3 = 1 THEN 'Applied' END AS status, {dealt_sql(FILTERS, "o_orderkey")} AS wanted FROM orders)
SELECT o_orderkey, CASE wanted WHEN 'All application statuses' THEN true WHEN 'Not applied' THEN NOT applied AND NOT away WHEN 'Not interested' THEN away WHEN 'Applied' THEN applied OR coalesce(status, '') = 'Applied' ELSE coalesce(status, '') = wanted END AS shown FROM a""")
def application_filter(spark, sf):
    k = F.col("o_orderkey")
    status = F.when(k % 3 == 0, "Interview").when(k % 3 == 1, "Applied")
    return t(spark, sf, "orders").select("o_orderkey", S.application_shown(F.col("o_orderstatus") == "F", k % 7 == 0, status, dealt(FILTERS, "o_orderkey")).alias("shown"))


SITES = ("https://a.com/", "", "https://a.com/careers/", " ")
BOARD_URLS = ("https://a.com/careers", "", "https://jobs.lever.co/a", "https://a.com/login")


@query(f"""WITH c AS (SELECT c_custkey, trim({dealt_sql(SITES, "c_custkey")}) AS careers, CASE WHEN c_nationkey > 12 THEN 'https://a.com' ELSE '' END AS known, {dealt_sql(BOARD_URLS, "(c_custkey // 4)")} AS board, c_acctbal FROM customer),
b AS (SELECT *, regexp_replace(careers, '/+$', '') AS page FROM c)
SELECT c_custkey, (page <> '' OR known <> '') AND (board = '' OR contains(board, 'login') OR (page <> '' AND board = page)) AS needed, page <> '' OR known <> '' AS forced,
 c_acctbal < 0 OR board = '' OR c_custkey % 5 = 0 OR c_custkey % 11 = 0 AS refresh FROM b""")
def discovery_needs(spark, sf):
    k = F.col("c_custkey")
    c = t(spark, sf, "customer").withColumn("k", F.floor(k / 4)).select("c_custkey", "c_acctbal", dealt(SITES, "c_custkey").alias("careers"), F.when(F.col("c_nationkey") > 12, "https://a.com").otherwise("").alias("known"), dealt(BOARD_URLS, "k").alias("board"))
    state = ("careers", F.lit(None).cast("string"), "known", "board", F.contains("board", F.lit("login")))
    method = F.when(k % 5 == 0, S_BY_HAND).otherwise("Static")
    refresh = S.needs_refresh(F.when(F.col("c_acctbal") < 0, "Partial").otherwise("Completed"), "board", method, k % 11 != 0)
    return c.select("c_custkey", S.needs_discovery(*state).alias("needed"), S.needs_discovery(*state, force=True).alias("forced"), refresh.alias("refresh"))


S_BY_HAND = K.BY_HAND
REASONS = ("", "could not verify host", "parked page", "")
NOTES = ("", "company name terms not found; x", "banking/credit union terms not found", "other")
CONFIDENCE = ("High", "Medium", "Low", "None")


@query(f"""WITH a AS (SELECT s_suppkey, s_suppkey % 2 = 0 AS verified, {dealt_sql(REASONS, "(s_suppkey // 2)")} AS reason, {dealt_sql(NOTES, "(s_suppkey // 8)")} AS notes, {dealt_sql(CONFIDENCE, "s_suppkey")} AS confidence, CASE WHEN s_acctbal > 0 THEN 'https://a.com/c' ELSE '' END AS careers, s_nationkey > 12 AS feed FROM supplier)
SELECT s_suppkey, CASE WHEN contains(reason, 'could not verify') THEN 'Failed to Check' WHEN verified AND confidence IN ('High', 'Medium') THEN 'Verified' WHEN reason <> '' THEN 'Likely Incorrect' ELSE 'Needs Review' END AS audit,
CASE WHEN reason <> '' THEN reason WHEN contains(notes, 'company name') THEN 'Website does not contain company name terms.' WHEN contains(notes, 'banking') THEN 'Website does not contain bank or credit union terms.'
 WHEN careers <> '' AND NOT verified THEN 'Careers Page URL exists but Official Website could not be verified.' WHEN verified THEN '' ELSE 'Website could not be confidently verified.' END AS issue,
CASE WHEN verified AND careers <> '' AND confidence IN ('High', 'Medium') THEN 'Completed' WHEN verified AND (careers <> '' OR feed) THEN 'Partial' WHEN verified THEN 'Needs Review' ELSE 'Failed' END AS enrichment,
CASE WHEN notes = '' THEN 'Never Run' WHEN feed THEN 'Running' WHEN notes = 'other' THEN 'Success' ELSE 'Failed' END AS run FROM a""")
def status_verdicts(spark, sf):
    k = F.col("s_suppkey")
    a = t(spark, sf, "supplier").withColumns({"k2": F.floor(k / 2), "k8": F.floor(k / 8)})
    a = a.select("s_suppkey", (k % 2 == 0).alias("verified"), dealt(REASONS, "k2").alias("reason"), dealt(NOTES, "k8").alias("notes"), dealt(CONFIDENCE, "s_suppkey").alias("confidence"), F.when(F.col("s_acctbal") > 0, "https://a.com/c").otherwise("").alias("careers"), (F.col("s_nationkey") > 12).alias("feed"))
    v, site = F.col("verified"), F.when(F.col("verified"), "https://a.com").otherwise("")
    ran = F.when(F.col("notes") == "", None).when(F.col("notes") == "other", "Completed").otherwise("Cancelled")
    return a.select(
        "s_suppkey", S.audit_status(v, F.col("reason") != "", "reason", "confidence").alias("audit"), S.audit_issue(v, "reason", "notes", "careers").alias("issue"),
        S.enrichment_status(site, "careers", "confidence", F.col("feed")).alias("enrichment"), S.run_label(ran, F.col("feed")).alias("run"),
    )


@query("""WITH p AS (SELECT page_id, page_id % 5 AS k, url FROM pages)
SELECT page_id, CASE k WHEN 0 THEN url || ' returned an error/placeholder page ("page not found"); refusing to record an authoritative zero-job result.' WHEN 1 THEN ''
 WHEN 2 THEN url || ' loaded but rendered no listing content (single-page-app shell); refusing to record an authoritative zero-job result.' WHEN 3 THEN ''
 ELSE url || ' rendered no recognizable job-list structure and did not state that there are no openings; the zero-job result is uncertain and is not authoritative.' END AS doubt FROM p""")
def zero_results(spark, sf):
    k = F.col("page_id") % 5
    soft = R.soft_404(F.when(k == 0, "Sorry, page not found").otherwise("Welcome"))
    return t(spark, sf, "pages").select("page_id", S.zero_doubt("url", soft, k == 1, k == 2, F.when(k == 3, "job table header row").otherwise("")).alias("doubt"))


CARDS = ("Teller - Austin, TX full time", "O'Fallon, MO", "Remote", "  St. Paul,  MN", "Paris, France", "")


@query(rf"SELECT l_orderkey, l_linenumber, trim(regexp_replace(regexp_extract({dealt_sql(CARDS, 'l_orderkey')}, '([A-Za-z .''-]+,\s*[A-Z]{{2}})\b', 1), '\s+', ' ', 'g')) AS place FROM lineitem")
def card_locations(spark, sf):
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.city_state(dealt(CARDS, "l_orderkey")).alias("place"))


LISTS = ('["a","b c"]', '["a",1,null,"é"]', '{"a":1}', "not json", "", '[]', '[["x"],"y"]')


@query(f"SELECT event_id, ([['a','b c'],['a','é'],[],[],[],[],['y']])[CAST(event_id % {len(LISTS)} AS INTEGER) + 1] AS items FROM events")
def json_string_lists(spark, sf):
    return t(spark, sf, "events").select("event_id", S.json_strings(dealt(LISTS, "event_id")).alias("items"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, CAST(l_orderkey % 30 AS INTEGER) AS n, CAST(l_linenumber AS INTEGER) AS c FROM lineitem), x AS (SELECT *, CASE WHEN n > 7 THEN [1, n, c - 1, c, c + 1] || CASE WHEN c <= 3 THEN [2, 3, 4] ELSE [] END || CASE WHEN c >= n - 2 THEN [n - 1, n - 2, n - 3] ELSE [] END ELSE range(1, n + 1) END AS a FROM p)
SELECT l_orderkey, l_linenumber, array_to_string(list_sort(list_distinct(list_filter(a, lambda v: v >= 1 AND v <= n))), ',') AS numbers FROM x""")
def pager_numbers(spark, sf):
    n = S.page_numbers(F.col("l_linenumber").cast("int"), (F.col("l_orderkey") % 30).cast("int"))
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(n, ",").alias("numbers"))


_MATCHES = "WITH m AS (SELECT o_orderkey, c_name, o_orderpriority, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 101 END AS score, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Matched' WHEN 2 THEN 'Needs Rematch' ELSE 'Match Failed' END AS status FROM orders JOIN customer ON c_custkey = o_custkey) "
_MATCH_SORTS = {
    "Company": ("All statuses", "c_name, o_orderpriority, o_orderkey"), "Lowest match": ("Matched", "coalesce(score, 101), o_orderkey"), "Best match": ("Not Matched", "coalesce(score, -1) DESC, c_name, o_orderkey"),
}


def _match_list(sort: str, wanted: str):
    def run(spark, sf):
        k = F.col("o_orderkey")
        m = t(spark, sf, "orders").join(t(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
        m = m.select("o_orderkey", "c_name", "o_orderpriority", F.when(k % 4 > 0, k % 101).alias("score"), F.when(k % 4 == 1, "Matched").when(k % 4 == 2, "Needs Rematch").when(k % 4 == 3, "Match Failed").alias("status"))
        m = m.where(S.match_shown("c_name", "o_orderpriority", "status", "URGENT", wanted))
        return paging.page_of(m, [*S.match_order(sort, F.col("score"), F.col("c_name"), F.col("o_orderpriority")), F.asc("o_orderkey")], 1, 50).select("o_orderkey", "c_name", "score")

    run.__name__ = f"match_list_{sort.split()[0].lower()}"
    run.__doc__ = f"First 50 matches by {sort}."
    return run


for _sort, (_wanted, _order) in _MATCH_SORTS.items():
    _where = "" if _wanted == "All statuses" else f" AND coalesce(status, 'Not Matched') = '{_wanted}'"
    query(_MATCHES + f"SELECT o_orderkey, c_name, score FROM m WHERE contains(lower(c_name || ' ' || o_orderpriority), 'urgent'){_where} ORDER BY {_order} LIMIT 50")(_match_list(_sort, _wanted))


@query("""WITH o AS (SELECT o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS r, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, o_totalprice FROM o WHERE r > 25 * ((n - 1) // 25)""")
def last_page(spark, sf):
    """A page far beyond the last one is the last one; an odd page size is 25."""
    return paging.page_of(t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.asc("o_totalprice"), F.asc("o_orderkey")], 10**6, 33)


@query("""WITH e AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '')
SELECT o_orderkey FROM e WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def rematch_candidates(spark, sf):
    o = t(spark, sf, "orders").withColumn("s", F.when(F.col("o_orderstatus") == "O", "OPEN").otherwise("closed"))
    done = t(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit("Matched").alias("status")).distinct()
    return K.unmatched(o, done, "o_orderkey", S.rematch_eligible("s", F.col("o_orderkey").cast("string"), "o_orderpriority")).select("o_orderkey")


# ---- record changes ---------------------------------------------------------------------------------------------------------

_COMPANIES = """companies AS (SELECT 'c' || c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'Acme ' || (c_custkey % 70) ELSE c_name END AS name, c_custkey FROM customer)"""


def _companies(spark, sf):
    k = F.col("c_custkey")
    name = F.when(k % 10 == 0, F.concat(F.lit("Acme "), (k % 70).cast("string"))).otherwise(F.col("c_name"))
    return t(spark, sf, "customer").select(
        F.concat(F.lit("c"), k.cast("string")).alias("id"), name.alias("name"), F.when(k % 20 == 0, F.lower(name)).otherwise("").alias("normalizedName"), F.lpad(k.cast("string"), 12, "0").alias("createdAt"), k.alias("c_custkey"),
        F.when(k % 3 == 0, "").otherwise("about").alias("companyDescription"), F.lit("https://a.com").alias("officialWebsite"), F.when(k % 2 == 0, "https://a.com/c").otherwise("").alias("careersPageUrl"), F.lit("").alias("jobBoardUrl"),
        F.lit(True).alias("websiteVerified"), F.lit("Static").alias("jobBoardDiscoveryMethod"), F.lit("Completed").alias("searchStatus"), F.lit("2024-01-01").alias("lastChecked"),
    )


_OWNERS = "owners AS (SELECT lower(name) AS key, arg_min(id, (CASE WHEN c_custkey % 20 = 0 THEN 0 ELSE 1 END) * 1000000000 + c_custkey) AS owner FROM companies GROUP BY 1)"


@query(f"""WITH {_COMPANIES}, {_OWNERS},
new AS (SELECT 's' || s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN '  ' WHEN 1 THEN 'ACME  ' || (s_suppkey % 7 * 10) WHEN 2 THEN 'New ' || (s_suppkey // 10) ELSE s_name END AS name, s_suppkey FROM supplier),
k AS (SELECT *, regexp_replace(lower(trim(name)), '\\s+', ' ', 'g') AS key FROM new), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s_suppkey) AS turn, first(id) OVER (PARTITION BY key ORDER BY s_suppkey) AS ahead FROM k)
SELECT id, CASE WHEN r.key = '' THEN 'invalid' WHEN owner IS NOT NULL OR turn > 1 THEN 'duplicate' ELSE 'created' END AS outcome, CASE WHEN r.key <> '' AND (owner IS NOT NULL OR turn > 1) THEN coalesce(owner, ahead) END AS duplicateOf,
 CASE WHEN s_suppkey % 2 = 0 THEN 'Manual' ELSE 'Not Found' END AS method FROM r LEFT JOIN owners o ON o.key = r.key""")
def company_create(spark, sf):
    k = F.col("s_suppkey")
    name = F.when(k % 5 == 0, "  ").when(k % 5 == 1, F.concat(F.lit("ACME  "), (k % 7 * 10).cast("string"))).when(k % 5 == 2, F.concat(F.lit("New "), F.floor(k / 10).cast("string"))).otherwise(F.col("s_name"))
    new = t(spark, sf, "supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("id"), name.alias("name"), F.lit("https://n.com").alias("companyWebsite"), F.when(k % 2 == 0, "https://b.com").otherwise("").alias("jobBoardUrl"), F.lpad(k.cast("string"), 12, "0").alias("createdAt"))
    return K.create(_companies(spark, sf), new).select("id", "outcome", "duplicateOf", F.col("jobBoardDiscoveryMethod").alias("method"))


@query(f"""WITH {_COMPANIES}, n AS (SELECT lower(name) AS key, count(*) AS n, min(id) AS low FROM companies GROUP BY 1),
p AS (SELECT id AS pid, CASE c_custkey % 8 WHEN 0 THEN name WHEN 2 THEN 'Acme 10' WHEN 4 THEN 'Fresh ' || c_custkey ELSE '' END AS nname, CASE WHEN c_custkey % 16 < 8 THEN 'https://a.com' ELSE 'https://z.com' END AS site, CASE WHEN c_custkey % 2 = 0 THEN 'https://a.com/c' ELSE '' END AS page FROM companies WHERE c_custkey % 2 = 0),
m AS (SELECT c.*, p.*, lower(nname) AS key, coalesce(n.n, 0) AS n, n.low FROM companies c LEFT JOIN p ON pid = id LEFT JOIN n ON n.key = lower(nname)),
s AS (SELECT *, n > 1 OR (n = 1 AND low <> id) AS shared FROM m), o AS (SELECT *, CASE WHEN pid IS NULL THEN NULL WHEN nname = '' THEN 'invalid' WHEN shared AND key <> lower(name) THEN 'duplicate' ELSE 'updated' END AS outcome FROM s)
SELECT id, CASE WHEN outcome = 'updated' THEN nname ELSE name END AS name, coalesce(outcome = 'updated' AND site <> 'https://a.com', false) AS reverify, CASE WHEN outcome = 'updated' AND site <> 'https://a.com' THEN 'Needs Review' ELSE 'Completed' END AS searchStatus,
 CASE WHEN outcome = 'updated' THEN CASE WHEN c_custkey % 20 = 0 AND lower(name) = key THEN key WHEN shared THEN '' ELSE key END WHEN c_custkey % 20 = 0 THEN lower(name) ELSE '' END AS normalizedName, CASE WHEN outcome = 'updated' AND c_custkey % 4 = 0 THEN 'new' WHEN c_custkey % 3 = 0 THEN '' ELSE 'about' END AS companyDescription, outcome FROM o""")
def company_update(spark, sf):
    c = _companies(spark, sf)
    k = F.col("c_custkey")
    name = F.when(k % 8 == 0, F.col("name")).when(k % 8 == 2, "Acme 10").when(k % 8 == 4, F.concat(F.lit("Fresh "), k.cast("string"))).otherwise("")
    patch = c.where(k % 2 == 0).select("id", name.alias("name"), F.when(k % 4 == 0, "new").otherwise("").alias("companyDescription"), F.when(k % 16 < 8, "https://a.com").otherwise("https://z.com").alias("officialWebsite"), "careersPageUrl", "jobBoardUrl")
    return K.update(c, patch).select("id", "name", "reverify", "searchStatus", "normalizedName", "companyDescription", "outcome")


@query(f"""WITH {_COMPANIES}, {_OWNERS},
i AS (SELECT 'c' || (s_suppkey * 3) AS id, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'Name ' || s_suppkey END AS name, 'phone' || s_suppkey AS phone, '' AS fax FROM supplier WHERE s_suppkey % 3 = 0
 UNION ALL SELECT 'x' || s_suppkey, CASE WHEN s_suppkey % 3 = 1 THEN 'acme ' || (s_suppkey % 7 * 10) ELSE 'Other ' || s_suppkey END, 'phone' || s_suppkey, 'fax' FROM supplier WHERE s_suppkey % 3 > 0),
new AS (SELECT i.*, owner FROM i LEFT JOIN owners ON key = lower(name) WHERE id NOT IN (SELECT id FROM companies)), f AS (SELECT owner, arg_min(phone, id) AS phone, min(id) AS iid FROM new WHERE owner IS NOT NULL GROUP BY 1)
SELECT c.id, coalesce(nullif(i.name, ''), c.name) AS name, coalesce(i.phone, CASE WHEN c_custkey % 2 = 0 THEN 'own' END, f.phone, '') AS phone, coalesce(CASE WHEN c_custkey % 5 = 0 THEN 'ownfax' END, CASE WHEN f.iid IS NOT NULL THEN 'fax' END, '') AS fax,
 CASE WHEN i.id IS NOT NULL THEN 'updated by id' WHEN f.owner IS NOT NULL THEN 'filled by name' ELSE 'kept' END AS action FROM companies c LEFT JOIN i ON i.id = c.id LEFT JOIN f ON f.owner = c.id
UNION ALL SELECT id, name, phone, fax, 'added' FROM new WHERE owner IS NULL""")
def company_snapshot(spark, sf):
    s, k = t(spark, sf, "supplier"), F.col("s_suppkey")
    say = lambda head: F.concat(F.lit(head), k.cast("string"))
    known = s.where(k % 3 == 0).select(F.concat(F.lit("c"), (k * 3).cast("string")).alias("id"), F.when(k % 2 == 0, "").otherwise(say("Name ")).alias("name"), say("phone").alias("phone"), F.lit("").alias("fax"))
    other = s.where(k % 3 > 0).select(say("x").alias("id"), F.when(k % 3 == 1, F.concat(F.lit("acme "), (k % 7 * 10).cast("string"))).otherwise(say("Other ")).alias("name"), say("phone").alias("phone"), F.lit("fax").alias("fax"))
    c = F.col("c_custkey")
    stored = _companies(spark, sf).withColumns({"phone": F.when(c % 2 == 0, "own").otherwise(""), "fax": F.when(c % 5 == 0, "ownfax").otherwise("")})
    return K.snapshot_upsert(stored, known.unionByName(other), ["phone", "fax"])


@query("""WITH companies AS (SELECT 'c' || c_custkey AS id, c_name AS name FROM customer), n AS (SELECT lower(name) AS k, max(id) AS named FROM companies GROUP BY 1),
s AS (SELECT 'candidate-' || l_orderkey || '-' || l_linenumber AS id, 'c' || (l_orderkey % 200 + 1) AS company_id, '' AS company_name, l_comment AS payload FROM (SELECT *, l_linestatus AS l_comment FROM lineitem) WHERE l_linenumber = 1),
i AS (SELECT o_orderkey AS i, CASE WHEN o_orderkey % 2 = 0 THEN 'c' || o_custkey ELSE 'gone' END AS company_id, CASE WHEN o_orderkey % 3 = 0 THEN upper(c_name) ELSE 'Nobody' END AS company_name, '{"priority":"' || o_orderpriority || '"}' AS payload FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F')
SELECT * FROM s WHERE company_id NOT IN (SELECT id FROM companies WHERE CAST(substr(id, 2) AS INTEGER) % 2 = 0)
UNION ALL SELECT 'candidate-' || substr(sha256(i || ':' || payload), 1, 32), coalesce(c.id, named), company_name, payload FROM i LEFT JOIN companies c ON c.id = company_id LEFT JOIN n ON k = lower(company_name)""")
def candidate_replace(spark, sf):
    customer = t(spark, sf, "customer")
    cid = lambda c: F.concat(F.lit("c"), c.cast("string"))
    companies = customer.select(cid(F.col("c_custkey")).alias("id"), F.col("c_name").alias("name"))
    li = t(spark, sf, "lineitem").where("l_linenumber = 1")
    stored = li.select(F.concat(F.lit("candidate-"), F.col("l_orderkey").cast("string"), F.lit("-1")).alias("id"), cid(F.col("l_orderkey") % 200 + 1).alias("company_id"), F.lit("").alias("company_name"), F.col("l_linestatus").alias("payload"))
    o, k = t(spark, sf, "orders").where("o_orderstatus = 'F'").join(customer, F.col("c_custkey") == F.col("o_custkey")), F.col("o_orderkey")
    payload = F.concat(F.lit('{"priority":"'), F.col("o_orderpriority"), F.lit('"}'))
    incoming = o.select(k.alias("index"), F.when(k % 2 == 0, cid(F.col("o_custkey"))).otherwise("gone").alias("company_id"), F.when(k % 3 == 0, F.upper("c_name")).otherwise("Nobody").alias("company_name"), payload.alias("payload"))
    return K.replace_candidates(stored, incoming, companies, customer.where("c_custkey % 2 = 0").select(cid(F.col("c_custkey")).alias("company_id")))


@query("""WITH j AS (SELECT 'j' || o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'old' || (o_orderkey // 8) END AS legacy_id, o_orderkey AS ord FROM orders), l AS (SELECT legacy_id, arg_min(id, ord) AS moved FROM j WHERE legacy_id IS NOT NULL GROUP BY 1),
a AS (SELECT l_orderkey * 10 + l_linenumber AS ord, CASE l_linenumber WHEN 1 THEN 'j' || l_orderkey WHEN 2 THEN 'old' || (l_orderkey // 8) ELSE 'none' || l_orderkey END AS source_id FROM lineitem WHERE l_linenumber <= 3),
r AS (SELECT a.*, coalesce(moved, source_id) AS job_id FROM a LEFT JOIN l ON legacy_id = source_id)
SELECT ord, source_id, job_id, CASE WHEN job_id NOT IN (SELECT id FROM j) THEN 'skip: job relationship not found' WHEN row_number() OVER (PARTITION BY job_id ORDER BY ord) > 1 THEN 'skip: duplicate application job ID' ELSE 'keep' END AS action FROM r""")
def application_legacy_ids(spark, sf):
    k, n = F.col("o_orderkey"), F.col("l_linenumber")
    say = lambda head, c: F.concat(F.lit(head), c.cast("string"))
    jobs = t(spark, sf, "orders").select(say("j", k).alias("id"), F.when(k % 2 == 0, say("old", F.floor(k / 8))).alias("legacy_id"), k.alias("ord"))
    source = F.when(n == 1, say("j", F.col("l_orderkey"))).when(n == 2, say("old", F.floor(F.col("l_orderkey") / 8))).otherwise(say("none", F.col("l_orderkey")))
    return K.resolve_applications(t(spark, sf, "lineitem").where("l_linenumber <= 3").select((F.col("l_orderkey") * 10 + n).alias("ord"), source.alias("source_id")), jobs)


@query("""WITH o AS (SELECT l_orderkey, l_returnflag AS f, 'flag' AS s, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT l_orderkey, l_linestatus, 'mode', count(*) FROM lineitem GROUP BY ALL
 UNION ALL SELECT l_orderkey, '', 'odd', 1 FROM lineitem WHERE l_quantity > 49 GROUP BY ALL), t AS (SELECT l_orderkey, s, sum(n) AS n FROM o GROUP BY 1, 2)
SELECT l_orderkey, CAST(max(n) AS BIGINT) AS total, max(n) = min(n) AS agreed FROM t GROUP BY 1""")
def facet_totals(spark, sf):
    """A line item is an option that counts one in two selects; an order with a large one has a third select that disagrees. The operator sums options up, so they are not grouped before."""
    li = t(spark, sf, "lineitem")
    option = lambda name, c: F.struct(F.lit(name).alias("select"), F.col(c).alias("option"), F.lit(1).cast("bigint").alias("n"))
    options = li.select("l_orderkey", F.inline(F.array(option("flag", "l_returnflag"), option("mode", "l_linestatus"))))
    odd = li.where("l_quantity > 49").select("l_orderkey").distinct().select("l_orderkey", F.lit("odd").alias("select"), F.lit("").alias("option"), F.lit(1).cast("bigint").alias("n"))
    return K.facet_totals(options.unionByName(odd), "l_orderkey", "select", "n")


@query("""SELECT event_type, count(*) AS reviewed, count(*) FILTER (user_id % 4 = 0) AS updated, count(*) FILTER (user_id % 4 = 1) AS failed, count(*) FILTER (user_id % 4 = 2) AS unchanged FROM events GROUP BY 1""")
def refresh_summary(spark, sf):
    u = F.col("user_id") % 4
    e = t(spark, sf, "events").select("event_type", F.when(u == 0, "updated").when(u == 1, "failed").when(u == 2, "unchanged").otherwise("other").alias("outcome"))
    return K.summary_counts(e, ["event_type"], "outcome", ("updated", "failed", "unchanged"))


@query("""WITH c AS (SELECT o_orderpriority, count(*) AS reviewed, count(*) FILTER (o_orderstatus <> 'P') AS attempted, count(*) FILTER (o_orderstatus = 'F') AS found, count(*) FILTER (o_orderkey % 9 = 0) AS rejected, count(*) FILTER (o_orderkey % 10 = 1) AS skipped,
 count(*) FILTER (o_orderkey % 11 = 2) AS needsReview, count(*) FILTER (o_orderkey % 13 = 3) AS errors FROM orders GROUP BY 1)
SELECT *, greatest(0, reviewed - attempted) + skipped AS rowsSkipped, greatest(0, attempted - found - errors - skipped - rejected - needsReview) AS notFound FROM c""")
def fill_missing_summary(spark, sf):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    tests = {"attempted": s != "P", "found": s == "F", "rejected": k % 9 == 0, "skipped": k % 10 == 1, "needsReview": k % 11 == 2, "errors": k % 13 == 3}
    return K.fill_summary(t(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("reviewed"), *(F.count_if(v).alias(c) for c, v in tests.items())))


@query("""WITH p AS (SELECT conv_id, count(*) AS total, count(*) FILTER (turn % 2 = 0) AS done FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN done > 0 THEN 90.0 / done ELSE 0 END AS average, CASE WHEN done > 0 THEN 90.0 / done * (total - done) ELSE 0 END AS remaining FROM p""")
def run_progress(spark, sf):
    p = t(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("total"), F.count_if(F.col("turn") % 2 == 0).alias("done"))
    return p.select("conv_id", K.progress(F.col("done"), F.col("total"), F.lit(90.0)).alias("p")).select("conv_id", "p.*")


@query("""WITH a AS (SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey < 15), b AS (SELECT n_nationkey AS k, 'new ' || n_name AS v FROM nation WHERE n_nationkey > 9)
SELECT k, v, 'replaced' AS how FROM b UNION ALL SELECT k, v, 'replaced' FROM a WHERE k <= 9 UNION ALL SELECT k, v, 'ignored' FROM a UNION ALL SELECT k, v, 'ignored' FROM b WHERE k > 14""")
def settings_put(spark, sf):
    n = t(spark, sf, "nation")
    a = n.where("n_nationkey < 15").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    b = n.where("n_nationkey > 9").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("new "), F.col("n_name")).alias("v"))
    both = [K.put_settings(a, b, "k", how == "replaced").withColumn("how", F.lit(how)) for how in ("replaced", "ignored")]
    return both[0].unionByName(both[1])


@query("SELECT event_id, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN ' ' WHEN event_id % 3 = 1 THEN 'v1' END, ' '), json_extract_string(props, '$.k'), '0') AS version, 'imported' AS origin FROM events")
def column_backfill(spark, sf):
    """A version from the row itself, else from its JSON, else 0; a column that was not there."""
    k = F.col("event_id") % 3
    e = t(spark, sf, "events").select("event_id", "props", F.when(k == 0, " ").when(k == 1, "v1").alias("version"))
    return K.add_columns(e, {"version": F.coalesce(F.get_json_object("props", "$.k"), F.lit("0")), "origin": F.lit("imported")}).select("event_id", "version", "origin")


@query("""WITH m AS (SELECT o_custkey, list_distinct(list(o_orderpriority)) AS held FROM orders GROUP BY 1)
SELECT o_custkey, array_to_string(list_sort(list_filter(['1-URGENT', '2-HIGH', '5-LOW', '9-NONE'], lambda x: NOT list_contains(held, x))), ',') AS missing FROM m""")
def required_missing(spark, sf):
    m = K.missing_required(t(spark, sf, "orders"), ["o_custkey"], F.array("o_orderpriority"), ("1-URGENT", "2-HIGH", "5-LOW", "9-NONE"))
    return m.select("o_custkey", F.array_join("missing", ",").alias("missing"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) % 4 AS score, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_quantity AS INTEGER) % 4 DESC, l_linenumber) AS r FROM lineitem)
SELECT l_orderkey, l_linenumber, score, score > 0 OR n = 1 AS sure FROM s WHERE r = 1""")
def best_cards(spark, sf):
    """The best link of a card, and whether it would pass as the best organisation."""
    s = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") % 4).alias("score"))
    sure = K.best_of(s, ["l_orderkey"], "score", "l_linenumber", sure=True).select("l_orderkey", F.lit(True).alias("sure"))
    return K.best_of(s, ["l_orderkey"], "score", "l_linenumber").join(sure, "l_orderkey", "left").withColumn("sure", F.coalesce("sure", F.lit(False)))


# ---- display ----------------------------------------------------------------------------------------------------------------

_MONEY = "CASE WHEN {0} = floor({0}) THEN format('{{:,}}', CAST({0} AS BIGINT)) ELSE format('{{:,.2f}}', {0}) END"
PAY_TEXTS, CURRENCIES, PERIODS = ("", "Not listed", "", "$20/hr DOE", ""), ("usd", "", "cad"), ("hourly", "annual", "other", "Weekly")


@query(f"""WITH x AS (SELECT o_orderkey, {dealt_sql(PAY_TEXTS, "o_orderkey")} AS said, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS low, CASE WHEN o_orderkey % 3 = 0 THEN round(o_totalprice + 10, 0) END AS high, {dealt_sql(CURRENCIES, "(o_orderkey // 2)")} AS cur, {dealt_sql(PERIODS, "(o_orderkey // 3)")} AS per FROM orders),
y AS (SELECT *, CASE WHEN cur = 'cad' THEN 'CAD ' ELSE '$' END AS sign, CASE lower(per) WHEN 'hourly' THEN ' per hour' WHEN 'annual' THEN ' per year' ELSE '' END AS tail, {_MONEY.format("low")} AS lo, {_MONEY.format("high")} AS hi FROM x)
SELECT o_orderkey, CASE WHEN said = '$20/hr DOE' THEN said WHEN low IS NULL AND high IS NULL THEN 'Pay not posted' WHEN high IS NULL THEN 'From ' || sign || lo || tail WHEN low IS NULL THEN 'Up to ' || sign || hi || tail ELSE sign || lo || ' - ' || sign || hi || tail END AS shown FROM y""")
def pay_display_cases(spark, sf):
    k = F.col("o_orderkey")
    o = t(spark, sf, "orders").withColumns({"k2": F.floor(k / 2), "k3": F.floor(k / 3)})
    return o.select("o_orderkey", N.pay_display(dealt(PAY_TEXTS, "o_orderkey"), F.when(k % 2 == 0, F.col("o_totalprice")), F.when(k % 3 == 0, F.round(F.col("o_totalprice") + 10, 0)), dealt(PERIODS, "k3"), dealt(CURRENCIES, "k2")).alias("shown"))


TITLES = ("Chief Risk Officer", "Branch Manager", "Team Lead", "Security Analyst", "Teller", "", "Zookeeper", "Night Zookeeper", "Lead Zookeeper")
TEXTS = ("You will supervise a team of tellers.", "Plain work.", "Manages a team of four and direct reports.")


def _first(patterns, x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, {q(p)}) THEN {q(p)}" for p in patterns) + " END"


@query(f"""WITH r AS (SELECT p_partkey, {dealt_sql(TITLES, "p_partkey")} AS title, lower({dealt_sql(TEXTS, "(p_partkey // 9)")}) AS body FROM part),
p AS (SELECT *, {_first(R.EXEC_TITLES, "lower(title)")} AS ex, {_first(R.MANAGER_TITLES, "lower(title)")} AS mt, {_first(R.MANAGER_TEXTS, "body")} AS md FROM r)
SELECT p_partkey, CASE WHEN title = '' THEN 'UNKNOWN' WHEN ex IS NOT NULL THEN 'EXEC' WHEN mt IS NOT NULL OR md IS NOT NULL THEN 'MGR' WHEN title IN ('Zookeeper') THEN 'UNKNOWN' ELSE 'IC' END AS type,
CASE WHEN title = '' THEN 'Title missing or unclear.' WHEN ex IS NOT NULL THEN 'Matched executive title pattern ''' || ex || '''.' WHEN mt IS NOT NULL THEN 'Matched manager title pattern ''' || mt || '''.'
 WHEN md IS NOT NULL AND contains(lower(title), 'lead') THEN 'Lead title plus people-management signal ''' || md || '''.' WHEN md IS NOT NULL THEN 'Matched people-management description signal ''' || md || '''.'
 WHEN title = 'Zookeeper' THEN 'Not enough title signal to classify.' WHEN title IN ('Night Zookeeper', 'Lead Zookeeper') THEN 'No executive or people-management signals found.' ELSE 'Matched individual contributor title keyword.' END AS reason FROM p""")
def role_type_cases(spark, sf):
    p = t(spark, sf, "part").withColumn("k", F.floor(F.col("p_partkey") / 9)).select("p_partkey", dealt(TITLES, "p_partkey").alias("title"), dealt(TEXTS, "k").alias("body"))
    return p.select("p_partkey", R.role_type("title", "body").alias("r")).select("p_partkey", "r.*")


BOARD_LINKS = (("Careers", "https://acme.com/careers"), ("Jobs at Acme", "https://jobs.lever.co/acme"), ("About", "https://acme.com/about"), ("Login", "https://acme.com/login"), ("Openings", "https://indeed.com/acme"))


@query(f"""SELECT s_suppkey, 'https://jobs.lever.co/acme' AS url, 'Lever' AS platform FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT s_suppkey, 'https://acme.com/careers', '' FROM supplier WHERE s_suppkey % 2 = 1""")
def board_pick_cases(spark, sf):
    """The best board of every site: a vendor's board where the site links to one, else its careers page."""
    links = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(a).alias("label"), F.lit(u).alias("url")) for i, (a, u) in enumerate(BOARD_LINKS)))
    found = t(spark, sf, "supplier").select("s_suppkey", F.explode(links).alias("l")).select("s_suppkey", "l.*").where("s_suppkey % 2 = 0 OR url NOT LIKE '%lever%'")
    s = D.board_score(F.lit("Acme Bank"), F.col("url"), F.col("label"), F.lit(True))
    scored = found.select("s_suppkey", "url", "ord", F.lit(0).alias("stage"), s.alias("s")).select("s_suppkey", "url", "ord", "stage", "s.*")
    return D.best_board(scored, "s_suppkey", "stage", "ord").select("s_suppkey", "url", "platform")


@query("SELECT doc_id, regexp_matches(text, '(?i)\\b(?:full[\\s-]?time|part[\\s-]?time|temporary|seasonal|internship|intern|per[\\s-]diem|contract|contingent|casual|exempt|non[\\s-]?exempt|hourly|salaried)\\b') AS employment FROM documents")
def employment_signal(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.coalesce(F.array_contains(R.metadata_signals("text"), "employment type"), F.lit(False)).alias("employment"))

