"""Column functions over fixed texts, dealt over the rows of a table; their SQL holds the results as worked out by hand. And the operators of
runs, schedules and search hits beside plain SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import rules as R
from ..functions import text as T
from ..functions import timefn as X
from ..functions import url as U
from ..operators import discovery as D
from ..operators import paging, runs
from .queries import query, t
from .records import q



def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return q(v) if isinstance(v, str) else repr(v)


def cases(name: str, doc: str, pairs: list[tuple], f: Callable[[Column], Column], kind: str = "string") -> None:
    """A query that gives f of the n-th text for the n-th part, round and round."""
    given, want = [p[0] for p in pairs], [p[1] for p in pairs]

    def run(spark, sf):
        texts = F.array(*(F.lit(g).cast("string") for g in given))
        # a large table of narrow rows is a small file, which one task would read: its keys are dealt over tasks
        dealt = t(spark, sf, "part").select("p_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
        parts = dealt.select("p_partkey", F.element_at(texts, (F.col("p_partkey") % len(given) + 1).cast("int")).alias("x"))
        return parts.select("p_partkey", f(F.col("x")).cast(kind).alias("out"))

    run.__name__, run.__doc__ = name, doc
    types = {"string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE", "bigint": "BIGINT"}
    query(f"SELECT p_partkey, CAST(([{', '.join(map(_literal, want))}])[CAST(p_partkey % {len(want)} AS INTEGER) + 1] AS {types[kind]}) AS out FROM part")(run)


joined = lambda f: lambda c: F.array_join(f(c), "|")

cases("url_public_shape", "http(s), a public host, no credentials.", [("https://bank.com", True), ("http://127.0.0.1/", False), ("http://localhost", False), ("http://a:b@bank.com", False)], U.public_shape, "boolean")
cases("url_company_match", "Does a site look like the company's own.", [("https://www.firstbank.com", True), ("https://first-ely.org", True), ("https://other.com", False)], lambda c: U.matches_company(F.lit("First Bank"), c), "boolean")
cases("url_careers_context", "Why a page is a careers page.", [("https://x.com/careers/", 'careers URL segment ("careers")'), ("https://x.com/a", 'careers page title ("Join our team")')], lambda c: U.careers_context(c, F.lit(""), F.lit("Join our team")))
cases("number_period", "One spelling for each pay period.", [("annual", "year"), ("hour", "hour"), ("weekly", "week"), ("x", "unknown")], N.period)
cases(
    "pay_bounds", "Pay in texts: bounds, period, currency.",
    [("Salary range $80,000-$105,000 annually", "80000|105000|annual|USD"), ("Pay: $24.50 to $31.75 per hour", "24|32|hourly|USD"), ("Hourly rate 28 to 34 USD", "28|34|hourly|USD"), ("Salary: £55,000 - £65,000 annually", "55000|65000|annual|GBP"), ("We offer a 401(k) match", None), ("10 years of experience", None)],
    lambda c: R.once(R.pay(c), lambda p: F.when(p.getField("low").isNotNull(), F.concat_ws("|", *(p.getField(k).cast("string") for k in ("low", "high", "period", "currency"))))),
)
cases("title_structured", "Titles that a structured source marks as postings.", [("CFO", True), ("Paralegal", True), ("Apply Now", False), ("2 days ago", False), ("General Employment Application", False)], R.valid_structured_title, "boolean")
cases("text_reasons", "Texts that are no title.", [("a@b.co", "email address, not a job title"), ("(555) 123-4567", "phone number, not a job title"), ("Find an ATM", 'marketing call to action ("find an atm")'), ("We're hiring", "marketing sentence, not a job title"), ("Troop Manager", "")], R.text_reason)
cases("metadata_cases", "Posting metadata that a text shows.", [("Location: Austin, TX", "labelled metadata (location)|city/state location"), ("hourly pay", "employment type"), ("$20 per hour", "published pay"), ("nothing", "")], joined(R.metadata_signals))
cases("destination_reasons", "Where a link that is no posting leads.", [("#top", "in-page anchor, not a posting URL"), ("https://www.facebook.com/x", "social/aggregator link (facebook.com)"), ("https://b.com/", "site root, not a posting URL"), ("https://b.com/locations", "branch/ATM link"), ("https://b.com/about/careers/teller-1", "")], R.destination_reason)


# ---- runs, schedules, hits --------------------------------------------------------------------------------------------------

_RUNS = """r AS (SELECT event_id AS id, 'job' || (user_id % 7) AS job_key, (['Queued','Running','Completed','Failed','Skipped'])[CAST(event_id % 5 AS INTEGER) + 1] AS status, ts AS started_at, round(value, 2) AS runtime_seconds FROM events)"""


def _runs(spark, sf):
    status = F.element_at(F.array(*map(F.lit, ("Queued", "Running", "Completed", "Failed", "Skipped"))), (F.col("event_id") % 5 + 1).cast("int"))
    return t(spark, sf, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("job"), (F.col("user_id") % 7).cast("string")).alias("job_key"), status.alias("status"), F.col("ts").alias("started_at"), F.round("value", 2).alias("runtime_seconds"))


@query(f"""WITH {_RUNS} SELECT id, CASE WHEN status IN ('Queued', 'Running') THEN 'Failed' ELSE status END AS status, CASE WHEN status IN ('Queued', 'Running') THEN greatest(0, round(date_diff('microsecond', started_at, TIMESTAMP '2024-03-01') / 1e6, 2)) ELSE runtime_seconds END AS runtime_seconds,
CASE WHEN status IN ('Queued', 'Running') THEN '2024-03-01 00:00:00' ELSE '' END AS completed_at FROM r""")
def runs_interrupted(spark, sf):
    r = _runs(spark, sf).withColumns({"started_at": F.col("started_at").cast("string"), "completed_at": F.lit(""), "error": F.lit("")})
    return runs.interrupted(r, "2024-03-01 00:00:00").select("id", "status", "runtime_seconds", "completed_at")


@query("""WITH s AS (SELECT o_orderkey, CAST(o_orderkey % 8 AS INTEGER) AS total, CAST(o_orderkey % 5 AS INTEGER) AS current FROM orders)
SELECT o_orderkey, CASE WHEN total > 0 THEN CAST(round_even(100.0 * current / total, 0) AS BIGINT) ELSE 0 END AS progress_percent, 'Checked ' || current || ' of ' || total || ' companies' AS progress_text FROM s""")
def runs_snapshot(spark, sf):
    k = F.col("o_orderkey")
    r = t(spark, sf, "orders").select("o_orderkey", (k % 8).cast("int").alias("progress_total"), (k % 5).cast("int").alias("progress_current"), F.lit("Checked").alias("progress_verb"), F.lit("companies").alias("progress_unit"), F.lit("Completed").alias("status"), F.lit("").alias("started_at"), F.lit(1.0).alias("runtime_seconds"))
    return runs.snapshot(r, F.lit("2024-03-01").cast("timestamp")).select("o_orderkey", F.col("progress_percent").cast("bigint").alias("progress_percent"), "progress_text")


@query(f"""WITH {_RUNS}, n AS (SELECT job_key, arg_max(id, CAST(epoch_us(started_at) AS HUGEINT) * 1000000 + id) AS id FROM r GROUP BY 1), j AS (SELECT 'job' || n_nationkey AS job_key, CASE WHEN n_nationkey % 2 = 0 THEN '07:30' END AS run_time FROM nation)
SELECT j.job_key, run_time, r.status FROM j LEFT JOIN n USING (job_key) LEFT JOIN r ON r.id = n.id""")
def runs_dashboard(spark, sf):
    jobs = t(spark, sf, "nation").select(F.concat(F.lit("job"), F.col("n_nationkey").cast("string")).alias("job_key"), "n_nationkey")
    schedules = jobs.where("n_nationkey % 2 = 0").select("job_key", F.lit("07:30").alias("run_time"))
    return runs.dashboard(jobs.select("job_key"), schedules, _runs(spark, sf)).select("job_key", "run_time", F.col("latest_run.status").alias("status"))


@query(f"""WITH {_RUNS}, d AS (SELECT DISTINCT job_key, strftime(started_at, '%Y-%m-%d') AS local_date FROM r), c AS (SELECT DISTINCT job_key, strftime(started_at, '%Y-%m-%d') AS local_date FROM r WHERE status = 'Failed' AND id % 10 = 3) SELECT * FROM d EXCEPT SELECT * FROM c""")
def schedule_claims(spark, sf):
    r = _runs(spark, sf).withColumn("local_date", F.date_format("started_at", "yyyy-MM-dd"))
    return runs.claims(r, r.where("status = 'Failed' AND id % 10 = 3"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 4 THEN 'update-id' WHEN o_orderkey % 3 = 0 THEN 'update' ELSE 'create' END AS action FROM orders""")
def import_actions(spark, sf):
    k = F.col("o_orderkey")
    new = t(spark, sf, "orders").select("o_orderkey", F.when(k % 10 == 4, -k).otherwise(k).alias("before"))
    return runs.import_plan(new, t(spark, sf, "orders").where("o_orderkey % 3 = 0").select("o_orderkey"), "o_orderkey", "before").select("o_orderkey", "action")


@query("""WITH h AS (SELECT l_orderkey AS company_id, 'u' || (l_partkey % 5) AS url, l_linenumber % 3 AS phrase_no, l_linenumber AS hit_no FROM lineitem), o AS (SELECT company_id, url, min(phrase_no * 100 + hit_no) AS first_at FROM h WHERE hit_no <= 4 GROUP BY 1, 2),
r AS (SELECT company_id, url, row_number() OVER (PARTITION BY company_id ORDER BY first_at, url) AS rank FROM o) SELECT company_id, url, rank FROM r WHERE rank <= 3""")
def search_hits_ranked(spark, sf):
    h = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("company_id"), F.concat(F.lit("u"), (F.col("l_partkey") % 5).cast("string")).alias("url"), (F.col("l_linenumber") % 3).alias("phrase_no"), F.col("l_linenumber").alias("hit_no"))
    return D.rank_hits(h, most=3).select("company_id", "url", F.col("rank").cast("bigint").alias("rank"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'board' WHEN c_custkey % 2 = 0 AND c_custkey % 5 > 0 THEN 'feed' ELSE 'none' END AS kind FROM customer""")
def first_sources(spark, sf):
    k = F.col("c_custkey")
    c = t(spark, sf, "customer").select("c_custkey", F.when(k % 3 == 0, " https://b.com ").alias("job_board_url"), F.when(k % 5 > 0, "https://f.com").alias("jobs_rss_feed_url"), F.when(k % 2 == 0, "Yes").otherwise("no").alias("feed_found"))
    return c.select("c_custkey", D.first_source().getField("kind").alias("kind"))


@query("""WITH d AS (SELECT o_orderkey, o_orderkey % 4 AS saved, CASE WHEN o_orderkey % 9 = 0 THEN 'timeout' END AS error, o_orderkey % 2 = 0 AS generic FROM orders)
SELECT o_orderkey, CASE WHEN error IS NOT NULL THEN 'Collector Failed' WHEN saved > 0 THEN 'Jobs Collected' ELSE 'No Jobs Found' END AS status, CASE WHEN error IS NOT NULL THEN 'Collector failed: timeout' WHEN saved > 0 THEN 'Real job records were saved after validation.'
 WHEN generic THEN 'No validated jobs saved from generic page parsing; review source page or add a platform-specific collector.' ELSE 'No validated jobs saved; platform collector needs review.' END AS notes FROM d""")
def collector_outcomes(spark, sf):
    k = F.col("o_orderkey")
    return t(spark, sf, "orders").select("o_orderkey", D.diagnostic(k % 4, F.when(k % 9 == 0, "timeout"), k % 2 == 0).alias("d")).select("o_orderkey", "d.*")


@query("""WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) SELECT o_orderkey, r > 100 AS omitted FROM o""")
def limit_and_rest(spark, sf):
    """A run's first hundred postings, and those that the limit left out."""
    head, rest = paging.slice_by_rank(t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 100, key=["o_orderkey"])
    return head.select("o_orderkey", F.lit(False).alias("omitted")).unionByName(rest.select("o_orderkey", F.lit(True).alias("omitted")))


@query("""SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50""")
def sorted_by_choice(spark, sf):
    """A sort column from the whitelist; another column would sort by name."""
    order = paging.sort_order({"name": F.col("c_name"), "balance": F.col("c_acctbal")}, "balance", True, "name", F.col("c_custkey"))
    return paging.page_of(t(spark, sf, "customer"), order, 1, 50).select("c_custkey", "c_name")
