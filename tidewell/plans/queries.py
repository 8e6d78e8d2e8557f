"""The library's operators over the driver's tables: companies are customers, postings are orders (status 'O' is open), an
application is an order with a returned line, runs and snapshots are events, pages are pages.

Each query stands beside the SQL that gives the same rows. Sums are cast, since the oracle's sums are wider than Spark's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import pages as P
from ..functions import rules as R
from ..functions import text as T
from ..functions import timefn as X
from ..functions import url as U
from ..operators import diff, keywords, merge, paging
from ..operators import discovery as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = "2024-02-01 00:00:00"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- company page -----------------------------------------------------------------------------------------------------------


def company_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Companies with open count, last posting date and applied count: each side is summed up before it is joined."""
    orders = t(spark, sf, "orders")
    jobs = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.when(F.lower("o_orderstatus") == "o", 1).otherwise(0)).alias("active_count"), F.max(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("last_date"))
    returned = t(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    applied = orders.join(returned, "o_orderkey", "left_semi").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("applied_count"))
    c = t(spark, sf, "customer").join(jobs, "c_custkey", "left").join(applied, "c_custkey", "left")
    return c.select("c_custkey", "c_name", "c_mktsegment", F.coalesce("active_count", F.lit(0)).alias("active_count"), F.coalesce("last_date", F.lit("")).alias("last_date"), F.coalesce("applied_count", F.lit(0)).alias("applied_count"))


_METRICS = """
WITH m AS (SELECT o_custkey, CAST(sum(CASE WHEN lower(o_orderstatus) = 'o' THEN 1 ELSE 0 END) AS BIGINT) AS active_count, max(strftime(o_orderdate, '%Y-%m-%d')) AS last_date FROM orders GROUP BY 1),
     c AS (SELECT c_custkey, c_name, c_mktsegment, coalesce(active_count, 0) AS active_count, coalesce(last_date, '') AS last_date,
                  (SELECT count(*) FROM orders o WHERE o.o_custkey = c_custkey AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_returnflag = 'R')) AS applied_count
           FROM customer LEFT JOIN m ON o_custkey = c_custkey)
"""


@query(_METRICS + "SELECT * FROM c WHERE active_count > 0 ORDER BY active_count DESC, lower(c_name), c_custkey LIMIT 25 OFFSET 25")
def company_page_metrics(spark, sf):
    """Second page of companies with open postings, most open first."""
    return paging.page_of(company_metrics(spark, sf).where("active_count > 0"), [F.desc("active_count"), F.lower("c_name"), F.asc("c_custkey")], 2, 25, total=50)


@query(_METRICS + "SELECT count(*) AS total, count(*) FILTER (WHERE active_count > 0) AS with_active, count(*) FILTER (WHERE active_count = 0) AS without_active, CAST(greatest(1, ceil(count(*) / 25.0)) AS BIGINT) AS total_pages FROM c")
def company_page_total(spark, sf):
    return company_metrics(spark, sf).agg(F.count("*").alias("total"), F.count_if(F.col("active_count") > 0).alias("with_active"), F.count_if(F.col("active_count") == 0).alias("without_active")).withColumn("total_pages", N.pages("total", 25))


@query("SELECT DISTINCT 'segment' AS facet, c_mktsegment AS value FROM customer WHERE trim(c_mktsegment) <> '' UNION ALL SELECT DISTINCT 'nation', n_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE trim(n_name) <> '' UNION ALL SELECT DISTINCT 'region', r_name FROM region")
def company_facets(spark, sf):
    seg = paging.facet(t(spark, sf, "customer"), "c_mktsegment").select(F.lit("segment").alias("facet"), "value")
    nat = paging.facet(t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")), "n_name").select(F.lit("nation").alias("facet"), "value")
    return seg.union(nat).union(paging.facet(t(spark, sf, "region"), "r_name").select(F.lit("region").alias("facet"), "value"))


@query("SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE (lower(c_name) LIKE '%1_3%' OR lower(n_name) LIKE '%1_3%' OR lower(r_name) LIKE '%1_3%' OR lower(c_mktsegment) LIKE '%1_3%')")
def company_search_any_column(spark, sf):
    """The term's underscore is a wildcard, as in the search box."""
    n = F.broadcast(t(spark, sf, "nation").join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")))  # fixed tables
    return t(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).where(T.like_any("1_3", "c_name", "n_name", "r_name", "c_mktsegment")).select("c_custkey", "c_name", "n_name", "r_name")


# ---- joins, pruning, diffs --------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, r_name, l_returnflag FROM orders LEFT JOIN (SELECT * FROM region WHERE r_regionkey = 0) r ON true LEFT JOIN (SELECT l_orderkey, min(l_returnflag) AS l_returnflag FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) l ON l_orderkey = o_orderkey AND r_regionkey = 0 WHERE o_orderstatus = 'P'")
def single_row_left_join(spark, sf):
    """One resume beside every posting, then its result."""
    one = F.broadcast(t(spark, sf, "region").where("r_regionkey = 0").limit(1))  # one row
    first = t(spark, sf, "lineitem").where("l_linenumber = 1").groupBy("l_orderkey").agg(F.min("l_returnflag").alias("l_returnflag"))
    o = t(spark, sf, "orders").where("o_orderstatus = 'P'").join(one, F.lit(True), "left")
    return o.join(first, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("r_regionkey") == 0), "left").select("o_orderkey", "r_name", "l_returnflag")


def _jobs(spark, sf):
    return t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("company_id"), F.col("o_orderstatus").alias("status"))


def _pruned(spark, sf):
    apps = t(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("job_id"))
    jobs = _jobs(spark, sf)
    return merge.prune(jobs, jobs.where("id % 3 = 0"), apps, jobs.where("company_id % 2 = 0").select("company_id"))


@query("SELECT o_orderkey AS id FROM orders o WHERE o_custkey % 2 = 0 AND o_orderkey % 3 <> 0 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_returnflag = 'R')")
def prune_archive(spark, sf):
    return _pruned(spark, sf).where("status = 'Archived'").select("id")


@query("SELECT o_orderkey AS id FROM orders o WHERE o_custkey % 2 = 0 AND o_orderkey % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_returnflag = 'R')")
def prune_delete(spark, sf):
    return _jobs(spark, sf).join(_pruned(spark, sf).select("id"), "id", "left_anti").select("id")


def _slices(spark, sf):
    e = t(spark, sf, "events").select("user_id", "event_type", F.to_date("ts").alias("d"))
    return e.where("d >= '2024-01-15' AND d < '2024-01-20'").select("user_id", "event_type").distinct(), e.where("d >= '2024-01-10' AND d < '2024-01-15'").select("user_id", "event_type").distinct()


_SLICES = "WITH a AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts >= '2024-01-15' AND ts < '2024-01-20'), b AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts >= '2024-01-10' AND ts < '2024-01-15') "


@query(_SLICES + "SELECT * FROM a ANTI JOIN b USING (user_id, event_type)")
def snapshot_added(spark, sf):
    return diff.added(*_slices(spark, sf), ["user_id", "event_type"])


@query(_SLICES + "SELECT * FROM b ANTI JOIN a USING (user_id, event_type)")
def snapshot_removed(spark, sf):
    return diff.removed(*_slices(spark, sf), ["user_id", "event_type"])


@query("""WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'F' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS p FROM orders WHERE o_orderkey % 11 <> 0),
b AS (SELECT o_orderkey, o_orderstatus AS s, o_totalprice AS p FROM orders WHERE o_orderkey % 13 <> 0)
SELECT count(*) FILTER (WHERE b.o_orderkey IS NULL) AS new_count, count(*) FILTER (WHERE a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL AND (a.s IS DISTINCT FROM b.s OR a.p IS DISTINCT FROM b.p)) AS changed_count,
count(*) FILTER (WHERE a.o_orderkey IS NULL) AS removed_count, count(*) FILTER (WHERE b.s = 'O' AND a.s <> 'O') AS closed_count FROM b FULL JOIN a USING (o_orderkey)""")
def refresh_change_counts(spark, sf):
    name = F.when(F.col("o_orderstatus") == "O", "open").otherwise(F.col("o_orderstatus"))
    o = t(spark, sf, "orders").select("o_orderkey", name.alias("status"), F.col("o_totalprice").alias("price"))
    after = o.where("o_orderkey % 11 <> 0").withColumns({"status": F.when(F.col("o_orderkey") % 5 == 0, "F").otherwise(F.col("status")), "price": F.when(F.col("o_orderkey") % 7 == 0, F.col("price") + 1).otherwise(F.col("price"))})
    return diff.refresh_counts(o.where("o_orderkey % 13 <> 0"), after, "o_orderkey", ["status", "price"], "status")


@query("""WITH o AS (SELECT o_orderkey AS id, o_custkey AS company_id, o_totalprice AS price FROM orders),
oc AS (SELECT DISTINCT company_id, CASE company_id % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'partial' WHEN 2 THEN 'failed' ELSE 'skipped' END AS outcome FROM o),
kept AS (SELECT id, company_id, price, id AS ord FROM o WHERE company_id NOT IN (SELECT company_id FROM oc WHERE outcome = 'success')),
new AS (SELECT id, company_id, price * 2 AS price, id + 1000000000 AS ord FROM o WHERE id % 2 = 0 AND company_id IN (SELECT company_id FROM oc WHERE outcome IN ('success', 'partial')))
SELECT id, company_id, price, ord, min(ord) OVER (PARTITION BY id) AS first_seen_order FROM (SELECT * FROM kept UNION ALL SELECT * FROM new) QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC) = 1""")
def merge_scope_replacement(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("company_id"), F.col("o_totalprice").alias("price"))
    kind = F.element_at(F.array(*map(F.lit, ("success", "partial", "failed", "skipped"))), (F.col("company_id") % 4 + 1).cast("int"))
    outcomes = o.select("company_id").distinct().withColumn("outcome", kind)
    new = o.where("id % 2 = 0").withColumns({"price": F.col("price") * 2, "ord": F.col("id") + 1000000000})
    return merge.replace_scope(o.withColumn("ord", F.col("id")), new, outcomes, F.col("id"), "ord")


# ---- de-duplication and resolution ------------------------------------------------------------------------------------------


@query("SELECT user_id, event_type, event_id, value, min(event_id) OVER (PARTITION BY user_id, event_type) AS first_seen_order FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def dedupe_last_wins(spark, sf):
    return merge.last_wins(t(spark, sf, "events").select("user_id", "event_type", "event_id", "value"), F.struct("user_id", "event_type"), "event_id")


@query("SELECT doc_id, row_number() OVER (PARTITION BY lower(text) ORDER BY doc_id) > 1 AS duplicate FROM documents")
def dedupe_first_wins_rejects(spark, sf):
    return merge.first_wins(t(spark, sf, "documents").select("doc_id", F.sha2(F.lower("text"), 256).alias("h")), F.col("h"), "doc_id").select("doc_id", "duplicate")


@query("""WITH o AS (SELECT o_orderkey, 'job-' || CAST(o_orderkey // 4 AS VARCHAR) AS id, substr(sha256(CAST(o_custkey % 5 AS VARCHAR)), 1, 12) AS d FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o_orderkey) AS rk FROM o), s AS (SELECT *, row_number() OVER (PARTITION BY id, d, rk > 1 ORDER BY o_orderkey) AS same FROM r)
SELECT o_orderkey, id, CASE WHEN rk = 1 THEN id ELSE id || '--' || d || CASE WHEN same > 1 THEN '-' || CAST(same AS VARCHAR) ELSE '' END END AS repaired_id FROM s""")
def duplicate_id_repair(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("job-"), F.floor(F.col("o_orderkey") / 4).cast("string")).alias("id"), (F.col("o_custkey") % 5).cast("string").alias("body"))
    return merge.repair_ids(o, "id", F.col("body"), "o_orderkey").drop("body")


@query("SELECT p_partkey, CASE WHEN row_number() OVER (PARTITION BY lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) ORDER BY p_size, p_partkey) = 1 THEN lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) ELSE '' END AS normalized_name FROM part")
def name_key_owner(spark, sf):
    return merge.name_owner(t(spark, sf, "part").select("p_partkey", "p_name", "p_size"), "p_name", ["p_size", "p_partkey"]).select("p_partkey", "normalized_name")


_RESOLVE = "WITH s AS (SELECT s_suppkey AS id, 'Customer#' || lpad(CAST(s_suppkey % 40 AS VARCHAR), 9, '0') AS name FROM supplier), c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE -1 END AS ref, c_name FROM customer) "


def _resolve(spark, sf):
    s = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Customer#"), F.lpad((F.col("s_suppkey") % 40).cast("string"), 9, "0")).alias("name"))
    return t(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).otherwise(-1).alias("ref"), "c_name"), s


@query(_RESOLVE + ", u AS (SELECT lower(name) AS name, min(id) AS uid FROM s GROUP BY 1 HAVING count(*) = 1) SELECT c_custkey, coalesce(s.id, uid) AS resolved_id FROM c LEFT JOIN s ON s.id = ref LEFT JOIN u ON u.name = lower(c_name)")
def resolve_by_id_or_unique_name(spark, sf):
    c, s = _resolve(spark, sf)
    return merge.resolve_unique(c, "ref", "c_name", s).select("c_custkey", "resolved_id")


@query(_RESOLVE + ", u AS (SELECT lower(name) AS name, max(id) AS uid FROM s GROUP BY 1) SELECT c_custkey, coalesce(CAST(s.id AS VARCHAR), CAST(uid AS VARCHAR), '') AS resolved_id FROM c LEFT JOIN s ON s.id = ref LEFT JOIN u ON u.name = lower(c_name)")
def resolve_by_id_or_last_name(spark, sf):
    c, s = _resolve(spark, sf)
    return merge.resolve_last(c, "ref", "c_name", s.withColumn("id", F.col("id").cast("string")).withColumn("ord", F.col("id").cast("bigint")), "ord").select("c_custkey", "resolved_id")


_FOLD_PICKS = ", ".join(f"CASE WHEN CASE WHEN t THEN r.{c} ELSE f.{c} END <> '' THEN CASE WHEN t THEN r.{c} ELSE f.{c} END WHEN t THEN f.{c} ELSE r.{c} END" for c in merge.COMPANY_COLUMNS)
_FOLD_NOTES = "array_to_string(list_filter(list_filter(list_transform(string_split(f.notes || ';' || r.notes, ';'), lambda x: trim(x)), lambda x: x <> ''), lambda x, i: list_position(list_filter(list_transform(string_split(f.notes || ';' || r.notes, ';'), lambda x: trim(x)), lambda x: x <> ''), x) = i), '; ')"


@query(f"""WITH RECURSIVE s AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS company_id, 'Company ' || (c_custkey % 97) AS company_name, '' AS city, CAST(c_custkey % 4 AS VARCHAR) AS state,
 CASE WHEN c_custkey % 3 = 0 THEN 'https://www.site' || (c_custkey % 97) || '.example' ELSE '' END AS official_website, CASE WHEN c_custkey % 5 = 0 THEN 'https://careers.example' ELSE '' END AS careers_page_url,
 CASE WHEN c_custkey % 7 = 0 THEN 'https://jobs.example' ELSE '' END AS job_board_url, CASE WHEN c_custkey % 11 < 4 THEN '2024-0' || (c_custkey % 11 % 4 + 1) ELSE '' END AS last_checked, CAST(c_custkey % 90 // 30 AS INTEGER) AS confidence, 'note ' || (c_custkey % 3) AS notes FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY k) AS i FROM (SELECT *, CASE WHEN official_website <> '' THEN 'domain:site' || (k % 97) || '.example' ELSE 'name-state:company-' || (k % 97) || ':' || state END AS key FROM s)),
f AS (SELECT key, i, {", ".join(merge.COMPANY_COLUMNS)}, confidence, notes FROM r WHERE i = 1
 UNION ALL SELECT f.key, r.i, {_FOLD_PICKS}, greatest(f.confidence, r.confidence), {_FOLD_NOTES}
 FROM f JOIN r ON r.key = f.key AND r.i = f.i + 1, LATERAL (SELECT (r.job_board_url <> '', r.careers_page_url <> '', r.official_website <> '', r.confidence, r.last_checked) > (f.job_board_url <> '', f.careers_page_url <> '', f.official_website <> '', f.confidence, f.last_checked) AS t) x)
SELECT key, {", ".join(merge.COMPANY_COLUMNS)}, confidence, notes, CAST(i AS INTEGER) AS n_rows FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY i DESC) = 1""")
def company_identity_fold(spark, sf):
    """Order-dependent, with a running score: the SQL folds row by row."""
    c = t(spark, sf, "customer")
    some = lambda test, v: F.when(test, v).otherwise("")
    k = F.col("c_custkey")
    rows = c.select(
        k.alias("ord"), k.cast("string").alias("company_id"), F.concat(F.lit("Company "), (k % 97).cast("string")).alias("company_name"), F.lit("").alias("city"), (k % 4).cast("string").alias("state"),
        some(k % 3 == 0, F.concat(F.lit("https://www.site"), (k % 97).cast("string"), F.lit(".example"))).alias("official_website"), some(k % 5 == 0, "https://careers.example").alias("careers_page_url"), some(k % 7 == 0, "https://jobs.example").alias("job_board_url"),
        some(k % 11 < 4, F.concat(F.lit("2024-0"), (k % 11 % 4 + 1).cast("string"))).alias("last_checked"), F.floor(k % 90 / 30).alias("confidence"), F.concat(F.lit("note "), (k % 3).cast("string")).alias("notes"),
    )
    return merge.fold_companies(rows, "ord")


@query("""WITH r AS (SELECT c_nationkey AS k, c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS a, CASE WHEN c_custkey % 5 <> 0 THEN '' ELSE c_mktsegment END AS b FROM customer),
s AS (SELECT *, CASE WHEN a <> '' THEN -1 ELSE 0 END + CASE WHEN b <> '' THEN -1 ELSE 0 END AS q FROM r)
SELECT k, arg_min(id, (q, id)) AS id, arg_min(a, (q, id)) FILTER (WHERE a <> '') AS a, arg_min(b, (q, id)) FILTER (WHERE b <> '') AS b FROM s GROUP BY k""")
def ranked_blank_fill(spark, sf):
    c = t(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")).alias("a"), F.when(F.col("c_custkey") % 5 != 0, "").otherwise(F.col("c_mktsegment")).alias("b"))
    return merge.ranked_fill(c, "k", ["a", "b"], "id")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority || '+' ELSE o_orderpriority END AS priority, CAST(o_orderdate AS DATE) AS first_seen FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, o_orderpriority || '+', DATE '2030-01-01' FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 4 = 0")
def upsert_keeps_first_seen(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.to_date("o_orderdate").alias("first_seen"))
    new = o.where("o_orderkey % 4 = 0").withColumns({"priority": F.concat("priority", F.lit("+")), "first_seen": F.lit("2030-01-01").cast("date")})
    return merge.upsert(o.where("o_orderkey % 3 <> 0"), new, "o_orderkey", keep=["first_seen"])


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND (p_partkey % 3 = 0 OR p_partkey % 5 = 0) THEN upper(p_brand) || '!' ELSE CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END END AS brand FROM part")
def field_protected_update(spark, sf):
    k = F.col("p_partkey")
    stored = t(spark, sf, "part").select(k, F.when(k % 3 == 0, "").otherwise(F.col("p_brand")).alias("brand"))
    found = t(spark, sf, "part").where("p_partkey % 2 = 0").select(k, F.concat(F.upper("p_brand"), F.lit("!")).alias("brand"), F.when(k % 5 == 0, F.array(F.lit("brand"))).otherwise(F.array().cast("array<string>")).alias("allowed"))
    return merge.protected_update(stored, found, "p_partkey", ["brand"])


@query("SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT -o_orderkey FROM orders WHERE o_custkey % 10 <> 0")
def cascade_delete(spark, sf):
    c, o = t(spark, sf, "customer").select("c_custkey"), t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    out = merge.cascade_delete(c, c.where("c_custkey % 10 = 0"), "c_custkey", {"orders": (o, "o_custkey")})
    return out["parents"].union(out["orders"].select(-F.col("o_orderkey")))


@query("SELECT c.c_custkey, coalesce(f.v, p.v) AS existing_v FROM customer c LEFT JOIN (SELECT c_nationkey, c_mktsegment, max(c_custkey) AS v FROM customer WHERE c_custkey % 50 = 0 GROUP BY 1, 2) f ON f.c_nationkey = c.c_nationkey AND f.c_mktsegment = c.c_mktsegment LEFT JOIN (SELECT c_nationkey, max(c_custkey) AS v FROM customer WHERE c_custkey % 50 = 0 GROUP BY 1) p ON p.c_nationkey = c.c_nationkey")
def intake_two_step_match(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("nation"), F.col("c_mktsegment").alias("segment"))
    m = c.where("c_custkey % 50 = 0").select("nation", "segment", F.col("c_custkey").alias("v"), F.col("c_custkey").alias("ord"))
    return merge.two_step_match(c, m, ["nation", "segment"], ["nation"], "ord", "v").select("c_custkey", "existing_v")


# ---- runs, schedules, statistics --------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events), h AS (SELECT * FROM r WHERE rn <= 100),
d AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY rn) AS k FROM h WHERE value > 20), a AS (SELECT event_type, round_even(avg(value), 2) AS average_runtime FROM d WHERE k <= 20 GROUP BY 1)
SELECT h.event_type, average_runtime, min(event_id) FILTER (WHERE rn = 1) AS latest_run FROM h LEFT JOIN a USING (event_type) GROUP BY 1, 2""")
def run_statistics(spark, sf):
    """Average of the last 20 completed among the last 100 runs of each job, and the latest run."""
    last = paging.top_per_key(t(spark, sf, "events"), ["event_type"], [F.desc("ts"), F.desc("event_id")], 100)
    done = paging.top_per_key(last.where("value > 20"), ["event_type"], [F.desc("ts"), F.desc("event_id")], 20).groupBy("event_type").agg(F.bround(F.avg("value"), 2).alias("average_runtime"))
    return last.groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest_run")).join(done, "event_type", "left")


@query("SELECT event_type, event_id, user_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark, sf):
    e = t(spark, sf, "events")
    return e.groupBy("event_type").agg(F.max_by(F.struct("event_id", "user_id", "value"), F.struct("ts", "event_id")).alias("r")).select("event_type", "r.*")


@query("SELECT CASE WHEN o_totalprice > 200000 THEN 'Collector Failed' WHEN o_orderstatus = 'O' THEN 'Jobs Collected' ELSE 'No Jobs Found' END AS outcome, count(*) AS n FROM orders GROUP BY 1")
def outcome_counts(spark, sf):
    outcome = F.when(F.col("o_totalprice") > 200000, "Collector Failed").when(F.col("o_orderstatus") == "O", "Jobs Collected").otherwise("No Jobs Found")
    return t(spark, sf, "orders").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT least(count(*), 50000) AS counted, count(*) > 50000 AS capped FROM (SELECT 1 FROM lineitem LIMIT 50001)")
def bounded_count(spark, sf):
    return paging.bounded_count(t(spark, sf, "lineitem").select("l_orderkey"), 50_000)


@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS applied, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, CAST(floor(avg(greatest(0, date_diff('day', CAST(o_orderdate AS DATE), DATE '2024-02-01'))) FILTER (WHERE o_orderstatus = 'F') + 0.5) AS BIGINT) AS average_days FROM orders")
def application_stats(spark, sf):
    days = F.greatest(F.lit(0), F.date_diff(F.lit("2024-02-01").cast("date"), F.to_date("o_orderdate")))
    return t(spark, sf, "orders").agg(F.count_if(F.col("o_orderstatus") == "F").alias("applied"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), N.half_up(F.avg(F.when(F.col("o_orderstatus") == "F", days))).alias("average_days"))


@query("""SELECT event_id, (strftime(ts - INTERVAL 7 HOUR, '%H:%M') >= '07:30' AND strftime(ts - INTERVAL 7 HOUR, '%Y-%m-%d') <> '2024-01-05' AND strftime(ts - INTERVAL 7 HOUR, '%a') IN ('Mon', 'Wed', 'Fri')) AS due FROM events""")
def due_schedules(spark, sf):
    """Every event's time as the clock of one schedule, in January's Denver time."""
    return t(spark, sf, "events").select("event_id", X.due(F.col("ts").cast("timestamp"), F.lit("America/Denver"), F.lit("07:30"), F.array(F.lit("Mon"), F.lit("Wed"), F.lit("Fri")), F.lit("2024-01-05")).alias("due"))


@query("SELECT event_id, value > 0 AND date_diff('second', ts, TIMESTAMP '2024-02-01') / 86400.0 < 7 AS recent FROM events")
def recency_skip(spark, sf):
    e = t(spark, sf, "events")
    return e.select("event_id", ((F.col("value") > 0) & X.within_days(F.col("ts").cast("string"), 7, F.lit(NOW).cast("timestamp"))).alias("recent"))


# ---- job list ---------------------------------------------------------------------------------------------------------------

_ORDERS = {
    "newest": (lambda: [F.desc("o_orderdate"), F.asc("c_name"), F.asc("o_orderkey")], "o_orderdate DESC, c_name, o_orderkey"),
    "highest_pay": (lambda: [F.desc("o_totalprice"), F.asc("o_orderkey")], "o_totalprice DESC, o_orderkey"),
    "best_fit": (lambda: [F.desc(F.coalesce(F.col("score"), F.lit(0))), F.asc("o_orderkey")], "coalesce(score, 0) DESC, o_orderkey"),
    "role": (lambda: [F.asc("role_rank"), F.asc("o_orderpriority"), F.asc("o_orderkey")], "role_rank, o_orderpriority, o_orderkey"),
    "company": (lambda: [F.asc("c_name"), F.asc("o_orderkey")], "c_name, o_orderkey"),
    "title": (lambda: [F.asc("o_orderpriority"), F.asc("o_orderkey")], "o_orderpriority, o_orderkey"),
}
_LIST = """WITH j AS (SELECT o_orderkey, c_name, n_name, o_orderpriority, o_totalprice, o_orderdate, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 101 END AS score, CAST(o_orderkey % 4 AS INTEGER) AS role_rank
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus = 'O' AND contains(lower(concat_ws(' ', o_orderpriority, c_name, n_name)), 'nation_1') AND o_totalprice >= 50000) """


def _job_list(spark, sf):
    j = t(spark, sf, "orders").where("o_orderstatus = 'O' AND o_totalprice >= 50000").join(t(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(F.broadcast(t(spark, sf, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))  # 25 rows
    j = j.where(F.contains(F.lower(F.concat_ws(" ", "o_orderpriority", "c_name", "n_name")), F.lit("nation_1")))
    return j.select("o_orderkey", "c_name", "n_name", "o_orderpriority", "o_totalprice", "o_orderdate", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 101).alias("score"), (F.col("o_orderkey") % 4).cast("int").alias("role_rank"))


def _listed(name: str):
    def run(spark, sf):
        return paging.page_of(_job_list(spark, sf), _ORDERS[name][0](), 1, 50).select("o_orderkey", "c_name", "n_name", "o_totalprice", "score", "role_rank")

    run.__name__ = f"job_list_{name}"
    run.__doc__ = f"First 50 open postings of a filtered list, by {name}."
    return run


for _name, (_, _sql) in _ORDERS.items():
    query(_LIST + f"SELECT o_orderkey, c_name, n_name, o_totalprice, score, role_rank FROM j ORDER BY {_sql} LIMIT 50")(_listed(_name))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND length(o_orderpriority) >= 4 AND lower(o_orderpriority) NOT LIKE '%not spec%' ORDER BY o_orderdate DESC, o_orderkey LIMIT 5")
def dashboard_recent(spark, sf):
    o = t(spark, sf, "orders").where((F.col("o_orderstatus") == "O") & (F.length("o_orderpriority") >= 4) & ~T.contains_any(F.lower("o_orderpriority"), ("not spec",)))
    return o.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(5).select("o_orderkey", "o_orderpriority")


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, 0) = 1 AS toxic, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l USING (doc_id)")
def job_with_application_defaults(spark, sf):
    l = t(spark, sf, "labels").withColumn("_l", F.lit(True))
    return t(spark, sf, "documents").select("doc_id").join(l, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), (F.coalesce("toxic", F.lit(0)) == 1).alias("toxic"), F.coalesce("_l", F.lit(False)).alias("labelled"))


# ---- text, URL, pay, roles --------------------------------------------------------------------------------------------------


@query(r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\.', '') AS domain FROM pages")
def url_domain_key(spark, sf):
    return t(spark, sf, "pages").select("page_id", U.domain_key("url").alias("domain"))


@query(r"SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) || CASE WHEN regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END || regexp_extract(url, '(\?[^#]+)', 1) AS canonical FROM pages")
def url_canonical(spark, sf):
    return t(spark, sf, "pages").select("page_id", U.canonical("url").alias("canonical"))


@query(r"SELECT page_id, array_to_string(list_filter(list_transform(string_split(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: regexp_replace(lower(trim(s)), '\.(html?|aspx?|php|jsp|cfm)$', '')), lambda s: s <> ''), '|') AS segments FROM pages")
def url_segments(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.array_join(U.segments("url"), "|").alias("segments"))


_HOST = r"regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1)"


@query(f"SELECT page_id, CASE WHEN {_HOST} = 'example.org' OR suffix({_HOST}, '.example.org') THEN true ELSE false END AS in_org, '' AS platform, 'Generic' AS collector FROM pages")
def platform_route(spark, sf):
    return t(spark, sf, "pages").select("page_id", U.in_domain(U.host("url"), "example.org").alias("in_org"), U.platform("url").alias("platform"), R.collector("url", F.lit("")).alias("collector"))


_SLUG = "coalesce(nullif(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown')"


@query(f"SELECT p_partkey, {_SLUG.format('p_name')} AS slug, 'company-' || {_SLUG.format('p_name')} || '-' || {_SLUG.format('p_brand')} AS company_id, 'job-' || substr({_SLUG.format('p_name')}, 1, 140) AS job_id FROM part")
def slug_and_stable_id(spark, sf):
    return t(spark, sf, "part").select("p_partkey", T.slug("p_name").alias("slug"), U.company_id(F.lit(""), F.lit(""), "p_name", "p_brand").alias("company_id"), U.job_id("p_name").alias("job_id"))


def _alternatives(words) -> str:
    return "|".join(w.replace("(", r"\(").replace(")", r"\)") for w in words)


_TITLE = f"""WITH x AS (SELECT doc_id, substr(regexp_replace(trim(regexp_replace(string_split(text, chr(10))[1], '[\\s]+', ' ', 'g')), '^(?i)(job title|title)\\s*[:\\-]\\s*', ''), 1, 180) AS shown FROM documents),
y AS (SELECT *, lower(shown) AS low, regexp_extract_all(lower(shown), '[a-z0-9]+') AS w FROM x),
z AS (SELECT *, len(list_filter(w, lambda v: v IN ({", ".join(f"'{v}'" for v in R.GENERIC_WORDS)}))) AS g, regexp_matches(low, '{_alternatives(R.PART_REJECTS)}') AS part,
 len(list_filter(w, lambda v: v IN ({", ".join(f"'{v}'" for v in R.ROLE_NOUNS)}))) > 0 AS noun FROM y),
s AS (SELECT *, CAST(CASE WHEN noun THEN 2 ELSE 0 END + CASE WHEN contains(low, 'member service') THEN 2 ELSE 0 END - CASE WHEN part THEN 4 ELSE 0 END - CASE WHEN g > 0 THEN 1 ELSE 0 END + CASE WHEN len(w) >= 3 THEN 1 ELSE 0 END AS INTEGER) AS score FROM z)
SELECT doc_id, score, CASE WHEN shown = '' THEN 'blank title' WHEN length(shown) < 4 THEN 'too short' WHEN low IN ({", ".join(f"'{v}'" for v in R.EXACT_REJECTS)}) THEN 'navigation/button label' WHEN part THEN 'boilerplate text'
 WHEN len(w) = 0 THEN 'no title words' WHEN g = len(w) THEN 'generic navigation words only' WHEN len(w) <= 2 AND g > 0 THEN 'short generic title' WHEN score < 1 THEN 'not enough real job title signal' ELSE 'unknown' END AS reason FROM s"""


@query(_TITLE)
def title_normalise_score_reason(spark, sf):
    line = T.job_title(F.get(F.split("text", "\n"), F.lit(0)))
    d = t(spark, sf, "documents").select("doc_id", line.alias("line"))
    return d.select("doc_id", R.title_score("line").alias("score"), R.title_rejection("line").alias("reason"))


@query()
def pay_extract(spark, sf):
    """Look-behind patterns, which the oracle's regex engine lacks; tests hold the cases."""
    return t(spark, sf, "documents").select("doc_id", R.pay("text").alias("p")).select("doc_id", "p.*")


@query("""SELECT p_partkey, 'From $' || CASE WHEN p_retailprice = floor(p_retailprice) THEN format('{:,}', CAST(p_retailprice AS BIGINT)) ELSE format('{:,.2f}', p_retailprice) END || ' per year' AS shown FROM part""")
def pay_display(spark, sf):
    return t(spark, sf, "part").select("p_partkey", N.pay_display(F.lit(""), F.col("p_retailprice"), F.lit(None).cast("double"), F.lit("annual"), F.lit("USD")).alias("shown"))


def _first_pattern(patterns, x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{p}') THEN '{p}'" for p in patterns) + " END"


@query(f"""WITH r AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Chief Risk Officer' WHEN 1 THEN 'Branch Manager' WHEN 2 THEN 'Team Lead' WHEN 3 THEN 'Security Analyst' WHEN 4 THEN 'Teller' ELSE '' END AS title, lower(text) AS low FROM documents),
p AS (SELECT *, {_first_pattern(R.EXEC_TITLES, 'lower(title)')} AS ex, {_first_pattern(R.MANAGER_TITLES, 'lower(title)')} AS mt FROM r)
SELECT doc_id, CASE WHEN title = '' THEN 'UNKNOWN' WHEN ex IS NOT NULL THEN 'EXEC' WHEN mt IS NOT NULL THEN 'MGR' ELSE 'IC' END AS type,
CASE WHEN title = '' THEN 'Title missing or unclear.' WHEN ex IS NOT NULL THEN 'Matched executive title pattern ''' || ex || '''.' WHEN mt IS NOT NULL THEN 'Matched manager title pattern ''' || mt || '''.' ELSE 'Matched individual contributor title keyword.' END AS reason FROM p""")
def role_type(spark, sf):
    titles = F.array(*map(F.lit, ("Chief Risk Officer", "Branch Manager", "Team Lead", "Security Analyst", "Teller", "")))
    d = t(spark, sf, "documents").select("doc_id", F.element_at(titles, (F.col("doc_id") % 6 + 1).cast("int")).alias("title"), "text")
    return d.select("doc_id", R.role_type("title", "text").alias("r")).select("doc_id", "r.*")


def _match_sql() -> str:
    norm = lambda x: f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9+.#\\s-]', ' ', 'g'), '\\s+', ' ', 'g'))"
    stop = ", ".join(f"'{w}'" for w in T.MATCH_STOP)
    words = lambda x: f"list_filter(string_split({x}, ' '), lambda v: length(v) > 4 AND v NOT IN ({stop}))"
    tracked = "[" + ", ".join(f"'{k}'" for k in R.TRACKED) + "]"
    first = lambda x: f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"  # noqa: E731  distinct, in order
    return f"""WITH d AS (SELECT doc_id, {norm("substr(text, 1, 80)")} AS title, {norm("substr(text, 1, 80) || ' ' || substr(text, 81)")} AS n, {norm("(SELECT string_agg(text, ' ' ORDER BY turn) FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations))")} AS resume FROM documents),
w AS (SELECT *, {words("n")} AS nw, {words("title")} AS tw FROM d), u AS (SELECT *, {first("nw")} AS un, {first("tw")} AS ut FROM w),
k AS (SELECT *, list_concat(list_filter({tracked}, lambda v: contains(n, v)), un[1:30]) AS ka FROM u), q AS (SELECT *, {first("ka")} AS kw FROM k),
h AS (SELECT *, len(list_filter(kw, lambda v: contains(resume, v))) AS hk, len(list_filter(ut, lambda v: contains(resume, v))) AS ht FROM q),
s AS (SELECT doc_id, hk, least(100, CAST(round_even(CAST(CASE WHEN len(kw) = 0 THEN 0 ELSE hk / len(kw) * 60 END + CASE WHEN len(ut) = 0 THEN 0 ELSE ht / len(ut) * 25 END
 + CASE WHEN regexp_matches(resume, '\\b(?:[3-9]|1\\d)\\+?\\s+years?\\b') THEN 10 ELSE 0 END + CASE WHEN contains(resume, 'remote') THEN 5 ELSE 2 END AS DOUBLE), 0) AS BIGINT)) AS score FROM h)
SELECT doc_id, score, CAST(hk AS BIGINT) AS matched, CASE WHEN score >= 80 THEN 'Strong Match' WHEN score >= 60 THEN 'Good Match' WHEN score >= 40 THEN 'Moderate Match' ELSE 'Low Match' END AS label FROM s"""


def _resume(spark, sf):
    c = t(spark, sf, "conversations")
    first = c.agg(F.min("conv_id").alias("conv_id"))
    return c.join(F.broadcast(first), "conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x.getField("text")), " ").alias("resume"))  # one conversation


@query(_match_sql())
def resume_match_score(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.substring("text", 1, 80).alias("title"), F.expr("substring(text, 81)").alias("body"))
    found = keywords.score_postings(d, _resume(spark, sf).withColumn("resume_id", F.lit("current")), keep=["doc_id"])
    return found.select("row.doc_id", F.col("score").cast("bigint").alias("score"), F.size("matched").cast("bigint").alias("matched"), "label")


@query("""WITH k AS (SELECT DISTINCT k FROM (SELECT unnest(string_split(lower(text), ' ')) AS k FROM benchmark) WHERE length(k) >= 6),
f AS (SELECT doc_id, string_agg(k, ' ' ORDER BY k) AS found, count(*) AS n_found FROM documents JOIN k ON contains(text, k) GROUP BY doc_id)
SELECT doc_id, coalesce(n_found, 0) AS n_found, md5(coalesce(found, '')) AS found_md5 FROM documents LEFT JOIN f USING (doc_id)""")
def keyword_containment(spark, sf):
    """Which of some thousand keywords stand anywhere in a text: one pass, however many there are."""
    known = t(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("keyword")).where(F.length("keyword") >= 6)
    found = keywords.contained(t(spark, sf, "documents").select("doc_id", "text"), F.col("text"), known)
    return found.select("row.doc_id", F.size("found").cast("bigint").alias("n_found"), F.md5(F.array_join("found", " ")).alias("found_md5"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Not Matched' WHEN doc_id % 4 = 1 OR doc_id % 10 = 3 THEN 'Needs Rematch' WHEN doc_id % 3 = 0 THEN 'Match Failed' ELSE 'Matched' END AS status FROM documents")
def match_status(spark, sf):
    """Stored results go stale with the resume's version or the posting's fingerprint."""
    k, now = F.col("doc_id"), R.fingerprint("text", "lang")
    then = R.fingerprint(F.when(k % 10 == 3, F.concat("text", F.lit("."))).otherwise(F.col("text")), "lang")
    stored = F.when(k % 4 != 0, F.struct(F.when(k % 3 == 0, "Failed").otherwise("Matched").alias("status"), F.when(k % 4 == 1, "v1").otherwise("v2").alias("version"), then.alias("fingerprint"), F.lit("2").alias("algorithm")))
    return t(spark, sf, "documents").select("doc_id", R.match_status(stored, F.lit("v2"), now, "2").alias("status"))


@query()
def metadata_signals(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.array_join(R.metadata_signals("text"), "|").alias("signals"), F.array_join(R.benefit_terms("text"), "|").alias("benefits"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS valid FROM events")
def json_paths(spark, sf):
    return t(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.try_parse_json("props").isNotNull().alias("valid"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber // 3 AS page, count(*) AS n FROM lineitem GROUP BY 1, 2), b AS (SELECT l_orderkey, CAST(sum(n) AS BIGINT) AS seen, count(*) AS pages FROM p GROUP BY 1), d AS (SELECT l_orderkey, max(l_linenumber) AS declared FROM lineitem GROUP BY 1)
SELECT l_orderkey, seen, pages, declared, seen = declared AS complete FROM b JOIN d USING (l_orderkey)""")
def pagination_completeness(spark, sf):
    """Pages of a board against the total that the board declares."""
    pages = t(spark, sf, "lineitem").groupBy("l_orderkey", F.floor(F.col("l_linenumber") / 3).alias("page")).agg(F.count("*").alias("n"), F.max("l_linenumber").alias("declared"))
    return pages.groupBy("l_orderkey").agg(F.sum("n").alias("seen"), F.count("*").alias("pages"), F.max("declared").alias("declared")).withColumn("complete", F.col("seen") == F.col("declared"))


# ---- pages ------------------------------------------------------------------------------------------------------------------


@query()
def page_links(spark, sf):
    """Links with their label and absolute URL; a document tree is beyond the oracle's SQL."""
    return P.links(t(spark, sf, "pages")).select("page_id", "ord", "label", "url")


@query()
def page_title_h1(spark, sf):
    return P.flatten(t(spark, sf, "pages")).select("page_id", "title", "h1")


@query()
def page_chrome_filter(spark, sf):
    return P.links(t(spark, sf, "pages")).groupBy(P.chrome_reason("around").alias("reason")).agg(F.count("*").alias("n"))


@query()
def evidence_verdict(spark, sf):
    """Every link of every page as a posting candidate, with the verdict."""
    found = P.links(t(spark, sf, "pages"))
    verdict = R.evidence(F.col("label"), F.col("url"), P.chrome_reason("around"), P.in_job_list("around"), R.metadata_signals("label"), F.lit(False), F.col("page_url"))
    return found.select("page_id", "ord", verdict.alias("v")).select("page_id", "ord", "v.*")


@query()
def official_website_score(spark, sf):
    """Each page as a candidate for its own site's company."""
    flat = P.flatten(t(spark, sf, "pages"))
    s = D.website_score(F.regexp_replace(U.registered_domain("url"), r"\..*$", " bank"), F.col("url"), F.col("text"), F.lit(""), F.lit(""))
    return flat.select("page_id", s.alias("s")).select("page_id", "s.*")


@query()
def job_board_pick(spark, sf):
    """The best job-board link of each page's site."""
    found = P.links(t(spark, sf, "pages")).withColumn("site", U.registered_domain("page_url"))
    s = D.board_score(F.col("site"), F.col("url"), F.col("label"), F.lit(True))
    return D.best_board(found.select("site", "url", "ord", F.lit(0).alias("stage"), s.alias("s")).select("site", "url", "ord", "stage", "s.*"), "site", "stage", "ord")
