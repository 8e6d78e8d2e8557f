"""Column functions over the driver's own columns (texts, URLs, times, amounts), each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import rules as R
from ..functions import text as T
from ..functions import timefn as X
from ..functions import url as U
from .queries import query, t

_DISTINCT = "list_filter({0}, lambda v, i: list_position({0}, v) = i)"


@query(f"""WITH n AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, '.', ';') || ';' || source || ';' || lang, ';'), lambda x: trim(x)), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, md5(array_to_string({_DISTINCT.format('w')}, '; ')) AS out FROM n""")
def text_notes(spark, sf):
    """Notes merged, each once: a text's sentences, its source and its language."""
    return t(spark, sf, "documents").select("doc_id", F.md5(T.merge_notes(F.replace("text", F.lit("."), F.lit(";")), "source", "lang")).alias("out"))


@query("SELECT doc_id, md5(CASE WHEN length(s) >= 40 THEN substr(s, 1, 1500) ELSE '' END) AS out FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM documents)")
def text_descriptions(spark, sf):
    """Descriptions: squashed, none below 40 characters."""
    return t(spark, sf, "documents").select("doc_id", F.md5(T.description("text")).alias("out"))


@query("SELECT doc_id, md5(array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ('credit', 'union', 'federal', 'bank', 'national', 'association', 'the', 'and')), '|')) AS out FROM documents")
def text_identity_tokens(spark, sf):
    """Words that tell a company, of whole texts."""
    return t(spark, sf, "documents").select("doc_id", F.md5(F.array_join(T.identity_tokens("text"), "|")).alias("out"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\\breleased under the\\b') THEN 'released under the' WHEN regexp_matches(text, '(?i)\\bmit license\\b') THEN 'mit license' WHEN regexp_matches(text, '(?i)\\blicense\\b') THEN 'license' WHEN regexp_matches(text, '(?i)\\btoken\\b') THEN 'token' ELSE '' END AS out FROM documents""")
def text_longest_phrase(spark, sf):
    """The longest of four phrases that stands in a text as whole words."""
    return t(spark, sf, "documents").select("doc_id", T.longest_phrase("text", ("license", "token", "mit license", "released under the")).alias("out"))


@query("""WITH m AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+') AS w FROM documents), l AS (SELECT doc_id, list_transform(w, lambda x: lower(x)) AS w FROM m),
d AS (SELECT doc_id, list_filter(w, lambda v, i: list_position(w, v) = i) AS w FROM l)
SELECT doc_id, CASE WHEN len(w) <= 50 AND len(list_filter(w, lambda x: NOT regexp_full_match(x, '[^@\\s]+@[^@\\s]+\\.[^@\\s]+'))) = 0 THEN array_to_string(w, '|') END AS out FROM d""")
def text_recipients(spark, sf):
    """The addresses of a text as a list of recipients; null where one is none or there are more than fifty."""
    found = F.array_join(F.regexp_extract_all("text", F.lit("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"), F.lit(0)), "; ")
    return t(spark, sf, "documents").select("doc_id", F.array_join(T.recipients(found), "|").alias("out"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, CASE l_partkey % 4 WHEN 0 THEN '=' WHEN 1 THEN ' @' WHEN 2 THEN 'JavaScript:' ELSE '' END || l_returnflag || ' ' || l_linestatus AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN regexp_matches(ltrim(s), '^[=+\\-@]') OR regexp_matches(ltrim(s), '(?i)^(javascript|data|vbscript|file):') THEN '''' || s ELSE s END AS out FROM s""")
def text_safe_cells(spark, sf):
    """Cells of a sheet, three in four of which would run."""
    lead = F.element_at(F.array(*map(F.lit, ("=", " @", "JavaScript:", ""))), (F.col("l_partkey") % 4 + 1).cast("int"))
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.safe_cell(F.concat(lead, "l_returnflag", F.lit(" "), "l_linestatus")).alias("out"))


_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1))"


@query(f"SELECT page_id, array_to_string((string_split({_HOST}, '.'))[-2:], '.') AS out FROM pages")
def url_registered_domain(spark, sf):
    """The domain of a page's host; none of them has a suffix of two labels."""
    return t(spark, sf, "pages").select("page_id", U.registered_domain("url").alias("out"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') || '/' AS out FROM pages")
def url_site_root(spark, sf):
    return t(spark, sf, "pages").select("page_id", U.site_root("url").alias("out"))


@query(f"""SELECT page_id, regexp_matches(lower(x), '\\.(pdf|doc|docx)$|routing-number|routingnumber|reviews|review|directory|branches') OR regexp_matches(h, '(^|\\.)(yelp\\.com|facebook\\.com)$') AS out
FROM (SELECT page_id, x, lower(regexp_extract(x, '^[a-z]+://([^/?#:]*)', 1)) AS h FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'https://www.yelp.com/' || page_id WHEN 2 THEN 'https://site' || page_id || '.com/a.PDF' WHEN 3 THEN url || '/reviews' ELSE 'https://notyelp.com/' || page_id END AS x FROM pages))""")
def url_disallowed(spark, sf):
    """Pages' own URLs, listings, documents and review pages."""
    k, own = F.col("page_id"), F.col("url")
    shown = F.when(k % 5 == 0, own).when(k % 5 == 1, F.concat(F.lit("https://www.yelp.com/"), k.cast("string"))).when(k % 5 == 2, F.concat(F.lit("https://site"), k.cast("string"), F.lit(".com/a.PDF"))).when(k % 5 == 3, F.concat(own, F.lit("/reviews"))).otherwise(F.concat(F.lit("https://notyelp.com/"), k.cast("string")))
    return t(spark, sf, "pages").select("page_id", U.disallowed(shown).alias("out"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 1 THEN '' ELSE url END AS out FROM pages")
def url_safe_link(spark, sf):
    """Links that a mail may hold; each third is a script."""
    return t(spark, sf, "pages").select("page_id", U.safe_link(F.when(F.col("page_id") % 3 == 1, F.concat(F.lit("javascript:"), "url")).otherwise(F.concat(F.lit(" "), "url"))).alias("out"))


@query("SELECT event_id, regexp_full_match(c, '([01][0-9]|2[0-3]):[0-5][0-9]') AS out FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%H:%M') WHEN event_id % 3 = 1 THEN hour(ts) || ':' || minute(ts) ELSE (hour(ts) + 12) || ':' || strftime(ts, '%M') END AS c FROM events)")
def time_clock(spark, sf):
    """HH:MM as a clock shows it: times of events, some without their zeros, some past midnight."""
    k, h = F.col("event_id"), F.hour("ts")
    shown = F.when(k % 3 == 0, F.date_format("ts", "HH:mm")).when(k % 3 == 1, F.concat(h.cast("string"), F.lit(":"), F.minute("ts").cast("string"))).otherwise(F.concat((h + 12).cast("string"), F.lit(":"), F.date_format("ts", "mm")))
    return t(spark, sf, "events").select("event_id", X.is_clock(shown).alias("out"))


@query("SELECT event_id, greatest(0, round_even((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 1e6, 2)) AS out FROM events")
def time_elapsed(spark, sf):
    """Seconds to a fixed end, never below 0."""
    return t(spark, sf, "events").select("event_id", X.elapsed_seconds(F.col("ts").cast("string"), F.lit("2024-02-01T00:00:00Z")).alias("out"))


@query("SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL WHEN 3 THEN strftime(TIMESTAMP '2024-05-05 15:00:00' - to_days(CAST(event_id % 90 AS INTEGER)), '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%d') END AS out FROM events")
def time_posted(spark, sf):
    """A posting's free date text in four spellings, and one that is no date."""
    k, ts = F.col("event_id"), F.col("ts")
    shown = F.when(k % 5 == 0, F.date_format(ts, "yyyy-MM-dd")).when(k % 5 == 1, F.date_format(ts, "MMM d, yyyy")).when(k % 5 == 2, F.concat(F.lit("on "), F.date_format(ts, "M/d/yyyy"))).when(k % 5 == 3, F.concat((k % 90).cast("string"), F.lit("+ days ago"))).otherwise(F.lit("soon"))
    return t(spark, sf, "events").select("event_id", F.date_format(X.posted(shown, F.lit("2024-05-05 15:00:00").cast("timestamp")), "yyyy-MM-dd").alias("out"))


@query("SELECT event_id, CASE WHEN strftime(ts - INTERVAL 7 HOUR, '%H:%M') >= '07:30' THEN strftime(ts - INTERVAL 7 HOUR, '%Y-%m-%d') ELSE '' END AS out FROM events WHERE ts < TIMESTAMP '2024-03-10'")
def time_suppressed(spark, sf):
    """Switched on at an event's time, in Denver's winter: after today's run time today counts as done."""
    return t(spark, sf, "events").where("ts < timestamp '2024-03-10'").select("event_id", X.suppressed_on_enable(F.col("ts"), F.lit("America/Denver"), F.lit("07:30")).alias("out"))


@query("SELECT c_custkey, CAST(CASE c_custkey % 5 WHEN 0 THEN 90 WHEN 1 THEN 65 WHEN 2 THEN 35 WHEN 3 THEN floor(c_acctbal) ELSE 0 END AS BIGINT) AS out FROM customer")
def number_confidence(spark, sf):
    """Confidence words and numbers."""
    k = F.col("c_custkey")
    shown = F.when(k % 5 == 0, "High ").when(k % 5 == 1, "medium").when(k % 5 == 2, "LOW").when(k % 5 == 3, F.col("c_acctbal").cast("string")).otherwise("?")
    return t(spark, sf, "customer").select("c_custkey", N.confidence(shown).cast("bigint").alias("out"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE round(o_totalprice, 2) END AS out FROM orders")
def number_strict(spark, sf):
    """Amounts as they are written, with commas, and texts that are no number."""
    shown = F.when(F.col("o_orderkey") % 4 == 3, "n/a").otherwise(F.concat(F.lit(" "), F.format_number("o_totalprice", 2)))
    return t(spark, sf, "orders").select("o_orderkey", N.number(shown).alias("out"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(x, 'remote|work from home|telecommut') THEN 'Remote' WHEN contains(x, 'hybrid') THEN 'Hybrid' WHEN regexp_matches(x, 'on-?site|on site|in-?office|in person') THEN 'Onsite' ELSE 'Not Listed' END AS out
FROM (SELECT doc_id, lower(text || CASE doc_id % 6 WHEN 0 THEN ' Work from HOME' WHEN 1 THEN ' hybrid, some remote days' WHEN 2 THEN ' Hybrid' WHEN 3 THEN ' in-office' ELSE '' END) AS x FROM documents)""")
def work_types(spark, sf):
    """Remote, hybrid or on site, in whole texts with a note at the end."""
    notes = F.element_at(F.array(*map(F.lit, (" Work from HOME", " hybrid, some remote days", " Hybrid", " in-office", "", ""))), (F.col("doc_id") % 6 + 1).cast("int"))
    return t(spark, sf, "documents").select("doc_id", R.work_type(F.concat("text", notes)).alias("out"))
