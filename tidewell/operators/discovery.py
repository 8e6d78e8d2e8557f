"""Finding a company's site and job board from landed evidence: search hits, pages, links. Fetching is no part of this.

Scores are arithmetic over named signals; picks are aggregates by (score, earliest), never a sort of all candidates.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U
from . import scans

# ---- Fixed values ----
FINANCE = ("bank", "banking", "credit union", "federal credit union", "checking", "savings", "loans", "mortgage", "routing number", "ncua", "fdic", "online banking")
SITE_PARTS = ("online banking", "checking", "savings", "loans", "locations", "contact", "careers")
PARKED = ("domain for sale", "buy this domain", "parked", "this domain is available", "under construction", "coming soon")
BOARD_TERMS = (
    "careers", "employment", "openings", "open positions", "current openings", "search jobs", "search and apply", "apply now", "job opportunities", "join our team", "work with us", "working at", "recruiting", "recruitment", "talent community",
)
BOARD_LABELS = ("search jobs", "current openings", "open positions", "careers", "apply now", "join our team")
NOT_A_BOARD = (
    "loan", "loan-application", "loan application", "mortgage application", "membership application", "member application", "account application", "online banking", "credit card application", "/reviews", "reviews?", "/salaries", "/interviews",
    "login", "log-in", "signin", "sign-in", "pdf",
)
AGGREGATORS = ("indeed.com", "glassdoor.com", "ziprecruiter.com", "linkedin.com", "monster.com", "careerbuilder.com", "simplyhired.com")


def count_of(text: Column, terms) -> Column:
    return sum((F.when(text.contains(t), 1).otherwise(0) for t in terms), F.lit(0))


def website_score(company: Column | str, url: Column | str, page: Column | str, city: Column | str, state_name: Column | str) -> Column:
    """struct(score, confidence, verified, reason): how surely a page is the company's official site.

    +18 domain like the name, +12 a name word, +6 a finance term (at most 30), +3 a site part (at most 18), +5 the place; -35 no
    name word, -30 no finance term, -50 a bare job board, -50 parked.
    """
    text = F.lower(T.blank(page))
    words = F.size(F.filter(T.identity_tokens(company), lambda w: text.contains(w)))
    finance, parts = count_of(text, FINANCE), count_of(text, SITE_PARTS)
    own = U.matches_company(company, url)
    place = F.exists(F.filter(F.array(F.lower(F.trim(T.blank(city))), F.lower(F.trim(T.blank(state_name)))), lambda p: p != ""), lambda p: text.contains(p))
    board_only = (U.platform(url) != "") & (finance == 0)
    point = lambda test, n: F.when(test, n).otherwise(0)
    score = (
        point(own, 18) + 12 * words + F.least(F.lit(30), 6 * finance) + F.least(F.lit(18), 3 * parts) + point(place, 5) - point(words == 0, 35) - point(finance == 0, 30) - point(board_only, 50)
        - point((F.length(F.trim(text)) < 40) | T.contains_any(text, PARKED), 50)
    )
    refused = U.disallowed(url) | (T.blank(url) == "")
    high = (score >= 55) & (words > 0) & (finance > 0)
    medium = (score >= 35) & ((words > 0) | own) & (finance > 0)
    return F.struct(
        F.when(refused, 0).otherwise(score).alias("score"), F.when(refused, "None").when(high, "High").when(medium, "Medium").when(score < 10, "Low").otherwise("None").alias("confidence"), (~refused & (high | medium)).alias("verified"),
        F.when(refused, "third-party, directory, review, social, job board, or document URL").otherwise("").alias("reason"),
    )


def link_score(label: Column | str, href: Column | str) -> Column:
    """+10 a careers term in label or link, +18 a strong label, +14 a careers path, -15 a label over 120 characters."""
    shown, low = T.squash(label), F.lower(T.blank(label))
    both = F.concat(low, F.lit(" "), F.lower(T.blank(href)))
    return 10 * count_of(both, BOARD_TERMS) + 18 * count_of(low, BOARD_LABELS) + F.when(F.lower(T.blank(href)).rlike("/(jobs|careers|employment|openings)(/|$|-)"), 14).otherwise(0) - F.when(F.length(shown) > 120, 15).otherwise(0)


def board_rejection(url: Column | str, h: Column | None = None) -> Column:
    """Why a URL is no job board, the first reason that holds; ''. ``h``: its host, where it is at hand."""
    low, aggregator = F.lower(T.blank(url)), U.in_domains(U.host(url) if h is None else h, AGGREGATORS)
    return F.when(low == "", "blank URL").when(~low.startswith("http"), "unsupported URL").when(aggregator, "job aggregator").when(T.contains_any(low, NOT_A_BOARD), "rejected URL term").when(U.disallowed(url, h) & (U.platform(url, h=h) == ""), "third-party site").otherwise("")


def board_score(company: Column | str, url: Column | str, label: Column | str, from_official: Column, clicked: Column | None = None) -> Column:
    """struct(score, platform, rejected, reason) of a board candidate: link terms, +70 a platform, +20 the company's name, +18 found on its own page, +14 clicked, +18 a careers URL."""
    reason, name = board_rejection(url), U.platform(url)
    point = lambda test, n: F.when(test, n).otherwise(0)
    score = link_score(label, url) + point(name != "", 70) + point(U.matches_company(company, url), 20) + point(from_official, 18) + point(F.lit(False) if clicked is None else clicked, 14) + point(F.lower(T.blank(url)).rlike("careers|jobs|employment|openings"), 18)
    weak = (score < 35) & (name == "")
    return F.struct(F.when(reason != "", -100).otherwise(score).alias("score"), name.alias("platform"), ((reason != "") | weak).alias("rejected"), F.when(reason != "", reason).when(weak, "weak careers/jobs signal").otherwise("").alias("reason"))


def best_board(candidates: DataFrame, key: str, stage: str, order: str) -> DataFrame:
    """One board a company from scored candidates (score, platform, rejected): within the earliest stage that has an acceptable one
    (55 points or a platform), the highest score, of equals the first."""
    good = candidates.where("NOT rejected AND (score >= 55 OR platform <> '')")
    row = F.struct(*good.columns)
    return good.groupBy(key).agg(F.max_by(row, F.struct(-F.col(stage), "score", -F.col(order))).alias("_r")).select("_r.*")


def best_website(candidates: DataFrame, key: str, order: str) -> DataFrame:
    """One site a company: in order, a candidate takes over if its confidence ranks higher or its score is higher; a verified
    High ends the search. "Or" makes this depend on the order: a company's few candidates are folded as one array. A company with very
    many is cut into segments, of which each is summed up as a table - for whatever leads before it, who leads behind it - and
    only these are folded. ``order``: a number or time.
    """
    rank = F.when(F.col("confidence") == "High", 3).when(F.col("confidence") == "Medium", 2).when(F.col("confidence") == "Low", 1).otherwise(0)
    kept = candidates.where("confidence <> 'None' OR score > 0").select(F.col(key).alias("_key"), F.col(order).alias("o"), rank.alias("rank"), "score", "url", "confidence", "verified")
    kept, hot = scans.segmented(kept, "_key", "o")
    few = kept.where("not _hot").groupBy("_key").agg(F.sort_array(F.collect_list(F.struct(*SITE))).alias("rows"))

    def step(best: Column, x: Column) -> Column:
        done = (best.getField("confidence") == "High") & best.getField("verified")
        better = (x.getField("rank") > best.getField("rank")) | (x.getField("score") > best.getField("score"))
        return F.when(~done & better, x).otherwise(best)

    out = few.select("_key", F.aggregate(F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0))), F.get("rows", F.lit(0)), step).alias("b"))
    if hot:
        row = kept.select(F.struct(*SITE).alias("row")).schema["row"].dataType.simpleString()
        name = kept.schema["_key"].dataType.simpleString()
        tables = kept.where("_hot").groupBy("_key", "_seg").applyInArrow(_site_segment, f"_key {name}, _seg int, first {row}, by_rank array<struct<at:bigint,row:{row}>>, by_score array<struct<at:bigint,score:double,row:{row}>>")
        out = out.unionByName(tables.groupBy("_key").applyInArrow(_site_chain, f"_key {name}, b {row}"))
    return out.select(F.col("_key").alias(key), "b.url", "b.score", "b.confidence", "b.verified")


SITE = ("o", "rank", "score", "url", "confidence", "verified")


def _site_segment(table: pa.Table) -> pa.Table:
    """One segment as a table: who leads behind it if its first row leads at its start (first), if the leader before has rank r (by_rank[r]: from the
    first row of a higher rank on), or a score below a record of the segment (by_score: from that record on)."""
    rows = sorted(table.select(SITE).to_pylist(), key=lambda x: tuple(x[c] for c in SITE))
    end, later, higher = [0] * len(rows), [len(rows)] * 4, []  # later[r]: the nearest row behind with a rank over r; higher: behind, ever larger scores
    for i in range(len(rows) - 1, -1, -1):
        x = rows[i]
        while higher and rows[higher[-1]]["score"] <= x["score"]:
            higher.pop()
        follows = min(later[x["rank"]], higher[-1] if higher else len(rows))
        end[i] = i if follows == len(rows) or x["confidence"] == "High" and x["verified"] else end[follows]
        higher.append(i)
        later = [i if x["rank"] > r else later[r] for r in range(4)]
    by_rank = [{"at": at, "row": rows[end[at]] if at < len(rows) else None} for at in later]
    by_score = [{"at": i, "score": float(rows[i]["score"]), "row": rows[end[i]]} for i in _records(rows)]
    of = {"_key": [table["_key"][0].as_py()], "_seg": [table["_seg"][0].as_py()], "first": [rows[end[0]]], "by_rank": [by_rank], "by_score": [by_score]}
    site = pa.struct([table.schema.field(c) for c in SITE])
    kinds = (table.schema.field("_key").type, pa.int32(), site, pa.list_(pa.struct([("at", pa.int64()), ("row", site)])), pa.list_(pa.struct([("at", pa.int64()), ("score", pa.float64()), ("row", site)])))
    return pa.table([pa.array(v, t) for v, t in zip(of.values(), kinds)], names=list(of))


def _records(rows: list[dict]) -> list[int]:
    """The rows with a higher score than all before them."""
    out: list[int] = []
    for i, x in enumerate(rows):
        if not out or x["score"] > rows[out[-1]]["score"]:
            out.append(i)
    return out


def _site_chain(table: pa.Table) -> pa.Table:
    """The segments of one company, folded."""
    best = None
    for seg in sorted(table.to_pylist(), key=lambda s: s["_seg"]):
        if best is None:
            best = seg["first"]
        elif not (best["confidence"] == "High" and best["verified"]):
            ways = [x for x in (seg["by_rank"][best["rank"]], next((x for x in seg["by_score"] if x["score"] > best["score"]), None)) if x and x["row"]]
            best = min(ways, key=lambda x: x["at"])["row"] if ways else best
    return pa.table([pa.array([table["_key"][0].as_py()], table.schema.field("_key").type), pa.array([best], table.schema.field("first").type)], names=["_key", "b"])


def rank_hits(hits: DataFrame, company: str = "company_id", most: int = 8, per_phrase: int = 4) -> DataFrame:
    """Search hits (company, phrase_no, hit_no, url): the first per_phrase of each phrase, each URL once, in order of arrival, at most ``most``."""
    from pyspark.sql import Window as W

    once = hits.where(F.col("hit_no") <= per_phrase).groupBy(company, "url").agg(F.min(F.struct("phrase_no", "hit_no")).alias("at"))
    return once.withColumn("rank", F.row_number().over(W.partitionBy(company).orderBy("at", "url"))).where(F.col("rank") <= most).drop("at")


def first_source() -> Column:
    """Where a company's postings come from: its board, else its feed if one was found, else nothing."""
    board, feed = F.trim(T.blank("job_board_url")), F.trim(T.blank("jobs_rss_feed_url"))
    return F.when(board != "", F.struct(F.lit("board").alias("kind"), board.alias("url"))).when(F.lower(T.blank("feed_found")).isin("true", "yes", "1") & (feed != ""), F.struct(F.lit("feed").alias("kind"), feed.alias("url"))).otherwise(F.struct(F.lit("none").alias("kind"), F.lit("").alias("url")))


def missing_fields(columns: list[str]) -> Column:
    """The names of blank or clearly invalid company fields."""
    bad = lambda c: (T.blank(c) == "") | T.blank(c).rlike("(?i)^(n/?a|none|null|unknown|not found|-+)$")
    return F.array_compact(F.array(*(F.when(bad(c), F.lit(c)) for c in columns)))


def diagnostic(jobs_saved: Column, error: Column | str, generic: Column) -> Column:
    """struct(status, notes) of one collection."""
    failed = T.blank(error) != ""
    status = F.when(failed, "Collector Failed").when(jobs_saved > 0, "Jobs Collected").otherwise("No Jobs Found")
    notes = (
        F.when(failed, F.concat(F.lit("Collector failed: "), T.blank(error))).when(jobs_saved > 0, "Real job records were saved after validation.")
        .when(generic, "No validated jobs saved from generic page parsing; review source page or add a platform-specific collector.").otherwise("No validated jobs saved; platform collector needs review.")
    )
    return F.struct(status.alias("status"), notes.alias("notes"))
