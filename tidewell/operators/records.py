"""Changes of records: creating and updating companies, snapshots, candidates, applications with legacy ids, settings, back-fills.

Tables are DataFrames; a change gives the whole new table or the rows it concerns with what became of them. Changes come as tables too,
so a thousand updates are one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import blank, name_key

NEEDS_REVIEW, BY_HAND = "Needs Review", "Manual Re-verification Required"
URLS = ("officialWebsite", "careersPageUrl", "jobBoardUrl")


def name_owner(companies: DataFrame) -> DataFrame:
    """(key, owner, stored): who has a normalised name: those that store it first, then the oldest, then the smallest id."""
    named = companies.select(name_key("name").alias("key"), F.struct(F.when(blank("normalizedName") != "", 0).otherwise(1).alias("late"), "createdAt", "id").alias("at")).where("key <> ''")
    return named.groupBy("key").agg(F.min("at").alias("at")).select("key", F.col("at.id").alias("owner"))


def create(companies: DataFrame, new: DataFrame) -> DataFrame:
    """What becomes of each new company (id, name, companyWebsite, jobBoardUrl, createdAt): ``outcome`` created, duplicate or invalid, and
    ``duplicateOf``. Of new ones with one name the first (createdAt, id) is created."""
    key = name_key("name")
    first = F.row_number().over(W.partitionBy("key").orderBy("createdAt", "id"))
    asked = new.withColumn("key", key).withColumn("turn", first).join(name_owner(companies), "key", "left")
    ahead = asked.where("turn = 1").select("key", F.col("id").alias("first_id"))
    met = asked.join(ahead, "key", "left").withColumn("duplicateOf", F.coalesce("owner", F.when(F.col("turn") > 1, F.col("first_id"))))
    outcome = F.when(F.col("key") == "", "invalid").when(F.col("duplicateOf").isNotNull(), "duplicate").otherwise("created")
    kept = met.withColumn("outcome", outcome)
    board, website = F.trim(blank("jobBoardUrl")), F.trim(blank("companyWebsite"))
    return kept.select(
        "id", F.trim("name").alias("name"), F.when(F.col("outcome") == "created", F.col("key")).alias("normalizedName"), website.alias("officialWebsite"), website.alias("knownWebsite"), board.alias("jobBoardUrl"),
        F.when(board != "", "Manual").otherwise("Not Found").alias("jobBoardDiscoveryMethod"), F.lit(NEEDS_REVIEW).alias("searchStatus"), "outcome", F.when(F.col("outcome") == "duplicate", F.col("duplicateOf")).alias("duplicateOf"),
    )


def update(companies: DataFrame, patch: DataFrame) -> DataFrame:
    """The companies after ``patch`` (id, name, companyDescription and the three URLs; one row an id): a change of a URL asks for a new
    verification. ``outcome``: updated, duplicate (another company has the new name; nothing changes), or null (not in the patch).

    A blank description keeps the old one. A company that shares its old name with another stays outside the unique names.
    """
    others = companies.select(name_key("name").alias("new_key"), "id").groupBy("new_key").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    given = patch.select("id", *(F.col(c).alias(f"new_{c}") for c in ("name", "companyDescription", *URLS)), F.lit(True).alias("patched"))
    met = companies.join(given, "id", "left").withColumn("new_key", name_key("new_name")).join(others, "new_key", "left")
    taken = (F.col("low") != F.col("id")) | (F.col("high") != F.col("id"))
    shared = F.coalesce(taken, F.lit(False))
    clash = shared & (F.col("new_key") != name_key("name"))
    done = F.coalesce(F.col("patched") & ~clash & (F.col("new_key") != ""), F.lit(False))
    new = {c: F.trim(blank(f"new_{c}")) for c in ("name", "companyDescription", *URLS)}
    changed = F.lit(False)
    for c in URLS:
        changed = changed | (F.trim(blank(c)) != new[c])
    anew = done & changed
    text = F.when(new["companyDescription"] == "", F.col("companyDescription")).otherwise(new["companyDescription"])
    stored = F.when(F.col("normalizedName") == F.col("new_key"), F.col("new_key")).when(shared, "").otherwise(F.col("new_key"))
    changes: dict[str, Column] = {
        "name": F.when(done, new["name"]), "normalizedName": F.when(done, stored), "companyDescription": F.when(done, text), **{c: F.when(done, new[c]) for c in URLS},
        "websiteVerified": F.when(anew, False), "jobBoardDiscoveryMethod": F.when(anew, BY_HAND), "searchStatus": F.when(anew, NEEDS_REVIEW), "lastChecked": F.when(anew, ""),
    }
    outcome = F.when(F.col("patched").isNull(), None).when(F.col("new_key") == "", "invalid").when(clash, "duplicate").otherwise("updated")
    return met.select(*(F.coalesce(changes[c], F.col(c)).alias(c) if c in changes else F.col(c) for c in companies.columns), outcome.alias("outcome"), anew.alias("reverify"))


def snapshot_upsert(companies: DataFrame, incoming: DataFrame, columns: list[str]) -> DataFrame:
    """Companies after an incoming snapshot (id, name, columns): one with a known id takes the incoming values, one whose name is known
    keeps the stored values and takes what it lacks, and the rest are added. ``action`` says which."""
    by_id = incoming.select("id", F.struct("name", *columns).alias("by_id"))
    new = incoming.join(companies.select("id"), "id", "left_anti")
    owned = new.withColumn("key", name_key("name")).join(name_owner(companies), "key", "left")
    first = owned.where("owner is not null").groupBy("owner").agg(F.min_by(F.struct("name", *columns), "id").alias("by_name")).withColumnRenamed("owner", "id")
    met = companies.join(by_id, "id", "left").join(first, "id", "left")
    # an incoming value outranks a stored one by id, and fills a blank one by name
    value = lambda c: F.coalesce(F.nullif(blank(F.col(f"by_id.{c}")), F.lit("")), F.nullif(blank(c), F.lit("")), F.nullif(blank(F.col(f"by_name.{c}")), F.lit("")), F.lit(""))
    action = F.when(F.col("by_id").isNotNull(), "updated by id").when(F.col("by_name").isNotNull(), "filled by name").otherwise("kept")
    kept = met.select("id", value("name").alias("name"), *(value(c).alias(c) for c in columns), action.alias("action"))
    added = owned.where("owner is null").select("id", F.trim("name").alias("name"), *(blank(c).alias(c) for c in columns), F.lit("added").alias("action"))
    return kept.unionByName(added)


def candidate_id(index: Column, canonical: Column) -> Column:
    return F.concat(F.lit("candidate-"), F.substring(F.sha2(F.concat_ws(":", index.cast("string"), canonical), 256), 1, 32))


def replace_candidates(stored: DataFrame, incoming: DataFrame, companies: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Candidates (id, company_id, company_name, payload) after a run: those of the companies in ``scope`` (all without it) go, the
    incoming ones (index, company_id, company_name, payload) come. A company that is not known by id is found by its name, the last
    one of that name; an id that is there already is overwritten."""
    names = companies.groupBy(F.lower("name").alias("k")).agg(F.max("id").alias("named"))
    known = incoming.join(companies.select(F.col("id").alias("company_id"), F.lit(True).alias("ok")), "company_id", "left").withColumn("k", F.lower(blank("company_name"))).join(names, "k", "left")
    new = known.select(candidate_id(F.col("index"), F.col("payload")).alias("id"), F.when(F.col("ok"), F.col("company_id")).otherwise(F.col("named")).alias("company_id"), "company_name", "payload")
    kept = stored.limit(0) if scope is None else stored.join(scope, "company_id", "left_anti")
    return kept.join(new.select("id"), "id", "left_anti").select("id", "company_id", "company_name", "payload").unionByName(new)


def resolve_applications(applications: DataFrame, jobs: DataFrame) -> DataFrame:
    """(ord, source_id, job_id, action): an application's id becomes the first job (ord) that once had it (jobs: id, legacy_id, ord), else
    stands for itself; skipped if there is no such job or an earlier application has it."""
    legacy = jobs.where("legacy_id is not null").groupBy(F.col("legacy_id").alias("source_id")).agg(F.min_by("id", "ord").alias("moved"))
    ids = jobs.select(F.col("id").alias("resolved"), F.lit(True).alias("known")).distinct()
    met = applications.join(legacy, "source_id", "left").withColumn("resolved", F.coalesce("moved", "source_id")).join(ids, "resolved", "left")
    turn = F.row_number().over(W.partitionBy("resolved").orderBy("ord"))
    action = F.when(F.col("known").isNull(), "skip: job relationship not found").when(turn > 1, "skip: duplicate application job ID").otherwise("keep")
    return met.select("ord", "source_id", F.col("resolved").alias("job_id"), action.alias("action"))


def facet_totals(options: DataFrame, board: str, select: str, count: str) -> DataFrame:
    """(board, total, agreed): a board's declared number of postings from its facets: the options of each select sum up to it."""
    sums = options.groupBy(board, select).agg(F.sum(count).alias("total"))
    return sums.groupBy(board).agg(F.max("total").alias("total"), (F.min("total") == F.max("total")).alias("agreed"))


def summary_counts(rows: DataFrame, by: list[str], outcome: str, outcomes: tuple[str, ...]) -> DataFrame:
    """One counter for each outcome, and all rows."""
    return rows.groupBy(*by).agg(F.count("*").alias("reviewed"), *(F.count_if(F.col(outcome) == o).alias(o) for o in outcomes))


def fill_summary(counts: DataFrame) -> DataFrame:
    """Adds rowsSkipped and what is left over as notFound to (reviewed, attempted, found, rejected, skipped, needsReview, errors)."""
    left = F.col("attempted") - F.col("found") - F.col("errors") - F.col("skipped") - F.col("rejected") - F.col("needsReview")
    return counts.withColumn("rowsSkipped", F.greatest(F.lit(0), F.col("reviewed") - F.col("attempted")) + F.col("skipped")).withColumn("notFound", F.greatest(F.lit(0), left))


def progress(done: Column, total: Column, elapsed: Column) -> Column:
    """struct(average, remaining): seconds an item so far, and for the items left; 0 before the first."""
    average = F.when(done > 0, elapsed / F.nullif(done, F.lit(0))).otherwise(0.0)
    return F.struct(average.alias("average"), (average * F.greatest(F.lit(0), total - done)).alias("remaining"))


def put_settings(stored: DataFrame, incoming: DataFrame, key: str, overwrite: bool) -> DataFrame:
    """Rows by key: incoming ones replace stored ones (overwrite) or only come where there is none."""
    if overwrite:
        return stored.join(incoming.select(key), key, "left_anti").unionByName(incoming)
    return stored.unionByName(incoming.join(stored.select(key), key, "left_anti"))


def add_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds the columns that are missing, and fills those that are there where they are null or blank."""
    return df.withColumns({c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), v.cast("string")) if c in df.columns else v for c, v in columns.items()})


def missing_required(df: DataFrame, by: list[str], present: Column, required: tuple[str, ...]) -> DataFrame:
    """(by, missing): what is required and no row has; ``present`` is an array of names a row."""
    held = df.groupBy(*by).agg(F.array_distinct(F.flatten(F.collect_set(present))).alias("_held"))
    return held.select(*by, F.array_sort(F.array_except(F.array(*map(F.lit, required)), "_held")).alias("missing"))


def best_of(df: DataFrame, by: list[str], score: str, order: str, sure: bool = False) -> DataFrame:
    """The row with the highest score, of equals the first; with ``sure`` none where the best score is 0 and there are several."""
    best = df.groupBy(*by).agg(F.max_by(F.struct(*df.columns), F.struct(F.col(score), -F.col(order))).alias("_r"), F.count("*").alias("_n"))
    return (best.where(f"_n = 1 OR _r.{score} <> 0") if sure else best).select("_r.*")


def unmatched(postings: DataFrame, results: DataFrame, key: str, eligible: Column) -> DataFrame:
    """Eligible postings that have no current match yet."""
    return postings.where(eligible).join(results.where("status = 'Matched'").select(key), key, "left_anti")
