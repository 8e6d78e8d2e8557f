"""Upserts, folds, de-duplication and resolution. Input order is always a column; where rows tie, the order column decides.

Plain files have no MERGE, so each operation gives the whole new table; writing it is the caller's one commit.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.url import domain_key
from . import scans


#: What is said of a job's id, as bits.
SCOPE, KEPT, APPLIED = 1, 2, 4


def _others(df: DataFrame, *out: str) -> list[str]:
    return [c for c in df.columns if c not in out]


def last_wins(df: DataFrame, key: Column, order: str) -> DataFrame:
    """One row a key: the last in order, with ``first_seen_order`` of the first. Aggregated before the shuffle, so no key is a hot spot."""
    row = F.struct(*(F.col(c) for c in df.columns))
    found = df.groupBy(key.alias("_key")).agg(F.max_by(row, F.struct(order, *_others(df, order))).alias("_row"), F.min(order).alias("first_seen_order"))
    return found.select("_row.*", "first_seen_order")


def first_wins(df: DataFrame, key: Column, order: str) -> DataFrame:
    """All rows with ``duplicate``: false for the first of its key in order."""
    first = df.groupBy(key.alias("_key")).agg(F.min(order).alias("_first"))
    return df.withColumn("_key", key).join(first, "_key").withColumn("duplicate", F.col(order) != F.col("_first")).drop("_key", "_first")


def job_key(source_url: str, company: str, title: str, location: str) -> Column:
    """url:<lower source URL>, else fallback:<company>:<title slug>:<location slug>."""
    u = F.lower(F.trim(T.blank(source_url)))
    return F.when(u != "", F.concat(F.lit("url:"), u)).otherwise(F.concat_ws(":", F.lit("fallback"), T.blank(company), T.slug(title), T.slug(location)))


def repair_ids(df: DataFrame, id_col: str, content: Column, order: str) -> DataFrame:
    """Duplicate ids made distinct: the first keeps its id, others get id--<12 hex of the content's hash>, equal ones -2, -3 ... behind it."""
    digest = F.substring(F.sha2(content, 256), 1, 12)
    rank = F.row_number().over(W.partitionBy(id_col).orderBy(order))
    same = F.row_number().over(W.partitionBy(id_col, "_digest", F.col("_rank") > 1).orderBy(order))
    ranked = df.withColumn("_digest", digest).withColumn("_rank", rank).withColumn("_same", same)
    fixed = F.concat(F.col(id_col), F.lit("--"), F.col("_digest"), F.when(F.col("_same") > 1, F.concat(F.lit("-"), F.col("_same").cast("string"))).otherwise(""))
    return ranked.withColumn("repaired_id", F.when(F.col("_rank") == 1, F.col(id_col)).otherwise(fixed)).drop("_digest", "_rank", "_same")


def name_owner(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """``normalized_name`` for the oldest row of each name key, '' for the others and for blank names."""
    key = T.name_key(name)
    first = df.groupBy(key.alias("_key")).agg(F.min(F.struct(*order)).alias("_owner"))
    return df.withColumn("_key", key).join(first, "_key").withColumn("normalized_name", F.when(F.struct(*order) == F.col("_owner"), F.col("_key")).otherwise("")).drop("_key", "_owner")


def resolve_unique(rows: DataFrame, id_col: str, name_col: str, targets: DataFrame) -> DataFrame:
    """``resolved_id``: the row's id if targets (id, name) has it, else the id of the only target with its name, else null."""
    ids = targets.select(F.col("id").alias("_id")).distinct()
    names = targets.groupBy(F.lower("name").alias("_name")).agg(F.count("*").alias("_n"), F.min("id").alias("_by_name")).where("_n = 1").drop("_n")
    out = rows.join(ids, F.col(id_col) == F.col("_id"), "left").join(names, F.lower(F.col(name_col)) == F.col("_name"), "left")
    return out.withColumn("resolved_id", F.coalesce("_id", "_by_name")).drop("_id", "_name", "_by_name")


def resolve_last(rows: DataFrame, id_col: str, name_col: str, targets: DataFrame, order: str) -> DataFrame:
    """As resolve_unique, but a name that several targets share goes to the last of them, and what stays open is blank."""
    ids = targets.select(F.col("id").alias("_id")).distinct()
    names = targets.groupBy(F.lower("name").alias("_name")).agg(F.max_by("id", F.struct(order, "id")).alias("_by_name"))
    out = rows.join(ids, F.col(id_col) == F.col("_id"), "left").join(names, F.lower(F.col(name_col)) == F.col("_name"), "left")
    return out.withColumn("resolved_id", F.coalesce("_id", "_by_name", F.lit(""))).drop("_id", "_name", "_by_name")


def two_step_match(rows: DataFrame, master: DataFrame, full: list[str], partial: list[str], order: str, value: str) -> DataFrame:
    """``value`` of the master row with equal ``full`` keys, else with equal ``partial`` keys; of several the last in order."""
    def side(keys: list[str], out: str) -> DataFrame:
        return master.groupBy(*(F.lower(T.blank(k)).alias(f"_{k}") for k in keys)).agg(F.max_by(value, order).alias(out))

    def on(keys: list[str], other: DataFrame) -> Column:
        test = F.lit(True)
        for k in keys:
            test = test & (F.lower(T.blank(rows[k])) == other[f"_{k}"])
        return test

    a, b = side(full, "_full"), side(partial, "_partial")
    out = rows.join(a, on(full, a), "left").drop(*(a[f"_{k}"] for k in full))
    out = out.join(b, on(partial, b), "left").drop(*(b[f"_{k}"] for k in partial))
    return out.withColumn(f"existing_{value}", F.coalesce("_full", "_partial")).drop("_full", "_partial")


def replace_scope(existing: DataFrame, incoming: DataFrame, outcomes: DataFrame, key: Column, order: str) -> DataFrame:
    """Replacement of scopes by outcome (company_id, outcome): success, even an empty one, replaces a company's rows; partial
    adds to them; failed, disabled, limited and skipped keep them. Then one row a key, the last in order."""
    done = outcomes.where(F.col("outcome") == "success").select("company_id")
    adds = outcomes.where(F.col("outcome").isin("success", "partial")).select("company_id")
    kept = existing.join(done, "company_id", "left_anti")
    both = kept.unionByName(incoming.join(adds, "company_id", "left_semi"))
    return last_wins(both, key, order)


def upsert(stored: DataFrame, incoming: DataFrame, key: str, keep: Iterable[str] = ()) -> DataFrame:
    """Incoming rows overwrite stored ones, but for the ``keep`` columns, which a stored row never loses."""
    keep = set(keep)
    s, n = stored.select(F.struct(*stored.columns).alias("_s"), F.col(key)), incoming.select(F.struct(*incoming.columns).alias("_n"), F.col(key))
    joined = s.join(n, key, "full_outer")
    pick = lambda c: F.when(F.col("_s").isNotNull(), F.col(f"_s.{c}")).otherwise(F.col(f"_n.{c}")) if c in keep else F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(f"_s.{c}"))
    return joined.select(*((F.col(key) if c == key else pick(c)).alias(c) for c in stored.columns))


def prune(jobs: DataFrame, keep: DataFrame, applications: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Jobs of the scope that are not in ``keep``: archived if an application names them, gone if none does.

    What is said of an id - in the scope, kept, applied for - is gathered in one aggregate and joined once, so that a task holds two sorts, not one for each test. A null id is never missing.
    """
    inside = jobs if scope is None else jobs.join(scope.select("company_id").distinct(), "company_id", "left_semi")
    said = ((inside.select("id"), SCOPE), (keep.select("id"), KEPT), (applications.select(F.col("job_id").alias("id")), APPLIED))
    said = functools.reduce(DataFrame.union, (df.withColumn("_said", F.lit(bit)) for df, bit in said))
    missing = said.groupBy("id").agg(F.bit_or("_said").alias("_said")).where(F.col("_said").isin(SCOPE, SCOPE | APPLIED))
    stays = jobs.join(missing, "id", "left").where(F.col("_said").isNull() | (F.col("_said") != SCOPE))
    return stays.withColumn("status", F.when(F.col("_said").isNotNull(), "Archived").otherwise(F.col("status"))).select(jobs.columns)


def protected_update(stored: DataFrame, found: DataFrame, key: str, columns: list[str], replaceable: str = "allowed") -> DataFrame:
    """Found values go in only where they are not blank and the stored one is blank or named in the row's ``replaceable`` array."""
    f = found.select(F.col(key), F.col(replaceable).alias("_allowed"), *(F.col(c).alias(f"_f_{c}") for c in columns))
    new = {c: F.when((T.blank(f"_f_{c}") != "") & ((T.blank(c) == "") | F.coalesce(F.array_contains("_allowed", c), F.lit(False))), F.col(f"_f_{c}")).otherwise(F.col(c)) for c in columns}
    return stored.join(f, key, "left").withColumns(new).select(stored.columns)


def overlay(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Non-blank incoming values over stored ones; new keys are added."""
    s, n = stored.select(F.struct(*stored.columns).alias("_s"), F.col(key)), incoming.select(F.struct(*incoming.columns).alias("_n"), F.col(key))
    filled = lambda c: F.coalesce(F.when(F.col(f"_n.{c}").cast("string") != "", F.col(f"_n.{c}")), F.col(f"_s.{c}"))
    return s.join(n, key, "full_outer").select(*((F.col(key) if c == key else filled(c)).alias(c) for c in stored.columns))


def cascade_delete(parents: DataFrame, gone: DataFrame, parent_key: str, children: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Parents without the gone keys, and each child table (frame, foreign key) without their rows."""
    out = {"parents": parents.join(gone.select(parent_key), parent_key, "left_anti")}
    for name, (df, fk) in children.items():
        out[name] = df.join(gone.select(F.col(parent_key).alias(fk)), fk, "left_anti")
    return out


COMPANY_COLUMNS = ("company_id", "company_name", "city", "state", "official_website", "careers_page_url", "job_board_url", "last_checked")


def company_key() -> Column:
    d = domain_key(F.when(T.blank("official_website") != "", F.col("official_website")).otherwise(F.lit("")))
    return F.when(d != "", F.concat(F.lit("domain:"), d)).otherwise(F.concat(F.lit("name-state:"), T.slug("company_name"), F.lit(":"), T.slug("state")))


def fold_companies(df: DataFrame, order: str) -> DataFrame:
    """One row a company, folded in order: of two rows the one with more (board, careers, site, confidence, checked) leads - the
    earlier if equal - and its blanks are filled from the other; notes are joined, confidence is the higher.

    The fold depends on its order, since a filled blank raises the score of what is compared next, but all that it compares with are running
    values: which of the three links any earlier row had, their highest confidence, and the date of the leader, which is a running maximum
    since the last row that led by links or confidence (or brought the first date). So each row can tell whether it took the lead, and
    a field is that of the last leader that has it, else of the first row that has it. No key is gathered; a hot one is cut into segments. ``order``: a number or time.
    """
    text = [T.blank(c).alias(c) for c in COMPANY_COLUMNS]
    links = 4 * (F.col("job_board_url") != "").cast("int") + 2 * (F.col("careers_page_url") != "").cast("int") + (F.col("official_website") != "").cast("int")
    rows = df.select(company_key().alias("key"), F.col(order).alias("o"), *text, F.coalesce("confidence", F.lit(0)).cast("int").alias("confidence"), T.blank("notes").alias("notes")).withColumn("links", links)
    rows, hot = scans.segmented(rows, "key", "o")
    by = ["o", *COMPANY_COLUMNS, "confidence", "notes"]
    dated, date = F.col("last_checked") != "", F.col("last_checked")
    rows = scans.before(rows, ["key"], by, hot, n=("sum", F.lit(1)), had=("bit_or", F.col("links")), best=("max", F.col("confidence")), dates=("sum", dated.cast("int")))
    even = (F.col("links") == F.col("had")) & (F.col("n") > 0)
    leads = (F.col("n") == 0) | (F.col("links") > F.col("had")) | even & (F.col("confidence") > F.col("best"))
    rows = rows.withColumns({"leads": leads, "even": even & (F.col("confidence") == F.col("best")), "fresh": dated & (leads | (F.col("dates") == 0))})
    rows = scans.before(rows, ["key"], by, hot, run=("sum", F.col("fresh").cast("int"))).withColumn("run", F.col("run") + F.col("fresh").cast("int"))
    rows = scans.before(rows, ["key", "run"], by, hot, led=("max", F.when(F.col("fresh") | F.col("even"), date)))
    rows = rows.withColumn("leads", F.col("leads") | F.col("even") & (date > F.coalesce("led", F.lit(""))))
    at = F.struct(*by)
    last = lambda c: F.max_by(c, F.when(F.col("leads") & (F.col(c) != ""), at))  # noqa: E731  null order: no candidate
    first = lambda c: F.min_by(c, F.when(F.col(c) != "", at))
    folded = rows.groupBy("key").agg(*(F.coalesce(last(c), first(c), F.lit("")).alias(c) for c in COMPANY_COLUMNS), F.max("confidence").alias("confidence"), F.min("notes").alias("alone"), F.count("*").cast("int").alias("n_rows"))
    said = rows.where("notes <> ''").select("key", "o", F.posexplode(F.transform(F.split("notes", ";"), lambda x: F.trim(x))).alias("k", "note"), F.struct(*by).alias("at")).where("note <> ''")
    notes = said.groupBy("key", "note").agg(F.min(F.struct("at", "k")).alias("at")).groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "note"))), lambda x: x.getField("note")), "; ").alias("notes"))
    return folded.join(notes, "key", "left").select("key", *COMPANY_COLUMNS, "confidence", F.when(F.col("n_rows") == 1, F.col("alone")).otherwise(F.coalesce("notes", F.lit(""))).alias("notes"), "n_rows")


def ranked_fill(df: DataFrame, key: str, fields: list[str], id_col: str) -> DataFrame:
    """One row a key: the record with most filled fields (then the smallest id), each blank from the next record that has it."""
    filled = sum((F.when(T.blank(f) != "", 1).otherwise(0) for f in fields), F.lit(0))
    at = F.struct((-filled).alias("rank"), F.col(id_col))
    first = lambda f: F.min_by(f, F.when(T.blank(f) != "", at)).alias(f)  # noqa: E731  no value: null order, so it never leads
    return df.groupBy(key).agg(F.min_by(id_col, at).alias(id_col), *(first(f) for f in fields))


def identity_groups(df: DataFrame, name: str, domain: str) -> DataFrame:
    """``group_key``: rows of one name belong together if the name has at most one verified domain; else each domain stands alone."""
    domains = df.where(T.blank(domain) != "").groupBy(T.name_key(name).alias("_name")).agg(F.min(domain).alias("_lo"), F.max(domain).alias("_hi"))
    out = df.withColumn("_name", T.name_key(name)).join(domains, "_name", "left")
    sole = F.coalesce(F.col("_lo") == F.col("_hi"), F.lit(True))
    return out.withColumn("group_key", F.when(sole, F.col("_name")).otherwise(F.concat_ws("|", "_name", T.blank(domain)))).drop("_name", "_lo", "_hi")


def assert_unique(df: DataFrame, *keys: str) -> None:
    """Spark keeps no constraints: raise if a key stands twice."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"not unique: {twice[0].asDict()}")


def assert_references(child: DataFrame, fk: str, parent: DataFrame, key: str) -> None:
    """Raise if a child's non-null foreign key has no parent."""
    lost = child.where(F.col(fk).isNotNull()).join(parent.select(F.col(key).alias(fk)), fk, "left_anti").select(fk).limit(1).collect()
    if lost:
        raise ValueError(f"no parent for {fk}={lost[0][0]}")
