"""JSON sources and sinks: snapshots, polymorphic imports, landed API pages, inventories, backups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

MAX_RECORDS, MAX_NESTING = 50_000, 64
#: A stored posting. Names as they stand in the snapshot files.
JOB_FIELDS = (
    "id", "companyId", "companyName", "title", "location", "workType", "payMin", "payMax", "payText", "payPeriod", "payCurrency", "postedDate", "sourceUrl", "jobPlatform", "description", "descriptionSnippet",
    "collectedAt", "status", "roleType", "roleTypeReason",
)
_NUMBERS = ("payMin", "payMax")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(path, payload VARIANT) of whole JSON files; a byte-order mark is dropped, and a payload is null where the file is no JSON."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("text"))
    return files.select("path", F.try_parse_json("text").alias("payload"), "text")


def nesting_ok(text: Column | str, most: int = MAX_NESTING) -> Column:
    """Brackets outside strings never stand deeper than ``most``."""
    marks = F.regexp_extract_all(F.regexp_replace(T.col(text), r'"(?:[^"\\]|\\.)*"', ""), F.lit(r"[\[{\]}]"), F.lit(0))
    depth = F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda a, m: F.struct(
        (a.getField("now") + F.when(m.isin("[", "{"), 1).otherwise(-1)).alias("now"), F.greatest(a.getField("most"), a.getField("now") + F.when(m.isin("[", "{"), 1).otherwise(0)).alias("most")))
    return depth.getField("most") <= most


def _items(df: DataFrame, array: Column) -> DataFrame:
    return df.select("path", F.posexplode(F.coalesce(array, F.array().cast("array<variant>"))).alias("ord", "item"))


def split_import(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(companies, jobs) as (path, ord, item): an object holds both lists; an array holds jobs if its first element has a title."""
    kind = F.schema_of_variant("payload")
    listed = payloads.where(kind.startswith("ARRAY"))
    first_title = F.try_variant_get("payload", "$[0].title", "string")
    both = payloads.where(kind.startswith("OBJECT"))
    get = lambda df, path: _items(df, F.try_variant_get("payload", path, "array<variant>"))
    companies = get(both, "$.companies").union(get(listed.where(first_title.isNull()), "$"))
    jobs = get(both, "$.jobs").union(get(listed.where(first_title.isNotNull()), "$"))
    return companies, jobs


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Typed rows of a jobs snapshot; a file that is no list gives none, items that are no objects are skipped, and rawData that is no object is {}."""
    items = _items(read_payloads(spark, path), F.try_variant_get("payload", "$", "array<variant>")).where(F.schema_of_variant("item").startswith("OBJECT"))
    raw = F.try_variant_get("item", "$.rawData", "variant")
    fields = [F.try_variant_get("item", f"$.{f}", "double" if f in _NUMBERS else "string").alias(f) for f in JOB_FIELDS]
    return items.select("ord", *fields, F.when(F.schema_of_variant(raw).startswith("OBJECT"), F.to_json(raw)).otherwise("{}").alias("rawData"))


def enforce_record_limit(*frames: DataFrame, most: int = MAX_RECORDS) -> None:
    held = sum(df.limit(most + 1).count() for df in frames)
    if held > most:
        raise ValueError(f"an import holds at most {most} records")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Path, bytes, time and SHA-256 of source files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"))


def feature_pages(api_pages: DataFrame, listing: str, total: str, item_id: str) -> tuple[DataFrame, DataFrame]:
    """Landed API pages (company_id, page_no, payload text): (postings, completeness).

    A board is complete if its pages agree on one declared total and hold that many distinct postings; else it is partial.
    """
    pages = api_pages.withColumn("v", F.try_parse_json("payload"))
    items = pages.select("company_id", "page_no", F.try_variant_get("v", f"$.{total}", "bigint").alias("declared"), F.posexplode_outer(F.try_variant_get("v", f"$.{listing}", "array<variant>")).alias("at", "item"))
    key = F.try_variant_get("item", f"$.{item_id}", "string")
    totals = items.groupBy("company_id").agg(F.count_distinct("declared").alias("totals"), F.max("declared").alias("declared"), F.count_distinct(key).alias("seen"), F.count("item").alias("rows"))
    verdict = totals.withColumn("complete", (F.col("totals") == 1) & (F.col("declared") == F.col("seen")))
    return items.where("item is not null").withColumn("posting_id", key), verdict


def backup(frames: dict[str, DataFrame], path: str) -> DataFrame:
    """Write tables below path with a manifest (table, rows, schema hash); the manifest comes last, so a backup without one is none."""
    spark = next(iter(frames.values())).sparkSession
    rows = []
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        stored = spark.read.parquet(f"{path}/{name}")
        rows.append((name, stored.count(), stored.schema.json()))
    manifest = spark.createDataFrame(rows, "name string, n bigint, schema string").select("name", "n", F.sha2("schema", 256).alias("schema_sha256"))
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return manifest


def validate_backup(spark: SparkSession, path: str) -> DataFrame:
    """Tables whose rows or schema differ from the manifest; empty if the backup is sound."""
    bad = []
    for r in spark.read.parquet(f"{path}/manifest").collect():  # one row a table
        df = spark.read.parquet(f"{path}/{r.name}")
        same = spark.createDataFrame([(df.schema.json(),)], "s string").select(F.sha2("s", 256)).first()[0]
        if df.count() != r.n or same != r.schema_sha256:
            bad.append((r.name, r.n))
    return spark.createDataFrame(bad, "name string, n bigint")


def stale_backups(listing: DataFrame, keep: int) -> DataFrame:
    """Backups (name, created_at, valid) beyond the newest ``keep`` valid ones."""
    newest = listing.where("valid").orderBy(F.desc("created_at"), F.desc("name")).limit(keep)
    return listing.join(newest.select("name"), "name", "left_anti")
