"""Job feeds of landed pages: declared ones, then well-known paths; the first whose landed body is a feed counts. Fetching is no part of this."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import elements as E
from ..functions import text as T

# ---- Fixed values ----
FEED_PATHS = ("/feed", "/rss", "/rss.xml", "/jobs/rss", "/jobs/feed", "/careers/rss", "/careers/feed", "/employment/rss", "/employment/feed")
FEED_TYPES = ("application/rss+xml", "application/atom+xml")
#: What a feed's root element may hold: RSS, RSS 1.0 and Atom. A body that is no XML leaves all of it null and _broken filled.
_ITEM = "array<struct<title:string,link:string>>"
FEED = f"channel struct<title:string,link:string,description:string,item:{_ITEM}>, item {_ITEM}, title string, id string, updated string, entry array<struct<title:string,id:string>>, _version string, _broken string"


def candidates(pages: DataFrame, key: str, order: str) -> DataFrame:
    """(key, ord, url, how) from a key's pages (page_id, url, html, order): the feeds that its pages declare, page by page, then the well-known
    paths below each distinct site; a URL counts once, where it comes first."""
    at = pages.select("page_id", F.col(key).alias("key"), F.col(order).alias("page"), "url")
    rel = F.concat_ws(" ", F.split(F.lower(T.blank("rel")), r"\s+"))
    declared = E.nodes(pages).where(E.tag_is("link") & rel.contains("alternate") & F.lower(T.blank("type")).isin(*FEED_TYPES) & (T.blank("href") != "")).select("page_id", F.col("pre").cast("bigint").alias("place"), F.col("link").alias("feed"))
    listed = declared.join(at, "page_id").select("key", F.struct(F.lit(0).alias("kind"), F.col("page").cast("string").alias("p"), F.col("place").alias("k")).alias("at"), F.col("feed").alias("url"), F.lit("declared").alias("how"))
    base = F.regexp_extract("url", r"(?i)^(https?://[^/?#]+)", 1)
    sites = at.withColumn("base", base).where("base <> ''").groupBy("key", "base").agg(F.min("page").alias("page"))
    known = sites.select("key", "page", "base", F.posexplode(F.array(*map(F.lit, FEED_PATHS))).alias("k", "path")).select("key", F.struct(F.lit(1).alias("kind"), F.col("page").cast("string").alias("p"), F.col("k").cast("bigint").alias("k")).alias("at"), F.concat("base", "path").alias("url"), F.lit("well-known").alias("how"))
    first = listed.unionByName(known).groupBy("key", "url").agg(F.min(F.struct("at", "how")).alias("f"))
    return first.select(F.col("key").alias(key), F.col("f.at").alias("ord"), "url", F.col("f.how").alias("how"))


def is_feed(body: Column | str) -> Column:
    """The body is well-formed XML and a feed: a channel or feed with a title, link, id or date that has entries or says its version."""
    x = F.from_xml(T.blank(body), FEED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "ignoreNamespace": "true", "attributePrefix": "_"})
    said = F.coalesce(*(x.getField(f) for f in ("title", "id", "updated")), x.getField("channel").getField("title"), x.getField("channel").getField("link"), x.getField("channel").getField("description"))
    many = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    entries = many(x.getField("entry")) | many(x.getField("item")) | many(x.getField("channel").getField("item"))
    root = F.regexp_extract(T.blank(body), r"(?s)^\s*(?:<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>|\s)*<(?:\w+:)?(\w+)", 1)
    versioned = x.getField("_version").isNotNull() | (root == "feed") | (root == "RDF")
    return (F.lower(root).isin("rss", "feed", "rdf")) & x.getField("_broken").isNull() & said.isNotNull() & (entries | versioned)


def find(pages: DataFrame, bodies: DataFrame, key: str, order: str) -> DataFrame:
    """(key, url, found, tried) for every key of the pages: the first candidate whose landed body (url, body) is a feed; url '' if none is."""
    asked = candidates(pages, key, order)
    valid = bodies.groupBy("url").agg(F.max(is_feed("body")).alias("valid"))
    met = asked.join(valid, "url", "left")
    picked = met.groupBy(key).agg(F.min_by("url", F.when(F.col("valid"), F.col("ord"))).alias("url"), F.count("*").alias("tried"))
    return pages.select(key).distinct().join(picked, key, "left").select(key, F.coalesce("url", F.lit("")).alias("url"), F.col("url").isNotNull().alias("found"), F.coalesce("tried", F.lit(0)).alias("tried"))
