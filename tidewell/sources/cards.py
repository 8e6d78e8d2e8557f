"""Cards of landed pages: elements that may be postings, with their title, link, place and signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import elements as E
from ..functions import text as T

# ---- Fixed values ----
CARD_TAGS = ("article", "li", "tr")
CARD_NAMES = ("job", "career", "opening", "position", "listing", "card")
CARD_IDS = ("job", "opening")
ACTION_LABELS = ("apply", "apply now", "view details", "view details (opens an external site)", "opens an external site", "learn more", "read more", "search jobs")
SIGNALS = ("job", "career", "opening", "position", "recruit", "department", "location")
LINK_TERMS = ("job", "career", "opening", "position", "recruit")
DOCUMENT_TERMS = ("job", "position", "career", "employment")
DOCUMENT_TAGS = ("article", "section", "li", "div", "td")
APPLY_SIGNALS = (
    "to apply", "how to apply", "forward your resume", "submit your resume", "send your resume", "email your resume", "send us your resume", "apply in person", "apply now", "apply online", "application", "resume and cover letter", "mailto:",
    "we are hiring", "now hiring", "career opportunit",
)
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Cards of a page that are looked at: a feature of the rule, counted before repeats are dropped.
MOST_CARDS = 500
PARENTS, DOCUMENT_TEXT = 6, (10, 2500)


def selectors() -> list[Column]:
    """Predicates of a card, in order."""
    return [*(E.tag_is(t) for t in CARD_TAGS), *(E.has("names", n) for n in CARD_NAMES), *(E.has("id", n) for n in CARD_IDS)]


def is_document(url: Column | str) -> Column:
    """The URL's path ends in .pdf."""
    path = F.regexp_replace(F.regexp_replace(T.blank(url), "[?#].*", ""), "(?i)^[a-z][a-z0-9+.-]*:", "")
    return F.lower(F.when(path.startswith("//"), F.regexp_replace(path, "^//[^/]*", "")).otherwise(path)).endswith(".pdf")


def is_action(label: Column) -> Column:
    return F.lower(T.job_title(label)).isin(*ACTION_LABELS)


def apply_signal(text: Column | str) -> Column:
    """A section says how to apply."""
    return T.contains_any(F.lower(T.squash(text)), APPLY_SIGNALS)


def _document_cards(nodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """(page_id, pre, post, at): for each link to a job document (at: its number) the nearest of its PARENTS that is compact and has a heading."""
    signal = F.lower(T.squash(F.concat_ws(" ", "said", T.blank("title"), "href")))
    links = anchors.where(is_document("href") & T.contains_any(signal, DOCUMENT_TERMS)).select("page_id", "pre", F.col("depth").alias("a_depth"))
    able = nodes.where(E.tag_is(*DOCUMENT_TAGS)).select("page_id", F.col("pre").alias("lo"), F.col("post").alias("hi"), "depth")
    near = E.within(able, links).where(F.col("a_depth") - F.col("depth") <= PARENTS).select("page_id", F.col("pre").alias("at"), "lo", "hi", "depth")
    around = near.select("page_id", "lo", "hi").distinct()
    headed = E.within(around, nodes.where(E.tag_is(*HEADINGS)).select("page_id", "pre")).select("page_id", "lo").distinct()
    fit = E.texts_of(around.join(headed, ["page_id", "lo"], "left_semi"), nodes).where(F.length("said").between(*DOCUMENT_TEXT)).select("page_id", "lo")
    best = near.join(fit, ["page_id", "lo"], "left_semi").groupBy("page_id", "at").agg(F.max_by(F.struct("lo", "hi"), "depth").alias("c"))
    return best.select("page_id", F.col("c.lo").alias("pre"), F.col("c.hi").alias("post"), "at")


def _anchors(nodes: DataFrame) -> DataFrame:
    found = nodes.where(E.tag_is("a") & F.col("href").isNotNull()).select("page_id", "pre", F.col("pre").alias("lo"), F.col("post").alias("hi"), "depth", "href", "link", "title")
    return E.texts_of(found, nodes)


def cards(pages: DataFrame, most: int = MOST_CARDS) -> DataFrame:
    """(page_id, ord, pre, text, title, href, location, document, signal) of every card of pages (page_id, url, html).

    Cards come selector by selector, then those around job documents; the first ``most`` of a page count, and an element that several
    select is one card. title: of a card with a document link the heading nearest the end that is no call to action; else that of the first heading, bold or
    title-like element; else of the first link. href: the link with most signals, of equals the first. A page without cards gives no row.
    """
    nodes = E.nodes(pages)
    anchors = _anchors(nodes)
    chosen = F.array_compact(F.array(*(F.when(p, F.lit(k)) for k, p in enumerate(selectors()))))
    elements = nodes.where("tag is not null").select("page_id", "pre", "post", F.explode(chosen).alias("by")).withColumn("at", F.col("pre"))
    every = elements.unionByName(_document_cards(nodes, anchors).withColumn("by", F.lit(len(selectors()))))
    turn = W.partitionBy("page_id").orderBy("by", "at")
    first = every.withColumn("ord", F.row_number().over(turn)).where(F.col("ord") <= most).groupBy("page_id", F.col("pre").alias("lo"), F.col("post").alias("hi")).agg(F.min("ord").alias("ord"))
    told = E.texts_of(first, nodes)

    # what may give a title, by its place in the order of looking
    kinds = [*(E.tag_is(h) for h in (*HEADINGS, "strong")), E.has("names", "title"), E.has("names", "heading"), E.has("testid", "title")]
    marked = nodes.where("tag is not null").select("page_id", "pre", F.col("pre").alias("lo"), F.col("post").alias("hi"), F.array_compact(F.array(*(F.when(p, F.lit(k)) for k, p in enumerate(kinds)))).alias("kinds")).where(F.size("kinds") > 0)
    marks = E.texts_of(marked, nodes).select("page_id", "pre", "kinds", "said", F.lit(None).cast("string").alias("href"), F.lit(None).cast("string").alias("link"))
    parts = marks.unionByName(anchors.select("page_id", "pre", F.array(F.lit(-1)).alias("kinds"), "said", "href", "link"))
    inside = E.within(first.select("page_id", "lo", "hi"), parts).groupBy("page_id", "lo").agg(F.array_sort(F.collect_list(F.struct("pre", "kinds", T.job_title("said").alias("title"), "said", "href", "link"))).alias("parts"))
    rows = told.join(inside, ["page_id", "lo"], "left").withColumn("parts", F.coalesce("parts", F.array().cast(inside.schema["parts"].dataType)))

    links = F.filter("parts", lambda x: x.getField("href").isNotNull())
    headings = F.filter("parts", lambda x: F.exists(x.getField("kinds"), lambda k: k.between(0, len(HEADINGS) - 1)) & (x.getField("title") != ""))
    document = F.exists(links, lambda x: is_document(x.getField("href")))
    act = lambda x: F.lower(x.getField("title")).isin(*ACTION_LABELS)
    title_at = lambda a: F.get(a, F.lit(0)).getField("title")
    first_of = lambda k: F.nullif(title_at(F.filter("parts", lambda x: F.array_contains(x.getField("kinds"), F.lit(k)))), F.lit(""))
    of_kind = [first_of(k) for k in range(len(kinds))]
    nearest = F.when(document, title_at(F.reverse(F.filter(headings, lambda x: ~act(x)))))
    linked = title_at(F.filter(links, lambda x: (x.getField("title") != "") & ~act(x)))
    point = lambda x: F.when(T.contains_any(F.concat_ws(" ", F.lower(x.getField("said")), F.lower(x.getField("link"))), LINK_TERMS), 10).otherwise(0) + F.when(act(x), 5).otherwise(0)
    scored = F.transform(F.filter(links, lambda x: T.blank(x.getField("link")) != ""), lambda x: F.struct(point(x).alias("score"), (-x.getField("pre")).alias("o"), x.getField("link").alias("link")))
    hrefs = F.array_join(F.transform(links, lambda x: x.getField("href")), " ")
    return rows.select(
        "page_id", "ord", F.col("lo").alias("pre"), F.col("said").alias("text"), F.coalesce(nearest, *of_kind, linked, F.lit("")).alias("title"), F.coalesce(F.array_max(scored).getField("link"), F.lit("")).alias("href"),
        F.when(document & (F.size(headings) >= 2), F.element_at(headings, -2).getField("title")).otherwise("").alias("location"), document.alias("document"),
        T.contains_any(F.lower(F.concat_ws(" ", "said", hrefs)), SIGNALS).alias("signal"),
    )


def detail_titles(pages: DataFrame) -> DataFrame:
    """(page_id, title): of a posting's own page, from its first h1, h2, og:title or title that is not empty, without '- Careers ...' at its end; '' if there is none."""
    nodes = E.nodes(pages)
    kinds = [E.tag_is("h1"), E.tag_is("h2"), E.tag_is("meta") & (F.col("property") == "og:title"), E.tag_is("title")]
    kind = F.coalesce(*(F.when(p, F.lit(k)) for k, p in enumerate(kinds)))
    first = nodes.where("tag is not null").withColumn("kind", kind).where("kind is not null").groupBy("page_id", "kind").agg(F.min_by(F.struct(F.col("pre").alias("lo"), F.col("post").alias("hi"), "content"), "pre").alias("e")).select("page_id", "kind", "e.*")
    told = E.texts_of(first, nodes)
    shown = F.regexp_replace(T.job_title(F.when(F.col("kind") == 2, T.blank("content")).otherwise(F.col("said"))), r"(?i)\s*[-|]\s*(careers|jobs|employment).*$", "")
    best = told.withColumn("shown", shown).where("shown <> ''").groupBy("page_id").agg(F.min_by("shown", "kind").alias("title"))
    return pages.select("page_id").distinct().join(best, "page_id", "left").select("page_id", F.coalesce("title", F.lit("")).alias("title"))
