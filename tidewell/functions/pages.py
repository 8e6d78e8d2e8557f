"""HTML pages to flat rows. Spark has no document tree, so one pass of the standard parser in a task gives links with their
surroundings; every rule over them is a Column expression.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

HIDDEN = frozenset(("script", "style", "noscript", "template"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
DEPTH = 12
#: Elements whose text is what stands around a link, and the headings above a list of openings. Fixed values.
CARDS = frozenset(("li", "tr", "article", "section", "div", "td", "p", "dd"))
HEADINGS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6}
OPENINGS = re.compile(r"^(?:available|current|open)\s+(?:job\s+)?(?:positions|openings|opportunities)$|^employment\s+opportunities$", re.I)


class Flat(HTMLParser):
    """Links, visible text, title, first headings and description of one page.

    A link's ``near`` is the text of the innermost card-like element around it, its ``section`` the heading of the list of openings
    that it stands below (up to the next heading of that rank or above)."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.stack, self.text, self.links, self.open = base, [], [], [], []
        self.title, self.h1, self.description, self.json_ld = [], [], "", []
        self.cards, self.heading, self.section = [], None, None  # cards: (place in text, links); heading: its words; section: (rank, words)

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and a.get("name", "").lower() == "description":
            self.description = a.get("content", "")
        if tag == "a" and "href" in a or tag == "iframe" and a.get("src"):
            link = {"tag": tag, "href": a.get("href") or a.get("src"), "text": [], "near": "", "section": self.section[1] if self.section else "", "around": [f"{t}|{c}|{r}" for t, c, r in reversed(self.stack[-DEPTH:])]}
            self.links.append(link)
            if self.cards:
                self.cards[-1][1].append(link)
            if tag == "a":
                self.open.append(link)
        if tag in HEADINGS:
            self.heading = []
            if self.section and HEADINGS[tag] <= self.section[0]:
                self.section = None
        if tag in CARDS:
            self.cards.append((len(self.text), []))
        if tag not in VOID:
            self.stack.append((tag, f"{a.get('class', '')} {a.get('id', '')}".strip(), a.get("type" if tag == "script" else "role", "")))

    def handle_endtag(self, tag):
        if tag in HEADINGS and self.heading is not None:
            words, self.heading = " ".join("".join(self.heading).split()), None
            if OPENINGS.match(words):
                self.section = (HEADINGS[tag], words)
        if any(t == tag for t, _, _ in self.stack):
            while True:
                ended = self.stack.pop()[0]
                if ended in CARDS and self.cards:
                    self.end_card()
                if ended == tag:
                    break
        if tag == "a" and self.open:
            self.open.pop()

    def end_card(self):
        at, links = self.cards.pop()
        if links:
            near = " ".join(" ".join(self.text[at:]).split())
            for link in links:
                link["near"] = near

    def close(self):
        super().close()
        while self.cards:
            self.end_card()

    def handle_data(self, data):
        tags = [t for t, _, _ in self.stack]
        if self.stack and self.stack[-1][0] == "script" and "ld+json" in self.stack[-1][2]:
            self.json_ld.append(data)
        if HIDDEN.intersection(tags):
            return
        if "title" in tags:
            self.title.append(data)
            return
        self.text.append(data)
        if self.heading is not None:
            self.heading.append(data)
        if "h1" in tags:
            self.h1.append(data)
        for link in self.open:
            link["text"].append(data)


def _flat(page: str, base: str) -> dict:
    p = Flat(base)
    p.feed(page or "")
    p.close()
    links = []
    for x in p.links:
        href = x["href"].strip()
        if href.lower().startswith(("mailto:", "tel:", "javascript:")):
            continue
        try:
            url = urldefrag(urljoin(base or "", href))[0]
        except ValueError:
            continue
        links.append({"tag": x["tag"], "href": href, "url": url, "label": " ".join("".join(x["text"]).split()), "around": x["around"], "near": x["near"], "section": x["section"]})
    join = lambda parts: " ".join(" ".join(parts).split())
    return {"title": join(p.title), "h1": join(p.h1), "description": p.description, "text": join(p.text), "json_ld": p.json_ld, "links": links}


_LINK = pa.struct([("tag", pa.string()), ("href", pa.string()), ("url", pa.string()), ("label", pa.string()), ("around", pa.list_(pa.string())), ("near", pa.string()), ("section", pa.string())])
_PAGE = pa.struct([("title", pa.string()), ("h1", pa.string()), ("description", pa.string()), ("text", pa.string()), ("json_ld", pa.list_(pa.string())), ("links", pa.list_(_LINK))])


#: Pages that are held in parsed form at once.
PAGES_AT_ONCE = 32


def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most PAGES_AT_ONCE: what a task holds of parsed pages does not grow with Spark's batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, PAGES_AT_ONCE):
            yield batch.slice(at, PAGES_AT_ONCE)


def flatten(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, h1, description, text, json_ld, links: array<struct<tag, href, url, label, around, near, section>>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            rows = [_flat(h, u) for u, h in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(rows, _PAGE)], ["page_id", "url", "page"])

    schema = "page_id bigint, url string, page struct<title:string,h1:string,description:string,text:string,json_ld:array<string>,links:array<struct<tag:string,href:string,url:string,label:string,around:array<string>,near:string,section:string>>>"
    return pages.select("page_id", "url", "html").mapInArrow(run, schema).select("page_id", "url", "page.*")


def links(pages: DataFrame) -> DataFrame:
    return flatten(pages).select("page_id", F.col("url").alias("page_url"), F.posexplode("links").alias("ord", "link")).select("page_id", "page_url", "ord", "link.*")


# ---- Fixed values: what marks page chrome ----
CHROME_TAGS = ("nav", "header", "footer", "aside")
CHROME_ROLES = ("navigation", "banner", "contentinfo", "menu", "menubar", "menuitem", "search", "dialog", "alertdialog", "toolbar")
CHROME_NAMES = (
    r"(?i)(?:^|[-_\s])(nav|navbar|navigation|mainnav|topnav|subnav|menu|submenu|megamenu|dropdown|header|masthead|footer|breadcrumb|breadcrumbs|social|share|sidebar|widget|utility|topbar|toolbar|skip|skiplink|cookie|consent|banner|modal|popup"
    r"|offcanvas|drawer|hamburger|sitemap|pagination|pager)(?:$|[-_\s])"
)


def chrome_reason(around: Column | str) -> Column:
    """Why a link's surroundings (tag|class and id|role, nearest first) are page chrome; ''."""

    def of(x: Column) -> Column:
        parts = F.split(x, r"\|")
        tag, names, role = (F.get(parts, F.lit(k)) for k in range(3))
        named = F.regexp_extract(names, CHROME_NAMES, 1)
        return (
            F.when(tag.isin(*CHROME_TAGS), F.concat(F.lit("inside <"), tag, F.lit("> site chrome"))).when(F.lower(role).isin(*CHROME_ROLES), F.concat(F.lit('inside role="'), F.lower(role), F.lit('" landmark')))
            .when(named != "", F.concat(F.lit('inside "'), named, F.lit('" navigation/chrome container'))).otherwise("")
        )

    return F.coalesce(F.get(F.filter(F.transform(T.col(around), of), lambda r: r != ""), F.lit(0)), F.lit(""))


def in_job_list(around: Column | str) -> Column:
    return F.exists(F.slice(T.col(around), 1, 10), lambda x: x.rlike(r"(?i)(?:^|[-_\s|])(job|jobs|career|careers|opening|openings|position|positions|vacanc(?:y|ies)|posting|postings)(?:$|[-_\s|])"))


#: Words by which a page says that it has no openings, and marks of a page that no script has rendered. Fixed values.
NO_OPENINGS = (
    "no current openings", "no current job openings", "no open positions", "no open positions at this time", "no openings at this time", "no job openings at this time", "no positions available at this time",
    "there are currently no openings", "there are no open positions", "we do not have any openings", "we don't have any openings", "no vacancies at this time", "0 jobs found", "0 open positions",
)
SHELL_MARKS = (
    "${", "{{", "pagestatedata", "please enable javascript", "enable javascript to run this app", "you need to enable javascript", "we're sorry but", "doesn't work properly without javascript",
    "this application requires javascript",
)
EMPTY_ROOT = r"""(?i)<div[^>]+id=["'](?:root|app|__next|main|react-root|ember-app)["'][^>]*>\s*</div>"""


def says_none(text: Column | str) -> Column:
    """The page says outright that there are no openings."""
    return T.contains_any(F.lower(T.squash(text)), NO_OPENINGS)


def unrendered(html: Column | str, text: Column | str) -> Column:
    """A page whose scripts have not run: a mark of it, an empty root with two scripts, or three scripts and hardly any text."""
    low = F.lower(T.blank(html))
    scripts = F.size(F.split(low, "<script")) - 1
    return T.contains_any(low, SHELL_MARKS) | (low.rlike(EMPTY_ROOT) & (scripts >= 2)) | ((scripts >= 3) & (F.length(T.squash(text)) < 400))


#: Where JSON-LD keeps further items, and the type of those that are postings. Fixed values.
NESTED, POSTING = ("@graph", "graph", "itemListElement", "item"), "jobposting"


def posting_items(text: str | None) -> list[dict]:
    """The JobPosting objects of one JSON-LD text in order, however deep lists, graphs and list items nest; none of a text that is no JSON."""
    try:
        todo, found = [json.loads(text or "")], []
    except (ValueError, RecursionError):
        return []
    while todo:
        value = todo.pop()
        if isinstance(value, list):
            todo += reversed(value)
        elif isinstance(value, dict):
            kinds = value.get("@type") or value.get("type") or []
            if any(POSTING in str(k).replace(" ", "").lower() for k in (kinds if isinstance(kinds, list) else [kinds])):
                found.append(value)
            todo += [value[k] for k in reversed(NESTED) if k in value]
    return found


def job_postings(flat: DataFrame) -> DataFrame:
    """JobPosting items of a page's JSON-LD (page_id, item VARIANT), wherever they stand: at the top, in lists, graphs and list items of any depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(p, json.dumps(x)) for p, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for t in texts or () for x in posting_items(t)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int64()), pa.array([x for _, x in found], pa.string())], ["page_id", "item"])

    items = flat.where(F.size("json_ld") > 0).select("page_id", "json_ld").mapInArrow(run, "page_id bigint, item string")
    return items.select("page_id", F.try_parse_json("item").alias("item")).where("item is not null")


def assigned_json(script: Column | str, assignment: str) -> Column:
    """The JSON value (VARIANT) that follows the first match of ``assignment``, say ``window\\.pageData\\s*=\\s*``, whatever code comes after it.

    Strings are taken whole, so that brackets and quotes in them do not count; the value ends where its first bracket is closed. Null if there is no
    assignment, if the text breaks off before the end, or if what stands there is no JSON.
    """
    once = lambda x, body: F.get(F.transform(F.array(x), body), F.lit(0))
    rest = F.regexp_extract(T.blank(script), f"(?s){assignment}(.*)", 1)
    scalar = F.regexp_extract(rest, r'(?s)^(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|"(?:[^"\\]++|\\.)*+")', 1)
    tokens = F.regexp_extract_all(rest, F.lit(r'(?s)"(?:[^"\\]++|\\.)*+"|[\[\]{}]|[^"\[\]{}]++'), F.lit(0))
    state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(acc: Column, t: Column) -> Column:
        depth = acc.getField("depth") + F.when(t.isin("{", "["), 1).when(t.isin("}", "]"), -1).otherwise(0)
        return F.when(acc.getField("done"), acc).otherwise(F.struct(depth.alias("depth"), (acc.getField("n") + 1).alias("n"), (depth <= 0).alias("done")))

    scanned = once(tokens, lambda ts: once(F.aggregate(ts, state, step), lambda end: F.when(end.getField("done"), F.array_join(F.slice(ts, F.lit(1), end.getField("n")), ""))))
    return F.try_parse_json(F.when(scalar != "", scalar).when(rest.rlike(r"^[\[{]"), scanned))


def founded_year(c: Column | str) -> Column:
    return F.regexp_extract(T.squash(c), r"(?i)\b(?:founded|established|since|chartered)\s+(?:in\s+)?((?:18|19|20)\d{2})\b", 1).try_cast("int")


def total_assets(c: Column | str) -> Column:
    """Assets in dollars from '$1.2 billion in assets' and the like."""
    pattern = r"(?i)\$\s?(\d[\d,]*(?:\.\d+)?)\s*(million|billion|m|b)\b[^.]{0,40}?assets|assets[^.$]{0,40}\$\s?(\d[\d,]*(?:\.\d+)?)\s*(million|billion|m|b)\b"
    s = T.squash(c)
    g = lambda k: F.regexp_extract(s, pattern, k)
    from .numbers import scaled

    return scaled(F.when(g(1) != "", g(1)).otherwise(g(3)), F.when(g(2) != "", g(2)).otherwise(g(4)))
