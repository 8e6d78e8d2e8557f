"""HTML elements as rows with interval codes: an element covers the nodes numbered pre + 1 to post, so "inside", "around" and
"nearest" are joins on intervals, and a selector is a predicate on a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pages import VOID, few

#: Elements whose strings are no text of the page.
MUTE = frozenset(("script", "style", "template"))
_KINDS = {
    "page_id": pa.int64(), "pre": pa.int64(), "post": pa.int64(), "depth": pa.int32(), "tag": pa.string(), "names": pa.string(), "id": pa.string(), "href": pa.string(), "link": pa.string(), "title": pa.string(),
    "testid": pa.string(), "property": pa.string(), "content": pa.string(), "rel": pa.string(), "type": pa.string(), "text": pa.string(),
}
NODES = "page_id bigint, pre bigint, post bigint, depth int, tag string, names string, id string, href string, link string, title string, testid string, property string, content string, rel string, type string, text string"
_ATTRIBUTES = {"names": "class", "id": "id", "href": "href", "title": "title", "testid": "data-testid", "property": "property", "content": "content", "rel": "rel", "type": "type"}


class _Tree(HTMLParser):
    """Nodes of one page in order; an end tag closes its nearest open element and what is open inside."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.rows, self.open, self.said, self.mute = base, [], [], [], 0

    def flush(self):
        text, self.said = " ".join("".join(self.said).split()), []
        if text:
            self.rows.append({"pre": len(self.rows), "post": len(self.rows), "depth": len(self.open), "text": text})

    def handle_starttag(self, tag, attrs):
        self.flush()
        given = dict(reversed(attrs))  # of an attribute given twice the first counts
        row = {"pre": len(self.rows), "post": len(self.rows), "depth": len(self.open), "tag": tag} | {k: given[a] or "" for k, a in _ATTRIBUTES.items() if a in given}
        if "href" in row:
            try:
                row["link"] = urljoin(self.base, row["href"])
            except ValueError:
                row["link"] = ""
        self.rows.append(row)
        if tag not in VOID:
            self.open.append(row)
            self.mute += tag in MUTE

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def end(self):
        row = self.open.pop()
        row["post"] = len(self.rows) - 1
        self.mute -= row["tag"] in MUTE
        return row["tag"]

    def handle_endtag(self, tag):
        self.flush()
        if any(x["tag"] == tag for x in self.open):
            while self.end() != tag:
                pass

    def handle_comment(self, data):
        self.flush()

    def handle_data(self, data):
        if not self.mute:
            self.said.append(data)

    def close(self):
        super().close()
        self.flush()
        while self.open:
            self.end()


def nodes(pages: DataFrame) -> DataFrame:
    """A row for each element (tag, its attributes as far as rules use them, href resolved against the page as ``link``) and each run of text (``text``, white space
    collapsed) of pages (page_id, url, html). A null or empty page has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            rows = []
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                tree = _Tree(url or "")
                tree.feed(html or "")
                tree.close()
                rows += ({"page_id": page} | r for r in tree.rows)
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in _KINDS.items()], list(_KINDS))

    return pages.select("page_id", "url", "html").mapInArrow(run, NODES)


#: Nodes that share a key of an interval join.
SPAN = 64


def within(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Each row of inner (page_id, pre, ...) with each row of outer (page_id, lo, hi, ...) whose interval lo < pre <= hi holds it.

    Both meet by page and by runs of SPAN nodes, so that a page's nodes are compared with intervals that reach their run only.
    """
    reach = outer.withColumn("_run", F.explode(F.sequence(F.floor(F.col("lo") / SPAN), F.floor(F.col("hi") / SPAN))))
    met = inner.withColumn("_run", F.floor(F.col("pre") / SPAN))
    return met.join(reach, ["page_id", "_run"]).where((F.col("pre") > F.col("lo")) & (F.col("pre") <= F.col("hi"))).drop("_run")


def texts_of(elements: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """elements (page_id, lo, hi, ...) with ``said``: the text inside, runs joined by a blank; '' if there is none."""
    runs = all_nodes.where("text is not null").select("page_id", "pre", "text")
    said = within(elements.select("page_id", "lo", "hi").distinct(), runs).groupBy("page_id", "lo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "text"))), lambda x: x.getField("text")), " ").alias("said"))
    return elements.join(said, ["page_id", "lo"], "left").withColumn("said", F.coalesce("said", F.lit("")))


def tag_is(*tags: str) -> Column:
    return F.col("tag").isin(*tags)


def has(attribute: str, part: str) -> Column:
    """The selector [attribute*='part']."""
    return F.coalesce(F.col(attribute).contains(part), F.lit(False))
