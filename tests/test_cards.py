"""Cards and detail titles against a plain tree; intervals of elements; the cap; odd pages."""

from __future__ import annotations

import random
from html.parser import HTMLParser
from urllib.parse import urljoin


from tidewell.functions import elements
from tidewell.sources import cards

VOID = set("area base br col embed hr img input link meta source track wbr".split())


class Node:
    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def all(self):
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.all()

    def strings(self):
        for c in self.children if self.tag not in ("script", "style", "template") else ():
            if isinstance(c, Node):
                yield from c.strings()
            elif c.strip():
                yield " ".join(c.split())

    def text(self):
        return " ".join(self.strings())

    def one(self, test):
        return next((n for n in self.all() if test(n)), None)


class Reader(HTMLParser):
    def __init__(self):
        super().__init__()
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        x = self.at
        while x.parent and x.tag != tag:
            x = x.parent
        if x.parent:
            self.at = x.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tidy(s):
    import re

    return re.sub(r"(?i)^(job title|title)\s*[:\-]\s*", "", " ".join(s.split()))[:180]


def plain(url, html, most=500):
    reader = Reader()
    reader.feed(html)
    reader.close()
    root, heads = reader.root, ("h1", "h2", "h3", "h4", "h5", "h6")
    pdf = lambda u: u.split("#")[0].split("?")[0].lower().endswith(".pdf")
    part = lambda a, v: lambda n: v in n.attrs.get(a, "")
    tests = [lambda n, t=t: n.tag == t for t in ("article", "li", "tr")] + [part("class", v) for v in ("job", "career", "opening", "position", "listing", "card")] + [part("id", v) for v in ("job", "opening")]
    found = [n for test in tests for n in root.all() if test(n)]
    links = lambda n: [a for a in n.all() if a.tag == "a" and "href" in a.attrs]
    for a in links(root):
        if pdf(a.attrs["href"]) and any(t in f"{a.text()} {a.attrs.get('title', '')} {a.attrs['href']}".lower() for t in cards.DOCUMENT_TERMS):
            up, p = [], a.parent
            while p is not None and p.tag and len(up) < 6:
                up.append(p)
                p = p.parent
            best = next((p for p in up if p.tag in cards.DOCUMENT_TAGS and p.one(lambda n: n.tag in heads) and 10 <= len(p.text()) <= 2500), None)
            if best:
                found.append(best)
    out, seen = [], set()
    for card in found[:most]:
        if id(card) in seen:
            continue
        seen.add(id(card))
        action = lambda s: tidy(s).lower() in cards.ACTION_LABELS
        headings = [t for n in card.all() if n.tag in heads and (t := tidy(n.text()))]
        document = any(pdf(a.attrs["href"]) for a in links(card))
        title = next((t for t in reversed(headings) if not action(t)), "") if document else ""
        for test in [*(lambda n, t=t: n.tag == t for t in (*heads, "strong")), part("class", "title"), part("class", "heading"), part("data-testid", "title")]:
            if not title and (n := card.one(test)):
                title = tidy(n.text())
        title = title or next((t for a in links(card) if (t := tidy(a.text())) and not action(t)), "")
        best, score = "", -1
        for a in links(card):
            href, label = urljoin(url, a.attrs["href"]), a.text().lower()
            points = 10 * any(t in f"{label} {href.lower()}" for t in cards.LINK_TERMS) + 5 * action(label)
            if href and points > score:
                best, score = href, points
        signal = any(t in f"{card.text()} {' '.join(a.attrs['href'] for a in links(card))}".lower() for t in cards.SIGNALS)
        out.append((card.text(), title, best, headings[-2] if document and len(headings) >= 2 else "", document, signal))
    return out


def random_page(rng):
    words = ["Teller", "Branch", "apply now", "Learn More", "job", "opening", "Title: Cook", "x", "Department", "", "long " * 700]

    def node(depth):
        tag = rng.choice(["div", "li", "article", "section", "h2", "h3", "strong", "a", "span", "td", "tr", "p", "br", "script"])
        attrs = "".join(f' {k}="{rng.choice(v)}"' for k, v in (("class", ["job-card", "card title", "heading", "nav", "listing"]), ("id", ["job1", "x"]), ("data-testid", ["the-title", "y"])) if rng.random() < 0.15)
        if tag == "a" and rng.random() < 0.9:
            attrs += f' href="{rng.choice(["/jobs/1", "a.pdf", "/job/x.PDF?y=1", "#top", "", "https://e.com/careers", "mailto:a@b.c"])}"'
        inner = rng.choice(words) if rng.random() < 0.6 else ""
        for _ in range(rng.randrange(0, 4) if depth < 6 else 0):
            inner += node(depth + 1) + rng.choice(["", " and ", "<!-- c -->"])
        return f"<{tag}{attrs}>" if tag == "br" else f"<{tag}{attrs}>" + ("if (a < b) {}" if tag == "script" else inner) + (f"</{tag}>" if rng.random() < 0.95 else "")

    return "<html><body>" + "".join(node(0) for _ in range(rng.randrange(0, 8))) + "</body></html>"


def test_cards_against_a_plain_tree(spark):
    rng = random.Random(21)
    pages = [(k, f"https://site{k}.com/careers/", random_page(rng)) for k in range(80)] + [(900, "https://e.com", None), (901, None, ""), (902, "https://e.com", "no tags < at > all")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    for most in (500, 3):
        got = {k: [] for k, _, _ in pages}
        for r in cards.cards(df, most).orderBy("ord").collect():
            got[r.page_id].append((r.text, r.title, r.href, r.location, r.document, r.signal))
        want = {k: plain(u or "", h or "", most) for k, u, h in pages}
        assert got == want
    assert sum(map(len, want.values())) > 100 and any(x[4] and x[3] for page in want.values() for x in page)


def test_intervals(spark):
    df = spark.createDataFrame([(1, "https://e.com/a", "<div><p>one <b>two</b></p><ul><li>x<li>y</ul></div><p>z")], "page_id bigint, url string, html string")
    rows = {(r.tag or r.text): (r.pre, r.post, r.depth) for r in elements.nodes(df).collect()}
    assert rows["div"][:2] == (0, 9) and rows["two"][0] == rows["b"][0] + 1 == rows["b"][1] and rows["z"][2] == 1


def test_detail_titles(spark):
    pages = ["<h1> </h1><h2>Title: Branch Teller - Careers at Ely</h2>", "<meta property='og:title' content='Cook | Jobs'><title>other</title>", "<title>Only</title>", "", "<h1>First</h1><h1>Second</h1>"]
    df = spark.createDataFrame([(k, "u", h) for k, h in enumerate(pages)], "page_id bigint, url string, html string")
    assert [r.title for r in cards.detail_titles(df).orderBy("page_id").collect()] == ["Branch Teller", "Cook", "Only", "", "First"]


def test_apply_signal(spark):
    df = spark.createDataFrame([("Please Send\n your resume",), ("nothing",), (None,)], "t string")
    assert [r[0] for r in df.select(cards.apply_signal("t")).collect()] == [True, False, False]


def test_nodes_of_many_pages_come_in_few_batches(spark):
    """A batch of nodes holds those of several pages, and every page's nodes are there in order."""
    from tidewell.functions import elements, pages

    df = spark.range(100).selectExpr("id AS page_id", "'https://x.com/' AS url", "'<p>a</p><p>b</p>' AS html").coalesce(1)
    sizes = elements.nodes(df).mapInArrow(lambda batches: (b.select(["page_id"]).slice(0, 1) for b in batches), "page_id bigint").count()
    assert sizes <= -(-100 // pages.PAGES_AT_ONCE)
    assert [tuple(r) for r in elements.nodes(df).where("page_id = 77").select("pre", "tag", "text").collect()] == [(0, "p", None), (1, None, "a"), (2, "p", None), (3, None, "b")]
