"""Main text of web pages by equivalence classes of template tokens.

Pass 1 lists each page's tokens: container tokens (the path of container tags, with class and id, from the root) and text tokens
(a block of text at its innermost path). Tokens of one host that have the same occurrence vector over its pages form an
equivalence class; vectors are compared by two sums of keyed page hashes weighted with the counts, so no vector is ever
gathered. A class is valid if its paths nest; nested valid classes make the host's template, and so do the text tokens
that stand at their place on nine tenths of the pages. The main slot is the deepest template slot that holds all of the
host's running text, not counting template text: what stands beside it is dropped by markup or is template text.

Pass 2 extracts what remains in that slot: less the blocks that are template text, less the parts that are no article by their
markup (menus, adverts, forms, comments and so on). A page without the slot falls back to its article, its main element, or its
body. Template text inside the slot counts only on hosts of LEAST_PAGES pages or more, and only where it is less than half of
the slot's text: pages that are copies of one another show no template.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

SALTS, MAX_SENT, LEAST_PAGES = 64, shared.MAX_BROADCAST_BYTES // 4, 4
LISTED = "host string, path string, piece bigint, n bigint, a bigint, b bigint, size bigint"
#: Elements whose content is never article text; elements that hold others; elements that end a block.
DROPPED = frozenset("script style noscript template iframe svg nav footer aside form button select textarea dialog head menu".split())
RAW = frozenset("script style noscript template iframe svg textarea".split())
CONTAINERS = frozenset("html head body div section article main header table tbody tr td th ul ol li dl details center".split()) | DROPPED
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre hr br dt dd figure figcaption address fieldset caption option summary".split()) | CONTAINERS
VOID = frozenset("br hr img input meta link source area base col embed wbr".split())
SLOTS = frozenset("body div section article main td".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
#: Words in class or id names that mark a part as no article. Fixed values.
_NAMES = (
    "ad|ads|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|promotion|cookie|cookies|consent|gdpr|notice|notices|alert|newsletter|subscribe|subscription|signup|login|sidebar|side|"
    "rail|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|comment|comments|disqus|reply|replies|respond|share|sharing|social|related|recommended|recommendations|footer|masthead|topbar|popup|modal|overlay|pagination|pager|toolbar|widget|widgets|skip|search"
)
NAMED = re.compile(rf"(?:^|[\s_-])(?:{_NAMES})(?:$|[\s_-])", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*(?:>|$)", re.S)
_ATTR = re.compile(r"([a-zA-Z_:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


class Element:
    __slots__ = ("tag", "path", "dropped")

    def __init__(self, tag: str, path: str, dropped: bool):
        self.tag, self.path, self.dropped = tag, path, dropped


def events(page: str) -> Iterator[tuple[str, object, list[Element]]]:
    """("open", element, stack), ("block", None, stack) and ("text", raw text, stack), in page order. Only containers are
    kept on the stack; an end tag without its element is nothing, one further up ends what it holds."""
    stack: list[Element] = []
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            yield "text", page[at:], stack
            return
        if m.start() > at:
            yield "text", page[at : m.start()], stack
        at = m.end()
        if m[2] is None:
            if page.startswith("<", m.start()) and m[0][1:2].isalpha():
                yield "block", None, stack
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in CONTAINERS:
                if any(e.tag == tag for e in stack):
                    while stack.pop().tag != tag:
                        pass
                yield "block", None, stack
            elif tag in BLOCKS:
                yield "block", None, stack
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else n
            continue
        if tag in CONTAINERS:
            attrs = {a.lower(): x or y or z for a, x, y, z in _ATTR.findall(m[3])} if m[3] else {}
            if tag in ("li", "tr", "td", "th") and stack and stack[-1].tag == tag:
                stack.pop()
            names = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip()
            above = stack[-1] if stack else None
            out = bool(above and above.dropped) or tag in DROPPED or attrs.get("role", "").lower() in ROLES or bool(names and tag not in ("html", "body", "article", "main") and NAMED.search(names))
            if tag == "header" and not any(e.tag in ("article", "main") for e in stack):
                out = True
            if tag == "article" and names and re.search(r"(?:^|[\s_-])(?:comment|comments|reply)(?:$|[\s_-])", names, re.I):
                out = True
            e = Element(tag, f"{above.path if above else ''}/{tag}" + (f".{'.'.join(names.split())}" if names else ""), out)
            yield "block", None, stack
            if tag not in VOID:
                stack.append(e)
                yield "open", e, stack
        elif tag in BLOCKS:
            yield "block", None, stack


def blocks(page: str) -> Iterator[tuple[str, list[Element], bool]]:
    """(block of text as it stands, elements above it, None) in page order, less dropped parts; and the elements as they open
    ("", stack, True)."""
    pieces: list[str] = []
    above: list[Element] = []
    for kind, what, stack in events(page):
        if kind == "text":
            if not (stack and stack[-1].dropped):
                if not pieces:
                    above = list(stack)
                pieces.append(what)
            continue
        if pieces:
            yield "".join(pieces), above, False
            pieces = []
        if kind == "open":
            yield "", stack, True
    if pieces:
        yield "".join(pieces), above, False


def key_of(block: str) -> int:
    """What text tokens are compared by: 63 bits of a hash of the block, its white space evened out."""
    import xxhash

    return xxhash.xxh3_64_intdigest(" ".join(block.split())) >> 1


def tokens(page: str) -> tuple[dict[str, list[int]], dict[tuple[str, int], int]]:
    """path -> [times opened, characters of running text below it]; (innermost path, key of a block of text) -> its characters."""
    out: dict[str, list[int]] = {}
    texts: dict[tuple[str, int], int] = {}
    for block, stack, opened in blocks(page):
        if opened:
            if not stack[-1].dropped:
                out.setdefault(stack[-1].path, [0, 0])[0] += 1
        elif stack:
            size = len(block.strip())
            for path in {e.path for e in stack} if size else ():
                out.setdefault(path, [0, 0])[1] += size
            if size:
                k = stack[-1].path, key_of(block)
                texts[k] = texts.get(k, 0) + size
    return out, texts


def main_text(page: str | None, slot: str | None = None, template: frozenset[int] = frozenset()) -> str:
    """Blocks of the slot, but for those whose key is in ``template``, or of the fallback, joined by newlines; white space inside a
    block is one space."""
    if not page:
        return ""
    inside: dict[str, list[str]] = {"slot": [], "article": [], "main": [], "body": []}
    for block, stack, opened in blocks(page):
        if opened:
            continue
        text = " ".join(entities.unescape(block).split())
        if not text:
            continue
        for k, held in inside.items():
            if k == "body" or any(e.path == slot if k == "slot" else e.tag == k for e in stack):
                if k != "slot" or not template or key_of(block) not in template:
                    held.append(text)
    return "\n".join(next((inside[k] for k in ("slot", "article", "main", "body") if inside[k]), []))


def host(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


@shared.tidy
def _list_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        hosts, pages, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
        for h, page in zip(hosts, pages):
            # the page's place in the vector: two hashes of its content, wrapped to keep the sums in range
            a, b = (int(np.int64(xxhash.xxh3_64_intdigest(page or "", seed) >> 24)) for seed in (1, 2))
            found, texts = tokens(page or "")
            out += [(h, path, None, n, a * n, b * n, size) for path, (n, size) in found.items()]
            out += [(h, path, key, 1, 0, 0, size) for (path, key), size in texts.items()]
        cols = list(zip(*out)) or [[]] * 7
        types = (pa.string(), pa.string(), *[pa.int64()] * 5)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], ["host", "path", "piece", "n", "a", "b", "size"])


def templates(pages: DataFrame) -> DataFrame:
    """(host, slot, template): the main slot of each host's template, and the keys of the template text inside it."""
    listed = pages.select(host().alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(_list_tokens, LISTED)
    total = F.sum(F.col("a").cast("decimal(38,0)")).alias("a"), F.sum(F.col("b").cast("decimal(38,0)")).alias("b")
    # kept: all tokens of a host, a row each; pages are summed up before the shuffle
    counted = shared.stored(listed.groupBy("host", "path", "piece").agg(F.count("*").alias("support"), F.sum("n").alias("times"), *total, F.sum("size").alias("size")).where("piece is null or support > 1"), "tokens")
    vectors = counted.where("piece is null").drop("piece")
    depth = F.size(F.split("path", "/"))
    classes = vectors.groupBy("host", "support", "times", "a", "b").agg(F.max(depth).alias("deepest"), F.count("*").alias("members"), F.min(F.struct(depth, "path")).getField("path").alias("outer"), F.collect_list(F.struct("path", "size")).alias("tokens"))
    # valid: every path of the class lies below its outermost one, once for each time that stands
    valid = classes.where(F.forall("tokens", lambda t: t.getField("path").startswith(F.col("outer"))))
    whole = valid.groupBy("host").agg(F.max("support").alias("pages"))
    inner = valid.join(whole, "host").where("2 * support >= pages AND times = support").select("host", F.explode("tokens").alias("t"), "pages").select("host", "pages", "t.path", "t.size")
    # template text: pieces at one place on nine tenths of the pages; it counts for none of the paths above it
    repeated = counted.where("piece is not null").join(whole, "host").where("10 * support >= 9 * pages")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    template = repeated.select("host", "size", F.explode(above).alias("path")).groupBy("host", "path").agg(F.sum("size").alias("template"))
    inner = inner.join(template, ["host", "path"], "left").withColumn("own", F.col("size") - F.coalesce("template", F.lit(0))).drop("template")
    most = inner.groupBy("host").agg(F.max("size").alias("most"), F.max("own").alias("most_own"))
    slots = inner.join(most, "host").withColumn("tag", F.regexp_extract(F.element_at(F.split("path", "/"), -1), "^[a-z]+", 0)).where(F.col("tag").isin(*SLOTS))
    named = F.when(F.col("tag").isin("article", "main") & (2 * F.col("size") >= F.col("most")), 2).when(F.col("own") >= F.col("most_own"), 1).otherwise(0)
    held = F.when(F.col("most_own") > 0, F.col("own")).otherwise(F.col("size"))  # pages that are all alike have no text of their own
    best = F.max(F.struct("rank", "held", F.size(F.split("path", "/")), "path", "size")).alias("best")
    main = slots.withColumn("rank", named).withColumn("held", held).where("rank > 0").groupBy("host").agg(best, F.first("pages").alias("pages")).select("host", "pages", "best.path", "best.size")
    main = main.withColumnsRenamed({"path": "slot", "size": "slot_size"})
    below = (F.col("path") == F.col("slot")) | F.col("path").startswith(F.concat("slot", F.lit("/")))
    texts = repeated.drop("pages").join(main, "host").where(below).groupBy("host").agg(F.collect_set("piece").alias("keys"), F.sum("size").alias("held"))
    few = (F.col("pages") >= LEAST_PAGES) & (2 * F.col("held") < F.col("slot_size"))
    return main.join(texts, "host", "left").select("host", "slot", F.when(few, F.col("keys")).otherwise(F.array().cast("array<bigint>")).alias("template"))


@shared.tidy
def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(batch.column("html").to_pylist(), batch.column("slot").to_pylist(), batch.column("template").to_pylist())
        texts = [main_text(page, slot, frozenset(template or ())) for page, slot, template in rows]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("slot"), pa.array(texts, pa.string())], ["row", "slot", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """``row`` (all columns of pages but html), ``slot`` and ``text`` for every page; null or empty html gives ''.

    A null or odd url is the host ''. Rows given twice are extracted alike, and an empty table gives an empty one. Pages of any length
    are read whole. Columns with clashing names stay in ``row``.

    Slots of up to MAX_SENT bytes in all go to the pages as a broadcast. More are joined by host and salt, so that a host with a
    third of all pages is spread over SALTS tasks.
    """
    slots = shared.stored(templates(pages), "slots")
    held = slots.agg(F.sum(F.length("host") + F.length("slot") + 8 * F.size("template") + 100)).first()[0] or 0
    kept = [c for c in pages.columns if c != "html"]
    source = pages.select(F.struct(*kept).alias("row"), F.col("html").cast("string").alias("html"), host().alias("host"))
    if held <= MAX_SENT:
        met = source.join(F.broadcast(slots), "host", "left")
    else:
        salted = slots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = source.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    met = met.select("row", "html", "slot", "template")
    return met.mapInArrow(_extract, f"row {met.schema['row'].dataType.simpleString()}, slot string, text string")


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(shared.table(spark, sf_dir, "pages"))
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("bigint").alias("n_chars"), "slot")
