"""Secret scan with multipart credential linking, in DataFrame operations only.

Base findings (assign, access, hex) stand alone. Weak candidates - account names, addresses, hosts, endpoints, secret-shaped
strings - are parts of a credential: a weak part is reported only where a part with another role lies within SCOPE code points of
it in the same text, and one of the two is a secret or a base finding. The parts are joined as intervals: each lies in
the buckets that it touches and looks into those and their neighbours.

Texts are scanned once; what is found (places, no text) is written, linked once for each distinct text, and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .sqltext import found

SCOPE = 200
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ASSIGN_LEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_ADDRESS = "[A-Za-z0-9._%+-]"
#: Weak parts: kind, role, pattern (for SQL engines without look-behind: SQL_PATTERNS), what a match must also hold.
WEAK = (
    ("identifier", "id", r"""(?i:user(?:name)?|login|account_?id|client_?id|tenant_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", ()),
    ("secret", "secret", "[A-Za-z0-9+/]{32,}", ("^.{1,88}$", "[A-Z]", "[a-z]", "[0-9]")),
    ("endpoint", "endpoint", r"""(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|s3|ftps?)://[^\x09-\x0D\x20"'<>]{4,}""", ()),
    # begins where its run of characters does, so that a long run is read once
    ("account", "id", rf"(?:\G|(?<!{_ADDRESS})){_ADDRESS}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", ()),
    ("host", "endpoint", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", (rf"^(?:{_OCTET}\.){{3}}{_OCTET}$",)),
)
SQL_PATTERNS = {"account": rf"{_ADDRESS}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"}
KINDS = ("assign", "access", "hex", *(w[0] for w in WEAK))
ROLES = ("secret", "id", "secret", *(w[1] for w in WEAK))
_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _kind(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s.getField("start").alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s.getField("end").alias("end")))


def base_spans(text: Column) -> Column:
    """assign, access and hex findings in order of start, then kind."""
    none = F.array().cast(_SPAN)
    # assign's matches are taken first and dropped after, for a match too short still uses up its characters
    assign = F.filter(found(text, ASSIGN), lambda s: F.length(F.regexp_replace(s.getField("match"), ASSIGN_LEAD, "")) >= 12)
    some = lambda test, spans, kind: F.when(test, _kind(spans, kind).cast(_SPAN)).otherwise(none)
    return F.sort_array(F.concat(
        some(text.rlike(ASSIGN_HEAD), assign, "assign"),
        some(text.contains("AKIA"), F.filter(found(text, ACCESS), lambda s: F.length(s.getField("match")) >= 18), "access"),
        some(text.rlike("[0-9a-f]{16}"), found(text, "[0-9a-f]{16,}"), "hex"),  # a run of 16 or more is a match of HEX that passes
    ))


def render(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.getField("kind")), s.getField("start").cast("string"), s.getField("end").cast("string"))), ",")


def weak_spans(text: Column) -> Column:
    """All weak candidates, linked or not."""
    none = F.array().cast(_SPAN)

    def of(kind: str, pattern: str, also: tuple[str, ...]) -> Column:
        fits = found(text, pattern)
        if also:
            fits = F.filter(fits, lambda s: F.forall(F.array(*map(F.lit, also)), lambda more: F.regexp_like(s.getField("match"), more)))
        return F.when(text.rlike(pattern), _kind(fits, kind).cast(_SPAN)).otherwise(none)

    return F.concat(*(of(kind, pattern, also) for kind, _, pattern, also in WEAK))


def linked_parts(texts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(tk, added): the weak parts of each text (tk, base, weak) that stand near a part that completes them."""
    parts = texts.select("tk", F.explode(F.concat("base", "weak")).alias("s")).select("tk", "s.start", "s.end", "s.kind")
    parts = parts.withColumn("role", F.get(F.array(*map(F.lit, ROLES)), F.col("kind"))).withColumn("bucket", F.floor(F.col("start") / scope))
    mine = parts.where(F.col("kind") >= 3)
    # a part may be longer than the scope: it stands in every bucket it touches
    other = parts.select("tk", *(F.col(c).alias(f"o_{c}") for c in ("start", "end", "kind", "role")), F.explode(F.sequence(F.col("bucket"), F.floor(F.col("end") / scope))).alias("bucket"))
    looks = mine.withColumn("bucket", F.explode(F.sequence(F.col("bucket") - 1, F.floor(F.col("end") / scope) + 1)))
    near = (F.col("o_start") - F.col("end") <= scope) & (F.col("start") - F.col("o_end") <= scope)
    completes = (F.col("role") != F.col("o_role")) & ((F.col("role") == "secret") | (F.col("o_role") == "secret") | (F.col("o_kind") < 3))
    overlaps = (F.col("o_start") < F.col("end")) & (F.col("start") < F.col("o_end"))
    kept = looks.join(other, ["tk", "bucket"]).where(near & completes & ~overlaps).select("tk", "start", "kind", "end").distinct()
    return kept.groupBy("tk").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))


def scan(docs: DataFrame, scope: int = SCOPE, keep: list[str] | None = None) -> DataFrame:
    """``row`` (all columns of docs but text, or those of ``keep``) with base and all spans (start, kind index, end).

    Null and empty texts have no span, an empty table gives an empty one. Rows given twice are scanned alike. A text of any length
    is scanned whole, in time linear in it and its matches. Columns with clashing names stay in ``row``; a null doc_id does not
    matter, since parts are linked by a key of the text. Copies of one text are linked once and dealt over several tasks.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = [c for c in docs.columns if c != "text"] if keep is None else keep
    row = F.struct(*kept) if kept else F.struct(F.lit(None).cast("string").alias("none"))
    spans = docs.select(row.alias("row"), text.alias("text")).select("row", shared.text_key().alias("tk"), base_spans(F.col("text")).alias("base"), weak_spans(F.col("text")).alias("weak"))
    spans = shared.stored(spans, "spans")
    # a weak part needs a second part
    able = (F.size("weak") > 0) & (F.size("base") + F.size("weak") > 1)
    texts = spans.where(able).groupBy("tk").agg(F.first("base").alias("base"), F.first("weak").alias("weak"), F.count("*").alias("copies"))
    texts = shared.stored(texts, "texts")
    added = shared.stored(linked_parts(texts, scope).join(texts.select("tk", "copies"), "tk"), "added")
    # rows that can have no link get a key of their own, so that copies of such a text do not meet in one task
    keyed = spans.withColumn("tk", F.when(able, F.col("tk")).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id())))
    every = F.sort_array(F.concat("base", F.coalesce("added", F.array().cast(_SPAN)).cast(_SPAN)))
    return shared.join_spread(keyed, added, ["tk"], "copies", F.monotonically_increasing_id(), "left").select("row", "base", every.alias("spans"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(shared.table(spark, sf_dir, "documents"), keep=["doc_id"]).select("row.doc_id", "base", "spans")
    count = lambda k: F.size(F.filter("base", lambda s: s.getField("kind") == k)).cast("bigint")
    n_linked = (F.size("spans") - F.size("base")).cast("bigint")
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(render(F.col("base")), 256).alias("base_sha256"), render(F.col("spans")).alias("spans"), n_linked.alias("n_linked"))


_quoted = lambda s: "'" + s.replace("'", "''") + "'"
_FITS = {0: f"length(regexp_replace(m, {_quoted(ASSIGN_LEAD)}, '')) >= 12", 1: "length(m) >= 18", 2: "length(m) >= 16"} | {
    3 + k: " AND ".join([f"regexp_matches(m, {_quoted(a)})" for a in also] or ["true"]) for k, (*_, also) in enumerate(WEAK)
}
_PATTERNS = (ASSIGN, ACCESS, f"{HEX[:-1]}{{16,}}", *(SQL_PATTERNS.get(w[0], w[2]) for w in WEAK))
_ALL = " UNION ALL ".join(
    f"SELECT doc_id, '{KINDS[k]}' AS kind, {k} AS k, '{ROLES[k]}' AS role, regexp_extract_all(t, {_quoted(p)}) AS ms, string_split_regex(t, {_quoted(p)}) AS ps FROM d" for k, p in enumerate(_PATTERNS)
)
_COMPLETE = f"a.role <> b.role AND (a.role = 'secret' OR b.role = 'secret' OR b.k < 3) AND b.s - a.e <= {SCOPE} AND a.s - b.e <= {SCOPE} AND NOT (b.s < a.e AND a.s < b.e)"
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({_ALL}),
u AS (SELECT doc_id, kind, k, role, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM m),
p AS (SELECT doc_id, kind, k, role, ms[i] AS m, CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + list_sum(list_transform(ms[1:i], lambda x: length(x))) AS BIGINT) AS e FROM u),
f AS (SELECT *, e - length(m) AS s FROM p WHERE CASE k {" ".join(f"WHEN {k} THEN {c}" for k, c in _FITS.items())} END),
l AS (SELECT * FROM f WHERE k < 3 UNION ALL SELECT DISTINCT a.* FROM f a JOIN f b USING (doc_id) WHERE a.k >= 3 AND {_COMPLETE}),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, count(*) FILTER (k >= 3) AS n_linked,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM l GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
FROM d LEFT JOIN g USING (doc_id)
"""
