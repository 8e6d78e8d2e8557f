"""URL functions by plain patterns; nothing here touches a network. parse_url keeps a host's case and drops its port, so it is not used."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import blank, domain_name, identity_tokens, slug, squash

#: Domain, then platform, in the order in which they are tried. Fixed values.
PLATFORMS = (
    ("workforcenow.adp.com", "ADP Workforce Now"), ("recruiting.adp.com", "ADP Recruiting"), ("myworkdayjobs.com", "Workday"), ("wd1.myworkdayjobs.com", "Workday"), ("wd5.myworkdayjobs.com", "Workday"),
    ("greenhouse.io", "Greenhouse"), ("boards.greenhouse.io", "Greenhouse"), ("lever.co", "Lever"), ("jobs.lever.co", "Lever"), ("icims.com", "ICIMS"), ("paylocity.com", "Paylocity"), ("ukg.com", "UKG"),
    ("ultipro.com", "UKG"), ("adp.com", "ADP Workforce Now"), ("bamboohr.com", "BambooHR"), ("smartrecruiters.com", "SmartRecruiters"), ("jobvite.com", "Jobvite"), ("paycomonline.net", "Paycom"),
    ("recruitingbypaycor.com", "Paycor"), ("applicantpro.com", "ApplicantPro"), ("saashr.com", "UKG Ready"), ("oraclecloud.com", "Oracle Recruiting"), ("successfactors.com", "SAP SuccessFactors"),
    ("isolvedhire.com", "isolved Hire"), ("jazzhr.com", "JazzHR"), ("clearcompany.com", "ClearCompany"), ("hrmdirect.com", "ClearCompany"), ("paycor.com", "Paycor"), ("app.joinhandshake.com", "Handshake"),
    ("jobs.dayforcehcm.com", "Dayforce"), ("csod.com", "Cornerstone"),
)
#: Sites that are never a company's own. Fixed values.
DISALLOWED = (
    "wikipedia.org", "facebook.com", "linkedin.com", "yelp.com", "crunchbase.com", "zoominfo.com", "bbb.org", "glassdoor.com", "indeed.com", "ziprecruiter.com", "jobzmall.com", "monster.com", "careerbuilder.com",
    "simplyhired.com", "jooble.org", "salary.com", "mapquest.com", "yellowpages.com", "opencorporates.com", "dnb.com", "ncua.gov", "routingnumber", "usbanklocations.com", "bankbranchlocator.com", "branchspot.com",
)
DISALLOWED_PARTS = ("routing-number", "routingnumber", "reviews", "review", "directory", "branches")
#: Second-level public suffixes beside the plain top-level ones; longest match wins. A table parameter replaces them.
PUBLIC_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "com.br", "com.mx", "co.in", "co.za", "com.sg", "com.hk")


def with_scheme(c: Column | str) -> Column:
    s = F.trim(blank(c))
    return F.when(s.contains("://"), s).otherwise(F.concat(F.lit("https://"), s))


def netloc(c: Column | str) -> Column:
    return F.regexp_extract(with_scheme(c), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def domain_key(c: Column | str) -> Column:
    """The lower-case authority without a leading www.; port and user stay. '' for a blank."""
    return F.when(blank(c) == "", "").otherwise(F.regexp_replace(F.lower(netloc(c)), r"^www\.", ""))


def host(c: Column | str) -> Column:
    """The lower-case host: no user, no port, no trailing dot."""
    return F.regexp_replace(F.lower(F.regexp_extract(netloc(c), r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1)), r"\.+$", "")


def path(c: Column | str) -> Column:
    return F.regexp_extract(with_scheme(c), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(c: Column | str) -> Column:
    return F.regexp_extract(with_scheme(c), r"^[^?#]*\?([^#]*)", 1)


def _plain(c: Column | str, h: Column | None = None) -> Column:
    """A plain http(s) URL: a host, no user, a port that is one. ``h``: its host, where it is at hand."""
    scheme, authority = F.lower(F.regexp_extract(with_scheme(c), "^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), netloc(c)
    port = F.regexp_extract(authority, r":(\d*)$", 1)
    bad = (blank(c) == "") | ~scheme.isin("http", "https") | ((host(c) if h is None else h) == "") | authority.contains("@") | authority.rlike(r"(?<!\]):[^0-9\]]")
    return ~bad & F.coalesce(port.try_cast("int") <= 65535, port == "")


def canonical(c: Column | str) -> Column:
    """Lower-case scheme and host, no default port, '/' for an empty path, no fragment. Null for what is no plain http(s) URL."""
    s, authority = with_scheme(c), netloc(c)
    scheme = F.lower(F.regexp_extract(s, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    port = F.regexp_extract(authority, r":(\d*)$", 1)
    keep = (port != "") & ~((scheme == "http") & (port == "80")) & ~((scheme == "https") & (port == "443"))
    q = query(c)
    out = F.concat(scheme, F.lit("://"), host(c), F.when(keep, F.concat(F.lit(":"), port.try_cast("int").cast("string"))).otherwise(""), F.when(path(c) == "", "/").otherwise(path(c)), F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
    return F.when(_plain(c), out)


def site_root(c: Column | str) -> Column:
    return F.concat(F.regexp_extract(with_scheme(c), "^([A-Za-z][A-Za-z0-9+.-]*)://", 1), F.lit("://"), netloc(c), F.lit("/"))


def in_domain(h: Column, domain: Column | str) -> Column:
    d = F.lit(domain) if isinstance(domain, str) else domain
    return (h != "") & ((h == d) | h.endswith(F.concat(F.lit("."), d)))


def in_domains(h: Column, domains: Iterable[str]) -> Column:
    """The host is one of the domains or below one: a single test, however many there are."""
    return h.rlike(r"(?:^|\.)(?:" + "|".join(f"\\Q{d}\\E" for d in domains) + ")$")


def _once(value: Column, body) -> Column:
    """Evaluate value once and use it several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _platform_of(h: Column) -> Column:
    names = F.array(*(F.struct(F.lit(d).alias("domain"), F.lit(n).alias("name")) for d, n in PLATFORMS))
    return F.get(F.filter(names, lambda p: in_domain(h, p.getField("domain"))), F.lit(0)).getField("name")


def platform(*urls: Column | str, h: Column | None = None) -> Column:
    """The platform of the first URL that has one; domains are tried in their own order. ``h``: the host of a single URL, where it is at hand."""
    found = [_once(host(u), _platform_of) if h is None else _platform_of(h) for u in urls]
    return F.coalesce(*(F.when(blank(u) != "", f) for u, f in zip(urls, found)), F.lit(""))


def registered_domain(c: Column | str, suffixes: tuple[str, ...] = PUBLIC_SUFFIXES) -> Column:
    """The host's last label before its public suffix, with the suffix."""
    h = host(c)
    two = "|".join(f"\\Q{s}\\E" for s in suffixes)
    longer = F.regexp_extract(h, rf"([^.]+\.(?:{two}))$", 1)
    plain = F.regexp_extract(h, r"([^.]+\.[^.]+)$", 1)
    return F.when(longer != "", longer).when(plain != "", plain).otherwise(h)


def disallowed(c: Column | str, h: Column | None = None) -> Column:
    """A document, a listing or review page, or a site that is never a company's own. ``h``: its host, where it is at hand."""
    low, h = F.lower(blank(c)), host(c) if h is None else h
    return low.rlike(r"\.(pdf|doc|docx)$") | low.rlike("|".join(DISALLOWED_PARTS)) | in_domains(h, DISALLOWED)


def matches_company(name: Column | str, url: Column | str) -> Column:
    """The domain's first label is the company's normal name, or holds one of its identity tokens."""
    label = domain_name(F.get(F.split(registered_domain(url), r"\."), F.lit(0)))
    own = domain_name(name)
    return (label != "") & (own != "") & ((label == own) | F.exists(identity_tokens(name), lambda t: label.contains(t)))


def segments(c: Column | str) -> Column:
    """Lower-case path segments without page suffixes."""
    cleaned = F.transform(F.split(path(c), "/"), lambda s: F.regexp_replace(F.lower(F.trim(s)), r"\.(html?|aspx?|php|jsp|cfm)$", ""))
    return F.filter(cleaned, lambda s: s != "")


def company_id(official: Column | str, known: Column | str, name: Column | str, state: Column | str) -> Column:
    d = domain_key(F.when(blank(official) != "", blank(official)).otherwise(blank(known)))
    return F.concat(F.lit("company-"), F.when(d != "", slug(d)).otherwise(F.concat(slug(name), F.lit("-"), slug(state))))


def job_id(basis: Column | str) -> Column:
    """'job-' and 140 characters of the slug: long URLs may meet, so sources pass a short key of their own where they have one."""
    return F.concat(F.lit("job-"), F.substring(slug(basis), 1, 140))


def position_anchor(url: Column | str, title: Column | str) -> Column:
    return F.concat(blank(url), F.lit("#position-"), F.substring(F.sha2(F.lower(blank(title)), 256), 1, 16))


def safe_link(c: Column | str) -> Column:
    s = F.trim(blank(c))
    return F.when(s.rlike("(?i)^https?://.+"), s).otherwise("")


def public_shape(c: Column | str, h: Column | None = None) -> Column:
    """http(s) with a host that is neither private nor local, and no credentials. ``h``: its host, where it is at hand."""
    h = host(c) if h is None else h
    private = h.rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.|0\.|\[)") | h.endswith(".local") | ~h.contains(".")
    return _plain(c, h) & ~private


#: Query keys that carry a requisition id, in the order in which they are tried. Fixed values.
ID_KEYS = ("jobid", "job_id", "reqid", "req_id", "requisitionid", "requisition_id", "postingid", "posting_id", "jobcode", "job_code", "jvi", "jobreqid", "opportunityid", "vacancyid")
#: Segments that stand before an id or a posting's slug. Fixed values.
ID_ANCHORS = (
    "job", "jobs", "career", "careers", "opening", "openings", "opportunity", "opportunities", "position", "positions", "posting", "postings", "requisition", "requisitions", "vacancy", "vacancies",
    "apply", "employment",
)
#: Segments of a careers area. Fixed values.
CAREER_SEGMENTS = (
    "career", "careers", "job", "jobs", "employment", "opening", "openings", "opportunity", "opportunities", "join-our-team", "join-us", "work-with-us", "workhere", "work-here", "hiring", "recruiting",
    "recruitment", "vacancy", "vacancies", "positions", "apply",
)
#: Domain, then what path and query of a posting's own page hold there, in the order in which they are tried. Fixed values.
DETAIL_SHAPES = (
    ("greenhouse.io", r"/jobs/\d+"), ("lever.co", r"/[^/]+/[0-9a-f]{8}-[0-9a-f-]{27,}"), ("myworkdayjobs.com", r"/job/"), ("icims.com", r"/jobs/\d+"), ("applicantpro.com", r"/jobs/\d+"),
    ("isolvedhire.com", r"/jobs/\d+"), ("ultipro.com", r"/opportunitydetail"), ("workforcenow.adp.com", r"/recruitment/recruitment\.html|jobid="), ("recruiting.adp.com", r"/srccar/public/"),
    ("paycomonline.net", r"/viewjobdetails|/jobs/\d+"), ("recruitingbypaycor.com", r"/career/jobintroduction"), ("paylocity.com", r"/details/\d+"), ("jobs.dayforcehcm.com", r"/jobs/\d+"),
    ("csod.com", r"/requisition/\d+|/jobdetails"), ("hrmdirect.com", r"/employment/job-opening\.php"), ("applytojob.com", r"/apply/"), ("jazzhr.com", r"/apply/"), ("smartrecruiters.com", r"/\d{9,}"),
    ("jobvite.com", r"/job/"), ("bamboohr.com", r"/careers/\d+"), ("successfactors.com", r"/job/"), ("oraclecloud.com", r"/job/"), ("saashr.com", r"/ta/|/jobdetail"),
)
#: The board path of the vendor whose postings' URLs hold it, and the culture it has where none is named. Fixed values.
BOARD_HOST, BOARD_PATH, CULTURE = "jobs.dayforcehcm.com", r"(?i)^/(?:([A-Za-z]{2,3}(?:-[A-Za-z]{2})?)/)?([A-Za-z0-9_-]+)/([A-Za-z0-9_-]+)(?:/jobs/[0-9]+)?/?$", "en-US"


def _anchored(c: Column | str) -> Column:
    """The segments right behind an anchor that are no anchors or careers segments themselves."""
    s = segments(c)
    behind = F.transform(s, lambda x, i: F.when((i > 0) & F.get(s, F.greatest(i - 1, F.lit(0))).isin(*ID_ANCHORS) & ~x.isin(*ID_ANCHORS, *CAREER_SEGMENTS), x))
    return F.filter(behind, lambda x: x.isNotNull())


_NUMBERED = r"^(?=.*\d)[A-Za-z0-9][A-Za-z0-9._-]{1,63}$"


def requisition(c: Column | str) -> Column:
    """The requisition id in a query, as it stands there, or behind an anchor segment; ''."""
    by_key, q = F.lit(""), query(c)
    for k in reversed(ID_KEYS):
        v = F.trim(F.regexp_replace(F.regexp_extract(q, rf"(?i)(?:^|&){k}=([^&]+)", 1), r"\+", " "))
        by_key = F.when(v != "", F.coalesce(F.try_url_decode(v), v)).otherwise(by_key)
    return F.when(by_key != "", by_key).otherwise(F.coalesce(F.get(F.filter(_anchored(c), lambda x: x.rlike(_NUMBERED)), F.lit(0)), F.lit("")))


def posting_slug(c: Column | str) -> Column:
    """A slug without digits behind an anchor segment; ''. Weak evidence: a benefits page has the same shape."""
    return F.coalesce(F.get(F.filter(_anchored(c), lambda x: ~x.rlike(_NUMBERED) & x.rlike("^[a-z0-9]+(?:-[a-z0-9]+)+$")), F.lit(0)), F.lit(""))


def detail_vendor(c: Column | str) -> Column:
    """The domain whose posting pages look like this URL; ''. Only a URL with a scheme has a host."""
    s = F.trim(blank(c))
    shapes = F.array(*(F.struct(F.lit(d).alias("domain"), F.lit(f"(?i){p}").alias("shape")) for d, p in DETAIL_SHAPES))
    at = F.struct(F.when(s.contains("://"), host(s)).otherwise("").alias("host"), F.concat(path(s), F.lit("?"), query(s)).alias("target"))
    fits = lambda x: F.filter(shapes, lambda p: in_domain(x.getField("host"), p.getField("domain")) & F.regexp_like(x.getField("target"), p.getField("shape")))
    return F.coalesce(_once(at, lambda x: F.get(fits(x), F.lit(0)).getField("domain")), F.lit(""))


def canonical_board(c: Column | str) -> Column:
    """The board's root for a board or posting URL of the one vendor that has both in one path; any other URL as it is, trimmed."""
    s = F.trim(blank(c))
    authority, route = F.lower(netloc(s)), path(s)
    known = s.rlike("(?i)^https://") & authority.isin(BOARD_HOST, f"{BOARD_HOST}:443", f"{BOARD_HOST}.", f"{BOARD_HOST}:") & route.rlike(BOARD_PATH)
    part = lambda k: F.regexp_extract(route, BOARD_PATH, k)
    return F.when(known, F.concat_ws("/", F.lit(f"https://{BOARD_HOST}"), F.when(part(1) == "", CULTURE).otherwise(part(1)), part(2), part(3))).otherwise(s)


def careers_context(page_url: Column | str, h1: Column | str, title: Column | str) -> Column:
    """Why a page is a careers page: a segment of its URL, its heading, its title; ''."""
    named = F.get(F.filter(segments(page_url), lambda x: x.isin(*CAREER_SEGMENTS)), F.lit(0))
    words = r"(?i)\b(?:careers?|jobs?|employment|openings?|opportunit(?:y|ies)|join our team|work (?:with|for) us|hiring)\b"
    said = lambda c, kind: F.when(squash(c).rlike(words), F.concat(F.lit(f'careers page {kind} ("'), F.substring(squash(c), 1, 80), F.lit('")')))
    return F.coalesce(F.concat(F.lit('careers URL segment ("'), named, F.lit('")')), said(h1, "h1"), said(title, "title"), F.lit(""))


def crawl(links: DataFrame, seeds: DataFrame, depth: int | None = None, most: int = 8) -> DataFrame:
    """Breadth-first over a landed edge table links(src, dst) from seeds(site, url), inside one registered domain: at most
    ``most`` pages a site, in order of depth, then URL. One join a level, down to the level at which every site has its pages or
    has no links left (or to ``depth``); only the number of new pages reaches the driver."""
    from pyspark.sql import Window as W

    front = seeds.select("site", F.col("url").alias("url"), F.lit(0).alias("depth"))
    seen, d = front, 0
    edges = links.select(F.col("src").alias("url"), "dst").where(registered_domain("src") == registered_domain("dst"))
    while depth is None or d < depth:
        d += 1
        wanting = seen.groupBy("site").agg(F.count("*").alias("n")).where(F.col("n") < most).select("site")
        new = front.join(edges, "url").select("site", F.col("dst").alias("url"), F.lit(d).alias("depth")).distinct().join(seen.select("site", "url"), ["site", "url"], "left_anti")
        new = new.join(wanting, "site", "left_semi")
        if depth is None and new.isEmpty():
            break
        front, seen = new, seen.unionByName(new)
    return seen.withColumn("rank", F.row_number().over(W.partitionBy("site").orderBy("depth", "url"))).where(F.col("rank") <= most)
