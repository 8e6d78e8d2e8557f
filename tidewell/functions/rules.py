"""Rule cascades over postings: titles, roles, pay, work types, evidence, destinations. All are Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import numbers as N
from . import text as T
from . import url as U

# ---- Fixed values: titles ----
EXACT_REJECTS = (
    "general employment application", "skip to content", "careers", "career", "search open positions", "search jobs", "view open positions", "view current openings", "current openings", "job openings",
    "apply now", "apply", "learn more", "read more", "view details", "view details (opens an external site)", "opens an external site", "join our team", "home", "menu", "privacy", "privacy policy", "terms",
    "terms of use", "accessibility", "sign in", "login", "log in", "remote work", "benefits", "culture", "locations", "equal opportunity", "talent community", "open positions all departments", "job alerts",
    "create alert", "subscribe", "share", "back", "next", "previous", "filter", "sort",
)
PART_REJECTS = (
    "view details", "opens an external site", "skip navigation", "current openings", "equal opportunity employer", "join our talent community", "cookie", "captcha", "forgot password", "create account",
    "job alerts", "powered by", "remote work", "equal opportunity", "talent community", "search jobs", "search open positions", "open positions", "apply now", "learn more", "read more", "create alert",
    "accessibility", "locations", "benefits", "culture",
)
STRUCTURED_REJECTS = ("join our talent community", "equal opportunity employer", "skip navigation", "forgot password", "create account", "powered by", "search open positions", "search jobs")
GENERIC_WORDS = (
    "apply", "career", "careers", "job", "jobs", "menu", "opening", "openings", "position", "positions", "search", "view", "details", "external", "site", "learn", "more", "read", "alerts", "alert", "subscribe",
    "filter", "sort", "share", "back", "next", "previous",
)
ROLE_NOUNS = (
    "accountant", "consultant", "teller", "banker", "representative", "receptionist", "specialist", "manager", "analyst", "engineer", "administrator", "coordinator", "processor", "officer", "associate", "assistant",
    "director", "supervisor", "advisor", "clerk", "technician", "architect", "developer", "lead", "senior", "branch", "member", "service", "loan", "mortgage", "compliance", "risk", "operations", "finance",
    "accounting", "it", "systems", "security", "infrastructure", "core", "data",
)
# ---- Fixed values: roles, in the order in which they are tried; the pattern is part of the stated reason ----
EXEC_TITLES = (
    r"\bchief\b", r"\bc[- ]?level\b", r"\bexecutive vice president\b", r"\bevp\b", r"\bsenior vice president\b", r"\bsvp\b", r"\bvice president\b", r"\bvp\b", r"\bpresident\b", r"\bcio\b", r"\bcto\b", r"\bciso\b", r"\bcoo\b", r"\bcfo\b", r"\bceo\b",
)
MANAGER_TITLES = (r"\bmanager\b", r"\bsupervisor\b", r"\bdirector\b", r"\bhead of\b", r"\bteam lead\b", r"\blead manager\b", r"\bbranch manager\b", r"\boperations manager\b", r"\bassistant manager\b", r"\bdepartment manager\b")
MANAGER_TEXTS = (
    r"manages a team", r"supervises employees", r"direct reports", r"performance reviews", r"coaching staff", r"\b(?:hire|hiring),?\s+(?:coach(?:ing)?|manage(?:ment)?|supervis(?:e|ing))\b", r"leads department", r"responsible for (?:a )?team",
    r"oversees staff", r"people leader",
)
CONTRIBUTOR_WORDS = (
    "specialist", "analyst", "engineer", "administrator", "consultant", "representative", "teller", "banker", "processor", "coordinator", "technician", "architect", "developer", "associate", "clerk", "advisor", "assistant", "officer",
)
DAYS_AGO = r"^\d+\+?\s+days?\s+ago$"


def _title(c: Column | str) -> tuple[Column, Column, Column]:
    shown = T.job_title(c)
    low = F.lower(shown)
    return shown, low, T.ascii_words(shown)


def _long_block(shown: Column, low: Column) -> Column:
    return (F.length(shown) > 140) & T.contains_any(low, ("apply", "join", "search", "opening"))


def title_score(c: Column | str) -> Column:
    """+2 for a role noun, +2 for 'member service', -4 for boilerplate, -1 for a generic word, +1 for three words or more."""
    _, low, words = _title(c)
    point = lambda test, n: F.when(test, n).otherwise(0)
    return (
        point(F.exists(words, lambda w: w.isin(*ROLE_NOUNS)), 2) + point(low.contains("member service"), 2) + point(T.contains_any(low, PART_REJECTS), -4)
        + point(F.exists(words, lambda w: w.isin(*GENERIC_WORDS)), -1) + point(F.size(words) >= 3, 1)
    )


def title_rejection(c: Column | str) -> Column:
    """Why a title is none, the first reason that holds; 'unknown' for a good one."""
    shown, low, words = _title(c)
    generic = lambda w: w.isin(*GENERIC_WORDS)
    return (
        F.when(shown == "", "blank title").when(F.length(shown) < 4, "too short").when(low.isin(*EXACT_REJECTS), "navigation/button label").when(T.contains_any(low, PART_REJECTS), "boilerplate text")
        .when(low.rlike(DAYS_AGO), "posted date text").when(F.size(words) == 0, "no title words").when(F.forall(words, generic), "generic navigation words only")
        .when((F.size(words) <= 2) & F.exists(words, generic), "short generic title").when(_long_block(shown, low), "long UI block").when(title_score(c) < 1, "not enough real job title signal").otherwise("unknown")
    )


def valid_title(c: Column | str) -> Column:
    return title_rejection(c) == "unknown"


def valid_structured_title(c: Column | str) -> Column:
    """For titles that a structured source already marks as postings: only navigation and boilerplate go."""
    shown, low, words = _title(c)
    return (F.length(shown) >= 2) & ~low.isin(*EXACT_REJECTS) & ~low.rlike(DAYS_AGO) & (F.size(words) > 0) & ~F.forall(words, lambda w: w.isin(*GENERIC_WORDS)) & ~T.contains_any(low, STRUCTURED_REJECTS)


def role_type(title: Column | str, text: Column | str) -> Column:
    """struct(type, reason): EXEC, MGR, IC or UNKNOWN, and the first pattern that decided."""
    t, d = F.lower(T.blank(title)), F.lower(T.blank(text))
    words = F.array_distinct(T.ascii_words(title))
    said = lambda kind, why: F.struct(F.lit(kind).alias("type"), (why if isinstance(why, Column) else F.lit(why)).alias("reason"))
    first = lambda patterns, x: F.coalesce(*(F.when(x.rlike(p), F.lit(p)) for p in patterns))
    quote = lambda head, p: F.concat(F.lit(f"{head} '"), p, F.lit("'."))
    ex, mt, md = first(EXEC_TITLES, t), first(MANAGER_TITLES, t), first(MANAGER_TEXTS, d)
    return (
        F.when(F.trim(t) == "", said("UNKNOWN", "Title missing or unclear."))
        .when(ex.isNotNull(), said("EXEC", quote("Matched executive title pattern", ex)))
        .when(mt.isNotNull(), said("MGR", quote("Matched manager title pattern", mt)))
        .when(md.isNotNull() & t.contains("lead"), said("MGR", quote("Lead title plus people-management signal", md)))
        .when(md.isNotNull(), said("MGR", quote("Matched people-management description signal", md)))
        .when(F.exists(words, lambda w: w.isin(*CONTRIBUTOR_WORDS)), said("IC", "Matched individual contributor title keyword."))
        .when(F.size(words) >= 2, said("IC", "No executive or people-management signals found."))
        .otherwise(said("UNKNOWN", "Not enough title signal to classify."))
    )


# ---- Fixed values: pay patterns ----
_SIGN = r"(?:US\$|CA\$|\$|£|€|USD|CAD|GBP|EUR)"
_AMOUNT = r"\d[\d,]*(?:\.\d{1,2})?\s*[kK]?"
_UPTO = rf"(?:\s*(?:-|to|–|—)\s*(?:{_SIGN}\s*)?{_AMOUNT}(?:\s*(?:usd|cad|gbp|eur|dollars?))?)?(?:\s*(?:/|per)?\s*(?:hour|hr|year|yr|annually|annual|month|monthly|week|weekly))?"
PAY_NAMED = rf"(?i)\b(?:pay range|salary range|compensation|starting at|up to|salary|pay|wage|hourly rate|annual rate)\b[^.;\n\r]{{0,40}}?(?:{_SIGN}\s*)?{_AMOUNT}(?:\s*(?:usd|cad|gbp|eur|dollars?))?{_UPTO}"
PAY_SIGNED = rf"(?i)(?:{_SIGN}\s*{_AMOUNT}|{_AMOUNT}\s*(?:USD|CAD|GBP|EUR|dollars?)){_UPTO}"
PAY_NUMBER = r"(?i)(?<![\d.])\$?\s?(\d[\d,]*(?:\.\d{1,2})?)\s*(k)?"


def once(x: Column, body: Callable[[Column], Column]) -> Column:
    """body of x, which is evaluated once; a plain lambda would evaluate it anew wherever it stands."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def pay_numbers(c: Column) -> Column:
    """The amounts in order, thousands for k, halves to even."""
    found, thousands = (F.regexp_extract_all(c, F.lit(PAY_NUMBER), F.lit(g)) for g in (1, 2))
    return F.zip_with(found, thousands, lambda n, k: N.half_even(F.regexp_replace(n, ",", "").try_cast("double") * F.when(k != "", 1000.0).otherwise(1.0)))


def pay_period(c: Column) -> Column:
    return _pay_period(F.lower(c), F.array_max(pay_numbers(c)))


def _pay_period(low: Column, top: Column) -> Column:
    return (
        F.when(low.rlike("hour|/hr| hr|per hr"), "hourly").when(low.rlike("annual|year|/yr"), "annual").when(low.contains("month"), "monthly").when(low.contains("week"), "weekly")
        .when(top <= 300, "hourly").when(top >= 1000, "annual").otherwise("unknown")
    )


def currency(c: Column) -> Column:
    up = F.upper(c)
    return F.when(up.rlike(r"CAD|CA\$"), "CAD").when(up.rlike("GBP|£"), "GBP").when(up.rlike("EUR|€"), "EUR").otherwise("USD")


#: One of these, in lower case, and a digit stand in every text that names pay: they spare most texts the patterns.
PAY_MARKS = ("$", "£", "€", "usd", "cad", "gbp", "eur", "dollar", "pay", "salary", "compensation", "starting", "up", "wage", "hourly", "annual")


def pay(c: Column | str) -> Column:
    """struct(low, high, text, period, currency, source): the first pay named in a text, nulls and blanks if none is plausible."""
    none = _pay_struct(F.lit(None), F.lit(None), F.lit(""), F.lit("unknown"), F.lit("USD"), F.lit(""))
    marked = T.blank(c).rlike("[0-9]") & once(F.lower(T.blank(c)), lambda low: T.contains_any(low, PAY_MARKS))
    return F.when(marked, once(T.squash(c), lambda value: once(_pay_found(value), lambda f: _pay_of(value, f)))).otherwise(none)


def _pay_struct(*fields: Column) -> Column:
    names, kinds = ("low", "high", "text", "period", "currency", "source"), ("bigint", "bigint", "string", "string", "string", "string")
    return F.struct(*(f.cast(k).alias(n) for f, n, k in zip(fields, names, kinds)))


def _pay_found(value: Column) -> Column:
    of = lambda raw, by_name: F.struct(raw.alias("raw"), F.btrim(raw, F.lit(" .;,")).alias("shown"), by_name.alias("by_name"))
    signed = once(F.regexp_extract(value, PAY_SIGNED, 0), lambda raw: of(raw, F.lit(False)))
    return once(F.regexp_extract(value, PAY_NAMED, 0), lambda raw: F.when(raw != "", of(raw, F.lit(True))).otherwise(signed))


def _pay_of(value: Column, f: Column) -> Column:
    """What was found, its amounts, period and verdict each worked out once."""
    shown = f.getField("shown")

    def judged(amounts: Column) -> Column:
        top = F.array_max(amounts)
        return once(_pay_period(F.lower(shown), top), lambda per: once(~_pay_refused(value, f, top, per), lambda sound: _pay_shown(f, amounts, per, sound)))

    return once(pay_numbers(shown), judged)


def _pay_refused(value: Column, f: Column, top: Column, per: Column) -> Column:
    raw, shown, by_name = (f.getField(x) for x in ("raw", "shown", "by_name"))
    signless = ~shown.rlike(f"(?i){_SIGN}")
    after = F.substring(value, F.position(raw, value) + F.length(raw), F.lit(24))
    refused = (
        (signless & (after.rlike(r"(?i)^\s*\(\s*k\s*\)") | shown.rlike(r"(?i)\b401\s*k\b")))
        | by_name & ((per == "annual") & (top < 10_000) | (per == "monthly") & (top < 500) | (per == "weekly") & (top < 100) | (per == "hourly") & ~top.between(5, 500) | signless & (per == "unknown") & (top < 1_000))
    )
    return F.coalesce(refused, F.lit(False))


def _pay_shown(f: Column, amounts: Column, per: Column, sound: Column) -> Column:
    shown, two = f.getField("shown"), F.size(amounts) >= 2
    ok = (f.getField("raw") != "") & (F.size(amounts) > 0) & sound
    return _pay_struct(
        F.when(ok, F.when(two, F.array_min(amounts)).otherwise(F.get(amounts, F.lit(0)))), F.when(ok & two, F.array_max(amounts)), F.when(ok, shown).otherwise(""),
        F.when(ok, per).otherwise("unknown"), F.when(ok, currency(shown)).otherwise("USD"), F.when(ok, F.when(f.getField("by_name"), "context").otherwise("currency")).otherwise(""),
    )


#: Units of schema.org pay. Fixed values.
UNITS = {"HOUR": "hourly", "YEAR": "annual", "MONTH": "monthly", "WEEK": "weekly"}


def structured_pay(salary: Column | str) -> Column:
    """Pay of a schema.org baseSalary (VARIANT): minValue, maxValue or value, unitText and currency."""
    v = T.col(salary)
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    unit = F.upper(F.coalesce(get("$.value.unitText", "string"), get("$.unitText", "string"), F.lit("")))
    per = F.lit("unknown")
    for k, name in UNITS.items():
        per = F.when(unit == k, name).otherwise(per)
    low = F.coalesce(get("$.value.minValue", "double"), get("$.value.value", "double"), get("$.value", "double"))
    return F.struct(N.half_even(low).alias("low"), N.half_even(get("$.value.maxValue", "double")).alias("high"), per.alias("period"), F.coalesce(get("$.currency", "string"), get("$.value.currency", "string"), F.lit("USD")).alias("currency"))


def work_type(text: Column | str, order: tuple[str, ...] = ("remote", "hybrid", "onsite"), remote_flag: Column | None = None) -> Column:
    """Remote, Hybrid, Onsite or Not Listed. Sources differ in what they look for first (order), and some carry a flag."""
    low = F.lower(T.blank(text))
    tests = {"remote": low.rlike("remote|work from home|telecommut"), "hybrid": low.contains("hybrid"), "onsite": low.rlike(r"on-?site|on site|in-?office|in person")}
    out = F.lit("Not Listed")
    for k in reversed(order):
        out = F.when(tests[k], k.capitalize()).otherwise(out)
    return out if remote_flag is None else F.when(F.coalesce(remote_flag, F.lit(False)), "Remote").otherwise(out)


#: Which test each source makes first. Fixed values.
WORK_TYPE_ORDER = {"csod": ("hybrid", "remote", "onsite"), "clearcompany": ("hybrid", "remote", "onsite"), "paylocity": ("hybrid", "remote", "onsite")}

# ---- Fixed values: destinations that are no posting ----
SCHEMES = ("mailto", "tel", "sms", "javascript", "callto", "fax")
SOCIAL_HOSTS = (
    "facebook.com", "twitter.com", "x.com", "linkedin.com", "instagram.com", "youtube.com", "youtu.be", "tiktok.com", "pinterest.com", "threads.net", "snapchat.com", "reddit.com", "nextdoor.com", "yelp.com",
    "glassdoor.com", "indeed.com", "ziprecruiter.com", "simplyhired.com", "monster.com", "careerbuilder.com",
)
SEGMENT_REASONS = {
    "account/product application link": (
        "open-an-account", "openanaccount", "open-account", "openaccount", "account-opening", "apply-for-a-loan", "apply-for-loan", "loan-application", "mortgage-application",
        "card-application", "switch-kit",
    ),
    "branch/ATM link": (
        "location", "locations", "branch", "branches", "atm", "atms", "branch-locator", "locator", "find-a-branch", "find-a-location", "find-an-atm", "hours", "directions",
    ),
    "login/registration link": (
        "login", "log-in", "signin", "sign-in", "signon", "sign-on", "logon", "logout", "sign-out", "register", "registration", "enroll", "enrollment", "password", "forgot-password",
        "reset-password", "online-banking", "onlinebanking", "mobile-banking", "account-login",
    ),
    "contact/email link": (
        "contact", "contact-us", "contactus", "email-us", "feedback", "appointment", "schedule-appointment", "book-appointment",
    ),
    "privacy/legal/accessibility page link": (
        "privacy", "privacy-policy", "privacy-notice", "legal", "terms", "terms-of-use", "terms-and-conditions", "disclosure", "disclosures", "disclaimer", "accessibility", "sitemap",
        "site-map", "cookies", "cookie-policy", "security", "fraud", "patriot-act", "esign", "eeo", "equal-opportunity",
    ),
    "marketing/product page link": (
        "rates", "products", "personal", "business", "commercial", "checking", "savings", "loans", "mortgage", "mortgages", "credit-cards", "creditcards", "insurance", "investments", "wealth",
        "promotions", "offers", "calculators", "financial-education", "resources", "news", "newsroom", "press", "blog", "events", "community", "about", "about-us", "aboutus", "history",
        "leadership", "board-of-directors", "testimonials", "faq", "faqs", "help", "support",
    ),
}


def destination_reason(target: Column | str, page_url: Column | str | None = None) -> Column:
    """Why a link is no posting; '' if nothing speaks against it. Segments of a careers area outrank all others."""
    value = F.trim(T.blank(target))
    scheme = F.lower(F.regexp_extract(value, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    absolute = value.contains("://")
    h = F.when(absolute, U.host(value)).otherwise("")
    route = F.when(absolute, U.path(value)).otherwise(F.regexp_extract(value, "^([^?#]*)", 1))
    parts = F.filter(F.transform(F.split(route, "/"), lambda s: F.regexp_replace(F.lower(F.trim(s)), r"\.(html?|aspx?|php|jsp|cfm)$", "")), lambda s: s != "")
    social = F.lit(None).cast("string")
    for s in reversed(SOCIAL_HOSTS):
        social = F.when(U.in_domain(h, s), F.lit(f"social/aggregator link ({s})")).otherwise(social)
    reasons = F.create_map(*(F.lit(x) for why, words in SEGMENT_REASONS.items() for w in words for x in (w, why)))
    named = F.filter(F.transform(parts, lambda s: F.try_element_at(reasons, s)), lambda x: x.isNotNull())
    away = F.lit(False) if page_url is None else (h != "") & (U.host(page_url) != "") & (h != U.host(page_url))
    return (
        F.when(value == "", "").when(value.startswith("#"), "in-page anchor, not a posting URL").when(scheme.isin(*SCHEMES), F.concat(scheme, F.lit(": link, not a posting URL"))).when(social.isNotNull(), social)
        .when(F.size(parts) == 0, F.when(away, "").otherwise("site root, not a posting URL")).when(F.exists(parts, lambda s: s.isin(*U.CAREER_SEGMENTS)), "").otherwise(F.coalesce(F.get(named, F.lit(0)), F.lit("")))
    )


# ---- Fixed values: texts that are no title ----
CALLS_TO_ACTION = (
    "open an account", "open your account", "find a branch", "find an atm", "branch locator", "atm locator", "locations & hours", "locations and hours", "contact us", "email us", "call us", "apply for a loan",
    "get started", "get pre-approved", "schedule an appointment", "make an appointment", "routing number", "online banking", "mobile banking", "enroll now", "make a payment", "view rates", "compare rates",
    "download the app", "see all locations", "switch to", "join now", "become a member", "refer a friend", "sign up for", "follow us", "read our blog", "watch the video",
)
ERROR_PHRASES = (
    "still building this path", "page not found", "page cannot be found", "page you requested", "page you are looking for", "page you're looking for", "404 error", "error 404", "under construction", "coming soon",
    "temporarily unavailable", "no longer available", "we couldn't find", "we could not find", "oops", "whoops", "something went wrong", "access denied", "check back soon",
)
SENTENCE = r"(?i)\b(?:we're|we are|we've|we have|you'll|you will|you can|let's|our team is|thanks for|sorry|please try|click here)\b"


def text_reason(c: Column | str) -> Column:
    """Why a text is page furniture and no title; '' if nothing speaks against it."""
    v = T.squash(c)
    error, action = T.longest_phrase(v, ERROR_PHRASES), T.longest_phrase(v, CALLS_TO_ACTION)
    return (
        F.when(v == "", "").when(v.rlike(r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$"), "email address, not a job title").when(v.rlike(r"(?i)^(?:https?://|www\.)\S+$"), "bare URL, not a job title")
        .when(v.rlike(r"^[-+().\s\d]{7,}$") & v.rlike(r"\d"), "phone number, not a job title").when(error != "", F.concat(F.lit('error/placeholder page text ("'), error, F.lit('")')))
        .when(action != "", F.concat(F.lit('marketing call to action ("'), action, F.lit('")'))).when(v.rlike(SENTENCE), "marketing sentence, not a job title").otherwise("")
    )


def soft_404(c: Column | str) -> Column:
    """The error phrase in the first 800 characters of a page's visible text; ''."""
    return T.longest_phrase(F.substring(T.squash(c), 1, 800), ERROR_PHRASES)


#: What marks posting metadata. Fixed values.
METADATA_LABELS = (
    r"(?i)\b(location|locations|department|division|business unit|job type|employment type|job category|category|schedule|shift|hours|status|posted|date posted|posting date|closing date|apply by|salary|pay|"
    r"pay range|pay rate|compensation|wage|rate of pay|req(?:uisition)?\s*(?:#|no\.?|number|id)|job\s*(?:#|no\.?|number|id)|fte|reports to)\s*[:\-–]"
)
EMPLOYMENT_TYPES = r"(?i)\b(?:full[\s-]?time|part[\s-]?time|temporary|seasonal|internship|intern|per[\s-]diem|contract|contingent|casual|exempt|non[\s-]?exempt|hourly|salaried)\b"
CITY_STATE = r"\b[A-Z][A-Za-z.'-]+(?:\s+[A-Z][A-Za-z.'-]+)*,\s*(?:[A-Z]{2}\b|[A-Z][a-z]+\b)"
PUBLISHED_PAY = (
    r"(?i)\$\s?\d[\d,]*(?:\.\d{2})?\s*(?:-|to|–)?\s*(?:\$\s?\d[\d,]*(?:\.\d{2})?)?\s*(?:per\s+(?:hour|hr|year|yr|week|month)|/\s*(?:hour|hr|year|yr)|annually|hourly)"
)


def metadata_signals(c: Column | str) -> Column:
    """Which posting metadata a text shows."""
    v = T.squash(c)
    return F.array_compact(F.array(
        F.when(v.rlike(METADATA_LABELS), F.concat(F.lit("labelled metadata ("), F.lower(F.regexp_extract(v, METADATA_LABELS, 1)), F.lit(")"))),
        F.when(v.rlike(EMPLOYMENT_TYPES), "employment type"), F.when(v.rlike(CITY_STATE), "city/state location"), F.when(v.rlike(PUBLISHED_PAY), "published pay"),
    ))


BENEFITS = ("401(k)", "health insurance", "dental", "vision", "life insurance", "paid time off", "tuition", "bonus", "parental leave", "remote")


def benefit_terms(c: Column | str) -> Column:
    low = F.lower(T.squash(c))
    return F.array_compact(F.array(*(F.when(low.contains(b), F.lit(b)) for b in BENEFITS)))


def evidence(
    title: Column, target: Column, chrome: Column, in_list: Column, signals: Column, structured: Column, page_url: Column | None = None, document: Column | None = None, careers: Column | None = None
) -> Column:
    """struct(accepted, reason): the verdict on a candidate. Against: page chrome, text, destination. For: structured data, a vendor's
    posting URL or a requisition id; then a list with metadata; then a posting's slug in a list, or with metadata on a careers page;
    then a job description document in a list or on a careers page."""
    said = lambda ok, why: F.struct(F.lit(ok).alias("accepted"), (why if isinstance(why, Column) else F.lit(why)).alias("reason"))
    document, careers = (F.lit(False) if x is None else x for x in (document, careers))
    facts = {
        "chrome": chrome, "text": text_reason(title), "place": destination_reason(target, page_url), "vendor": U.detail_vendor(target), "id": U.requisition(target), "slug": U.posting_slug(target) != "",
        "structured": structured, "in_list": in_list, "known": F.size(signals) > 0, "document": document, "careers": careers,
    }

    def verdict(x: Column) -> Column:
        f = {k: x.getField(k) for k in facts}
        missing = F.concat_ws(", ", F.when(~f["in_list"], F.lit("job list")), F.when(~f["known"], F.lit("posting metadata")), F.lit("requisition id"))
        return (
            F.when(f["chrome"] != "", said(False, f["chrome"])).when(f["text"] != "", said(False, f["text"])).when(f["place"] != "", said(False, f["place"]))
            .when(f["structured"], said(True, "structured posting data")).when(f["vendor"] != "", said(True, F.concat(f["vendor"], F.lit(" posting URL")))).when(f["id"] != "", said(True, "requisition id in the URL"))
            .when(f["in_list"] & f["known"], said(True, "job list with posting metadata")).when(f["slug"] & f["in_list"], said(True, "posting slug in a job list"))
            .when(f["slug"] & f["known"] & f["careers"], said(True, "posting slug with metadata on a careers page")).when(f["document"] & (f["in_list"] | f["careers"]), said(True, "job description document"))
            .otherwise(said(False, F.concat(F.lit("missing evidence: "), missing)))
        )

    return F.get(F.transform(F.array(F.struct(*(c.alias(k) for k, c in facts.items()))), verdict), F.lit(0))  # each fact is found once


#: Routing of a source to its collector, tried in order: parts of the URL, parts of the platform's name. The last takes the rest. Fixed values.
ROUTES = (
    ("ADP", ("workforcenow.adp.com",), ()), ("ApplicantPro", ("applicantpro.com",), ()), ("isolved Hire", ("isolvedhire.com",), ()), ("ClearCompany", ("hrmdirect.com",), ()),
    ("Dayforce", ("jobs.dayforcehcm.com",), ("dayforce",)), ("Cornerstone", ("csod.com",), ("cornerstone", "csod")), ("Workday", ("myworkdayjobs.com",), ("workday",)), ("Greenhouse", ("greenhouse.io",), ("greenhouse",)),
    ("Lever", ("lever.co",), ("lever",)), ("ICIMS", ("icims.com",), ("icims",)), ("Paylocity", ("paylocity.com",), ("paylocity",)), ("Paycor", ("recruitingbypaycor.com",), ("paycor",)),
    ("Paycom", ("paycomonline.net",), ("paycom",)), ("UKG Ready", ("saashr.com",), ("ukg ready",)), ("UKG", ("ultipro.com", "ukg.com"), ("ukg",)),
)


def collector(board_url: Column | str, platform_name: Column | str) -> Column:
    """Who collects a board. The platform that its URL shows outranks the stored name, which counts only where the URL shows none; three vendors
    go by the URL alone, and ADP by a URL that names its tenant, or by its name where another page holds the board."""
    u, shown = F.lower(T.blank(board_url)), F.lower(U.platform(board_url))
    p = F.when(shown != "", shown).otherwise(F.lower(T.blank(platform_name)))
    out = F.lit("Generic")
    for name, urls, names in reversed(ROUTES[1:]):
        test = T.contains_any(u, urls)
        out = F.when(test | T.contains_any(p, names) if names else test, name).otherwise(out)
    own = u.contains(ROUTES[0][1][0])
    return F.when(own & u.contains("cid=") & u.contains("ccid=") | ~own & (F.trim(p) == "adp workforce now"), ROUTES[0][0]).otherwise(out)


def match_label(score: Column) -> Column:
    return F.when(score.isNull(), "Not Matched").when(score >= 80, "Strong Match").when(score >= 60, "Good Match").when(score >= 40, "Moderate Match").otherwise("Low Match")


# ---- Fixed values: keywords that are always looked for ----
TRACKED = (
    "active directory", "automation", "azure", "banking", "cloud", "compliance", "credit union", "cybersecurity", "database", "excel", "financial services", "fiserv", "help desk", "infrastructure", "jack henry",
    "kubernetes", "leadership", "linux", "microsoft 365", "networking", "operations", "powershell", "project management", "risk", "security", "sql", "symitar", "terraform", "vendor management", "virtualization", "windows server",
)


def keywords(normal: Column) -> Column:
    """Tracked keywords in the text, then its first 30 meaningful words; distinct, in order."""
    tracked = F.filter(F.array(*map(F.lit, TRACKED)), lambda k: normal.contains(k))
    return F.array_distinct(F.concat(tracked, F.slice(T.meaningful_words(normal), 1, 30)))


def match(resume: Column, title: Column | str, text: Column | str, work: Column | str) -> Column:
    """struct(score, matched, missing, label) of one posting against a resume (match_text form).

    60 points by share of keywords, 25 by share of title words, 10 for stated years of experience, 5 for remote else 2; rounded half to even, at most 100.
    """
    once = lambda x, body: F.get(F.transform(F.array(x), body), F.lit(0))  # noqa: E731  a lambda would evaluate x anew for each element
    normal = T.match_text(F.concat_ws(" ", T.blank(title), T.blank(text)))
    return once(normal, lambda n: once(keywords(n), lambda kw: once(T.meaningful_words(T.match_text(title)), lambda words: _scored(resume, kw, words, F.lower(T.blank(work))))))


def _scored(resume: Column, kw: Column, words: Column, work: Column) -> Column:
    hit = F.filter(kw, lambda k: resume.contains(k))
    terms = F.filter(words, lambda w: resume.contains(w))
    share = lambda a, b, points: F.when(F.size(b) == 0, 0.0).otherwise(F.size(a) / F.nullif(F.size(b), F.lit(0)) * points)
    years = F.when(resume.rlike(r"\b(?:[3-9]|1\d)\+?\s+years?\b"), 10.0).otherwise(0.0)
    place = F.when((work == "remote") | resume.contains("remote"), 5.0).otherwise(2.0)
    score = F.least(F.lit(100), N.half_even(share(hit, kw, 60) + share(terms, words, 25) + years + place))
    return F.struct(score.alias("score"), hit.alias("matched"), F.slice(F.filter(kw, lambda k: ~resume.contains(k)), 1, 12).alias("missing"), match_label(score).alias("label"))


def fingerprint(*columns: Column | str) -> Column:
    """One hash over several texts, blanks for nulls; used to see that a stored result is stale."""
    return F.sha2(F.to_json(F.array(*(T.blank(c) for c in columns))), 256)


def match_status(result: Column, resume_version: Column, job_print: Column, algorithm: str) -> Column:
    """Not Matched, Match Failed, Needs Rematch or Matched; result: struct(status, version, fingerprint, algorithm) or null."""
    fresh = (result.getField("version") == resume_version) & (result.getField("fingerprint") == job_print) & (result.getField("algorithm") == algorithm)
    return F.when(resume_version.isNull() | result.isNull(), "Not Matched").when(~fresh, "Needs Rematch").when(result.getField("status") == "Failed", "Match Failed").otherwise("Matched")
