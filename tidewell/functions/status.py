"""States and verdicts of companies, applications, matches and runs, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, squash


def _bare(c: Column | str) -> Column:
    """Trimmed, without slashes at the end."""
    return F.regexp_replace(F.trim(blank(c)), "/+$", "")


def needs_discovery(careers: Column | str, official: Column | str, known: Column | str, board: Column | str, unlikely: Column, force: bool = False) -> Column:
    """A company needs a search for its job board: it has a site to start from, and no board, an unlikely one, or its careers page in
    the board's place. ``unlikely``: the verdict on the board's URL."""
    start = (_bare(careers) != "") | (_bare(F.coalesce(F.nullif(blank(official), F.lit("")), blank(known))) != "")
    if force:
        return start
    return start & ((_bare(board) == "") | unlikely | ((_bare(careers) != "") & (_bare(board) == _bare(careers))))


def needs_refresh(search_status: Column | str, board: Column | str, method: Column | str, reachable: Column) -> Column:
    """A company's discovery is due anew; ``reachable`` counts only where nothing else speaks for it."""
    return (blank(search_status) != "Completed") | (F.trim(blank(board)) == "") | (blank(method) == "Manual Re-verification Required") | ~F.coalesce(reachable, F.lit(False))


def application_shown(applied: Column, not_interested: Column, status: Column | str, wanted: Column) -> Column:
    """Does an application pass the list's filter; null flags are false."""
    applied, away = F.coalesce(applied, F.lit(False)), F.coalesce(not_interested, F.lit(False))
    return (
        F.when(wanted == "All application statuses", True).when(wanted == "Not applied", ~applied & ~away).when(wanted == "Not interested", away)
        .when(wanted == "Applied", applied | (blank(status) == "Applied")).otherwise(blank(status) == wanted)
    )


def match_shown(company: Column | str, title: Column | str, status: Column | str, query: str, wanted: str) -> Column:
    """Search over company and title, and the match status (none counts as Not Matched)."""
    found = F.contains(F.lower(F.concat_ws(" ", blank(company), blank(title))), F.lit(query.lower()))
    return found if wanted == "All statuses" else found & (F.coalesce(F.nullif(blank(status), F.lit("")), F.lit("Not Matched")) == wanted)


def match_order(sort: str, score: Column, company: Column, title: Column) -> list[Column]:
    """The order of the match list: by company, lowest match (none is 101), else best match (none is -1)."""
    if sort == "Company":
        return [company.asc(), title.asc()]
    if sort == "Lowest match":
        return [F.coalesce(score, F.lit(101)).asc()]
    return [F.coalesce(score, F.lit(-1)).desc(), company.asc()]


def rematch_eligible(status: Column | str, *needed: Column | str) -> Column:
    """An open posting that has what a match needs."""
    out = F.lower(blank(status)) == "open"
    for c in needed:
        out = out & (blank(c) != "")
    return out


def enrichment_status(official: Column | str, careers: Column | str, confidence: Column | str, feed_found: Column) -> Column:
    site, page = blank(official) != "", blank(careers) != ""
    return F.when(site & page & blank(confidence).isin("High", "Medium"), "Completed").when(site & (page | F.coalesce(feed_found, F.lit(False))), "Partial").when(site, "Needs Review").otherwise("Failed")


def audit_status(verified: Column, rejected: Column, reason: Column | str, confidence: Column | str) -> Column:
    return (
        F.when(rejected & F.contains(blank(reason), F.lit("could not verify")), "Failed to Check").when(verified & blank(confidence).isin("High", "Medium"), "Verified")
        .when(rejected, "Likely Incorrect").otherwise("Needs Review")
    )


def audit_issue(verified: Column, reason: Column | str, notes: Column | str, careers: Column | str) -> Column:
    noted = lambda words: F.contains(blank(notes), F.lit(words))
    return (
        F.when(blank(reason) != "", blank(reason)).when(noted("company name terms not found"), "Website does not contain company name terms.")
        .when(noted("banking/credit union terms not found"), "Website does not contain bank or credit union terms.")
        .when((blank(careers) != "") & ~verified, "Careers Page URL exists but Official Website could not be verified.").when(verified, "").otherwise("Website could not be confidently verified.")
    )


def run_label(status: Column | str, running: Column) -> Column:
    """A maintenance run's result; no run at all has a null status."""
    s = F.col(status) if isinstance(status, str) else status
    return F.when(s.isNull(), "Never Run").when(F.coalesce(running, F.lit(False)), "Running").when(s == "Completed", "Success").otherwise("Failed")


def zero_doubt(url: Column | str, soft_404: Column | str, says_none: Column, unrendered: Column, list_reason: Column | str) -> Column:
    """Why a page without postings does not prove that there are none; '' where it does."""
    end = "zero-job result"
    return (
        F.when(blank(soft_404) != "", F.concat(blank(url), F.lit(' returned an error/placeholder page ("'), blank(soft_404), F.lit(f'"); refusing to record an authoritative {end}.')))
        .when(says_none, "").when(unrendered, F.concat(blank(url), F.lit(f" loaded but rendered no listing content (single-page-app shell); refusing to record an authoritative {end}.")))
        .when(blank(list_reason) == "", F.concat(blank(url), F.lit(f" rendered no recognizable job-list structure and did not state that there are no openings; the {end} is uncertain and is not authoritative.")))
        .otherwise("")
    )


def city_state(c: Column | str) -> Column:
    """The first "City, ST" of a text; ''."""
    return squash(F.regexp_extract(blank(c), r"([A-Za-z .'-]+,\s*[A-Z]{2})\b", 1))


def json_strings(c: Column | str) -> Column:
    """The strings of a JSON list; anything else is the empty list."""
    v = F.try_parse_json(F.coalesce(F.nullif(blank(c), F.lit("")), F.lit("[]")))
    items = F.try_variant_get(v, "$", "array<variant>")
    kept = F.filter(items, lambda x: F.schema_of_variant(x) == "STRING")
    return F.coalesce(F.transform(kept, lambda x: F.try_variant_get(x, "$", "string")), F.array().cast("array<string>"))


def page_numbers(current: Column, count: Column) -> Column:
    """The page numbers that a pager shows: all up to seven; else the ends, the neighbours, and four at an end that is near."""
    near = lambda test, pages: F.when(test, F.array(*pages)).otherwise(F.array().cast("array<int>"))
    some = F.concat(F.array(F.lit(1), count, current - 1, current, current + 1), near(current <= 3, [F.lit(2), F.lit(3), F.lit(4)]), near(current >= count - 2, [count - 1, count - 2, count - 3]))
    return F.when(count <= 0, F.array().cast("array<int>")).when(count <= 7, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.sort_array(F.array_distinct(F.filter(some, lambda p: (p >= 1) & (p <= count)))))
