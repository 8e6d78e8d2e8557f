"""Text functions: Column in, Column out. Blank strings mean missing; null counts as blank.

White space, digits and word edges are Unicode-wide ((?U)), as in the data's own rules.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that the rules below leave out.
INSTITUTION_WORDS = r"(?U)\b(credit union|federal credit union|bank|national association|n\.a\.|na)\b"
IDENTITY_STOP = ("credit", "union", "federal", "bank", "national", "association", "the", "and")
MATCH_STOP = (
    "about", "ability", "company", "experience", "including", "position", "preferred", "required", "requirements",
    "responsibilities", "skills", "strong", "their", "there", "these", "those", "through", "using", "with", "years", "your",
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c: Column | str) -> Column:
    """The string, '' for null."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def squash(c: Column | str) -> Column:
    """Runs of white space to one space, trimmed."""
    return F.trim(F.regexp_replace(blank(c), r"(?U)\s+", " "))


def match_text(c: Column | str) -> Column:
    """Lower case, only a-z 0-9 + . # - and single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(blank(c)), r"[^a-z0-9+.#\s-]", " "), r"\s+", " "))


def slug(c: Column | str) -> Column:
    """Letters and digits of any script, other runs as one hyphen; 'unknown' if none."""
    s = F.regexp_replace(F.regexp_replace(F.lower(blank(c)), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "unknown").otherwise(s)


def job_title(c: Column | str) -> Column:
    """Squashed, without a leading 'title:' label, at most 180 characters."""
    return F.substring(F.regexp_replace(squash(c), r"(?i)^(job title|title)\s*[:\-]\s*", ""), 1, 180)


def name_key(c: Column | str) -> Column:
    """What names are compared by: squashed, lower case."""
    return F.lower(squash(c))


def domain_name(c: Column | str) -> Column:
    """A company name as it may stand in a domain: no institution words, only a-z 0-9."""
    return F.regexp_replace(F.regexp_replace(F.lower(blank(c)), INSTITUTION_WORDS, ""), "[^a-z0-9]+", "")


def ascii_words(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(blank(c)), F.lit("[a-z0-9]+"), F.lit(0))


def identity_tokens(c: Column | str) -> Column:
    return F.filter(ascii_words(c), lambda w: (F.length(w) >= 3) & ~w.isin(*IDENTITY_STOP))


def meaningful_words(c: Column | str) -> Column:
    """Distinct words over four characters, in order of first use, stop words left out; c is match_text."""
    return F.array_distinct(F.filter(F.split(blank(c), " "), lambda w: (F.length(w) > 4) & ~w.isin(*MATCH_STOP)))


def merge_notes(*notes: Column | str) -> Column:
    """The distinct notes of several '; ' lists, in order."""
    parts = F.flatten(F.array(*(F.split(blank(n), ";") for n in notes)))
    return F.array_join(F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")), "; ")


def description(c: Column | str) -> Column:
    """Squashed; blank under 40 characters, at most 1,500."""
    s = squash(c)
    return F.when(F.length(s) >= 40, F.substring(s, 1, 1500)).otherwise("")


def snippet(c: Column | str, n: int = 360) -> Column:
    return F.substring(squash(c), 1, n)


def operation_slug(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.trim(blank(c))), r"\s+", "-")


def safe_error(c: Column | str, fallback: str = "The operation failed.") -> Column:
    """Error text without paths, at most 240 characters."""
    s = squash(c)
    return F.when((s == "") | s.rlike(r"[\\/]"), fallback).otherwise(F.substring(s, 1, 240))


def quoted(phrase: str) -> str:
    """A phrase as a whole-word pattern: edges only where it begins or ends in a letter or digit."""
    edge = lambda ch: r"\b" if ch.isalnum() else ""
    return f"{edge(phrase[0])}\\Q{phrase}\\E{edge(phrase[-1])}"


def longest_phrase(c: Column | str, phrases: Iterable[str]) -> Column:
    """The longest of the phrases that stands in the text as whole words, lower case; '' if none. The earlier one wins a tie."""
    pattern = "(?i)" + "|".join(quoted(p) for p in sorted(set(phrases), key=lambda p: (-len(p), p)))
    hits = F.regexp_extract_all(blank(c), F.lit(pattern), F.lit(0))
    return F.lower(F.aggregate(hits, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best)))


def has_phrase(c: Column | str, phrases: Iterable[str]) -> Column:
    return blank(c).rlike("(?i)" + "|".join(quoted(p) for p in phrases))


def contains_any(c: Column | str, parts: Iterable[str]) -> Column:
    """Plain containment of any part; c is lower case already."""
    return blank(c).rlike("|".join(f"\\Q{p}\\E" for p in parts))


def title_and_location(c: Column | str) -> Column:
    """'<title> - <place> Location' taken apart."""
    s = squash(c)
    pattern = r"^(.+?)\s+-\s+(.+?)\s+Location$"
    hit = s.rlike(pattern)
    return F.struct(F.when(hit, F.regexp_extract(s, pattern, 1)).otherwise(s).alias("title"), F.when(hit, F.regexp_extract(s, pattern, 2)).otherwise("").alias("location"))


EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def recipients(c: Column | str, most: int = 50) -> Column:
    """A recipient list: split at commas, semicolons and white space, lower case, distinct; null if one is no address or there are too many."""
    found = F.array_distinct(F.filter(F.transform(F.split(blank(c), r"[,;\s]+"), F.lower), lambda x: x != ""))
    return F.when(F.forall(found, lambda x: x.rlike(EMAIL)) & (F.size(found) <= most), found)


def like_any(term: str, *columns: str) -> Column:
    """LOWER(col) LIKE '%term%' over several columns. The term's own % and _ act as wildcards, as in the search box."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(F.col(c)).like(f"%{term.lower()}%"), F.lit(False))
    return out


def name_matches(c: Column | str, filters: Iterable[str]) -> Column:
    """Case-blind containment of any filter; blank filters count for nothing; without a filter nothing matches."""
    wanted = [f.strip().lower() for f in filters if f.strip()]
    return contains_any(F.lower(blank(c)), wanted) if wanted else F.lit(False)


def safe_cell(c: Column | str) -> Column:
    """A spreadsheet cell that can't act: control characters out, formula starts and script schemes behind an apostrophe."""
    s = F.regexp_replace(blank(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return F.when(F.ltrim(s).rlike(r"^[=+\-@]") | F.ltrim(s).rlike(r"(?i)^(javascript|data|vbscript|file):"), F.concat(F.lit("'"), s)).otherwise(s)
