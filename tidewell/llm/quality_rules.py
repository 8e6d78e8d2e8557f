"""Quality rules: a threshold table compiled into one Spark projection, with no user function.

Every measure is an expression over the whole text. Arrays that several measures need are bound once with ``let``
(a lambda over a one-element array), since Spark would otherwise evaluate them anew in each lambda.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .sqltext import let

SPACE = " \t\n\x0b\x0c\r"
#: Frequent function words of the four languages, as they stand inside sentences.
STOP_WORDS = (
    "the of and to in is that it for was on with as be by at are this from or an a "
    "le la les de des et un une du en est que qui dans pour pas sur au avec par "
    "der die das und ist von zu den mit nicht ein eine sich auf im für dem als auch "
    "el los las y que en un una por con se del es no su para al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails where ``measure`` is below ``least`` or above ``most``."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: The threshold table. Ratios of documents without words are 0; base rules fail those by their length.
RULES = (
    Rule("symbols", "symbol_ratio", most=0.1),
    Rule("stop_words", "stop_ratio", least=0.04),
    Rule("word_length_low", "mean_word_length", least=2.0),
    Rule("word_length_high", "mean_word_length", most=15.0),
    Rule("exclamations", "exclamation_ratio", most=0.2),
    Rule("repeated_lines", "dup_line_ratio", most=0.5),
    Rule("stutter", "stutter_ratio", most=0.3),
)


def _repeat_words(words: Column, n: int = 8) -> Column:
    """Words inside n-word windows that occur twice or more. Windows are told apart by a 64-bit hash.

    Only documents with a repeated window pay for the second step: sort (hash, place), mark places whose neighbour has the
    same hash, and add up the stretches they cover.
    """

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.least(F.lit(n), F.coalesce(F.get(places, i + 1) - p, F.lit(n))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def marked(rows: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(rows, k).getField("h") == x.getField("h"), F.lit(False))
        # a place before the first has no neighbour: get() takes no negative index
        twice = F.filter(rows, lambda x, i: same(x, i + 1) | (F.when(i > 0, same(x, F.greatest(i - 1, F.lit(0)))).otherwise(False)))
        return F.sort_array(F.transform(twice, lambda x: x.getField("i")))

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(hashes) - (n - 1)), lambda i: F.xxhash64(F.slice(hashes, i, n)))

    def counted(keys: Column) -> Column:
        rows = F.sort_array(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("bigint")).otherwise(let(let(rows, marked), covered))

    return F.when(F.size(words) < n + 1, F.lit(0).cast("bigint")).otherwise(let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), counted))


def measures(text: Column) -> Column:
    """A struct of counts over the text; null counts as no text."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    trimmed = F.btrim(t, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
    lines = F.filter(F.split(t, "\n"), lambda line: F.btrim(line, F.lit(SPACE)) != "")
    big = lambda c: c.cast("bigint")
    of_words = let(
        words,
        lambda w: F.struct(
            big(F.size(w)).alias("n_words"),
            big(F.length(F.array_join(w, ""))).alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
            big(F.size(F.filter(w, lambda x: x.isin(STOP_WORDS)))).alias("n_stop_words"),
            big(F.size(F.filter(w, lambda x, i: x == F.get(w, i + 1)))).alias("n_stutters"),
        ),
    )
    of_lines = let(lines, lambda x: F.struct(big(F.size(x)).alias("n_lines"), big(F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    return F.struct(of_words.alias("w"), of_lines.alias("l"), big(F.regexp_count(t, F.lit("[#*$%&|<>]"))).alias("n_symbols"), big(F.regexp_count(t, F.lit("!"))).alias("n_exclamations"))


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """The names of the rules that a row of measures fails, as one array expression."""
    failed = []
    for rule in rules:
        bad = F.lit(False)
        if rule.least is not None:
            bad = bad | (F.col(rule.measure) < rule.least)
        if rule.most is not None:
            bad = bad | (F.col(rule.measure) > rule.most)
        failed.append(F.when(bad, F.lit(rule.name)))
    return F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``row`` (all columns of docs) with counts, ratios, base_failed, failed_rules and kept.

    A null or empty text has no words and fails the base rule. Repeated rows are judged alike; extra columns stay in ``row``, whatever their names. An
    empty table gives an empty one. Texts of any length are counted whole; a ratio without a divisor is 0.
    """
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    counted = docs.select(F.struct(*docs.columns).alias("row"), measures(F.col("text")).alias("m")).select("row", "m.w.*", "m.l.*", "m.n_symbols", "m.n_exclamations")
    ratios = counted.withColumns({
        "symbol_ratio": ratio("n_symbols", "n_words"), "stop_ratio": ratio("n_stop_words", "n_words"), "mean_word_length": ratio("word_chars", "n_words"),
        "exclamation_ratio": ratio("n_exclamations", "n_words"), "dup_line_ratio": ratio("n_dup_lines", "n_lines"), "stutter_ratio": ratio("n_stutters", "n_words"),
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    })
    return ratios.withColumn("failed_rules", compile_rules(rules)).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def filter_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass."""
    return judge(docs, rules).where("kept").select("row.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(shared.table(spark, sf_dir, "documents")).select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.concat_ws(",", "failed_rules").alias("failed_rules"))


_BAD = ", ".join(
    f"CASE WHEN {' OR '.join(f'{r.measure} {op} {v}' for op, v in (('<', r.least), ('>', r.most)) if v is not None)} THEN '{r.name}' END" for r in RULES
)
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
p AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM r) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(len(l) AS BIGINT) AS n_lines,
             CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(regexp_extract_all(t, '!')) AS n_exclamations,
             len(list_filter(w, lambda x: x IN ({", ".join(f"'{s}'" for s in dict.fromkeys(STOP_WORDS))}))) AS n_stop_words,
             len(list_filter(w, lambda x, i: x = w[i + 1])) AS n_stutters FROM d LEFT JOIN p USING (doc_id)),
q AS (SELECT *, coalesce(n_symbols / nullif(n_words, 0), 0) AS symbol_ratio, coalesce(n_stop_words / nullif(n_words, 0), 0) AS stop_ratio, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_length,
             coalesce(n_exclamations / nullif(n_words, 0), 0) AS exclamation_ratio, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio, coalesce(n_stutters / nullif(n_words, 0), 0) AS stutter_ratio, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
f AS (SELECT *, concat_ws(',', {_BAD}) AS failed_rules FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM f
"""
