"""Surrogates: coreference of names, leaks, exhausted shapes, scans, edge cases, and a brute-force replacer for plain types."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidewell.llm import shared, surrogates


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")


def replaced(spark, *texts, key="k"):
    return {r.doc_id: (r.text, r.n_entities) for r in surrogates.replace_entities(docs(spark, *texts), key).select("row.doc_id", "text", "n_entities").collect()}


def test_one_person_in_all_forms(spark):
    got = replaced(spark, "Mr. John Smith came. Mr. Smith left. John Smith wrote. Smith's letter; John signed.", "Dr. John Smith, Mrs. Smith and Blacksmith")
    text, n = got[0]
    assert n == 5 and "John" not in text and "Smith" not in text
    given, last = re.match(r"Mr\. (\S+) (\S+) came\.", text).groups()
    assert text == f"Mr. {given} {last} came. Mr. {last} left. {given} {last} wrote. {last}'s letter; {given} signed."
    assert given in surrogates.MALE and got[1] == (f"Dr. {given} {last}, Mrs. {last} and Blacksmith", 2)


def test_names_behind_given_names_and_double_titles(spark):
    got = replaced(spark, "Anna Weber and Frau Prof. Dr. Lena-Marie Groß met; Weber spoke", "anna weber, Annabel Weber, The Times")
    text, n = got[0]
    last = re.search(r"; (\S+) spoke", text)[1]
    assert n == 3 and re.fullmatch(rf"[A-Z]\w+ {last} and Frau Prof\. Dr\. [\w-]+ \w+ met; {last} spoke", text)
    assert not re.search("Anna|Weber|Groß|Lena-Marie", text) and got[1][1] == 0


def test_persons_of_one_surname_stay_apart(spark):
    names = [f"Mr. {a}{b} Lee" for a in "ABCDEFGHIJ" for b in ("an", "ob", "ix", "ur")]  # twice the pool
    got = replaced(spark, *names)
    assert len({t for t, _ in got.values()}) == len(names) and not {t for t, _ in got.values()} & set(names)


def test_full_shapes_are_widened(spark):
    real = [f"{a}{b}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    rows = surrogates.assign(spark.createDataFrame([("surname", r) for r in real], "kind string, norm string"), "k").collect()
    drawn = {r.drawn for r in rows}
    assert len(rows) == len(drawn) == len(real) and not drawn & set(real)


def test_plain_types_against_brute_force(spark):
    """Python's own search over the same patterns, with the surrogates read from the result of one mention each."""
    found = ["10.20.30.40", "a.b@c-d.org", "555-12-3456", "+49 30 1234567", "4111 1111 1111 1111", "(544) 555-8128"]
    alone = dict(zip(found, (text for _, (text, _) in sorted(replaced(spark, *found).items()))))
    texts = [" / ".join(found), ",".join(reversed(found)), "x10.20.30.40 10.20.30.40.5 nothing", "a.b@c-d.org.a.b@c-d.org", "née " + found[2] + "é " + found[2]]
    patterns = [re.compile(p.replace(r"\p{L}", r"^\W\d_").replace("[^\\W\\d_\\p{N}", "[\\w").replace(r"\p{N}", r"\d").replace(r"\G|", "")) for k, p in surrogates.TYPES if k in ("ip", "ssn")]
    got = replaced(spark, *texts)
    assert got[0][0] == " / ".join(alone[m] for m in found) and got[1][0] == ",".join(alone[m] for m in reversed(found))
    assert got[2] == ("x10.20.30.40 10.20.30.40.5 nothing", 0) and not any(p.search(texts[2]) for p in patterns)
    assert "a.b@c" not in got[3][0] and got[4][0] == f"née {found[2]}é {alone[found[2]]}"


def test_long_runs_take_linear_time(spark):
    got = replaced(spark, "x" * 2_000_000, "日" * 300_000 + "@", "1." * 200_000)
    assert [n for _, n in got.values()] == [0, 0, 0]


def test_at_most_two_scans(spark, tmp_path):
    """All texts are scanned once, those with a mention once more (for extract and split)."""
    df = docs(spark, "call 555-123-4567", "none")
    plans = []
    kept = shared.stored

    def stored(d, name, *more):
        plans.append((name, d._jdf.queryExecution().optimizedPlan().toString()))
        return kept(d, name, *more)

    shared.stored = stored
    try:
        out = surrogates.replace_entities(df, "k")
    finally:
        shared.stored = kept
    scans = {name: plan.count("regexp_extract_all(text") for name, plan in plans}
    assert scans["seen"] == 1 and scans["held"] == 1 and sum(scans.values()) == 2
    assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(shared, "ROWS_A_KEY", 2)  # hot keys are split
    rows = [(1, "Mr. Jon Doe", "x"), (1, "Mr. Jon Doe", "x"), (None, "Mr. Jon Doe", None), (2, None, "x"), (3, "", "x"), *((k, "Mr. Jon Doe", "y") for k in range(10, 30))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, said string").withColumns({c: F.lit("c") for c in ("tk", "row", "names", "mentions", "pieces", "copies", "drawn", "salt", "kind")})
    got = surrogates.replace_entities(df, "k")
    assert got.select("row.*").columns == [c for c in df.columns if c != "text"]
    texts = [r.text for r in got.collect()]
    assert len(texts) == len(rows) and texts.count(None) == 1 and texts.count("") == 1 and len({t for t in texts if t}) == 1 and "Doe" not in str(texts)
    assert surrogates.replace_entities(df.limit(0), "k").count() == 0
    assert surrogates.replace_entities(df.select("text"), "k").count() == len(rows)


def test_key_is_of_the_session(spark):
    spark.conf.unset(surrogates.KEY_SETTING)
    a = replaced(spark, "mail a.b@c.org", key=None)
    drawn = spark.conf.get(surrogates.KEY_SETTING)
    assert a == replaced(spark, "mail a.b@c.org", key=drawn) and surrogates.secret_key(spark) == drawn
    spark.conf.unset(surrogates.KEY_SETTING)
    assert surrogates.secret_key(spark) != drawn


def test_what_stays(spark):
    texts = ["The Lancet. Mr. and Mrs. arrived", "version 1.2.3 of 2024-01-15", "mrs. smith"]
    assert list(replaced(spark, *texts).values()) == [(t, 0) for t in texts]


def test_grammar_of_names(spark):
    texts = [
        "Contact Jane Miller, or Mary Jones at the desk. Robert Brown called.", "Mrs. O'Brien and Ms. McDonald met Mr. van Dyke. Mr. SMITH and Dr. J. R. Tolkin left.", "Mr. Tom Keller called.", "We met Tom Keller again, and Keller paid.",
        "Yesterday Tom Keller said that Ulla Brandt agreed; Zoltan Kovacs wrote to Brandt.", "Tom Sawyer and The Keller Group stay. New York, Public License.",
    ]
    got = replaced(spark, *texts)
    for k, names in enumerate(("Jane Miller Mary Jones Robert Brown", "O'Brien McDonald Dyke SMITH Tolkin", "Tom Keller", "Tom Keller", "Tom Keller Ulla Brandt Zoltan Kovacs")):
        assert not [n for n in names.split() if re.search(rf"\b{n}\b", got[k][0])], got[k]
    assert got[5] == (texts[5], 0) and got[1][0].count("van ") == 1 and re.search(r"Mr\. [A-Z]{5} and Dr\.", got[1][0])
    one, two = re.match(r"Mr\. (\S+ \S+) called", got[2][0])[1], re.match(r"We met (\S+ \S+) again, and (\S+) paid", got[3][0])
    assert one == two[1] and one.endswith(two[2]) and f"Yesterday {one} said" in got[4][0]  # one person in all texts
    assert all(re.search("[aeiouy]", w.lower()) for w in one.split())


def test_planted_names_outside_the_lists(spark):
    import random

    rng = random.Random(9)
    syllables = ["ka", "ro", "mi", "ten", "vul", "sha", "bri", "don", "lex", "qui", "fe", "zor"]
    name = lambda: "".join(rng.choices(syllables, k=rng.randrange(2, 4))).capitalize()
    planted = [(name(), name()) for _ in range(600)]
    frames = ["We saw Mr. {} {} there.", "Frau {} {} kam.", "The letter was signed {} {} in haste.", "Then {} {} called us back.", "Dear {} {}, thank you.", "In the end {} {} agreed to pay.", "Contact {} {} for more.", "Later {} {} wrote again."]
    texts = [frames[k % len(frames)].format(*p) for k, p in enumerate(planted)]
    known = {g for g in surrogates.FEMALE + surrogates.MALE}
    got = replaced(spark, *texts)
    gone = [not re.search(rf"\b{g} {s}\b", got[k][0]) for k, (g, s) in enumerate(planted)]
    assert not known & {g for g, _ in planted} and sum(gone) / len(gone) >= 0.9
    plain = ["".join(rng.choices(syllables, k=3)).capitalize() + " and so on. The end of it." for _ in range(50)]
    assert all(n == 0 for _, n in replaced(spark, *plain).values())


def test_account_numbers(spark):
    def remainder(x):
        x = x.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97

    text, n = replaced(spark, "Pay DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432, not DE88 3704 0044 0532 0130 00; AB12CDEF34567890")[0]
    found = re.findall(r"(?:DE|GB)\d\d(?: ?[A-Z0-9]{4})+(?: ?[A-Z0-9]{1,3})?", text)
    assert n == 2 and "DE88 3704 0044 0532 0130 00; AB12CDEF34567890" in text and "3704 0044 0532 0130 00 or" not in text and "WEST" not in text
    assert [remainder(x) for x in found[:2]] == [1, 1] and re.match(r"DE\d\d( \d{4}){4} \d\d$", found[0]) and re.match(r"GB\d\d[A-Z]{4}\d{14}$", found[1])


def test_patterns_of_any_length_need_no_stack(spark):
    """Runs of capital words, titles, labels of a domain and capitals with hyphens by the ten thousand; the engine's own stack overflowed at some thousand."""
    n = 30_000
    for text in ("Johanna Miller " * n, "Word " * n, "Mr. " + "Dr " * n, "Mr. " + "Dr. " * n, "a@b" + ".com" * n, "Mr. AA" + "'BB" * n):
        matcher = spark._jvm.java.util.regex.Pattern.compile(surrogates.SCAN).matcher(text)  # in the driver's JVM, which an overflow does not end as it ends an executor
        assert matcher.results().count() >= 1, text[:20]
