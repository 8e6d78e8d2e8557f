"""Personal data replaced by keyed surrogates, in DataFrame operations only.

Every detected entity gets a surrogate of its own type and shape: digits for digits in the same layout, letters for letters of
the same case and script, a given name of the same gender, a card number with a valid check digit, an address with
valid octets. The surrogate depends on the key, the type and the entity's normal form, so one entity has one surrogate
in the whole corpus. Surrogates that two entities share, or that equal a real entity, are drawn again until none is left; a
shape without free values is widened by a letter or digit after every ``WIDEN`` draws, so drawing always ends.

Names are two entities: the surname, and the given name within its surname. A name that stands behind a title (or begins
with a common given name) makes its parts known in that text, so that "Mr. John Smith", "Mr. Smith", "John Smith", "Smith" and
"John" all change, and all to parts of one surrogate.

Texts are scanned once for mentions; only those with one are scanned again, for the parts of names that are now known.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .sqltext import let

#: Names the secret key in the session's configuration; without it, each session draws a key of its own.
KEY_SETTING = "spark.tidewell.surrogateKey"
WIDEN = 8
#: Given names by gender, titles by gender or none, particles of surnames, words around a person's full name, capitals that begin no name.
FEMALE = (
    "Agnes Alice Amy Andrea Angela Ann Anna Barbara Betty Brenda Camille Carla Carmen Carol Caroline Catherine Christine Clara Cynthia Deborah Diana Dolores Donna Dorothy Elena Elizabeth Emily Emma Eva Frances Gloria Hannah Heather Helen Ines "
    "Isabel Jane Janet Janice Jean Jennifer Jessica Joan Joyce Judith Julia Julie Karen Katherine Kathleen Kimberly Laura Lea Lena Linda Lisa Lucia Margaret Maria Marie Martha Mary Michelle Nancy Nicole Nina Nora Olivia Pamela Patricia Paula Pilar "
    "Rachel Rebecca Rosa Ruth Sabine Sandra Sara Sarah Sharon Shirley Sofia Sophie Susan Teresa Theresa Ursula Virginia"
).split()
MALE = (
    "Adam Alan Albert Alexander Andrew Anthony Antonio Arthur Benjamin Brian Carlos Charles Christopher Daniel David Dennis Donald Douglas Edward Eric Erik Felix Francisco Frank Gary George Gerald Gregory Hans Harold Henry Hugo Ivan Jacob James Jan "
    "Jason Javier Jeffrey Jerry John Jonas Jonathan Jorge Jose Joseph Joshua Juan Karl Keith Kenneth Kevin Klaus Larry Lawrence Leo Louis Luis Lukas Manuel Marco Mark Martin Matthew Michael Miguel Nicholas Oliver Oscar Patrick Paul Pedro Peter Philip "
    "Pierre Ralph Raymond Richard Robert Roger Ronald Samuel Scott Sergio Stefan Stephen Steven Thomas Timothy Victor Walter William"
).split()
FEMALE_TITLES, MALE_TITLES, TITLES = "Mrs Ms Miss Frau Mme Madame Sra".split(), "Mr Herr Monsieur Sr".split(), "Dr Prof".split()
PARTICLES = "van von der den de del della di da dos du la le ten ter zu".split()
BEFORE = "Contact contact Dear dear Attn: attn: Signed signed Author: author: Name: name: named Regards, regards, Sincerely, sincerely, employee customer patient client manager witness Judge President Senator Professor Captain met told asked thanked hired married called".split()
BEHIND = "called said says wrote writes asked replied signed paid told met lives works joined resigned agreed spoke".split()
NO_NAME = "The This That These Those It He She We They I You In On At Of And But For From To By With As If".split()

_EDGE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_LOCAL_PART = r"[\p{L}\p{N}._%+-]"
_LABEL = r"(?:\.[A-Za-z0-9-]+)"
#: A name's word: inner capitals, an apostrophe or hyphens are part of it; behind a title also all capitals.
_WORD = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}+(?:\p{Lu}\p{Ll}+)?(?:-\p{Lu}\p{Ll}+)?"
_ANY_WORD = rf"(?:{_WORD}{_END}|\p{{Lu}}{{2,}}(?:['’-]\p{{Lu}}{{2,}}{_END})*+{_END}|\p{{Lu}}['’]\p{{Lu}}{{2,}}{_END})"
#: (item)*, where what follows takes back eight items at the most: all but the last eight are taken for good, without a stack frame for each.
_MORE = "(?:{0}(?={0}{{8}}))*+{0}{{0,8}}"
_PARTICLE = "(?:(?:" + "|".join(PARTICLES) + ") ){0,2}"
_TITLE = "(?:" + "|".join(FEMALE_TITLES + MALE_TITLES + TITLES) + r")\.? " + _MORE.format("(?:(?:" + "|".join(TITLES) + r")\.? )")
_CALLED = "(?:" + "|".join(f"{c}(?:{'|'.join(n[1:] for n in FEMALE + MALE if n[0] == c)})" for c in sorted({n[0] for n in FEMALE + MALE})) + ")"  # by initials: most words fail at the first
_FULL = rf"(?!(?:{'|'.join(NO_NAME)}) ){_WORD} {_PARTICLE}{_WORD}"
_NAMED = "|".join((
    rf"{_TITLE}(?:\p{{Lu}}\. ){{0,2}}(?:{_ANY_WORD} ){{0,2}}{_PARTICLE}{_ANY_WORD}", rf"{_CALLED} (?:\p{{Lu}}\. )?{_PARTICLE}{_WORD}",
    # two capital words: only then is it worth looking at what stands around them
    rf"(?=\p{{Lu}}[\p{{L}}'’-]+ {_PARTICLE}\p{{Lu}})(?:{_FULL}(?= (?:{'|'.join(BEHIND)}){_END})|(?<={'|'.join(f'(?<![a-zA-Z]){w} ' for w in BEFORE)}){_FULL})",
))
#: + and 7 to 15 digits in groups of any size or none; NNN-NNN-NNNN that is no part of a longer run.
_WORLD, _LOCAL = _EDGE + r"\+[1-9](?:[ .-]?[0-9]){6,14}" + _END, _EDGE + r"(?<![0-9]-)(?:1-)?[0-9]{3}-[0-9]{3}-[0-9]{4}(?!-[0-9])" + _END
#: type, pattern; the first that matches a mention whole names its type. An address begins where its run of characters does
#: (or where a match ended), so a long run is read once.
TYPES = (
    ("email", rf"(?:\G|(?<!{_LOCAL_PART})){_LOCAL_PART}++@[A-Za-z0-9-]+(?:{_MORE.format(_LABEL)}|{_LABEL}*)\.[A-Za-z]{{2,}}"),
    ("ip", _EDGE + r"(?<![0-9]\.)(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])" + r"(?![\p{L}\p{N}]|\.[0-9])"),
    ("phone", r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}" + _END + r"|(?<![\p{L}\p{N}])\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,5}" + _END + f"|{_WORLD}|{_LOCAL}"),
    ("card", _EDGE + r"[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{4}" + _END),
    ("ssn", _EDGE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _END),
    ("iban", _EDGE + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _END),
    ("name", _EDGE + f"(?:{_NAMED})" + _END),
)
_P = dict(TYPES)
# what can begin with a digit, a plus or a bracket is tried only there, and names only at capitals
MENTION = f"{_P['email']}|(?=[0-9+(])(?:" + "|".join(f"(?:{_P[k]})" for k in ("ip", "phone", "card", "ssn")) + rf")|(?=\p{{Lu}})(?:{_P['iban']}|{_P['name']})"
#: Two capital words or more that are no name by themselves; a name that another text knows may be among them. The character before tells them from names.
#: The words behind the first are taken for good (++), each to its end: the engine keeps no stack frame for each, so a run may be of any length.
_RUN = rf"(?=\p{{Lu}}[\p{{L}}'’-]+ \p{{Lu}})(?!{_NAMED}){_WORD}(?: (?!{_NAMED}){_WORD}{_END})++"
SCAN = rf"{MENTION}|(?:\A|[^\p{{L}}\p{{N}}]){_RUN}"
#: Characters that stand for others of their kind, by script and case. Fixed values.
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SCRIPTS = (
    (0xDF, 0x17F, "àâäáãåçèéêëìíîïñòóôöùúûüý"), (0x370, 0x3FF, "αβγδεζηθικλμνξοπρστυφχψω"), (0x400, 0x52F, "абвгдежзийклмнопрстуфхцчшщъыьэюя"),
    (0x590, 0x5FF, "אבגדהוזחטיכלמנסעפצקרשת"), (0x600, 0x6FF, "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"), (0x3040, 0x30FF, "かきくけこさしすせそたちつてとなにぬねの"), (0x4E00, 0x9FFF, "山川田中村林木石水火金土日月星空海花草風"),
)


def _remainder(iban: Column) -> Column:
    """An account number as a number, its first four characters last, letters as 10 to 35, modulo 97."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    numbers = F.transform(F.split(moved, ""), lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(numbers, F.lit(0), lambda a, n: (a * F.when(n > 9, 100).otherwise(10) + n) % 97)


def kind_of(mention: Column) -> Column:
    """A mention's type; 'none' for what looks like an account number and has a wrong check sum: it stays."""
    kind = F.lit("name")
    for name, pattern in reversed(TYPES[:-1]):
        found = F.lit(name) if name != "iban" else F.when(_remainder(F.replace(mention, F.lit(" "), F.lit(""))) == 1, name).otherwise("none")
        kind = F.when(mention.rlike(f"^(?:{pattern})$"), found).otherwise(kind)
    return kind


_NAME = "struct<title:string,given:string,particle:string,last:string,gender:string>"


def _name(mention: Column) -> Column:
    """A name's title, given names, surname (one word behind a title is a surname) and gender: by the title, or by the given name."""

    def parts(bare: Column) -> Column:
        title = F.substring(mention, F.lit(1), F.length(mention) - F.length(bare))
        piece = lambda k: F.regexp_extract(bare, rf"^(?:(.+?) )??({_PARTICLE})(\S+)$", k)
        first, known = F.regexp_extract(title, r"^\p{L}+", 0), F.split(bare, " ")[0]
        gender = F.when(first.isin(FEMALE_TITLES) | ~first.isin(MALE_TITLES) & known.isin(FEMALE), "f").when(first.isin(MALE_TITLES) | known.isin(MALE), "m")
        return F.struct(title.alias("title"), F.nullif(piece(1), F.lit("")).alias("given"), piece(2).alias("particle"), piece(3).alias("last"), gender.alias("gender"))

    return let(F.regexp_replace(mention, f"^{_TITLE}", ""), parts)


def names_in(mentions: Column) -> Column:
    """The distinct names among a text's mentions."""
    said = F.filter(mentions, lambda m: F.regexp_replace(m, r"[\p{L}\p{M}.'’ -]", "") == "")  # letters alone: a name, as runs are apart
    return F.array_distinct(F.transform(said, lambda m: _name(m).cast(_NAME)))


def is_run(text: Column):
    """Which of a text's matches of SCAN are runs: those that begin with another character, and the first where the text itself begins with one."""
    leads = text.rlike(rf"\A{_RUN}")
    return lambda m, i: m.rlike(r"^[^\p{L}\p{N}]\p{Lu}") & ~m.contains("@") | (i == 0) & leads


def pairs_in(runs: Column) -> Column:
    """Neighbouring words of runs, in lower case."""
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: let(F.split(F.lower(F.regexp_replace(r, r"^[^\p{L}]", "")), " "), lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))))))


def wider(names: Column) -> Column:
    """MENTION, and the parts of these names where they stand alone, longest first, also in capitals."""
    whole = lambda n: F.concat(F.coalesce(F.concat(n.getField("given"), F.lit(" ")), F.lit("")), n.getField("particle"), n.getField("last"))
    forms = F.flatten(F.transform(names, lambda n: F.array(whole(n), n.getField("last"), F.upper(n.getField("last")), F.coalesce(n.getField("given"), n.getField("last")))))
    longest = F.array_sort(F.array_distinct(forms), lambda a, b: F.length(b) - F.length(a))
    quoted = F.transform(longest, lambda f: F.concat(F.lit(r"\Q"), f, F.lit(r"\E")))
    return F.when(F.size(names) == 0, F.lit(MENTION)).otherwise(F.concat(F.lit(f"{MENTION}|{_EDGE}(?:"), F.array_join(quoted, "|"), F.lit(f"){_END}")))


def parsed(mention: Column, names: Column) -> Column:
    """What a mention says: kind and normal form; for a name the title, given name and surname that stand there, and the entity
    of each (``person`` and ``family``). One word is the given name of the text's first person of that name, else a surname."""

    def by_kind(kind: Column) -> Column:
        plain = F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(mention, "[^0-9]", "")).when(kind == "iban", F.replace(mention, F.lit(" "), F.lit(""))).when(kind != "none", F.lower(mention))

        def named(n: Column) -> Column:
            alone = F.get(F.filter(names, lambda k: n.getField("given").isNull() & (k.getField("given") == n.getField("last"))), F.lit(0))

            def out(p: Column) -> Column:
                called = p.isNotNull()
                given = F.when(called, n.getField("last")).otherwise(n.getField("given"))
                last = F.when(~called, n.getField("last"))
                person = F.when(called, F.concat_ws(" ", p.getField("given"), p.getField("last"))).when(given.isNotNull(), F.concat_ws(" ", given, last))
                name = kind == "name"
                gender = F.coalesce(n.getField("gender"), p.getField("gender"))
                return F.struct(
                    mention.alias("mention"), kind.alias("kind"), F.when(~name, plain).alias("norm"), F.when(name, n.getField("title")).alias("title"), F.when(name, given).alias("given"), F.when(name, n.getField("particle")).alias("particle"), F.when(name, last).alias("last"),
                    F.when(name, F.lower(person)).alias("person"), F.when(name, F.lower(last)).alias("family"), F.when(name, gender).alias("gender"),
                )

            return let(alone, out)

        return let(_name(mention).cast(_NAME), named)

    return let(kind_of(mention), by_kind)


def _draw(secret: Column, i: Column) -> Column:
    """A number from 0 to 65535 for place i of an entity's keyed hash; longer entities go on with further hashes."""
    block = F.sha2(F.concat_ws("|", secret, F.floor(i / 16).cast("string")), 256)
    return F.conv(F.substring(block, (i % 16) * 4 + 1, 4), 16, 10).cast("int")


def _pick(letters: str, n: Column) -> Column:
    return F.substring(F.lit(letters), n % len(letters) + 1, 1)


_VOWELS, _CONSONANTS = "aeiou", "bcdfghjklmnprstvwz"


def _spoken(text: Column, secret: Column) -> Column:
    """Like ``_characters``, with vowels for vowels and consonants for consonants, so that a name can be spoken."""
    drawn = F.split(_characters(text, secret), "")
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: let(_draw(secret, i), lambda n: F.when(c.rlike("^[aeiou]$"), _pick(_VOWELS, n)).when(c.rlike("^[a-z]$"), _pick(_CONSONANTS, n)).otherwise(F.get(drawn, i)))), "")


def _characters(text: Column, secret: Column) -> Column:
    """Each letter and digit replaced by one of its script, case and kind; the rest stays."""

    def one(c: Column, i: Column) -> Column:
        n, code = _draw(secret, i), F.ascii(c)
        out = c
        for lo, hi, letters in _SCRIPTS:
            drawn = _pick(letters, n)
            out = F.when(code.between(lo, hi) & c.rlike(r"^\p{L}$"), F.when((F.lower(c) != c), F.upper(drawn)).otherwise(drawn)).otherwise(out)
        return F.when(c.rlike("^[a-z]$"), _pick(_LOWER, n)).when(c.rlike("^[A-Z]$"), _pick(_UPPER, n)).when(c.rlike("^[0-9]$"), (n % 10).cast("string")).otherwise(out)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _digits(n: Column, secret: Column, least: Column) -> Column:
    """n digits, the first at least ``least``."""
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i == 0, _draw(secret, i) % (10 - least) + least).otherwise(_draw(secret, i) % 10).cast("string")), "")


def _check_digit(body: Column) -> Column:
    """Luhn: from the right, every other digit doubled."""
    digits = F.transform(F.reverse(F.split(body, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return ((10 - F.aggregate(digits, F.lit(0), lambda a, x: a + x) % 10) % 10).cast("string")


def surrogate(kind: Column, norm: Column, gender: Column, draw: int, key: str) -> Column:
    """The surrogate's normal form, of norm's own shape; one letter or digit longer for every WIDEN draws before."""
    secret, more = F.sha2(F.concat_ws("|", F.lit(key), kind, norm, F.lit(str(draw))), 256), draw // WIDEN
    size, tld = F.length(norm), F.regexp_extract(norm, r"\.[^.]+$", 0)
    ip = F.concat_ws(".", *(((_draw(secret, F.lit(i)) % (254 if i in (0, 3) else 256)) + (1 if i in (0, 3) else 0)).cast("string") for i in range(4)))
    country = F.when((kind == "phone") & (size > 10), F.substring(norm, F.lit(1), size - 10)).otherwise("")
    digits = _digits(F.when(kind == "card", size - 2).otherwise(size - F.length(country)) + more, secret, F.when(kind == "phone", 2).when(kind == "card", 0).otherwise(1))
    card = let(F.concat(F.substring(norm, 1, 1), digits), lambda body: F.concat(body, _check_digit(body)))
    own = F.when(kind == "given", F.regexp_extract(norm, r"^(.+) \S+$", 1)).when(kind == "email", F.substring(norm, F.lit(1), size - F.length(tld))).otherwise(norm)
    # more letters: like an address's first, like a name's last
    wide = F.when(kind == "email", F.concat(F.lit("a" * more), own)).otherwise(F.concat(own, F.repeat(F.substring(own, -1, 1), F.lit(more))))
    letters = F.when(kind.isin("surname", "given"), _spoken(wide, F.sha2(secret, 256))).otherwise(_characters(wide, F.sha2(secret, 256)))
    land = F.substring(norm, 1, 2)
    iban = let(_characters(F.substring(norm, F.lit(5), size), F.sha2(secret, 256)), lambda body: F.concat(land, F.lpad((98 - _remainder(F.concat(land, F.lit("00"), body))).cast("string"), 2, "0"), body))
    lower = lambda names: F.array(*(F.lit(n.lower()) for n in names))
    of = lambda names: F.get(lower(names), _draw(secret, F.lit(0)) % len(names))
    pool = F.when(gender == "f", of(FEMALE)).when(gender == "m", of(MALE)).otherwise(of(FEMALE + MALE))
    # the pools are Latin and small: other scripts, and a surname that has used its pool up, get letters
    given = letters if more else F.when(own.rlike(r"^[\p{IsLatin} -]+$"), pool).otherwise(letters)
    out = F.when(kind == "ip", ip).when(kind == "iban", iban).when(kind == "card", card).when(kind.isin("phone", "ssn"), F.concat(country, digits))
    return out.when(kind == "email", F.concat(letters, tld)).when(kind == "given", given).otherwise(letters)


def cased(mention: Column, drawn: Column) -> Column:
    """drawn with the capitals of the mention."""
    return F.array_join(F.zip_with(F.split(mention, ""), F.split(drawn, ""), lambda m, d: F.when(F.lower(m) != m, F.upper(d)).otherwise(d)), "")


def laid_out(kind: Column, mention: Column, drawn: Column) -> Column:
    """The surrogate in the mention's own layout: its separators, its capitals. Digits more than it has stand at the end."""
    gaps = F.split(mention, "[0-9]", -1)
    digits = F.array_join(F.zip_with(gaps, F.split(drawn, ""), lambda g, d: F.concat(F.coalesce(g, F.lit("")), F.coalesce(d, F.lit("")))), "")
    step = lambda acc, c: F.when(c == " ", F.concat(acc, c)).otherwise(F.concat(acc, F.substring(drawn, F.length(F.replace(acc, F.lit(" "), F.lit(""))) + 1, F.lit(1))))
    spaced = F.aggregate(F.split(mention, ""), F.lit(""), step)
    return F.when(kind == "none", mention).when(kind == "ip", drawn).when(kind == "iban", spaced).when(kind.isin("phone", "card", "ssn"), digits).otherwise(cased(mention, drawn))


def assign(entities: DataFrame, key: str = "") -> DataFrame:
    """(kind, norm, drawn) for distinct entities (kind, norm and, if there, gender and any others): distinct surrogates, none
    equal to a real entity. A given name's norm ends with the surname, and is held apart from the others of that surname.

    Each round keeps what is free and draws the rest again; surrogates given out stay. Only counts reach the driver. Addresses
    of four octets are not widened: they end as long as the corpus holds fewer than the four thousand million there are.
    """
    scope, own = F.when(F.col("kind") == "given", F.regexp_extract("norm", r"\S+$", 0)).otherwise(""), F.when(F.col("kind") == "given", F.regexp_extract("norm", r"^(.+) \S+$", 1)).otherwise(F.col("norm"))
    gender = F.min("gender") if "gender" in entities.columns else F.lit(None).cast("string")
    entities = shared.stored(entities.groupBy("kind", "norm").agg(gender.alias("gender")).withColumns({"scope": scope, "own": own}), "entities")
    at, given, left, draw = ["kind", "scope", "drawn"], None, entities, 0
    while given is None or not left.isEmpty():
        tried = shared.stored(left.select("kind", "scope", "norm", "gender", surrogate(F.col("kind"), F.col("norm"), F.col("gender"), draw, key).alias("drawn")), "drawn")
        free = tried.groupBy(*at).agg(F.min("norm").alias("norm")).join(entities.select("kind", "scope", F.col("own").alias("drawn")), at, "left_anti")
        if given is not None:
            free = free.join(given.select(*at), at, "left_anti")
        free = shared.stored(free.select("kind", "scope", "norm", "drawn"), "given")
        given = free if given is None else given.union(free)
        left = tried.drop("drawn").join(free.select("kind", "norm"), ["kind", "norm"], "left_anti")
        draw += 1
    return given.select("kind", "norm", "drawn")


def secret_key(spark: SparkSession) -> str:
    """The key of KEY_SETTING, else one drawn for this session."""
    named = spark.conf.get(KEY_SETTING, None)
    if not named:
        named = secrets.token_hex(16)
        spark.conf.set(KEY_SETTING, named)
    return named


def with_known(seen: DataFrame) -> DataFrame:
    """seen (tk, pairs, names, ...) with the full names that other texts know and that stand in a text's runs added to its names: who is named once behind a
    title is the same person where the name stands without it. Pairs of a frequent name are dealt over tasks; a text's few names come back by its key."""
    full = seen.select(F.explode("names").alias("n")).where("n.given is not null").select(F.lower(F.concat_ws(" ", "n.given", "n.last")).alias("pair"), F.struct(F.lit("").alias("title"), F.col("n.given").alias("given"), F.col("n.particle").alias("particle"), F.col("n.last").alias("last"), F.col("n.gender").alias("gender")).alias("name"))
    known = shared.stored(full.groupBy("pair").agg(F.min("name").alias("name")), "known")
    if known.isEmpty():
        return seen
    pairs = seen.where("size(pairs) > 0").select("tk", F.explode("pairs").alias("pair")).groupBy("tk", "pair").agg(F.count("*").alias("copies"))
    found = shared.stored(pairs.join(known.select("pair"), "pair", "left_semi"), "pairs")
    counted = shared.stored(found.groupBy("pair").agg(F.count("*").alias("n")).join(known, "pair"), "known-here")
    more = shared.join_spread(found, counted, ["pair"], "n", F.col("tk")).groupBy("tk").agg(F.max("copies").alias("copies"), F.collect_set("name").alias("more"))
    more = shared.stored(more, "more")
    empty = F.array().cast(seen.schema["names"].dataType)
    met = shared.join_spread(seen.where("size(pairs) > 0"), more, ["tk"], "copies", F.monotonically_increasing_id(), "left").withColumn("names", F.array_distinct(F.concat("names", F.coalesce("more", empty)))).drop("more")
    return seen.where("size(pairs) = 0").unionByName(met)


def replace_entities(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``row`` (all columns of docs but text), ``text`` with surrogates, ``n_entities``.

    A null text stays null and an empty one empty, with no entity; an empty table gives an empty one. Rows given twice are
    replaced alike. A text of any length is scanned whole, in time linear in it. Columns with clashing names stay in ``row``. A null
    doc_id does not matter: rows meet their surrogates by a key of their text, and many copies of one text are dealt
    over several tasks.
    """
    key = secret_key(docs.sparkSession) if key is None else key
    kept = [c for c in docs.columns if c != "text"]
    row = F.struct(*kept) if kept else F.struct(F.lit(None).cast("string").alias("none"))
    none = F.array().cast("array<string>")
    text = F.col("text").cast("string")
    seen = docs.select(row.alias("row"), text.alias("text")).withColumns({"tk": shared.text_key(), "said": F.coalesce(F.regexp_extract_all("text", F.lit(SCAN), F.lit(0)), none)})
    run = is_run(F.col("text"))
    seen = seen.select("row", "text", "tk", F.filter("said", lambda m, i: ~run(m, i)).alias("said"), pairs_in(F.filter("said", run)).alias("pairs"))
    seen = shared.stored(seen, "seen")
    seen = with_known(seen.withColumn("names", names_in(F.col("said"))))
    clean = seen.where("size(said) = 0 and size(names) = 0").select("row", "text", F.lit(0).cast("bigint").alias("n_entities"))
    held = seen.where("size(said) > 0 or size(names) > 0").select("row", "text", "tk", "names").withColumn("pattern", wider(F.col("names")))
    mentions = F.transform(F.regexp_extract_all("text", F.col("pattern"), F.lit(0)), lambda m: parsed(m, F.col("names")))
    held = shared.stored(held.select("row", "tk", F.split("text", F.col("pattern"), -1).alias("pieces"), mentions.alias("mentions")), "held")

    texts = held.groupBy("tk").agg(F.first("mentions").alias("mentions"), F.count("*").alias("copies"))
    one = lambda kind, norm, gender: F.struct(kind.alias("kind"), norm.alias("norm"), gender.alias("gender"))
    field = lambda m, *names: [m.getField(n) for n in names]
    listed = F.flatten(F.transform("mentions", lambda m: F.array(one(*field(m, "kind", "norm", "gender")), one(F.lit("given"), *field(m, "person", "gender")), one(F.lit("surname"), *field(m, "family", "gender")))))
    said = texts.select("tk", "copies", F.explode(F.array_distinct(F.filter(listed, lambda e: e.getField("norm").isNotNull()))).alias("e")).select("tk", "copies", "e.*")
    said = shared.stored(said, "said")
    given = assign(said, key)
    held_by = given.join(said.groupBy("kind", "norm").agg(F.count("*").alias("n")), ["kind", "norm"])
    put = shared.join_spread(said.groupBy("tk", "kind", "norm").agg(F.first("copies").alias("copies")), held_by, ["kind", "norm"], "n", F.col("tk"))
    lists = shared.stored(put.groupBy("tk").agg(F.first("copies").alias("copies"), F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "norm"), "drawn"))).alias("drawn")), "lists")

    def shown(m: Column) -> Column:
        drawn = lambda kind, norm: F.col("drawn")[F.concat_ws("|", kind, norm)]
        part = lambda text, kind, norm: F.when(text.isNotNull(), cased(text, drawn(F.lit(kind), norm)))
        name = F.concat(m.getField("title"), F.concat_ws(" ", part(m.getField("given"), "given", m.getField("person")), F.concat(m.getField("particle"), part(m.getField("last"), "surname", m.getField("family")))))
        return F.when(m.getField("kind") == "name", name).otherwise(laid_out(m.getField("kind"), m.getField("mention"), drawn(m.getField("kind"), m.getField("norm"))))

    pieces = F.zip_with("pieces", F.transform("mentions", shown), lambda p, x: F.concat(p, F.coalesce(x, F.lit(""))))
    done = shared.join_spread(held, lists, ["tk"], "copies", F.monotonically_increasing_id())
    return clean.union(done.select("row", F.array_join(pieces, "").alias("text"), F.size(F.filter("mentions", lambda m: m.getField("kind") != "none")).cast("bigint").alias("n_entities")))


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; the key is fixed here so that the query gives the same rows in every session."""
    found = replace_entities(shared.table(spark, sf_dir, "documents").select("doc_id", "text"), key="op6 on invented documents")
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_entities", "text")
