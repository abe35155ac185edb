"""Personal data: detected entities get keyed surrogates of the same type, gender, script and format.

A surrogate is drawn from a digest of (key, type, canonical value, turn): every digit gives a digit, every vowel a
vowel and every consonant a consonant of its script, case as in the mention; card numbers keep their first digit and
their check digit's validity, phone numbers their country code, mail addresses their last label, names their titles
and a gender ending. The canonical value (letters in lower case, numbers without separators) decides alone, so all
mentions of an entity, in whatever layout, in all documents, get the same surrogate.

Names are found after a title, with any number of parts that begin with a capital, and then wherever the same text says
one of those parts. Numbers of bank accounts keep their country and get valid check digits.

Distinctness is checked over the whole corpus: values whose surrogate another value has too, or is itself a value of
the corpus, draw again with the next turn, until there is none; of several values with one surrogate the least keeps
it. Later turns make names longer, and after TURNS a digest's end is added, so that values never run out of surrogates.
The table of entities is written once, the few that draw again turn by turn; it is joined, never collected.

Cases: null and empty texts stay as they are and have no entity; repeated rows get the same text; an empty table gives
an empty table; other columns, whatever their names, stay as they are, but for a column of the output's name; a very
long text costs its length and its mentions.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.functions.frames import together
from tonearm.llm.common import Tables, spans_of, table

TITLES = r"Mr\.?|Mrs\.?|Ms\.?|Miss|Dr\.?|Herrn?|Frau|Monsieur|Madame|Mme|Señora?|Sra?\.|Господин|Госпожа"
#: In this order where several begin at one place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+(?:1(?:[\x20().-]{0,3}[0-9]){10}(?![0-9])|[0-9](?:[\x20()./-]{0,3}[0-9]){6,14})|\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|0[1-9][0-9]{0,4}[\x20/-][0-9]{5,9}|0[1-9](?:[\x20.-][0-9]{2}){4})(?![0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?!\.?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9])",
    "name": rf"\p{{Lu}}(?:(?<=\b(?:{TITLES})\x20(?:\p{{Lu}}\.\x20){{0,4}}\p{{Lu}})|(?<=\b(?:{TITLES})\x20\p{{Lu}}\p{{L}}{{1,20}}\x20\p{{Lu}}))(?:\p{{L}}|['-](?![sS](?!\p{{L}}))(?=\p{{L}}))++",
}
#: All kinds but mail addresses begin with a digit, a sign or a capital: most places fail at once.
OTHERS = r"(?=[0-9+(\p{Lu}])(?:" + "|".join(f"(?:{p})" for kind, p in PATTERNS.items() if kind != "email") + ")"
ANY = f"(?:{PATTERNS['email']})|{OTHERS}"
#: A whole name after a title: any number of parts and initials, with the particles between them, up to a word of ENDS.
PART = r"\p{Lu}(?:\p{L}|['-](?![sS](?!\p{L}))(?=\p{L}))*+"
PARTICLES = "von|van|der|den|zu|zur|de|del|della|di|da|dos|du|la|le|las|los|el|y|bin|ibn|al"
#: Words that begin with a capital after a name without being part of it.
ENDS = "The|A|An|And|Or|But|He|She|It|They|We|You|I|In|On|At|For|Der|Die|Das|Und|Er|Sie|Es|Wir|Ich|Im|Am|Ein|Eine|Le|Les|Il|Elle|Ils|Et|Un|Une|El|Los|Las|Y|Un|Una"
WHOLE_NAME = rf"(?<=\b(?:{TITLES})\x20){PART}(?:(?:(?<=(?<!\p{{L}})\p{{Lu}})\.)?\x20(?:(?:{PARTICLES})\x20)*+(?!(?:{ENDS})(?!\p{{L}})){PART})*+"
#: A name of the same text without a title, in any case behind its capital, also with a genitive's s.
UNTITLED = (r"|(?<![\p{L}\p{N}])(?=\p{Lu})(?iu:", r")(?=s?(?![\p{L}\p{N}]))")
#: Country codes, which surrogates keep.
COUNTRY = r"^\+(?:7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: Letters that replace one another.
CLASSES = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "áàâäåéèêëíîïóòôöúùûü", "çñ", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ")
#: Other letters with marks, by script and by whether the plain letter is a vowel: tables by rule from the character database.
MARKED = tuple(
    "".join(c for c in map(chr, span) if c.islower() and c not in "".join(CLASSES) and len(c.upper()) == 1 and ((unicodedata.normalize("NFD", c)[0] in plain) == vowel))
    for span, plain in ((range(0xDF, 0x250), "aeiouyæœøıəɛɔ"), (range(0x1E00, 0x1F00), "aeiouy"), (range(0x430, 0x530), "аеиоуыэюяѐёєіїўѣ"), (range(0x3AC, 0x3CF), "αεηιουω"), (range(0x1F00, 0x2000), "αεηιουω"))
    for vowel in (True, False)
)
#: First and last letter of scripts without case, and of those beyond the tables: each is drawn from its own range.
RANGES = ((0x561, 0x586), (0x5D0, 0x5EA), (0x621, 0x63A), (0x641, 0x64A), (0x905, 0x939), (0x995, 0x9A8), (0xE01, 0xE2E), (0xE40, 0xE44), (0x10D0, 0x10F0), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))
ENDINGS = ("a", "а", "ов", "ова", "ев", "ева")
TURNS = 8


def kind_of(found: Column) -> Column:
    out = F.lit("name")
    for kind in ("card", "ssn", "ip", "phone", "iban", "email"):
        out = F.when(found.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def canonical(kind: Column, found: Column) -> Column:
    bare = F.regexp_replace(found, r"[^0-9A-Za-z]", "")
    # North American numbers without their 1; all others with a + and their country code.
    national = F.when((F.length(bare) == 11) & bare.startswith("1"), F.substring(bare, 2, 10)).when(found.startswith("+"), F.concat(F.lit("+"), bare)).otherwise(bare)
    return F.when(kind.isin("email", "name"), F.lower(found)).when(kind == "ip", found).when(kind == "phone", national).otherwise(F.lower(bare))


def by_sign(text: Column, f: Callable[[str], Column]) -> Column:
    """f of the pattern that a text needs: mail addresses are looked for only where there is an @."""
    return F.when(F.contains(text, F.lit("@")), f(ANY)).otherwise(f(OTHERS))


def pattern_of(text: Column) -> Column:
    """The pattern that a text needs, with the names found in it after a title: their other mentions are theirs too."""
    titled = F.regexp_extract_all(text, F.lit(WHOLE_NAME), F.lit(0))
    parts = F.flatten(F.transform(titled, lambda n: F.regexp_extract_all(n, F.lit(rf"(?<![\p{{L}}'-]){PART}"), F.lit(0))))
    names = F.array_distinct(F.transform(F.filter(parts, lambda n: (F.length(n) > 1) & ~n.rlike(f"^(?:{TITLES})$")), F.lower))
    longest = F.transform(F.sort_array(F.transform(names, lambda n: F.struct(F.length(n).alias("n"), n.alias("name"))), asc=False), lambda x: x["name"])
    untitled = F.when(F.size(names) > 0, F.concat(F.lit(UNTITLED[0]), F.array_join(longest, "|"), F.lit(UNTITLED[1]))).otherwise(F.lit(""))
    return F.concat(by_sign(text, F.lit), untitled)


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def redrawn(text: Column, seed: Column) -> Column:
    """Every letter and digit replaced by one of its class, drawn by its place from the seed."""

    def one(c: Column, i: Column) -> Column:
        draw = F.pmod(F.xxhash64(seed, i), F.lit(1 << 40))
        sign = F.ascii(c)
        from_table = lambda letters: F.substring(F.lit(letters), (draw % len(letters) + 1).cast("int"), F.lit(1))
        code = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 4, "0")), "UTF-16BE")
        out = F.when(c.rlike(r"\p{L}"), from_table(CLASSES[2])).otherwise(c)  # a letter of none of them
        for first, last in RANGES:
            out = F.when(sign.between(first, last), code(draw % (last - first + 1) + first)).otherwise(out)
        for letters in reversed(MARKED):
            out = F.when(F.call_function("instr", F.lit(letters), c) > 0, from_table(letters)).otherwise(out)
        out = F.when(sign < 128, c).otherwise(out)
        for letters in reversed(CLASSES):  # the most frequent are asked for first
            out = F.when(F.call_function("instr", F.lit(letters), c) > 0, from_table(letters)).otherwise(out)
        return out

    return F.array_join(F.transform(chars(text), one), "")


def luhn(digits: Column) -> Column:
    """The check sum's remainder of a digit string: 0 if valid."""
    from_right = F.transform(F.reverse(chars(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(from_right, F.lit(0), lambda acc, x: acc + x) % 10


def check_digits(country: Column, body: Column) -> Column:
    """The two check digits of an account number, from the remainder by 97 of its digits, letters counting 10 to 35."""
    digits = F.array_join(F.transform(chars(F.concat(body, country, F.lit("00"))), lambda c: F.when(c.rlike("[a-z]"), (F.ascii(c) - 87).cast("string")).otherwise(c)), "")
    rest = F.aggregate(chars(digits), F.lit(0), lambda acc, c: (acc * 10 + c.cast("int")) % 97)
    return F.lpad((98 - rest).cast("string"), 2, "0")


def surrogate(kind: Column, value: Column, turn: Column, key: str) -> Column:
    """The surrogate of a canonical value, drawn for a turn."""
    seed = F.sha2(F.concat_ws("\u001f", F.lit(key), kind, value, turn.cast("string")), 256)
    octet = lambda i: (F.pmod(F.xxhash64(seed, F.lit(i)), F.lit(254)) + 1).cast("string")
    at = F.length(value) - F.length(F.regexp_extract(value, r"[^.]*$", 0))
    mail = F.concat(redrawn(F.substring(value, F.lit(1), at), seed), F.substring(value, at + 1, F.length(value)))
    card = F.concat(F.substring(value, 1, 1), redrawn(F.substring(value, F.lit(2), F.length(value)), seed))
    front = F.substring(card, F.lit(1), F.length(card) - 1)
    valid = F.concat(front, ((10 - luhn(F.concat(front, F.lit("0")))) % 10).cast("string"))
    country = F.length(F.regexp_extract(value, COUNTRY, 0))
    phone = F.concat(F.substring(value, F.lit(1), country), redrawn(F.substring(value, country + 1, F.length(value)), seed))
    body = redrawn(F.substring(value, F.lit(5), F.length(value)), seed)
    iban = F.concat(F.substring(value, 1, 2), check_digits(F.substring(value, 1, 2), body), body)
    ending = F.regexp_extract(value, f"({'|'.join(sorted(ENDINGS, key=len, reverse=True))})$", 0)
    stem = F.length(value) - F.length(ending)
    # Short names have few surrogates: later turns are longer.
    longer = F.when(turn > 2, F.substring(F.lit("ranelisomu"), F.lit(1), turn - 2)).otherwise(F.lit(""))
    name = F.concat(redrawn(F.concat(F.substring(value, F.lit(1), stem), longer), seed), ending)
    new = (
        F.when(kind == "email", mail).when(kind == "ip", F.concat_ws(".", *[octet(i) for i in range(4)])).when(kind == "card", F.when(luhn(value) == 0, valid).otherwise(card))
        .when(kind == "phone", phone).when(kind == "iban", iban).when(kind == "name", name).otherwise(redrawn(value, seed))
    )
    return F.when(turn > TURNS, F.concat(new, F.translate(F.substring(seed, 1, 12), "0123456789", "ghijklmnop"))).otherwise(new)


def formatted(kind: Column, found: Column, new: Column) -> Column:
    """A surrogate in a mention's layout: its separators, and capitals where it has them."""
    bare = F.regexp_replace(found, "[^0-9A-Za-z]", "")
    digits = F.when(kind == "phone", F.ltrim(new, F.lit("+"))).otherwise(new)
    ahead = F.when(kind == "phone", F.substring(bare, F.lit(1), F.length(bare) - F.length(digits))).otherwise(F.lit(""))
    letters = chars(F.concat(ahead, digits))
    place = F.aggregate(
        chars(found),
        F.struct(F.lit(0).alias("i"), F.lit("").alias("out")),
        lambda acc, c: F.struct(
            (acc["i"] + c.rlike("[0-9A-Za-z]").cast("int")).alias("i"),
            F.concat(acc["out"], F.when(c.rlike("[A-Z]"), F.upper(F.get(letters, acc["i"]))).when(c.rlike("[0-9a-z]"), F.get(letters, acc["i"])).otherwise(c)).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    cased = F.array_join(F.transform(letters, lambda c, i: F.when(F.get(chars(found), i).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), "")
    return F.when(kind == "ip", new).when(kind.isin("email", "name"), cased).otherwise(place)


def entities(mentions: DataFrame, key: str, tables: Tables) -> DataFrame:
    """(kind, value, new) of all mentions with distinct surrogates; only the few that clash are drawn again and written, turn by turn."""
    draw = lambda rows, turn: rows.withColumn("new", surrogate(F.col("kind"), F.col("value"), F.lit(turn), key))
    least = lambda rows: rows.groupBy("kind", "new").agg(F.min("value").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = lambda rows: rows.join(least(rows), ["kind", "new"]).filter("value <> least").select("kind", "value")
    first = tables.write(draw(mentions.select("kind", "value").distinct(), 0), "drawn-0")
    values = first.select("kind", F.col("value").alias("new"))
    again = tables.write(together(later(first), first.join(values, ["kind", "new"], "left_semi").select("kind", "value")).distinct(), "again-0")
    settled, turn = first.join(again, ["kind", "value"], "left_anti"), 0
    while not again.isEmpty():
        turn += 1
        drawn = tables.write(draw(again, turn), f"drawn-{turn}")
        taken = together(drawn.join(settled.select("kind", "new"), ["kind", "new"], "left_semi"), drawn.join(values, ["kind", "new"], "left_semi"))
        again = tables.write(together(later(drawn), taken.select("kind", "value")).distinct(), f"again-{turn}")
        settled = together(settled, drawn.join(again, ["kind", "value"], "left_anti"))
    return settled


def replace(docs: DataFrame, key: str, id: str = "doc_id", text: str = "text", out: str = "entities") -> DataFrame:
    """docs with surrogates in the text, and `entities`: array of (kind, start, end) in the original text."""
    tables = Tables(docs.sparkSession, "pii")
    docs = docs.drop(out)
    whole = F.col("row")[text]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.coalesce(by_sign(whole, lambda p: whole.rlike(p)), F.lit(False)).alias("some"))
    held = rows.filter("some").select("row", F.col(f"row.{id}").alias("id"), F.xxhash64(whole).alias("digest"), pattern_of(whole).alias("pattern"))
    spans = held.select("id", "digest", F.posexplode(spans_of(whole, F.col("pattern"))).alias("place", "span"))
    kind = kind_of(F.col("span.found"))
    mentions = spans.select("id", "digest", "place", "span", kind.alias("kind")).select("*", canonical(F.col("kind"), F.col("span.found")).alias("value"))
    mentions = tables.write(mentions.dropDuplicates(["id", "digest", "place"]), "mentions")
    known = entities(mentions, key, tables).select("kind", "value", "new")
    said = mentions.join(known, ["kind", "value"]).select("id", "digest", "place", "span.start", "span.end", "kind", formatted(F.col("kind"), F.col("span.found"), F.col("new")).alias("new"))
    parts = said.groupBy("id", "digest").agg(F.sort_array(F.collect_list(F.struct("place", "start", "end", "kind", "new"))).alias("parts"))
    parts = parts.select(F.col("id").alias("part_id"), F.col("digest").alias("part_digest"), "parts")
    joined = held.join(parts, F.col("id").eqNullSafe(F.col("part_id")) & (F.col("digest") == F.col("part_digest")))
    gaps = F.split(whole, F.col("pattern"), -1)
    text_new = F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size("parts")), "parts", lambda g, p: F.concat(g, p["new"])), ""), F.element_at(gaps, -1))
    found = F.transform("parts", lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end")))
    changed = joined.select(*[(text_new if c == text else F.col("row")[c]).alias(c) for c in docs.columns], found.alias(out))
    kept = rows.filter("not some").select("row.*", F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)").alias(out))
    return together(kept, changed)


def op10_pii(spark: SparkSession, sf_dir: str, key: str = "a key of the owner's") -> DataFrame:
    """Every document with surrogates for its personal data, and how many entities of each kind it had."""
    done = replace(table(spark, sf_dir, "documents").select("doc_id", "text"), key)
    count = lambda kind: F.size(F.filter("entities", lambda e: e["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return done.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), *[count(k) for k in PATTERNS])
