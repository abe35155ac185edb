"""Column functions on text: folding, paths, durations, ratings, slugs (ids H1-H6, H24-H35 of the survey)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def nocase(c: Column) -> Column:
    """ASCII case folding; other scripts stay as they are."""
    return F.translate(c, UPPER, LOWER)


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def parent_dir(path: Column) -> Column:
    """The folder of a path, `\\` as `/`; empty where there is none."""
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"^(.+)/[^/]*$", 1)


def path_prefixes(path: Column) -> Column:
    """Every folder above or at a folder path: /a/b gives [/a, /a/b]; relative paths stay relative."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(clean, "/"), lambda p: p != "")
    head = F.when(clean.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    steps = F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda n: F.concat(head, F.array_join(F.slice(parts, F.lit(1), n), "/")))


def format_duration(ms: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on; negative counts as 0."""
    s = F.floor(F.greatest(ms, F.lit(0)) / 1000).cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def track_of(raw: Column) -> Column:
    return raw % 1000


def disc_of(raw: Column) -> Column:
    """Thousands of the raw number, 1 where there are none."""
    return F.when(raw >= 1000, F.floor(raw / 1000)).otherwise(F.lit(1)).cast("int")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def parse_rating(c: Column) -> Column:
    """A rating word or a score of 1 to 5 as 0..1, else null."""
    word = F.lower(F.trim(c))
    stars = F.expr("1") * F.when(word.rlike("^[1-5]$"), word.cast("int"))
    return F.when(word.isin("up", "+", "good", "like"), 1.0).when(word.isin("down", "-", "bad", "dislike"), 0.0).otherwise((stars - 1) / 4.0)


def parse_rate(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """'0.1' or '10%' as a rate within bounds, else null."""
    text = F.trim(c)
    value = F.when(text.endswith("%"), F.expr("1.0") * F.regexp_replace(text, "%$", "").try_cast("double") / 100).otherwise(text.try_cast("double"))
    return F.when(value.between(lo, hi), value)


def params_of(text: Column) -> Column:
    """'a=1,b=2' as a map."""
    return F.str_to_map(text, F.lit(","), F.lit("="))


def read_param(params: Column, name: str, kind: str, default: object, lo: float | None = None, hi: float | None = None, choices: tuple[str, ...] = ()) -> Column:
    """A typed read from a map of strings: unreadable or foreign values give the default, numbers are clamped."""
    raw = F.trim(F.try_element_at(params, F.lit(name)))
    if kind == "bool":
        return F.when(F.lower(raw).isin("true", "1", "yes", "on"), True).when(F.lower(raw).isin("false", "0", "no", "off"), False).otherwise(F.lit(default))
    if kind == "choice":
        return F.when(raw.isin(*choices), raw).otherwise(F.lit(default))
    value = F.coalesce(F.nanvl(raw.try_cast("double"), F.lit(None).cast("double")), F.lit(float(default)))
    value = F.least(F.greatest(value, F.lit(float(lo))) if lo is not None else value, F.lit(float(hi if hi is not None else 1e308)))
    return F.floor(value + 0.5).cast("long") if kind == "int" else value


def render_key(*parts: Column) -> Column:
    """SHA-256 of the parts, joined by the unit separator, null as empty."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def stable_id(name: Column) -> Column:
    """31 h + code over the trimmed lower-case name, masked to 63 bits.

    In two halves of 32 and 31 bits, so that nothing overflows: the low 63 bits of each step depend on those before alone.
    """
    codes = F.transform(F.filter(F.split(F.lower(F.trim(name)), ""), lambda c: c != ""), F.ascii)

    def step(acc: Column, code: Column) -> Column:
        low = acc["low"] * 31 + code
        return F.struct(F.shiftright(low, 32).alias("carry"), low.bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"), (acc["high"] * 31 + F.shiftright(low, 32)).bitwiseAND(F.lit(0x7FFFFFFF)).alias("high"))

    zero = F.struct(*[F.lit(0).cast("long").alias(n) for n in ("carry", "low", "high")])
    return F.aggregate(codes, zero, step, lambda acc: F.shiftleft(acc["high"], 32) + acc["low"])


def alignment_distance(a: Column, b: Column) -> Column:
    """Edits between two short names, a swap of neighbours counting one: rows of the table as arrays, in one expression.

    Common ends cost nothing and are cut off first. Each step is a transform() of an array of one, so that its lists are
    made once and not for every cell.
    """
    chars = lambda c: F.filter(F.split(c, ""), lambda z: z != "")

    def common(x: Column, y: Column) -> Column:
        differs = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), F.lit(False))
        return F.coalesce(F.when(differs > 0, differs - 1).otherwise(F.size(x)), F.lit(0)).cast("int")

    pair = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    without = lambda c, n, start: F.slice(c, start, F.greatest(F.size(c) - n, F.lit(0)))
    both = F.array(pair(chars(a), chars(b)))
    both = F.transform(both, lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"), common(F.reverse(s["x"]), F.reverse(s["y"])).alias("n")))
    both = F.transform(both, lambda s: pair(without(s["x"], s["n"], F.lit(1)), without(s["y"], s["n"], F.lit(1))))
    both = F.transform(both, lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"), common(s["x"], s["y"]).alias("n")))
    both = F.transform(both, lambda s: pair(without(s["x"], s["n"], s["n"] + 1), without(s["y"], s["n"], s["n"] + 1)))
    return F.get(F.transform(both, lambda s: _edits(s["x"], s["y"])), 0)


def _edits(x: Column, y: Column) -> Column:
    """Edits between two lists of characters."""
    first = F.sequence(F.lit(0), F.size(y))

    def row(acc: Column, i: Column) -> Column:
        here, before = F.get(x, i), F.get(x, i - 1)

        def cell(left: Column, j: Column) -> Column:
            same = here == F.get(y, j)
            best = F.least(F.element_at(left, -1) + 1, F.get(acc["last"], j + 1) + 1, F.get(acc["last"], j) + F.when(same, 0).otherwise(1))
            swap = (i > 0) & (j > 0) & (here == F.get(y, j - 1)) & (before == F.get(y, j))
            return F.concat(left, F.array(F.when(F.coalesce(swap, F.lit(False)), F.least(best, F.get(acc["older"], j - 1) + 1)).otherwise(best)))

        places = F.when(F.size(y) > 0, F.sequence(F.lit(0), F.size(y) - 1)).otherwise(F.array().cast("array<int>"))
        return F.struct(acc["last"].alias("older"), F.aggregate(places, F.array(i + 1), cell).alias("last"))

    steps = F.when(F.size(x) > 0, F.sequence(F.lit(0), F.size(x) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.struct(first.alias("older"), first.alias("last")), row, lambda acc: F.element_at(acc["last"], -1))


def number_text(x: Column, decimals: int = 3) -> Column:
    """A number as a report shows it: so many decimals at most, no trailing zeros; a dash where it is none."""
    shown = F.regexp_replace(F.regexp_replace(F.format_string(f"%.{decimals}f", x.cast("double")), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(x.isNull() | F.isnan(x.cast("double")), F.lit("—")).when(F.abs(x) == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).otherwise(shown)


def percent_text(x: Column, decimals: int = 1) -> Column:
    """A share as a percentage."""
    return F.concat(F.format_string(f"%.{decimals}f", 100 * x.cast("double")), F.lit(" %"))


def csv_text(x: Column) -> Column:
    """A CSV field, quoted where it must be."""
    return F.when(x.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(x, F.lit("")))


def suggestion_limit(c: Column) -> Column:
    """Edits within which a name is offered for a misspelt one: a third of its length, 1 to 3."""
    return F.greatest(F.lit(1), F.least(F.lit(3), F.floor((F.length(c) + 2) / 3))).cast("int")


def deletions(word: Column, most: int) -> Column:
    """A word and all that is left of it without up to `most` of its letters."""
    without = lambda w: F.transform(F.when(F.length(w) > 0, F.sequence(F.lit(1), F.length(w))).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    level = out = F.array(word)
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, without)))
        out = F.array_union(out, level)
    return out
