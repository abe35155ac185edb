"""Column functions against plain Python, on literal rows with nulls and odd values."""

import hashlib
import math

from pyspark.sql import functions as F

from tonearm.functions import exprs, music, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text(spark):
    cases = [
        (text.parent_dir(F.lit("a\\b\\c.mp3")), "a/b"),
        (text.parent_dir(F.lit("/c.mp3")), ""),
        (text.parent_dir(F.lit("c.mp3")), ""),
        (text.format_duration(F.lit(3_725_000)), "1:02:05"),
        (text.format_duration(F.lit(65_999)), "1:05"),
        (text.format_duration(F.lit(-5)), "0:00"),
        (text.slug(F.lit("  Long Blend! 2 ")), "long-blend-2"),
        (text.nocase(F.lit("ÄB")), "Äb"),
        (text.disc_of(F.lit(2013)), 2),
        (text.disc_of(F.lit(13)), 1),
    ]
    for column, want in cases:
        assert one(spark, column) == want
    assert one(spark, text.path_prefixes(F.lit("/a/b"))) == ["/a", "/a/b"]
    assert one(spark, text.path_prefixes(F.lit("a//b/"))) == ["a", "a/b"]
    assert one(spark, text.path_prefixes(F.lit("/"))) == []


def test_ratings_rates_params(spark):
    for word, want in {"UP": 1.0, "-": 0.0, "3": 0.5, "5": 1.0, "meh": None, "9": None}.items():
        assert one(spark, text.parse_rating(F.lit(word))) == want
    for word, want in {"10%": 0.1, "0.2": 0.2, "3": None, "x%": None}.items():
        assert one(spark, text.parse_rate(F.lit(word))) == want
    p = text.params_of(F.lit("bars=7.5,on=yes,curve=S,odd=zz"))
    assert one(spark, text.read_param(p, "bars", "int", 4, 1, 16)) == 8
    assert one(spark, text.read_param(p, "bars", "double", 4, 1, 6)) == 6.0
    assert one(spark, text.read_param(p, "odd", "double", 4)) == 4.0
    assert one(spark, text.read_param(p, "on", "bool", False)) is True
    assert one(spark, text.read_param(p, "curve", "choice", "L", choices=("L", "S"))) == "S"
    assert one(spark, text.read_param(p, "none", "int", 3)) == 3


def test_tempo_key_level(spark):
    for a, b, want in ((120, 126, "SAME"), (120, 63, "DOUBLE"), (60, 125, "HALF")):
        assert one(spark, music.tempo_relation(F.lit(float(a)), F.lit(float(b))))["relation"] == want
    for name, want in {"F#m": (6, True), "Bb minor": (10, True), "C": (0, False), "c♯": (1, False), "H": None}.items():
        got = one(spark, music.parse_key(F.lit(name)))
        assert (tuple(got) if got else None) == want
    assert one(spark, music.camelot(F.lit(9), F.lit(True))) == 8  # A minor
    assert one(spark, music.camelot(F.lit(0), F.lit(False))) == 8  # C major
    assert one(spark, music.camelot_distance(F.lit(12), F.lit(True), F.lit(1), F.lit(False))) == 2
    assert one(spark, music.coerce(F.lit(float("nan")), 0.0, 1.0)) == 0.0
    assert one(spark, music.verdict(F.lit(float("nan")), F.lit(1.0), F.lit(2.0), F.lit(False))) == "FAIL"
    assert one(spark, music.cosine(F.array().cast("array<double>"), F.array(F.lit(1.0)))) == 1.0
    gain = one(spark, music.normalise_gain(F.lit(-20.0), F.lit(-3.0)))
    assert (gain.gain, gain.peak_limited) == (2.0, True)
    assert one(spark, music.normalise_gain(F.lit(float("-inf")), F.lit(0.0))).gain == 0.0
    assert one(spark, music.multiplier(F.lit(0), F.lit(0.0), F.lit(0), F.lit(0.0))) == 1.0
    assert math.isclose(one(spark, music.multiplier(F.lit(3), F.lit(3.0), F.lit(0), F.lit(0.0))), 0.5 + 5 / 7)


def test_jitter_equals_hashlib(spark):
    bits = int(hashlib.sha256(b"7\x009\x001\x00bassSwap").hexdigest()[:14], 16) >> 3
    want = 1 + 0.05 * (2 * (bits / 2**53) - 1)
    assert math.isclose(one(spark, music.jitter(F.lit(7), F.lit(9), F.lit(1), F.lit("bassSwap"))), want)


def test_expressions(spark):
    names = {"a": F.lit(3.0), "b": F.lit(0.0)}
    for source, want in {"1 + 2 * a": 7.0, "clamp(a, 0, 2)": 2.0, "round(-2.5)": -2.0, "a / b": None, "-min(a, 1, b)": 0.0, "ceil(a / 2)": 2.0}.items():
        assert one(spark, exprs.expression(source, names)) == want
    for source in ("c", "a ** 2", "__import__('os')", "a if b else a", "min(a)", "a +", "'x'", "(" * 70 + "a" + ")" * 70 + "+" + "-" * 70 + "a"):
        try:
            exprs.expression(source, names)
        except ValueError:
            continue
        raise AssertionError(source)
    got = exprs.resolved({"x": ("a * 10", 0, 12), "y": ("x + 1", 0, 100)}, names)
    assert one(spark, got["y"]) == 13.0
