"""Colours in any usual notation as Column expressions: parsing, laying one over another, contrast, channel tests.

Defined results: null, empty and unreadable text gives null; percentages and
alpha values are taken as they stand; channels round half to even.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arborlake.functions.lines import bind
from arborlake.functions.scalars import luminance

#: Names that may stand for a colour.
NAMED = {"black": (0, 0, 0), "white": (255, 255, 255)}


def _struct(r: Column, g: Column, b: Column, a: Column) -> Column:
    return F.struct(r.cast("int").alias("r"), g.cast("int").alias("g"), b.cast("int").alias("b"), a.cast("double").alias("a"))


def parse_color(text: Column) -> Column:
    """struct(r, g, b, a) of #rgb, #rgba, #rrggbb, #rrggbbaa, rgb(), rgba(), hsl(), hsla() or a name; null for anything else."""
    t = F.lower(F.trim(text))

    def hexed(h: Column) -> Column:
        pair = lambda k: F.conv(F.substring(h, 2 * k + 1, 2), 16, 10).cast("double")
        return _struct(pair(0), pair(1), pair(2), pair(3) / 255)

    digits = F.regexp_extract(t, "^#([0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})$", 1)
    digits = F.rpad(F.when(F.length(digits) <= 4, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits), 8, "f")
    body = F.regexp_extract(t, r"^(?:rgb|hsl)a?\(([^)]+)\)", 1)
    parts = F.filter(F.transform(F.split(body, "[,/]"), lambda p: F.trim(p)), lambda p: p != "")
    values = F.transform(parts, lambda p: F.struct(F.regexp_replace(p, "(?:%|deg)$", "").try_cast("double").alias("n"), p.endswith("%").alias("p")))
    alpha = lambda v: F.when(F.size(v) < 4, F.lit(1.0)).when(F.get(v, F.lit(3))["p"], F.get(v, F.lit(3))["n"] / 100).otherwise(F.get(v, F.lit(3))["n"])

    def rgb(v: Column) -> Column:
        amount = lambda x: F.bround(F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.when(x["p"], x["n"] * 2.55).otherwise(x["n"]))), 0)
        level = F.transform(F.slice(v, 1, 3), lambda x: F.when(x["n"].isNotNull(), amount(x)))
        return bind(level, lambda c: _struct(c[0], c[1], c[2], alpha(v)))

    def hsl(v: Column) -> Column:
        s, li = v[1]["n"] / 100, v[2]["n"] / 100
        base = F.struct(F.pmod(v[0]["n"], F.lit(360.0)).alias("h"), ((1 - F.abs(2 * li - 1)) * s).alias("c"), li.alias("l"))

        def turn(w: Column) -> Column:
            x, c, zero = w["c"] * (1 - F.abs(F.pmod(w["h"] / 60, F.lit(2.0)) - 1)), w["c"], F.lit(0.0)
            at = lambda *by: F.bround((F.get(F.array(*by), F.floor(w["h"] / 60).cast("int")) + w["l"] - c / 2) * 255, 0)
            return _struct(at(c, x, zero, zero, x, c), at(x, c, c, x, zero, zero), at(zero, zero, x, c, c, x), alpha(v))

        return bind(base, turn)

    named = None
    for k, v in NAMED.items():
        value = _struct(*map(F.lit, v), F.lit(1.0))
        named = F.when(t == k, value) if named is None else named.when(t == k, value)
    whole = lambda c: F.when(c["r"].isNotNull() & c["g"].isNotNull() & c["b"].isNotNull() & c["a"].isNotNull(), c)
    spoken = bind(values, lambda v: F.when((F.size(v) >= 3) & t.startswith("rgb"), rgb(v)).when((F.size(v) >= 3) & t.startswith("hsl"), hsl(v)))
    return named.when(t.rlike("^#(?:[0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})$"), bind(digits, hexed)).otherwise(bind(spoken, whole))


def over(front: Column, back: Column) -> Column:
    """struct(r, g, b, a = 1): a parsed colour laid over an opaque one."""
    mix = lambda f, b, k: F.bround(f[k] * f["a"] + b[k] * (1 - f["a"]), 0)
    return bind(front, lambda f: bind(back, lambda b: _struct(mix(f, b, "r"), mix(f, b, "g"), mix(f, b, "b"), F.lit(1.0))))


def ratio(text: Column, on: Column) -> Column:
    """Contrast of two colours in any notation, the first laid over the second."""
    bright = lambda v: luminance(v["r"], v["g"], v["b"])
    both = lambda back: bind(F.array(bind(over(parse_color(text), back), bright), bright(back)), lambda y: (F.array_max(y) + 0.05) / (F.array_min(y) + 0.05))
    return bind(parse_color(on), both)


def plain_luminance(r: Column, g: Column, b: Column) -> Column:
    """Weighted brightness of channels without linearizing them."""
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def terrain_like(r: Column, g: Column, b: Column) -> Column:
    """Earth and plant tones: bright enough, and neither red nor green far below blue."""
    return (g > 72) & (r > 62) & (b > 38) & (r > b * 0.92) & (g > b * 0.92)
