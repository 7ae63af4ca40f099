"""Scalar functions as Column expressions: estimates, names, hashes, anchors, colours, cards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
RESERVED = ("con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10)))
FLOORS = {"standard": {"text": 4.5, "large": 3.0, "ui": 3.0}, "shield": {"text": 7.0, "large": 4.5, "ui": 3.0}}


def tokens_floor(s: Column) -> Column:
    """A quarter of the characters, at least one; 0 for empty text."""
    return F.when(F.coalesce(F.length(s), F.lit(0)) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.length(s) / 4))).cast("long")


def tokens_ceil(s: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((F.coalesce(F.length(s), F.lit(0)) + 3) / 4)).cast("long")


def tokens_bytes(s: Column) -> Column:
    """A quarter of the bytes, halves to the even neighbour."""
    return F.bround(F.octet_length(s) / 4, 0).cast("long")


def slug(s: Column) -> Column:
    """Lower-case name of letters, digits, _ and -, at most 60 characters; reserved and empty names get a prefix."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(F.translate(s, "/\\", "--")), "[^a-z0-9_-]+", "-"), "^[-_]+|[-_]+$", "")
    return F.substring(F.when(clean == "", F.lit("mem-node")).when(clean.isin(*RESERVED), F.concat(F.lit("mem-"), clean)).otherwise(clean), 1, 60)


def safe_filename(s: Column, limit: int = 200) -> Column:
    x = F.regexp_replace(F.regexp_replace(F.translate(s, "/\\: ", "---_"), "[()]", ""), r'[<>:"/\\|?*#%\x00-\x1f\x7f]', "_")
    x = F.regexp_replace(x, "^[. ]+|[. ]+$", "")
    return F.when(x == "", F.lit("unnamed")).otherwise(F.substring(x, 1, limit))


def safe_component(s: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(s, "[^A-Za-z0-9_.-]+", "_"), "^_+|_+$", "")
    return F.when(x == "", F.lit("_")).otherwise(x)


def doc_path(file_path: Column, qualified_name: Column, root: str = "docs") -> Column:
    """Where the page of a symbol lies: the folder named after its file, then its name."""
    stem = F.regexp_replace(F.coalesce(file_path, F.lit("unknown")), r"(?<=[^/])\.[^./]*$", "")
    return F.concat_ws("/", F.lit(root), stem, F.concat(safe_component(qualified_name), F.lit(".md")))


def content_hash(s: Column) -> Column:
    """SHA-256 of the text, null as empty."""
    return F.sha2(F.coalesce(s, F.lit("")), 256)


def luhn(s: Column) -> Column:
    """Whether 13 to 16 digits remain and pass the card checksum."""
    digits = F.regexp_replace(s, "[^0-9]", "")
    return F.length(digits).between(13, 16) & F.call_function("luhn_check", digits)


def line_of(text: Column, position: Column) -> Column:
    """1-based line of a 0-based position."""
    head = F.substring(text, F.lit(1), position)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def snake_and_camel(s: Column) -> Column:
    """The words of an identifier, two characters or more."""
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "([A-Z]+)([A-Z][a-z])", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+", " ")
    return F.filter(F.split(F.trim(x), " +"), lambda w: F.length(w) >= 2)


def channel(hex_colour: Column, k: int) -> Column:
    """Channel k of a colour written #rgb, #rrggbb or #rrggbbaa."""
    h = F.regexp_replace(hex_colour, "^#", "")
    h = F.when(F.length(h).isin(3, 4), F.regexp_replace(h, "(.)", "$1$1")).otherwise(h)
    return F.conv(F.substring(h, 2 * k + 1, 2), 16, 10).cast("int")


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Relative luminance of 0..255 channels."""
    lin = lambda c: F.when(c / 255 <= 0.04045, c / 255 / 12.92).otherwise(F.pow((c / 255 + 0.055) / 1.055, F.lit(2.4)))
    return 0.2126 * lin(r) + 0.7152 * lin(g) + 0.0722 * lin(b)


def contrast(a: Column, b: Column) -> Column:
    """Contrast ratio of two hex colours, lighter over darker."""
    x, y = (luminance(*(channel(c, k) for k in range(3))) for c in (a, b))
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def composite(fg: Column, bg: Column, alpha: Column) -> Column:
    """A channel over another, rounded half to even."""
    return F.bround(fg * alpha + bg * (1 - alpha), 0).cast("int")


def hsl_channel(h: Column, s: Column, lightness: Column, k: int) -> Column:
    """Channel k of a colour given as hue in degrees, saturation and lightness in 0..1."""
    a = s * F.least(lightness, 1 - lightness)
    n = F.pmod(F.lit([0, 8, 4][k]) + h / 30, F.lit(12))
    return F.bround(255 * (lightness - a * F.greatest(F.lit(-1.0), F.least(n - 3, 9 - n, F.lit(1.0)))), 0).cast("int")


def to_hex(*channels: Column) -> Column:
    """#rrggbb of channels clamped to 0..255."""
    return F.concat(F.lit("#"), *(F.lower(F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), c)).cast("long")), 2, "0")) for c in channels))


def verdict(ratio: Column, usage: str, profile: str = "standard") -> Column:
    return F.when(ratio >= FLOORS[profile][usage], "pass").otherwise("fail")


def anchor(resource: Column) -> Column:
    """path#Lx-Ly -> struct(path, first, last, valid); no absolute path, no parent step, x from 1 and not above y."""
    path, a, b = (F.regexp_extract(resource, r"^([^#]+)#L([0-9]+)-L?([0-9]+)$", k) for k in (1, 2, 3))
    x, y = F.nullif(a, F.lit("")).cast("int"), F.nullif(b, F.lit("")).cast("int")
    ok = (path != "") & ~path.startswith("/") & ~F.concat(F.lit("/"), path, F.lit("/")).contains("/../") & (x >= 1) & (x <= y)
    return F.struct(F.nullif(path, F.lit("")).alias("path"), x.alias("first"), y.alias("last"), F.coalesce(ok, F.lit(False)).alias("valid"))
