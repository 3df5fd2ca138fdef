"""Text, ids, dates, maps and small lookups."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two spellings of a version 4 UUID, and the largest whole number that a range may name.
HYPHENATED = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
PLAIN = "^[0-9a-f]{12}4[0-9a-f]{3}[89ab][0-9a-f]{15}$"
LARGEST = 9007199254740991

#: Category codes of the source tables.
WALKWAYS = ("walkway", "walkway.island", "movingwalkway", "footbridge", "ramp", "steps", "lobby", "platform", "corridor", "sidewalk")
TRANSIT = ("elevator", "escalator", "stairs")
#: Feature types in canonical order.
FEATURE_TYPES = (
    "address", "amenity", "anchor", "building", "detail", "fixture", "footprint", "geofence",
    "kiosk", "level", "occupant", "opening", "relationship", "section", "unit", "venue",
)


def uuid4(value: Column) -> Column:
    """A version 4 UUID in lower case with hyphens, from that or from 32 hex digits; else null."""
    s = F.lower(F.trim(value))
    cut = F.concat_ws("-", *[F.substring(s, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.when(s.rlike(HYPHENATED), s).when(s.rlike(PLAIN), cut)


def non_empty(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def non_empty_list(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull() & (x != ""))


def finite_or(value: Column, default: float) -> Column:
    """A finite double read from text, else the default."""
    x = value.try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x).otherwise(F.lit(default))


def is_finite(*values: Column) -> Column:
    out = F.lit(True)
    for x in values:
        out = out & F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))
    return out


def is_walkway(category: Column) -> Column:
    return F.coalesce(category.isin(*WALKWAYS), F.lit(False))


def is_transit(category: Column) -> Column:
    return F.coalesce(category.isin(*TRANSIT), F.lit(False))


def type_rank(feature_type: Column) -> Column:
    """Place in the canonical order, -1 for an unknown type."""
    return F.array_position(F.array(*map(F.lit, FEATURE_TYPES)), feature_type).cast("int") - 1


def slug(text: Column, empty: str = "venue") -> Column:
    """Letters and digits of the compatibility decomposition in lower case, runs of all else as hyphens; ``empty`` if nothing is left."""
    found = F.regexp_replace(F.regexp_replace(F.lower(normalized(text, "NFKD")), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(found == "", empty).otherwise(found)


def search_text(text: Column) -> Column:
    """Compatibility forms composed, lower case, single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(nfkc(text)), r"\s+", " "))


def normalized(text: Column, form: str) -> Column:
    """Unicode normalization, which Spark has no function for: an Arrow function over batches, for texts beyond ASCII alone."""

    @F.pandas_udf("string")
    def normalize(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize(form, x))

    return normalize(text)


def nfkc(text: Column) -> Column:
    return normalized(text, "NFKC")


#: Fixed value: characters that a body may have.
MOST_CHARACTERS = 4000


def markdown_fault(text: Column, most: int = MOST_CHARACTERS) -> Column:
    """Why a body isn't valid, null if it is: control characters but tab and line feed, no or too many characters, white space alone."""
    t = F.regexp_replace(text, "\r\n?", "\n")
    control = t.rlike(r"[\x00-\x08\x0B-\x1F\x7F-\x9F]")
    size = F.length(t)
    return F.when(control, "disallowed control character").when((size < 1) | (size > most), "length").when(~t.rlike(r"[^\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"), "whitespace-only")


def summary(markdown: Column, most: int = 80) -> Column:
    """The first line with text once images are gone, cut to ``most`` characters; null without any."""
    lines = F.transform(F.split(F.regexp_replace(markdown, r"!\[[^\]]*\]\([^)]*\)", ""), r"\r?\n"), lambda x: F.trim(x))
    return F.substring(F.get(F.filter(lines, lambda x: x != ""), F.lit(0)), 1, most)


def clean_markdown(text: Column) -> Column:
    """Line ends folded to line feeds, other control characters dropped."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def attachment_ids(markdown: Column) -> Column:
    """Ids in image links to attachments, each once."""
    return F.array_distinct(F.regexp_extract_all(markdown, F.lit(r"!\[[^\]]*\]\(attachment:([0-9a-z-]+)\)"), 1))


def stem(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def localized(labels: Column, locale: Column, manifest: Column) -> Column:
    """A map's value for a locale; empty values don't count.

    In this order: the key itself; the first key whose primary subtag is the locale, whatever its case; then for the
    manifest's language, Japanese and English a key that is the language but for case, or the first with its primary
    subtag; then the first key.
    """
    full = F.map_filter(labels, lambda _, v: v.isNotNull() & (v != ""))
    keys = F.array_sort(F.map_keys(full))
    primary = lambda k: F.lower(F.split(k, "-")[0])
    first = lambda test: F.get(F.filter(keys, test), F.lit(0))
    found = [F.when(F.array_contains(keys, locale), locale), first(lambda k: primary(k) == F.lower(locale))]

    def of(language: Column) -> list[Column]:
        known = language.isNotNull() & (language != "")
        return [F.when(known, first(lambda k: F.lower(k) == F.lower(language))), F.when(known, first(lambda k: primary(k) == primary(language)))]

    found += [*of(manifest), *of(F.lit("ja")), *of(F.lit("en"))]
    return F.try_element_at(full, F.coalesce(*found, F.get(keys, F.lit(0))))


def has_language(labels: Column, lang: str) -> Column:
    return F.exists(F.map_keys(labels), lambda k: (k == lang) | k.startswith(lang + "-"))


def merge_maps(*maps: Column) -> Column:
    """Later maps win, whatever the session's policy on duplicate keys."""
    out = maps[0]
    for m in maps[1:]:
        out = F.map_concat(_without(out, m), m)
    return out


def _without(a: Column, b: Column) -> Column:
    return F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k))


def byte_range(header: Column, size: Column) -> Column:
    """A single byte range of a header over ``size`` bytes: struct(kind, first, last); kinds whole, range, unsatisfiable.

    A header that isn't one valid range counts as none.
    """
    spec = F.regexp_extract(F.trim(header), r"(?i)^bytes=\s*([0-9]*-[0-9]*)\s*$", 1)
    digits = [F.regexp_extract(spec, p, 1) for p in ("^([0-9]*)-", "-([0-9]*)$")]
    # null for a number that is too large, as well as for none
    first, last = (F.when(d.try_cast("long") <= LARGEST, d.try_cast("long")) for d in digits)
    whole = F.struct(F.lit("whole").alias("kind"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))
    no = F.struct(F.lit("unsatisfiable").alias("kind"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))
    some = lambda a, b: F.struct(F.lit("range").alias("kind"), a.cast("long").alias("first"), b.cast("long").alias("last"))
    return (
        F.when(header.isNull() | (spec == "") | (spec == "-"), whole)
        .when(digits[0] == "", F.when(last.isNull() | (last <= 0) | (size == 0), no).otherwise(some(F.greatest(F.lit(0), size - last), size - 1)))
        .when(first.isNull(), whole)
        .when(first >= size, no)
        .when(digits[1] == "", some(first, size - 1))
        .when(last.isNull() | (last < first), whole)
        .otherwise(some(first, F.least(last, size - 1)))
    )


def due_state(due: Column, today: Column, soon: int = 3) -> Column:
    """overdue, due_soon, later or none of a strict YYYY-MM-DD text."""
    day = strict_date(due)
    left = F.datediff(day, today)
    return F.when(day.isNull(), "none").when(left < 0, "overdue").when(left <= soon, "due_soon").otherwise("later")


def strict_date(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from start to end, exact to the microsecond; the session's time zone has no say when both have none."""
    d = end - start
    part = lambda k: F.extract(F.lit(k), d)
    whole = (part("DAY") * 86_400 + part("HOUR") * 3_600 + part("MINUTE") * 60).cast("decimal(20,6)")
    return (whole + part("SECOND")).cast("double")


def in_day_window(minute: Column, start: Column, end: Column) -> Column:
    """Whether a minute of the day is in [start, end), which may pass midnight; no window (-1) holds all."""
    inside = F.when(start <= end, (minute >= start) & (minute < end)).otherwise((minute >= start) | (minute < end))
    return F.when((start < 0) | (end < 0), True).otherwise(inside)


def manifest_supported(version: Column) -> Column:
    return F.coalesce(version.rlike(r"^1\.0\.0(-[0-9A-Za-z.-]+)?$"), F.lit(False))


def feature_reference(value: Column) -> Column:
    """An id given as text or as an object with an id."""
    return F.coalesce(F.get_json_object(value, "$.id"), value)


def accessible(values: Column) -> Column:
    """No list or an empty one admits all; else it has to name wheelchair."""
    return F.coalesce(F.size(values) <= 0, F.lit(True)) | F.exists(values, lambda x: F.lower(x).contains("wheelchair"))


def canonical_zero(x: Column) -> Column:
    return F.when(x == 0, F.lit(0.0)).otherwise(x)


def request_hash(*pairs: tuple[str, Column]) -> Column:
    """SHA-256 of key=value lines in key order; nulls are kept as such."""
    lines = [F.concat(F.lit(f"{k}="), F.coalesce(c.cast("string"), F.lit("null"))) for k, c in sorted(pairs, key=lambda p: p[0])]
    return F.sha2(F.concat_ws("\n", *lines), 256)


def pack_rgb(value: Column) -> Column:
    """An integer as red, green and blue bytes, highest first."""
    return F.struct(F.shiftright(value, 16).bitwiseAND(255).alias("r"), F.shiftright(value, 8).bitwiseAND(255).alias("g"), value.bitwiseAND(255).alias("b"))


def unpack_rgb(rgb: Column) -> Column:
    return rgb["r"] * 65536 + rgb["g"] * 256 + rgb["b"]
