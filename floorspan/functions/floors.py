"""Floor labels, ordinals and level names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes and prefixes that a floor label loses beside a digit.
STOREY_SUFFIXES = ("階", "floor", "fl", "f")
LEVEL_PREFIXES = ("level", "lvl", "l")


def label_to_ordinal(label: Column) -> Column:
    """Strict floor label: F<n> is n - 1, B<n> and <letters>B<n> are -n, M<n> is n; one F may follow; else null."""
    s = F.upper(F.trim(label))
    pattern = r"^([A-Z]+)([0-9]{1,9})F?$"
    kind, n = F.regexp_extract(s, pattern, 1), F.regexp_extract(s, pattern, 2).try_cast("int")
    value = F.when(kind == "F", n - 1).when(kind == "M", n).when((kind == "B") | kind.rlike("^[A-Z]+B$"), -n)
    return value.cast("double")


def token_to_ordinal(token: Column) -> Column:
    """One lower-case token of a layer name by the wide table of spellings; floors 0 to 60, basements 1 to 10."""
    number = lambda p: F.regexp_extract(token, p, 1).try_cast("int")
    up = number("^(?:f|floor)?([0-9]{1,2})(?:f|階|fl|floor)?$")
    # one mark only: on one side of the number, or none
    marks = ~token.rlike("^(?:f|floor)[0-9]+(?:f|階|fl|floor)$") & ~token.rlike("^[a-z]*0[0-9]")
    down = F.coalesce(number("^b([0-9]{1,2})(?:f|fl|floor)?$"), number("^(?:bf|basement)([0-9]{1,2})$"), number("^([0-9]{1,2})b$"), number("^地下([0-9]{1,2})(?:階|f|fl)$"))
    return (
        F.when(token.isin("gf", "g階", "ground"), 0)
        .when(token.isin("0", "f0", "0f", "0fl", "0floor", "floor0"), 0)
        .when(marks & up.between(1, 60), up - 1)
        .when(down.between(1, 10), -down)
        .when(token.rlike("^m[0-9]{1,9}$"), number("^m([0-9]+)$"))
        .when(token.rlike("^[a-z]+b[0-9]{1,9}f?$"), -number("^[a-z]+b([0-9]+)f?$"))
    ).cast("double")


def layer_to_ordinal(text: Column) -> Column:
    """The leading token decides if it names a floor; else the longest token that does, the first of equals."""
    s = F.trim(text)
    leading = token_to_ordinal(F.lower(F.split(s, r"[_\s（(　]+")[0]))
    tokens = F.filter(F.split(F.lower(s), r"[_\-\s.]+"), lambda x: x != "")
    placed = F.transform(tokens, lambda x, i: F.struct((-F.length(x)).alias("k"), i.alias("i"), token_to_ordinal(x).alias("v")))
    best = F.array_min(F.filter(placed, lambda x: x["v"].isNotNull()))["v"]
    return F.when(s != "", F.coalesce(leading, best))


STRUCTURED = r"(?i)^(.*)_(B[0-9]+|M[0-9]+|F?[0-9]+|R|RF|0)_(Drawing|Fixture|Floor|Space|Opening|Facility|Occupant|detail|level|unit|amenity)$"


def layer_parts(layer: Column) -> tuple[Column, Column, Column]:
    """Building, floor token and category of a structured layer name; nulls where it isn't one."""
    part = lambda i: F.when(layer.rlike(STRUCTURED), F.regexp_extract(layer, STRUCTURED, i))
    return part(1), part(2), part(3)


def layer_floor(layer: Column) -> Column:
    """A structured name counts by its floor token only, any other by all its tokens."""
    return F.when(layer.rlike(STRUCTURED), layer_to_ordinal(layer_parts(layer)[1])).otherwise(layer_to_ordinal(layer))


def layer_target(layer: Column) -> Column:
    """The feature type that a layer's name suggests; a layer between floors is detail."""
    s = F.lower(layer)
    ends = lambda *xs: F.coalesce(*[F.when(s.endswith(x), True) for x in xs], F.lit(False))
    return (
        F.when(s.contains("_to_"), "detail")
        .when(ends("_floor", "_level"), "level")
        .when(ends("_space", "_unit"), "unit")
        .when(ends("_opening"), "opening")
        .when(ends("_drawing", "_detail", "_nw"), "detail")
        .when(ends("_fixture"), "fixture")
        .when(ends("_facility", "_amenity") | s.isin("facility_merge", "wifi", "beacon", "net_junction") | s.startswith("point_facility"), "amenity")
        .when(ends("_occupant"), "occupant")
        .when((s == "net_path") | ends("_link"), "detail")
    )


def ordinal_to_label(ordinal: Column) -> Column:
    n = F.round(ordinal).cast("int")
    return F.when(n >= 0, F.concat(F.lit("F"), n + 1)).otherwise(F.concat(F.lit("B"), -n))


def reduce_label(label: Column) -> Column:
    """A label's comparable form: half-width, lower, letters and digits only, without a storey suffix after a digit
    and a level prefix before one; null when nothing is left."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
    thin = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
    s = F.regexp_replace(F.replace(F.lower(F.translate(label, wide, thin)), F.lit("地下"), F.lit("b")), r"[^\p{L}\p{N}]", "")
    s = F.regexp_replace(s, f"(?<=[0-9])(?:{'|'.join(STOREY_SUFFIXES)})$", "")
    s = F.regexp_replace(s, f"^(?:{'|'.join(LEVEL_PREFIXES)})(?=[0-9])", "")
    return F.nullif(s, F.lit(""))


def label_candidates(label: Column) -> Column:
    """The comparable forms of a whole label and of its first word."""
    first = F.split(F.trim(F.translate(label, "　", " ")), r"\s+")[0]
    return F.array_distinct(F.array_compact(F.array(reduce_label(label), reduce_label(first))))


def composite_level_id(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)
