"""Category codes, roles, colours and encodings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Internal category codes and the category of each.
VENUE_CODES = {
    "A001": "transitstation", "A002": "airport", "A003": "stadium", "A004": "shoppingcenter", "A005": "conventioncenter", "A006": "governmentfacility",
    "A007": "medicalfacility", "A008": "welfare", "A009": "communitycenter", "A010": "hotel", "A011": "parkingfacility", "A012": "university", "A013": "theater",
    "A014": "aquarium", "A015": "museum", "A016": "other", "A017": "retailstore", "A018": "shoppingcenter", "A019": "resort", "A020": "themepark", "A021": "casino",
    "A022": "other", "A023": "businesscampus", "A024": "publictoilet", "A999": "other",
}
UNIT_CODES = {
    "B001": "retail", "B002": "office", "B003": "publicfacility", "B004": "waitingroom", "B005": "tickets", "B006": "information", "B007": "restroom.male",
    "B008": "restroom.female", "B009": "restroom.unisex", "B010": "restroom", "B011": "restroom", "B012": "restroom", "B013": "restroom", "B014": "restroom",
    "B015": "smokingarea", "B016": "mothersroom", "B017": "firstaid", "B018": "room", "B019": "room", "B020": "opentobelow", "B021": "stairs", "B022": "elevator",
    "B023": "escalator", "B024": "walkway", "B025": "walkway", "B026": "nonpublic", "B027": "parking", "B028": "platform", "B029": "walkway",
}
FIXTURE_CODES = {
    "C001": "column", "C002": "bench", "C003": "reception", "C004": "cubicle", "C005": "rubbishbin", "C006": "furniture", "C007": "kiosk", "C008": "obstruction",
    "C009": "vegetation", "C010": "wall", "C011": "water", "C012": "locker", "C013": "vendingmachine", "C014": "atm", "C015": "stage", "C016": "fence",
    "C017": "twsi.hazard", "C018": "twsi.guidance", "C019": "twsi.crossing", "C101": "platform.screen", "C102": "platform.gate", "C103": "ticket.vending",
    "C104": "ticketgate", "C201": "baggage.carousel", "C202": "checkin.kiosk", "C999": "unspecified",
}
#: Parts of category names and the role of each; the first that a name holds decides.
ROLES = (
    ("escalator", "escalator"), ("elevator", "elevator"), ("lift", "elevator"), ("stair", "stairs"), ("ramp", "ramp"), ("run", "stairs"), ("landing", "stairs"),
    ("support", "structure"), ("door", "opening"), ("opening", "opening"), ("window", "opening"), ("ceiling", "ceiling"), ("roof", "ceiling"), ("floor", "walkable"),
    ("slab", "walkable"), ("wall", "structure"), ("column", "structure"), ("structural", "structure"), ("stair rail", "structure"), ("railing", "structure"),
    ("room", "public"), ("retail", "public"), ("shop", "public"), ("office", "service"), ("mechanical", "service"), ("plumbing", "service"),
    ("electrical", "service"), ("restricted", "restricted"), ("staff", "restricted"),
)
#: Categories of surfaces by role; conveyances come first, all others are public.
CONVEYANCES = {"elevator": "elevator", "escalator": "escalator", "stairs": "stairs", "steps": "stairs", "ramp": "ramp", "movingwalkway": "ramp"}
WALKABLE = ("walkway", "pedestrian", "concourse", "corridor", "lobby", "plaza", "footbridge", "parkingcirculation", "platform", "walkwayisland")
SERVICE = (
    "office", "mechanicalroom", "electricalroom", "serverroom", "storage", "structure", "utilityroom", "serviceyard", "loadingdock", "phoneroom", "smokingarea",
    "laboratory", "kitchen",
)
RESTRICTED = ("nonpublic", "restricted", "unenclosedarea", "road", "parking", "driveway")
DEFAULT_COLOUR = "#808080"


def _table(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def category_of_code(raw: Column) -> Column:
    """A code's category, its table's default for an unknown code; what isn't a code stays as it is."""
    code = F.trim(raw)
    known = F.coalesce(_table(VENUE_CODES | UNIT_CODES | FIXTURE_CODES)[code], F.when(code.startswith("A"), "other").otherwise("unspecified"))
    return F.when(code.rlike("^[ABC][0-9]+$"), known).otherwise(raw)


def role_of_category(category: Column) -> Column:
    s = F.lower(category)
    return F.coalesce(*[F.when(s.contains(part), role) for part, role in ROLES], F.when(category.isNotNull(), "context"))


def occlusion(role: Column) -> Column:
    return F.when(role == "ceiling", "protected_corridor").when(role.isin("structure", "context"), "context").otherwise("never")


def surface_role(category: Column) -> Column:
    moved = _table(CONVEYANCES)[category]
    return F.coalesce(moved, F.when(category.isin(*WALKABLE), "walkable").when(category.isin(*SERVICE), "service").when(category.isin(*RESTRICTED), "restricted").otherwise("public"))


def fixture_form(category: Column) -> Column:
    return F.when(category == "ticketgate", "automatic_gate").otherwise("absent")


def fill(value: Column, names: dict[str, str]) -> Column:
    """A colour by name, a literal #RGB or #RRGGBB as it is, grey for other text, null for none."""
    named = _table(names)[value] if names else F.lit(None)
    return F.when(value.isNull() | (value == ""), None).otherwise(F.coalesce(named, F.when(value.rlike("^#([0-9a-fA-F]{3}|[0-9a-fA-F]{6})$"), value), F.lit(DEFAULT_COLOUR)))


def quantize(value: Column, least: Column, greatest: Column) -> Column:
    """A place between two bounds in 65,535 steps."""
    step = F.when(greatest > least, (greatest - least) / 65_535).otherwise(1.0)
    return F.least(F.lit(65_535), F.greatest(F.lit(0), F.round((value - least) / step))).cast("int")


def octahedral(x: Column, y: Column, z: Column) -> Column:
    """A direction as two signed 16-bit numbers: the octahedron's lower half is folded over its upper one."""
    total = F.greatest(F.abs(x) + F.abs(y) + F.abs(z), F.lit(1e-7))
    u, v = x / total, y / total
    sign = lambda t: F.when(t >= 0, 1.0).otherwise(-1.0)
    fold = lambda a, b: F.when(z < 0, (1 - F.abs(b)) * sign(a)).otherwise(a)
    whole = lambda t: F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), t)) * 32_767).cast("int")
    return F.array(whole(fold(u, v)), whole(fold(v, u)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def direction(encoded: Column) -> Column:
    """The unit vector (x, y, z) of two signed 16-bit numbers that ``octahedral`` made."""
    return bound(encoded, _direction)


def _direction(encoded: Column) -> Column:
    u, v = F.get(encoded, F.lit(0)) / 32_767.0, F.get(encoded, F.lit(1)) / 32_767.0
    z = 1 - F.abs(u) - F.abs(v)
    sign = lambda t: F.when(t >= 0, 1.0).otherwise(-1.0)
    x, y = F.when(z < 0, (1 - F.abs(v)) * sign(u)).otherwise(u), F.when(z < 0, (1 - F.abs(u)) * sign(v)).otherwise(v)
    size = F.greatest(F.sqrt(x * x + y * y + z * z), F.lit(1e-7))
    return F.struct((x / size).alias("x"), (y / size).alias("y"), (z / size).alias("z"))


def inverse(m: Column) -> Column:
    """The inverse of a 4 x 4 matrix in row order, by cofactors; null where the determinant is 0."""
    return bound(m, _inverse)


def _inverse(m: Column) -> Column:
    e = lambda i, j: F.get(m, F.lit(4 * i + j))
    rest = lambda k: [i for i in range(4) if i != k]

    def minor(i: int, j: int) -> Column:
        (a, b, c), (p, q, r) = rest(i), rest(j)
        return e(a, p) * (e(b, q) * e(c, r) - e(b, r) * e(c, q)) - e(a, q) * (e(b, p) * e(c, r) - e(b, r) * e(c, p)) + e(a, r) * (e(b, p) * e(c, q) - e(b, q) * e(c, p))

    det = sum((e(0, j) * minor(0, j) * (-1) ** j for j in range(1, 4)), e(0, 0) * minor(0, 0))
    adjugate = F.array(*[minor(j, i) * (-1) ** (i + j) for i in range(4) for j in range(4)])
    return bound(det, lambda d: F.when(d != 0, F.transform(adjugate, lambda x: x / d)))


def product(a: Column, b: Column, n: int = 4) -> Column:
    """The product of two n x n matrices in row order."""
    return bound(F.struct(a.alias("a"), b.alias("b")), lambda m: _product(m["a"], m["b"], n))


def _product(a: Column, b: Column, n: int) -> Column:
    cell = lambda i, j: sum((F.get(a, F.lit(i * n + k)) * F.get(b, F.lit(k * n + j)) for k in range(1, n)), F.get(a, F.lit(i * n)) * F.get(b, F.lit(j)))
    return F.array(*[cell(i, j) for i in range(n) for j in range(n)])
