"""Scalar functions on their edge cases."""

import pytest
from pyspark.sql import functions as F

from floorspan.functions import floors, geo, text


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_strict_floor_labels(spark):
    cases = {"F1": 0.0, "F36": 35.0, "b1": -1.0, "M2": 2.0, "KB3": -3.0, "SB4F": -4.0, " f2 ": 1.0, "R": None, "": None, "F1X": None, "garbage": None, None: None}
    got = values(spark, [(k,) for k in cases], "s string", floors.label_to_ordinal(F.col("s")))
    assert [x for (x,) in got] == list(cases.values())


def test_wide_floor_tokens(spark):
    cases = {"B2FL(1FL)_x(TP-5.11)": -2.0, "GF": 0.0, "3階": 2.0, "地下2階": -2.0, "floor12": 11.0, "0fl": 0.0, "RF": None, "x-10f": 9.0, "m3": 3.0, "kb3": -3.0, "61f": None, "f2f": None, "": None}
    got = values(spark, [(k,) for k in cases], "s string", floors.layer_to_ordinal(F.col("s")))
    assert [x for (x,) in got] == list(cases.values())


def test_reduced_labels(spark):
    cases = {"Ｂ１Ｆ": "b1", "地下1階": "b1", "L1": "1", "1F": "1", "roof": "roof", "lobby": "lobby", "Level 3": "3", "!!": None}
    got = values(spark, [(k,) for k in cases], "s string", floors.reduce_label(F.col("s")))
    assert [x for (x,) in got] == list(cases.values())


def test_uuid_range_and_dates(spark):
    ids = [("0123456789ab4def8123456789abcdef",), ("01234567-89AB-4DEF-8123-456789ABCDEF",), ("nope",), (None,)]
    want = "01234567-89ab-4def-8123-456789abcdef"
    assert [x for (x,) in values(spark, ids, "s string", text.uuid4(F.col("s")))] == [want, want, None, None]
    heads = [("bytes=0-9", 5), ("bytes=-3", 10), ("bytes=-0", 10), ("bytes=9-", 9), ("bytes=5-2", 9), (None, 3), ("bytes=1-", 3), ("bytes=-", 3)]
    got = [(r.kind, r.first, r.last) for (r,) in values(spark, heads, "h string, n long", text.byte_range(F.col("h"), F.col("n")).alias("r"))]
    assert got == [("range", 0, 4), ("range", 7, 9), ("unsatisfiable", None, None), ("unsatisfiable", None, None), ("whole", None, None), ("whole", None, None), ("range", 1, 2), ("whole", None, None)]
    days = [("2024-02-29",), ("2023-02-29",), ("2024-2-1",), (None,)]
    assert [x for (x,) in values(spark, days, "d string", text.due_state(F.col("d"), F.lit("2024-02-27").cast("date")))] == ["due_soon", "none", "none", "none"]


def test_localized_and_merge(spark):
    d = spark.sql("SELECT map('ja-JP', 'a', 'en-GB', 'b') AS m, map() AS e")
    pick = lambda loc: text.localized(F.col("m"), F.lit(loc), F.lit("fr"))
    # a locale matches a key itself or a key's primary subtag; one that does neither falls back to Japanese
    assert tuple(d.select(pick("en-GB"), pick("en"), pick("en-US"), pick("de")).first()) == ("b", "b", "a", "a")
    blank = F.create_map(F.lit("en"), F.lit(""), F.lit("FR-ca"), F.lit("c"), F.lit("zh"), F.lit("z"))
    assert tuple(d.select(text.localized(blank, F.lit("en"), F.lit("fr-BE")), text.localized(blank, F.lit("de"), F.lit(None).cast("string"))).first()) == ("c", "c")
    m = text.merge_maps(F.col("m"), F.create_map(F.lit("en-GB"), F.lit("c")))
    assert d.select(m.alias("m")).first().m == {"ja-JP": "a", "en-GB": "c"}


def test_nfkc(spark):
    assert values(spark, [("ｶﾞ①",), (None,)], "s string", text.nfkc(F.col("s"))) == [("ガ1",), (None,)]


def test_day_window_passes_midnight(spark):
    rows = [(1380, 60, 1400), (1380, 60, 30), (1380, 60, 60), (-1, 5, 3), (10, 20, 20)]
    got = values(spark, rows, "s int, e int, t int", text.in_day_window(F.col("t"), F.col("s"), F.col("e")))
    assert [x for (x,) in got] == [True, True, False, True, False]


@pytest.mark.parametrize(("x", "y", "inside"), [(1.0, 1.0, True), (3.0, 1.0, False), (-1.0, 1.0, False), (1.0, 5.0, False)])
def test_ring(spark, x, y, inside):
    ring = geo.rectangle(*map(F.lit, (0.0, 0.0, 2.0, 2.0)))
    r = spark.range(1).select(geo.in_ring(F.lit(x), F.lit(y), ring), geo.ring_area(ring), geo.ring_centroid(ring)).first()
    assert r[0] is inside and r[1] == 4.0 and tuple(r[2]) == (1.0, 1.0)


def test_haversine_of_a_degree(spark):
    d = spark.range(1).select(geo.haversine(*map(F.lit, (0.0, 0.0, 1.0, 0.0)))).first()[0]
    assert abs(d - 111_194.93) < 0.1
