"""Keyed operators: latest version, collisions, upsert, mappings, validation."""
import pytest

from stockboard.operators import keyed as KY
from stockboard.plans import products as P


def test_latest_skips_deprecated(spark):
    df = spark.createDataFrame([("p", 1, False), ("p", 2, True), ("q", 1, True), ("q", 3, True)],
                               "name string, major int, deprecated boolean")
    got = {r.name: r.major for r in KY.latest_version(df, "name", ["major"], "deprecated").collect()}
    assert got == {"p": 1, "q": 3}


def test_latest_is_deterministic_on_ties(spark):
    df = spark.createDataFrame([("k", 1, "b"), ("k", 1, "a"), ("k", 1, "c")], "k string, v int, x string")
    assert KY.latest_per_key(df.repartition(3), "k", ["v"]).first().x == "c"


def test_key_collisions(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1), (2, 1), (2, 1)], "a int, b int")
    got = {(r.a, r.b): r.anzahl for r in KY.key_collisions(df, ["a", "b"]).collect()}
    assert got == {(1, 1): 2, (2, 1): 3}


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, v int, val string")
    changes = spark.createDataFrame([("b", 2, "Y"), ("b", 3, "YY"), ("c", 1, "z")], "k string, v int, val string")
    once = KY.upsert_by_key(base, changes, "k", ["v"])
    twice = KY.upsert_by_key(once, changes, "k", ["v"])
    want = {("a", 1, "x"), ("b", 3, "YY"), ("c", 1, "z")}
    assert {tuple(r) for r in once.collect()} == want
    assert {tuple(r) for r in twice.collect()} == want


def test_apply_mappings_overrides_group_with_latest_valid(spark):
    mats = spark.createDataFrame([("M1", "alt"), ("M2", None), ("M3", "bleibt")],
                                 "material_nr string, warengruppe string")
    maps = spark.createDataFrame([("M1", "neu1", 1, 1), ("M1", "neu2", 2, 1), ("M2", "gesetzt", 1, 1),
                                  ("M3", "", 5, 1)],
                                 "material_nr string, ziel_warengruppe string, geaendert_am int, version int")
    got = {r.material_nr: r.warengruppe for r in KY.apply_mappings(mats, maps).collect()}
    assert got == {"M1": "neu2", "M2": "gesetzt", "M3": "bleibt"}


def test_split_valid_reasons(spark):
    df = spark.createDataFrame([("M1", "G", None), ("", "G", None), ("M3", None, None),
                                ("M4", "G" * 81, None), ("M5", "G", "k" * 501), ("M6", "G", "ok")],
                               "material_nr string, ziel_warengruppe string, kommentar string")
    got = {r.material_nr: r.grund for r in KY.split_valid(df).collect()}
    assert got == {"M1": None, "": "material_nr zu kurz", "M3": "ziel_warengruppe fehlt",
                   "M4": "ziel_warengruppe zu lang", "M5": "kommentar zu lang", "M6": None}


def test_product_table():
    def made(version, **more):
        return P.Product("kanban", version, P.plant_load_product, (), (), 10, **more)
    assert P.find_product("material-overview").major == 2
    assert P.find_product("material-overview", 1).deprecated
    for name, major in (("material-overview", 9), ("kanban", None)):
        with pytest.raises(KeyError):
            P.find_product(name, major)
    with pytest.raises(ValueError, match="twice"):
        P.by_name_and_major([made("3.0"), made("3.4")])
    for version in ("3", "x.1", "3.", ""):
        with pytest.raises(ValueError):
            P.by_name_and_major([made(version)])
    assert set(P.by_name_and_major([made("3.0"), made("4.1")])) == {("kanban", 3), ("kanban", 4)}


def test_upsert_reads_each_input_once_and_needs_no_join(spark):
    base = spark.range(50).selectExpr("id as k", "1 as v")
    p = KY.upsert_by_key(base, spark.range(7).selectExpr("id as k", "2 as v"), "k", ["v"]) \
        ._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in p and p.count("Range (") == 2


def test_absent_required_column_is_missing_everywhere(spark):
    rows = KY.split_valid(spark.createDataFrame([("M1", "k")], "material_nr string, kommentar string")).collect()
    assert [r.grund for r in rows] == ["ziel_warengruppe fehlt"]
    only = spark.createDataFrame([("M1", "G")], "material_nr string, ziel_warengruppe string")
    assert KY.split_valid(only).first().grund is None                     # the comment is optional


def test_latest_per_key_with_dotted_column_names(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b")], "`MATERIAL-NR.` string, v int, `GEÄNDERT.x` string")
    got = KY.latest_per_key(df, "MATERIAL-NR.", ["v"]).collect()
    assert [tuple(r) for r in got] == [("k", 2, "b")]
