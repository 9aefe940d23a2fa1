"""Rules of the material overview, the risk score and the plant load, stated on generated rows."""
import datetime as dt

import pytest

from stockboard.functions.columns import risk_class
from stockboard.operators import contracts as K
from stockboard.plans import products as P

DAY = dt.date(2026, 5, 11)


def materials(spark, *rows):
    """Rows as dicts; what is not given is null."""
    return spark.createDataFrame([tuple(r.get(c) for c in K.MATERIALS.names) for r in rows], K.MATERIALS)


@pytest.fixture(scope="module")
def shelf(spark):
    """Nine materials: stock null, 0 or 40, group null, blank or named; price 0.125 each."""
    return materials(spark, *[
        {"material_nr": f"T-{i}", "bezeichnung": ("Bolzen kurz", "Feder", None)[i % 3], "status": "Aktiv",
         "warengruppe": (None, "", "Norm")[i // 3], "bestand": (None, 0, 40)[i % 3], "preis": 0.125,
         "werk_id": f"W{i % 2}", "werk_name": f"Halle {i % 2}"} for i in range(9)])


def numbers(df):
    return sorted(int(r.material_nr[2:]) for r in df.collect())


def test_value_is_stock_times_price_and_unknown_without_stock(shelf):
    values = {int(r.material_nr[2:]): r.bestandswert for r in P.material_overview_v2(shelf).collect()}
    assert values == {i: (None, 0.0, 5.0)[i % 3] for i in range(9)}


@pytest.mark.parametrize("params, want", [
    ({"ohne_klassifizierung": True}, range(6)),
    ({"warengruppe": ("Norm",)}, (6, 7, 8)),
    ({"warengruppe": ("",)}, ()),                                  # blank has become null before
    ({"suche": "FEDER"}, (1, 4, 7)),
    ({"suche": "t-3 bol"}, (3,)),                                  # number and name are one text
    ({"suche": "none"}, ()),                                       # a missing name is no text
    ({"suche": " t-5 "}, (5,)),
    ({"werk": ("W1",)}, (1, 3, 5, 7)),
    ({"status": ("Obsolet",)}, ()),
    ({"min_bestandswert": 0.01}, (2, 5, 8)),
    ({"min_bestandswert": 0}, range(9)),                           # an unknown value counts as none
    ({"werk": ("W0",), "suche": "bolzen", "ohne_klassifizierung": True}, (0,))])
def test_overview_parameters(shelf, params, want):
    assert numbers(P.material_overview_v2(shelf, P.MaterialParams(**params))) == list(want)


def test_versions_differ_in_their_columns(shelf):
    one, two = P.material_overview_v1(shelf), P.material_overview_v2(shelf)
    assert K.conforms(one, K.MATERIAL_V1) and K.conforms(two, K.MATERIAL_V2)
    assert numbers(P.material_overview_v1(shelf, P.MaterialParams(werk=("Halle 1",)))) == [1, 3, 5, 7]
    assert {r.werk for r in one.collect()} == {"Halle 0", "Halle 1"}
    assert all(r.warengruppe in (None, "Norm") for r in two.collect())


def risk(spark, by_supplier, **params):
    """by_supplier: id -> [(delay, complaints), ...]; each is a supplier of one material."""
    master = spark.createDataFrame([(s, s.lower(), "CH", 1) for s in by_supplier], K.SUPPLIERS)
    rows = [(s, "T-1", DAY + dt.timedelta(days=d), DAY, 1, c) for s, ds in by_supplier.items() for d, c in ds]
    found = P.supplier_risk(master, spark.createDataFrame(rows, K.DELIVERIES), P.RiskParams(**{"seit": dt.date(2026, 4, 1), **params}))
    return {r.lieferant_id: r for r in found.collect()}


def test_score_is_made_of_delay_lateness_and_complaints(spark):
    got = risk(spark, {"NONE": [(0, 0)] * 3, "HALF": [(7, 0), (7, 0)], "ALL": [(14, 1)], "BEYOND": [(90, 0)],
                       "GRUMBLE": [(0, 2), (0, 0), (-3, 0), (0, 1)]})
    assert {k: (r.risiko_score, r.risiko_klasse) for k, r in got.items()} == {
        "NONE": (0.0, "niedrig"), "HALF": (55.0, "mittel"), "ALL": (100.0, "hoch"), "BEYOND": (80.0, "hoch"),
        "GRUMBLE": (10.0, "niedrig")}
    assert got["BEYOND"].mittlerer_verzug_tage == 90.0 and got["GRUMBLE"].reklamationsquote_pct == 50.0


def test_means_are_taken_before_limits_and_signs_of_zero_go(spark):
    got = risk(spark, {"MIX": [(-6, 0), (6, 0)], "EARLY": [(-1, 0), (1, 0), (0, 0)]})
    assert got["MIX"].risiko_score == 15.0 and got["MIX"].mittlerer_verzug_tage == 0.0
    assert repr(got["EARLY"].mittlerer_verzug_tage) == "0.0"


@pytest.mark.parametrize("tolerance, on_time", [(0, 25.0), (1, 50.0), (5, 75.0), (30, 100.0)])
def test_tolerance_counts_days_late(spark, tolerance, on_time):
    got = risk(spark, {"S": [(0, 0), (1, 0), (5, 0), (30, 0)]}, toleranz_tage=tolerance)
    assert got["S"].liefertreue_pct == on_time


def test_least_number_of_deliveries(spark):
    data = {"IDLE": [], "BUSY": [(0, 0)] * 4, "OLD": []}
    assert set(risk(spark, data)) == {"BUSY"} and set(risk(spark, data, min_lieferungen=5)) == set()
    idle = risk(spark, data, min_lieferungen=0)["IDLE"]
    assert (idle.lieferungen, idle.liefertreue_pct, idle.risiko_score) == (0, 100.0, 0.0)
    assert set(risk(spark, data, min_lieferungen=0, risiko_klasse=("hoch",))) == set()
    assert risk(spark, {}) == {}


def test_deliveries_count_from_the_day_on(spark):
    assert risk(spark, {"S": [(0, 0), (9, 0)]}, seit=DAY + dt.timedelta(days=9))["S"].lieferungen == 1


def test_class_follows_the_shown_score(spark):
    from pyspark.sql import functions as F
    scores = spark.createDataFrame([(29.94,), (29.96,), (59.94,), (59.96,)], "s double")
    assert [r[0] for r in scores.select(risk_class(F.round("s", 1))).collect()] == ["niedrig", "mittel", "mittel", "hoch"]


@pytest.mark.parametrize("make", [lambda: P.RiskParams(toleranz_tage=-1), lambda: P.RiskParams(toleranz_tage=31),
                                  lambda: P.RiskParams(min_lieferungen=-1), lambda: P.MaterialParams(min_bestandswert=-.1),
                                  lambda: P.plant_load_product(None, -1)])
def test_parameters_out_of_range(make):
    with pytest.raises(ValueError):
        make()


def test_plant_load(spark):
    rows = [{"material_nr": n, "werk_id": w, "werk_name": name, "bestand": b} for n, w, name, b in (
        ("T-1", "A", "zwei", 3), ("T-1", "A", "eins", 4), ("T-2", "A", "zwei", None), ("T-3", None, None, 8),
        ("T-4", "B", None, None))]
    got = {r.werk_id: tuple(r)[1:] for r in P.plant_load_product(materials(spark, *rows)).collect()}
    assert got == {"A": ("eins", 3, 7), None: (None, 1, 8), "B": (None, 1, 0)}
    assert [r.werk_id for r in P.plant_load_product(materials(spark, *rows), 2).collect()] == ["A"]
