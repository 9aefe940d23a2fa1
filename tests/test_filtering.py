"""Filter rules of the table view, each on a grid of rows with a known answer."""
import itertools
import json

import pytest
from pyspark.sql import functions as F

from stockboard.functions import predicates as PR
from stockboard.operators import aggregates as A
from stockboard.operators import filters as FL

STATES = ("Aktiv", "Obsolet", "Gesperrt")
PLANTS = ("Nord", "Süd")
GROUPS = ("Lager", "", None)


@pytest.fixture(scope="module")
def grid(spark):
    """One row for each state, plant and group (18); the stock is ten times the row number."""
    rows = [(f"P{i:02d}-{s[:2]}", f"{s} in {p}", g, p, s, "KG", 10 * i, None)
            for i, (s, p, g) in enumerate(itertools.product(STATES, PLANTS, GROUPS))]
    return spark.createDataFrame(rows, "material_nr string, bezeichnung string, warengruppe string, werk string, "
                                       "status string, einheit string, bestand long, geaendert string")


def kept(df):
    return sorted(int(r.material_nr[1:3]) for r in df.collect())


def expected(grid, test):
    return sorted(int(r.material_nr[1:3]) for r in grid.collect() if test(r))


@pytest.mark.parametrize("nothing", [None, {}, {"status": []}, {"search": " \t"}, {"ohne_klass": 0}, {"unbekannt": 1}])
def test_without_an_active_filter_nothing_is_planned(grid, nothing):
    assert FL.apply_filters(grid, nothing) is grid


CASES = {
    "one state": ({"status": ["Obsolet"]}, lambda r: r.status == "Obsolet"),
    "states are alternatives": ({"status": ["Obsolet", "Aktiv"]}, lambda r: r.status != "Gesperrt"),
    "dimensions add up": ({"status": ["Aktiv"], "werk": ["Süd"]}, lambda r: (r.status, r.werk) == ("Aktiv", "Süd")),
    "a chosen blank group is the blank one": ({"warengruppe": [""]}, lambda r: r.warengruppe == ""),
    "unclassified is blank or missing": ({"ohne_klass": True}, lambda r: not r.warengruppe),
    "text in the name, any case, umlauts too": ({"search": "  SÜD"}, lambda r: r.werk == "Süd"),
    "text in the number": ({"search": "-ob"}, lambda r: r.status == "Obsolet"),
    "text does not run over into the next column": ({"search": "ak aktiv"}, lambda r: False),
    "all at once": ({"status": ["Gesperrt"], "werk": ["Nord"], "ohne_klass": True, "search": "p1"},
                    lambda r: (r.status, r.werk) == ("Gesperrt", "Nord") and not r.warengruppe),
}


@pytest.mark.parametrize("name", CASES)
def test_filters(grid, name):
    state, rule = CASES[name]
    assert kept(FL.apply_filters(grid, state)) == expected(grid, rule)


def test_state_is_read_from_loose_input():
    s = FL.FilterState.normalize({"werk": ("Nord",), "search": " a b ", "ohne_klass": "yes", "status": None, "x": 3})
    assert s == FL.FilterState(werk=("Nord",), search="a b", ohne_klass=True)
    assert s.updated({"search": "", "status": ["Aktiv"]}) == FL.FilterState(status=("Aktiv",), werk=("Nord",),
                                                                            ohne_klass=True)


def test_blank_means_empty_not_white_space(spark):
    groups = spark.createDataFrame([(g,) for g in ("", " ", "\t", "x", None)], "warengruppe string")
    assert groups.where(PR.unclassified()).count() == 2


@pytest.mark.parametrize("conditions, rule", [
    ([("bestand", ">=", 90), ("bestand", "<", 130)], lambda r: 90 <= r.bestand < 130),
    ([("werk", "!=", "nord")], lambda r: r.werk == "Süd"),
    ([("bezeichnung", "contains", "LET IN n")], lambda r: r.status == "Obsolet" and r.werk == "Nord")])
def test_column_filters(grid, conditions, rule):
    assert kept(grid.where(PR.column_filters(conditions, numeric_columns=["bestand"]))) == expected(grid, rule)


def test_column_filter_knows_its_operators():
    with pytest.raises(ValueError):
        PR.column_filter("bestand", "=~", 1)


def test_tiles_filter_and_say_whether_they_do(grid):
    for tile, _, _, flt in A.KPI_DEFINITIONS:
        want = expected(grid, lambda r: (not flt["status"] or r.status in flt["status"])
                        and (not flt["ohne_klass"] or not r.warengruppe))
        assert kept(FL.kpi_drilldown(grid, tile)) == want
        assert FL.kpi_is_active(tile, {**flt, "search": "anything", "werk": ["Nord"]})
        assert not FL.kpi_is_active(tile, {"status": ["Aktiv", "Obsolet"], "ohne_klass": True})
    with pytest.raises(KeyError):
        FL.kpi_state("no such tile")


def test_board_counts_what_its_tiles_filter(grid):
    board = A.kpi_board(grid).orderBy("position").collect()
    assert [r.kpi_id for r in board] == [k[0] for k in A.KPI_DEFINITIONS] and [r.position for r in board] == [1, 2, 3, 4, 5]
    for r in board:
        assert r.value == FL.apply_filters(grid, json.loads(r.filter)).count()


def test_labels_may_hold_quotes(spark):
    from stockboard.operators import contracts as K
    odd = K.T.StructType([K.T.StructField("it's", K.S, False)])
    got = K.contract_violations(spark.createDataFrame([(None,), ("x",)], "`it's` string"), odd).collect()
    assert [(r.feld, r.regel, r.verstoesse) for r in got] == [("it's", "required", 1), ("it's", "type", 0)]


def test_counter_and_values(grid):
    r = A.record_counter(grid, FL.filter_predicate({"werk": ["Süd"]})).first()
    assert (r.gefiltert, r.gesamt, r.anzeige) == (9, 18, "9 / 18 Datensätze")
    assert A.record_counter(grid, None).first().gefiltert == 18
    assert [r.wert for r in A.distinct_values(grid, "warengruppe").collect()] == ["Lager"]
    counts = A.count_status(grid).first()
    assert (counts.aktiv, counts.nicht_geliefert, counts.obsolet, counts.gesperrt) == (6, 0, 6, 6)
    assert A.count_unclassified(grid.where(F.col("werk") == "Nord")).first()[0] == 6
