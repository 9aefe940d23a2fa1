"""Paging, envelope meta, contracts, column selection and labels."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from stockboard.operators import contracts as K
from stockboard.operators import paging as PG
from stockboard.sources import generate as G


@pytest.fixture(scope="module")
def mats(spark):
    return G.generate_materials(spark.range(64).withColumnRenamed("id", "i"))


def test_limit_offset(mats):
    page = PG.page(mats, [F.col("material_nr").asc()], limit=10, offset=5)
    rows = page.collect()
    assert len(rows) == 10
    everything = [r.material_nr for r in mats.orderBy("material_nr").collect()]
    assert [r.material_nr for r in rows] == everything[5:15]
    meta = PG.envelope_meta(mats, product="material-overview", version="2.0",
                            generated_at=dt.datetime(2026, 1, 1), limit=10, offset=5,
                            sources=["neo4j"]).first()
    assert (meta.row_count, meta.total_count, meta.source) == (10, 64, "neo4j")


def test_page_plan_is_take_ordered(mats):
    page = PG.page(mats, [F.col("material_nr").asc()], limit=10, offset=5)
    assert "TakeOrderedAndProject" in page._jdf.queryExecution().executedPlan().toString()


def test_pages_concatenate_to_the_whole(mats):
    pages = []
    for n in range(4):
        pages += [tuple(r) for r in PG.sorted_page(mats, "bestand", "desc", page_no=n).collect()]
    whole = [tuple(r) for r in mats.orderBy(*PG.total_order(mats, [F.col("bestand").desc_nulls_last()])).collect()]
    assert pages == whole


def test_page_limits():
    with pytest.raises(ValueError):
        PG.check_page(0, 0)
    with pytest.raises(ValueError):
        PG.check_page(50_001, 0)
    with pytest.raises(ValueError):
        PG.check_page(10, -1)


def test_source_label():
    assert PG.source_label(["postgres", "neo4j", "neo4j"]) == "neo4j+postgres"
    assert PG.source_label([]) == "none"


def test_contract_violations(spark):
    df = spark.createDataFrame([("A", "Aktiv", "ST"), (None, "Kaputt", "ST"), ("C", None, "XX")],
                               "material_nr string, status string, einheit string")
    contract = K.T.StructType([f for f in K.MATERIAL_V1.fields if f.name in ("material_nr", "status", "einheit", "werk")])
    got = {(r.feld, r.regel): r.verstoesse for r in K.contract_violations(df, contract).collect()}
    assert got[("material_nr", "required")] == 1
    assert got[("status", "domain")] == 1
    assert got[("einheit", "domain")] == 1
    assert got[("werk", "missing")] == 3


def test_visible_and_labels(spark):
    df = spark.createDataFrame([("M", "B", "G", "W", "Aktiv", "ST", 1, "x")],
                               "material_nr string, bezeichnung string, warengruppe string, werk string, "
                               "status string, einheit string, bestand long, geaendert string")
    assert K.visible_columns(df, []).columns == ["material_nr", "bezeichnung"]
    assert K.visible_columns(df, None).columns == df.columns
    assert K.visible_columns(df, ["bestand"]).columns == ["material_nr", "bezeichnung", "bestand"]
    assert K.label_columns(df).columns[-1] == "GEÄNDERT"


def test_format_and_lookup(spark):
    from stockboard.functions.columns import format_thousands, lookup_constant, normalize_change_date
    df = spark.createDataFrame([(1234567, "Aktiv", "05.03.2026"), (12, "Unbekannt", "2026-03-05"),
                                (None, None, "5.3.26x")], "n long, s string, d string")
    rows = df.select(format_thousands("n"), lookup_constant("s", {"Aktiv": "#2e9e5b"}),
                     normalize_change_date("d")).collect()
    assert [tuple(r) for r in rows] == [("1.234.567", "#2e9e5b", dt.date(2026, 3, 5)),
                                        ("12", None, dt.date(2026, 3, 5)), (None, None, None)]


def test_keyset_pages_equal_offset_pages(mats):
    order = [F.col("bestand").desc(), F.col("material_nr").desc()]
    cursor, got = None, []
    for _ in range(7):
        rows = PG.page_after(mats, ["bestand", "material_nr"], cursor, limit=10, descending=True).collect()
        if not rows:
            break
        got += [r.material_nr for r in rows]
        cursor = (rows[-1].bestand, rows[-1].material_nr)
    assert got == [r.material_nr for r in mats.orderBy(*order).collect()]
    assert [r.material_nr for r in PG.page_after(mats, ["material_nr"], None, 5).collect()] == \
        [r.material_nr for r in PG.page(mats, [F.col("material_nr").asc()], 5).collect()]


def test_respond_pages_and_describes(mats):
    from stockboard.plans.products import find_product, respond
    prod = find_product("material-overview", 1)
    r = respond(prod, mats, [F.col("material_nr").asc()], generated_at=dt.datetime(2026, 1, 1),
                limit=10, offset=5)
    assert r.data.count() == 10
    meta = r.meta.first()
    assert (meta.row_count, meta.total_count, meta.deprecated, meta.sunset) == (10, 64, True, dt.date(2026, 12, 31))
    again = respond(prod, mats, [F.col("material_nr").asc()], generated_at=dt.datetime(2027, 1, 1),
                    limit=10, offset=5)
    assert again.tag.first() == r.tag.first()


def test_labelled_columns_page_and_fingerprint(spark):
    from stockboard.operators.aggregates import content_fingerprint
    df = spark.createDataFrame([("M", "B", "G", "W", "Aktiv", "ST", i, "x") for i in range(30)],
                               "material_nr string, bezeichnung string, warengruppe string, werk string, "
                               "status string, einheit string, bestand long, geaendert string")
    labelled = K.label_columns(df)
    assert [r["BESTAND"] for r in PG.sorted_page(labelled, "BESTAND", "desc", page_no=1, size=5).collect()] == \
        [24, 23, 22, 21, 20]
    assert content_fingerprint(labelled).first().n_rows == 30
