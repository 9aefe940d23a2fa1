"""Registered queries: smoke, plans, and the differential check against DuckDB."""
import pytest

import __spark_entry__ as E
from checks.compare import compare, duck_connect
from checks.oracle import ORACLE
from stockboard.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "risiko_score" in df.columns


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE) and set(QUERIES) <= set(E.queries())


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], ORACLE[name], SF)
    assert r.get("ok"), r


def test_delivery_date_bound_is_pushed_to_parquet(spark):
    p = E.queries()["scan_deliveries"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in p


def test_kpi_board_scans_part_once_and_nothing_else(spark):
    p = plan_of(E.queries()["kpi_board"](spark, SF))
    assert p.count("part.parquet") == 1
    assert "lineitem.parquet" not in p          # unused plant join removed by Catalyst


def test_filters_reach_the_parquet_reader_on_stored_entities(spark):
    """Written once as entity tables, the dashboard filter's IN lists and the
    v2 plant filter are pushed into the scan; the text search stays a Filter."""
    import os
    import uuid
    from stockboard.operators import contracts as K
    from stockboard.operators.filters import apply_filters
    from stockboard.plans import products as P
    from stockboard.session import ensure_checkpoint_dir
    from stockboard.sources import scans as S
    from stockboard.sources import views as V
    from stockboard.sources.tables import read_entity
    path = os.path.join(ensure_checkpoint_dir(spark), "test-entities", uuid.uuid4().hex, "materials")
    V.materials(spark, SF).write.parquet(path)
    mats = read_entity(spark, path, K.MATERIALS)
    flat = apply_filters(S.scan_materials_flat(mats),
                         {"status": ["Aktiv", "Gesperrt"], "werk": ["NATION_3"], "search": "red"})
    p = plan_of(flat)
    assert "In(status, [Aktiv,Gesperrt])" in p or "In(status, [Gesperrt,Aktiv])" in p
    assert "EqualTo(werk_name,NATION_3)" in p or "In(werk_name, [NATION_3])" in p
    v2 = P.material_overview_v2(mats, P.MaterialParams(werk=("W-3", "W-7")))
    assert "In(werk_id, [W-3,W-7])" in plan_of(v2)
    assert flat.count() == E.queries()["apply_filters"](spark, SF).where(
        "werk = 'NATION_3' and status in ('Aktiv', 'Gesperrt')").count()


def test_survey_facts_at_sf01(spark):
    """Class and status splits that the blueprint measured on these views at sf0.1."""
    base = "/root/testdata/sf0.1"
    hist = {r.risiko_klasse: r.lieferanten for r in E.queries()["risk_class_histogram"](spark, base).collect()}
    assert hist == {"niedrig": 336, "mittel": 418, "hoch": 246}
    s = E.queries()["count_status"](spark, base).first()
    assert (s.aktiv, s.nicht_geliefert, s.obsolet, s.gesperrt) == (12713, 3286, 2374, 1627)


def test_supplier_risk_from_stored_entities_equals_view_result(spark):
    """Production path: entity tables stored with fixed schemas, joined on the
    text id; must equal the registered query, which joins on the numeric key."""
    import os
    import uuid
    from stockboard.operators import contracts as K
    from stockboard.plans import products as P
    from stockboard.plans.queries import SINCE
    from stockboard.session import ensure_checkpoint_dir
    from stockboard.sources import scans as S
    from stockboard.sources import views as V
    from stockboard.sources.tables import read_entity
    root = os.path.join(ensure_checkpoint_dir(spark), "test-entities", uuid.uuid4().hex)
    V.suppliers(spark, SF).select(*S.SUPPLIER_COLUMNS).write.parquet(f"{root}/suppliers")
    V.deliveries(spark, SF).select(*S.DELIVERY_COLUMNS).write.parquet(f"{root}/deliveries")
    stored = P.supplier_risk(read_entity(spark, f"{root}/suppliers", K.SUPPLIERS),
                             read_entity(spark, f"{root}/deliveries", K.DELIVERIES),
                             P.RiskParams(seit=SINCE))
    registered = E.queries()["supplier_risk"](spark, SF)
    assert sorted(tuple(r) for r in stored.collect()) == sorted(tuple(r) for r in registered.collect())
