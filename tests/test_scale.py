"""Plan properties that matter at scale: hot keys, no pair enumeration."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from stockboard.plans.queries import QUERIES
from stockboard.operators import aggregates as A
from stockboard.operators import keyed as KY
from stockboard.plans import products as P

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def skewed(spark):
    """60 000 deliveries; supplier HOT holds a third of them."""
    return (spark.range(60000)
            .select(F.when(F.col("id") % 3 == 0, F.lit("HOT"))
                     .otherwise(F.format_string("L-%03d", F.col("id") % 97)).alias("lieferant_id"),
                    F.lit("MAT-1").alias("material_nr"),
                    F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") % 7).cast("int")).alias("geliefert_am"),
                    F.lit("2026-01-03").cast("date").alias("zugesagt_am"),
                    F.lit(10).alias("menge"),
                    (F.col("id") % 10 == 0).cast("int").alias("reklamationen")))


def test_hot_supplier_is_combined_map_side(spark, skewed):
    kpis = A.delivery_kpis(skewed.repartition(8))
    p = plan_of(kpis)
    assert "partial_count" in p and "partial_avg" in p
    hot = kpis.where("lieferant_id = 'HOT'").first()
    assert hot.lieferungen == 20000


def test_hot_supplier_risk_is_exact(spark, skewed):
    sup = spark.createDataFrame([("HOT", "Heiss", "DE", 1)],
                                "lieferant_id string, lieferant_name string, land string, anzahl_materialien long")
    r = P.supplier_risk(sup, skewed, P.RiskParams(seit=dt.date(2026, 1, 1))).first()
    assert r.lieferungen == 20000


def test_latest_per_key_plans_no_window(spark, skewed):
    latest = KY.latest_per_key(skewed, "lieferant_id", ["geliefert_am"])
    p = plan_of(latest)
    assert "Window" not in p and "partial_max" in p
    assert latest.count() == 98


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_or_nested_loop(spark, name):
    p = plan_of(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_risk_classes_sum_to_suppliers(spark):
    q = QUERIES
    hist = sum(r.lieferanten for r in q["risk_class_histogram"](spark, SF).collect())
    assert hist == q["supplier_risk"](spark, SF).count()


def test_results_do_not_depend_on_session_time_zone(spark):
    q = QUERIES["upsert_by_key"]
    before = sorted(tuple(r) for r in q(spark, SF).collect())
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        after = sorted(tuple(r) for r in q(spark, SF).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert before == after


SPLIT_ALL = {"spark.sql.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
             "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def splitting(spark):
    """No broadcasts, and partitions count as skewed from 1 KB on."""
    old = {k: spark.conf.get(k, None) for k in SPLIT_ALL}
    for k, v in SPLIT_ALL.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ran(df):
    rows = df.collect()                                # runs this DataFrame's own adaptive plan
    return rows, plan_of(df)


def test_hot_supplier_in_the_plant_links_is_split(spark, splitting):
    """One supplier is the lowest of a third of all parts: the join in plant_links itself is split."""
    from stockboard.sources import views as V
    ids = spark.range(1, 30001)
    lineitem = ids.select(F.col("id").alias("l_partkey"),
                          F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 500 + 2).alias("l_suppkey"))
    supplier = spark.range(1, 600).select(F.col("id").alias("s_suppkey"), (F.col("id") % 25).alias("s_nationkey"))
    rows, p = ran(V.plant_links(lineitem, supplier))
    assert "SortMergeJoin(skew=true)" in p and "AQEShuffleRead skewed" in p
    assert len(rows) == 30000 and {r.plant_key for r in rows if r.material_key % 19 == 0} == {None}
    assert all(r.plant_key == 1 for r in rows if r.material_key % 3 == 0 and r.material_key % 19)


def test_hot_material_in_the_graph_edges_is_split(spark, splitting):
    """One material holds a third of all supplier links."""
    from stockboard.sources.graph import to_graph_edges
    ids = spark.range(30000)
    links = ids.select(F.col("id").alias("supplier_key"),
                       F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 900).alias("material_key"))
    mats = spark.range(800).select(F.col("id").alias("material_key"), F.lit("W-1").alias("werk_id"),
                                   F.lit("").alias("warengruppe"))
    text = F.col("material_key").cast("string")
    rows, p = ran(to_graph_edges(mats, links, key="material_key", supplier_key="supplier_key",
                                 material_text=lambda c: c.cast("string"), supplier_text=lambda c: c.cast("string")))
    del text
    assert "SortMergeJoin(skew=true)" in p
    want = sum(1 for i in range(30000) if i % 3 == 0 or i % 900 < 800)
    assert sum(r.rel == "SUPPLIES" for r in rows) == want and sum(r.rel == "LOCATED_IN" for r in rows) == 800


def test_no_python_worker_in_any_registered_query(spark):
    for name, q in QUERIES.items():
        p = plan_of(q(spark, SF))
        assert not any(x in p for x in ("MapInPandas", "EvalPython", "InArrow", "FlatMapGroups")), name
