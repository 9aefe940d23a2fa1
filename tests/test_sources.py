"""Generators, graph tables, fingerprint and snapshots."""
import datetime as dt
import os
import uuid

from pyspark.sql import functions as F

from stockboard.operators.aggregates import content_fingerprint
from stockboard.sources import generate as G
from stockboard.sources import graph as GR
from stockboard.sources import snapshots as SN
from stockboard.session import ensure_checkpoint_dir


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_generated_materials_are_partition_independent(spark):
    one = G.generate_materials(spark.range(0, 500, 1, 1).withColumnRenamed("id", "i"))
    eight = G.generate_materials(spark.range(0, 500, 1, 8).withColumnRenamed("id", "i"))
    assert rows(one) == rows(eight)


def test_generated_domains_and_weights(spark):
    df = G.generate_materials(spark.range(20000).withColumnRenamed("id", "i"))
    assert df.where(~F.col("status").isin(list(G.STATUSES))).count() == 0
    assert df.where(~F.col("warengruppe").isin(list(G.GROUPS))).count() == 0
    stats = df.agg(F.min("bestand"), F.max("bestand"), F.min("preis"), F.max("preis"),
                   F.avg((F.col("status") == "Aktiv").cast("double"))).first()
    assert stats[0] >= 300 and stats[1] <= 9800 and stats[2] >= 0.5 and stats[3] <= 480.0
    assert 0.53 < stats[4] < 0.57
    first = df.orderBy("i").first()
    assert first.material_nr == "MAT-100777"


def test_generated_deliveries(spark):
    sup = spark.createDataFrame([("L-001",), ("L-002",)], "lieferant_id string")
    d = G.generate_deliveries(sup, 64)
    assert d.count() == 80
    bad = d.where((F.datediff("geliefert_am", "zugesagt_am") < 0) | (F.col("menge") < 10)
                  | (F.col("menge") > 899) | ~F.col("reklamationen").isin(0, 1, 2))
    assert bad.count() == 0
    assert d.agg(F.min("zugesagt_am")).first()[0] == dt.date(2026, 1, 1)


def test_sample_without_replacement(spark):
    sup = spark.createDataFrame([(f"L-{i:03d}",) for i in range(20)], "lieferant_id string")
    mats = G.generate_materials(spark.range(64).withColumnRenamed("id", "i"))
    links = G.sample_supplier_links(sup, mats, 64, 8, 30)
    per = {r.lieferant_id: (r.n, r.d) for r in links.groupBy("lieferant_id")
           .agg(F.count("*").alias("n"), F.countDistinct("material_nr").alias("d")).collect()}
    assert len(per) == 20
    assert all(8 <= n <= 30 and n == d for n, d in per.values())
    again = G.sample_supplier_links(sup.repartition(4), mats, 64, 8, 30)
    assert rows(links) == rows(again)


def test_graph_tables_and_purge(spark):
    mats = spark.createDataFrame([("M1", "a", "G1", "W1", "Werk 1"), ("M2", "b", "", "W1", "Werk 1"),
                                  ("M3", "c", None, None, None)],
                                 "material_nr string, bezeichnung string, warengruppe string, werk_id string, werk_name string")
    sups = spark.createDataFrame([("L1", "S1", ["M1", "M2", "M9"])],
                                 "lieferant_id string, lieferant_name string, materialien array<string>")
    nodes = GR.to_graph_nodes(mats, sups)
    edges = GR.to_graph_edges(mats, GR.unwind_links(sups))
    per = {r.label: r.anzahl for r in GR.nodes_per_label(nodes).collect()}
    assert per == {"Material": 3, "Werk": 1, "Warengruppe": 1, "Lieferant": 1}
    rels = sorted(r.rel for r in edges.collect())
    assert rels == ["HAS_WARENGRUPPE", "LOCATED_IN", "LOCATED_IN", "SUPPLIES", "SUPPLIES"]
    assert set(nodes.columns) == set(GR.NODE_COLUMNS)
    kept_nodes, kept_edges = GR.purge_label(nodes, edges, "Werk")
    assert kept_nodes.where(F.col("label") == "Werk").count() == 0
    assert sorted(r.rel for r in kept_edges.collect()) == ["HAS_WARENGRUPPE", "SUPPLIES", "SUPPLIES"]


def test_fingerprint_properties(spark):
    df = spark.createDataFrame([(i, f"x{i}") for i in range(200)], "a long, b string")
    base = content_fingerprint(df).first()
    assert content_fingerprint(df.repartition(7)).first() == base
    dup = df.unionByName(df.limit(1))
    assert content_fingerprint(dup).first().fingerprint != base.fingerprint
    edited = df.withColumn("b", F.when(F.col("a") == 5, "y").otherwise(F.col("b")))
    assert content_fingerprint(edited).first().fingerprint != base.fingerprint


def test_snapshot_states(spark):
    root = os.path.join(ensure_checkpoint_dir(spark), "test-snap", uuid.uuid4().hex)
    t0 = dt.datetime(2026, 1, 1, 12, 0, 0)
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x long, y string")
    k1 = SN.snapshot_key("p", 1, {"a": 1})
    k2 = SN.snapshot_key("q", 1, {"a": 1})
    assert k1 != SN.snapshot_key("p", 1, {"a": 2})
    assert SN.materialize_snapshot(df, root, k1, "p", t0, 0) == "bypass"
    assert SN.read_snapshot(spark, root, k1, t0)[1] == "miss"
    SN.materialize_snapshot(df, root, k1, "p", t0, 60)
    SN.materialize_snapshot(df.limit(1), root, k2, "q", t0, 60)
    data, state = SN.read_snapshot(spark, root, k1, t0 + dt.timedelta(seconds=30))
    assert state == "hit" and rows(data) == [(1, "a"), (2, "b")]
    assert SN.read_snapshot(spark, root, k1, t0 + dt.timedelta(seconds=61))[1] == "miss"
    SN.invalidate_snapshots(spark, root, t0 + dt.timedelta(seconds=40), product="p")
    assert SN.read_snapshot(spark, root, k1, t0 + dt.timedelta(seconds=45))[1] == "miss"
    data2, state2 = SN.read_snapshot(spark, root, k2, t0 + dt.timedelta(seconds=45))
    assert state2 == "hit" and data2.count() == 1


def test_sample_matches_brute_force(spark):
    """Recompute every supplier's sample in plain Python and compare exactly."""
    import hashlib

    def drawn(*parts):
        return int(hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)
    ids = [f"L-{i:06d}" for i in range(1, 41)]
    sup = spark.createDataFrame([(i,) for i in ids], "lieferant_id string")
    for n, k_min, k_max in ((50, 3, 9), (5, 3, 9), (1, 1, 1)):
        mats = G.generate_materials(spark.range(n).withColumnRenamed("id", "i"), 7)
        links = G.sample_supplier_links(sup, mats, n, k_min, k_max, 7)
        want = set()
        for sid in ids:
            low, high = min(k_min, n), min(k_max, n)
            k, taken = low + drawn(7, "k", sid) % (high - low + 1), []
            for j in range(n - k, n):
                t = drawn(7, "pick", sid, j) % (j + 1)
                taken.append(j if t in taken else t)
            assert len(set(taken)) == k
            want |= {(sid, f"MAT-{100777 + 13 * i}") for i in taken}
        assert {tuple(r) for r in links.collect()} == want


def test_dense_index(spark):
    keys = spark.createDataFrame([(k,) for k in (900, 5, 5, 70000, 3, 140001)], "k long")
    assert rows(G.dense_index(keys, "k", ranges=3)) == [(0, 3), (1, 5), (2, 900), (3, 70000), (4, 140001)]


def snap_root(spark):
    return os.path.join(ensure_checkpoint_dir(spark), "test-snap", uuid.uuid4().hex)


T0 = dt.datetime(2026, 1, 1, 12, 0, 0)


def test_two_products_in_one_root_keep_their_own_columns(spark):
    root = snap_root(spark)
    SN.materialize_snapshot(spark.createDataFrame([(1, "a")], "x long, y string"), root, "p:1", "p", T0, 60)
    SN.materialize_snapshot(spark.createDataFrame([(2.5,)], "z double"), root, "q:1", "q", T0, 60)
    p, q = (SN.read_snapshot(spark, root, k, T0)[0] for k in ("p:1", "q:1"))
    assert (p.columns, rows(p)) == (["x", "y"], [(1, "a")]) and (q.columns, rows(q)) == (["z"], [(2.5,)])


def test_empty_snapshots(spark):
    root, full = snap_root(spark), spark.createDataFrame([(1,)], "x long")
    SN.materialize_snapshot(full.limit(0), root, "k", "p", T0, 60)
    data, state = SN.read_snapshot(spark, root, "k", T0)
    assert state == "hit" and data.columns == ["x"] and rows(data) == []
    SN.materialize_snapshot(full, root, "k", "p", T0 + dt.timedelta(seconds=1), 60)
    SN.materialize_snapshot(full.limit(0), root, "k", "p", T0 + dt.timedelta(seconds=2), 60)
    assert rows(SN.read_snapshot(spark, root, "k", T0 + dt.timedelta(seconds=2))[0]) == []


def test_a_snapshot_is_good_up_to_its_end(spark):
    root = snap_root(spark)
    SN.materialize_snapshot(spark.range(2), root, "k", "p", T0, 60)
    assert SN.read_snapshot(spark, root, "k", T0 + dt.timedelta(seconds=60))[1] == "hit"
    assert SN.read_snapshot(spark, root, "k", T0 + dt.timedelta(seconds=60, microseconds=1))[1] == "miss"


def test_get_or_build_builds_once_and_counts_what_ends(spark):
    root, built = snap_root(spark), []

    def build():
        built.append(1)
        return spark.range(3)
    states = [SN.get_or_build(spark, root, "k", "p", T0, ttl, build)[1] for ttl in (60, 60, 0)]
    assert states == ["miss", "hit", "bypass"] and len(built) == 2
    SN.materialize_snapshot(spark.range(1), root, "other", "q", T0, 60)
    assert SN.invalidate_snapshots(spark, root, T0, "p") == 1
    assert SN.invalidate_snapshots(spark, root, T0) == 1                  # only q is left
    assert SN.invalidate_snapshots(spark, root, T0) == 0


def test_compaction_keeps_what_is_live(spark):
    root = snap_root(spark)
    for i in range(4):
        SN.materialize_snapshot(spark.range(i), root, f"k{i % 2}", "p", T0 + dt.timedelta(seconds=i), 60)
    SN.materialize_snapshot(spark.range(9), root, "gone", "q", T0, 60)
    SN.invalidate_snapshots(spark, root, T0 + dt.timedelta(seconds=5), "q")
    now = T0 + dt.timedelta(seconds=6)
    assert SN.compact_manifest(spark, root, now) == 2
    assert [SN.read_snapshot(spark, root, k, now)[0].count() for k in ("k0", "k1")] == [2, 3]
    assert SN.read_snapshot(spark, root, "gone", now)[1] == "miss"
    SN.invalidate_snapshots(spark, root, now)
    assert SN.compact_manifest(spark, root, now) == 0
    assert SN.read_snapshot(spark, root, "k0", now)[1] == "miss"


def test_no_nested_loop_in_snapshot_reads(spark):
    root = snap_root(spark)
    SN.materialize_snapshot(spark.range(2), root, "k", "p", T0, 60)
    p = SN.valid_snapshots(spark, root, T0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_fingerprint_tells_nulls_and_separators_apart(spark):
    tags = [content_fingerprint(spark.createDataFrame([r], "a string, b string")).first().fingerprint
            for r in ((None, "x"), ("-", "x"), ("\\N", "x"), ("1:x", None), ("a1:b", "c"), ("a", "1:bc"), ("", "x"))]
    assert len(set(tags)) == len(tags)
    one = spark.createDataFrame([("v", 1)], "a string, n int")
    assert content_fingerprint(one).first() != content_fingerprint(one.withColumnRenamed("n", "m")).first()


def test_read_entity_refuses_other_layouts(spark):
    import pytest
    from stockboard.operators import contracts as K
    from stockboard.sources.tables import read_entity
    path = os.path.join(ensure_checkpoint_dir(spark), "test-entity", uuid.uuid4().hex)
    mats = spark.createDataFrame([], K.MATERIALS)
    mats.drop("preis").withColumn("bestand", F.col("bestand").cast("string")).write.parquet(path + "/bad")
    with pytest.raises(ValueError, match="bestand is string.*preis is missing"):
        read_entity(spark, path + "/bad", K.MATERIALS)
    mats.withColumn("extra", F.lit(1)).write.parquet(path + "/good")
    assert read_entity(spark, path + "/good", K.MATERIALS).columns == K.MATERIALS.names


def test_a_table_that_grows_is_read_anew(spark):
    from stockboard.sources import tables, views
    base = os.path.join(ensure_checkpoint_dir(spark), "test-grow", uuid.uuid4().hex)
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    part.write.parquet(f"{base}/part.parquet")
    for t in ("lineitem", "supplier", "nation"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{base}/{t}.parquet")
    before = views.materials(spark, base).count()
    part.withColumn("p_partkey", F.col("p_partkey") + 10_000).write.mode("append").parquet(f"{base}/part.parquet")
    assert views.materials(spark, base).count() == 2 * before == tables.read_table(spark, base, "part").count()


def test_group_links_fan_out(spark):
    from stockboard.sources.scans import scan_materials
    nodes = spark.createDataFrame([(1, "M1")], "material_key long, material_nr string")
    nodes = nodes.select("*", *[F.lit(None).cast("string").alias(c) for c in
                                ("bezeichnung", "status", "einheit", "bestand", "preis", "geaendert")])
    two = spark.createDataFrame([(1, 10), (1, 11)], "material_key long, plant_key long")
    plants = spark.createDataFrame([(10, "W-10", "a"), (11, "W-11", "b")], "plant_key long, werk_id string, werk_name string")
    groups = spark.createDataFrame([(1, "G1"), (1, "G2"), (2, "G3")], "material_key long, warengruppe string")
    got = {(r.werk_id, r.warengruppe) for r in scan_materials(nodes, two, plants, groups).collect()}
    assert got == {(w, g) for w in ("W-10", "W-11") for g in ("G1", "G2")}


def test_scan_materials_fans_out_and_keeps_unlocated(spark):
    from stockboard.sources.scans import scan_materials
    nodes = spark.createDataFrame(
        [(1, "M1", "a", "G", "Aktiv", "ST", 1, 1.0, "x"), (2, "M2", "b", None, "Aktiv", "ST", 2, 2.0, "y"),
         (3, "M3", "c", "", "Obsolet", "L", None, 3.0, "z")],
        "material_key long, material_nr string, bezeichnung string, warengruppe string, status string, "
        "einheit string, bestand long, preis double, geaendert string")
    links = spark.createDataFrame([(1, 10), (1, 11), (2, 99)], "material_key long, plant_key long")
    plants = spark.createDataFrame([(10, "W-10", "Werk 10"), (11, "W-11", "Werk 11")],
                                   "plant_key long, werk_id string, werk_name string")
    got = sorted((r.material_nr, r.werk_id) for r in scan_materials(nodes, links, plants).collect())
    assert got == [("M1", "W-10"), ("M1", "W-11"), ("M2", None), ("M3", None)]


def test_to_records_keeps_nulls(spark):
    import json
    df = spark.createDataFrame([("a", 1, None), ("b", None, 2.5)], "k string, n long, x double")
    recs = sorted(json.loads(r.record)["k"] + str(json.loads(r.record)) for r in SN.to_records(df).collect())
    assert recs[0].endswith("{'k': 'a', 'n': 1, 'x': None}")
    assert recs[1].endswith("{'k': 'b', 'n': None, 'x': 2.5}")


def test_snapshot_reads_are_as_of_their_clock(spark):
    root = os.path.join(ensure_checkpoint_dir(spark), "test-snap", uuid.uuid4().hex)
    t0 = dt.datetime(2026, 1, 1, 12, 0, 0)
    df = spark.createDataFrame([(1,)], "x long")
    key = SN.snapshot_key("p", 1, {})
    SN.materialize_snapshot(df, root, key, "p", t0, 600)
    SN.invalidate_snapshots(spark, root, t0 + dt.timedelta(seconds=100), product="p")
    assert SN.read_snapshot(spark, root, key, t0 + dt.timedelta(seconds=50))[1] == "hit"
    assert SN.read_snapshot(spark, root, key, t0 + dt.timedelta(seconds=150))[1] == "miss"
    assert SN.read_snapshot(spark, root, key, t0 - dt.timedelta(seconds=1))[1] == "miss"


def test_helpers_without_a_local_context(spark, monkeypatch):
    """The Connect-style branches: no JVM context, DataFrame API only."""
    from stockboard.session import ensure_checkpoint_dir as ecd
    from stockboard.sources import tables
    monkeypatch.setattr(tables, "_jvm_context", lambda s: None)
    root = os.path.join(ensure_checkpoint_dir(spark), "test-exists", uuid.uuid4().hex)
    assert not tables.path_exists(spark, root)
    spark.range(3).write.parquet(root)
    assert tables.path_exists(spark, root)
    assert ecd(spark) == spark.conf.get("spark.checkpoint.dir")
