"""The registered queries: every inventory operator applied to the entity
views of the test tables. Each entry is ``(spark, base_dir) -> DataFrame``;
every one reads whole tables and returns a lazy DataFrame (the snapshot and
JSON round trips write first, then return the read-back DataFrame).
"""
from __future__ import annotations

import datetime as dt
import functools
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockboard.functions import columns as C
from stockboard.functions import predicates as PR
from stockboard.operators import aggregates as A
from stockboard.operators import contracts as K
from stockboard.operators import filters as FL
from stockboard.operators import keyed as KY
from stockboard.operators import paging as PG
from stockboard.operators import tolerance as TL
from stockboard.operators import upkeep as UK
from stockboard.operators.ranking import Ranked
from stockboard.plans import products as P
from stockboard.session import ensure_checkpoint_dir
from stockboard.sources import generate as G
from stockboard.sources import graph as GR
from stockboard.sources import purge as PU
from stockboard.sources import scans as S
from stockboard.sources import search_index as SI
from stockboard.sources import snapshots as SN
from stockboard.sources import views as V
from stockboard.sources.tables import read_json_records, read_table

Query = Callable[[SparkSession, str], DataFrame]

# Fixed parameters of the registered queries.
SINCE = dt.date(1998, 1, 1)
SEED = 42
GENERATED_AT = dt.datetime(2026, 12, 3, 10, 42, 0)
MAPPING_SPLIT = "1998-01-01 00:00:00"          # compared as timestamp_ntz: no session zone
FILTER_STATE = {"status": ["Aktiv", "Gesperrt"], "werk": ["NATION_3", "NATION_7", "NATION_11"],
                "search": "  Red ", "ohne_klass": False}
V1_PARAMS = P.MaterialParams(status=("Aktiv", "Obsolet"), werk=("NATION_1", "NATION_2", "NATION_5"),
                             suche="o")
V2_PARAMS = P.MaterialParams(status=("Aktiv", "Nicht geliefert"), werk=("W-4", "W-9", "W-16"),
                             min_bestandswert=20000.0, suche="mat-10")


def _flat(spark, base):
    return S.scan_materials_flat(V.materials(spark, base))


def _risk(tol: int = 0, min_n: int = 1, classes: tuple[str, ...] = ()) -> Query:
    def q(spark: SparkSession, base: str) -> DataFrame:
        params = P.RiskParams(seit=SINCE, toleranz_tage=tol, min_lieferungen=min_n, risiko_klasse=classes)
        return P.supplier_risk(V.suppliers(spark, base), V.deliveries(spark, base), params,
                               key="supplier_key")
    return q


def _scratch(spark: SparkSession, name: str) -> str:
    root = ensure_checkpoint_dir(spark)
    return os.path.join(root, "stockboard", f"{name}-{uuid.uuid4().hex[:12]}")


def _edges(spark, base):
    return GR.to_graph_edges(V.materials(spark, base, keyed=True), V.supply_links(spark, base), key="material_key",
                             supplier_key="supplier_key", material_text=V.material_nr, supplier_text=V.supplier_id)


def _graph(spark, base):
    return GR.to_graph_nodes(V.materials(spark, base), V.supplier_master(spark, base)), _edges(spark, base)


def _graph_with_mock(spark, base):
    """The graph, with the blocked materials as nodes that carry the extra label Mock."""
    mats, blocked = V.materials(spark, base), F.col("status") == "Gesperrt"
    mock = GR.to_graph_nodes(mats.where(blocked), V.supplier_master(spark, base), ("Mock",))
    nodes = GR.to_graph_nodes(mats.where(~blocked), V.supplier_master(spark, base))
    return nodes.unionByName(mock.where(F.col("label") == "Material")), _edges(spark, base)


def _material_ids(spark, base):
    return read_table(spark, base, "part", ["p_partkey"]).select((F.col("p_partkey") - 1).alias("i"))


# --- scans, sources, sinks ---------------------------------------------------

def q_scan_materials(spark, base):
    return S.order_materials(V.materials(spark, base))


def q_scan_deliveries(spark, base):
    return S.order_deliveries(S.scan_deliveries(V.deliveries(spark, base), SINCE))


def q_generate_materials(spark, base):
    return G.generate_materials(_material_ids(spark, base), SEED)


def q_generate_deliveries(spark, base):
    n = _material_ids(spark, base).count()          # one scalar
    return G.generate_deliveries(V.suppliers(spark, base).select("lieferant_id"), n, SEED)


def q_sample_supplier_links(spark, base):
    ids = G.dense_index(read_table(spark, base, "part", ["p_partkey"]), "p_partkey").select("i")
    n = _material_ids(spark, base).distinct().count()          # one scalar
    return G.sample_supplier_links(V.supplier_master(spark, base), G.generate_materials(ids, SEED), n, 8, 30, SEED)


def q_graph_nodes(spark, base):
    return _graph(spark, base)[0].drop("labels")


def q_graph_edges(spark, base):
    return _edges(spark, base)


def q_purge_label(spark, base):
    return GR.purge_label(*_graph(spark, base), "Werk")[1]


def q_purge_mock_nodes(spark, base):
    return GR.purge_label(*_graph_with_mock(spark, base), "Mock")[0].drop("labels")


def q_purge_mock_edges(spark, base):
    return GR.purge_label(*_graph_with_mock(spark, base), "Mock")[1]


def q_purge_label_filtered(spark, base):
    """S9 with the filter ahead of the anti joins: the blocked materials and their edges go; edges that stay."""
    nodes, edges = GR.store_graph(*_graph_with_mock(spark, base), _scratch(spark, "graph"))
    return PU.purge_label_filtered(nodes, edges, "Mock")[1]


def q_scan_materials_from_graph(spark, base):
    return GR.scan_materials_from_graph(*_graph(spark, base))


def q_nodes_per_label(spark, base):
    return GR.nodes_per_label(_graph(spark, base)[0])


def q_records_json(spark, base):
    path = _scratch(spark, "records")
    SN.write_records(_risk()(spark, base), path)
    return read_json_records(spark, path, K.SUPPLIER_RISK_V1)


def q_snapshot_roundtrip(spark, base):
    root = _scratch(spark, "snapshots")
    params = {"seit": SINCE.isoformat(), "toleranz_tage": 0, "min_lieferungen": 1}
    key = SN.snapshot_key("supplier-risk", 1, params)
    SN.materialize_snapshot(_risk()(spark, base), root, key, "supplier-risk", GENERATED_AT, 300)
    data, state = SN.read_snapshot(spark, root, key, GENERATED_AT + dt.timedelta(seconds=60))
    if state != "hit":
        raise RuntimeError("snapshot not readable right after writing")
    return data


def q_snapshot_states(spark, base):
    """Miss, hit, another key, a product without lifetime, and after invalidation; the rows of each answer."""
    root, later = _scratch(spark, "snapshots"), GENERATED_AT + dt.timedelta(seconds=300)
    build, key = (lambda: _risk()(spark, base)), SN.snapshot_key("supplier-risk", 1, {"toleranz_tage": 0})
    other = SN.snapshot_key("supplier-risk", 1, {"toleranz_tage": 3})
    answers = [SN.get_or_build(spark, root, k, "supplier-risk", at, ttl, build)
               for k, at, ttl in ((key, GENERATED_AT, 300), (key, later, 300), (other, later, 300), (key, later, 0))]
    SN.invalidate_snapshots(spark, root, later, "supplier-risk")
    answers += [SN.get_or_build(spark, root, key, "supplier-risk", later, 300, build) for _ in range(2)]    # at the drop's time
    parts = [data.agg(F.lit(i).alias("schritt"), F.lit(state).alias("zustand"), F.count(F.lit(1)).alias("zeilen"))
             for i, (data, state) in enumerate(answers, start=1)]
    return functools.reduce(DataFrame.unionByName, parts)


# --- projections and computed columns ----------------------------------------

def q_blank_to_null(spark, base):
    m = V.materials(spark, base)
    return m.select("material_nr", C.blank_to_null("warengruppe").alias("warengruppe"))


def q_lenient_cast(spark, base):
    m = V.materials(spark, base)
    return m.select("material_nr", C.lenient_long(F.col("bestand").cast("string")).alias("bestand"),
                    C.lenient_long("status").alias("status_zahl"),
                    C.lenient_long(F.substring_index("material_nr", "-", -1)).alias("nummer"))


def q_stock_value(spark, base):
    m = V.materials(spark, base)
    return m.select("material_nr", "bestand", "preis", C.stock_value().alias("bestandswert"))


def q_delay_days(spark, base):
    d = V.deliveries(spark, base)
    return d.select("lieferant_id", "material_nr", "geliefert_am", "zugesagt_am",
                    C.delay_days().alias("verzug_tage"))


def _kpis_by_key(spark, base, tol: int = 0):
    recent = S.scan_deliveries(V.deliveries(spark, base), SINCE, extra=("supplier_key",))
    return A.delivery_kpis(recent, tol, key="supplier_key")


def _with_supplier_id(df):
    """Format the text id once per supplier, after aggregating on the number."""
    return df.select(V.supplier_id(F.col("supplier_key")).alias("lieferant_id"),
                     *[c for c in df.columns if c != "supplier_key"])


def q_supplier_kpis(spark, base):
    return P.supplier_kpis(V.suppliers(spark, base), _kpis_by_key(spark, base), "supplier_key") \
        .drop("supplier_key")


def q_supplier_kpis_filled(spark, base):
    return P.fill_defaults(q_supplier_kpis(spark, base))


def q_risk_score(spark, base):
    return _risk(min_n=0)(spark, base).select("lieferant_id", "risiko_score")


def q_risk_class_histogram(spark, base):
    return P.risk_class_histogram(_risk()(spark, base))


def q_visible_columns(spark, base):
    return K.visible_columns(_flat(spark, base), ["status", "bestand"])


def q_label_columns(spark, base):
    return K.label_columns(_flat(spark, base))


def q_format_thousands(spark, base):
    load = P.plant_load_product(V.materials(spark, base))
    return load.select("werk_id", "bestand_gesamt", C.format_thousands("bestand_gesamt").alias("bestand_text"))


def q_status_color(spark, base):
    return _flat(spark, base).select("material_nr", "status",
                                     C.lookup_constant("status", A.STATUS_COLORS).alias("farbe"))


def q_normalize_change_date(spark, base):
    m = V.materials(spark, base)
    return m.select("material_nr", "geaendert", C.normalize_change_date("geaendert").alias("geaendert_datum"))


# --- filters ------------------------------------------------------------------

def q_multiselect(spark, base):
    pred = PR.multiselect({"status": ["Aktiv", "Gesperrt"], "werk": ["NATION_3", "NATION_7"],
                           "warengruppe": []})
    return _flat(spark, base).where(pred)


def q_unclassified(spark, base):
    return _flat(spark, base).where(PR.unclassified("warengruppe"))


def q_search_any(spark, base):
    return _flat(spark, base).where(PR.search_any(["material_nr", "bezeichnung"], " BLUE "))


def q_search_joined(spark, base):
    return V.materials(spark, base).where(PR.search_joined(["material_nr", "bezeichnung"], "7 red"))


def q_min_stock_value(spark, base):
    return P.material_overview_v2(V.materials(spark, base), P.MaterialParams(min_bestandswert=50000.0))


def q_apply_filters(spark, base):
    return FL.apply_filters(_flat(spark, base), FILTER_STATE)


def q_apply_filters_empty(spark, base):
    return FL.apply_filters(_flat(spark, base), None)


def q_column_filters(spark, base):
    pred = PR.column_filters([("bestand", ">=", 1000), ("status", "=", "aktiv"),
                              ("bezeichnung", "contains", "GEAR")], numeric_columns=["bestand"])
    return _flat(spark, base).where(pred)


def q_kpi_drilldown(spark, base):
    return FL.kpi_drilldown(_flat(spark, base), "nicht_geliefert")


# --- joins ----------------------------------------------------------------------

def q_apply_mappings(spark, base):
    return KY.apply_mappings(V.materials(spark, base), V.mapping_events(spark, base))


# --- aggregations ---------------------------------------------------------------

def q_count_status(spark, base):
    return A.count_status(_flat(spark, base))


def q_count_unclassified(spark, base):
    return A.count_unclassified(_flat(spark, base))


def q_kpi_board(spark, base):
    return A.kpi_board(_flat(spark, base))


def q_delivery_kpis(spark, base, tol: int = 0):
    return _with_supplier_id(_kpis_by_key(spark, base, tol))


def q_delivery_kpis_by_tolerance(spark, base):
    """A4 for 0..30 days; the histograms of complaints and of the other deliveries are merged first."""
    recent = S.scan_deliveries(V.deliveries(spark, base), SINCE, extra=("supplier_key",))
    complaint = F.col("reklamationen") > 0
    parts = [TL.delay_histogram(recent.where(p), key="supplier_key") for p in (complaint, ~complaint)]
    return _with_supplier_id(TL.kpis_by_tolerance(TL.merge_histograms(*parts, key="supplier_key"), key="supplier_key"))


def _board_changes(flat: DataFrame) -> DataFrame:
    """Undelivered materials become active and classified, blocked ones are deleted, and each obsolete one gets a successor."""
    status = F.col("status")
    changed = flat.where(status.isin("Nicht geliefert", "Gesperrt")).select(
        "material_nr", "bezeichnung", F.coalesce(F.nullif("warengruppe", F.lit("")), F.lit("Neu")).alias("warengruppe"), "werk",
        F.when(status == "Nicht geliefert", "Aktiv").otherwise(status).alias("status"), "einheit", "bestand", "geaendert",
        (status == "Gesperrt").alias("geloescht"))
    successors = flat.where(status == "Obsolet").withColumn("material_nr", F.concat(F.lit("N-"), "material_nr")) \
        .withColumn("status", F.lit("Aktiv")).withColumn("geloescht", F.lit(False))
    return changed.unionByName(successors)


def q_kpi_board_after_changes(spark, base):
    """A3 and A11 from the state before and the changes alone."""
    flat = _flat(spark, base)
    delta = UK.board_delta(UK.signed_changes(flat, _board_changes(flat), "material_nr"))
    return UK.board_of(UK.add_deltas(UK.board_state(flat), delta))


def q_search_indexed(spark, base):
    """F3 and F4 through the index, and a needle too short for it."""
    index = SI.SearchIndex.build(V.materials(spark, base), _scratch(spark, "search"), "material_nr", ("material_nr", "bezeichnung"))
    found = {"any:blue": index.search_any(" BLUE "), "joined:7 red": index.search_joined("7 red"), "any:77": index.search_any("77")}
    return functools.reduce(DataFrame.unionByName, [rows.withColumn("suche", F.lit(name)) for name, rows in found.items()])


def q_plant_load(spark, base):
    return P.plant_load_product(V.materials(spark, base), 0)


def q_delivery_summary(spark, base):
    return _with_supplier_id(A.delivery_summary(V.deliveries(spark, base), key="supplier_key"))


def q_record_counter(spark, base):
    return A.record_counter(_flat(spark, base), FL.filter_predicate(FILTER_STATE))


def q_envelope_meta(spark, base):
    return PG.envelope_meta(_risk()(spark, base), product="supplier-risk", version="1.0",
                            generated_at=GENERATED_AT, limit=10, offset=5,
                            sources=["postgres", "neo4j"], cache="miss")


def q_distinct_values(spark, base):
    return A.distinct_values(_flat(spark, base), "werk")


def q_content_fingerprint(spark, base):
    part = read_table(spark, base, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"])
    return A.content_fingerprint(part.withColumn("p_retailprice", F.round(F.col("p_retailprice") * 100).cast("bigint")))


def q_content_fingerprint_nulls(spark, base):
    """Over rows with nulls, blanks and texts that hold the field separator."""
    flat = _flat(spark, base)
    return A.content_fingerprint(flat.withColumn("bezeichnung", F.when(F.col("bestand") > 2000, "-")
                                                 .otherwise(F.concat("bezeichnung", F.lit(":1:-")))))


# --- keyed / window-like ----------------------------------------------------------

def q_latest_version(spark, base):
    orders = read_table(spark, base, "orders")
    return KY.latest_version(orders, "o_custkey", ["o_orderdate", "o_orderkey"],
                             F.col("o_orderstatus") == "F")


def q_key_collisions(spark, base):
    return KY.key_collisions(read_table(spark, base, "lineitem", ["l_orderkey", "l_linenumber"]),
                             ["l_orderkey", "l_linenumber"])


def q_upsert_by_key(spark, base):
    events = V.mapping_events(spark, base)
    order = ["geaendert_am", "version"]
    split = F.lit(MAPPING_SPLIT).cast("timestamp_ntz")
    before = KY.latest_per_key(events.where(F.col("geaendert_am") < split), "material_nr", order)
    after = events.where(F.col("geaendert_am") >= split)
    return KY.upsert_by_key(before, after, "material_nr", order)


def q_mapping_rejects(spark, base):
    m = V.materials(spark, base)
    requests = m.select("material_nr", F.col("warengruppe").alias("ziel_warengruppe"),
                        F.col("bezeichnung").alias("kommentar"))
    return KY.split_valid(requests).select("material_nr", "grund")


def q_mapping_rejects_absent(spark, base):
    """Requests whose required target column does not exist."""
    m = V.materials(spark, base)
    return KY.split_valid(m.select("material_nr", F.col("bezeichnung").alias("kommentar"))).select("material_nr", "grund")


# --- paging -----------------------------------------------------------------------

def q_top_risk(spark, base):
    risk = _risk()(spark, base)
    return PG.page(risk, PG.risk_order(risk), limit=10)


def q_page(spark, base):
    v2 = P.material_overview_v2(V.materials(spark, base))
    return PG.page(v2, [F.col("material_nr").asc()], limit=10, offset=5)


def q_sorted_page(spark, base):
    return PG.sorted_page(_flat(spark, base), "bestand", "desc", page_no=2)


def q_page_after(spark, base):
    v2 = P.material_overview_v2(V.materials(spark, base))
    rows = PG.page_after(v2, ["material_nr"], ["MAT-101"], limit=50)
    return PG.with_position(rows, [F.col("material_nr").asc()])


def q_product_page_supplier_risk(spark, base):
    rows = P.run_product("supplier-risk", 1, V.suppliers(spark, base), V.deliveries(spark, base),
                         params=P.RiskParams(seit=SINCE), limit=20, offset=10, key="supplier_key")
    return PG.with_position(rows, P.product_order(P.find_product("supplier-risk", 1)), 10)


def q_ordered_materials(spark, base):
    """O1 with its places: the first rows of the ordered scan."""
    rows = S.order_materials(V.materials(spark, base)).limit(50)
    return PG.with_position(rows, [F.col("material_nr").asc_nulls_last()])


def _ranked(df, *first):
    return Ranked(df, PG.total_order(df, [F.col(c).asc_nulls_last() for c in first]))


def q_ordered_materials_all(spark, base):
    return _ranked(V.materials(spark, base), "material_nr").rows()


def q_ordered_suppliers_all(spark, base):
    return _ranked(V.suppliers(spark, base).drop("supplier_key"), "lieferant_id").rows()


def q_ordered_deliveries_all(spark, base):
    """All deliveries since 1998 with their places; equal rows are neighbours."""
    return _ranked(S.scan_deliveries(V.deliveries(spark, base), SINCE), "lieferant_id", "geliefert_am").rows()


def q_page_by_ranges(spark, base):
    """O3: a page far into the deliveries' order, read from the ranges that hold it."""
    ranked = _ranked(S.scan_deliveries(V.deliveries(spark, base), SINCE), "lieferant_id", "geliefert_am")
    return ranked.page(limit=500, offset=1000)


def q_snapshot_eviction(spark, base):
    """A store of two entries; a third put evicts the one that ends first, a replaced key evicts nothing."""
    root, m = _scratch(spark, "snapshots"), V.materials(spark, base)
    part = lambda status: m.where(F.col("status") == status)
    for key, status, ttl in (("a", "Aktiv", 600), ("b", "Obsolet", 300), ("a", "Gesperrt", 500), ("c", "Aktiv", 900)):
        SN.materialize_snapshot(part(status), root, key, "material-overview", GENERATED_AT, ttl, max_entries=2)
    SN.compact_manifest(spark, root, GENERATED_AT)
    SN.vacuum(spark, root, GENERATED_AT, keep_seconds=0)
    answers = [(key, *SN.read_snapshot(spark, root, key, GENERATED_AT)) for key in ("a", "b", "c")]
    parts = [(m.limit(0) if data is None else data).agg(F.lit(key).alias("schluessel"), F.lit(state).alias("zustand"),
                                                        F.count(F.lit(1)).alias("zeilen")) for key, data, state in answers]
    return functools.reduce(DataFrame.unionByName, parts)


def q_delivery_violations(spark, base):
    """Deliveries with faults planted by quantity and date."""
    d = V.deliveries(spark, base).select(*S.DELIVERY_COLUMNS)
    m = F.col("menge")
    return K.contract_violations(d.select(
        F.when(m % 7 != 0, F.col("lieferant_id")).alias("lieferant_id"), "material_nr", "geliefert_am",
        F.when(F.dayofmonth("geliefert_am") != 13, F.col("zugesagt_am")).alias("zugesagt_am"),
        F.when(m % 11 == 0, 0).otherwise(m).alias("menge"),
        F.when(m % 13 == 0, -1).otherwise(F.col("reklamationen")).alias("reklamationen")), K.DELIVERY)


# --- contracts ----------------------------------------------------------------------

def q_contract_violations(spark, base):
    return K.contract_violations(_flat(spark, base), K.MATERIAL_V1)


# --- parameter variants (other branches of the same operators) ---------------------

def q_material_overview_v1_unclassified(spark, base):
    return P.material_overview_v1(V.materials(spark, base),
                                  P.MaterialParams(ohne_klassifizierung=True, suche="Blue"))


def q_sorted_page_by_name(spark, base):
    return PG.sorted_page(_flat(spark, base), "bezeichnung", "asc", page_no=3)


def q_column_filters_ops(spark, base):
    pred = PR.column_filters([("bestand", "<", 2000), ("einheit", "!=", "st"), ("werk", ">=", "nation_2")],
                             numeric_columns=["bestand"])
    return _flat(spark, base).where(pred)


def q_plant_load_min(spark, base):
    return P.plant_load_product(V.materials(spark, base), 100)


def q_page_deep(spark, base):
    v2 = P.material_overview_v2(V.materials(spark, base))
    return PG.page(v2, [F.col("material_nr").asc()], limit=50, offset=1000)


def q_envelope_meta_deprecated(spark, base):
    prod = P.find_product("material-overview", 1)
    return PG.envelope_meta(P.material_overview_v1(V.materials(spark, base), V1_PARAMS), product=prod.name,
                            version=prod.version, generated_at=GENERATED_AT, limit=20, offset=40,
                            sources=prod.sources, deprecated=prod.deprecated, sunset=prod.sunset)


def q_distinct_groups(spark, base):
    return A.distinct_values(_flat(spark, base), "warengruppe")


QUERIES: dict[str, Query] = {
    # S
    "scan_materials": q_scan_materials,
    "scan_materials_flat": _flat,
    "scan_supplier_links": lambda spark, base: S.order_suppliers(V.suppliers(spark, base).select(*S.SUPPLIER_COLUMNS)),
    "scan_deliveries": q_scan_deliveries,
    "generate_materials": q_generate_materials,
    "generate_deliveries": q_generate_deliveries,
    "sample_supplier_links": q_sample_supplier_links,
    "graph_nodes": q_graph_nodes,
    "graph_edges": q_graph_edges,
    "purge_label": q_purge_label,
    "purge_mock_nodes": q_purge_mock_nodes,
    "purge_mock_edges": q_purge_mock_edges,
    "purge_label_filtered": q_purge_label_filtered,
    "scan_materials_from_graph": q_scan_materials_from_graph,
    "snapshot_states": q_snapshot_states,
    "snapshot_eviction": q_snapshot_eviction,
    "records_json": q_records_json,
    "snapshot_roundtrip": q_snapshot_roundtrip,
    # P
    "material_overview_v1": lambda spark, base: P.material_overview_v1(V.materials(spark, base), V1_PARAMS),
    "material_overview_v2": lambda spark, base: P.material_overview_v2(V.materials(spark, base), V2_PARAMS),
    "blank_to_null": q_blank_to_null,
    "lenient_cast": q_lenient_cast,
    "stock_value": q_stock_value,
    "delay_days": q_delay_days,
    "supplier_kpis_filled": q_supplier_kpis_filled,
    "risk_score": q_risk_score,
    "risk_class_histogram": q_risk_class_histogram,
    "visible_columns": q_visible_columns,
    "label_columns": q_label_columns,
    "format_thousands": q_format_thousands,
    "status_color": q_status_color,
    "normalize_change_date": q_normalize_change_date,
    # F
    "multiselect": q_multiselect,
    "unclassified": q_unclassified,
    "search_any": q_search_any,
    "search_joined": q_search_joined,
    "search_indexed": q_search_indexed,
    "min_stock_value": q_min_stock_value,
    "supplier_risk_all": _risk(min_n=0),
    "supplier_risk_hoch": _risk(classes=("hoch",)),
    "apply_filters": q_apply_filters,
    "apply_filters_empty": q_apply_filters_empty,
    "column_filters": q_column_filters,
    "kpi_drilldown": q_kpi_drilldown,
    # J
    "supplier_kpis": q_supplier_kpis,
    "apply_mappings": q_apply_mappings,
    # A
    "count_status": q_count_status,
    "count_unclassified": q_count_unclassified,
    "kpi_board": q_kpi_board,
    "kpi_board_after_changes": q_kpi_board_after_changes,
    "delivery_kpis": q_delivery_kpis,
    "delivery_kpis_tolerance": lambda spark, base: q_delivery_kpis(spark, base, 3),
    "delivery_kpis_by_tolerance": q_delivery_kpis_by_tolerance,
    "plant_load": q_plant_load,
    "delivery_summary": q_delivery_summary,
    "nodes_per_label": q_nodes_per_label,
    "record_counter": q_record_counter,
    "envelope_meta": q_envelope_meta,
    "distinct_values": q_distinct_values,
    "content_fingerprint": q_content_fingerprint,
    "content_fingerprint_nulls": q_content_fingerprint_nulls,
    # W
    "latest_version": q_latest_version,
    "key_collisions": q_key_collisions,
    "upsert_by_key": q_upsert_by_key,
    # O
    "top_risk": q_top_risk,
    "page": q_page,
    "sorted_page": q_sorted_page,
    "page_after": q_page_after,
    "product_page_supplier_risk": q_product_page_supplier_risk,
    "ordered_materials": q_ordered_materials,
    "ordered_materials_all": q_ordered_materials_all,
    "ordered_suppliers_all": q_ordered_suppliers_all,
    "ordered_deliveries_all": q_ordered_deliveries_all,
    "page_by_ranges": q_page_by_ranges,
    # U
    "contract_violations": q_contract_violations,
    "delivery_violations": q_delivery_violations,
    "mapping_rejects": q_mapping_rejects,
    "mapping_rejects_absent": q_mapping_rejects_absent,
    # E
    "supplier_risk": _risk(),
    "supplier_risk_tolerance": _risk(tol=3),
    # parameter variants
    "material_overview_v1_unclassified": q_material_overview_v1_unclassified,
    "supplier_risk_classes_min": _risk(tol=2, min_n=340, classes=("mittel", "niedrig")),
    "sorted_page_by_name": q_sorted_page_by_name,
    "column_filters_ops": q_column_filters_ops,
    "plant_load_min": q_plant_load_min,
    "page_deep": q_page_deep,
    "envelope_meta_deprecated": q_envelope_meta_deprecated,
    "distinct_groups": q_distinct_groups,
}
