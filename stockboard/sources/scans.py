"""Scans of the entity tables.

The reference read these from a graph (materials, suppliers) and a relational
table (deliveries). Here each node label is a DataFrame and each relationship
a two-column DataFrame; the optional and mandatory matches become left and
inner joins.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockboard.functions.columns import lenient_long

# Column order of the service's raw material rows.
MATERIAL_COLUMNS = ("material_nr", "bezeichnung", "warengruppe", "werk_id", "werk_name",
                    "status", "einheit", "bestand", "preis", "geaendert")
# Column order of the dashboard table (plant by name only).
FLAT_COLUMNS = ("material_nr", "bezeichnung", "warengruppe", "werk", "status", "einheit",
                "bestand", "geaendert")
DELIVERY_COLUMNS = ("lieferant_id", "material_nr", "geliefert_am", "zugesagt_am", "menge",
                    "reklamationen")
SUPPLIER_COLUMNS = ("lieferant_id", "lieferant_name", "land", "anzahl_materialien")


def scan_materials(nodes: DataFrame, plant_links: DataFrame, plants: DataFrame,
                   group_links: DataFrame | None = None, *, key: str = "material_key",
                   plant_key: str = "plant_key", extra: tuple[str, ...] = ()) -> DataFrame:
    """Every material with its optional plant and its optional group;
    one row per match of both.

    ``nodes`` carries the material columns and ``key``; ``plant_links`` maps
    ``key`` to ``plant_key``; ``plants`` maps ``plant_key`` to ``werk_id`` and
    ``werk_name``; ``group_links`` maps ``key`` to ``warengruppe`` (None: the
    group is a column of ``nodes``). A link whose plant does not exist matches
    nothing, as an optional match does. A material with two plants and two
    groups yields four rows. No order is imposed here (see ``order_materials``).
    """
    located = plant_links.join(plants, plant_key, "inner").drop(plant_key)
    matched = nodes.join(located, key, "left")
    if group_links is not None:
        matched = matched.join(group_links.select(key, "warengruppe"), key, "left")
    return matched.select(*extra, *MATERIAL_COLUMNS)


def order_materials(df: DataFrame) -> DataFrame:
    """O1: by material number, nulls last."""
    return df.orderBy(F.col("material_nr").asc_nulls_last())


def scan_materials_flat(materials: DataFrame) -> DataFrame:
    """The dashboard's eight columns in schema order, stock cast leniently."""
    return materials.select(
        "material_nr", "bezeichnung", "warengruppe", F.col("werk_name").alias("werk"),
        "status", "einheit", lenient_long("bestand").alias("bestand"), "geaendert")


def scan_supplier_links(suppliers: DataFrame, supplies: DataFrame, *,
                        key: str = "lieferant_id") -> DataFrame:
    """Suppliers matched to their materials, with the link count.

    Suppliers without a material are absent (mandatory match). The links are
    counted per supplier before the join, so only one row per supplier reaches
    the join and a supplier holding a third of all links is combined map-side.
    """
    per_supplier = supplies.groupBy(key).agg(F.count(F.lit(1)).alias("anzahl_materialien"))
    # Supplier nodes are unique by key (they are merged by id), so the joined
    # rows are already one per (id, name, country) group. A surrogate key
    # other than the id is kept in front, for later joins on it.
    cols = SUPPLIER_COLUMNS if key in SUPPLIER_COLUMNS else (key, *SUPPLIER_COLUMNS)
    return suppliers.join(per_supplier, key, "inner").select(*cols)


def order_suppliers(df: DataFrame) -> DataFrame:
    """O1: by supplier id."""
    return df.orderBy(F.col("lieferant_id").asc_nulls_last())


def scan_deliveries(deliveries: DataFrame, since: dt.date | str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Deliveries on or after ``since``, in the contract's columns
    (plus ``extra`` ones, e.g. a numeric supplier key).

    The date bound is a plain comparison, which Catalyst pushes into the
    Parquet reader.
    """
    bound = F.lit(since if isinstance(since, dt.date) else dt.date.fromisoformat(since))
    cols = [c for c in extra if c not in DELIVERY_COLUMNS] + list(DELIVERY_COLUMNS)
    return deliveries.where(F.col("geliefert_am") >= bound).select(*cols)


def order_deliveries(df: DataFrame) -> DataFrame:
    """O1: by supplier, then delivery date."""
    return df.orderBy(F.col("lieferant_id").asc_nulls_last(), F.col("geliefert_am").asc_nulls_last())
