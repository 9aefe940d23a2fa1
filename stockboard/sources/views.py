"""Entity views over the TPC-H-style test tables.

They turn ``part``, ``lineitem``, ``supplier``, ``nation``, ``orders`` and
``customer`` into the reference's entities (materials, deliveries, suppliers,
mapping requests), with blanks and nulls injected on purpose so that every
null rule of the operators is exercised. Every view is a lazy DataFrame over
the whole tables; nothing is collected.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockboard.sources.scans import scan_materials, scan_supplier_links
from stockboard.sources.tables import read_table

# How the views derive entities from the test tables.
MATERIAL_NR_BASE = 100777
MATERIAL_NR_STEP = 13
CHANGE_DATE_START = "2026-01-01"
CHANGE_DATE_SPAN = 240
UNITS = ("M", "KG", "L", "PAK", "ST")          # by p_partkey % 5
COMPLAINT_FLAG = "R"                          # l_returnflag that counts as a complaint


def material_nr(key: Column) -> Column:
    return F.concat(F.lit("MAT-"), (F.lit(MATERIAL_NR_BASE) + key * MATERIAL_NR_STEP).cast("string"))


def supplier_id(key: Column) -> Column:
    # Zero-padded to at least six digits and never truncated, so ids stay
    # unique at any scale (plain lpad would cut longer keys).
    digits = key.cast("string")
    return F.concat(F.lit("L-"), F.lpad(digits, F.greatest(F.lit(6), F.length(digits)), "0"))


def plant_id(key: Column) -> Column:
    return F.concat(F.lit("W-"), key.cast("string"))


def material_nodes(part: DataFrame) -> DataFrame:
    """Material nodes (group inline) keyed by ``material_key`` = p_partkey."""
    k = F.col("p_partkey")
    size = F.col("p_size") % 20
    unit = F.when(k % 5 == 0, UNITS[0])
    for i, u in enumerate(UNITS[1:], start=1):
        unit = unit.when(k % 5 == i, u)
    changed = F.date_add(F.lit(CHANGE_DATE_START).cast("date"), (k % CHANGE_DATE_SPAN).cast("int"))
    return part.select(
        k.alias("material_key"),
        material_nr(k).alias("material_nr"),
        F.col("p_name").alias("bezeichnung"),
        F.when(k % 17 == 0, F.lit("")).when(k % 17 == 1, F.lit(None).cast("string"))
         .otherwise(F.col("p_type")).alias("warengruppe"),
        F.when(size < 11, "Aktiv").when(size < 15, "Nicht geliefert")
         .when(size < 18, "Obsolet").otherwise("Gesperrt").alias("status"),
        unit.alias("einheit"),
        F.when(k % 23 == 0, F.lit(None).cast("bigint"))
         .otherwise((F.col("p_size") * 100).cast("bigint")).alias("bestand"),
        F.col("p_retailprice").alias("preis"),
        F.when(k % 2 == 0, F.date_format(changed, "dd.MM.yyyy"))
         .otherwise(F.date_format(changed, "yyyy-MM-dd")).alias("geaendert"),
    )


def unique_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row per key (the smallest value), stated as an aggregate.

    Master tables are unique by key already; saying so as a GROUP BY lets
    Catalyst's distinct-key tracking prove that a LEFT JOIN to them cannot fan
    out, so the join is removed from every query that reads no column of it
    (the KPI board then never scans the line items). Before a sort-merge join
    on the same key this aggregate's shuffle replaces the join's own.
    """
    return df.groupBy(key).agg(F.min(value).alias(value))


def plant_links(lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    """LOCATED_IN: a part's plant is the nation of its lowest supplier key.

    Parts with ``p_partkey % 19 = 0`` get no plant: it is blanked on the row.
    The minimum is a partial aggregate, so a part with very many line items is
    combined map-side. The suppliers are joined as they are, not as an aggregate:
    both sides of that join are then plain shuffles, and Spark splits the
    partition of a supplier that is the lowest of very many parts. The aggregate
    per part comes after it (one row each), on the key the next join wants.
    """
    first = lineitem.groupBy("l_partkey").agg(F.min("l_suppkey").alias("first_suppkey"))
    one = (first.join(supplier, F.col("first_suppkey") == F.col("s_suppkey"), "inner")
           .groupBy("l_partkey").agg(F.min("s_nationkey").alias("nation")))
    return one.select(F.col("l_partkey").alias("material_key"),
                      F.when(F.col("l_partkey") % 19 != 0, F.col("nation")).alias("plant_key"))


def plant_nodes(nation: DataFrame) -> DataFrame:
    return unique_by(nation, "n_nationkey", "n_name").select(
        F.col("n_nationkey").alias("plant_key"),
        plant_id(F.col("n_nationkey")).alias("werk_id"),
        F.col("n_name").alias("werk_name"))


def materials(spark: SparkSession, base_dir: str, keyed: bool = False) -> DataFrame:
    """The service's raw material rows (output of S1); ``keyed``: with ``material_key`` in front."""
    part = read_table(spark, base_dir, "part", ["p_partkey", "p_name", "p_type", "p_size", "p_retailprice"])
    lineitem = read_table(spark, base_dir, "lineitem", ["l_partkey", "l_suppkey"])
    supplier = read_table(spark, base_dir, "supplier", ["s_suppkey", "s_nationkey"])
    nation = read_table(spark, base_dir, "nation", ["n_nationkey", "n_name"])
    return scan_materials(material_nodes(part), plant_links(lineitem, supplier), plant_nodes(nation),
                          extra=("material_key",) if keyed else ())


def deliveries(spark: SparkSession, base_dir: str) -> DataFrame:
    """``lieferungen``: one delivery per line item, with the numeric
    ``supplier_key`` beside the text id (grouping on the number is cheaper;
    an id that no query reads is never computed).

    delay = l_suppkey % 12 + l_linenumber % 5 - 4 days (-4 .. 11), so the
    promise date is the ship date minus that delay.
    """
    li = read_table(spark, base_dir, "lineitem",
                    ["l_suppkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate"])
    shipped = F.to_date(F.col("l_shipdate"))
    delay = (F.col("l_suppkey") % 12 + F.col("l_linenumber") % 5 - 4).cast("int")
    return li.select(
        F.col("l_suppkey").alias("supplier_key"),
        supplier_id(F.col("l_suppkey")).alias("lieferant_id"),
        material_nr(F.col("l_partkey")).alias("material_nr"),
        shipped.alias("geliefert_am"),
        F.date_sub(shipped, delay).alias("zugesagt_am"),
        F.col("l_quantity").cast("int").alias("menge"),
        F.when(F.col("l_returnflag") == COMPLAINT_FLAG, 1).otherwise(0).alias("reklamationen"),
    )


def supplier_master(spark: SparkSession, base_dir: str) -> DataFrame:
    """Supplier nodes: key, id, name, country."""
    supplier = read_table(spark, base_dir, "supplier", ["s_suppkey", "s_name", "s_nationkey"])
    nation = read_table(spark, base_dir, "nation", ["n_nationkey", "n_name"])
    return (supplier.join(nation, supplier.s_nationkey == nation.n_nationkey, "left")
            .select(F.col("s_suppkey").alias("supplier_key"),
                    supplier_id(F.col("s_suppkey")).alias("lieferant_id"),
                    F.col("s_name").alias("lieferant_name"),
                    F.col("n_name").alias("land")))


def supply_links(spark: SparkSession, base_dir: str) -> DataFrame:
    """SUPPLIES edges: distinct (supplier, part) pairs of the line items."""
    li = read_table(spark, base_dir, "lineitem", ["l_suppkey", "l_partkey"])
    return (li.distinct()
            .select(F.col("l_suppkey").alias("supplier_key"),
                    F.col("l_partkey").alias("material_key")))


def suppliers(spark: SparkSession, base_dir: str) -> DataFrame:
    """The suppliers entity: id, name, country, number of supplied materials."""
    return scan_supplier_links(supplier_master(spark, base_dir), supply_links(spark, base_dir),
                               key="supplier_key")


def mapping_events(spark: SparkSession, base_dir: str) -> DataFrame:
    """Group override requests: every order line asks to move its part into the
    ordering customer's market segment, stamped with the order date; the order
    key breaks ties between requests of the same day.
    """
    li = read_table(spark, base_dir, "lineitem", ["l_orderkey", "l_partkey"])
    orders = read_table(spark, base_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    customer = read_table(spark, base_dir, "customer", ["c_custkey", "c_mktsegment"])
    joined = (li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "inner")
              .join(customer, F.col("o_custkey") == F.col("c_custkey"), "inner"))
    return joined.select(
        material_nr(F.col("l_partkey")).alias("material_nr"),
        F.col("c_mktsegment").alias("ziel_warengruppe"),
        F.col("o_orderdate").alias("geaendert_am"),
        F.col("o_orderkey").alias("version"),
    )
