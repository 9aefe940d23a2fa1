"""Graph tables.

The property graph becomes one node table (``NODE_COLUMNS``) and one edge table
``(rel, src, dst)``, where ``node_id`` is ``label:key``. A node carries the
properties of its label, nulls elsewhere. Node creation is an upsert by key
(``MERGE ... SET``): one node per key, chosen deterministically; edges are
distinct.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockboard.operators.keyed import latest_per_key
from stockboard.sources.scans import scan_materials

# Properties of material nodes, then of supplier nodes.
PROPERTIES = (("status", "string"), ("einheit", "string"), ("bestand", "bigint"), ("preis", "double"),
              ("geaendert", "string"), ("land", "string"))
NODE_COLUMNS = ("node_id", "label", "labels", "name", *(p for p, _ in PROPERTIES))
EDGE_COLUMNS = ("rel", "src", "dst")


def node_id(label: str, key: Column) -> Column:
    return F.concat(F.lit(f"{label}:"), key)


def _labels(label: str, extra: Sequence[str]) -> Column:
    return F.array(*[F.lit(x) for x in (label, *extra)])


def _nodes(df: DataFrame, label: str, key: str, name: str, extra: Sequence[str],
           own: Sequence[str] = ()) -> DataFrame:
    """One node per key with the properties ``own`` that ``df`` has."""
    props = [F.col(p) if p in own and p in df.columns else F.lit(None) for p, _ in PROPERTIES]
    one = latest_per_key(df.select(F.col(key).alias("k"), F.col(name).alias("name"),
                                   *[c.cast(t).alias(p) for c, (p, t) in zip(props, PROPERTIES)])
                         .where(F.col("k").isNotNull()), "k", [])
    return one.select(node_id(label, F.col("k")).alias("node_id"), F.lit(label).alias("label"),
                      _labels(label, extra).alias("labels"), "name", *[p for p, _ in PROPERTIES])


def to_graph_nodes(materials: DataFrame, suppliers: DataFrame,
                   extra_labels: Sequence[str] = ()) -> DataFrame:
    """Material, plant, group and supplier nodes; one per key.

    A group node exists only for a non-empty group name. ``extra_labels`` (such
    as the seed's ``Mock``) are added to every node.
    """
    groups = materials.where(F.col("warengruppe").isNotNull() & (F.col("warengruppe") != ""))
    return (_nodes(materials, "Material", "material_nr", "bezeichnung", extra_labels,
                   ("status", "einheit", "bestand", "preis", "geaendert"))
            .unionByName(_nodes(materials, "Werk", "werk_id", "werk_name", extra_labels))
            .unionByName(_nodes(groups.withColumn("g", F.col("warengruppe")), "Warengruppe",
                                "warengruppe", "g", extra_labels))
            .unionByName(_nodes(suppliers, "Lieferant", "lieferant_id", "lieferant_name", extra_labels,
                                ("land",))))


def unwind_links(suppliers: DataFrame, list_col: str = "materialien") -> DataFrame:
    """Nested supplier rows with a material list -> one (supplier, material) row each."""
    return suppliers.select("lieferant_id", F.explode(list_col).alias("material_nr"))


def to_graph_edges(materials: DataFrame, links: DataFrame, *, key: str = "material_nr",
                   supplier_key: str = "lieferant_id", material_text: Callable[[Column], Column] | None = None,
                   supplier_text: Callable[[Column], Column] | None = None) -> DataFrame:
    """LOCATED_IN, HAS_WARENGRUPPE (non-empty group only) and SUPPLIES.

    Supplier links are matched to existing materials; a link to an unknown
    material creates no edge. Edges are distinct: duplicates go per relation, on
    the keys, and numeric keys become text ids (``*_text``) only afterwards. The
    materials are matched as they are, without a distinct of their own, so that
    Spark can split the partition of a material that holds very many links.
    """
    m_text, s_text = material_text or (lambda c: c), supplier_text or (lambda c: c)

    def edges(rel: str, pairs: DataFrame, src: Column, dst: Column) -> DataFrame:
        return pairs.select(F.lit(rel).alias("rel"), src.alias("src"), dst.alias("dst"))

    material = node_id("Material", m_text(F.col(key)))
    located = materials.where(F.col("werk_id").isNotNull()).select(key, "werk_id").distinct()
    grouped = (materials.where(F.col("warengruppe").isNotNull() & (F.col("warengruppe") != ""))
               .select(key, "warengruppe").distinct())
    supplied = links.select(supplier_key, key).distinct().join(materials.select(key), key, "left_semi")
    return (edges("LOCATED_IN", located, material, node_id("Werk", F.col("werk_id")))
            .unionByName(edges("HAS_WARENGRUPPE", grouped, material, node_id("Warengruppe", F.col("warengruppe"))))
            .unionByName(edges("SUPPLIES", supplied, node_id("Lieferant", s_text(F.col(supplier_key))), material)))


def scan_materials_from_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """S1 on the stored graph: material nodes with their optional plant and group."""
    def of(label: str) -> DataFrame:
        return nodes.where(F.col("label") == label)

    def ends(rel: str) -> DataFrame:
        return edges.where(F.col("rel") == rel).select(F.col("src").alias("material_key"), F.col("dst").alias("to"))

    def after_label(node: str) -> Column:
        return F.expr(f"substring({node}, instr({node}, ':') + 1)")

    materials = of("Material").select(
        F.col("node_id").alias("material_key"), after_label("node_id").alias("material_nr"),
        F.col("name").alias("bezeichnung"), "status", "einheit", "bestand", "preis", "geaendert")
    plants = of("Werk").select(F.col("node_id").alias("plant_key"), after_label("node_id").alias("werk_id"),
                               F.col("name").alias("werk_name"))
    groups = ends("HAS_WARENGRUPPE").select("material_key", after_label("to").alias("warengruppe"))
    return scan_materials(materials, ends("LOCATED_IN").withColumnRenamed("to", "plant_key"), plants, groups)


def store_graph(nodes: DataFrame, edges: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Write the node and edge tables under ``root`` (shared storage) and
    return them read back: the graph is built once, and later operators
    (purge, counts) start from two Parquet scans instead of re-deriving it."""
    spark = nodes.sparkSession
    nodes.write.mode("overwrite").parquet(f"{root}/nodes")
    edges.write.mode("overwrite").parquet(f"{root}/edges")
    return spark.read.parquet(f"{root}/nodes"), spark.read.parquet(f"{root}/edges")


def purge_label(nodes: DataFrame, edges: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Delete every node carrying ``label`` and every edge touching one."""
    doomed = nodes.where(F.array_contains("labels", label)).select(F.col("node_id").alias("id"))
    kept_nodes = nodes.where(~F.array_contains("labels", label))
    kept_edges = (edges.join(doomed, edges.src == doomed.id, "left_anti")
                  .join(doomed, edges.dst == doomed.id, "left_anti"))
    return kept_nodes, kept_edges.select(*EDGE_COLUMNS)


def nodes_per_label(nodes: DataFrame) -> DataFrame:
    """Node count per first label."""
    return nodes.groupBy(F.col("labels")[0].alias("label")).agg(F.count(F.lit(1)).alias("anzahl"))
