"""Aggregations.

All of them are hash aggregates with a partial (map-side) step, so a key that
holds a third of all rows is combined inside each task before the shuffle and
never lands whole in one task.
"""
from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockboard.functions.columns import col_exact, delay_days, rounded
from stockboard.functions.predicates import unclassified

# Status domain in display order, the status colours, and the
# KPI definitions (id, label, colour, filter) in display order.
STATUSES = ("Aktiv", "Nicht geliefert", "Obsolet", "Gesperrt")
STATUS_COLORS = {"Aktiv": "#2e9e5b", "Nicht geliefert": "#ef6c00", "Obsolet": "#6b7683",
                 "Gesperrt": "#d13b3b"}
KPI_DEFINITIONS = (
    ("aktiv", "Aktive Materialien", "#2e9e5b", {"status": ["Aktiv"], "ohne_klass": False}),
    ("nicht_geliefert", "Nicht gelieferte Teile", "#ef6c00",
     {"status": ["Nicht geliefert"], "ohne_klass": False}),
    ("obsolet", "Obsolete Materialien", "#6b7683", {"status": ["Obsolet"], "ohne_klass": False}),
    ("gesperrt", "Gesperrte Materialien", "#d13b3b", {"status": ["Gesperrt"], "ohne_klass": False}),
    ("ohne_klassifizierung", "Ohne Klassifizierung", "#6a4bc0", {"status": [], "ohne_klass": True}),
)


def rows_of(rows: Sequence[Sequence[Column]], names: Sequence[str], one: DataFrame) -> DataFrame:
    """A one-row DataFrame turned into one row per listed tuple of columns."""
    return one.select(F.inline(F.array(*[F.struct(*[c.alias(n) for c, n in zip(r, names)]) for r in rows])))


def status_key(status: str) -> str:
    return status.lower().replace(" ", "_")


def kpi_filter_json(flt: Mapping) -> str:
    return json.dumps(flt, separators=(",", ":"), ensure_ascii=False)


def count_status(df: DataFrame, statuses: Sequence[str] = STATUSES,
                 column: str = "status") -> DataFrame:
    """A1: one row, one count per status (``count_if(status = s)``), one pass."""
    return df.agg(*[F.count_if(F.col(column) == F.lit(s)).alias(status_key(s)) for s in statuses])


def count_unclassified(df: DataFrame, column: str = "warengruppe") -> DataFrame:
    """A2: rows whose group is null or ''."""
    return df.agg(F.count_if(unclassified(column)).alias("ohne_klassifizierung"))


def kpi_board(df: DataFrame) -> DataFrame:
    """A3: the five KPI tiles in display order, from ONE scan of the full table.

    One aggregate computes the five counts; an inlined array of structs turns the
    single result row into five rows with the literal definitions, without a join.
    """
    counts = df.agg(
        *[F.count_if(F.col("status") == F.lit(s)).alias(status_key(s)) for s in STATUSES],
        F.count_if(unclassified("warengruppe")).alias("ohne_klassifizierung"))
    return kpi_tiles(counts)


def kpi_tiles(counts: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """One row of counts, a column per tile, as tiles in display order; ``extra`` columns go on each."""
    return rows_of([(F.lit(pos), F.lit(kpi_id), F.lit(label), F.lit(color), F.col(kpi_id),
                     F.lit(kpi_filter_json(flt)), *[F.col(c) for c in extra])
                    for pos, (kpi_id, label, color, flt) in enumerate(KPI_DEFINITIONS, start=1)],
                   ("position", "kpi_id", "label", "color", "value", "filter", *extra), counts)


def delivery_kpis(deliveries: DataFrame, tolerance_days: int = 0, *,
                  key: str = "lieferant_id") -> DataFrame:
    """A4: per supplier: deliveries, mean delay, on-time share, complaint share.

    Means ignore nulls; the count counts every row. On time means
    ``delay <= tolerance_days``; a complaint is ``reklamationen > 0``.
    """
    delay = delay_days("geliefert_am", "zugesagt_am")
    return deliveries.groupBy(key).agg(
        F.count(F.lit(1)).alias("lieferungen"),
        F.avg(delay).alias("mittlerer_verzug_tage"),
        F.avg((delay <= F.lit(tolerance_days)).cast("double")).alias("puenktlich"),
        F.avg((F.col("reklamationen") > 0).cast("double")).alias("reklamationsquote"),
    )


def plant_load(materials: DataFrame, min_materials: int = 0) -> DataFrame:
    """Per plant id: rows, total stock (null counts 0), plant name.

    A null plant is its own group. Rows are counted, not distinct materials.
    The name is the smallest one seen for the id (deterministic).

    Two levels: counts and sums per (id, name) run as a hash aggregate over
    every row; only the few (id, name) pairs then meet ``min(name)``, whose
    string buffer would otherwise force a sort-based aggregate on all rows.
    """
    pairs = materials.groupBy("werk_id", "werk_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.coalesce(F.col("bestand"), F.lit(0)).cast("bigint")).alias("s"))
    return (pairs.groupBy("werk_id")
            .agg(F.min("werk_name").alias("werk_name"),
                 F.sum("n").cast("bigint").alias("materialien"),
                 F.sum("s").cast("bigint").alias("bestand_gesamt"))
            .where(F.col("materialien") >= F.lit(min_materials)))


def delivery_summary(deliveries: DataFrame, *, key: str = "lieferant_id") -> DataFrame:
    """Per supplier the number of deliveries and the mean delay to 2 places."""
    delay = delay_days("geliefert_am", "zugesagt_am")
    return (deliveries.groupBy(key)
            .agg(F.count(F.lit(1)).alias("lieferungen"),
                 rounded(F.avg(delay), 2).alias("mittlerer_verzug")))


def record_counter(total: DataFrame, predicate: Column | None) -> DataFrame:
    """Filtered and total count in one pass, and the "x / y Datensätze" text."""
    hit = F.count(F.lit(1)) if predicate is None else F.count_if(predicate)
    counts = total.agg(hit.alias("gefiltert"), F.count(F.lit(1)).alias("gesamt"))
    return counts.withColumn(
        "anzeige", F.concat(F.col("gefiltert").cast("string"), F.lit(" / "),
                            F.col("gesamt").cast("string"), F.lit(" Datensätze")))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """A10: distinct values without null and '', sorted."""
    c = F.col(column)
    return (df.select(c.alias("wert")).where(F.col("wert").isNotNull() & (F.col("wert") != ""))
            .distinct().orderBy("wert"))


def _row_text(columns: Sequence[str]) -> Column:
    """Each field as ``<length>:<text>``, a null as ``-``: no two different rows
    (or column lists, whose names come first) give the same text."""
    fields = [F.concat(F.char_length(t).cast("string"), F.lit(":"), t)
              for t in [col_exact(c).cast("string") for c in columns]]
    names = "".join(f"{len(c)}:{c}" for c in columns)
    return F.concat(F.lit(names), *[F.coalesce(f, F.lit("-")) for f in fields])


def content_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Order-free content tag: row count and two sums of 60-bit row hashes.

    Each row's text is hashed with SHA-256; hex digits 1-15 and 16-30 are read as
    numbers and summed as decimal(38,0). The sums are independent of order and
    partitioning, and unlike XOR a duplicated row changes them. Column names count
    too. Doubles should be passed as whole numbers (cents) by the caller.
    """
    lanes = row_lanes(list(columns or df.columns))
    zero = F.lit(0).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  fingerprint_text([F.coalesce(F.sum(x), zero) for x in lanes]).alias("fingerprint"))


def row_lanes(columns: Sequence[str]) -> list[Column]:
    """The two 60-bit hashes of a row that the fingerprint sums."""
    digest = F.sha2(_row_text(columns), 256)
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 16)]


def fingerprint_text(sums: Sequence[Column | str]) -> Column:
    return F.concat_ws("-", *[(F.col(x) if isinstance(x, str) else x).cast("string") for x in sums])
