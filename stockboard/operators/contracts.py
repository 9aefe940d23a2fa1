"""Row contracts and their checks.

A contract is a ``StructType``: field order, types and nullability. Display
labels and the "always visible" flag live in the field metadata. Checking
rows against a contract is ONE aggregate with a ``count_if`` per rule.
"""
from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockboard.operators.aggregates import STATUSES, rows_of

# Domains of the entities.
UNITS = ("M", "KG", "L", "PAK", "ST")
RISK_CLASSES = ("niedrig", "mittel", "hoch")


def _f(name: str, dtype: T.DataType, nullable: bool = True, **meta) -> T.StructField:
    return T.StructField(name, dtype, nullable, metadata=meta)


S, L, D = T.StringType(), T.LongType(), T.DoubleType()

MATERIAL_V1 = T.StructType([
    _f("material_nr", S, False), _f("bezeichnung", S), _f("warengruppe", S), _f("werk", S),
    _f("status", S, domain=list(STATUSES)), _f("einheit", S, domain=list(UNITS)),
    _f("bestand", L), _f("geaendert", S)])

MATERIAL_V2 = T.StructType([
    _f("material_nr", S, False), _f("bezeichnung", S), _f("warengruppe", S), _f("werk_id", S),
    _f("werk_name", S), _f("status", S, domain=list(STATUSES)), _f("bestand", L), _f("preis", D),
    _f("bestandswert", D), _f("geaendert", S)])

SUPPLIER_RISK_V1 = T.StructType([
    _f("lieferant_id", S, False), _f("lieferant_name", S), _f("land", S),
    _f("anzahl_materialien", L), _f("lieferungen", L), _f("liefertreue_pct", D),
    _f("mittlerer_verzug_tage", D), _f("reklamationsquote_pct", D), _f("risiko_score", D),
    _f("risiko_klasse", S, domain=list(RISK_CLASSES))])

# The dashboard table (id, label, fixed, numeric) in display order.
TABLE_COLUMNS = T.StructType([
    _f("material_nr", S, False, label="Material-Nr.", fixed=True),
    _f("bezeichnung", S, label="Bezeichnung", fixed=True),
    _f("warengruppe", S, label="Warengruppe"),
    _f("werk", S, label="Werk"),
    _f("status", S, label="Status", domain=list(STATUSES)),
    _f("einheit", S, label="Einheit", domain=list(UNITS)),
    _f("bestand", L, label="Bestand", numeric=True),
    _f("geaendert", S, label="Geändert")])


# Entity tables as stored: fixed schemas for ``read_entity``.
MATERIALS = T.StructType([_f(c, t) for c, t in [
    ("material_nr", S), ("bezeichnung", S), ("warengruppe", S), ("werk_id", S), ("werk_name", S),
    ("status", S), ("einheit", S), ("bestand", L), ("preis", D), ("geaendert", S)]])
DELIVERIES = T.StructType([_f(c, t) for c, t in [
    ("lieferant_id", S), ("material_nr", S), ("geliefert_am", T.DateType()), ("zugesagt_am", T.DateType()),
    ("menge", T.IntegerType()), ("reklamationen", T.IntegerType())]])
# A delivery as it must be: every field given, something delivered, no negative complaints.
DELIVERY = T.StructType([
    _f("lieferant_id", S, False), _f("material_nr", S, False), _f("geliefert_am", T.DateType(), False),
    _f("zugesagt_am", T.DateType(), False), _f("menge", T.IntegerType(), False, minimum=1),
    _f("reklamationen", T.IntegerType(), False, minimum=0)])
SUPPLIERS = T.StructType([_f(c, t) for c, t in [
    ("lieferant_id", S), ("lieferant_name", S), ("land", S), ("anzahl_materialien", L)]])


def project_contract(df: DataFrame, contract: T.StructType,
                     renames: Mapping[str, str] | None = None) -> DataFrame:
    """Exactly the contract's fields, in order, renamed and cast.

    ``renames`` maps a contract field to the source column it comes from.
    """
    src = dict(renames or {})
    # One SQL projection list: a single call builds all casts (a Column per
    # field would cost several driver round trips each); same plan either way.
    return df.selectExpr(*[f"CAST(`{src.get(f.name, f.name)}` AS {f.dataType.simpleString()}) AS `{f.name}`"
                           for f in contract.fields])


def visible_columns(df: DataFrame, chosen: Iterable[str] | None,
                    schema: T.StructType = TABLE_COLUMNS) -> DataFrame:
    """Fixed columns always, the others only if chosen; ``None`` means all."""
    pick = None if chosen is None else set(chosen)
    keep = [f.name for f in schema.fields
            if f.name in df.columns and (f.metadata.get("fixed") or pick is None or f.name in pick)]
    return df.select(*keep)


def label_columns(df: DataFrame, schema: T.StructType = TABLE_COLUMNS, upper: bool = True) -> DataFrame:
    """Rename columns to their display labels (upper-cased, as the table shows them)."""
    labels = {f.name: f.metadata.get("label", f.name) for f in schema.fields}
    return df.select(*[F.col(c).alias(labels[c].upper() if upper else labels[c]) if c in labels
                       else F.col(c) for c in df.columns])


def contract_violations(df: DataFrame, contract: T.StructType) -> DataFrame:
    """Per field and rule, the number of rows that break it, in one aggregate.

    Rules: ``required`` (null in a non-nullable field), ``type`` (a non-null
    value that does not cast to the field type), ``domain`` (a value outside the
    field's listed domain), ``range`` (a value below the field's ``minimum``, in
    its metadata). A field missing from ``df`` counts every row.
    Output: (feld, regel, verstoesse), in contract order.
    """
    checks: list[tuple[str, str, object]] = []
    total = F.count(F.lit(1))
    for f in contract.fields:
        if f.name not in df.columns:
            checks.append((f.name, "missing", total))
            continue
        c = F.col(f.name)
        if not f.nullable:
            checks.append((f.name, "required", F.count_if(c.isNull())))
        checks.append((f.name, "type", F.count_if(c.isNotNull() & c.try_cast(f.dataType).isNull())))
        if "domain" in f.metadata:
            checks.append((f.name, "domain",
                           F.count_if(c.isNotNull() & ~c.isin(list(f.metadata["domain"])))))
        if "minimum" in f.metadata:
            checks.append((f.name, "range", F.count_if(c < F.lit(f.metadata["minimum"]))))
    counts = df.agg(*[expr.alias(f"c{i}") for i, (_n, _r, expr) in enumerate(checks)])
    return rows_of([(F.lit(i), F.lit(n), F.lit(r), F.col(f"c{i}")) for i, (n, r, _e) in enumerate(checks)],
                   ("pos", "feld", "regel", "verstoesse"), counts)


def conforms(df: DataFrame, contract: T.StructType, names: Sequence[str] | None = None) -> bool:
    """Driver-side check that a schema matches a contract (names, order, types)."""
    want = [(f.name, f.dataType) for f in contract.fields]
    have = [(f.name, f.dataType) for f in df.schema.fields]
    return have == want if names is None else [h for h in have if h[0] in names] == want
