"""Keyed table operators.

"Latest row per key" is computed as ``max(struct(order..., row...))`` per key,
an aggregate with a partial step, instead of ``row_number`` over a window: a
window sorts every row of a key inside one task, so a key holding a third of
the table would land whole in one task. The struct carries every column, so
ties are broken by the remaining columns and the result is deterministic.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockboard.functions.columns import col_exact as _q


def _as_list(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def latest_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the one with the greatest ``order`` tuple."""
    keys = _as_list(key)
    rest = [c for c in df.columns if c not in keys]
    order_cols = [_q(o) if isinstance(o, str) else o for o in order]
    ranked = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order_cols)],
                      F.struct(*[_q(c) for c in rest]).alias("_row"))
    best = df.groupBy(*[_q(k) for k in keys]).agg(F.max(ranked).alias("_best"))
    row = F.col("_best").getField("_row")
    return best.select(*[_q(k) for k in keys], *[row.getField(c).alias(c) for c in rest]) \
               .select(*[_q(c) for c in df.columns])


def latest_version(df: DataFrame, key: str | Sequence[str], version: Sequence[str],
                   deprecated: str | Column) -> DataFrame:
    """Newest non-deprecated row per key; if every row is deprecated, the newest."""
    dep = F.col(deprecated) if isinstance(deprecated, str) else deprecated
    live = F.coalesce(~dep, F.lit(True))
    return latest_per_key(df, key, [live, *version])


def key_collisions(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    ks = _as_list(keys)
    return (df.groupBy(*ks).agg(F.count(F.lit(1)).alias("anzahl"))
            .where(F.col("anzahl") > 1))


def upsert_by_key(base: DataFrame, changes: DataFrame, key: str | Sequence[str],
                  order: Sequence[str]) -> DataFrame:
    """Create-or-replace by key, idempotent.

    Base and change rows are tagged and reduced together: a change beats the base
    row of its key, the latest change the others. One aggregate, each input once.
    Of several base rows of one key, the latest stays. Applying the same changes
    twice gives the same table.
    """
    names = base.columns
    tagged = (base.select(*map(_q, names), F.lit(0).alias("_change"))
              .unionByName(changes.select(*map(_q, names), F.lit(1).alias("_change"))))
    return latest_per_key(tagged, key, ["_change", *order]).select(*map(_q, names))


def apply_mappings(materials: DataFrame, mappings: DataFrame, *, key: str = "material_nr",
                   target: str = "ziel_warengruppe", column: str = "warengruppe",
                   order: Sequence[str] = ("geaendert_am", "version")) -> DataFrame:
    """The latest valid override per material replaces the material's group.

    Only one row per material reaches the join (latest first), so the join
    never fans out.
    """
    rules = [(key, 1, MAPPING_RULES[0][2]), (target, 1, MAPPING_RULES[1][2]), MAPPING_RULES[2]]
    valid = split_valid(mappings, rules).where(F.col("grund").isNull())
    latest = latest_per_key(valid.select(key, target, *order), key, list(order))
    return (materials.join(latest.select(key, target), key, "left")
            .withColumn(column, F.coalesce(F.col(target), F.col(column)))
            .select(*materials.columns))


# Length rules of a mapping request (number 1..40, target 1..80,
# comment at most 500 characters).
MAPPING_RULES = (("material_nr", 1, 40), ("ziel_warengruppe", 1, 80), ("kommentar", 0, 500))


def split_valid(requests: DataFrame, rules: Sequence[tuple[str, int, int]] = MAPPING_RULES) -> DataFrame:
    """Add ``grund``, the first broken rule, or null when the row is valid.

    A required field (min length >= 1) must be present and long enough; an
    optional one (min 0) may be null or absent. A required column that the table
    does not have is missing in every row. Valid rows: ``grund IS NULL``.
    """
    reason = F.lit(None).cast("string")
    for name, low, high in reversed(rules):
        if name not in requests.columns:
            reason = F.lit(f"{name} fehlt") if low >= 1 else reason
            continue
        c = F.col(name)
        length = F.char_length(c)
        if low >= 1:
            reason = (F.when(c.isNull(), F.lit(f"{name} fehlt"))
                      .when(length < low, F.lit(f"{name} zu kurz"))
                      .when(length > high, F.lit(f"{name} zu lang"))
                      .otherwise(reason))
        else:
            reason = F.when(c.isNotNull() & (length > high), F.lit(f"{name} zu lang")).otherwise(reason)
    return requests.withColumn("grund", reason)
