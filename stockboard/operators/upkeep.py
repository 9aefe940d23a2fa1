"""KPI tiles and content fingerprint kept up to date from changes.

The state is one row of plain sums: rows, one count per tile, and the two sums of row hashes. A
change set is turned into signed rows, the stored row going out (-1) and the new one coming in
(+1); their sums are added to the state. Only the changed keys are looked up in the stored table.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockboard.functions.columns import col_exact
from stockboard.functions.predicates import unclassified
from stockboard.operators.aggregates import STATUSES, fingerprint_text, kpi_tiles, row_lanes, status_key

SIGN = "_vorzeichen"


def signed_changes(before: DataFrame, changes: DataFrame, key: str, deleted: str = "geloescht") -> DataFrame:
    """Rows of ``before`` that a change replaces or deletes with sign -1, new rows with sign +1.

    ``changes`` has the columns of ``before`` and the flag ``deleted`` (null: not deleted), with one row
    per key (``keyed.latest_per_key`` makes it so). A key that is not stored is an insert; deleting it does
    nothing. A null key matches nothing: it inserts, and deletes nothing.
    """
    columns = [col_exact(c) for c in before.columns]
    keys = changes.select(col_exact(key).alias("_schluessel"))
    out = before.join(keys, col_exact(key) == F.col("_schluessel"), "left_semi")
    new = changes.where(~F.coalesce(col_exact(deleted), F.lit(False)))
    return (out.select(*columns, F.lit(-1).alias(SIGN))
            .unionByName(new.select(*columns, F.lit(1).alias(SIGN))))


def _sums(rows: DataFrame, columns: Sequence[str], sign: Column) -> DataFrame:
    def counted(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, sign).otherwise(0)), F.lit(0)).cast("bigint")

    zero = F.lit(0).cast("decimal(38,0)")
    return rows.agg(
        counted(F.lit(True)).alias("n_rows"),
        *[counted(F.col("status") == F.lit(s)).alias(status_key(s)) for s in STATUSES],
        counted(unclassified("warengruppe")).alias("ohne_klassifizierung"),
        *[F.coalesce(F.sum((lane * sign).cast("decimal(38,0)")), zero).cast("decimal(38,0)").alias(f"lane_{i}")
          for i, lane in enumerate(row_lanes(columns), start=1)])


def board_state(rows: DataFrame) -> DataFrame:
    """The one-row state of a whole table with ``status`` and ``warengruppe``; all its columns are fingerprinted."""
    return _sums(rows, rows.columns, F.lit(1))


def board_delta(signed: DataFrame) -> DataFrame:
    """The one-row sums of signed rows, to be added to a state of the same columns."""
    return _sums(signed, [c for c in signed.columns if c != SIGN], F.col(SIGN))


def add_deltas(state: DataFrame, *deltas: DataFrame) -> DataFrame:
    """The state after the deltas, in any order."""
    whole = state
    for delta in deltas:
        whole = whole.unionByName(delta)
    return whole.agg(*[F.sum(c).cast(t).alias(c) for c, t in state.dtypes])


def board_of(state: DataFrame) -> DataFrame:
    """The tiles of ``kpi_board`` and, on each, the ``content_fingerprint`` of the table."""
    return kpi_tiles(state.withColumn("fingerprint", fingerprint_text(["lane_1", "lane_2"])),
                     extra=("n_rows", "fingerprint"))
