"""Filter state and its application (F6, F7, F9, F11) plus parameter checks.

``apply_filters`` gathers the active predicates into ONE ``filter`` call;
Catalyst pushes the ``IN`` parts into the Parquet reader and keeps the text
search as a Filter above it.
"""
from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockboard.functions.predicates import all_of, multiselect, search_any, unclassified
from stockboard.operators.aggregates import KPI_DEFINITIONS

# Columns filtered by multi-select in the dashboard, and the search columns.
MULTISELECT_COLUMNS = ("status", "werk", "warengruppe")
SEARCH_COLUMNS = ("material_nr", "bezeichnung")


@dataclass(frozen=True)
class FilterState:
    """The dashboard's canonical filter state (missing -> default, text trimmed)."""
    status: tuple[str, ...] = ()
    werk: tuple[str, ...] = ()
    warengruppe: tuple[str, ...] = ()
    search: str = ""
    ohne_klass: bool = False

    @classmethod
    def normalize(cls, raw: Mapping | None) -> FilterState:
        """From loose input: keys that are no field are ignored; a missing or empty
        value is the field's default, which also says how a value is read."""
        given = raw or {}
        read = {tuple: tuple, str: str.strip, bool: bool}
        return cls(**{f.name: read[type(f.default)](given[f.name]) for f in fields(cls) if given.get(f.name)})

    def updated(self, partial: Mapping) -> FilterState:
        return FilterState.normalize({**asdict(self), **partial})


def filter_predicate(state: FilterState | Mapping | None) -> Column | None:
    """the conjunction of all active predicates; None when nothing is active."""
    st = state if isinstance(state, FilterState) else FilterState.normalize(state)
    preds = []
    ms = multiselect({c: getattr(st, c) for c in MULTISELECT_COLUMNS})
    if ms is not None:
        preds.append(ms)
    if st.ohne_klass:
        preds.append(unclassified("warengruppe"))
    s = search_any(SEARCH_COLUMNS, st.search)
    if s is not None:
        preds.append(s)
    return all_of(preds)


def apply_filters(df: DataFrame, state: FilterState | Mapping | None) -> DataFrame:
    """filter by the state; with no active predicate the DataFrame itself returns."""
    pred = filter_predicate(state)
    return df if pred is None else df.filter(pred)


def kpi_state(kpi_id: str, base: FilterState | None = None) -> FilterState:
    """The filter a KPI tile applies: a partial update of status and the flag."""
    for k_id, _label, _color, flt in KPI_DEFINITIONS:
        if k_id == kpi_id:
            return (base or FilterState()).updated(flt)
    raise KeyError(f"unknown KPI {kpi_id!r}")


def kpi_is_active(kpi_id: str, state: FilterState | Mapping | None) -> bool:
    """Whether the current state is exactly the KPI's filter on the dimensions a
    tile controls (status set and the unclassified flag); plant, group and
    search are ignored. Derived from the state, never stored beside it."""
    st = state if isinstance(state, FilterState) else FilterState.normalize(state)
    want = kpi_state(kpi_id)
    return set(st.status) == set(want.status) and st.ohne_klass == want.ohne_klass


def kpi_drilldown(df: DataFrame, kpi_id: str, base: FilterState | None = None) -> DataFrame:
    """apply a KPI's stored filter to the table."""
    return apply_filters(df, kpi_state(kpi_id, base))


def min_group_size(df: DataFrame, column: str, minimum: int) -> DataFrame:
    """keep groups whose count is at least ``minimum`` (HAVING)."""
    return df.where(F.col(column) >= F.lit(minimum))


def keep_values(df: DataFrame, column: str, values: Sequence[str] | None) -> DataFrame:
    """keep the listed values; None or empty keeps all."""
    return df.where(F.col(column).isin(list(values))) if values else df


# --- driver-side parameter checks (not operators) ---------------------------

MAX_LIMIT = 50_000


def check_params(params: Mapping, allowed: Iterable[str]) -> None:
    unknown = set(params) - set(allowed)
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")


def check_page(limit: int, offset: int) -> None:
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be 1..{MAX_LIMIT}")
    if offset < 0:
        raise ValueError("offset must be >= 0")
