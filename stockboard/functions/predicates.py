"""Predicate builders.

Each returns a boolean ``Column``. Plain comparisons and ``isin`` reach the
Parquet reader as pushed filters; the substring searches stay a Filter above
the scan because ``lower(x)`` cannot be pushed.
"""
from __future__ import annotations

import functools
import operator
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def all_of(predicates: Iterable[Column]) -> Column | None:
    """AND of the predicates; None when there are none (= no constraint)."""
    preds = list(predicates)
    return functools.reduce(operator.and_, preds) if preds else None


def multiselect(selections: Mapping[str, Sequence[str]]) -> Column | None:
    """``IN`` per column, AND across columns; an empty list sets no constraint.

    A null value never matches.
    """
    return all_of(F.col(name).isin(list(values))
                  for name, values in selections.items() if values)


def unclassified(c: Column | str = "warengruppe") -> Column:
    """null or the empty string; whitespace is not blank."""
    x = _col(c)
    return x.isNull() | (x == F.lit(""))


def normalize_needle(needle: str | None) -> str:
    return (needle or "").strip().lower()


def search_any(columns: Sequence[str], needle: str | None) -> Column | None:
    """case-insensitive literal substring in any of the columns.

    A null column is no hit; a row whose hits are all null is dropped.
    None when the trimmed needle is empty.
    """
    n = normalize_needle(needle)
    if not n:
        return None
    return functools.reduce(operator.or_, (F.lower(F.col(c)).contains(F.lit(n)) for c in columns))


def search_joined(columns: Sequence[str], needle: str | None) -> Column | None:
    """substring of the columns joined by one space, so a needle may span them.

    Unlike the text formatting it replaces, a null column counts as the empty
    string (not as the word ``None``).
    """
    n = normalize_needle(needle)
    if not n:
        return None
    parts = []
    for i, c in enumerate(columns):
        if i:
            parts.append(F.lit(" "))
        parts.append(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return F.lower(F.concat(*parts)).contains(F.lit(n))


def min_value(c: Column | str, minimum: float | None) -> Column | None:
    """``coalesce(value, 0) >= minimum``: minimum 0 keeps nulls, above 0 drops them."""
    if minimum is None:
        return None
    return F.coalesce(_col(c), F.lit(0)) >= F.lit(minimum)


# The operators of the table's own column filter row.
COLUMN_FILTER_OPS = ("=", "!=", "<", "<=", ">", ">=", "contains")


def column_filter(name: str, op: str, value, *, numeric: bool = False) -> Column:
    """one ad-hoc column predicate, case-insensitive on text.

    Text columns compare lower-cased text; numeric columns compare numbers.
    ``contains`` always works on the text form.
    """
    if op not in COLUMN_FILTER_OPS:
        raise ValueError(f"unknown column filter operator {op!r}")
    c = F.col(name)
    if op == "contains":
        return F.lower(c.cast("string")).contains(F.lit(str(value).lower()))
    if numeric:
        left, right = c, F.lit(value)
    else:
        left, right = F.lower(c), F.lit(str(value).lower())
    return {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le,
            ">": operator.gt, ">=": operator.ge}[op](left, right)


def column_filters(specs: Iterable[tuple[str, str, object]],
                   numeric_columns: Iterable[str] = ()) -> Column | None:
    """AND of several (column, operator, value) predicates."""
    numeric = set(numeric_columns)
    return all_of(column_filter(n, op, v, numeric=n in numeric) for n, op, v in specs)
