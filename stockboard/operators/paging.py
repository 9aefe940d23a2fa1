"""Sorting, paging and the envelope's meta row.

A page is ``orderBy(...).offset(o).limit(n)``, which Spark plans as a
``TakeOrderedAndProject`` of ``o + n`` rows: every task keeps its own top
``o + n`` and only those reach the final merge. The order must be total, or
two runs may cut pages differently; callers pass a unique tie-break.
"""
from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockboard.functions.columns import col_exact
from stockboard.operators.filters import check_page

DEFAULT_LIMIT = 1000
TABLE_PAGE_SIZE = 20


def total_order(df: DataFrame, first: Sequence[Column]) -> list[Column]:
    """``first`` followed by every column ascending, nulls last: a total order."""
    return list(first) + [col_exact(c).asc_nulls_last() for c in df.columns]


def page(df: DataFrame, order: Sequence[Column], limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """O3: rows ``offset .. offset + limit`` of the ordered result."""
    check_page(limit, offset)
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def page_after(df: DataFrame, keys: Sequence[str], after: Sequence | None, limit: int = DEFAULT_LIMIT,
               descending: bool = False) -> DataFrame:
    """O3 for deep pages: the ``limit`` rows that follow the key tuple ``after``.

    ``keys`` must be unique and non-null (a total order). Instead of ranking
    ``offset + limit`` rows in every task, one lexicographic filter drops the
    rows before the cursor and a ``limit`` top-k takes the page, so the cost
    of page 10 000 equals that of page 1. ``after=None`` gives the first page.
    """
    check_page(limit, 0)
    cols = [col_exact(k) for k in keys]
    if after is not None:
        if len(after) != len(keys):
            raise ValueError("cursor and keys differ in length")
        beyond = None
        for i in reversed(range(len(keys))):
            step = (cols[i] < F.lit(after[i])) if descending else (cols[i] > F.lit(after[i]))
            if beyond is not None:
                step = step | ((cols[i] == F.lit(after[i])) & beyond)
            beyond = step
        df = df.where(beyond)
    order = [c.desc() if descending else c.asc() for c in cols]
    return df.orderBy(*order).limit(limit)


def with_position(rows: DataFrame, order: Sequence[Column], offset: int = 0) -> DataFrame:
    """The rows of a page with their place in the whole order (from 1), in front.
    For pages only: one task numbers them."""
    place = F.row_number().over(Window.orderBy(*order)) + F.lit(offset)
    return rows.select(place.cast("bigint").alias("position"), *[col_exact(c) for c in rows.columns])


def sorted_page(df: DataFrame, column: str, direction: str = "asc", page_no: int = 0,
                size: int = TABLE_PAGE_SIZE) -> DataFrame:
    """User sort on any column, ``size`` rows per page, page numbers from 0."""
    if direction not in ("asc", "desc"):
        raise ValueError("direction must be 'asc' or 'desc'")
    c = col_exact(column)
    first = c.asc_nulls_last() if direction == "asc" else c.desc_nulls_last()
    return page(df, total_order(df, [first]), limit=size, offset=page_no * size)


def risk_order(df: DataFrame) -> list[Column]:
    """O2: score descending; ties by supplier id."""
    return [F.col("risiko_score").desc_nulls_last(), F.col("lieferant_id").asc_nulls_last()]


def source_label(sources: Sequence[str]) -> str:
    """Source names sorted and joined by '+', 'none' when empty."""
    names = sorted(set(sources))
    return "+".join(names) if names else "none"


def _utc_naive(t: dt.datetime) -> dt.datetime:
    return t.astimezone(dt.timezone.utc).replace(tzinfo=None) if t.tzinfo else t


def envelope_meta(result: DataFrame, *, product: str, version: str, generated_at: dt.datetime,
                  limit: int = DEFAULT_LIMIT, offset: int = 0, sources: Sequence[str] = (),
                  cache: str = "miss", deprecated: bool = False,
                  sunset: dt.date | None = None) -> DataFrame:
    """The one-row meta of a product response.

    ``total_count`` is the row count after filters and before paging;
    ``row_count`` the size of the page. One aggregate over ``result``.
    """
    check_page(limit, offset)
    total = F.count(F.lit(1))
    row_count = F.least(F.lit(limit).cast("bigint"), F.greatest(total - F.lit(offset), F.lit(0)))
    return result.agg(
        F.lit(product).alias("product"), F.lit(version).alias("version"),
        F.lit("v1").alias("api_version"),
        F.lit(_utc_naive(generated_at).isoformat(sep=" ")).cast("timestamp_ntz").alias("generated_at"),
        row_count.cast("bigint").alias("row_count"), total.alias("total_count"),
        F.lit(source_label(sources)).alias("source"), F.lit(cache).alias("cache"),
        F.lit(deprecated).alias("deprecated"),
        F.lit(sunset).cast("date").alias("sunset"))
