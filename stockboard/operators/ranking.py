"""Places in a whole order (O1, O3, S7), without one task that sees all rows.

The rows are range-partitioned by the order and sorted within each range, which is
written to the shared checkpoint folder with its range and the place in
it. A range begins where the sizes of the ranges before it end, so a row's position is a
sum; only the sizes (one row per range) are added up in one task. A page reads
the ranges that hold it and no other.
"""
from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockboard.functions.columns import col_exact
from stockboard.operators.filters import check_page
from stockboard.session import ensure_checkpoint_dir

PLACE_BITS = 33                     # monotonically_increasing_id: the lower bits count the rows of a partition


class Ranked:
    """Rows in a total order, stored by range. ``order`` must tell all rows apart (see
    ``paging.total_order``), or equal rows share their places in any order and one range."""

    def __init__(self, df: DataFrame, order: Sequence[Column], ranges: int | None = None):
        spark, self.columns = df.sparkSession, df.columns
        n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
        placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order) \
            .select(F.spark_partition_id().alias("_range"), place.alias("_place"), *map(col_exact, df.columns))
        path = f"{ensure_checkpoint_dir(spark)}/ranked-{uuid.uuid4().hex}"
        placed.write.partitionBy("_range").parquet(path)
        schema = T.StructType([f for f in placed.schema if f.name != "_range"] + [placed.schema["_range"]])
        self.stored = spark.read.schema(schema).parquet(path) if self._any(spark, path) else spark.createDataFrame([], schema)

    @staticmethod
    def _any(spark, path: str) -> bool:
        from stockboard.sources.commit_log import list_folder
        return any(name.startswith("_range=") for name, _ in list_folder(spark, path))

    def starts(self) -> DataFrame:
        """(_range, _start, _size) of each range that has rows."""
        sizes = self.stored.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
        before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)       # one row per range
        return sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"), "_size")

    def rows(self, name: str = "position", first: int = 1) -> DataFrame:
        """All rows with their place in the whole order, in front."""
        starts = self.starts().select(F.col("_range").alias("_r"), "_start")
        position = (F.col("_start") + F.col("_place") + F.lit(first)).cast("bigint")
        return self.stored.join(starts, F.col("_range") == F.col("_r")).select(position.alias(name), *map(col_exact, self.columns))

    def page(self, limit: int, offset: int, name: str = "position") -> DataFrame:
        """Rows ``offset .. offset + limit`` with their positions (from 1), read from the ranges that hold them."""
        check_page(limit, offset)
        held = self.starts().where((F.col("_start") < offset + limit) & (F.col("_start") + F.col("_size") > offset)).collect()
        start = F.lit(None).cast("bigint")
        for r in held:                                    # a page's ranges: few, whatever the table's size
            start = F.when(F.col("_range") == r["_range"], F.lit(r["_start"])).otherwise(start)
        rows = self.stored.where(F.col("_range").isin([r["_range"] for r in held])) if held else self.stored.limit(0)
        position = (start + F.col("_place") + 1).cast("bigint")
        return rows.select(position.alias(name), *map(col_exact, self.columns)) \
            .where((F.col(name) > offset) & (F.col(name) <= offset + limit))
