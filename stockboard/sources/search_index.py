"""Text search on stored tables through a trigram posting index.

The index holds one row per distinct (trigram, key) of a table's searched columns, joined by one
space and lower-cased. One index serves both searches: a needle within one column lies within the
joined text too. It is written range-partitioned and sorted by (trigram, key), so that a hot trigram
is spread over many files and ``trigram IN (...)`` skips the row groups of all others. A second
small table counts the rows of each trigram.

A search reads the postings of the needle's rarest trigrams, intersects them per key, and fetches
and verifies those rows with the plain predicate, so its rows are exactly those of ``search_any``
or ``search_joined``. Needles of less than three characters fall back to the plain search.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockboard.functions.columns import col_exact
from stockboard.functions.predicates import normalize_needle, search_any, search_joined

SIZE = 3
#: Trigrams of a needle whose postings are read; the others are left to the verification.
RAREST = 4


def _trigrams(needle: str) -> list[str]:
    return sorted({needle[i:i + SIZE] for i in range(len(needle) - SIZE + 1)})


def postings(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Distinct (trigram, key) of the columns' joined lower-case text; shorter texts have none."""
    parts = [F.coalesce(col_exact(c).cast("string"), F.lit("")) for c in columns]
    letters = rows.select(col_exact(key).alias("key"),
                          F.split(F.lower(F.concat_ws(" ", *parts)), "").alias("letters"))
    starts = F.when(F.size("letters") >= SIZE, F.sequence(F.lit(1), F.size("letters") - (SIZE - 1)))
    grams = F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice("letters", i, SIZE), "")))
    return letters.select("key", F.explode(grams).alias("trigram")).distinct().select("trigram", "key")


@dataclass(frozen=True)
class SearchIndex:
    """A stored table with its postings, under ``root`` (shared storage)."""
    spark: SparkSession
    root: str
    key: str
    columns: tuple[str, ...]

    @classmethod
    def build(cls, rows: DataFrame, root: str, key: str, columns: Sequence[str]) -> SearchIndex:
        """Write the rows, their postings and the postings' counts into new folders under ``root``."""
        spark = rows.sparkSession
        rows.write.parquet(f"{root}/rows")
        stored = spark.read.parquet(f"{root}/rows")
        (postings(stored, key, columns).repartitionByRange("trigram", "key")
         .sortWithinPartitions("trigram", "key").write.parquet(f"{root}/postings"))
        (spark.read.parquet(f"{root}/postings").groupBy("trigram").agg(F.count(F.lit(1)).alias("n"))
         .repartitionByRange("trigram").sortWithinPartitions("trigram").write.parquet(f"{root}/counts"))
        return cls(spark, root, key, tuple(columns))

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/rows")

    def candidates(self, needle: str) -> DataFrame | None:
        """Keys of rows that may hold the needle; None when it is too short to tell."""
        grams = _trigrams(normalize_needle(needle))
        if not grams:
            return None
        counted = self.spark.read.parquet(f"{self.root}/counts").where(F.col("trigram").isin(grams))
        found = {r.trigram: r.n for r in counted.collect()}         # at most one row per trigram of the needle
        chosen = sorted(grams, key=lambda g: (found.get(g, 0), g))[:RAREST]
        hits = self.spark.read.parquet(f"{self.root}/postings").where(F.col("trigram").isin(chosen))
        return hits.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(chosen)).select("key")

    def _verified(self, needle: str, predicate) -> DataFrame:
        rows, keys = self.rows(), self.candidates(needle)
        if predicate is None:
            return rows
        if keys is not None:
            rows = rows.join(keys.withColumnRenamed("key", "_key"), col_exact(self.key).eqNullSafe(F.col("_key")), "left_semi")
        return rows.where(predicate)

    def search_any(self, needle: str | None, columns: Sequence[str] | None = None) -> DataFrame:
        """F3 over the indexed columns or some of them; an empty needle returns all rows."""
        chosen = list(columns or self.columns)
        if not set(chosen) <= set(self.columns):
            raise ValueError(f"only {', '.join(self.columns)} are indexed")
        return self._verified(needle or "", search_any(chosen, needle))

    def search_joined(self, needle: str | None) -> DataFrame:
        """F4 over the indexed columns in their order; an empty needle returns all rows."""
        return self._verified(needle or "", search_joined(list(self.columns), needle))
