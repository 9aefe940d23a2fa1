"""Delivery KPIs for many tolerances at once (A4), from a histogram that merges.

The histogram has one row per supplier and delay in whole days, from 0 (early and
punctual) up to one day beyond the highest tolerance (all later ones), plus one
for an unknown delay: at most ``highest + 3`` rows per supplier, whatever number
of deliveries it has. Rows hold plain sums, so histograms of disjoint parts (days,
files) merge by addition and answer every tolerance without the deliveries.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockboard.functions.columns import delay_days

HIGHEST = 30
_SUMS = ("lieferungen", "verzug_summe", "mit_reklamationsangabe", "mit_reklamation")


def delay_histogram(deliveries: DataFrame, highest: int = HIGHEST, *, key: str = "lieferant_id") -> DataFrame:
    """Per supplier and delay step (null: delay unknown): deliveries, sum of the exact
    delays, deliveries that state complaints, and those with at least one."""
    if highest < 0:
        raise ValueError("highest tolerance must be >= 0")
    delay = delay_days("geliefert_am", "zugesagt_am")
    step = F.when(delay.isNotNull(), F.least(F.greatest(delay, F.lit(0)), F.lit(highest + 1)))
    return deliveries.groupBy(key, step.alias("verzug_stufe")).agg(
        F.count(F.lit(1)).alias("lieferungen"),
        F.sum(delay.cast("bigint")).alias("verzug_summe"),
        F.count("reklamationen").alias("mit_reklamationsangabe"),
        F.count_if(F.col("reklamationen") > 0).alias("mit_reklamation"))


def merge_histograms(*parts: DataFrame, key: str = "lieferant_id") -> DataFrame:
    """The histogram of all deliveries of the parts; they must have the same highest tolerance."""
    whole = reduce(DataFrame.unionByName, parts)
    return whole.groupBy(key, "verzug_stufe").agg(*[F.sum(c).alias(c) for c in _SUMS])


def kpis_by_tolerance(histogram: DataFrame, highest: int = HIGHEST, *, key: str = "lieferant_id") -> DataFrame:
    """Per supplier and tolerance 0..highest what ``delivery_kpis`` gives for that tolerance.

    ``highest`` may be lower than the histogram's, not higher. Means over no known value are null.
    """
    step, n = F.col("verzug_stufe"), F.col("lieferungen")
    on_time = F.array(*[F.sum(F.when(step <= t, n).otherwise(0)) for t in range(highest + 1)])
    sums = histogram.groupBy(key).agg(
        F.sum(n).alias("lieferungen"),
        F.sum("verzug_summe").alias("_verzug"),
        F.sum(F.when(step.isNotNull(), n).otherwise(0)).alias("_bekannt"),
        F.sum("mit_reklamationsangabe").alias("_angaben"),
        F.sum("mit_reklamation").alias("_reklamiert"),
        on_time.alias("_puenktlich"))

    def share(part: str, whole: str):
        return F.when(F.col(whole) > 0, F.col(part).cast("double") / F.col(whole))

    return (sums.select("*", F.posexplode("_puenktlich").alias("toleranz_tage", "_rechtzeitig"))
            .select(key, "toleranz_tage", "lieferungen",
                    share("_verzug", "_bekannt").alias("mittlerer_verzug_tage"),
                    share("_rechtzeitig", "_bekannt").alias("puenktlich"),
                    share("_reklamiert", "_angaben").alias("reklamationsquote")))
