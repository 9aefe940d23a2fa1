"""Seeded synthetic data.

Every random draw is a hash of (seed, column, row id): the first 15 hex digits
of a SHA-256 read as a number. The draws do not depend on partitioning, task
order or retries, so a lost executor recomputes exactly the same rows, and the
same rows come out at 1 or 1000 partitions. Values differ from Python's
``random``; domains, weights and determinism are what is kept.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The seed's domains and weights, in their natural order.
GROUPS = ("Betriebsstoffe", "Rohstoffe", "Fertigerzeugnisse", "Verpackung", "Ersatzteile",
          "Halbfabrikate", "")
GROUP_WEIGHTS = (18, 18, 18, 12, 12, 16, 6)
PLANTS = (("W-KOE", "Werk Koeln"), ("W-BER", "Werk Berlin"), ("W-MUC", "Werk Muenchen"),
          ("W-HAM", "Werk Hamburg"))
STATUSES = ("Aktiv", "Nicht geliefert", "Obsolet", "Gesperrt")
STATUS_WEIGHTS = (55, 18, 15, 12)
UNITS = ("M", "KG", "L", "PAK", "ST")
NAMES = ("Gewindestange M10", "Sensorhalter Typ B", "Dichtungsring NBR 25", "Aluminiumprofil 40x40",
         "Steckverbinder 4-pol", "Oelfilter Standard", "Edelstahlschraube M8x40",
         "Fuehrungsschiene 500mm", "Zahnriemen HTD-5M")
STOCK_RANGE = (300, 9800)
PRICE_CENTS_RANGE = (50, 48000)
CHANGE_MONTHS = (1, 8)
CHANGE_DAYS = (1, 28)
# Deliveries: 40 per supplier, a promise every 5 days from 2026-01-01,
# delay = max(0, round(bias + uniform(-3, 3))), quantity 10..899,
# complaints 0/1/2 at weights 85/12/3; per-supplier delay bias drawn from 0, 2, 6, 1.
DELIVERIES_PER_SUPPLIER = 40
PROMISE_START = "2026-01-01"
PROMISE_STEP_DAYS = 5
DELAY_BIASES = (0, 2, 6, 1)
QUANTITY_RANGE = (10, 899)
COMPLAINTS = (0, 1, 2)
COMPLAINT_WEIGHTS = (85, 12, 3)


def draw(seed: int, column: str, *ids: Column) -> Column:
    """A 60-bit non-negative pseudo-random number for each row."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(column), *[i.cast("string") for i in ids])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def uniform_int(d: Column, low: int, high: int) -> Column:
    return F.lit(low) + d % F.lit(high - low + 1)


def choice(d: Column, values: Sequence) -> Column:
    idx = d % F.lit(len(values))
    out = F.when(idx == 0, F.lit(values[0]))
    for i, v in enumerate(values[1:], start=1):
        out = out.when(idx == i, F.lit(v))
    return out


def weighted_choice(d: Column, values: Sequence, weights: Sequence[int]) -> Column:
    """Cumulative weights against ``d % sum(weights)``."""
    r = d % F.lit(sum(weights))
    bound, out = 0, None
    for v, w in zip(values, weights):
        bound += w
        out = F.when(r < bound, F.lit(v)) if out is None else out.when(r < bound, F.lit(v))
    return out


def generate_materials(ids: DataFrame, seed: int = 42, id_col: str = "i") -> DataFrame:
    """One synthetic material per id; number ``MAT-{100777 + 13 i}``."""
    i = F.col(id_col)
    d = lambda name: draw(seed, name, i)
    plant = d("werk") % F.lit(len(PLANTS))
    month = uniform_int(d("monat"), *CHANGE_MONTHS)
    day = uniform_int(d("tag"), *CHANGE_DAYS)
    return ids.select(
        i.cast("bigint").alias("i"),
        F.concat(F.lit("MAT-"), (F.lit(100777) + i * 13).cast("string")).alias("material_nr"),
        choice(d("name"), NAMES).alias("bezeichnung"),
        weighted_choice(d("warengruppe"), GROUPS, GROUP_WEIGHTS).alias("warengruppe"),
        choice(plant, [p[0] for p in PLANTS]).alias("werk_id"),
        choice(plant, [p[1] for p in PLANTS]).alias("werk_name"),
        weighted_choice(d("status"), STATUSES, STATUS_WEIGHTS).alias("status"),
        choice(d("einheit"), UNITS).alias("einheit"),
        uniform_int(d("bestand"), *STOCK_RANGE).cast("bigint").alias("bestand"),
        (uniform_int(d("preis"), *PRICE_CENTS_RANGE).cast("double") / F.lit(100.0)).alias("preis"),
        F.format_string("2026-%02d-%02d", month.cast("int"), day.cast("int")).alias("geaendert"),
    )


def generate_deliveries(suppliers: DataFrame, n_materials: int, seed: int = 42,
                        per_supplier: int = DELIVERIES_PER_SUPPLIER,
                        key: str = "lieferant_id") -> DataFrame:
    """``per_supplier`` deliveries for every supplier row.

    The series is an ``explode(sequence(0, n-1))`` per supplier row: no join,
    and each supplier's rows are produced where that supplier already is.
    """
    s = F.col(key)
    series = suppliers.select(s.alias(key), F.explode(F.sequence(F.lit(0), F.lit(per_supplier - 1))).alias("n"))
    n = F.col("n")
    d = lambda name: draw(seed, name, F.col(key), n)
    bias = choice(draw(seed, "bias", F.col(key)), DELAY_BIASES)
    # delay in hundredths of a day: bias + uniform(-3.00, 3.00); rounded half up, at least 0
    hundredths = bias * 100 + uniform_int(d("verzug"), -300, 300)
    delay = F.greatest(F.lit(0), F.floor((hundredths + 50) / F.lit(100)).cast("int"))
    promised = F.date_add(F.lit(PROMISE_START).cast("date"), (n * PROMISE_STEP_DAYS).cast("int"))
    mat = uniform_int(d("material"), 0, n_materials - 1)
    return series.select(
        F.col(key),
        F.concat(F.lit("MAT-"), (F.lit(100777) + mat * 13).cast("string")).alias("material_nr"),
        promised.alias("zugesagt_am"),
        F.date_add(promised, delay).alias("geliefert_am"),
        uniform_int(d("menge"), *QUANTITY_RANGE).cast("int").alias("menge"),
        weighted_choice(d("reklamationen"), COMPLAINTS, COMPLAINT_WEIGHTS).cast("int").alias("reklamationen"),
    )


def dense_index(materials: DataFrame, key: str, ranges: int | None = None) -> DataFrame:
    """``key`` with its rank ``i`` from 0 among the distinct keys, of any sortable type and
    however sparse: ranks within ranges of the keys, plus the number of keys in the ranges before."""
    from stockboard.operators.ranking import Ranked
    keys = materials.select(F.col(key)).where(F.col(key).isNotNull()).distinct()
    return Ranked(keys, [F.col(key).asc()], ranges).rows("i", first=0).select("i", key)


def sample_supplier_links(suppliers: DataFrame, materials: DataFrame, n_materials: int,
                          k_min: int = 8, k_max: int = 30, seed: int = 42) -> DataFrame:
    """Per supplier a sample WITHOUT replacement of k in [k_min, k_max] materials.

    Materials are addressed by their dense index ``i`` in ``0..n_materials-1``
    (``dense_index`` makes one). Each supplier row draws its k distinct indices
    by Floyd's method, a fold over the last k indices: draw t up to j; take t,
    or j if t is taken already. At most ``k_max`` rows are made per supplier and
    no supplier x material pairs; the indices then meet the materials in an
    equi-join.
    """
    if not 0 <= k_min <= k_max:
        raise ValueError("need 0 <= k_min <= k_max")
    sid, low, high = F.col("lieferant_id"), min(k_min, n_materials), min(k_max, n_materials)
    k = uniform_int(draw(seed, "k", sid), low, high)
    drawn = suppliers.select(sid, k.alias("k"))

    def fold(taken: Column, j: Column) -> Column:
        t = draw(seed, "pick", sid, j) % (j + 1)
        return F.array_append(taken, F.when(F.array_contains(taken, t), j).otherwise(t))

    last = F.sequence(F.lit(n_materials).cast("bigint") - F.col("k"), F.lit(n_materials - 1).cast("bigint"))
    picks = drawn.where("k > 0").select(sid, F.explode(
        F.aggregate(last, F.array().cast("array<bigint>"), fold)).alias("i"))
    return picks.join(materials.select("i", "material_nr"), "i", "inner").select("lieferant_id", "material_nr")
