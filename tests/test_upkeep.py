"""Histograms of delays, tiles kept from changes, the filter ahead of a purge, the search index, stored answers."""
import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from stockboard.operators import aggregates as A
from stockboard.operators import tolerance as TL
from stockboard.operators import upkeep as UK
from stockboard.functions.predicates import search_any, search_joined
from stockboard.session import ensure_checkpoint_dir
from stockboard.sources import graph as GR
from stockboard.sources import purge as PU
from stockboard.sources.search_index import SearchIndex, postings

DELIVERY = "lieferant_id string, geliefert_am date, zugesagt_am date, reklamationen int"
FLAT = "material_nr string, bezeichnung string, warengruppe string, status string"
NODE, EDGE = "node_id string, labels array<string>", "rel string, src string, dst string"


def rows(df):
    return sorted(df.collect(), key=str)


def scratch(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/test-{name}-{uuid.uuid4().hex}"


def random_deliveries(n, seed=3):
    rng, day = random.Random(seed), dt.date(2026, 1, 1)
    return [(rng.choice(["L-1", "L-1", "L-2", None]), day + dt.timedelta(rng.randint(-9, 45)) if rng.random() < .9 else None,
             day, rng.choice([0, 0, 1, 2, None])) for _ in range(n)] + [("L-leer", None, day, None)]


def test_every_tolerance_equals_its_own_aggregate(spark):
    deliveries = spark.createDataFrame(random_deliveries(400), DELIVERY)
    got = TL.kpis_by_tolerance(TL.delay_histogram(deliveries))
    for tolerance in (0, 1, 7, 30):
        alone = got.where(F.col("toleranz_tage") == tolerance).drop("toleranz_tage")
        assert rows(alone) == rows(A.delivery_kpis(deliveries, tolerance))
    assert got.count() == 31 * 4


def test_histograms_of_parts_merge_to_that_of_the_whole(spark):
    data = random_deliveries(300)
    whole = TL.delay_histogram(spark.createDataFrame(data, DELIVERY))
    parts = [TL.delay_histogram(spark.createDataFrame(data[at::3], DELIVERY)) for at in range(3)]
    assert rows(TL.merge_histograms(*parts)) == rows(whole)
    assert whole.groupBy("lieferant_id").count().agg(F.max("count")).first()[0] <= TL.HIGHEST + 3


def test_histogram_of_nothing(spark):
    assert TL.kpis_by_tolerance(TL.delay_histogram(spark.createDataFrame([], DELIVERY))).collect() == []
    with pytest.raises(ValueError):
        TL.delay_histogram(spark.createDataFrame([], DELIVERY), -1)


BEFORE = [("M1", "a", "g", "Aktiv"), ("M2", None, "", "Obsolet"), ("M3", "c", None, "Gesperrt"), (None, "d", "g", "Aktiv")]


def board(spark, data):
    return A.kpi_board(spark.createDataFrame(data, FLAT)).select("kpi_id", "value")


@pytest.mark.parametrize("changes, after", [
    ([("M1", "a2", None, "Obsolet", False)], [("M1", "a2", None, "Obsolet"), *BEFORE[1:]]),
    ([("M2", "x", "x", "Aktiv", True), ("M9", "n", "", "Gesperrt", None)], [BEFORE[0], *BEFORE[2:], ("M9", "n", "", "Gesperrt")]),
    ([("M7", "x", "x", "Aktiv", True), (None, "e", "g", "Aktiv", False)], [*BEFORE, (None, "e", "g", "Aktiv")]),
    ([], BEFORE),
    ([(f"M{i}", None, None, None, True) for i in (1, 2, 3)], BEFORE[3:])])
def test_upkeep_equals_a_recount(spark, changes, after):
    before = spark.createDataFrame(BEFORE, FLAT)
    signed = UK.signed_changes(before, spark.createDataFrame(changes, FLAT + ", geloescht boolean"), "material_nr")
    kept = UK.board_of(UK.add_deltas(UK.board_state(before), UK.board_delta(signed)))
    assert rows(kept.select("kpi_id", "value")) == rows(board(spark, after))
    tag = A.content_fingerprint(spark.createDataFrame(after, FLAT)).first()
    assert {(r.n_rows, r.fingerprint) for r in kept.collect()} == {(tag.n_rows, tag.fingerprint)}


def test_deltas_add_up_in_any_order_and_to_nothing_when_taken_back(spark):
    before = spark.createDataFrame(BEFORE, FLAT)
    there = UK.board_delta(before.withColumn(UK.SIGN, F.lit(1)))
    back = UK.board_delta(before.withColumn(UK.SIGN, F.lit(-1)))
    state = UK.board_state(before)
    assert rows(UK.add_deltas(state, there, back)) == rows(UK.add_deltas(state, back, there)) == rows(state)
    assert UK.add_deltas(state, back).first().n_rows == 0


def test_filtered_purge_equals_the_plain_one(spark):
    rng = random.Random(5)
    nodes = spark.createDataFrame([(f"n{i}", ["Mock", "M"] if i % 7 == 0 else ["M"]) for i in range(500)], NODE)
    ends = [f"n{i}" for i in range(520)] + [None]
    edges = spark.createDataFrame([("r", rng.choice(ends), rng.choice(ends)) for _ in range(3000)], EDGE)
    for blocks in (1, 8, PU.BLOCKS):
        got, plain = PU.purge_label_filtered(nodes, edges, "Mock", blocks), GR.purge_label(nodes, edges, "Mock")
        assert [rows(x) for x in got] == [rows(x) for x in plain]
    none = PU.purge_label_filtered(nodes, edges, "absent")
    assert rows(none[1]) == rows(edges) and none[0].count() == 500
    assert PU.purge_label_filtered(nodes, edges.limit(0), "Mock")[1].collect() == []


def test_filter_misses_no_id_and_keeps_most_others_off_the_anti_joins(spark):
    ids = spark.range(2000).select(F.concat(F.lit("id"), "id").alias("id"))
    filter_ = PU.bloom_blocks(ids, "id", 4)
    others = spark.range(2000, 8000).select(F.concat(F.lit("id"), "id").alias("id"))
    assert PU.flag_may_hold(ids, "id", filter_, "f", 4).where("f").count() == 2000
    assert PU.flag_may_hold(others, "id", filter_, "f", 4).where("f").count() < 120
    assert filter_.count() <= 4


def test_filter_is_in_the_plan_ahead_of_the_anti_joins(spark):
    root = scratch(spark, "purge")
    graph = GR.store_graph(spark.createDataFrame([("a", ["Mock"])], NODE), spark.createDataFrame([("r", "a", "b")], EDGE), root)
    plan = PU.purge_label_filtered(*graph, "Mock")[1]._jdf.queryExecution().executedPlan().toString()
    assert "bitmap_construct_agg" in plan and plan.count("LeftAnti") >= 2 and "CartesianProduct" not in plan


MATERIALS = [("MAT-1", "Blaues Rohr", 1), ("MAT-2", None, 2), ("MAT-3", "rohr (blau) 100%", 3), (None, "Rohrzange", 4),
             ("MAT-3", "anderes", 5), ("MAT-4", "", 6), ("MAT-5", "Größe 😀 XL", 7), ("MAT-6", "x" * 5000 + "rohr", 8)]


@pytest.fixture(scope="module")
def index(spark):
    table = spark.createDataFrame(MATERIALS, "material_nr string, bezeichnung string, trigram int")
    return SearchIndex.build(table, scratch(spark, "search"), "material_nr", ("material_nr", "bezeichnung"))


@pytest.mark.parametrize("needle", ["rohr", " ROHR ", "mat-3", "t-3 ROHR", "größe", "😀 x", "100%", "(bl", "-3", "a", "", None,
                                    "   ", "nirgends", "xxx", "xrohr", "3 an", "4 "])
def test_index_finds_what_the_plain_search_finds(index, needle):
    names = ["material_nr", "bezeichnung"]
    for got, predicate in ((index.search_any(needle), search_any(names, needle)),
                           (index.search_joined(needle), search_joined(names, needle))):
        assert rows(got) == rows(index.rows() if predicate is None else index.rows().where(predicate))


def test_needles_of_three_letters_read_the_postings_and_shorter_ones_do_not(spark, index):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()
    assert "In(trigram" in plan(index.search_any("rohr")) or "EqualTo(trigram" in plan(index.search_any("rohr"))
    assert "postings" not in plan(index.search_any("ro"))
    assert index.search_any("rohr", ["bezeichnung"]).count() == 4
    with pytest.raises(ValueError):
        index.search_any("rohr", ["status"])
    assert postings(spark.createDataFrame([], "k string, t string"), "k", ["t"]).collect() == []
