"""The commit log under the snapshots, its bound and clean-up, and places in whole orders."""
import datetime as dt
import os
import threading
import uuid

import pytest
from pyspark.sql import functions as F

from stockboard.operators import paging as PG
from stockboard.operators.ranking import Ranked
from stockboard.session import ensure_checkpoint_dir
from stockboard.sources import commit_log as CL
from stockboard.sources import generate as G
from stockboard.sources import snapshots as SN

T0 = dt.datetime(2026, 3, 1)


@pytest.fixture
def root(spark):
    return f"{ensure_checkpoint_dir(spark)}/log-{uuid.uuid4().hex}"


def test_an_entry_is_created_once(spark, root):
    path = f"{root}/x/1.json"
    assert CL.create_if_absent(spark, path, "first") and not CL.create_if_absent(spark, path, "second")
    assert open(CL.local_path(path)).read() == "first" and [n for n, _ in CL.list_folder(spark, f"{root}/x")] == ["1.json"]
    assert CL.list_folder(spark, f"{root}/none") == []


def test_hadoop_path_of_create(spark, root, monkeypatch):
    monkeypatch.setattr(CL, "local_path", lambda path: None)
    path = f"{root}/y/1.json"
    assert CL.create_if_absent(spark, path, "first") and not CL.create_if_absent(spark, path, "second")
    assert [n for n, _ in CL.list_folder(spark, f"{root}/y") if not n.startswith(".")] == ["1.json"]
    CL.remove(spark, path)
    assert [n for n, _ in CL.list_folder(spark, f"{root}/y") if not n.startswith(".")] == []


def test_a_rebuild_at_the_time_of_a_drop_is_live(spark, root):
    build = lambda: spark.range(3)
    SN.get_or_build(spark, root, "k", "p", T0, 60, build)
    assert SN.invalidate_snapshots(spark, root, T0, "p") == 1
    data, state = SN.get_or_build(spark, root, "k", "p", T0, 60, build)
    assert (data.count(), state) == (3, "miss")
    assert SN.get_or_build(spark, root, "k", "p", T0, 60, build)[1] == "hit"


def test_two_writers_lose_nothing(spark, root):
    def put(name):
        for i in range(3):
            SN.materialize_snapshot(spark.range(i + 1), root, f"{name}{i}", "p", T0, 60)
    writers = [threading.Thread(target=put, args=(name,)) for name in "ab"]
    [w.start() for w in writers], [w.join() for w in writers]
    assert sorted(r.snapshot_key for r in SN.valid_snapshots(spark, root, T0).collect()) == ["a0", "a1", "a2", "b0", "b1", "b2"]
    assert CL.CommitLog(spark, root).numbers() == [1, 2, 3, 4, 5, 6]


def test_a_late_writer_tries_the_next_number(spark, root):
    log, asked = CL.CommitLog(spark, root), []

    def make(rows):
        asked.append(len(rows))
        if len(asked) == 1:                                  # another writer is first
            SN.invalidate_snapshots(spark, root, T0, "other")
        return [{"kind": "drop", "product": "mine", "at": "2026-03-01"}], "done"
    assert log.commit(make) == "done" and asked == [0, 1] and log.numbers() == [1, 2]


def test_eviction_by_the_earliest_end(spark, root):
    for key, ttl in (("a", 300), ("b", 100), ("c", 200)):
        SN.materialize_snapshot(spark.range(1), root, key, "p", T0, ttl, max_entries=2)
    live = lambda at: sorted(r.snapshot_key for r in SN.valid_snapshots(spark, root, at).collect())
    assert live(T0) == ["a", "c"]
    SN.materialize_snapshot(spark.range(2), root, "a", "p", T0, 50, max_entries=2)      # replaced: nothing else goes
    assert live(T0) == ["a", "c"]
    late = T0 + dt.timedelta(seconds=150)                                             # a has ended and does not count
    SN.materialize_snapshot(spark.range(1), root, "d", "p", late, 100, max_entries=2)
    assert live(late) == ["c", "d"]
    with pytest.raises(ValueError):
        SN.materialize_snapshot(spark.range(1), root, "e", "p", T0, 10, max_entries=0)


def test_vacuum_removes_what_nothing_needs(spark, root):
    for i in range(3):
        SN.materialize_snapshot(spark.range(i), root, "k", "p", T0, 60)
    SN.publish_table(spark.range(4), root, "t", T0)
    SN.publish_table(SN.current_table(spark, root, "t").withColumn("x", F.lit(1)), root, "t", T0)
    assert SN.vacuum(spark, root, T0) == 0                                            # all are fresh
    assert SN.compact_manifest(spark, root, T0) == 1
    assert SN.vacuum(spark, root, T0, keep_seconds=-5) == 3
    assert CL.CommitLog(spark, root).numbers() == [6]
    assert SN.read_snapshot(spark, root, "k", T0)[0].count() == 2
    assert SN.current_table(spark, root, "t").columns == ["id", "x"] and SN.current_table(spark, root, "none") is None
    SN.materialize_snapshot(spark.range(7), root, "k", "p", T0, 60)
    assert SN.read_snapshot(spark, root, "k", T0)[0].count() == 7
    assert len(os.listdir(CL.local_path(f"{root}/data"))) == 3


def test_compaction_keeps_later_entries(spark, root):
    SN.materialize_snapshot(spark.range(1), root, "k", "p", T0, 60)
    SN.compact_manifest(spark, root, T0)
    SN.invalidate_snapshots(spark, root, T0, "p")
    assert SN.read_snapshot(spark, root, "k", T0)[1] == "miss"
    assert SN.compact_manifest(spark, root, T0) == 0 and len(CL.CommitLog(spark, root).rows()) == 1


def test_positions_of_a_whole_order(spark):
    df = spark.createDataFrame([((i * 7) % 100, None if i % 9 == 0 else f"t{i % 5}") for i in range(300)], "k long, position string")
    order = PG.total_order(df, [F.col("k").desc()])
    want = sorted(((r.k, r.position) for r in df.collect()), key=lambda r: (-r[0], r[1] is None, r[1] or ""))
    for ranges in (1, 7):
        ranked = Ranked(df, order, ranges)
        got = sorted(tuple(r) for r in ranked.rows("place").collect())
        assert [g[0] for g in got] == list(range(1, 301)) and [g[1:] for g in got] == want
        page = sorted(tuple(r) for r in ranked.page(20, 250, "place").collect())
        assert [p[0] for p in page] == list(range(251, 271)) and [p[1:] for p in page] == want[250:270]
        assert ranked.page(20, 295, "place").count() == 5 and ranked.page(5, 1000, "place").count() == 0
    assert Ranked(df.limit(0), order).rows("place").count() == 0


def test_a_deep_page_reads_the_ranges_that_hold_it(spark):
    ranked = Ranked(spark.range(10_000), [F.col("id").asc()], 8)
    page = ranked.page(10, 9_000)
    assert [r.id for r in page.orderBy("position").collect()] == list(range(9_000, 9_010))
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "TakeOrdered" not in plan and "Window" not in plan
    rows = ranked.rows()._jdf.queryExecution().optimizedPlan().toString()
    assert rows.count("Window") == 1 and "Aggregate" in rows[rows.index("Window"):]       # over the ranges' sizes only


def test_dense_index_of_sparse_and_text_keys(spark):
    sparse = spark.createDataFrame([(k,) for k in (1 << 60, -(1 << 60), 5, 5, None, 10**15)], "k long")
    assert sorted(tuple(r) for r in G.dense_index(sparse, "k", 3).collect()) == \
        [(0, -(1 << 60)), (1, 5), (2, 10**15), (3, 1 << 60)]
    text = spark.createDataFrame([("b",), ("a",), ("ä",), ("b",)], "k string")
    assert sorted(tuple(r) for r in G.dense_index(text, "k").collect()) == [(0, "a"), (1, "b"), (2, "ä")]
