"""Rows that repeat an id, rows without one, long runs: each row gets its own result."""
import numpy as np
import pytest

import corpus_pipeline
from stockboard.llm import decontaminate, exact_dedup, jaccard_join, line_dedup, token_counts

SCHEMA = "doc_id long, text string"
LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
OTHER = "a b c d e f g h i j k l m n o p"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def got(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def want(*rows):
    return sorted(rows, key=repr)


def test_exact_dedup_keeps_one_row_of_each_text(spark):
    assert got(exact_dedup.drop_copies(frame(spark, [(9, "x"), (10, "x"), (9, "only here")]))) == want((10, "x"), (9, "only here"))
    assert got(exact_dedup.drop_copies(frame(spark, [(9, "x"), (9, "x"), (9, "y")]))) == want((9, "x"), (9, "y"))
    assert got(exact_dedup.drop_copies(frame(spark, [(None, "x"), (None, "x"), (3, "y"), (None, "Y")]))) == want((None, "x"), (3, "y"))
    assert got(exact_dedup.drop_copies(frame(spark, [(9, "x"), (10, "x"), (11, None), (12, "")]), "smallest")) == want((9, "x"), (11, None))
    extra = frame(spark, [(1, "x"), (2, "x")]).withColumn("__sha", exact_dedup.F.lit(1)).withColumn("kept", exact_dedup.F.lit(2))
    assert exact_dedup.drop_copies(extra).columns == extra.columns and exact_dedup.drop_copies(extra).count() == 1


def test_jaccard_join_keeps_one_row_of_each_component(spark):
    one = jaccard_join.one_of_each
    assert got(one(frame(spark, [(1, LONG), (9, LONG), (9, OTHER)]))) == want((1, LONG), (9, OTHER))
    assert got(one(frame(spark, [(1, LONG), (None, LONG), (None, LONG)]))) == want((1, LONG))
    assert got(one(frame(spark, [(None, LONG), (None, LONG), (None, OTHER)]))) == want((None, LONG), (None, OTHER))
    assert got(one(frame(spark, [(5, LONG), (5, LONG), (4, ""), (4, ""), (3, None)]))) == want((5, LONG), (4, ""), (4, ""), (3, None))


def test_decontamination_goes_by_text(spark):
    items = spark.createDataFrame([("i", LONG), ("j", OTHER)], "item_id string, text string")
    rows = [(1, LONG), (1, "nothing of it"), (None, OTHER), (None, "clean"), (2, None)]
    for size in (1 << 20, 20):                                             # one slice, and one for each item
        assert got(decontaminate.clean(frame(spark, rows), items, slice_bytes=size)) == \
            want((1, "nothing of it"), (None, "clean"), (2, None))
        found = decontaminate.contamination(frame(spark, rows), items, slice_bytes=size).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.contaminated) for r in found) == \
            [(False, 1, 3, False), (False, 1, 14, True), (False, 2, 0, False), (True, 0, 1, False), (True, 0, 16, True)]


def test_lines_of_texts_with_one_id(spark):
    rows = [(50, "common line\nkeep A"), (50, "unique B\ncommon line")] + [(i, f"common line\nown {i}") for i in range(12)]
    docs = frame(spark, rows)
    kept = line_dedup.apply_bitmaps(docs, line_dedup.bitmaps(docs, "frequent"))
    assert got(kept) == want((50, "keep A"), (50, "unique B"), *((i, f"own {i}") for i in range(12)))
    first = line_dedup.apply_bitmaps(docs, line_dedup.bitmaps(docs, "first"))
    assert sum("common line" in t for _, t in got(first)) == 1 and sum("unique B" in t for _, t in got(first)) == 1


def test_stages_of_the_pipeline_on_repeated_ids(spark):
    rows = [(9, "x"), (10, "x"), (9, "only here"), (None, "none")]
    docs = frame(spark, rows)
    assert got(corpus_pipeline.without_copies(spark, docs, "")) == want((10, "x"), (9, "only here"), (None, "none"))
    near = frame(spark, [(1, LONG), (9, LONG), (9, OTHER)])
    assert got(corpus_pipeline.without_near_copies(spark, near, "")) == want((1, LONG), (9, OTHER))


@pytest.mark.parametrize("text", ["ab" + " " * 25_000 + "cd", "ab." + "\n" * 20_000 + "\tcd", "x" + " \n" * 9_000, "\n" * 10_001 + " y",
                                  "q" + "\x1c" * 12_000 + " z", "q" + "\u3000 " * 6_000 + "é"])
def test_long_runs_have_the_tokens_of_one_call(text):
    encoder, _ = token_counts.encoding(token_counts.VOCABULARY)
    assert np.array_equal(token_counts.encoded(encoder, text), encoder.encode_to_numpy(text, disallowed_special=()))


def test_very_long_runs(spark):
    runs = [" " * 1_000_000, "\n" * 200_000, "a" * 1_000_000]
    docs = frame(spark, [(i, "begin" + run + "end") for i, run in enumerate(runs)])
    counted = token_counts.token_counts(docs, section="|").collect()
    encoder, size = token_counts.encoding(token_counts.VOCABULARY)
    for r in counted:
        ids = token_counts.encoded(encoder, "begin" + runs[r.doc_id] + "end")
        assert r.n_tokens == len(ids) and int(size[ids].sum()) == r.end == len(runs[r.doc_id]) + 8


def test_sections_against_brute_force(spark):
    encoder, size = token_counts.encoding(token_counts.VOCABULARY)
    texts = ["First line here\n\n second\n", "x" * 50 + "\n" + "日本語 text\nend", "", "\n\n\n", "don't\nstop  now\n  indented"]
    rows = token_counts.token_counts(frame(spark, list(enumerate(texts))), rule="first").collect()
    for i, text in enumerate(texts):
        raw, at, expected = text.encode(), 0, {}
        owner = [0]
        for b in raw:                                                      # a separator belongs to the line that it ends
            owner.append(owner[-1] + (b == 10))
        for t in encoder.encode_to_numpy(text, disallowed_special=()).tolist():
            expected[owner[at]] = expected.get(owner[at], 0) + 1
            at += int(size[t])
        found = {r.section: r.n_tokens for r in rows if r.doc_id == i}
        assert {k: v for k, v in found.items() if v} == expected and len(found) == text.count("\n") + 1


def test_rows_without_ids_spread_over_the_blocks_by_their_texts(spark):
    """Many texts of one length without ids fill blocks evenly, and dealing again deals alike."""
    from stockboard.llm.common import blocked
    docs = spark.createDataFrame([(None, f"text {i:06d}") for i in range(2000)], "doc_id long, text string")
    per_block = {r.block: r["count"] for r in blocked(docs, 2200).groupBy("block").count().collect()}
    assert len(per_block) == 10 and max(per_block.values()) < 300
    dealt = [sorted((r.text, r.block) for r in blocked(d, 2200).collect()) for d in (docs, docs.repartition(7))]
    assert dealt[0] == dealt[1]


def _linked(sets, sizes, pairs):
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in pairs:
        parent[root(a)] = root(b)
    names: dict = {}
    return [names.setdefault(root(i), len(names)) for i in range(len(sets))]


def _in_order(sets):
    return [np.array(s) for s in sorted(sorted(s) for s in sets)]


@pytest.mark.parametrize("percent", [50, 60, 80, 85, 100])
@pytest.mark.parametrize("few", [0, 4, 32])
def test_tree_walk_equals_all_pairs(percent, few, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FEW_ROWS", few)
    rng = np.random.default_rng(percent + few)
    for _ in range(25):
        vocabulary = int(rng.integers(3, 60))
        first = [set(rng.integers(0, vocabulary, rng.integers(1, 40)).tolist()) for _ in range(4)]
        sets = _in_order(first[rng.integers(4)] ^ set(rng.integers(0, vocabulary, rng.integers(0, 4)).tolist()) | {vocabulary}
                         for _ in range(50))
        sizes = np.array([len(s) + int(rng.integers(0, 3)) for s in sets])          # shingles of no other set count too
        side = rng.integers(0, 2, 50) if rng.random() < 0.5 else None
        pairs = [(a, b) for a in range(50) for b in range(a) if side is None or not side[a] or not side[b]
                 if 100 * (o := len(np.intersect1d(sets[a], sets[b]))) >= percent * (sizes[a] + sizes[b] - o)]
        found = jaccard_join.tree_links(sets, sizes, np.arange(50), side, percent)
        assert set(found) <= set(pairs)
        assert _linked(sets, sizes, found) == _linked(sets, sizes, pairs)


def test_unlinked_sets_of_a_hot_shingle_are_not_walked_to():
    """2,000 candidates under three common shingles without a link: no path of the tree is followed."""
    rng = np.random.default_rng(5)
    sets = _in_order(set(rng.integers(3, 10 ** 6, 97).tolist()) | {0, 1, 2} for _ in range(2000))
    sizes = np.array([len(s) for s in sets])
    leads = jaccard_join.Leads(jaccard_join.PrefixTree(sets), sizes, 10 ** 6, 85)
    met = 0
    for x in range(2000):
        met += len(leads.partners(x, int(sizes[x])))
        leads.add(x)
    assert met == 0
    assert jaccard_join.tree_links(sets, sizes, np.arange(2000), None, 85) == []


def test_clusters_of_too_many_sets_are_split(spark):
    docs = [(i, " ".join(f"w{(i // 6) * 50 + j}" for j in range(40)) + f" t{i}") for i in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    whole = sorted(map(tuple, jaccard_join.classes_of(frame).collect()))
    assert sorted(map(tuple, jaccard_join.classes_of(frame, tree_sets=3, chunk=4).collect())) == whole
    assert [c for _, _, c in whole] == [i // 6 * 6 for i in range(30)]
