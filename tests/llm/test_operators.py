"""The corpus operators against plain Python, on rows that try each rule:
nulls, empty and long texts, ties, repeated rows, clashing column names, empty tables."""
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stockboard.llm import (common, components, decontaminate, elias_fano, exact_dedup, jaccard_join, line_dedup,
                            ngram_lm, packing, secrets, substring_dedup, token_counts, toxicity)
from tests.llm import brute

SF = "/root/testdata/sf0.001"
#: Names that the operators use themselves.
CLASHING = ("block", "shard", "key", "n", "h", "token", "label", "kind", "drop", "keep_id", "score", "__gone", "start")


def corpus():
    r = random.Random(5)
    words = [f"w{k}" for k in range(60)] + ["Äpfel", "ça", "日本"]
    passage = [r.choice(words) for _ in range(50)]
    docs = [(1, None), (2, ""), (3, " \n\t "), (4, "One two"), (5, "one  TWO"), (6, "a\nb\na"), (7, "A \nb\n\nc")]
    for i in range(8, 40):
        w = [r.choice(words) for _ in range(r.randint(1, 90))]
        if i % 3 == 0:
            w[len(w) // 2:len(w) // 2] = passage[:r.randint(20, 50)]
        for k in range(10, len(w), 13):
            w[k] += "\n"
        docs.append((i, " ".join(w)))
    near = docs[20][1].split(" ")
    docs += [(50, docs[20][1]), (51, docs[20][1].upper()), (52, " ".join(near[:-1] + ["x"])), (9, docs[8][1]),
             (9, docs[8][1]), (None, "no id one two"), (60, " ".join(r.choice(words) for _ in range(30_000))),
             (61, "same " * 200)]
    return docs


DOCS = corpus()
ITEMS = [(1, " ".join(DOCS[12][1].split()[:20])), (2, None), (None, "w1"), (3, "!!"), (4, DOCS[20][1]), (4, DOCS[20][1])]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, DOCS).cache()


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def rows(df, *columns):
    found = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(found, key=repr)


def same(df, want, *columns):
    assert rows(df, *columns) == sorted(want, key=repr)


# --- 1 ------------------------------------------------------------------------

@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_add_up_to_the_whole(spark, docs, rule):
    encoder, _ = token_counts.encoding(token_counts.VOCABULARY)
    found = token_counts.token_counts(docs, ("kind", "text"), rule=rule).collect()
    want = {}
    for i, t in DOCS:
        n = len(encoder.encode_ordinary("x\n" + (t or "")))
        want[i] = want.get(i, 0) + n
    got = {}
    for r in found:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
        assert r.begin <= r.end and r.n_tokens >= 0
    assert {k: round(v, 6) for k, v in got.items()} == want
    assert sum(r.field == "text" for r in found) == sum((t or "").count("\n") + 1 for _, t in DOCS)


def test_crossing_tokens_follow_the_rule():
    start, size = np.array([0, 2, 7]), np.array([2, 5, 1])          # the second spans 2..7
    sections = np.array([0, 3, 3, 6])                                # the second section is empty
    by = {rule: token_counts.allocate(start, size, sections, 8, rule)[0].tolist() for rule in token_counts.RULES}
    assert by == {"most": [1, 0, 1, 1], "first": [2, 0, 0, 1], "share": [1.2, 0, .6, 1.2]}
    assert token_counts.allocate(start, size, sections, 8, "most")[1].tolist() == [1, 0, 1, 1]


# --- 2 ------------------------------------------------------------------------

@pytest.mark.parametrize("size, block", [(35, 1 << 20), (5, 700)])
def test_substring_dedup(spark, docs, size, block):
    same(substring_dedup.remove_repeats(docs, size, block), brute.substring(DOCS, size))


def test_gaps_survive_packing():
    r = np.random.default_rng(3)
    for top in (10, 1 << 14, 1 << 20, 1 << 31):
        v = np.sort(r.integers(0, top, 500).astype(np.uint64))
        assert (substring_dedup.unpacked_gaps(substring_dedup.packed_gaps(v + np.uint64(7), 7)) == v).all()


def test_sketch_never_underestimates():
    layout = substring_dedup.Layout(100)
    table = pa.table({"block": pa.array([0] * 30, pa.int32()), "doc_id": pa.array(range(30), pa.int64()),
                      "text": ["a b c d"] * 2 + [f"{i} b c d" for i in range(28)]})
    sent = substring_dedup.sketcher(layout, 4)(table)
    bits = pa.concat_tables([substring_dedup.merger(layout)(sent.filter(pa.compute.equal(sent["row"], k))) for k in (0, 1)])
    assert substring_dedup.passed(substring_dedup.Block(table, 4), layout, bits)[:2].all()


# --- 3 ------------------------------------------------------------------------

def test_language_model(spark, docs):
    model = ngram_lm.Model(docs, block_bytes=1500)
    found = rows(model.scores(), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    want = sorted(brute.language_model(DOCS, 10, 0, ngram_lm.WEIGHT, ngram_lm.POWER), key=repr)
    for a, b in zip(sorted(found, key=lambda x: repr(x[:5])), sorted(want, key=lambda x: repr(x[:5])), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-6)
        assert b[6] - 2e-4 * b[2] <= a[6] <= b[6] + 1e-6           # quantising rounds down
    levels = model.levels().collect()
    assert levels and all(elias_fano.TrieLevel.mapped(bytes(r.level)).contexts.n > 0 for r in levels)


def test_language_model_sums_to_one():
    """Over the known tokens and the unknown one, after a known word."""
    n, v, count = 50, 12, np.array([9, 1, 4, 20, 3, 2, 5, 1, 1, 2, 1, 1])
    p = np.append(count + .1, .1) / (n + .1 * (v + 1))
    h, pair = 9, np.array([3, 0, 1, 5, 0, 0, 0, 0, 0, 0, 0, 0, 0])
    m = ngram_lm.WEIGHT * h ** ngram_lm.POWER
    q = elias_fano.probability(elias_fano.quantised(pair / (h + m)))
    total = (np.where(pair > 0, q, 0) + m / (h + m) * p).sum()
    assert 1 - 4e-4 < total <= 1


def test_a_pair_of_several_blocks_is_looked_up_once(monkeypatch):
    r = random.Random(6)
    asked, look_up = [], elias_fano.TrieLevel.look_up
    monkeypatch.setattr(elias_fano.TrieLevel, "look_up",
                        lambda level, c, w: asked.extend(zip(c.tolist(), w.tolist())) or look_up(level, c, w))
    for spread in (1, 1 << 40):                                            # ids that fit into one number, and not
        blocks, total, rows, seen = [], Counter(), [], 500
        for b in range(3):
            pairs = sorted({(r.randint(1, 9) * spread, r.randint(1, 9) * spread) for _ in range(60)})
            counts = [r.randint(0, 3) for _ in pairs]
            total.update(dict(zip(pairs, counts)))
            contexts = sorted({c for c, _ in pairs})
            numbers = ([*contexts], [seen] * len(contexts), [sum(c == x for c, _ in pairs) for x in contexts],
                       [w for _, w in pairs], counts)
            rows.append((0, b, *(ngram_lm.packed(np.array(x)) for x in numbers)))
            blocks.append(pairs)
        asked.clear()
        answers = ngram_lm.pairs_answered(ngram_lm.table_of(rows, ngram_lm.PAIRS)).to_pylist()
        assert sorted(asked) == sorted(total)
        share = {p: n / (seen + ngram_lm.WEIGHT * seen ** ngram_lm.POWER) for p, n in total.items()}
        for pairs, answer in zip(blocks, answers, strict=True):
            want = [int(elias_fano.quantised(np.array([share[p]]))[0]) if total[p] else elias_fano.ABSENT for p in pairs]
            assert np.frombuffer(answer["a"], "<u2").tolist() == want


def third_order(docs):
    """(doc_id, trigram_score) row by row."""
    rows = [(i, i is None or zlib.crc32(str(i).encode()) % 10 == 0, brute.WORD.findall(brute.low(t)) + [" end"]) for i, t in docs]
    one, two, three = Counter(), Counter(), Counter()
    for _, held, w in rows:
        if not held:
            one.update(w)
            two.update(zip(w, w[1:]))
            three.update(zip(w, w[1:], w[2:]))
    n, v, out = sum(one.values()), len(one), []
    for i, _, w in rows:
        score = 0
        for k, x in enumerate(w):
            p = (one[x] + .1) / (n + .1 * (v + 1))
            for h, c in ((one[w[k - 1]], two[tuple(w[k - 1:k + 1])]) if k else (0, 0),
                         (two[tuple(w[k - 2:k])], three[tuple(w[k - 2:k + 1])]) if k > 1 else (0, 0)):
                m = ngram_lm.WEIGHT * h ** ngram_lm.POWER
                p = (c + m * p) / (h + m) if h else p
            score += math.log10(p)
        out.append((i, score, len(w)))
    return out


@pytest.mark.parametrize("hot, entries", [(1 << 21, 1 << 20), (1 << 21, 40), (3, 40)])
def test_language_model_of_third_order(spark, monkeypatch, hot, entries):
    monkeypatch.setattr(ngram_lm, "HOT_TOKENS", hot)                       # 3: frequent pairs are split by the third word
    monkeypatch.setattr(ngram_lm, "SHARD_ENTRIES", entries)
    r = random.Random(8)
    docs = [(k, " ".join(r.choice("a a a b b c d e f g".split()) for _ in range(r.randint(0, 30)))) for k in range(150)]
    docs += [(7, "a b c never seen"), (None, "a b q b a"), (None, None), (160, "a"), (161, "\n")]
    model = ngram_lm.Model(frame(spark, docs), block_bytes=400)
    found = sorted(((r.doc_id, r.trigram_score) for r in model.scores().collect()), key=repr)
    for a, b in zip(found, sorted(third_order(docs), key=repr), strict=True):
        assert a[0] == b[0] and b[1] - 4e-4 * b[2] <= a[1] <= b[1] + 1e-5 * b[2]
    levels = model.levels().collect()
    assert all(any(elias_fano.TrieLevel.mapped(bytes(r.level)).contexts.n for r in levels if r.size == size) for size in (2, 3))
    assert entries > 40 or len({r.shard for r in levels}) > 4


def test_split_pairs_send_each_triple_below_its_pair():
    """With words frequent enough to be split, as without: each triple once, below a pair of the same shard."""
    r = random.Random(9)
    texts = [" ".join(r.choice("abcdef") for _ in range(200)) for _ in range(5)]
    table = pa.table({"doc_id": pa.array(range(1, 6), pa.int64()), "text": texts})
    tokens = ngram_lm.tokens_of(table, 10, 0)
    asked = [ngram_lm.words_answered(2)(tokens.sent(2, 0).filter(pa.compute.equal(tokens.sent(2, 0)["shard"], k))) for k in range(4)]
    for hot in (1 << 21, 50):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(ngram_lm, "HOT_TOKENS", hot)
            known = ngram_lm.Known(tokens, pa.concat_tables(asked), 2)
            routes = known.shards(5)
        assert sorted(routes.triples.tolist()) == list(range(len(known.parent)))
        assert set(routes.pairs.tolist()) == set(range(len(known.keys)))
        assert (len(routes.pairs) > len(known.keys)) == (hot == 50)
        for _, place, below in routes:
            at = routes.pairs[place]
            assert len(set(at.tolist())) == len(at)
            assert np.repeat(at, routes.followers[place]).tolist() == known.parent[routes.triples[below]].tolist()


def test_count_of_a_context_from_its_code():
    for h in (1, 7, 1000, 10 ** 6):
        c = np.arange(1, min(h, 1400) + 1)
        seen = np.full(len(c), float(h))
        code = elias_fano.quantised(c / (seen + ngram_lm.weight(seen)))
        assert ngram_lm.count_of(code, seen).tolist() == c.tolist()
        many = np.linspace(h // 2 + 1, h, 50).astype(int)
        found = ngram_lm.count_of(elias_fano.quantised(many / (h + ngram_lm.weight(h))), np.full(50, float(h)))
        assert (found >= many).all() and (found <= many * 1.0004 + 1).all()
    assert ngram_lm.count_of(np.array([elias_fano.ABSENT], np.uint16), np.array([5.])).tolist() == [0]


def test_numbers_survive_packing():
    r = np.random.default_rng(4)
    for top in (1, 200, 1 << 20, 1 << 63):
        for n in (0, 1, 5, 3000):
            v = r.integers(0, top, n).astype(np.uint64)
            assert (ngram_lm.unpacked(ngram_lm.packed(v)) == v).all()


def test_elias_fano_against_sorted_arrays():
    r = np.random.default_rng(1)
    for _ in range(100):
        top = int(r.choice([5, 100, 10 ** 6, 2 ** 40]))
        v = np.sort(r.integers(0, top, int(r.integers(0, 60))).astype(np.uint64))
        e = elias_fano.EliasFano(elias_fano.EliasFano.build(v))
        q = np.concatenate((v, r.integers(0, top + 5, 50).astype(np.uint64)))
        index, found = e.successor(q)
        assert (index == np.searchsorted(v, q)).all() and (found == np.isin(q, v)).all()
        assert not len(v) or (e.at(np.arange(len(v))) == v).all()


def test_elias_fano_answers_few_questions_as_many():
    r = np.random.default_rng(7)
    v = np.sort(r.integers(0, 1 << 30, 5000).astype(np.uint64))
    x, i = np.concatenate((v[:9], r.integers(0, 1 << 30, 2000).astype(np.uint64))), np.arange(len(v))
    e = elias_fano.EliasFano(elias_fano.EliasFano.build(v))
    assert e.many(x) and not e.many(x[:9])
    index, found = e.successor(x)
    assert (e.at(i) == v).all() and (index == np.searchsorted(v, x)).all() and (found == np.isin(x, v)).all()
    for k in range(0, len(x), 9):
        a, b = e.successor(x[k:k + 9])
        assert (a == index[k:k + 9]).all() and (b == found[k:k + 9]).all() and (e.at(i[k:k + 9]) == v[k:k + 9]).all()


def test_trie_level_finds_its_pairs_and_no_others():
    r = np.random.default_rng(2)
    pairs = sorted({(int(a), int(b)) for a, b in zip(r.integers(1, 9, 300), r.integers(1, 400, 300))})
    c, w = (np.array([p[k] for p in pairs], np.uint64) for k in (0, 1))
    level = elias_fano.TrieLevel.mapped(elias_fano.TrieLevel.build(c, w, np.arange(len(c))))
    a, b = np.meshgrid(np.arange(1, 11, dtype=np.uint64), np.arange(1, 402, dtype=np.uint64))
    codes = level.look_up(a.ravel(), b.ravel())
    want = [pairs.index(p) if p in set(pairs) else elias_fano.ABSENT for p in zip(a.ravel().tolist(), b.ravel().tolist())]
    assert codes.tolist() == want


# --- 4 ------------------------------------------------------------------------

def test_words_have_the_tokenizers_ids():
    texts = ["Foo's don't İstanbul ΣΑΣ <|endoftext|> x<|startoftext|>y <|ENDOFTEXT|> á Å !!! -- a.. a.b ẞ ŉ Ǆ ß",
             "x y \x00 a\x00b 12ab３ 日本語 🙂👍🏽 'sx x're ''' word' word''s ſ K Å ĳ", "", " \n", None]
    texts += [t for _, t in DOCS]
    codec = packing.codec(packing.VOCABULARY)
    ids, at = codec.documents(common.one_array(pa.array(texts, pa.string())), 1)
    for k, t in enumerate(texts):
        assert ids[at[k]:at[k + 1]].tolist() == codec.whole.encode(t or "", add_special_tokens=False).ids + [1], t


def test_packing(spark, docs):
    capacity = 256
    found = packing.pack_documents(docs, capacity=capacity, open_bins=4, docs_per_packer=20, with_ids=True).cache()
    codec = packing.codec(packing.VOCABULARY)
    want = []
    for i, t in DOCS:
        ids = np.array(codec.whole.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(i, k, a, len(ids[a:a + capacity]), zlib.crc32(ids[a:a + capacity].tobytes()))
                 for k, a in enumerate(range(0, len(ids), capacity))]
    same(found, want, "doc_id", "piece", "start", "length", "ids_crc32")
    by = {}
    for r in found.collect():
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0] + [n for _, n in places])[:-1].tolist()
        assert sum(n for _, n in places) <= capacity
    whole = packing.sequences(found).collect()
    assert all(len(r.ids) == 4 * r.n_tokens for r in whole) and sum(r.n_tokens for r in whole) == sum(w[3] for w in want)


def test_best_fit_takes_the_fullest_and_closes_the_fullest_first():
    b = packing.BestFit(10, 2)
    assert [b.place(n) for n in (6, 7)] == [(0, 0), (1, 0)]
    assert b.place(3) == (1, 7)                     # the fullest that takes it; now full
    assert b.place(9) == (2, 0)
    assert b.place(5) == (3, 0)                     # bin 2, the fullest, closes
    assert b.place(1) == (0, 6) and b.place(1) == (0, 7)
    assert packing.BestFit(10, 1).place(10) == (0, 0)


def test_packing_fills_sequences():
    r = np.random.default_rng(0)
    b, sizes = packing.BestFit(4096, 256), r.integers(1, 2000, 20_000)
    used = len({b.place(int(n))[0] for n in sizes})
    assert used <= 1.01 * -(-sizes.sum() // 4096)


# --- 5 ------------------------------------------------------------------------

@pytest.mark.parametrize("window, slice_bytes", [(13, 1 << 20), (3, 1 << 20)])
def test_decontamination(spark, docs, items, window, slice_bytes):
    found = decontaminate.contamination(docs, items, window=window, slice_bytes=slice_bytes, block_bytes=900)
    same(found, brute.contamination(DOCS, ITEMS, window),
         "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_decontamination_in_slices(spark, docs, items):
    """Several slices of the benchmark give what one gives (documents told apart by id)."""
    once = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    same(decontaminate.contamination(once, items, window=5, slice_bytes=60),
         [tuple(r) for r in decontaminate.contamination(once, items, window=5).collect()])


def test_suffix_array():
    r = np.random.default_rng(4)
    for n, top in ((0, 1), (1, 1), (40, 2), (300, 3), (300, 100000)):
        t = r.integers(0, top, n)
        want = sorted(range(n), key=lambda i: t[i:i + 64].tolist())
        got = decontaminate.suffix_array(t, 64).tolist()
        assert [t[i:i + 64].tolist() for i in got] == [t[i:i + 64].tolist() for i in want] and sorted(got) == sorted(want)


def test_matches_have_their_places(spark):
    d = spark.createDataFrame([(1, "x a b c d e y a b c")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "z a b c d e")], "item_id long, text string")
    (found,) = decontaminate.matches(d, b, window=3).collect()
    assert [(m.item_id, m.item_word, m.start, m.length) for m in found.matches] == [("7", 1, 1, 5), ("7", 1, 7, 3)]


# --- 6 ------------------------------------------------------------------------

@pytest.mark.parametrize("mode", ["first", "frequent"])
def test_line_dedup(spark, mode):
    r = random.Random(1)
    lines = ["x", " X ", "Same line", "same LINE\t", "", "ünïque", "other", "a long line that is here often"]
    docs = [(i, "\n".join(r.choice(lines) + (str(r.randrange(40)) if r.random() < .5 else "")
                          for _ in range(r.randint(0, 9)))) for i in range(60)] + [(99, None), (None, "x\nx")]
    d = frame(spark, docs)
    same(line_dedup.apply_bitmaps(d, line_dedup.bitmaps(d, mode)), brute.lines(docs, mode, line_dedup.MIN_DOCS),
         "doc_id", "n_lines", "n_dropped", "text")


def test_line_dedup_min_length_and_modes(spark):
    docs = [(1, "ä\nabc"), (2, "ä\nabc")]
    d = frame(spark, docs)
    got = line_dedup.apply_bitmaps(d, line_dedup.bitmaps(d, "first", min_length=2))
    same(got, brute.lines(docs, "first", 0, 2), "doc_id", "n_lines", "n_dropped", "text")
    with pytest.raises(ValueError):
        line_dedup.bitmaps(d, "last")


# --- 7 ------------------------------------------------------------------------

@pytest.mark.parametrize("size, percent, options", [
    (4, 85, {}), (4, 85, {"tree_shingles": 0, "chunk": 4, "block_bytes": 900}),
    (2, 50, {"tree_shingles": 200, "chunk": 2, "block_bytes": 1500})])
def test_jaccard_join(spark, docs, size, percent, options):
    got = jaccard_join.classes_of(docs, size, percent, **options)
    same(got, brute.jaccard(DOCS, size, percent))


def test_jaccard_join_of_many_near_copies(spark):
    r = random.Random(9)
    docs = []
    for g in range(4):
        base = [f"g{g}w{r.randrange(80)}" for _ in range(60)]
        for _ in range(25):
            w = list(base)
            for _ in range(r.choice([0, 1, 1, 2])):
                w[r.randrange(len(w))] = r.choice(["x", "y", f"new{len(docs)}"])
            docs.append((len(docs), " ".join(w)))
    got = jaccard_join.classes_of(frame(spark, docs), tree_shingles=0, chunk=6)
    same(got, brute.jaccard(docs, 4, 85))


def test_components(spark):
    r = random.Random(2)
    links = [(a, a + 1) for a in range(0, 40)] + [(100, b) for b in range(101, 160)]
    links += [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a
    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(links, "a long, b long")
    same(components.components(df), [(a, find(a)) for a in root], "node", "component")
    assert components.components(df.limit(0)).count() == 0


# --- 8 ------------------------------------------------------------------------

def test_exact_dedup(spark, docs):
    same(exact_dedup.owners(docs), brute.exact(DOCS))
    kept = {sha: keep for _, keep, _, _, sha in brute.exact(DOCS)}.values()           # one row of each text
    assert sorted(map(repr, kept)) == sorted(repr(r.doc_id) for r in exact_dedup.drop_copies(docs).collect())
    assert exact_dedup.drop_copies(docs).columns == docs.columns


def test_exact_dedup_keeps_the_smallest_on_demand(spark):
    got = exact_dedup.owners(spark.createDataFrame([(3, "a"), (1, "A"), (2, "b")], "doc_id long, text string"), "smallest")
    assert {r.doc_id: r.keep_id for r in got.collect()} == {3: 1, 1: 1, 2: 2}


def test_radix_trie_with_spills():
    r = random.Random(3)
    keys = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) for _ in range(2000)]
    for limit in (1 << 30, 3000, 0):
        trie = exact_dedup.RadixTrie(True, limit)
        for i, k in enumerate(keys):
            trie.insert(k, hashlib.sha256(k).digest(), i, 1)
        got = {(n, d): (o, c) for n, d, o, c in trie.drain()}
        want = {}
        for i, k in enumerate(keys):
            h = (len(k), hashlib.sha256(k).digest())
            want[h] = (i, want.get(h, (0, 0))[1] + 1)
        assert got == want


# --- 9 ------------------------------------------------------------------------

SECRETS = ["", None, "no secret here", "password = hunter22 and token:abcdefg", "PassWord: 'x' secret=\"a.b-c_d/e\"",
           "token=token=abcdef secret: token:abcdefgh", "AKIA" + "A1" * 8 + " AKIAAKIA" + "B" * 14, "é" * 5 + "deadbeef" * 4,
           "api_key:" + "f" * 40 + " apikey = zz", "ab" * 11 + "c" + " " + "ab" * 12, "ſecret=abcdefgh toKen=abcdefgh",
           "日本 secret=abc日本def", "AKIA" + "Z" * 16 + "\nhttps://host.example/x?y\n" + "aB3" * 14,
           "https://alone.example", "aB3" * 14, "ABCDEFGHIJKLMNOP12 then " + "x" * 300 + " secret=abcdefgh",
           "ABCDEFGHIJKLMNOP12 near secret=abcdefgh at ftp://h/x"]


def test_base_secrets_and_their_places(spark):
    docs = [(i, t) for i, t in enumerate(SECRETS)] + [(1000, SECRETS[3]), (1000, SECRETS[3]), (None, SECRETS[4])]
    found = secrets.secrets(frame(spark, docs))
    base = found.select("doc_id", secrets.joined(F.filter("findings", lambda s: s["kind"] < 3)))
    same(base, [(i, ",".join(brute.base_secrets(t))) for i, t in docs])


def test_weak_candidates_need_complements(spark):
    found = {r.doc_id: r.spans for r in secrets.secrets(frame(spark, list(enumerate(SECRETS)))).select(
        "doc_id", secrets.joined(F.col("findings")).alias("spans")).collect()}
    assert [s.split(":")[0] for s in found[12].split(",")] == ["access", "endpoint", "opaque"]
    assert found[13] == found[14] == ""
    assert [s.split(":")[0] for s in found[15].split(",")] == ["assign"]
    assert [s.split(":")[0] for s in found[16].split(",")] == ["ident", "assign", "endpoint"]


def test_secret_scan_runs_no_python(spark, docs):
    p = secrets.secrets(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in p for x in ("Python", "Pandas", "InArrow"))


# --- 10 -----------------------------------------------------------------------

@pytest.fixture(scope="module")
def labelled():
    r = random.Random(8)
    words = [f"{a}{b}{c}" for a in ("ba", "ti", "ko", "lu") for b in ("ra", "ne", "so") for c in ("m", "n", "st", "l")]
    texts, labels = [], []
    for i in range(900):
        w = [r.choice(words) for _ in range(r.randint(3, 60))]
        bad = i % 3 == 0
        if bad:
            for _ in range(r.randint(1, 3)):
                w.insert(r.randrange(len(w)), r.choice(["vilest", "vilester", "vilestum", "grim"]))
        texts.append(" ".join(w))
        labels.append(int(bad))
    return texts, labels, [("en", "de")[i % 2] for i in range(900)]


def test_toxicity_held_out_accuracy(spark, labelled):
    texts, labels, langs = labelled
    d = spark.createDataFrame([(i, t, lang, "x") for i, (t, lang) in enumerate(zip(texts, langs))],
                              "doc_id long, text string, lang string, score string")
    lab = spark.createDataFrame(list(enumerate(labels)) + [(3, None), (None, 1)], "doc_id long, toxic int")
    held = toxicity.remainder(F.col("doc_id"), 3)
    net = toxicity.train(d, lab, held != 1)
    assert set(net.thresholds) <= {"en", "de"}                      # only with enough of both labels held back
    rows_ = toxicity.toxicity(d, net).withColumn("held", held == 1).collect()
    wrong = sum((r.score >= toxicity.THRESHOLD) != bool(labels[r.doc_id]) for r in rows_ if r.held)
    assert sum(r.held for r in rows_) > 200 and wrong <= 6
    again = toxicity.train(d.repartition(7), lab, held != 1)
    assert np.allclose(again.embedding, net.embedding) and again.shift == net.shift
    kept = toxicity.drop_toxic(d, net)
    assert kept.columns == d.columns and kept.count() == sum(not r.toxic for r in rows_)


def test_thresholds_by_language_need_enough_of_both_labels():
    net, y = toxicity.Network.fresh(np.ones(toxicity.BUCKETS)), np.array([0, 1] * 60, np.float32)
    logits = np.where(y == 1, 2.0, -2.0) + np.arange(120) / 1000
    toxicity.calibrate(net, logits, y, ["en"] * 80 + ["de"] * 38 + [None] * 2)
    assert set(net.thresholds) == {"en"} and 0.5 < net.thresholds["en"] < 0.9


def test_toxicity_of_odd_texts_and_one_sided_labels(spark, labelled):
    texts, labels, langs = labelled
    net = toxicity.fit(texts[:200], np.array(labels[:200]), langs[:200], epochs=1)
    odd = pa.array(["", "!!!", "a", "word " * 50_000, "日本 語"], pa.string())
    scores = net.scores(common.one_array(odd))
    assert ((scores >= 0) & (scores <= 1)).all()
    assert np.allclose(scores, [net.scores(common.one_array(odd[i:i + 1]))[0] for i in range(len(odd))])
    assert toxicity.fit(["a", "b"], np.array([1, 1]), [None, None]).scores(odd).tolist() == [1.0] * 5
    assert toxicity.fit([], np.array([]), []).scores(odd).tolist() == [0.0] * 5


@pytest.mark.parametrize("values, labels, cut", [
    ([1, 2, 4, 8], [0, 0, 1, 1], 3), ([1, 2, 4, 9, 20], [0, 1, 0, 1, 1], 6.5), ([5, 5, 5], [1, 0, 0], 6),
    ([5, 5, 5], [1, 1, 0], 4), ([3], [1], 2), ([3], [0], 4)])
def test_best_cut_makes_the_fewest_mistakes(values, labels, cut):
    assert toxicity.best_cut(np.array(values, float), np.array(labels, float)) == cut


def test_strengths_are_signed_roots_of_likelihood_ratios():
    texts = ["vile day"] * 8 + ["good day"] * 8 + ["day once"]
    labels = np.array([1] * 8 + [0] * 9, np.float32)
    found = toxicity.strengths(common.one_array(pa.array(texts, pa.string())), labels)
    bucket = {w: int(common.word_hashes(np.array([w], object))[0] % np.uint64(toxicity.WORD_BUCKETS))
              for w in ("vile", "good", "day", "once")}
    assert found[bucket["vile"]] == pytest.approx(np.sqrt(2 * 8 * np.log(17 / 8)))
    assert found[bucket["good"]] == pytest.approx(-np.sqrt(2 * 8 * np.log(17 / 9)))
    assert found[bucket["day"]] == found[bucket["once"]] == found[-1] == 0


def test_few_toxic_labels_leave_clean_texts_alone():
    r = random.Random(3)
    texts, labels = [], []
    for i in range(600):
        w = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(r.randint(50, 400))]
        bad = i % 10 == 0
        for _ in range(3 * bad):
            w[r.randrange(len(w))] = r.choice(["vilest", "grimly", "scummy"])
        texts.append(" ".join(w))
        labels.append(int(bad))
    net = toxicity.fit(texts[:300], np.array(labels[:300]), [None] * 300)
    found = net.scores(common.one_array(pa.array(texts[300:], pa.string()))) >= toxicity.THRESHOLD
    assert (found != np.array(labels[300:], bool)).sum() <= 3


def test_gradients_are_the_slopes_of_the_loss(labelled):
    texts, labels, _ = labelled
    net = toxicity.Network.fresh(np.ones(toxicity.BUCKETS), 1)
    for p in net.parameters():
        p += 0.05
    net.embedding[-1] = 0
    array, y = common.one_array(pa.array(texts[:6], pa.string())), np.array(labels[:6], np.float32)

    def loss():
        z = net.logits(array)
        return float(np.mean(np.logaddexp(0, z) - y * z))
    found = toxicity.gradients(net, *toxicity.features(array), y)
    for p, g in zip(net.parameters(), found, strict=True):
        at = np.unravel_index(int(np.argmax(np.abs(g))), g.shape)
        old, step = p[at], 2e-3
        p[at] = old + step
        up = loss()
        p[at] = old - step
        down = loss()
        p[at] = old
        assert (up - down) / (2 * step) == pytest.approx(float(g[at]), rel=0.1, abs=2e-4)


# --- all ----------------------------------------------------------------------

def test_empty_tables(spark, items):
    none = frame(spark, DOCS[:1]).limit(0)
    no_items = items.limit(0)
    results = [token_counts.token_counts(none), substring_dedup.remove_repeats(none), ngram_lm.Model(none).scores(),
               packing.pack_documents(none), decontaminate.contamination(none, items), line_dedup.bitmaps(none),
               line_dedup.apply_bitmaps(none, line_dedup.bitmaps(none, "frequent")), jaccard_join.classes_of(none),
               exact_dedup.owners(none), secrets.secrets(none),
               toxicity.toxicity(none, toxicity.fit([], np.array([]), []))]
    assert [r.count() for r in results] == [0] * len(results)
    found = decontaminate.contamination(frame(spark, DOCS), no_items).collect()
    assert len(found) == len(DOCS) and not any(r.contaminated for r in found)
