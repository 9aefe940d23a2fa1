"""Near-dedup by sketches, collocations and conversation repair against plain Python and DuckDB."""
import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stockboard.llm import collocations, conversation_repair, minhash_dedup

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- near-dedup -------------------------------------------------------------------

def near_classes(rows, size=2, percent=80):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and label[i] != label[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    least = {}
    for (d, _), x in zip(rows, label):
        least[x] = d if least.get(x) is None else least[x] if d is None else min(d, least[x])
    return sorted(((d, len(s), d if not s else least[x]) for (d, _), s, x in zip(rows, sets, label)), key=repr)


def near_rows():
    r = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    rows = [(1, None), (2, ""), (3, " \t"), (4, "one"), (5, "ONE"), (6, "one two"), (None, "One Two"), (None, "alone without id")]
    base = [r.choice(words) for _ in range(70)]
    for i in range(10, 26):                                                # near copies, chained and not
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 4, 6, 9])):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(r.choice(words[:40]) for _ in range(r.randint(2, 30)))) for i in range(60, 90)]
    rows += [(100, rows[12][1]), (101, rows[12][1].upper()), (100, rows[30][1]), (102, " ".join(r.choice(words) for _ in range(20_000)))]
    return rows


@pytest.mark.parametrize("options", [{"chunk": 4, "most_tiles": 2, "k": 16}])
def test_near_dedup_equals_brute_force(spark, options):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("key", F.lit(1)).withColumn("label", F.lit("x"))
    found = minhash_dedup.classes_of(docs, **options).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == near_classes(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_dedup_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash_dedup.classes_of(empty).count() == 0


def test_granted_overlap():
    assert minhash_dedup.least_common(64, 80) == 26
    assert minhash_dedup.granted(np.array([5, 51, 52, 1000]), 64, 80).tolist() == [4, 41, 26, 26]
    r = np.random.default_rng(1)
    fewest = min(int((r.permutation(300)[:64] < 240).sum()) for _ in range(20_000))       # common values of linked sets
    assert fewest >= 26


def test_bands_grant_two_common_ones():
    assert minhash_dedup.banding(80) == (4, 60) and minhash_dedup.banding(100) == (16, 2)
    r = np.random.default_rng(1)
    sets = []
    for n in [10, 90] * 2_000:                                             # linked pairs at the threshold
        u = r.integers(0, 2 ** 64, n, dtype=np.uint64)
        sets += [np.sort(u[:9 * n // 10]), np.sort(np.concatenate((u[:8 * n // 10], u[9 * n // 10:])))]
    bands = minhash_dedup.band_values(sets, 4, 60)
    common = (bands[::2] == bands[1::2]).sum(axis=1)
    assert common.min() >= 2 and abs(common.mean() - 60 * 0.8 ** 4) < 0.5


def test_lists_do_not_grow_with_common_shingles(spark):
    r = random.Random(5)
    words = [f"w{k}" for k in range(30)]                                   # every pair of words in many texts
    rows = [(i, " ".join(r.choice(words) for _ in range(60))) for i in range(300)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(5)]
    index = minhash_dedup.Index(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80, 64, 512)
    lists = index.lists().select("value", "key").collect()
    assert 10 <= len(lists) < 300                                          # thousands of single values are in two texts
    assert len({x.key for x in lists}) < 60


def opened(spark, rows, chunk):
    """(index, rows sent to chunks of open lists, what `classes_of` finds)"""
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    index = minhash_dedup.Index(docs, 2, 80, 64, chunk)
    lists = index.stored(index.lists(), "lists")
    stars = index.stored(index.stars(lists), "stars")
    sent = index.open_lists(lists, stars, minhash_dedup.components(index.links(stars))).count()
    found = minhash_dedup.classes_of(docs, chunk=chunk).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in found), key=repr) == near_classes(rows)
    return sent


def test_a_line_of_many_short_texts(spark):
    """They lie in common lists, but only near copies have rare values in common."""
    r = random.Random(6)
    line = "a line that many short texts of a corpus have in common with each other"
    rows = [(i, " ".join(f"w{r.randrange(3000)}" for _ in range(8)) + "\n" + line) for i in range(500)]
    rows += [(1000 + i, f"{rows[i][1]} end") for i in range(30)]
    assert opened(spark, rows, 8) < 8 * len(rows)


def test_a_large_group_of_near_copies(spark):
    """Sets that did not get to the component meet its sets once, however many lists hold them."""
    r = random.Random(7)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4]) if i % 8 else 14):
            w[r.randrange(len(w))] = f"v{r.randrange(3000)}"
        rows.append((i, " ".join(w)))
    assert opened(spark, rows, 16) < 12 * len(rows)


# --- collocations -----------------------------------------------------------------

def test_transducers():
    r = np.random.default_rng(4)
    alphabet = np.unique(r.integers(0, 1 << 63, 30).astype(np.uint64))
    grams = defaultdict(int)
    parts = []
    for _ in range(5):
        rows = np.unique(np.array([[*r.integers(0, 12, n), *[-1] * (4 - n)] for n in r.integers(1, 5, 200)]), axis=0)
        weight = r.integers(1, 4, len(rows))
        t = collocations.CountTransducer.of_sorted(alphabet, *collocations.in_row_order(rows, weight))
        got, w = collocations.CountTransducer.unpacked(t.packed()).paths()
        assert {tuple(x): int(c) for x, c in zip(got.tolist(), w)} == {tuple(x): int(c) for x, c in zip(rows.tolist(), weight)}
        for x, c in zip(rows.tolist(), weight):
            grams[tuple(x)] += int(c)
        parts.append(t)
    whole = collocations.CountTransducer.united(parts, 3)
    got, w = whole.paths()
    kept = {x: c for x, c in grams.items() if c >= 3}
    hashes = lambda a, rows: [tuple(int(a[i]) if i >= 0 else -1 for i in x) for x in rows.tolist()]
    assert dict(zip(hashes(whole.alphabet, got), w.tolist())) == {h: c for h, c in zip(hashes(alphabet, np.array(list(kept))), kept.values())}
    asked, answer = parts[0].composed(whole)
    mine = {h for h in hashes(alphabet, parts[0].paths()[0])}
    everything = dict(zip(hashes(whole.alphabet, got), w.tolist()))
    assert dict(zip(hashes(alphabet, asked), answer.tolist())) == {h: c for h, c in everything.items() if h in mine}
    shared = collocations.CountTransducer.of_sorted(alphabet, np.array([[0, 2, 3], [1, 2, 3]]), np.array([5, 5]))
    assert [len(level[1]) for level in shared.levels] == [2, 1, 1]                      # equal ends are one state


def duck(rows, sql):
    con = duckdb.connect()
    con.execute("create table documents (lang varchar, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    return sorted(con.execute(sql).fetchall())


def test_collocations_equal_sql(spark):
    r = random.Random(8)
    words = ["new", "york", "city", "of", "Angels", "über", "a\x1cb", "los", "x"]
    rows = [(None, None), ("en", ""), ("en", " ,;\n"), (None, "New york.")]
    for _ in range(150):
        out = []
        for _ in range(r.randint(1, 60)):
            out.append(r.choice(["new york city", "los Angels", "city of Angels"]) if r.random() < .3 else r.choice(words))
            out.append(r.choice([" ", "  ", "\t", ", ", ".", "\n", " "]))
        rows.append((r.choice(["en", "de", None]), "".join(out)))
    rows += rows[-5:]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4).withColumn("h", F.lit(1))
    want = duck(rows, collocations.ORACLE)
    assert len(want) > 15
    for options in ({}, {"range_bytes": 400, "filter_limit": 64}):
        assert sorted(tuple(x) for x in collocations.collocations(docs, **options).collect()) == want
    assert collocations.collocations(docs.limit(0)).count() == 0
    few = sorted(tuple(x) for x in collocations.collocations(docs, top=3).collect())
    assert few == [x for x in want if x[1] <= 3]


# --- conversation repair -------------------------------------------------------------

def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        spaced = lambda x: " " if x is None else str(x)
        role, text, kind = spaced(role), spaced(text), zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def repaired(rows):
    """Cheapest edits by a search over whole audits."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        marks = [c for c in text if c not in " \t\n\v\f\r"]
        faults.append("b" if not marks else "d" if (role, text) in seen else "" if marks[-1] in ".!?" else "t")
        seen.add((role, text))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    step = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done, names = [(0, "", 0, "0", ())], set(), {"u": "user", "a": "assistant"}
    while True:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if state == "end":
            text = "\n".join(out)
            return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit,
                    hashlib.sha256(text.encode()).hexdigest())
        if i == len(rows) and state in "0a":
            heapq.heappush(heap, (cost, audit, i, "end", out))
        for x, name in names.items():
            if (state, x) in step:
                heapq.heappush(heap, (cost + 2, audit + "I", i, step[state, x], out + (f"{name}:",)))
        if i == len(rows):
            continue
        _, role, text = rows[i]
        heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
        if faults[i] not in ("b", "d"):
            extra = faults[i] == "t"
            if (state, role[:1]) in step:
                heapq.heappush(heap, (cost + extra, audit + "K", i + 1, step[state, role[:1]], out + (f"{role}:{text}",)))
            for x, name in names.items():
                if (state, x) in step:
                    heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, step[state, x], out + (f"{name}:{text}",)))


def every(rows, ids):
    groups = defaultdict(list)
    for conv, *row in rows:
        groups[conv].append(tuple(row))
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return {(i, *(repaired(groups[i]) if i in groups else none)) for i in ids}


def test_repair_equals_a_search(spark):
    r = random.Random(6)
    rows = [(c, r.choice([None, k, k, k // 2]), r.choice(["user", "assistant", "system", "bot", "", None, "unknown"]),
             r.choice(["a.", "b", "", "Hi!", None, " \n", "x. ", "long?"]))
            for c in [None, *range(20)] for k in range(r.choice([1, 2, 5, 9, 60]))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4).withColumn("seen", F.lit(1))
    spaced = [(c, t, " " if a is None else a, " " if b is None else b) for c, t, a, b in rows]
    want = every(spaced, {x[0] for x in rows})
    for segment_rows in (1, 3, 4096):
        assert {tuple(x) for x in conversation_repair.repaired_conversations(frame, frame, segment_rows=segment_rows).collect()} == want
    bad = {tuple(x) for x in conversation_repair.repaired_conversations(conversation_repair.damaged(frame), frame).collect()}
    assert bad == every(damage(rows), {x[0] for x in rows})
    none = frame.limit(0)
    assert conversation_repair.repaired_conversations(conversation_repair.damaged(none), none).count() == 0


def test_registered_repair_equals_a_search(spark):
    rows = [tuple(x) for x in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {tuple(x) for x in conversation_repair.op13_conversation_repair(spark, SF).collect()}
    assert found == every(damage(rows), {x[0] for x in rows})


def test_audits_compare_by_their_strings():
    r = random.Random(2)
    audits, nodes = conversation_repair.Audits(), [0]
    for _ in range(400):
        nodes.append(audits.grown(r.choice(nodes[-6:]), r.choice("DIKR")))
    for _ in range(2000):
        a, b = r.choice(nodes), r.choice(nodes)
        assert audits.less(a, b) == (audits.text(a) < audits.text(b))
    audits.hash = [0] * len(audits.hash)                                    # every hash collides
    for _ in range(300):
        a, b = r.choice(nodes), r.choice(nodes)
        assert audits.less(a, b) == (audits.text(a) < audits.text(b))
