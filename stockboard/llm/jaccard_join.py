"""N-gram Jaccard join over prefix trees.

1. Documents are dealt into blocks (one shuffle, read twice). Each block makes
   its documents' sets of distinct shingles (64-bit hashes) and sends the
   shingles of its distinct sets to shards, which count in how many sets each
   occurs and answer with a class of that count.
2. All sets are ordered alike: rarest class first, then by hash. Two sets that
   link share a shingle among the first n - ceil(t n) + 1 of each (prefix
   filter), and it occurs in more than one set. A block writes, for each
   distinct set, those shingles as postings, and the set in order without the
   shingles that occur nowhere else (they cannot overlap).
3. Sets under one shingle form a group; equal groups are taken once. Sets that
   are connected by groups form a candidate cluster. A cluster of bounded size
   (`TREE_SHINGLES`, `TREE_SETS`) is put into one prefix tree: sets with a common
   beginning share a path, and the tree is walked once per set, towards sets that
   hold enough of its leading shingles, adding up the overlap along the path and
   leaving a subtree when its remaining length, sizes or places cannot reach the
   threshold, or when all of it is already connected to the set.
4. Larger clusters are split. The least set of a group is its pivot; every set is
   compared with its least pivot, in trees of at most `chunk` sets that all hold
   the pivot. After the components of these links, only groups whose sets still
   lie in different components are open: their sets are compared in the same
   way, in pairs of chunks, but for the sets of the group's largest component
   among themselves. So every pair that could connect two components is examined,
   and a cluster of near copies costs in proportion to its size.
5. Components of all links; a document's component is the least doc_id in it.

Texts with the same set of shingles are one set throughout; their copies are
never paired. Results are exact up to 64-bit (shingles) and 128-bit (sets) hashes.

Defined results: a text without words (or null) has no shingles, links with
nothing and is its own component; fewer words than `size` are one shingle; rows
that repeat a doc_id are documents of their own, and one with a null doc_id is
in the component of the others (null if it has no other); an empty table gives
no rows; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockboard.llm.common import (blocked, free_name, group_sums, mixed, one_array, scratch,
                                   split_words, text_bytes, window_hashes, word_hashes)
from stockboard.llm.components import components
from stockboard.llm.substring_dedup import LEAST_WORD_BYTES, Layout, ddl, packed_gaps, unpacked_gaps

SIZE, PERCENT = 4, 85
BLOCK_BYTES = 4 << 20               # of text; the arrays of its shingles take about thirty times as much
CHUNK = 512                         # sets of a tree, in clusters that are split
TREE_SHINGLES = 1 << 21             # shingles of a cluster that is taken whole
TREE_SETS = 1 << 15                 # sets of such a cluster: the walk takes a pass over their groups for each of them
FEW_ROWS = 32                       # sets of other groups that are walked to without a look at shared leading shingles
FIRST_TRIED = 16                    # sets under the rarest leading shingle that are tried ahead of the walk
BASE = 0x9E3779B97F4A7C15
BUCKETS_PER_SHINGLE = 64
SENT = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("gaps", pa.binary())])
CLASSES = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("classes", pa.binary())])
ROWS = pa.schema([("kind", pa.string()), ("doc_id", pa.int64()), ("key", pa.binary()), ("n", pa.int64()),
                  ("token", pa.int64()), ("tokens", pa.binary()), ("ranks", pa.binary())])
LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


class Sets:
    """The distinct shingle sets of a block."""

    def __init__(self, table: pa.Table, size: int):
        words, offsets, vocabulary = split_words(pc.ascii_lower(one_array(table.column("text"))))
        n_words = np.diff(offsets)
        hashes = word_hashes(vocabulary)[words]
        row = np.repeat(np.arange(len(n_words)), n_words)
        n = max(0, len(words) - size + 1)
        inside = np.flatnonzero(row[:n] == row[size - 1:]) if n else np.zeros(0, np.int64)
        shingles = [window_hashes(hashes, size, BASE)[inside]]
        rows = [row[inside]]
        for k in range(1, min(size, int(n_words.max(initial=0)) + 1)):    # shorter than a shingle: one of its own
            short = np.flatnonzero(n_words == k)
            shingles.append(window_hashes(hashes, k, BASE + 2 * k)[offsets[short]] if len(short)
                            else np.zeros(0, np.uint64))
            rows.append(short)
        h, r = np.concatenate(shingles), np.concatenate(rows)
        order = np.lexsort((h, r))
        h, r = h[order], r[order]
        once = np.concatenate(([True], (h[1:] != h[:-1]) | (r[1:] != r[:-1]))) if len(h) else np.zeros(0, bool)
        h, r = h[once], r[once]
        self.sizes = np.bincount(r, minlength=len(n_words))
        offsets = np.concatenate(([0], np.cumsum(self.sizes)))
        one, two = mixed(h), mixed(h ^ np.uint64(BASE))
        total = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64))) for x in (one, two)]
        self.keys = np.stack([t[offsets[1:]] - t[offsets[:-1]] for t in total], axis=1)
        self.keys[:, 0] += self.sizes.astype(np.uint64)
        filled = np.flatnonzero(self.sizes)
        _, first = np.unique(self.keys[filled].view("V16").ravel() if len(filled) else np.zeros(0, "V16"),
                             return_index=True)
        self.first = np.sort(filled[first])                     # one document of each distinct set
        take = np.zeros(len(n_words), bool)
        take[self.first] = True
        self.h = h[take[r]]
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes[self.first])))

    def key(self, i: int) -> bytes:
        return self.keys[i].astype(">u8").tobytes()


def counted(layout: Layout, size: int):
    def run(table: pa.Table) -> pa.Table:
        sets, number = Sets(table, size), table.column("block")[0].as_py()
        buckets = np.sort(layout.buckets(sets.h))
        cuts = layout.cuts(buckets)
        shards = np.flatnonzero(np.diff(cuts)).tolist()
        gaps = [packed_gaps(buckets[cuts[s]:cuts[s + 1]], s * layout.width) for s in shards]
        return pa.Table.from_arrays([pa.array(shards, pa.int32()), pa.array([number] * len(shards), pa.int32()),
                                     pa.array(gaps, pa.binary())], schema=SENT)
    return run


def classed(table: pa.Table) -> pa.Table:
    """For every shingle a block sent: eight times the binary logarithm of the number of sets that hold it."""
    places = [unpacked_gaps(raw.as_buffer().to_pybytes()) for raw in table.column("gaps")]
    _, inverse, count = np.unique(np.concatenate(places), return_inverse=True, return_counts=True)
    classes = np.minimum(np.round(8 * np.log2(count)), 255).astype(np.uint8)[inverse]
    ends = np.cumsum([len(p) for p in places])
    parts = [classes[e - len(p):e].tobytes() for p, e in zip(places, ends.tolist(), strict=True)]
    return pa.Table.from_arrays([table.column("block"), table.column("shard"), pa.array(parts, pa.binary())],
                                schema=CLASSES)


def written(layout: Layout, size: int, percent: int):
    """Members (m), postings (p) and ordered sets (s) of a block."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return ROWS.empty_table()
        sets = Sets(left, size)
        answers = {r["shard"]: r["classes"] for r in right.select(["shard", "classes"]).to_pylist()}
        buckets = layout.buckets(sets.h)
        order = np.argsort(buckets, kind="stable")
        cuts = layout.cuts(buckets[order])
        classes = np.zeros(len(order), np.uint8)
        classes[order] = np.frombuffer(b"".join(answers[s] for s in np.flatnonzero(np.diff(cuts)).tolist()), np.uint8)
        row = np.repeat(np.arange(len(sets.first)), np.diff(sets.offsets))
        by = np.lexsort((sets.h, classes, row))
        h, classes = sets.h[by], classes[by]
        sizes = np.diff(sets.offsets)
        prefix = sizes - (percent * sizes + 99) // 100 + 1
        place = np.arange(len(h)) - np.repeat(sets.offsets[:-1], sizes)
        shared = classes > 0
        posted = shared & (place < np.repeat(prefix, sizes))
        n_posted = group_sums(posted, sets.offsets)
        keys = [sets.key(i) for i in sets.first.tolist()]
        n_docs = left.num_rows
        members = [pa.array(["m"] * n_docs), left.column("doc_id").cast(pa.int64()).combine_chunks(),
                   pa.array([sets.key(i) for i in range(n_docs)], pa.binary()), pa.array(sets.sizes, pa.int64()),
                   pa.nulls(n_docs, pa.int64()), pa.nulls(n_docs, pa.binary()), pa.nulls(n_docs, pa.binary())]
        tokens = h[posted].view(np.int64)
        owner = pa.array(keys, pa.binary()).take(pa.array(row[posted]))
        k = len(tokens)
        postings = [pa.array(["p"] * k, pa.string()), pa.nulls(k, pa.int64()), owner, pa.nulls(k, pa.int64()),
                    pa.array(tokens, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())]
        chosen = np.flatnonzero(n_posted).tolist()
        parts = [(slice(sets.offsets[i], sets.offsets[i + 1])) for i in chosen]
        k = len(chosen)
        ordered = [pa.array(["s"] * k, pa.string()), pa.nulls(k, pa.int64()), pa.array([keys[i] for i in chosen], pa.binary()),
                   pa.array(sizes[chosen] if k else [], pa.int64()), pa.nulls(k, pa.int64()),
                   pa.array([h[s][shared[s]].tobytes() for s in parts], pa.binary()),
                   pa.array([classes[s][shared[s]].tobytes() for s in parts], pa.binary())]
        return pa.concat_tables([pa.Table.from_arrays(x, schema=ROWS) for x in (members, postings, ordered)])
    return run


class Branch:
    __slots__ = ("label", "children", "low", "high", "lows")

    def __init__(self, label: np.ndarray, low: int, high: int):
        self.label, self.low, self.high, self.children = label, low, high, []


class PrefixTree:
    """Ordered sets (rows sorted by their shingles' ranks) with shared beginnings; a
    subtree is a run of rows, and `lows` holds the first rows of a node's children."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.lengths = np.array([len(s) for s in sets], np.int64)
        self.root = self.branch(0, len(sets), 0)

    def branch(self, low: int, high: int, depth: int) -> Branch:
        top = None
        stack = [(low, high, depth, None)]
        made = []
        while stack:
            low, high, depth, parent = stack.pop()
            a, b = self.sets[low], self.sets[high - 1]           # sorted: these two differ first
            k = min(len(a), len(b))
            differs = np.flatnonzero(a[depth:k] != b[depth:k])
            end = depth + int(differs[0]) if len(differs) else k
            node = Branch(a[depth:end], low, high)
            made.append(node)
            if parent is None:
                top = node
            else:
                parent.children.append(node)
            at = low
            while at < high and len(self.sets[at]) == end:       # sets that end here stay rows of this node
                at += 1
            while at < high:
                first = self.sets[at][end]
                to = at + 1
                step = 1
                while to < high and self.sets[min(to + step, high) - 1][end] == first:
                    to = min(to + step, high)
                    step *= 2
                while to < high and self.sets[to][end] == first:
                    to += 1
                stack.append((at, to, end, node))
                at = to
        for node in made:
            node.children.sort(key=lambda c: c.low)
            node.lows = np.array([c.low for c in node.children], np.int64)
        return top


class Leads:
    """The sets so far under the shingles that lead them.

    A set of n shingles links with overlaps of c = ceil(t n) and more. Of two sets that link, the `lead` smallest
    common shingles lie among the first len - c + lead of each; lead = min(c, n - c + 1). So a partner
    has as many of them in common, and where the longest lists of a set are not read, as many less."""

    def __init__(self, tree: PrefixTree, sizes: np.ndarray, n_tokens: int, percent: int):
        self.sets, self.percent = tree.sets, percent
        least = (percent * sizes + 99) // 100
        self.lead = np.minimum(least, sizes - least + 1)
        self.reach = np.where(tree.lengths < least, 0, np.minimum(tree.lengths, tree.lengths - least + self.lead))
        total = np.zeros(n_tokens + 1, np.int64)
        for s, r in zip(tree.sets, self.reach.tolist(), strict=True):
            total[s[:r] + 1] += 1
        self.start = np.cumsum(total)
        self.filled = np.zeros(n_tokens, np.int64)
        self.rows = np.zeros(int(self.start[-1]), np.int32)

    def add(self, x: int) -> None:
        own = self.sets[x][:self.reach[x]]
        self.rows[self.start[own] + self.filled[own]] = x
        self.filled[own] += 1

    def likely(self, x: int) -> np.ndarray:
        """A few rows to try first: the last ones under the rarest leading shingle, and the row before."""
        own = self.sets[x][:self.reach[x]]
        n = self.filled[own]
        if not n.any():
            return np.zeros(0, np.int64)
        t = own[np.argmin(np.where(n > 0, n, len(self.rows) + 1))]
        end = int(self.start[t] + self.filled[t])
        return np.append(self.rows[max(int(self.start[t]), end - FIRST_TRIED):end], x - 1).astype(np.int64)

    def partners(self, x: int, size: int) -> np.ndarray:
        """Rows added before that may link with x, in ascending order."""
        own = self.sets[x][:self.reach[x]]
        smallest = (self.percent * size + 99) // 100                # lead grows with the size
        c = (self.percent * smallest + 99) // 100
        unread = (min(int(self.lead[x]), c, smallest - c + 1) - 1) // 2
        n = self.filled[own]
        read = np.argsort(n, kind="stable")[:len(own) - unread]
        own, n = own[read], n[read]
        ends = np.cumsum(n)
        if not len(ends) or not ends[-1]:
            return np.zeros(0, np.int64)
        rows = self.rows[np.arange(int(ends[-1])) + np.repeat(self.start[own] - ends + n, n)]
        if len(rows) > x // 4:
            counts = np.bincount(rows, minlength=x)
            found = np.flatnonzero(counts)
            counts = counts[found]
        else:
            found, counts = np.unique(rows, return_counts=True)
        return found[counts >= np.minimum(self.lead[found], self.lead[x]) - unread].astype(np.int64)


def tree_links(sets: list[np.ndarray], sizes: np.ndarray, group: np.ndarray, side: np.ndarray | None,
               percent: int) -> list[tuple[int, int]]:
    """Links that connect all linked rows of different groups. `group`: what is
    connected already; `side`: rows with the same side above 0 aren't compared.
    Only paths to rows that may link are walked (`Leads`)."""
    n_tokens = 1 + max((int(s[-1]) for s in sets if len(s)), default=0)
    tree, group, links = PrefixTree(sets), group.copy(), []
    leads = Leads(tree, sizes, n_tokens, percent)
    mark = np.zeros(n_tokens, bool)

    def others(x: int) -> np.ndarray:
        other = group[:x] != group[x]
        if side is not None and side[x]:
            other &= side[:x] != side[x]
        return other

    def join(x: int, y: int) -> None:
        if group[y] != group[x]:
            links.append((x, y))
            group[group == group[x]] = group[y]

    for x in range(len(sets)):
        if not leads.reach[x]:                                     # too few shingles that others hold: no link
            continue
        own, size = sets[x], int(sizes[x])
        mark[own] = True
        other = others(x)
        if int(np.count_nonzero(other)) > FEW_ROWS:
            rows = leads.likely(x)                                 # of near copies, one link mostly settles it
            for y in rows[other[rows]].tolist():
                overlap = int(np.count_nonzero(mark[sets[y]]))
                if 100 * overlap >= percent * (size + int(sizes[y]) - overlap):
                    join(x, y)
                    other = others(x)
                    break
        if int(np.count_nonzero(other)) > FEW_ROWS:
            rows = leads.partners(x, size)
            rows = rows[other[rows]]
        else:
            rows = np.flatnonzero(other)
        leads.add(x)
        rows = rows[(100 * sizes[rows] >= percent * size) & (100 * size >= percent * sizes[rows])]
        stack = [(tree.root, 0, 0, rows)] if len(rows) else []
        while stack:
            node, overlap, depth, rows = stack.pop()
            rows = rows[group[rows] != group[x]]
            if not len(rows):
                continue
            overlap += int(np.count_nonzero(mark[node.label]))
            depth += len(node.label)
            left = len(own) - (int(np.searchsorted(own, node.label[-1], side="right")) if len(node.label) else 0)
            lengths = tree.lengths[rows]
            # needed with the smallest set below: overlap >= percent (size + least) / (100 + percent)
            if (100 + percent) * (overlap + min(left, int(lengths.max()) - depth)) < percent * (size + int(sizes[rows].min())):
                continue
            ended = rows[lengths == depth]
            for y in ended[100 * overlap >= percent * (size + sizes[ended] - overlap)].tolist():
                join(x, y)
            rows = rows[lengths > depth]
            if len(rows):
                child = np.searchsorted(node.lows, rows, side="right") - 1
                cuts = np.flatnonzero(np.diff(child)) + 1
                stack += [(node.children[int(child[a])], overlap, depth, rows[a:b])
                          for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)], strict=True)]
        mark[own] = False
    return links


def joined_links(keys: list[bytes], sizes: list[int], tokens: list[bytes], ranks: list[bytes],
                 labels: list[bytes | None], sides: list[int], percent: int) -> list[tuple[bytes, bytes]]:
    """Links between the sets of one group (rows may repeat)."""
    unique = list({k: i for i, k in enumerate(keys)}.values())
    if len(unique) < 2:
        return []
    parts = [np.frombuffer(tokens[i], np.uint64) for i in unique]
    h = np.concatenate(parts)
    rank = np.concatenate([np.frombuffer(ranks[i], np.uint8) for i in unique])
    order = np.lexsort((h, rank))
    new = np.concatenate(([0], np.cumsum(h[order][1:] != h[order][:-1])))
    place = np.empty(len(h), np.int64)
    place[order] = new
    ends = np.cumsum([len(p) for p in parts])
    sets = [place[e - len(p):e] for p, e in zip(parts, ends.tolist(), strict=True)]
    by = sorted(range(len(unique)), key=lambda i: sets[i].astype(">i8").tobytes())
    number: dict = {}
    group = np.array([number.setdefault(labels[unique[i]] or keys[unique[i]], len(number)) for i in by])
    side = np.array([sides[unique[i]] for i in by])
    links = tree_links([sets[i] for i in by], np.array([sizes[unique[i]] for i in by]), group,
                       side if side.any() else None, percent)
    return [(keys[unique[by[a]]], keys[unique[by[b]]]) for a, b in links]


def linker(percent: int):
    """Rows sorted by (group, chunk) to links; a group and chunk is held at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("key", "n", "tokens", "ranks", "label", "side")
        current, rows = None, []

        def finished() -> pa.RecordBatch:
            found = joined_links(*map(list, zip(*rows, strict=True)), percent) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)],
                                              schema=LINKS)
        for batch in batches:
            for name, *row in zip(*(batch.column(c).to_pylist() for c in ("chunk", *columns)), strict=True):
                if name != current:
                    if len(rows) > 1:
                        yield finished()
                    current, rows = name, []
                rows.append(row)
        yield finished()
    return run


def compared(work: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of the chunks. work: chunk (any type), key, label, side."""
    s = sets.select(F.col("key").alias("__key"), "n", "tokens", "ranks")
    full = work.join(s, F.col("key") == F.col("__key")).select("chunk", "key", "n", "tokens", "ranks", "label", "side")
    return full.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(linker(percent), ddl(LINKS))


def grouped(postings: DataFrame) -> DataFrame:
    """(token, pivot, m, key): the sets under each shingle of two and more, equal groups once."""
    key = F.col("key")
    groups = postings.groupBy("token").agg(
        F.min("key").alias("pivot"), F.count("*").alias("m"), F.bit_xor(F.xxhash64(key)).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(1), key)).alias("y")).where("m > 1")
    once = groups.groupBy("pivot", "m", "x", "y").agg(F.min("token").alias("t"))
    return postings.join(once.select("t", "pivot", "m"), F.col("token") == F.col("t")) \
        .select("token", "pivot", "m", "key")


def clusters(groups: DataFrame, sets: DataFrame, most: int, most_sets: int) -> DataFrame:
    """(key, cluster, large): the candidate cluster of each set, and whether it has more than `most` shingles
    or `most_sets` sets."""
    pairs = groups.where(F.col("key") != F.col("pivot")).select(F.col("pivot").alias("a"), F.col("key").alias("b"))
    found = components(pairs)
    sized = found.join(sets.select("key", "n").distinct(), F.col("node") == F.col("key"))
    totals = sized.groupBy("component").agg(F.min("component").alias("cluster"), (
        (F.sum("n") > most) | (F.count("*") > most_sets)).alias("large"))
    return found.join(totals.select("cluster", "large"), F.col("component") == F.col("cluster")).select(
        F.col("node").alias("key"), "cluster", "large")


def whole(found: DataFrame) -> DataFrame:
    """work: clusters as they are."""
    return found.where("not large").select(F.col("cluster").alias("chunk"), "key",
                                           F.lit(None).cast("binary").alias("label"), F.lit(0).alias("side"))


def stars(groups: DataFrame, chunk: int) -> DataFrame:
    """work: each pivot with the sets whose least pivot it is, in chunks that all hold the pivot."""
    pairs = groups.groupBy("key").agg(F.min("pivot").alias("pivot")).where(F.col("key") != F.col("pivot"))
    parts = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / (chunk - 1)).cast("int").alias("parts"),
                                       F.min("pivot").alias("centre"))
    dealt = pairs.join(parts.select("centre", "parts"), F.col("pivot") == F.col("centre")).select(
        "pivot", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), "key")
    centres = parts.select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                           F.col("pivot").alias("key"))
    return dealt.unionByName(centres).select(F.struct("pivot", "part").alias("chunk"), "key",
                                             F.lit(None).cast("binary").alias("label"), F.lit(0).alias("side"))


def open_groups(groups: DataFrame, labels: DataFrame, chunk: int) -> DataFrame:
    """work: the groups whose sets lie in different components, as pairs of chunks. Sets
    of a group's largest component (side 1) are compared with the other sets only."""
    named = labels.select(F.col("node"), F.col("component"))
    rows = groups.join(named, F.col("key") == F.col("node"), "left").select(
        "token", "key", F.coalesce("component", "key").alias("label"))
    counts = rows.groupBy("token", "label").agg(F.count("*").alias("c"))
    top = counts.groupBy("token").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("m"),
                                      F.count("*").alias("labels"), F.min("token").alias("t")).where("labels > 1")
    half = chunk // 2
    top = top.select("t", F.col("top.label").alias("main"),
                     F.ceil(F.col("top.c") / half).cast("int").alias("mains"),
                     F.ceil((F.col("m") - F.col("top.c")) / half).cast("int").alias("others"))
    open_ = rows.join(top, F.col("token") == F.col("t"))
    is_main = F.col("label") == F.col("main")
    own = F.pmod(F.xxhash64("key"), F.when(is_main, F.col("mains")).otherwise(F.col("others"))).cast("int")
    # Chunk pairs: a main chunk meets every chunk of the others; the others' chunks meet each other.
    meets = F.when(is_main, F.transform(F.sequence(F.lit(0), F.col("others") - 1),
                                        lambda j: F.struct(F.lit(0).alias("with_main"), F.col("own").alias("i"),
                                                           j.cast("int").alias("j")))) \
        .otherwise(F.concat(
            F.transform(F.sequence(F.lit(0), F.col("mains") - 1),
                        lambda i: F.struct(F.lit(0).alias("with_main"), i.cast("int").alias("i"),
                                           F.col("own").alias("j"))),
            F.transform(F.filter(F.sequence(F.lit(0), F.col("others") - 1), lambda j: j != F.col("own")),
                        lambda j: F.struct(F.lit(1).alias("with_main"), F.least(j, F.col("own")).cast("int").alias("i"),
                                           F.greatest(j, F.col("own")).cast("int").alias("j")))))
    return open_.select("token", "key", "label", is_main.alias("is_main"), own.alias("own"), "mains", "others",
                        "main").select(
        "token", "key", "label", F.when(F.col("is_main"), 1).otherwise(0).alias("side"),
        F.explode(meets).alias("pair")).select(F.struct("token", "pair").alias("chunk"), "key", "label", "side")


def classes_of(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, chunk: int = CHUNK,
               tree_shingles: int = TREE_SHINGLES, tree_sets: int = TREE_SETS,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    layout = Layout(text_bytes(docs) // LEAST_WORD_BYTES, BUCKETS_PER_SHINGLE)
    blocks = blocked(docs, block_bytes)
    sent = blocks.groupBy("block").applyInArrow(counted(layout, size), ddl(SENT))
    answers = sent.groupBy("shard").applyInArrow(classed, ddl(CLASSES))
    rows = blocks.groupBy("block").cogroup(answers.groupBy("block")) \
        .applyInArrow(written(layout, size, percent), ddl(ROWS))
    path = scratch(spark, "jaccard-sets")
    rows.write.partitionBy("kind").parquet(path)
    table = spark.read.schema(ddl(ROWS)).parquet(path)
    sets = table.where("kind = 's'").select("key", "n", "tokens", "ranks")
    path = scratch(spark, "jaccard-groups")
    grouped(table.where("kind = 'p'").select("token", "key").distinct()).write.parquet(path)
    groups = spark.read.schema("token long, pivot binary, m long, key binary").parquet(path)

    def stored(links: DataFrame) -> DataFrame:
        path = scratch(spark, "jaccard-links")
        links.write.parquet(path)
        return spark.read.schema(ddl(LINKS)).parquet(path)

    path = scratch(spark, "jaccard-clusters")
    clusters(groups, sets, tree_shingles, tree_sets).write.parquet(path)
    found = spark.read.schema("key binary, cluster binary, large boolean").parquet(path)
    links = stored(compared(whole(found), sets, percent))
    large = found.where("large").select(F.col("key").alias("__large"))
    if not large.isEmpty():
        split = groups.join(large, F.col("key") == F.col("__large"), "left_semi")
        near = stored(compared(stars(split, chunk), sets, percent))
        more = stored(compared(open_groups(split, components(near), chunk), sets, percent))
        links = links.unionByName(near).unionByName(more)
    final = components(links)

    members = table.where("kind = 'm'").select("doc_id", F.col("n").alias("n_shingles"), "key")
    labelled = members.join(final.select("node", "component"), F.col("key") == F.col("node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "key").alias("label"))
    linked = labelled.where("n_shingles > 0")
    least = linked.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.max("label").alias("of"))
    return linked.join(least.select("of", "component_id"), F.col("label") == F.col("of")) \
        .select("doc_id", "n_shingles", "component_id") \
        .unionByName(labelled.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of each component, with all its columns: the one with the least id, one without an id only where
    no other has one. A row is known by its id and text (64 bits of hash), so rows that repeat an id
    with different texts stand for themselves; of rows that repeat both, any one stays. Texts
    without words link with nothing: their rows all stay."""
    row, kept, rows = (free_name(docs, x) for x in ("row", "kept", "rows"))
    named = F.xxhash64(docs["doc_id"], F.coalesce(docs["text"], F.lit("")))
    found = classes_of(docs.select(named.alias("doc_id"), docs["text"]), **options)
    ids = docs.select(named.alias("named"), docs["doc_id"].alias("id")).distinct()
    of = found.where("n_shingles > 0").groupBy("doc_id").agg(F.max("component_id").alias("component"), F.count("*").alias("n"),
                                                             F.max("doc_id").alias("row"))
    least = of.join(ids, F.col("row") == F.col("named")).groupBy("component").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", "n")).alias("o"))
    stay = least.select(F.col("o.row").alias(kept), F.col("o.n").alias(rows)).unionByName(
        found.where("n_shingles = 0").select(F.col("doc_id").alias(kept)).distinct().withColumn(rows, F.lit(1).cast("long")))
    chosen = docs.withColumn(row, named).join(stay, F.col(row) == F.col(kept))
    return chosen.where(F.col(rows) == 1).unionByName(chosen.where(F.col(rows) > 1).dropDuplicates([row])).drop(row, kept, rows)


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return classes_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))
