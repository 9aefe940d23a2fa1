"""Phrase collocation mining with weighted acyclic automata.

Texts are lower-cased (A-Z), cut at `[.,;:!?\\x0A-\\x0D]` into pieces and these into
words `[^\\x20\\x09]+`. A word stands for its language as well: a 64-bit hash of both.

1. One scan counts the words of each language (partial aggregates).
2. A second one makes, for each block of text, the sorted pairs with their counts, as
   a count transducer: sorted n-grams are added in order, each sharing the states of
   the longest prefix that it has in common with the one before; states behind it
   are final then and are merged with equal ones, weights included. It is cut by
   prefix ranges, and one task per range unites the blocks' transducers, adding up weights.
3. An n-gram is at most as frequent as its parts, so a third scan takes n-grams of three
   words and more only where all pairs are frequent. A Bloom filter of the frequent
   pairs tells: it never misses one, and its size is bounded (`FILTER_BITS`), so that
   at worst more n-grams travel. They are united as the pairs are.
4. Every contiguous part of a candidate is looked up in its prefix range: the automaton
   of the parts is composed with the count transducer, both walked together.
   Cuts are scored and contained candidates dropped by joins with these answers.

A range of n-grams follows from the first word and, within it, from the second, so a
word that starts a third of all n-grams is spread over `SPREAD` ranges; a hot n-gram
is one path for each block.

Defined results: a null text is empty; a null language is `und`; an empty table gives
no rows; repeated rows and rows without an id count one by one; equal scores and counts
go by the phrase; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockboard.llm.common import LOWER, mixed, one_array, scratch, slices, text_bytes, word_hashes

MOST_WORDS, LEAST, TOP = 4, 30, 2000
SCALE, COVER = 2_000_000, 80
BLOCK_BYTES = 4 << 20
RANGE_BYTES = 32 << 20                  # of text for each prefix range
SPREAD_BITS = 3                         # of the second word's hash, within a range of first words
FILTER_BITS = 1 << 27
#: Fixed: bytes that end a piece (2), that end a word (1), and those of words (0).
ENDS = np.array([2 if chr(b) in ".,;:!?\n\v\f\r" else 1 if b in (9, 32) else 0 for b in range(256)], np.uint8)
PARTS = "range int, automaton binary"
COUNTS = "range int, words array<long>, f long"
ONE, TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class CountTransducer:
    """Sorted n-grams over an alphabet of word hashes, with weights on the arcs that end one.

    levels[d]: (first arc of each state, word of each arc, its target among the states of
    the next level or -1, its weight or 0); the only state of level 0 is the start."""

    def __init__(self, alphabet: np.ndarray, levels: list[tuple[np.ndarray, ...]]):
        self.alphabet, self.levels = alphabet, levels

    @classmethod
    def of_sorted(cls, alphabet: np.ndarray, grams: np.ndarray, weight: np.ndarray) -> CountTransducer:
        """`grams`: rows of places in the sorted alphabet, shorter ones filled up with -1, sorted, each once."""
        m, depth = grams.shape
        length = (grams >= 0).sum(axis=1)
        fresh = np.zeros(m, bool)                   # the prefix up to here is not shared with the row before
        fresh[:1] = True
        levels = []
        parent = np.zeros(m, np.int64)              # arc of each row at the level before
        n_parents = 1
        for d in range(depth):
            fresh = fresh | np.concatenate((fresh[:1], grams[1:, d] != grams[:-1, d]))
            on = length > d
            starts = np.flatnonzero(fresh & on)
            if not len(starts):
                break
            arc = np.cumsum(fresh & on) - 1
            count = np.where(length[starts] == d + 1, weight[starts], 0)
            first = np.searchsorted(parent[starts], np.arange(n_parents + 1))
            levels.append([first, grams[starts, d], np.full(len(starts), -1, np.int64), count])
            parent, n_parents = arc, len(starts)
        return cls(alphabet, cls.merged(levels))

    @staticmethod
    def merged(levels: list[list[np.ndarray]]) -> list[tuple[np.ndarray, ...]]:
        """From the deepest level up, states with the same arcs, targets and weights become one."""
        out: list[tuple[np.ndarray, ...]] = []
        target_of = None
        for first, word, target, weight in reversed(levels):
            if target_of is not None:
                target = target_of
            size = np.diff(first)
            filled = np.flatnonzero(size)
            begin = first[:-1][filled]
            lanes = [mixed((word.astype(np.uint64) * ONE) ^ ((target + 2).astype(np.uint64) * TWO) ^ mixed(weight.astype(np.uint64) + lane))
                     for lane in (ONE, TWO)]
            sums = np.stack([np.add.reduceat(x, begin) if len(begin) else np.zeros(0, np.uint64) for x in lanes], axis=1)
            sums[:, 0] += size[filled].astype(np.uint64)
            _, one, same = np.unique(np.ascontiguousarray(sums).view("V16").ravel(), return_index=True, return_inverse=True)
            kept = np.sort(one)                                      # states in the order of their first use
            rank = np.empty(len(one), np.int64)
            rank[np.argsort(one, kind="stable")] = np.arange(len(one))
            state = np.full(len(size), -1, np.int64)
            state[filled] = rank[same]
            sizes = size[filled][kept]
            ends = np.cumsum(sizes)
            arcs = np.arange(int(sizes.sum())) - np.repeat(ends - sizes, sizes) + np.repeat(begin[kept], sizes)
            out.append((np.concatenate(([0], ends)), word[arcs], target[arcs], weight[arcs]))
            target_of = state
        return out[::-1]

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams as rows of places in the alphabet, weights), sorted."""
        rows, weights = [], []
        state, prefix = np.zeros(1, np.int64), np.zeros((1, 0), np.int64)
        depth = len(self.levels)
        for d, (first, word, target, weight) in enumerate(self.levels):
            size = first[state + 1] - first[state]
            arcs = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[state], size)
            prefix = np.hstack((np.repeat(prefix, size, axis=0), word[arcs][:, None]))
            final = weight[arcs] > 0
            rows.append(np.hstack((prefix[final], np.full((int(final.sum()), depth - d - 1), -1, np.int64))))
            weights.append(weight[arcs][final])
            on = target[arcs] >= 0
            state, prefix = target[arcs][on], prefix[on]
        if not rows:
            return np.zeros((0, 1), np.int64), np.zeros(0, np.int64)
        return in_row_order(np.vstack(rows), np.concatenate(weights))

    @classmethod
    def united(cls, parts: list[CountTransducer], least: int = 1) -> CountTransducer:
        """Union with weights added up; paths below `least` go."""
        alphabet = np.unique(np.concatenate([p.alphabet for p in parts])) if parts else np.zeros(0, np.uint64)
        depth = max((len(p.levels) for p in parts), default=1)
        rows, weights = [], []
        for p in parts:
            row, weight = p.paths()
            place = np.append(np.searchsorted(alphabet, p.alphabet), -1)           # -1 stays -1
            row = place[row]
            rows.append(np.hstack((row, np.full((len(row), depth - row.shape[1]), -1, np.int64))))
            weights.append(weight)
        row, weight = in_row_order(np.vstack(rows), np.concatenate(weights)) if rows \
            else (np.zeros((0, 1), np.int64), np.zeros(0, np.int64))
        new = np.concatenate(([True], (row[1:] != row[:-1]).any(axis=1))) if len(row) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        total = np.add.reduceat(weight, begin) if len(begin) else weight
        kept = total >= least
        return cls.of_sorted(alphabet, row[begin][kept], total[kept])

    def composed(self, counts: CountTransducer) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of this automaton that `counts` holds, with their weights there."""
        known = np.searchsorted(counts.alphabet, self.alphabet)
        there = np.minimum(known, max(0, len(counts.alphabet) - 1))
        known = np.where(counts.alphabet[there] == self.alphabet, there, -1) if len(counts.alphabet) \
            else np.full(len(self.alphabet), -1)
        mine, theirs, prefix = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros((1, 0), np.int64)
        rows, weights, depth = [], [], len(self.levels)
        for d, ((first, word, target, weight), level) in enumerate(zip(self.levels, counts.levels)):
            size = first[mine + 1] - first[mine]
            arcs = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[mine], size)
            prefix = np.hstack((np.repeat(prefix, size, axis=0), word[arcs][:, None]))
            span = len(counts.alphabet) + 1
            keys = np.repeat(np.arange(len(level[0]) - 1), np.diff(level[0])) * span + level[1]     # ascending
            wanted = np.repeat(theirs, size) * span + known[word[arcs]]
            at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
            met = (keys[at] == wanted) & (known[word[arcs]] >= 0) if len(keys) else np.zeros(len(wanted), bool)
            arcs, at, prefix = arcs[met], at[met], prefix[met]
            final = (weight[arcs] > 0) & (level[3][at] > 0)
            rows.append(np.hstack((prefix[final], np.full((int(final.sum()), depth - d - 1), -1, np.int64))))
            weights.append(level[3][at][final])
            on = (target[arcs] >= 0) & (level[2][at] >= 0)
            mine, theirs, prefix = target[arcs][on], level[2][at][on], prefix[on]
        if not rows:
            return np.zeros((0, 1), np.int64), np.zeros(0, np.int64)
        return np.vstack(rows), np.concatenate(weights)

    def packed(self) -> bytes:
        """All arrays in the least width that holds them, compressed."""
        arrays = [self.alphabet]
        for first, word, target, weight in self.levels:
            arrays += [np.diff(first), np.diff(word, prepend=0) & 0xFFFFFFFF, target + 1, weight]
        body = []
        for a in arrays:
            most = int(a.max(initial=0))
            kind = 3 if a.dtype == np.uint64 else next(k for k, top in enumerate((0xFF, 0xFFFF, 0xFFFFFFFF, 1 << 63)) if most <= top)
            body.append(np.array([kind, len(a)], "<i8").tobytes() + a.astype(f"<u{1 << kind}").tobytes())
        raw = b"".join(body)
        return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)

    @classmethod
    def unpacked(cls, blob: bytes) -> CountTransducer:
        raw = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
        arrays, at = [], 0
        while at < len(raw):
            kind, n = np.frombuffer(raw, "<i8", 2, at).tolist()
            arrays.append(np.frombuffer(raw, f"<u{1 << kind}", n, at + 16))
            at += 16 + (n << kind)
        levels = []
        for k in range(1, len(arrays), 4):
            size, word, target, weight = (a.astype(np.int64) for a in arrays[k:k + 4])
            levels.append((np.concatenate(([0], np.cumsum(size))), np.cumsum(word) & 0xFFFFFFFF, target - 1, weight))
        return cls(arrays[0], levels)


def in_row_order(rows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort(rows.T[::-1])
    return rows[order], weights[order]


class Words:
    """The words of a block of texts in order; a word's id is the place of its hash in the sorted alphabet."""

    def __init__(self, langs: list[str], texts: pa.StringArray):
        data = np.frombuffer(texts.buffers()[2].to_pybytes().translate(LOWER), np.uint8)
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1).astype(np.int64)
        ends = ENDS[data]
        inside = ends == 0
        starts = np.zeros(len(data) + 1, bool)
        starts[offsets] = True                                     # texts begin pieces as well
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | starts[1:-1]
        first = np.flatnonzero(begin)
        piece = np.cumsum(ends == 2)[first] + (np.searchsorted(offsets, first, side="right") - 1) if len(first) else first
        self.text = np.searchsorted(offsets, first, side="right") - 1
        size = np.add.reduceat(inside.astype(np.int64), first) if len(first) else first
        flat = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int32).tobytes()),
                                           pa.py_buffer(data[inside].tobytes()))
        coded = flat.dictionary_encode()
        self.strings = coded.dictionary
        # Pieces of different texts never have the same number: a text adds one to the count of piece ends.
        self.piece = piece
        names = sorted(set(langs))
        number = {x: i for i, x in enumerate(names)}
        lang = np.array([number[x] for x in langs], np.int64)[self.text] if len(first) else first
        both, ids = np.unique(lang * max(1, len(self.strings)) + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)
        self.lang_of, self.string_of = both // max(1, len(self.strings)), both % max(1, len(self.strings))
        of_lang = mixed(word_hashes(np.array(names, object), 1))
        h = mixed(word_hashes(self.strings)[self.string_of] ^ of_lang[self.lang_of]) if len(both) else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.names, self.alphabet, self.ids = names, h[order], place[ids] if len(both) else np.zeros(0, np.int64)
        self.lang_of, self.string_of = self.lang_of[order], self.string_of[order]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first word of each pair in the text, code of the pair)."""
        at = np.flatnonzero(self.piece[1:] == self.piece[:-1]) if len(self.ids) else np.zeros(0, np.int64)
        return at, self.ids[at] * len(self.alphabet) + self.ids[at + 1]


def language(name: str | None) -> str:
    return "und" if name is None else name


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for batch in slices(batches, BLOCK_BYTES):
        yield Words([language(x) for x in batch.column("lang").to_pylist()], one_array(batch.column("text")))


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for w in blocks(batches):
        yield pa.RecordBatch.from_arrays(
            [pa.array(w.names, pa.string()).take(pa.array(w.lang_of)), w.strings.take(pa.array(w.string_of)),
             pa.array(w.alphabet.view(np.int64)), pa.array(np.bincount(w.ids, minlength=len(w.alphabet)), pa.int64())],
            ["lang", "word", "h", "c"])


def range_of(first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    """The prefix range of n-grams by the hashes of their first two words (0 for a missing one)."""
    low = (second >> np.uint64(64 - SPREAD_BITS)).astype(np.int64)
    return ((first >> np.uint64(64 - bits)).astype(np.int64) << SPREAD_BITS if bits else 0) | low


def cut(alphabet: np.ndarray, grams: np.ndarray, weight: np.ndarray, bits: int) -> pa.RecordBatch:
    """Sorted n-grams as one transducer for each prefix range."""
    r = range_of(alphabet[grams[:, 0]], alphabet[grams[:, 1]], bits) if len(grams) else np.zeros(0, np.int64)
    order = np.argsort(r, kind="stable")
    r = r[order]
    ranges, begin = np.unique(r, return_index=True)
    parts = []
    for rows in np.split(order, begin[1:]) if len(ranges) else []:
        used, codes = np.unique(grams[rows], return_inverse=True)
        codes = codes.reshape(len(rows), -1)
        if used[0] < 0:
            used, codes = used[1:], codes - 1
        parts.append(CountTransducer.of_sorted(alphabet[used], codes, weight[rows]).packed())
    return pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(parts, pa.binary())], ["range", "automaton"])


def pair_maker(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in blocks(batches):
            code, count = np.unique(w.pairs()[1], return_counts=True)
            v = max(1, len(w.alphabet))
            yield cut(w.alphabet, np.stack((code // v, code % v), axis=1), count, bits)
    return run


def filter_places(first: np.ndarray, second: np.ndarray, n_bits: int) -> list[np.ndarray]:
    h = mixed(first * ONE + mixed(second))
    return [(x % np.uint64(n_bits)).astype(np.int64) for x in (h, mixed(h ^ TWO), mixed(h ^ ONE))]


def gram_maker(bits: int, most: int, n_bits: int, frequent):
    """n-grams of 3 to `most` words all of whose pairs pass the filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.frombuffer(frequent.value, np.uint8)
        for w in blocks(batches):
            v = max(1, len(w.alphabet))
            at, code = w.pairs()
            distinct, which = np.unique(code, return_inverse=True)
            places = filter_places(w.alphabet[distinct // v], w.alphabet[distinct % v], n_bits) if len(distinct) else []
            passed = np.ones(len(distinct), bool)
            for p in places:
                passed &= (flags[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
            link = np.zeros(len(w.ids) + 1, bool)             # this word and the next are a frequent pair
            link[at] = passed[which]
            prefix = np.full(len(w.ids) + 1, -1, np.int64)    # number of the n-gram that begins here
            prefix[at] = which
            grams = np.stack((distinct // v, distinct % v), axis=1)
            here = at[link[at]]
            rows, weights = [], []
            for n in range(3, most + 1):
                here = here[link[here + n - 2]]
                number, which, count = np.unique(prefix[here] * v + w.ids[here + n - 1], return_inverse=True, return_counts=True)
                grams = np.hstack((grams[number // v], (number % v)[:, None]))
                prefix[here] = which
                rows.append(np.hstack((grams, np.full((len(grams), most - n), -1, np.int64))))
                weights.append(count)
            row, weight = in_row_order(np.vstack(rows), np.concatenate(weights))
            yield cut(w.alphabet, row, weight, bits)
    return run


def uniter(least: int):
    def run(table: pa.Table) -> pa.Table:
        whole = CountTransducer.united([CountTransducer.unpacked(x) for x in table.column("automaton").to_pylist()], least)
        row, weight = whole.paths()
        hashes = np.append(whole.alphabet, np.uint64(0)).view(np.int64)[row]
        real = row >= 0
        words = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(real.sum(axis=1)))), pa.int32()), pa.array(hashes[real]))
        return pa.Table.from_arrays([pa.array([table.column("range")[0].as_py()] * len(row), pa.int32()), words, pa.array(weight, pa.int64())],
                                    ["range", "words", "f"])
    return run


def filter_bits(n_bits: int, chunk: int = 1 << 19):
    """Set bits of the filter in pieces of 64 KB."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(n_bits, bool)
        for batch in batches:
            if batch.num_rows:
                pair = batch.column("words").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 2)
                for p in filter_places(pair[:, 0], pair[:, 1], n_bits):
                    flags[p] = True
        pieces = [k for k in range(0, n_bits, chunk) if flags[k:k + chunk].any()]
        for k in pieces:
            yield pa.RecordBatch.from_arrays([pa.array([k // chunk], pa.int32()), pa.array(
                [np.packbits(flags[k:k + chunk], bitorder="little").tobytes()], pa.binary())], ["piece", "bits"])
    return run


def either(table: pa.Table) -> pa.Table:
    whole = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()])
    return pa.Table.from_arrays([table.column("piece").slice(0, 1), pa.array([whole.tobytes()], pa.binary())], ["piece", "bits"])


def as_transducer(words: pa.ChunkedArray, weight: np.ndarray) -> CountTransducer:
    lists = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], words.type)
    n = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    alphabet, code = np.unique(flat, return_inverse=True)
    depth = int(n.max(initial=1))
    rows = np.full((len(n), depth), -1, np.int64)
    rows[np.arange(depth) < n[:, None]] = code
    return CountTransducer.of_sorted(alphabet, *in_row_order(rows, weight))


def looked_up(counts: pa.Table, parts: pa.Table) -> pa.Table:
    """The parts of a range composed with its counts."""
    if not counts.num_rows or not parts.num_rows:
        return pa.table({"part": pa.array([], pa.list_(pa.int64())), "found": pa.array([], pa.int64())})
    wanted = as_transducer(parts.column("words"), np.ones(parts.num_rows, np.int64))
    row, weight = wanted.composed(as_transducer(counts.column("words"), counts.column("f").to_numpy()))
    real = row >= 0
    hashes = np.append(wanted.alphabet, np.uint64(0)).view(np.int64)[row]
    return pa.Table.from_arrays([pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(real.sum(axis=1)))), pa.int32()),
                                                          pa.array(hashes[real])), pa.array(weight, pa.int64())], ["part", "found"])


def range_column(bits: int):
    """range_of as a column expression over `words`."""
    first, second = F.element_at("words", 1), F.try_element_at("words", F.lit(2))
    low = F.when(second.isNull(), 0).otherwise(F.shiftrightunsigned(second, 64 - SPREAD_BITS))
    high = F.shiftleft(F.shiftrightunsigned(first, 64 - bits), SPREAD_BITS) if bits else F.lit(0)
    return high.bitwiseOR(low).cast("int").alias("range")


def collocations(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST, top: int = TOP, scale: int = SCALE,
                 cover: int = COVER, range_bytes: int = RANGE_BYTES, filter_limit: int = FILTER_BITS) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    d = docs.select(docs["lang"].cast("string").alias("lang"), docs["text"])
    bits = max(0, (text_bytes(d) // range_bytes).bit_length() - SPREAD_BITS + 1)

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = scratch(spark, f"collocations-{name}")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    words = stored(d.mapInArrow(word_counts, "lang string, word string, h long, c long")
                   .groupBy("lang", "word").agg(F.max("h").alias("h"), F.sum("c").alias("c")), "words")
    pairs = stored(d.mapInArrow(pair_maker(bits), PARTS).groupBy("range").applyInArrow(uniter(least), COUNTS), "pairs")
    counts = pairs
    if most_words > 2:
        n_bits = 1 << 19
        while n_bits < min(filter_limit, 16 * pairs.count()):
            n_bits <<= 1
        pieces = pairs.select("words").mapInArrow(filter_bits(n_bits), "piece int, bits binary") \
            .groupBy("piece").applyInArrow(either, "piece int, bits binary").collect()      # n_bits at most: bounded
        flags = np.zeros(n_bits >> 3, np.uint8)
        for p in pieces:
            flags[p.piece << 16:(p.piece + 1) << 16] = np.frombuffer(p.bits, np.uint8)
        frequent = spark.sparkContext.broadcast(flags.tobytes())
        grams = stored(d.mapInArrow(gram_maker(bits, most_words, n_bits, frequent), PARTS)
                       .groupBy("range").applyInArrow(uniter(least), COUNTS), "grams")
        counts = pairs.unionByName(grams)

    # All contiguous parts of candidates, with the count of the most frequent candidate around each.
    n = F.size("words")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.transform(
        F.sequence(F.lit(1), n - k + 1), lambda at: F.struct(F.slice("words", at, k).alias("words")))))
    parts = counts.select("f", F.explode(spans).alias("p")).groupBy("p.words").agg(F.max("f").alias("around"))
    singles = words.where(F.col("c") >= least).select(F.array("h").alias("words"), F.col("c").alias("f"))
    everything = counts.select("words", "f").unionByName(singles).withColumn("range", range_column(bits))
    parts = stored(parts, "parts")
    found = stored(everything.groupBy("range").cogroup(parts.select("words", range_column(bits)).groupBy("range"))
                   .applyInArrow(looked_up, "part array<long>, found long"), "found")

    kept = counts.join(parts.select(F.col("words").alias("part"), "around"), F.col("words") == F.col("part"), "left") \
        .where(F.col("around").isNull() | (F.lit(100).cast("decimal(20,0)") * F.col("around") < F.lit(cover).cast("decimal(20,0)") * F.col("f"))) \
        .select("words", F.col("f").alias("a"))
    cuts = kept.select("words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")).select(
        "words", "a", "k", F.slice("words", 1, F.col("k")).alias("left"),
        F.slice("words", F.col("k") + 1, F.size("words")).alias("right"))
    scored = cuts.join(found.select(F.col("part").alias("left"), F.col("found").alias("l")), "left") \
        .join(found.select(F.col("part").alias("right"), F.col("found").alias("r")), "right")
    score = F.expr(f"(cast(a as decimal(20,0)) * {int(scale)}) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = scored.groupBy("words", "a").agg(F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("b"))
    # Back to text: a word's hash names its language and string.
    named = best.select("words", "a", "b", F.posexplode("words").alias("at", "w")) \
        .join(words.select("h", "lang", "word"), F.col("w") == F.col("h")) \
        .groupBy("words").agg(F.max("lang").alias("lang"), F.max("a").alias("a"), F.max("b").alias("b"),
                              F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    totals = words.groupBy("lang").agg(F.sum("c").alias("n"), F.max("lang").alias("of"))
    rows = named.select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    rows = rows.join(totals.select("of", "n"), F.col("lang") == F.col("of"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top) \
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
              translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, [x FOR x IN string_split_regex(piece, '[\x20\x09]+') IF x <> ''] AS ws FROM p),
g AS (SELECT lang, ws[i:i + k - 1] AS ph FROM
      (SELECT lang, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k)),
f AS (SELECT lang, ph, count(*) AS f FROM g GROUP BY lang, ph),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(ph) = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE len(ph) >= 2 AND f >= 30),
sub AS (SELECT lang, ph[i:i + k - 1] AS ph, max(f) AS around FROM
        (SELECT lang, ph, f, k, unnest(generate_series(1, len(ph) - k + 1)) AS i FROM c, (SELECT unnest([2, 3]) AS k) WHERE len(ph) > k) GROUP BY 1, 2),
kept AS (SELECT c.lang, c.ph, c.f AS a FROM c LEFT JOIN sub USING (lang, ph) WHERE around IS NULL OR 100 * around < 80 * c.f),
cuts AS (SELECT lang, ph, a, unnest(generate_series(1, len(ph) - 1)) AS k FROM kept),
s AS (SELECT cuts.*, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score
      FROM cuts JOIN f x ON x.lang = cuts.lang AND x.ph = cuts.ph[1:k] JOIN f y ON y.lang = cuts.lang AND y.ph = cuts.ph[k + 1:]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
o AS (SELECT b.lang, array_to_string(ph, ' ') AS phrase, a, l, r, n.n, score::BIGINT AS score FROM b JOIN n USING (lang))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM o QUALIFY rank <= 2000
"""
