"""LM scoring with an Elias-Fano n-gram trie.

The model: p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)) for a text's first token, and
p(w | h) = (c(h w) + m(h) p(w)) / (c(h) + m(h)) with m(h) = 4 c(h)^0.8 after a
known word h, p(w) after an unknown one: for each h a distribution over the V
known tokens and one for all unknown ones. Likewise p(w | g h) = (c(g h w) +
m(g h) p(w | h)) / (c(g h) + m(g h)) after a known pair g h, p(w | h) after an
unknown one. A token is a word or the end of a text. `base_score` adds up the
logarithms of p(w), `score` those of p(w | h), `trigram_score` those of p(w | g h).

Documents are dealt into blocks of bounded size (one shuffle, read three times).
1. Blocks send their distinct words (hash) with the counts of learning
   documents to shards, which answer with the counts of all and an id, and with
   their shares of N and V (every block asks every shard).
2. Blocks send their distinct pairs of known words, sorted, with counts, and
   below each pair the known words that follow it. A pair's shard follows from
   its first word; a word that is frequent beyond `HOT_TOKENS` is split further
   by its second one, a pair of two such words by the third (the pair itself
   goes to each of these shards). One task per shard adds the counts, builds
   two trie levels (Elias-Fano contexts, pointers and successors, quantised
   c(h w) / (c(h) + m(h)) in 16 bits; contexts are words in the first and places
   of pairs in the second), maps them into memory and answers each block's pairs
   and triples by context-relative successor search.
3. Blocks put the answers together and add up the logarithms per document. The
   count of a pair as a context follows from its code.

Words are told apart by 80 bits of hash. Quantising rounds down, so that the
probabilities of a context sum to 1 or, by less than 0.04 % a level, below.

Defined results: a null text is an empty one, whose only token is the end; a
null doc_id counts as held out; without learning documents N, V and all counts
are 0 and base is log10(0.1 / 0.1) = 0 per token; rows that repeat a doc_id are
documents of their own; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from stockboard.llm.common import (BLOCK_BYTES, blocked, group_sums, in_order, mixed, objects, one_array, row_of,
                                   split_words, text_bytes, word_hashes)
from stockboard.llm.elias_fano import ABSENT, STEPS_PER_BIT, TrieLevel, probability, quantised
from stockboard.llm.substring_dedup import LEAST_WORD_BYTES, ddl

FOLDS, FOLD = 10, 0
ADD = 0.1
WEIGHT, POWER = 4.0, 0.8
HOT_TOKENS = 1 << 21
SHARD_ENTRIES = 1 << 20
SQUEEZED = 256                      # bytes from which a message's arrays are compressed
END = "\x20end"                     # no word holds a blank
WORDS = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("h", pa.binary()), ("check", pa.binary()),
                   ("count", pa.binary())])
COUNTS = pa.schema([("block", pa.int32()), ("level", pa.int32()), ("shard", pa.int32()), ("a", pa.binary()),
                    ("b", pa.binary()), ("tokens", pa.int64()), ("distinct", pa.int64())])
PAIRS = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("context", pa.binary()), ("seen", pa.binary()),
                   ("n", pa.binary()), ("word", pa.binary()), ("count", pa.binary())])
GRAMS = pa.schema([*PAIRS, ("followers", pa.binary()), ("next", pa.binary()), ("next_count", pa.binary())])
SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                    ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
                    ("train_tokens", pa.int64()), ("trigram_score", pa.float64())])


def packed(values: np.ndarray) -> bytes:
    """Unsigned integers in as few bytes each as the largest needs, all first bytes first, compressed if that is worth it."""
    values = values.astype("<u8")
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    raw = values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    if len(raw) < SQUEEZED:
        return bytes([width]) + raw
    return bytes([width + 8]) + len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(raw: bytes) -> np.ndarray:
    width, data = raw[0], memoryview(raw)[1:]
    if width > 8:
        width -= 8
        data = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd")
    narrow = np.frombuffer(data, np.uint8).reshape(width, -1)
    wide = np.zeros((narrow.shape[1], 8), np.uint8)
    wide[:, :width] = narrow.T
    return wide.view("<u8").ravel()


def weight(h: np.ndarray) -> np.ndarray:
    """m(h): the weight of the shorter context beside a context that was learnt h times."""
    return WEIGHT * h ** POWER


def share(h: np.ndarray) -> np.ndarray:
    """Of the probability after the shorter context: m(h) / (h + m(h)), 1 after an unknown one."""
    m = weight(h)
    return np.divide(m, h + m, out=np.ones(len(h)), where=h > 0)


def count_of(code: np.ndarray, h: np.ndarray) -> np.ndarray:
    """How often a pair was learnt, from its code and the count of its first word: exact, or too
    large by less than 0.04 % where a code stands for several counts; 0 if absent."""
    above = np.exp2((1 - code.astype(np.float64)) / STEPS_PER_BIT) * (h + weight(h))
    return np.where(code == ABSENT, 0.0, np.maximum(np.ceil(above * (1 + 1e-9)) - 1, 1))


def shard_bits(entries: int) -> int:
    return (entries // SHARD_ENTRIES).bit_length()


def is_held_out(ids: list, folds: int, fold: int) -> np.ndarray:
    return np.array([i is None or zlib.crc32(str(i).encode()) % folds == fold for i in ids], bool)


def sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Of the runs that begin at the places given."""
    return np.add.reduceat(values, begin) if len(begin) else values[:0]


def by_context(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """An order of pairs by context and word; equal ones in any order."""
    bits = int(word.max(initial=0)).bit_length()
    if bits + int(context.max(initial=0)).bit_length() > 64:
        return np.lexsort((word, context))
    return np.argsort((context << np.uint64(bits)) | word)


class Tokens:
    """Tokens of the texts of a block as numbers of its distinct ones, sorted by hash."""

    def __init__(self, ids: list, texts: pa.StringArray, folds: int, fold: int):
        words, offsets, vocabulary = split_words(pc.ascii_lower(texts))
        distinct = np.append(objects(vocabulary), END)
        words = np.insert(words, offsets[1:], len(vocabulary))
        self.offsets = offsets + np.arange(len(offsets))
        h = word_hashes(distinct)
        order = np.argsort(h, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.h, self.check = h[order], word_hashes(distinct, 1)[order].astype(np.uint16)
        self.words = place[words]
        self.held_out = is_held_out(ids, folds, fold)
        self.learnt = ~self.held_out[row_of(self.offsets)]
        self.count = np.bincount(self.words[self.learnt], minlength=len(order))

    def cuts(self, bits: int) -> np.ndarray:
        return np.searchsorted(self.h >> np.uint64(64 - bits), np.arange((1 << bits) + 1)) if bits \
            else np.array([0, len(self.h)])

    def sent(self, bits: int, number: int) -> pa.Table:
        """A row for every shard, also without words; hashes as steps from the one before."""
        cuts = self.cuts(bits)
        parts = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return table_of([(s, number, packed(np.diff(self.h[p], prepend=np.uint64(0))), self.check[p].tobytes(),
                          packed(self.count[p])) for s, p in enumerate(parts)], WORDS)


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def tokens_of(table: pa.Table, folds: int, fold: int) -> Tokens:
    return Tokens(table.column("doc_id").to_pylist(), one_array(table.column("text")), folds, fold)


def gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(number of the distinct word of each entry, learnt count of each distinct word, entries of each row)."""
    h = np.concatenate([np.cumsum(unpacked(raw), dtype=np.uint64) for raw in table.column("h").to_pylist()])
    check = np.frombuffer(b"".join(table.column("check").to_pylist()), np.uint16)
    counts = [unpacked(raw) for raw in table.column("count").to_pylist()]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if (same & (check[order][1:] != check[order][:-1])).any():
        order = np.lexsort((check, h))
    new = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (check[order][1:] != check[order][:-1]))) \
        if len(h) else np.zeros(0, bool)
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(new) - 1
    total = sums(np.concatenate(counts).astype(np.int64)[order], np.flatnonzero(new))
    return number, total, [len(c) for c in counts]


def words_answered(bits: int):
    def run(table: pa.Table) -> pa.Table:
        number, total, sizes = gathered(table)
        shard = table.column("shard")[0].as_py()
        # The more frequent a word, the smaller its id.
        known = np.flatnonzero(total)
        ids = np.zeros(len(total), np.int64)
        ids[known[np.argsort(-total[known], kind="stable")]] = 1 + shard + (np.arange(len(known)) << bits)
        ends = np.cumsum(sizes).tolist()
        rows = [(b, 1, shard, packed(total[number[e - n:e]]), packed(ids[number[e - n:e]]), int(total.sum()), len(known))
                for b, e, n in zip(table.column("block").to_pylist(), ends, sizes, strict=True)]
        return table_of(rows, COUNTS)
    return run


class Known:
    """Counts and ids of a block's distinct tokens, and its distinct pairs and triples of known ones in order of ids."""

    def __init__(self, tokens: Tokens, answers: pa.Table, bits: int):
        found = {r["shard"]: r for r in answers.filter(pc.equal(answers.column("level"), 1)).to_pylist()}
        self.n, self.v = (sum(r[c] for r in found.values()) for c in ("tokens", "distinct"))
        self.count = np.concatenate([unpacked(found[s]["a"]) for s in range(1 << bits)]).astype(np.int64)
        self.ids = np.concatenate([unpacked(found[s]["b"]) for s in range(1 << bits)])
        order = np.argsort(self.ids, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        row = row_of(tokens.offsets)
        a, b = tokens.words[:-1], tokens.words[1:]
        self.pair = np.flatnonzero((row[1:] == row[:-1]) & (self.ids[a] > 0) & (self.ids[b] > 0))  # place of the first
        a, b = a[self.pair], b[self.pair]
        self.keys, self.of_pair = np.unique((rank[a] << 32) | rank[b], return_inverse=True)
        self.learnt = np.bincount(self.of_pair[tokens.learnt[self.pair]], minlength=len(self.keys))
        first, second = order[self.keys >> 32], order[self.keys & 0xFFFFFFFF]
        self.context, self.word, self.seen = self.ids[first], self.ids[second], self.count[first]
        # Two pairs at neighbouring places are of one text.
        at = np.flatnonzero(np.diff(self.pair) == 1)
        self.triple = self.pair[at]                                                    # place of the first
        keys, self.of_triple = np.unique((self.of_pair[at] << 32) | rank[b[at + 1]], return_inverse=True)
        self.triple_learnt = np.bincount(self.of_triple[tokens.learnt[self.triple]], minlength=len(keys))
        self.parent, self.next = keys >> 32, self.ids[order[keys & 0xFFFFFFFF]]
        self.parts = -(-np.minimum(self.seen, self.count[second]) // HOT_TOKENS)       # shards of a pair's triples

    def shards(self, bits: int) -> Routes:
        """Pairs and triples by shard, both in order of ids within a shard."""
        def shard_of(mix: np.ndarray) -> np.ndarray:
            return (mix >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(mix), np.int64)

        parts = -(-self.seen // HOT_TOKENS)
        part = np.where(parts > 1, self.word.astype(np.int64) % np.maximum(parts, 1), 0).astype(np.uint64)
        mix = mixed(mixed(self.context) + part)
        shard = shard_of(mix)
        pair, triple_shard = np.arange(len(shard)), shard[self.parent]
        hot = np.flatnonzero(self.parts > 1)
        if len(hot):
            def split(pairs: np.ndarray, k: np.ndarray) -> np.ndarray:
                apart = mixed(mixed(mix[pairs] + self.word[pairs]) + k.astype(np.uint64))
                return np.where(k > 0, shard_of(apart), shard[pairs])

            below = np.flatnonzero(self.parts[self.parent] > 1)
            at = self.parent[below]
            triple_shard[below] = split(at, self.next[below].astype(np.int64) % self.parts[at])
            copies = np.repeat(hot, self.parts[hot])
            number = np.arange(len(copies)) - np.repeat(np.cumsum(self.parts[hot]) - self.parts[hot], self.parts[hot])
            sent = np.unique(np.concatenate(((shard << 32) | pair, (split(copies, number) << 32) | copies)))
            shard, pair = sent >> 32, sent & 0xFFFFFFFF
        return Routes(shard, pair, triple_shard, self.parent, bits)


class Routes:
    """What a block sends to each shard: `pairs`, `followers` of each, and `triples` in the order of these."""

    def __init__(self, shard: np.ndarray, pair: np.ndarray, triple_shard: np.ndarray, parent: np.ndarray, bits: int):
        small = np.uint16 if bits <= 16 else np.int64                                  # 16 bits are sorted faster
        order = np.argsort(shard.astype(small), kind="stable")
        self.pairs = pair[order]
        self.triples = np.argsort(triple_shard.astype(small), kind="stable")
        self.cuts, self.triple_cuts = (np.concatenate(([0], np.cumsum(np.bincount(x, minlength=1 << bits))))
                                       for x in (shard, triple_shard))
        if len(pair) == int(pair.max(initial=-1)) + 1:                                 # each pair is sent to one shard
            place = np.empty(len(pair), np.int64)
            place[self.pairs] = np.arange(len(pair))
            below = place[parent]
        else:
            below = np.searchsorted((shard[order] << 32) | self.pairs, (triple_shard << 32) | parent)
        self.followers = np.bincount(below, minlength=len(pair))

    def __iter__(self):
        """(shard, its place in `pairs` and `followers`, in `triples`) of each shard with pairs."""
        for s in np.flatnonzero(np.diff(self.cuts)).tolist():
            yield s, slice(self.cuts[s], self.cuts[s + 1]), slice(self.triple_cuts[s], self.triple_cuts[s + 1])


def grams_sent(bits: int, pair_bits: int, folds: int, fold: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows:
            table = in_order(left)
            known = Known(tokens_of(table, folds, fold), right, bits)
            routes = known.shards(pair_bits)
            number = left.column("block")[0].as_py()
            for s, place, below in routes:
                at, triples = routes.pairs[place], routes.triples[below]
                context = known.context[at]
                begin = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
                rows.append((s, number, packed(context[begin]), packed(known.seen[at][begin]),
                             packed(np.diff(np.append(begin, len(at)))), packed(known.word[at]),
                             packed(known.learnt[at]), packed(routes.followers[place]), packed(known.next[triples]),
                             packed(known.triple_learnt[triples])))
        return table_of(rows, GRAMS)
    return run


def blobs(table: pa.Table, column: str) -> list[np.ndarray]:
    return [unpacked(x) for x in table.column(column).to_pylist()]


def merged(context: np.ndarray, seen: np.ndarray, word: np.ndarray, count: np.ndarray) -> tuple:
    """(a trie level, context, word and learnt count of each distinct entry, sorted, the distinct one of every entry)."""
    order = by_context(context, word)
    c, w = context[order], word[order]
    new = np.concatenate(([True], (c[1:] != c[:-1]) | (w[1:] != w[:-1]))) if len(c) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    total, h, c, w = sums(count[order], begin), seen[order[begin]].astype(np.float64), c[begin], w[begin]
    learnt = np.flatnonzero(total)
    h = h[learnt]
    raw = TrieLevel.build(c[learnt], w[learnt], quantised(total[learnt] / (h + weight(h))))
    return raw, c, w, total, number


def level_of(table: pa.Table) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """The pairs of a shard, `merged`, and the entries of each row."""
    repeat = [n.astype(np.int64) for n in blobs(table, "n")]
    context, seen = (np.concatenate([np.repeat(c, n) for c, n in zip(blobs(table, x), repeat, strict=True)])
                     for x in ("context", "seen"))
    word = blobs(table, "word")
    return *merged(context, seen, np.concatenate(word), np.concatenate(blobs(table, "count")).astype(np.int64)), \
        [len(x) for x in word]


def next_level(table: pa.Table, total: np.ndarray, number: np.ndarray) -> tuple:
    """The triples of a shard, `merged`, and the entries of each row; `total`: counts of the pairs, `number`: pair of each entry."""
    parent = np.repeat(number, np.concatenate(blobs(table, "followers")).astype(np.int64))
    word = blobs(table, "next")
    return *merged((parent + 1).astype(np.uint64), total[parent], np.concatenate(word),
                   np.concatenate(blobs(table, "next_count")).astype(np.int64)), [len(x) for x in word]


def looked_up(raw: bytes, context: np.ndarray, word: np.ndarray, number: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """Codes of the entries of each row."""
    codes = TrieLevel.mapped(raw).look_up(context, word)[number].astype("<u2")
    return np.split(codes, np.cumsum(sizes)[:-1])


def pairs_answered(table: pa.Table, level: tuple | None = None) -> pa.Table:
    raw, context, word, _, number, sizes = level or level_of(table)
    shard = table.column("shard")[0].as_py()
    return table_of([(b, 2, shard, codes.tobytes(), None, None, None) for b, codes in
                     zip(table.column("block").to_pylist(), looked_up(raw, context, word, number, sizes), strict=True)],
                    COUNTS)


def grams_answered(table: pa.Table) -> pa.Table:
    """`pairs_answered` with the triples' codes beside, both packed."""
    level = level_of(table)
    pairs = [np.frombuffer(a, "<u2") for a in pairs_answered(table, level).column("a").to_pylist()]
    raw, context, word, _, number, sizes = next_level(table, level[3], level[4])
    triples = looked_up(raw, context, word, number, sizes)
    shard = table.column("shard")[0].as_py()
    return table_of([(b, 2, shard, packed(p), packed(t), None, None) for b, p, t in
                     zip(table.column("block").to_pylist(), pairs, triples, strict=True)], COUNTS)


def levels_stored(table: pa.Table) -> pa.Table:
    pairs, _, _, total, number, _ = level_of(table)
    triples, *_ = next_level(table, total, number)
    return pa.table({"shard": pa.array([table.column("shard")[0].as_py()] * 2, pa.int32()),
                     "size": pa.array([2, 3], pa.int32()), "level": pa.array([pairs, triples], pa.binary())})


def scorer(bits: int, pair_bits: int, folds: int, fold: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return SCORES.empty_table()
        table = in_order(left)
        tokens = tokens_of(table, folds, fold)
        known = Known(tokens, right, bits)
        base = (known.count + ADD) / (known.n + ADD * (known.v + 1))
        p = base[tokens.words]
        log_base = np.log10(base)[tokens.words]
        answers = {r["shard"]: r for r in right.filter(pc.equal(right.column("level"), 2)).to_pylist()}
        codes, next_codes = (np.full(n, ABSENT, np.uint16) for n in (len(known.keys), len(known.parent)))
        routes = known.shards(pair_bits)
        for s, place, below in routes:
            codes[routes.pairs[place]] = unpacked(answers[s]["a"])
            next_codes[routes.triples[below]] = unpacked(answers[s]["b"])
        # After a known word: its own share of the probability, then what the trie says.
        row = row_of(tokens.offsets)
        after = np.flatnonzero(row[1:] == row[:-1]) + 1
        p[after] *= share(known.count.astype(np.float64))[tokens.words[after - 1]]
        p[known.pair + 1] += probability(codes)[known.of_pair]
        log_pairs = np.log10(p)
        # After a known pair likewise.
        after = np.flatnonzero(known.pair + 2 < tokens.offsets[row[known.pair] + 1])
        p[known.pair[after] + 2] *= share(count_of(codes, known.seen.astype(np.float64)))[known.of_pair[after]]
        p[known.triple + 2] += probability(next_codes)[known.of_triple]
        added = [np.add.reduceat(x, tokens.offsets[:-1]) for x in (log_base, log_pairs, np.log10(p))]
        return pa.Table.from_arrays(
            [table.column("doc_id").cast(pa.int64()), pa.array(tokens.held_out),
             pa.array(np.diff(tokens.offsets), pa.int64()),
             pa.array(group_sums(known.count[tokens.words] > 0, tokens.offsets), pa.int64()),
             pa.array(added[0]), pa.array(added[1]), pa.array(np.full(table.num_rows, known.n), pa.int64()),
             pa.array(added[2])], schema=SCORES)
    return run


class Model:
    """The plan of a corpus: its blocks, the answers on words and the pairs and triples sent to the trie's shards."""

    def __init__(self, docs: DataFrame, folds: int = FOLDS, fold: int = FOLD, block_bytes: int = BLOCK_BYTES):
        self.folds, self.fold = folds, fold
        size = text_bytes(docs) // LEAST_WORD_BYTES
        self.bits, self.pair_bits = shard_bits(size // 6), shard_bits(size)
        self.blocks = blocked(docs, block_bytes)
        bits = self.bits
        sent = self.blocks.groupBy("block").applyInArrow(
            lambda t: tokens_of(in_order(t), folds, fold).sent(bits, t.column("block")[0].as_py()), ddl(WORDS))
        self.words = sent.groupBy("shard").applyInArrow(words_answered(self.bits), ddl(COUNTS))
        self.grams = self.blocks.groupBy("block").cogroup(self.words.groupBy("block")).applyInArrow(
            grams_sent(self.bits, self.pair_bits, folds, fold), ddl(GRAMS))

    def levels(self) -> DataFrame:
        """The trie itself: (shard, size, level), see `TrieLevel`; size 2 for pairs, 3 for triples."""
        return self.grams.groupBy("shard").applyInArrow(levels_stored, "shard int, size int, level binary")

    def scores(self) -> DataFrame:
        """doc_id, held_out, n_tokens, n_known, base_score, score, train_tokens, trigram_score."""
        answers = self.words.unionByName(self.grams.groupBy("shard").applyInArrow(grams_answered, ddl(COUNTS)))
        return self.blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
            scorer(self.bits, self.pair_bits, self.folds, self.fold), ddl(SCORES))


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return Model(spark.read.parquet(f"{sf_dir}/documents.parquet")).scores()
