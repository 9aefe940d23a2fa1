"""Substring dedup with a count-min prefilter.

A window is `size` consecutive words of one document; words covered by a window
whose sequence also starts anywhere else are removed, judged on the input.

Documents are dealt into blocks of bounded size (one shuffle, read three times).
1. Each block sketches its windows: for each of two independent hash rows, the
   sorted buckets with their counts, cut into shards of the bucket range and
   written as gaps. The number of buckets follows the input (eight per window),
   so a sketch is never denser on a larger corpus.
2. One task per shard adds the blocks' sketches into dense saturating counters
   and answers each block with one bit per window it sent: estimated repeated
   or not. A window passes if both rows say so; an estimate is never too low.
3. Blocks send only the windows that passed, once per block with their count
   there, keyed by 128 bits of hash; one task per shard groups them exactly and
   answers which are repeated. A window that fills a third of the corpus is one
   entry per block here.
4. Blocks mark the covered words and return the kept ones.

Defined results: a null or empty text has no words and keeps the empty string;
rows that repeat a doc_id are documents of their own, so identical rows remove
each other's windows; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockboard.llm.common import (BLOCK_BYTES, blocked, group_sums, in_order, objects, one_array, split_words,
                                   text_bytes, window_hashes, word_hashes)

SIZE = 35
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
BUCKETS_PER_WINDOW = 8
SHARD_WINDOWS = 1 << 21
LEAST_WORD_BYTES = 6                    # for sizing only: bytes of a word and its blank, on average
SKETCH = pa.schema([("row", pa.int32()), ("shard", pa.int32()), ("block", pa.int32()), ("gaps", pa.binary())])
BITS = pa.schema([("block", pa.int32()), ("row", pa.int32()), ("shard", pa.int32()), ("bits", pa.binary())])
EXACT = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("h1", pa.binary()), ("h2", pa.binary()),
                   ("first", pa.binary()), ("count", pa.binary())])
FOUND = pa.schema([("block", pa.int32()), ("first", pa.binary())])
KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])


def ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string",
             pa.float64(): "double", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def packed_gaps(sorted_values: np.ndarray, base: int) -> bytes:
    """Gaps of 16 bits, where 65535 means that much and more to come, or of 32 bits if that is shorter."""
    gaps = np.diff(sorted_values, prepend=np.uint64(base)).astype(np.int64)
    more = gaps // 0xFFFF
    if int(more.sum()) > len(gaps):
        return b"\4" + gaps.astype("<u4").tobytes()
    out = np.full(len(gaps) + int(more.sum()), 0xFFFF, "<u2")
    out[np.cumsum(more + 1) - 1] = gaps % 0xFFFF
    return b"\2" + out.tobytes()


def unpacked_gaps(raw: bytes) -> np.ndarray:
    """Positions relative to the shard's first bucket."""
    gaps = np.frombuffer(raw, "<u4" if raw[0] == 4 else "<u2", offset=1)
    places = np.cumsum(gaps, dtype=np.int64)
    return places if raw[0] == 4 else places[gaps != 0xFFFF]


class Layout:
    """Bucket bits and shards of a corpus of about `n` windows."""

    def __init__(self, n: int, per_window: int = BUCKETS_PER_WINDOW):
        self.shard_bits = max(0, (n // SHARD_WINDOWS).bit_length())
        self.bucket_bits = max(8, (per_window * max(1, n)).bit_length(), self.shard_bits)
        self.shards = 1 << self.shard_bits
        self.width = 1 << (self.bucket_bits - self.shard_bits)      # buckets of a shard

    def buckets(self, h: np.ndarray) -> np.ndarray:
        return h >> np.uint64(64 - self.bucket_bits)

    def cuts(self, sorted_buckets: np.ndarray) -> np.ndarray:
        return np.searchsorted(sorted_buckets, np.arange(self.shards + 1, dtype=np.uint64) * np.uint64(self.width))


class Block:
    """Words and window hashes of the documents of a block."""

    def __init__(self, table: pa.Table, size: int):
        self.table = in_order(table)
        self.words, self.offsets, self.vocabulary = split_words(one_array(self.table.column("text")))
        self.n_words = np.diff(self.offsets)
        n = max(0, len(self.words) - size + 1)
        row = np.repeat(np.arange(len(self.n_words)), self.n_words)
        self.start = np.flatnonzero(row[:n] == row[size - 1:]) if n else np.zeros(0, np.int64)
        self.size = size
        distinct = objects(self.vocabulary)
        self.hashes = [window_hashes(word_hashes(distinct, k)[self.words], size, BASES[k])[self.start]
                       for k in (0, 1)] if n else [np.zeros(0, np.uint64)] * 2

    def kept(self, repeated: np.ndarray) -> pa.Table:
        """The words that no repeated window covers, joined by blanks, per document."""
        edge = np.zeros(len(self.words) + 1, np.int64)
        begin = self.start[repeated]
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + self.size, -1)
        keep = np.cumsum(edge[:-1]) == 0
        n_kept = group_sums(keep, self.offsets)
        values = self.vocabulary.take(pa.array(self.words[keep]))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n_kept))), pa.int32()), values)
        return pa.Table.from_arrays(
            [self.table.column("doc_id").cast(pa.int64()), pa.array(self.n_words, pa.int64()),
             pa.array(self.n_words - n_kept, pa.int64()), pc.binary_join(lists, " ")], schema=KEPT)


def sketcher(layout: Layout, size: int):
    def run(table: pa.Table) -> pa.Table:
        block, rows = Block(table, size), []
        number = table.column("block")[0].as_py()
        for k in (0, 1):
            buckets = np.sort(layout.buckets(block.hashes[k]))
            cuts = layout.cuts(buckets)
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                rows.append((k, s, number, packed_gaps(buckets[cuts[s]:cuts[s + 1]], s * layout.width)))
        return pa.Table.from_arrays(
            [pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [()] * 4, SKETCH, strict=True)],
            schema=SKETCH)
    return run


def merger(layout: Layout):
    def run(table: pa.Table) -> pa.Table:
        counters = np.zeros(layout.width, np.uint8)
        gaps = table.column("gaps")
        for raw in gaps:                                    # count-min: estimates add up over the blocks
            at = unpacked_gaps(raw.as_buffer().to_pybytes())
            new = np.concatenate(([True], at[1:] != at[:-1]))
            once, begin = at[new], np.flatnonzero(new)
            count = np.diff(begin, append=len(at))
            counters[once] = np.minimum(counters[once].astype(np.int64) + count, 255)
        bits = [np.packbits(counters[unpacked_gaps(raw.as_buffer().to_pybytes())] >= 2).tobytes() for raw in gaps]
        return pa.Table.from_arrays([table.column("block"), table.column("row"), table.column("shard"),
                                     pa.array(bits, pa.binary())], schema=BITS)
    return run


def passed(block: Block, layout: Layout, replies: pa.Table) -> np.ndarray:
    """Windows that both rows estimate as repeated."""
    out = np.ones(len(block.start), bool)
    answers = {(r["row"], r["shard"]): r["bits"] for r in replies.select(["row", "shard", "bits"]).to_pylist()}
    for k in (0, 1):
        buckets = layout.buckets(block.hashes[k])
        order = np.argsort(buckets, kind="stable")
        cuts = layout.cuts(buckets[order])
        flags = np.zeros(len(order), bool)
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            n = int(cuts[s + 1] - cuts[s])
            flags[cuts[s]:cuts[s + 1]] = np.unpackbits(np.frombuffer(answers[k, s], np.uint8), count=n)
        estimated = np.zeros(len(order), bool)
        estimated[order] = flags
        out &= estimated
    return out


def pair_groups(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by hash pair, where each distinct pair begins in that order)."""
    order = np.lexsort((h2, h1))
    a, b = h1[order], h2[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
    return order, np.flatnonzero(new)


def candidates(layout: Layout, size: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows:
            block = Block(left, size)
            at = np.flatnonzero(passed(block, layout, right))
            h1, h2 = block.hashes[0][at], block.hashes[1][at]
            order, begin = pair_groups(h1, h2)
            count = np.minimum(np.diff(begin, append=len(order)), 2).astype(np.uint8)
            first = at[np.minimum.reduceat(order, begin)] if len(begin) else at
            a, b = h1[order][begin], h2[order][begin]
            cuts = np.searchsorted(layout.buckets(a), np.arange(layout.shards + 1, dtype=np.uint64)
                                   * np.uint64(layout.width))
            number = left.column("block")[0].as_py()
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                one = slice(cuts[s], cuts[s + 1])
                rows.append((s, number, a[one].tobytes(), b[one].tobytes(), first[one].astype("<u4").tobytes(),
                             count[one].tobytes()))
        return pa.Table.from_arrays(
            [pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [()] * 6, EXACT, strict=True)],
            schema=EXACT)
    return run


def exactly(table: pa.Table) -> pa.Table:
    """Which of the windows of a shard occur twice or more, for each block."""
    blob = {c: table.column(c).to_pylist() for c in ("h1", "h2", "first", "count")}
    sizes = np.array([len(x) for x in blob["count"]])
    h1, h2 = (np.frombuffer(b"".join(blob[c]), np.uint64) for c in ("h1", "h2"))
    order, begin = pair_groups(h1, h2)
    count = np.frombuffer(b"".join(blob["count"]), np.uint8).astype(np.int64)[order]
    total = np.add.reduceat(count, begin) if len(begin) else np.zeros(0, np.int64)
    repeated = np.zeros(len(order), bool)
    repeated[order] = np.repeat(total >= 2, np.diff(begin, append=len(order)))
    ends = np.cumsum(sizes)
    first = [np.frombuffer(f, "<u4")[repeated[e - n:e]].tobytes()
             for f, e, n in zip(blob["first"], ends.tolist(), sizes.tolist(), strict=True)]
    return pa.Table.from_arrays([table.column("block"), pa.array(first, pa.binary())], schema=FOUND)


def remover(size: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return KEPT.empty_table()
        block = Block(left, size)
        first = np.frombuffer(b"".join(right.column("first").to_pylist()), "<u4")
        h1, h2 = block.hashes
        known = first[np.argsort(h1[first], kind="stable")]
        repeated = np.zeros(len(h1), bool)
        if len(known):
            at = np.minimum(np.searchsorted(h1[known], h1), len(known) - 1)
            repeated = (h1[known][at] == h1) & (h2[known][at] == h2)
            repeated[first] = True
        return block.kept(repeated)
    return run


def remove_repeats(docs: DataFrame, size: int = SIZE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, text (the kept words joined by one blank)."""
    layout = Layout(text_bytes(docs) // LEAST_WORD_BYTES)
    blocks = blocked(docs, block_bytes)
    bits = (blocks.groupBy("block").applyInArrow(sketcher(layout, size), ddl(SKETCH))
            .groupBy("row", "shard").applyInArrow(merger(layout), ddl(BITS)))
    found = (blocks.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(candidates(layout, size), ddl(EXACT))
             .groupBy("shard").applyInArrow(exactly, ddl(FOUND)))
    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(remover(size), ddl(KEPT))


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    kept = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


#: Rows told apart by their number, windows by the digest of their words.
ORACLE = r"""
WITH words AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS MATERIALIZED (
  SELECT r, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35)),
repeated AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
starts AS (SELECT r, list(i) AS s FROM windows WHERE h IN (SELECT h FROM repeated) GROUP BY r),
flags AS (SELECT r, unnest(s) AS i FROM starts),
covered AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM flags),
spread AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
         FROM spread ANTI JOIN covered USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (r)
"""
