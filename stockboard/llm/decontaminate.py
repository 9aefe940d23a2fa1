"""Benchmark decontamination by training suffix arrays.

Each block of training documents gets a word-level suffix array (prefix
doubling on the ties that packed first words leave; sorted to the depth of the
longest item). Every suffix of every benchmark item is then binary-searched in
it, all suffixes at once, word by word: the interval of a suffix at depth 13
(or the whole length of a shorter item) holds all places where that window
occurs. Consecutive windows of one item on one diagonal join to longest
verbatim matches with their locations. Blocks are the shards: they are built
where the documents are scanned, nothing but the benchmark travels.

The benchmark is a stated query set, held in slices of at most `SLICE_BYTES`
of text (measured first); with several slices a block of documents is searched
for one after the other, each with its own suffixes in memory.

Words: A-Z lower-cased, runs of digits, letters a-z and non-ASCII bytes.
A window is `window` consecutive words of an item; an item of fewer words, but
not none, is one window. Defined results: a null or empty text has no words
and no hits; null or empty items have no windows; repeated items are items of
their own; item_id is reported as a string, null as the empty one; an empty
table gives no rows; an empty benchmark gives rows without hits; other columns
are ignored. Rows that repeat a doc_id are documents of their own, as are rows without one.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockboard.llm.common import ALNUM_LOWER, free_name, id_and_text, mapped, one_array, slices, split_words

WINDOW = 13
SLICE_BYTES = 2 << 20
BLOCK_BYTES = 6 << 20
MATCHES = "doc_id long, n_words long, matches array<struct<item_id string,item_word int,start int,length int>>"
MATCH_TYPE = pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int32()),
                                 ("start", pa.int32()), ("length", pa.int32())]))


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Positions of `tokens` (values from 0 up) sorted by their first `depth` tokens."""
    n = len(tokens)
    bits = max(1, int(tokens.max(initial=0) + 1).bit_length())
    span = max(1, 62 // bits)
    padded = np.concatenate((tokens.astype(np.int64) + 1, np.zeros(span, np.int64)))
    key = np.zeros(n, np.int64)
    for k in range(span):
        key = (key << bits) | padded[k:n + k]
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    sorted_key = key[order]
    new = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1])) if n else np.zeros(0, bool)
    begins = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = begins
    reached = span
    while reached < depth:
        last = np.append(new[1:], True) if n else new
        tied = np.flatnonzero(~(new & last))       # slots of groups of two and more
        if not len(tied):
            break
        at = order[tied]
        after = at + reached
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.lexsort((second, rank[at]))
        at, first, second = at[by], rank[at][by], second[by]
        order[tied] = at
        fresh = np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
        new[tied] = fresh
        rank[at] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))]
        reached *= 2
    return order


def bounds(tokens: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int,
           word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Narrows each interval of the suffix array to suffixes with `word` at `depth`."""
    def first_at_least(target):
        a, b = low.copy(), high.copy()
        while True:
            open_ = a < b
            if not open_.any():
                return a
            mid = (a + b) >> 1
            at = order[np.minimum(mid, len(order) - 1)] + depth
            less = np.where(at < len(tokens), tokens[np.minimum(at, len(tokens) - 1)], -1) < target
            a, b = np.where(open_ & less, mid + 1, a), np.where(open_ & ~less, mid, b)
    return first_at_least(word), first_at_least(word + 1)


class Queries:
    """The suffixes of a slice of the benchmark, as words."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        words, offsets, self.vocabulary = split_words(mapped(one_array(pa.array(texts, pa.string())), ALNUM_LOWER))
        self.words, self.ids = words.astype(np.int64), ids
        n = np.diff(offsets)
        size = np.minimum(n, window)
        starts = np.where(n > 0, n - size + 1, 0)                         # windows of each item
        self.item = np.repeat(np.arange(len(ids)), starts)
        self.offset = np.arange(len(self.item)) - np.repeat(np.cumsum(starts) - starts, starts)
        self.begin = offsets[:-1][self.item] + self.offset
        self.size = size[self.item]
        self.depth = int(size.max(initial=1))

    def search(self, texts: pa.StringArray) -> tuple[np.ndarray, ...]:
        """Words of each text, and (text, query, word position) of every occurrence of every window."""
        words, offsets, vocabulary = split_words(mapped(texts, ALNUM_LOWER))
        n_words, none = np.diff(offsets), np.zeros(0, np.int64)
        known = np.full(len(self.vocabulary), -1, np.int64)
        if len(vocabulary) and len(self.vocabulary):
            where = pa.compute.index_in(self.vocabulary, value_set=vocabulary)
            known = pa.compute.fill_null(where, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if not (known >= 0).any():
            return n_words, none, none, none
        # Texts end in the token 0, which no query has.
        row = np.repeat(np.arange(len(n_words)), n_words)
        tokens = np.zeros(len(words) + len(n_words), np.int64)
        places = np.arange(len(words)) + row
        tokens[places] = words.astype(np.int64) + 1
        order = suffix_array(tokens, self.depth)
        first = tokens[order]
        query = known[self.words] + 1                                     # 0: unknown here
        alive = np.flatnonzero(query[self.begin] > 0)
        low = np.searchsorted(first, query[self.begin[alive]], side="left")
        high = np.searchsorted(first, query[self.begin[alive]], side="right")
        found_q, found_low, found_high = [], [], []
        for depth in range(1, self.depth + 1):
            done = self.size[alive] == depth
            found_q.append(alive[done]), found_low.append(low[done]), found_high.append(high[done])
            alive, low, high = alive[~done], low[~done], high[~done]
            if not len(alive):
                break
            word = query[self.begin[alive] + depth]
            low, high = bounds(tokens, order, low, high, depth, word)
            going = (low < high) & (word > 0)
            alive, low, high = alive[going], low[going], high[going]
        q, low, high = np.concatenate(found_q), np.concatenate(found_low), np.concatenate(found_high)
        count = high - low
        query_of = np.repeat(q, count)
        slot = np.arange(len(query_of)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        ends = np.cumsum(n_words + 1)
        place = order[slot]
        text = np.searchsorted(ends, place, side="right")
        return n_words, text, query_of, place - (ends - n_words - 1)[text]

    def matches(self, texts: pa.StringArray) -> tuple[np.ndarray, list[list[dict]]]:
        """Longest verbatim matches of each text: windows that follow each other on a diagonal, joined."""
        n_words, text, q, start = self.search(texts)
        out: list[list[dict]] = [[] for _ in range(len(n_words))]
        if len(text):
            item, diagonal = self.item[q], start - self.offset[q]
            by = np.lexsort((start, diagonal, item, text))
            text, q, start, item, diagonal = text[by], q[by], start[by], item[by], diagonal[by]
            new = np.concatenate(([True], (text[1:] != text[:-1]) | (item[1:] != item[:-1])
                                  | (diagonal[1:] != diagonal[:-1]) | (start[1:] != start[:-1] + 1)))
            begin = np.flatnonzero(new)
            last = np.append(begin[1:], len(text)) - 1
            length = start[last] - start[begin] + self.size[q[last]]
            for t, i, o, s, n in zip(text[begin].tolist(), item[begin].tolist(), self.offset[q[begin]].tolist(),
                                     start[begin].tolist(), length.tolist(), strict=True):
                out[t].append({"item_id": self.ids[i], "item_word": o, "start": s, "length": n})
        return n_words, out


def matcher(parts: list[tuple[list[str], list[str]]], window: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = Queries(*parts[0], window) if len(parts) == 1 else None
        for block in slices(batches, block_bytes):
            texts, found = one_array(block.column("text")), None
            for ids, items in parts:
                n_words, more = (only or Queries(ids, items, window)).matches(texts)
                found = more if found is None else [a + b for a, b in zip(found, more, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id").cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(found, MATCH_TYPE)],
                ["doc_id", "n_words", "matches"])
    return run


def benchmark_slices(benchmark: DataFrame, slice_bytes: int) -> Iterator[tuple[list[str], list[str]]]:
    """The items in slices of about `slice_bytes` of text."""
    items = benchmark.select(F.coalesce(benchmark["item_id"].cast("string"), F.lit("")).alias("item_id"),
                             F.coalesce(benchmark["text"], F.lit("")).alias("text"))
    n = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // slice_bytes))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        rows = part.collect()
        yield [r.item_id for r in rows], [r.text for r in rows]


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slice_bytes: int = SLICE_BYTES,
            block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, matches (item_id, item_word, start, length; in words)."""
    parts = list(benchmark_slices(benchmark, slice_bytes))
    return id_and_text(docs).mapInArrow(matcher(parts, window, block_bytes), MATCHES)


def n_covered(matches: str) -> Column:
    """Words inside any of the matches."""
    spans = F.sort_array(F.transform(matches, lambda m: F.struct(
        m["start"].alias("start"), (m["start"] + m["length"]).alias("end"))))
    return F.aggregate(
        spans, F.struct(F.lit(0).alias("words"), F.lit(0).alias("reach")),
        lambda s, m: F.struct(
            (s["words"] + F.greatest(F.lit(0), m["end"] - F.greatest(m["start"], s["reach"]))).alias("words"),
            F.greatest(s["reach"], m["end"]).alias("reach")),
        lambda s: s["words"].cast("long"))


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, longest_match, contaminated (a twentieth of the words hit).
    Column expressions over the matches: a task that searches needs no second Python worker."""
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    longest = F.array_max(F.transform("matches", lambda m: m["length"]))
    found = matches(docs, benchmark, **options).select(
        "doc_id", "n_words", n_covered("matches").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        F.coalesce(longest, F.lit(0)).cast("long").alias("longest_match"))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows whose text is not contaminated, with all their columns, with or without an id. What
    a text is called does not matter: rows are found again by 64 bits of hash of the text."""
    text, gone = free_name(docs, "text"), free_name(docs, "gone")
    named = F.xxhash64(docs["text"])
    texts = contamination(docs.select(named.alias("doc_id"), docs["text"]), benchmark, **options) \
        .where("contaminated").select(F.col("doc_id").alias(gone)).distinct()
    return docs.withColumn(text, named).join(texts, F.col(text) == F.col(gone), "left_anti").drop(text)


def op5_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                         spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Rows told apart by their number; every window of both sides is written out.
ORACLE = r"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS MATERIALIZED (
  SELECT row_number() OVER () AS m, item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS MATERIALIZED (
  SELECT m, item_id, i AS j, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS t
  FROM (SELECT m, item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT k FROM item_windows),
doc_windows AS (
  SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS t
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, lengths WHERE len(w) >= k)),
hits AS MATERIALIZED (SELECT r, v.k AS k, i, j, m, item_id FROM doc_windows d JOIN item_windows v ON d.t = v.t AND d.k = v.k),
runs AS (SELECT r, max(i) - min(i) + max(k) AS length
         FROM (SELECT *, i - row_number() OVER (PARTITION BY r, m, i - j ORDER BY i) AS run FROM hits)
         GROUP BY r, m, i - j, run),
longest AS (SELECT r, max(length) AS length FROM runs GROUP BY r),
words AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(found.n, 0) AS BIGINT) AS n_items, sha256(coalesce(found.ids, '')) AS items_sha256,
       CAST(coalesce(length, 0) AS BIGINT) AS longest_match, coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r) LEFT JOIN longest USING (r)
"""
