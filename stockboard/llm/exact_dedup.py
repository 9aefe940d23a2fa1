"""Exact dedup by Patricia-trie owners.

Every text (A-Z lower-cased, null as empty) is inserted as a full byte string
into a compressed radix trie; the terminal node of a text holds the identifier
of its owner (the smallest or largest id) and the number of copies.

1. Each task inserts its batches into small tries: copies that meet there
   become one row, so a text that a third of all rows share leaves each task
   once per batch.
2. Rows go to partitions by length and SHA-256 of the text. A text that was
   already repeated within a batch gets a salt by task, so that the copies of a
   hot text spread over several partitions. One trie per partition; above
   `memory_bytes` the heaviest subtree is spilled to an unnamed temporary file
   of the task (as a Spark sort would) and finished on its own afterwards.
3. Terminals (length, SHA-256, owner, copies) of all salts are combined by a
   partial aggregate, then joined to the documents on the SHA-256.
   Two texts in one trie are compared in full; between salts of one text,
   identity rests on length and SHA-256.

Defined results: null text equals the empty text; a null doc_id owns a text
only if no copy has an id; rows that repeat a doc_id with the same text are all
marked alike; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockboard.llm.common import LOWER, UPPER, free_name, id_and_text

SALTS = 16
MEMORY_BYTES = 96 << 20
OUT_BYTES = 8 << 20
MEMBERS = "doc_id long, n_bytes long, sha binary"
ENTRIES = "n_bytes long, sha binary, salt int, text binary, owner long, copies long"
TERMINALS = "n_bytes long, sha binary, owner long, copies long"


def better(a: int | None, b: int | None, largest: bool) -> int | None:
    if a is None or b is None:
        return b if a is None else a
    return max(a, b) if largest else min(a, b)


class Node:
    __slots__ = ("label", "children", "value", "spilled")

    def __init__(self, label: bytes):
        self.label, self.children, self.value, self.spilled = label, {}, None, None


def shared(a: bytes, b: bytes, at: int) -> int:
    """Length of the longest prefix of `a` that `b` has at position `at`."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[at:at + mid] else (low, mid - 1)
    return low


def stored(file) -> Iterator[tuple]:
    """The entries of a spill file, from its beginning."""
    file.seek(0)
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


class RadixTrie:
    """Byte strings with (digest, owner, copies) at their terminals."""

    def __init__(self, largest: bool, memory_bytes: int):
        self.root, self.largest, self.limit, self.used = Node(b""), largest, memory_bytes, 0
        self.spills: list = []

    def insert(self, key: bytes, digest: bytes, owner: int | None, copies: int) -> None:
        node, at = self.root, 0
        while True:
            if node.spilled is not None:
                pickle.dump((key[at:], len(key), digest, owner, copies), node.spilled)
                return
            if at == len(key):
                break
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.used += len(child.label) + 200
                node, at = child, len(key)
            elif key.startswith(child.label, at):
                node, at = child, at + len(child.label)
            else:
                k = shared(child.label, key, at)
                upper = Node(child.label[:k])
                child.label = child.label[k:]
                upper.children[child.label[0]] = child
                node.children[key[at]] = upper
                self.used += 200
                node, at = upper, at + k
        if node.value is None:
            node.value = [len(key), digest, owner, copies]
        else:
            value = node.value
            value[2], value[3] = better(value[2], owner, self.largest), value[3] + copies
        if self.used > self.limit:
            self.spill()

    def entries(self, top: Node) -> Iterator[tuple[bytes, list]]:
        """Terminals below a node, with their bytes from that node on."""
        stack = [(top, b"")]
        while stack:
            node, path = stack.pop()
            if node.value is not None:
                yield path, node.value
            stack += [(c, path + c.label) for c in node.children.values()]

    def weight(self, top: Node) -> int:
        total, stack = 0, [top]
        while stack:
            node = stack.pop()
            total += len(node.label) + 200
            stack += node.children.values()
        return total

    def spill(self) -> None:
        """Writes out the heaviest subtree below the first branching; later keys follow it to its file."""
        node = self.root
        while True:
            open_children = [c for c in node.children.values() if c.spilled is None]
            if len(open_children) != 1 or node.value is not None:
                break
            node = open_children[0]
        heaviest = max(open_children, key=self.weight, default=None)
        if heaviest is None:
            return
        self.used -= self.weight(heaviest)
        file = tempfile.TemporaryFile()  # unnamed: it is gone with the task
        stack = [(heaviest, b"")]
        while stack:
            node, path = stack.pop()
            if node.value is not None:
                pickle.dump((path, *node.value), file)
            if node.spilled is not None:         # spilled before: its texts move to the larger subtree's file
                for rest, *value in stored(node.spilled):
                    pickle.dump((path + rest, *value), file)
                self.spills.remove(node.spilled)
                node.spilled.close()
            stack += [(c, path + c.label) for c in node.children.values()]
        heaviest.children, heaviest.value, heaviest.spilled = {}, None, file
        self.spills.append(file)

    def drain(self) -> Iterator[tuple[int, bytes, int | None, int]]:
        """(length, digest, owner, copies) of every text, spilled subtrees included."""
        for _, (n, digest, owner, copies) in self.entries(self.root):
            yield n, digest, owner, copies
        self.root = Node(b"")
        for file in self.spills:
            below = RadixTrie(self.largest, self.limit)
            lengths = {}
            for rest, n, digest, owner, copies in stored(file):
                lengths[digest] = n
                below.insert(rest, digest, owner, copies)
            file.close()
            for _, digest, owner, copies in below.drain():
                yield lengths[digest], digest, owner, copies


def normal(text: str | None) -> bytes:
    return (text or "").encode().translate(LOWER)


def members_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [normal(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array([len(k) for k in keys], pa.int64()),
             pa.array([hashlib.sha256(k).digest() for k in keys], pa.binary())], ["doc_id", "n_bytes", "sha"])


def batch_entries(largest: bool, salts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = 1 + TaskContext.get().partitionId() % salts
        for batch in batches:
            trie, rows = RadixTrie(largest, 1 << 62), []
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                trie.insert(normal(t), b"", i, 1)
            for key, (n, _, owner, copies) in trie.entries(trie.root):
                rows.append((n, hashlib.sha256(key).digest(), salt if copies > 1 else 0, key, owner, copies))
            names = ["n_bytes", "sha", "salt", "text", "owner", "copies"]
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
    return run


def partition_terminals(largest: bool, memory_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = RadixTrie(largest, memory_bytes)
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("text", "sha", "owner", "copies")), strict=True):
                trie.insert(*row)
        out = []
        for row in trie.drain():
            out.append(row)
            if len(out) == 50_000:
                yield terminal_batch(out)
                out = []
        yield terminal_batch(out)
    return run


def terminal_batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                      ["n_bytes", "sha", "owner", "copies"])


def owners(docs: DataFrame, keep: str = "largest", salts: int = SALTS,
           memory_bytes: int = MEMORY_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    largest = {"largest": True, "smallest": False}[keep]
    d = id_and_text(docs)
    best = F.max if largest else F.min
    terminals = (d.mapInArrow(batch_entries(largest, salts), ENTRIES)
                 .repartition("n_bytes", "sha", "salt")
                 .mapInArrow(partition_terminals(largest, memory_bytes), TERMINALS)
                 .groupBy("n_bytes", "sha").agg(best("owner").alias("keep_id"), F.sum("copies").alias("group_size"))
                 # Not the grouping column itself: the join deals both sides anew,
                 # and Spark can split the partition of a hot text's documents.
                 .select(F.substring("sha", 1, 32).alias("__sha"), "keep_id", "group_size"))
    m = d.mapInArrow(members_of, MEMBERS)
    return m.join(terminals, F.col("sha") == F.col("__sha"), "left").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """One row of each text, with all its columns: the one with the largest (or smallest) id, one without
    an id only where no copy has one. Rows that repeat an id with different texts are told apart
    by their texts; of rows that repeat id and text alike, any one stays."""
    sha, of, owner, rows = (free_name(docs, x) for x in ("sha", "of", "owner", "rows"))
    best = F.max if keep == "largest" else F.min
    texts = owners(docs, keep).groupBy("text_sha256").agg(
        F.max("text_sha256").alias(of), best("keep_id").alias(owner), F.sum(F.col("kept").cast("int")).alias(rows))
    normal_text = F.translate(F.coalesce(docs["text"], F.lit("")), UPPER, UPPER.lower())
    kept = docs.withColumn(sha, F.sha2(normal_text, 256)).join(texts.select(of, owner, rows), F.col(sha) == F.col(of)) \
        .where(docs["doc_id"].eqNullSafe(F.col(owner)))
    once, again = kept.where(F.col(rows) == 1), kept.where(F.col(rows) > 1).dropDuplicates([sha])
    return once.unionByName(again).drop(sha, of, owner, rows)


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return owners(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
