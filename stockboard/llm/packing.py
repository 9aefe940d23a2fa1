"""Bounded-space online best-fit packing.

1. Documents become token ids followed by an end id. Distinct words of a block
   are encoded once and gathered back as arrays; only longer documents are cut
   into pieces of `capacity` tokens. Full pieces are sequences of their own.
2. Pieces are dealt by a hash to packers of about `DOCS_PER_PACKER` documents
   and arrive in hash order. A packer is online: it keeps at most `open_bins`
   open sequences, found through a bitset keyed by free space. A piece goes to
   the fullest sequence that still takes it (lowest set bit from its length
   up); if none does, a new one opens, and above the bound the fullest open one
   closes first. A piece's place is known when it arrives, so rows stream out.

Words of Latin letters are merged by the vocabulary's ranks, all of a block in
one call; other words by the tokenizer itself, whose call costs about 10 us a
word (1 MB of text a second). Both give the tokenizer's ids, see the tests.

Defined results: null or empty texts are the end id alone; rows that repeat a
doc_id are packed one by one; an empty table gives no rows; other columns are
ignored.
"""
from __future__ import annotations

import functools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockboard.llm.common import id_and_text, objects, one_array, slices, split_words

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 1
OPEN_BINS = 2048
DOCS_PER_PACKER = 50_000
BLOCK_BYTES = 4 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
#: Words of Latin letters that are the same under NFC, with ASCII marks behind them.
MARKS = r"[!-/:-@\[-`{-~]"
PLAIN = f"^[A-Za-zÀ-ÖØ-öø-įı-ɏ]*{MARKS}*$"


def vocabulary_path(name: str) -> str:
    """A path as given, or the place of an installed public vocabulary of that name."""
    if os.path.isabs(name):
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


class WordCodec:
    """Token ids of single words (text between ASCII white space)."""

    def __init__(self, name: str):
        from tokenizers import Tokenizer
        path = vocabulary_path(name)
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as spec:
            self.merges, self.ends = self.merger(json.load(spec))

    @staticmethod
    def merger(spec: dict):
        """An encoding by rank of pieces that end in NUL, and which of its ids end a
        piece; nothing if the ids of this vocabulary aren't the order of its merges."""
        import tiktoken
        ids, end = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix")
        joined = [ids.get("".join(m.split() if isinstance(m, str) else m)) for m in spec["model"]["merges"]]
        if not end or None in joined or joined != sorted(joined):
            return None, None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
        special = {t["content"] for t in spec["added_tokens"]}
        ranks, ends = {}, np.zeros(max(ids.values()) + 2, bool)
        for word, i in ids.items():
            raw = b"" if word in special else bytes(byte_of[c] for c in word.removesuffix(end))
            if raw and 0 not in raw:                        # NUL stands for the word's end
                ranks[raw + b"\0" * word.endswith(end)] = i
                ends[i] = word.endswith(end)
        ranks[b"\0"] = len(ends) - 1
        return tiktoken.Encoding(spec["model"]["type"], pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks,
                                 special_tokens={}), ends

    def words(self, vocabulary: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, number of ids of each word)."""
        plain = pc.match_substring_regex(vocabulary, PLAIN).to_numpy(zero_copy_only=False) if self.merges \
            else np.zeros(len(vocabulary), bool)
        parts, sizes = [np.zeros(0, np.uint32)], np.zeros(len(vocabulary), np.int64)
        if plain.any():
            low = pc.utf8_lower(vocabulary.filter(pa.array(plain)))
            cut = pc.replace_substring_regex(low, f"({MARKS}+)$", "\0\\1")       # letters, then marks
            cut = pc.replace_substring_regex(cut, "^\0", "")
            pieces_ = pc.add(pc.count_substring(cut, "\0"), 1).to_numpy()
            ids = self.merges.encode_to_numpy("\0".join(objects(cut).tolist()) + "\0", disallowed_special=())
            last = np.flatnonzero(self.ends[ids])[np.cumsum(pieces_) - 1]
            sizes[plain] = np.diff(last, prepend=-1)
            parts.append(ids)
        if not plain.all():
            rest = self.whole.encode_batch(objects(vocabulary)[~plain].tolist(), add_special_tokens=False)
            own = [x.ids for x in rest]
            sizes[~plain] = [len(x) for x in own]
            parts.append(np.array([i for x in own for i in x], np.uint32))
        # The plain words' ids come first, then the others': back to the order of the words.
        order = np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))
        begins = np.empty(len(order), np.int64)
        begins[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate(parts), np.stack((begins, sizes))

    def documents(self, texts: pa.StringArray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, each with the end id; where each text begins and the end)."""
        words, offsets, vocabulary = split_words(texts)
        pool, (begins, sizes) = self.words(vocabulary)
        begins, sizes = np.append(begins, len(pool)).astype(np.int32), np.append(sizes, 1)
        pool = np.append(pool, np.uint32(end_id))
        words = np.insert(words, offsets[1:], len(vocabulary))        # the end id as a last word
        count = sizes[words]
        total = np.concatenate(([0], np.cumsum(count)))
        at = np.arange(total[-1], dtype=np.int32)
        at += np.repeat((begins[words] - total[:-1]).astype(np.int32), count)
        return pool[at], total[offsets + np.arange(len(offsets))]


@functools.lru_cache(maxsize=2)
def codec(name: str) -> WordCodec:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordCodec(name)


def pieces_of(vocabulary: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = codec(vocabulary)
        for block in slices(batches, BLOCK_BYTES):
            ids, offsets = words.documents(one_array(block.column("text")), end_id)
            size = np.diff(offsets)
            per_doc = -(-size // capacity)
            doc = np.repeat(np.arange(len(size)), per_doc)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
            start = piece * capacity
            length = np.minimum(size[doc] - start, capacity)
            begin = offsets[doc] + start
            raw = memoryview(ids.astype("<u4").tobytes())
            parts = [raw[4 * b:4 * (b + n)] for b, n in zip(begin.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id").cast(pa.int64()).take(pa.array(doc)), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                 pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                 pa.array([bytes(p) if with_ids else None for p in parts], pa.binary())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
    return run


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID,
           with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, ids (little-endian, if asked for)."""
    return id_and_text(docs).mapInArrow(pieces_of(vocabulary, capacity, end_id, with_ids), PIECES)


class BestFit:
    """Online best fit with a bounded number of open bins; a bin is (number, free space)."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most = capacity, open_bins
        self.free = 0                                       # bit f: an open bin has f free places
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.count = self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of that length."""
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            number = self.take(space)
        else:
            number, space = self.made, self.capacity
            self.made += 1
        left = space - length
        if left:
            if self.count == self.most:                     # the fullest closes first
                fullest = (self.free & -self.free).bit_length() - 1
                if fullest <= left:
                    self.take(fullest)
                else:
                    return number, self.capacity - space    # this one is the fullest
            self.bins[left].append(number)
            self.free |= 1 << left
            self.count += 1
        return number, self.capacity - space

    def take(self, space: int) -> int:
        number = self.bins[space].pop()
        if not self.bins[space]:
            self.free ^= 1 << space
        self.count -= 1
        return number


def placer(capacity: int, open_bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, first = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            places = [packer.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([first + b for b, _ in places], pa.int64()),
                 pa.array([o for _, o in places], pa.int64())], [*batch.schema.names, "sequence_id", "offset"])
    return run


def pack(parts: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, packers: int = 1) -> DataFrame:
    """The rows of `pieces` with sequence_id and offset."""
    dealt = parts.withColumn("__deal", F.xxhash64("doc_id", "piece"))
    ordered = dealt.repartition(packers, "__deal").sortWithinPartitions("__deal", "doc_id", "piece", "ids_crc32")
    return ordered.drop("__deal").mapInArrow(placer(capacity, open_bins), PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID,
                   open_bins: int = OPEN_BINS, docs_per_packer: int = DOCS_PER_PACKER,
                   with_ids: bool = False) -> DataFrame:
    packers = max(1, -(-docs.count() // docs_per_packer))
    return pack(pieces(docs, vocabulary, capacity, end_id, with_ids), capacity, open_bins, packers)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the sequences themselves, from pieces packed with their ids."""
    rows = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.unhex(F.array_join(F.transform(rows, lambda x: F.hex(x["ids"])), "")).alias("ids"))


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")
