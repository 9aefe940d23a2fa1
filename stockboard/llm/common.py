"""Helpers shared by the corpus operators: reading, blocks, words as arrays.

Words are split by Arrow kernels and handled as integer arrays; no operator
walks a corpus word by word in Python. A *block* is a bounded amount of text
(`BLOCK_BYTES`; one longer text makes a block of its own), so the memory of a
task does not grow with the input.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockboard.session import ensure_checkpoint_dir

BLOCK_BYTES = 8 << 20
#: Fixed: bytes that end a word besides letters, digits and non-ASCII bytes; A-Z go to a-z.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ALNUM_LOWER = bytes(c if (48 <= c <= 57 or 97 <= c <= 122 or c >= 128) else 32 for c in LOWER)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HASH_KEYS = ("stockboard-words", "words-stockboard")   # 16 bytes each: keys of the two word-hash lanes


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder for a written table."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def free_name(docs: DataFrame, name: str) -> str:
    """A name for a column beside those of `docs`, whatever they are called."""
    taken = {c.lower() for c in docs.columns}
    name = f"__{name}"
    while name in taken:
        name += "_"
    return name


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text only; other columns, whatever their names, are left out."""
    return docs.select(docs["doc_id"], docs["text"])


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def blocked(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, doc_id, text): documents dealt by a hash of id and whole text into
    blocks of about `block_bytes`, all rows of a block in one partition; rows equal
    in both share a block, since each pass has to deal them alike. The
    number of blocks follows the total size of the texts. There are no fewer
    partitions than Spark would choose, so that operators on groups of a block
    take them as they are; an equal plan elsewhere in a query reuses the shuffle."""
    n = max(1, -(-text_bytes(docs) // block_bytes))
    d = id_and_text(docs)
    block = F.pmod(F.xxhash64(d["doc_id"], d["text"]), F.lit(n)).cast("int")
    return d.select(block.alias("block"), d["doc_id"], F.coalesce(d["text"], F.lit("")).alias("text")) \
        .repartition(max(n, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "block")


def in_order(table: pa.Table) -> pa.Table:
    """The rows of a block in an order that does not depend on the shuffle."""
    ids = table.column("doc_id")
    by = [("doc_id", "ascending")]
    if pc.count_distinct(ids, mode="all").as_py() < len(ids):
        by.append(("text", "ascending"))
    return table.sort_by(by).combine_chunks()


def slices(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into runs of rows with at most `limit` bytes of text (one row at least)."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False),
                         dtype=np.int64)
        begin = 0
        while begin < len(size):
            floor = size[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(size, floor + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def one_array(column) -> pa.StringArray:
    """A text column as one array that starts at offset 0, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = pc.fill_null(column, "")
    first = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4) \
        if len(column) else np.zeros(1, np.int32)
    data = column.buffers()[2]
    data = data.slice(int(first[0]), int(first[-1] - first[0])) if data is not None else pa.py_buffer(b"")
    return pa.StringArray.from_buffers(len(column), pa.py_buffer((first - first[0]).astype(np.int32).tobytes()), data)


def mapped(texts: pa.StringArray, table: bytes) -> pa.StringArray:
    """Every byte of the texts replaced by the table, in one call (ASCII to ASCII only)."""
    return pa.StringArray.from_buffers(len(texts), texts.buffers()[1],
                                       pa.py_buffer(texts.buffers()[2].to_pybytes().translate(table)))


def split_words(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """Words between ASCII white space: (id of each word, where each text begins
    among them with the end appended, the distinct words by id)."""
    lists = pc.ascii_split_whitespace(texts)
    offsets = np.frombuffer(lists.buffers()[1], np.int32, len(lists) + 1, lists.offset * 4).astype(np.int64) \
        if len(lists) else np.zeros(1, np.int64)
    flat = lists.flatten()
    offsets -= offsets[0]
    real = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(real, min_count=0).as_py():
        seen = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False), dtype=np.int64)))
        offsets, flat = seen[offsets], flat.filter(real)
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), offsets, coded.dictionary


def objects(words: pa.StringArray) -> np.ndarray:
    return words.to_numpy(zero_copy_only=False)


def word_hashes(words: pa.StringArray | np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; the two lanes are independent."""
    from pandas.util import hash_array
    words = words if isinstance(words, np.ndarray) else objects(words)
    return hash_array(words.astype(object), hash_key=HASH_KEYS[lane], categorize=False) \
        if len(words) else np.zeros(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit (in place of low-quality low bits)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_hashes(word_hash: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hash of each run of `size` words, as a polynomial over the word hashes, mixed."""
    n = len(word_hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = word_hash[:n].copy()
    b = np.uint64(base | 1)
    for k in range(1, size):
        out *= b
        out += word_hash[k:k + n]
    return mixed(out)


def row_of(offsets: np.ndarray) -> np.ndarray:
    """For each element the row that it belongs to, from the rows' offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def group_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]
