"""Line dedup by range-partitioned hashes and compressed keep bitmaps.

1. Every line (split at \\n) becomes one row: a 128-bit hash of its key (line
   with white space stripped at both ends, A-Z lower-cased), document and position.
2. Rows are range-partitioned by (hash, document) and sorted by hash, document
   and position. The range bounds hold the document too, so a line that makes up
   a third of all rows spreads over as many partitions as it needs. Each
   partition is streamed once for the documents and the first occurrence of
   every hash; only hashes that reach a partition's edge may go on in another,
   and their partial counts are summed by an aggregate.
3. Dropped positions return per document as one bitmap: bit i set keeps line i,
   lines beyond its end stay; packed and deflated. Documents that lose nothing
   have none. The text itself is not shuffled by this operator.

Modes: `first` keeps only the first occurrence (by document, then position) of
each key; `frequent` drops every line whose key is in `min_docs` documents.
Lines whose key has fewer than `min_length` code points always stay.

Defined results: a null or empty text is one empty line; rows that repeat a
doc_id count as one document, but each text has a bitmap of its own (by its
64-bit hash); a null doc_id is a document like any other; an empty table
gives no rows; other columns are ignored.
"""
from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockboard.llm.common import LOWER, id_and_text

MIN_DOCS = 10
LINES = "h1 long, h2 long, doc_id long, text_hash long, pos int"


def lines_of(min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, counts, positions = [], [], []
            for text in batch.column("text").to_pylist():
                keys = [line.strip() for line in (text or "").encode().translate(LOWER).split(b"\n")]
                at = [i for i, k in enumerate(keys) if len(k) >= min_length
                      and (min_length < 2 or len(k.decode()) >= min_length)]
                digests += [xxhash.xxh3_128_digest(keys[i]) for i in at]
                counts.append(len(at))
                positions += at
            lanes = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2)
            owner = pa.array(np.repeat(np.arange(len(counts)), counts))
            ids, texts = batch.column("doc_id").cast(pa.int64()).take(owner), batch.column("text_hash").take(owner)
            yield pa.RecordBatch.from_arrays(
                [pa.array(lanes[:, 0].astype(np.int64)), pa.array(lanes[:, 1].astype(np.int64)), ids,
                 texts, pa.array(positions, pa.int32())], ["h1", "h2", "doc_id", "text_hash", "pos"])
    return run


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted lines to one row per hash and partition: documents, and the first of them with its position."""
    last = None                           # (h1, h2, documents, first document, its text, first position, last document)
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
        ids, pos, text = batch.column("doc_id"), batch.column("pos").to_numpy(), batch.column("text_hash").to_numpy()
        doc = pa.compute.fill_null(ids, -(1 << 63)).to_numpy(zero_copy_only=False)
        new_hash = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
        new_doc = new_hash | np.concatenate(([True], doc[1:] != doc[:-1]))
        begin = np.flatnonzero(new_hash)
        docs_in = np.add.reduceat(new_doc.astype(np.int64), begin)
        end = np.append(begin[1:], len(h1)) - 1
        out = [h1[begin], h2[begin], docs_in, doc[begin], text[begin], pos[begin].astype(np.int64)]
        if last is not None:
            if last[:2] == (int(h1[0]), int(h2[0])):  # the hash goes on from the batch before
                out[2][0] += last[2] - (last[6] == int(doc[0]))
                out[3][0], out[4][0], out[5][0] = last[3], last[4], last[5]
            else:
                yield hash_batch([np.array([x]) for x in last[:6]])
        last = tuple(int(x[-1]) for x in out) + (int(doc[end[-1]]),)
        yield hash_batch([x[:-1] for x in out])
    if last is not None:
        yield hash_batch([np.array([x]) for x in last[:6]])


def hash_batch(columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                      ["h1", "h2", "n_docs", "first_doc", "first_text", "first_pos"])


def bitmap(drop: list[int]) -> bytes:
    keep = np.ones(max(drop) + 1, bool)
    keep[drop] = False
    return zlib.compress(np.packbits(keep).tobytes() + len(keep).to_bytes(4, "little"))


def keep_flags(packed: bytes | None, n: int) -> np.ndarray:
    keep = np.ones(n, bool)
    if packed is not None:
        raw = zlib.decompress(packed)
        size = int.from_bytes(raw[-4:], "little")
        keep[:size] = np.unpackbits(np.frombuffer(raw[:-4], np.uint8), count=size).astype(bool)[:n]
    return keep


def packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array([bitmap(p) for p in batch.column("drop").to_pylist()], pa.binary())],
            ["doc_id", "text_hash", "keep_bitmap"])


def bitmaps(docs: DataFrame, mode: str = "first", min_docs: int = MIN_DOCS, min_length: int = 1) -> DataFrame:
    """(doc_id, text_hash, keep_bitmap) of the documents that lose lines; text_hash is xxhash64 of the text."""
    if mode not in ("first", "frequent"):
        raise ValueError(f"mode must be first or frequent, not {mode!r}")
    lines = id_and_text(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(lines_of(min_length), LINES)
    ordered = lines.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "text_hash", "pos")
    firsts = ordered.mapInArrow(streamed, "h1 long, h2 long, n_docs long, first_doc long, first_text long, first_pos long") \
        .groupBy("h1", "h2").agg(F.max("h1").alias("g1"), F.max("h2").alias("g2"), F.sum("n_docs").alias("n_docs"),
                                 F.min(F.struct("first_doc", "first_text", "first_pos")).alias("first"))
    # g1, g2 are results of the aggregate, so the join deals both sides anew and
    # Spark can split the partition of a line that fills a third of all rows.
    same = (lines["h1"] == firsts["g1"]) & (lines["h2"] == firsts["g2"])
    if mode == "frequent":
        drop = lines.join(firsts.where(F.col("n_docs") >= min_docs).select("g1", "g2"), same, "left_semi")
    else:
        doc = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
        drop = lines.join(firsts.select("g1", "g2", "first"), same).where(
            (doc != F.col("first.first_doc")) | (F.col("text_hash") != F.col("first.first_text"))
            | (F.col("pos") != F.col("first.first_pos")))
    per_doc = drop.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("drop"))
    return per_doc.mapInArrow(packed_rows, "doc_id long, text_hash long, keep_bitmap binary")


def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_lines, n_dropped, texts = [], [], []
        for text, packed in zip(batch.column("text").to_pylist(), batch.column("keep_bitmap").to_pylist(), strict=True):
            lines = (text or "").split("\n")
            n_lines.append(len(lines))
            if packed is None:
                n_dropped.append(0)
                texts.append(text or "")
                continue
            keep = keep_flags(packed, len(lines)).tolist()
            n_dropped.append(len(lines) - sum(keep))
            texts.append("\n".join(x for x, k in zip(lines, keep, strict=True) if k))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_lines, pa.int64()),
                                          pa.array(n_dropped, pa.int64()), pa.array(texts, pa.string())],
                                         ["doc_id", "n_lines", "n_dropped", "text"])


def apply_bitmaps(docs: DataFrame, maps: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) with the lines that the bitmaps keep."""
    d = id_and_text(docs)
    m = maps.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text"), "keep_bitmap")
    return d.join(m, d["doc_id"].eqNullSafe(m["__id"]) & (F.xxhash64(d["text"]) == m["__text"]), "left").select("doc_id", "text", "keep_bitmap") \
        .mapInArrow(rebuilt, "doc_id long, n_lines long, n_dropped long, text string")


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = apply_bitmaps(docs, bitmaps(docs, "frequent"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line,
             translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS dropped FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(dropped::int) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
