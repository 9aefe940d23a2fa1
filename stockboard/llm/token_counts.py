"""Token counts by offset-mapped attribution.

The fields of a document are joined by `separator` and encoded once, as a
whole, with a byte-level vocabulary; a token's span follows from the lengths of
the tokens before it (the encoding is lossless; runs of white space may be of any length). Sections are the fields' parts
between `section` strings; a separator belongs to the section that it ends.
Token spans and section spans of a block are joined as sorted intervals.

Tokens that cross a boundary are allocated by `rule`:
  `most`   the section that holds most of the token's bytes, the first of equals
  `first`  the section that holds its first byte
  `share`  each section its share of the bytes (then n_tokens is a fraction)
Under each rule the sections of a document sum to its number of tokens.

Defined results: a null field is an empty one and still has one section; a
document whose fields are all empty has sections of no token besides the
separators'; rows that repeat a doc_id are counted one by one; an empty table
gives no rows; other columns are ignored.
"""
from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockboard.llm.common import one_array, slices
from stockboard.llm.packing import vocabulary_path

VOCABULARY = "byte_bpe_50k.tiktoken"
BLOCK_BYTES = 4 << 20
RULES = ("most", "first", "share")
#: Fixed: what the pattern's white space is (Unicode's property of that name).
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


@functools.lru_cache(maxsize=2)
def encoding(name: str):
    """The encoding and the number of bytes of each token."""
    import public_tokenizers
    import tiktoken
    with open(vocabulary_path(name), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), size


def encoded(encoder, whole: str) -> np.ndarray:
    """The tokens of a whole text. The pattern takes a run of white space up to its last character as one
    piece, which joins what follows; its search is nested as deep as such a run is long, so the piece of a
    long run is cut out here and merged on its own. The tokens are those of one call."""
    parts, at = [], 0
    for run in LONG_SPACE.finditer(whole):
        end = run.end() if run.end() == len(whole) else run.end() - 1
        parts.append(encoder.encode_to_numpy(whole[at:run.start()], disallowed_special=()))
        parts.append(np.array(encoder._encode_single_piece(whole[run.start():end]), np.int64))
        at = end
    if not parts:
        return encoder.encode_to_numpy(whole, disallowed_special=())
    parts.append(encoder.encode_to_numpy(whole[at:], disallowed_special=()))
    return np.concatenate(parts).astype(np.int64)


def section_starts(text: bytes, section: bytes) -> list[int]:
    out, at = [0], text.find(section)
    while at >= 0:
        out.append(at + len(section))
        at = text.find(section, at + len(section))
    return out


def allocate(token_start: np.ndarray, token_size: np.ndarray, section_start: np.ndarray, end: int,
             rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, tokens that cross one of its boundaries) of each section; spans are sorted and cover 0..end."""
    n = len(section_start)
    # An empty section shares its start with the next one and holds no byte.
    first = np.searchsorted(section_start, token_start, side="right") - 1
    last = np.searchsorted(section_start, token_start + token_size - 1, side="right") - 1
    crossing = np.flatnonzero(first != last)
    tokens, crossed = np.bincount(first, minlength=n).astype(np.float64), np.zeros(n, np.int64)
    ends = np.append(section_start[1:], end)
    for t in crossing.tolist():
        a, b = int(first[t]), int(last[t])
        overlap = np.minimum(ends[a:b + 1], token_start[t] + token_size[t]) - np.maximum(section_start[a:b + 1],
                                                                                         token_start[t])
        crossed[a:b + 1] += overlap > 0
        if rule == "first":
            continue
        tokens[a] -= 1
        if rule == "most":
            tokens[a + int(np.argmax(overlap))] += 1
        else:
            tokens[a:b + 1] += overlap / token_size[t]
    return tokens, crossed


def counter(n_fields: int, vocabulary: str, separator: bytes, section: bytes, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, size = encoding(vocabulary)
        for batch in slices(batches, BLOCK_BYTES):
            fields = [one_array(batch.column(k + 1)).to_pylist() for k in range(n_fields)]
            doc, field, number, begin, finish, tokens, crossed = [], [], [], [], [], [], []
            for row, values in enumerate(zip(*fields, strict=True)):
                whole = separator.decode().join(values)
                raw = whole.encode()
                starts, of_field, of_number, at = [], [], [], 0
                for k, value in enumerate(values):
                    found = section_starts(value.encode(), section)
                    starts += [at + x for x in found]
                    of_field += [k] * len(found)
                    of_number += range(len(found))
                    at += len(value.encode()) + len(separator)
                starts = np.array(starts, np.int64)
                token_size = size[encoded(encoder, whole)]
                token_start = np.cumsum(token_size) - token_size
                n, c = allocate(token_start, token_size, starts, len(raw), rule)
                if len(raw) != len(whole):                # to code points
                    is_first = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
                    points = np.concatenate(([0], np.cumsum(is_first)))
                else:
                    points = None
                ends = np.append(starts[1:], len(raw))
                doc += [row] * len(starts)
                field += of_field
                number += of_number
                begin.append(starts if points is None else points[starts])
                finish.append(ends if points is None else points[ends])
                tokens.append(n)
                crossed.append(c)
            counts = np.concatenate(tokens) if tokens else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()).take(pa.array(doc, pa.int64())), pa.array(field, pa.int32()),
                 pa.array(number, pa.int32()), pa.array(np.concatenate(begin) if begin else [], pa.int64()),
                 pa.array(np.concatenate(finish) if finish else [], pa.int64()),
                 pa.array(counts) if rule == "share" else pa.array(counts.astype(np.int64)),
                 pa.array(np.concatenate(crossed) if crossed else [], pa.int64())],
                ["doc_id", "field_no", "section", "begin", "end", "n_tokens", "n_crossing"])
    return run


def token_counts(docs: DataFrame, fields: Sequence[str] = ("text",), section: str = "\n", separator: str = "\n",
                 rule: str = "most", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per section: doc_id, field, section (from 0 in its field), begin and end
    (code points in the joined document, end exclusive), n_tokens, n_crossing."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}, not {rule!r}")
    if not section or not separator:
        raise ValueError("section and separator must not be empty")
    names = [f"__field_{k}" if k else "text" for k in range(len(fields))]
    # The last field is by custom the long one; blocks are cut by the column named text.
    order = [len(fields) - 1, *range(len(fields) - 1)]
    place = {field: names[i] for i, field in enumerate(order)}
    d = docs.select(docs["doc_id"], *(docs[f].cast("string").alias(place[k]) for k, f in enumerate(fields)))
    kind = "double" if rule == "share" else "long"
    rows = d.mapInArrow(counter(len(fields), vocabulary, separator.encode(), section.encode(), rule),
                        f"doc_id long, field_no int, section int, begin long, end long, n_tokens {kind}, n_crossing long")
    named = F.element_at(F.array(*map(F.lit, fields)), F.col("field_no") + 1)
    return rows.select("doc_id", named.alias("field"), "section", "begin", "end", "n_tokens", "n_crossing")


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of the source line and of every line of the text, encoded as one document."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), ("source", "text"))
