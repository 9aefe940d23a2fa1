"""Purge by label for graphs whose edges are many and whose doomed nodes are too.

A blocked Bloom filter of the doomed ids stands ahead of the two anti joins: an id's hash picks a
block of 32,768 bits and four bits within. An edge with no end in the filter is certainly kept and is
never shuffled; only the others meet the exact anti joins. The filter is a table of at most ``blocks``
rows of 4 KiB, which bounds what is broadcast (1,024 blocks: 4 MiB) whatever the number of ids; one
that fills up lets more edges travel, never fewer, and the result stays the same.
"""
from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockboard.sources.graph import EDGE_COLUMNS

BLOCKS = 1024
BLOCK_BITS = 32768              # fixed by bitmap_construct_agg
HASHES = 4


def _block(id_: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), id_), F.lit(blocks)).cast("int")


def _bits(id_: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), id_), F.lit(BLOCK_BITS)).cast("int") for i in range(1, HASHES + 1)]


def bloom_blocks(ids: DataFrame, column: str, blocks: int = BLOCKS) -> DataFrame:
    """The filter of a column: at most ``blocks`` rows (block, bits). Nulls are left out."""
    if blocks < 1:
        raise ValueError("a filter has at least one block")
    id_ = F.col(column)
    marks = ids.where(id_.isNotNull()).select(_block(id_, blocks).alias("block"),
                                              F.explode(F.array(*_bits(id_))).alias("bit"))
    return marks.groupBy("block").agg(F.bitmap_construct_agg(F.col("bit").cast("bigint")).alias("bits"))


def _may_hold(bits: Column, id_: Column) -> Column:
    def is_set(bit: Column) -> Column:
        byte = F.conv(F.hex(F.substring(bits, F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, bit.bitwiseAND(7)) == 1

    return F.coalesce(reduce(and_, [is_set(b) for b in _bits(id_)]), F.lit(False))


def flag_may_hold(rows: DataFrame, column: str, filter_: DataFrame, flag: str, blocks: int = BLOCKS) -> DataFrame:
    """``rows`` with a boolean: false where the column is certainly not in the filter (a null never is)."""
    probe = F.broadcast(filter_.select(F.col("block").alias("_block"), F.col("bits").alias("_bits")))
    joined = rows.join(probe, _block(F.col(column), blocks) == F.col("_block"), "left")
    return joined.withColumn(flag, F.col(column).isNotNull() & _may_hold(F.col("_bits"), F.col(column))).drop("_block", "_bits")


def purge_label_filtered(nodes: DataFrame, edges: DataFrame, label: str, blocks: int = BLOCKS) -> tuple[DataFrame, DataFrame]:
    """What ``graph.purge_label`` returns, with the filter ahead of its anti joins.

    The edges are read twice (certain and possible ones); pass stored edges (``graph.store_graph``).
    """
    doomed = nodes.where(F.array_contains("labels", label)).select(F.col("node_id").alias("id"))
    filter_ = bloom_blocks(doomed, "id", blocks)
    flagged = flag_may_hold(flag_may_hold(edges.select(*EDGE_COLUMNS), "src", filter_, "_src", blocks), "dst", filter_, "_dst", blocks)
    possible = flagged.where(F.col("_src") | F.col("_dst"))
    certain = flagged.where(~(F.col("_src") | F.col("_dst"))).select(*EDGE_COLUMNS)
    kept = (possible.join(doomed, F.col("src") == F.col("id"), "left_anti")
            .join(doomed, F.col("dst") == F.col("id"), "left_anti").select(*EDGE_COLUMNS))
    return nodes.where(~F.array_contains("labels", label)), certain.unionByName(kept)
