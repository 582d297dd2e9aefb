"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into a fixed number of cells. A row falls into the cell of its hash; each shard has
virtual nodes at hashed cells, and a cell belongs to the next virtual node clockwise. Rows enter in
ring order: a row whose shard is full continues clockwise to the next shard that has room. As loads
are bounded, this needs only the number of rows in each cell: the counts (a fixed number, whatever
the input) decide which ranks of a cell go where, and each row finds its place by its rank within
its cell. Rows carry no text.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged, text_or_empty

CELLS = 1 << 14


def ring(shards: int, vnodes: int, cells: int = CELLS) -> list[tuple[int, int]]:
    """The virtual nodes, by cell: (cell, shard). A shard's nodes do not depend on the number of shards."""
    return sorted((zlib.crc32(f"shard {s} node {v}".encode()) % cells, s) for s in range(shards) for v in range(vnodes))


def capacities(rows: int, shards: int, load_factor: float) -> list[int]:
    """Rows that a shard may hold. A factor of 1 gives counts at most one apart."""
    if load_factor <= 1:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [-int(-load_factor * rows // shards)] * shards


def place(counts: Sequence[int], shards: int, vnodes: int, load_factor: float = 1.0) -> list[tuple[int, int, int, int, int]]:
    """Segments (cell, first rank, rank after the last, shard, slot of the first): where each cell's rows go."""
    nodes = ring(shards, vnodes, len(counts))
    at = [c for c, _ in nodes]
    free, used, out = capacities(sum(counts), shards, load_factor), [0] * shards, []
    for cell, n in enumerate(counts):
        k, rank = bisect.bisect_left(at, cell), 0
        while rank < n:
            shard = nodes[k % len(nodes)][1]
            if take := min(free[shard], n - rank):
                out.append((cell, rank, rank + take, shard, used[shard]))
                free[shard] -= take
                used[shard] += take
                rank += take
            k += 1
    return out


def ring_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, vnodes: int = 64, load_factor: float = 1.0) -> DataFrame:
    """A row per document: id, size, text_crc32, shard, slot.

    size is the text's UTF-8 bytes plus 1; a null text counts as empty. A row's place on the ring
    follows from its id and text hash; ties are in order of (hash, id, crc32, size), so reruns
    agree. Identical rows take consecutive places. With load_factor=1 the shards' row counts are at
    most one apart; a larger factor bounds each shard at that multiple of the mean and moves fewer
    rows when shards are added. slot counts a shard's rows from 0 without gaps. An empty table gives
    an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).select(
        "id", (F.octet_length("text") + F.lit(1)).cast("long").alias("size"), F.crc32("text").alias("text_crc32")
    )
    keyed = rows.groupBy("id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    keyed = keyed.withColumn("at", F.xxhash64("id", "text_crc32")).withColumn("cell", F.pmod("at", F.lit(CELLS)).cast("int"))
    keyed = staged(keyed, "ring-rows")
    counts = [0] * CELLS
    for r in keyed.groupBy("cell").agg(F.sum("copies").alias("n")).collect():  # CELLS rows at most
        counts[r.cell] = r.n
    segments = docs.sparkSession.createDataFrame(
        place(counts, shards, vnodes, load_factor), "cell int, first_rank long, end_rank long, shard int, first_slot long"
    )
    w = Window.partitionBy("cell").orderBy("at", "id", "text_crc32", "size")
    ranked = keyed.withColumn("before", F.sum("copies").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("copies")).select(
        "id", "size", "text_crc32", "cell", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("copies") - 1)).alias("rank")
    )
    inside = (ranked.cell == segments.cell) & (ranked["rank"] >= segments.first_rank) & (ranked["rank"] < segments.end_rank)
    return ranked.join(F.broadcast(segments), inside).select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("first_slot") + F.col("rank") - F.col("first_rank")).alias("slot")
    )
