"""Exact dedup: a tree-merge of sorted digest runs, in DataFrame operations only.

Documents are reduced to digest rows first, so no text is shuffled. Rows are dealt to `runs` runs by a
hash of their identifier, which spreads a group of copies, however large, over all runs; within a run
equal digests become one row: the run's winning identifier and number of copies. The runs merge in
binomial rounds. In each, a run whose number ends in 1 goes to its neighbour that ends in 0 (`fan_in`
runs meet where more merge at a time), both are sorted by digest, and equal digests become one row that
retains the winner. As the runs get fewer, each is cut into as many more ranges of digests, so that
every round has about as many tasks: the last one's single run lies in as many ranges as there were
runs. At most `fan_in` rows of a digest ever meet. The winner then travels back to the first level's
runs, at most `runs` rows per digest.

A digest is SHA-256; it is verified at every level, as the byte length and an independent 64-bit
hash are part of the merge key: texts that differ in either never merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep_rows, staged, text_or_empty

KEY = ["digest", "n_bytes", "check"]


def digest_rows(docs: DataFrame, id_col: str, text_col: str, runs: int) -> DataFrame:
    """One row per (text, id): digest, n_bytes, check, id, copies, run."""
    text = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    keyed = text.select("id", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("n_bytes"), F.xxhash64("text").alias("check"))
    return keyed.groupBy(*KEY, "id").agg(F.count("*").alias("copies")).withColumn("run", F.pmod(F.xxhash64("id"), F.lit(runs)).cast("int"))


def merge_round(level: DataFrame, cut: int, step: int) -> DataFrame:
    """One round: runs whose numbers differ in the last `step` bits meet, in ranges of the digest's first `cut` bits.

    `level` has a row for each key and run: the run's number, best and copies; so has the result.
    """
    first = F.conv(F.hex(F.substring("digest", 1, 3)), 16, 10).cast("int")
    moved = level.withColumns({"run": F.shiftright("run", step), "range": F.shiftright(first, 24 - cut)})
    met = moved.repartition("run", "range").sortWithinPartitions("run", "range", *KEY)
    return met.groupBy("run", "range", *KEY).agg(F.max("best").alias("best"), F.sum("copies").alias("copies")).drop("range")


def merge_tree(level: DataFrame, runs: int, fan_in: int) -> DataFrame:
    """All rounds: `level` has a row for each key and run, the result one for each key."""
    bits, step = (runs - 1).bit_length(), max(1, fan_in.bit_length() - 1)
    for done in range(0, bits, step):
        now = min(step, bits - done)
        level = merge_round(level, min(done + now, 24), now)
    return level.drop("run")


def verdicts(docs: DataFrame, id_col: str, text_col: str, keep: str = "largest", runs: int = 64, fan_in: int = 2) -> DataFrame:
    """A row per (text, id): id, digest, n_bytes, check, copies, keep_id, group_size. fan_in is a power of two."""
    sign = {"largest": 1, "smallest": -1}[keep]
    rows = staged(digest_rows(docs, id_col, text_col, runs), "digests")
    first = rows.groupBy(*KEY, "run").agg(F.max(F.struct((F.col("id") * sign).alias("id"))).alias("best"), F.sum("copies").alias("copies"))
    level = merge_tree(first, runs, fan_in)
    groups = level.filter("copies > 1").select(*KEY, (F.col("best.id") * sign).alias("keep_id"), F.col("copies").alias("group_size"))
    by_run = first.select(*KEY, "run").join(groups, KEY)
    found = rows.join(by_run, [*KEY, "run"], "left")
    single = F.col("group_size").isNull()
    return found.select(
        "id",
        *KEY,
        "copies",
        F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", runs: int = 64, fan_in: int = 2) -> DataFrame:
    """Finds groups of identical texts; returns a row per document: id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. The row with the largest (or, with keep="smallest", the smallest)
    identifier stays; a null identifier loses to any other. A repeated row (same id, same text) is
    counted as often as it occurs, and one of its occurrences is kept. An empty table gives an
    empty result; other columns of `docs` are ignored, whatever their names. Identifiers must be
    of an integer type.
    """
    found = verdicts(docs, id_col, text_col, keep, runs, fan_in).withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return found.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One document of each group of identical texts, with all its columns and no others; which one stays is as in exact_dedup().

    Null and empty texts are one group. Of rows with the same id and text one occurrence stays. An
    empty table gives an empty result.
    """
    found = verdicts(docs, id_col, text_col, keep)
    return keep_rows(docs, id_col, text_col, found.withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id"))))
