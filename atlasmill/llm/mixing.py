"""Mixing sources to target weights by subset-sum budget fitting.

A source whose target is at least its size is taken whole as often as it fits; what is left of the
target is its budget. Documents are counted by exact length; a source's histogram, and never its
documents, decides how many of each length fill the budget: an even share of every length first,
then a bounded-knapsack dynamic programme over the few words that remain. Seeded hashes then select
that many documents of each length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, staged, text_or_empty

WEIGHTS = (5, 2, 1)
#: Documents that are ranked in one task when a length's documents are selected.
CELL_ROWS = 4096
#: A plan of up to so many rows goes to every task.
BROADCAST_ROWS = 500_000


def word_count(text: F.Column) -> F.Column:
    """Number of words: each ends where a word character meets white space or the end."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def bounded_knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that the words come as near the budget, without exceeding it, as any choice can.

    Multiplicities are split into powers of two; `by[s]` is the first item that made the sum s, so
    walking back from the best sum meets each item once at most. Memory follows the budget.
    """
    take = np.zeros(len(lengths), np.int64)
    if budget <= 0:
        return take
    by = np.full(budget + 1, -1, np.int32)
    by[0] = 0
    items: list[tuple[int, int]] = [(0, 0)]
    for k, (length, count) in enumerate(zip(lengths.tolist(), counts.tolist(), strict=True)):
        left, part = min(count, budget // length), 1
        while left > 0 and by[budget] < 0:
            n = min(part, left)
            items.append((k, n))
            w = length * n
            new = (by[: budget + 1 - w] >= 0) & (by[w:] < 0)
            by[w:][new] = len(items) - 1
            left, part = left - n, part * 2
        if by[budget] >= 0:
            break
    s = int(np.flatnonzero(by >= 0)[-1])
    while s:
        k, n = items[by[s]]
        take[k] += n
        s -= int(lengths[k]) * n
    return take


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Documents to take of each length: words as near the budget as they can be, spread over all lengths.

    lengths are distinct and positive. The even share is rounded down along the cumulated words, so
    that less than one longest document is left for the dynamic programme.
    """
    words = lengths * counts
    total = int(words.sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0:
        return np.zeros_like(counts)
    share, take, done = budget / total, np.zeros_like(counts), 0.0
    for k in range(len(lengths)):  # longest first: short lengths make up for what long ones leave
        due = done + share * words[k]
        n = min(int(due // lengths[k]), int(counts[k]))
        take[k] = n
        done = due - n * lengths[k]
    rest = budget - int((take * lengths).sum())
    order = np.arange(len(lengths))[::-1]
    return take + bounded_knapsack(lengths[order], (counts - take)[order], rest)[np.argsort(order)]


def _fit_source(hist: pd.DataFrame) -> pd.DataFrame:
    hist = hist.sort_values("size", ascending=False, ignore_index=True)
    source_size, target = int(hist["source_size"].iloc[0]), float(hist["target"].iloc[0])
    some = hist["size"].to_numpy() > 0
    whole = int(target // source_size) if source_size else 0
    take = np.zeros(len(hist), np.int64)
    take[some] = fit(hist["size"].to_numpy()[some], hist["docs"].to_numpy()[some], round(target - whole * source_size))
    return hist.assign(whole=whole, selected=take)[["source", "no_source", "size", "docs", "source_size", "target", "whole", "selected"]]


def source_targets(hist: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """Targets by source: source, no_source, source_size, target. One row per source in one window.

    Sources are in order of code points, null last, and weigh `weights`, repeating. Filling up by
    weight until no source is above its cap means one level for all: target = min(cap, level x
    weight). In order of cap / weight, those up to the first that stays below its cap are capped.
    """
    by_name, by_ratio = Window.orderBy("no_source", "source"), Window.orderBy("ratio", "no_source", "source")
    sums = hist.groupBy("source", "no_source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))
    weight = F.array([F.lit(float(w)) for w in weights])[F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))]
    s = sums.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(max_repeats))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("room", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("weights", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("room") / F.col("weights"))
    # the level that holds is that of the first source, in this order, which stays below its cap
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "no_source", "source", "level"))).over(every)["level"]
    return s.withColumn("target", F.least("cap", F.col("weight") * level)).select("source", "no_source", "source_size", "target")


def _place(id_col: str, text_col: str, source_col: str, seed: int) -> list[F.Column]:
    """Columns source, no_source, size and at: a row's seeded hash, which only repeated rows share."""
    text = text_or_empty(text_col)
    return [
        F.coalesce(F.col(source_col), F.lit("")).alias("source"),
        F.col(source_col).isNull().alias("no_source"),
        word_count(text).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), text).alias("at"),
    ]


def mix_plan(rows: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """By (source, no_source, size): source_size, target, whole, and which rows are taken once more.

    Those are the rows up to the hash `upto`; `last` of the `tied` rows with just that hash. The rows
    of a length are dealt to cells by their hash, in order; only the cell in which the number is
    reached is ranked, so a length that very many documents share is not sorted in one task.
    """
    by_source = ["source", "no_source"]
    group = [*by_source, "size"]
    hist = rows.groupBy(*group).agg(F.count("*").alias("docs"))
    plan = (
        hist.join(source_targets(hist, weights, max_repeats), by_source)
        .groupBy(*by_source)
        .applyInPandas(_fit_source, "source string, no_source boolean, size long, docs long, source_size long, target double, whole long, selected long")
    )
    plan = staged(plan, "mix-plan")
    partly = plan.filter("selected > 0 AND selected < docs").select(*group, "selected", (F.floor(F.col("docs") / CELL_ROWS) + 1).alias("cells"))
    # cells in the order of the hashes: its leading 20 bits, scaled
    cell = F.shiftright((F.shiftright("at", 44) + (1 << 19)) * F.col("cells"), 20)
    counted = rows.groupBy(*group, "at").agg(F.count("*").alias("tied")).join(side(partly, partly.count()), group).withColumn("cell", cell)
    per_cell = counted.groupBy(*group, "cell").agg(F.sum("tied").alias("in_cell"))
    before = Window.partitionBy(*group).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    per_cell = per_cell.withColumn("before", F.coalesce(F.sum("in_cell").over(before), F.lit(0)))
    upto = Window.partitionBy(*group, "cell").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.join(per_cell.withColumnRenamed("cell", "in"), group).filter("cell = in AND before < selected AND selected <= before + in_cell")
    ranked = ranked.withColumn("rank", F.col("before") + F.coalesce(F.sum("tied").over(upto), F.lit(0)))
    cut = ranked.filter("rank < selected AND selected <= rank + tied").select(*group, F.col("at").alias("upto"), (F.col("selected") - F.col("rank")).alias("last"), "tied")
    return plan.join(cut, group, "left").select(*group, "source_size", "target", "whole", "selected", "docs", "upto", "last", "tied")


def side(small: DataFrame, n: int) -> DataFrame:
    return F.broadcast(small) if n <= BROADCAST_ROWS else small


def _decided(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with (source, no_source, size, at): source_size, target and times, how often the mix takes the row."""
    plan = staged(plan, "mix-cuts")
    group = ["source", "no_source", "size"]
    sizes = plan.agg(F.count("*").alias("n"), F.count_if(F.col("last") < F.col("tied")).alias("ties")).first()
    joined = rows.join(side(plan, sizes.n), group)
    more = F.when(F.col("selected") == F.col("docs"), 1).when(F.col("at") < F.col("upto"), 1).when((F.col("at") == F.col("upto")) & (F.col("last") == F.col("tied")), 1).otherwise(0)
    out = joined.withColumn("times", F.when(F.col("size") == 0, 0).otherwise(F.col("whole") + more))
    if sizes.ties:  # repeated rows of which some are taken: any of them will do
        tied = (F.col("at") == F.col("upto")) & (F.col("last") < F.col("tied"))
        some = out.filter(tied).withColumn("nth", F.row_number().over(Window.partitionBy(*group, "at").orderBy("at")))
        some = some.withColumn("times", F.col("times") + (F.col("nth") <= F.col("last")).cast("int")).drop("nth")
        out = out.filter(~F.coalesce(tied, F.lit(False))).unionByName(some)
    return out.drop("whole", "selected", "docs", "upto", "last", "tied", "at")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3, seed: int = 17) -> DataFrame:
    """How much of each document the mix takes: id, size, source_size, target, taken, source.

    size is the number of words, 0 for a null text. A source's target is its weight's share of all
    words, at most `max_repeats` times its own. taken is a multiple of size, at most `max_repeats`
    times it: documents are taken whole. Null sources are one source of their own. Repeated rows
    are separate documents. Selection follows a seeded hash of id and text, so reruns agree. Empty
    documents take nothing; an empty table gives an empty result; other columns are ignored.
    """
    rows = staged(docs.select(F.col(id_col).alias("id"), *_place(id_col, text_col, source_col, seed)), "sizes")
    return _decided(rows, mix_plan(rows, weights, max_repeats)).select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), F.when(~F.col("no_source"), F.col("source")).alias("source")
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3, seed: int = 17) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns and no others; documents without words are left out. Texts are not shuffled.

    Null and empty texts have no words; a null source is a source of its own; repeated rows are mixed
    as documents of their own. An empty table gives an empty result.
    """
    place = _place(id_col, text_col, source_col, seed)
    plan = mix_plan(staged(docs.select(*place), "sizes"), weights, max_repeats)
    rows = docs.select(F.struct("*").alias("row"), *place)
    return _decided(rows, plan).filter("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")
