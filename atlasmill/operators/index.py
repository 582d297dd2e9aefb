"""Priority and coverage-gap indices, their variants, random weights, reweighting and break-down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.draws import dirichlet
from ..functions.stats import descending_rank, min_max, ranks_of
from ..sources.staging import staged
from .crosswalk import paired

# The priority index's weights and its components' sources, turned so that more is worse.
WEIGHTS = {"d1": 0.30, "d2": 0.25, "d3": 0.25, "d4": 0.20}
SOURCES = {"d1": ("inhabitants_per_point", 1), "d2": ("branches_per_100k", -1), "d3": ("distance_km", 1), "d4": ("population", 1)}
COMPONENTS = tuple(WEIGHTS)


def _sum(parts: list[Column]) -> Column:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def composed(weights: dict[str, float], prefix: str = "n_") -> Column:
    """Weighted sum of components; null if one of those that count is."""
    return _sum([F.col(prefix + c) * float(w) for c, w in weights.items() if w])


def priority_index(units: DataFrame, key: str) -> DataFrame:
    """Adds n_d1..n_d4 (0-100), r_d1..r_d4 (percent ranks), score, rank_score and rank (mean ranks truncated). `key` names a unit.

    The units, which several grouped passes read, are written once.
    """
    units = staged(units, "units")
    turned = {c: F.col(s) * sign for c, (s, sign) in SOURCES.items()}
    t = min_max(units.withColumns(turned), {c: f"n_{c}" for c in COMPONENTS})
    t = t.join(ranks_of(units, key, {f"r_{c}": v for c, v in turned.items()}, "percent"), key)
    t = staged(t.withColumns({"score": composed(WEIGHTS), "rank_score": composed(WEIGHTS, "r_")}).drop(*COMPONENTS), "scores")
    return staged(descending_rank(t, "score", "rank", "average"), "index")


def variants() -> dict[str, tuple[dict[str, float], str]]:
    """Name to (weights, prefix): the index's own, by ranks, equal, deficits only, and with one component left out."""
    out = {"reference": (WEIGHTS, "n_"), "ranks": (WEIGHTS, "r_"), "equal": (dict.fromkeys(COMPONENTS, 0.25), "n_"), "no_stake": ({c: w / 0.80 for c, w in WEIGHTS.items() if c != "d4"}, "n_"), "deficits": (dict.fromkeys(("d1", "d2", "d3"), 1 / 3), "n_")}
    for left in COMPONENTS:
        kept = {c: w for c, w in WEIGHTS.items() if c != left}
        out[f"without_{left}"] = ({c: w / sum(kept.values()) for c, w in kept.items()}, "n_")
    return out


def variant_scores(indexed: DataFrame, key: str) -> DataFrame:
    """(variant, key, reference, value) for every variant: one pass over the units."""
    rows = [F.struct(F.lit(n).alias("variant"), composed(w, p).alias("value")) for n, (w, p) in variants().items()]
    return indexed.select(key, F.col("score").alias("reference"), F.explode(F.array(*rows)).alias("v")).select("v.variant", key, "reference", "v.value")


def compared(long: DataFrame, by: str, key: str, k: int) -> DataFrame:
    """(by, spearman, kept): rank correlation of value with reference, and how many of the first k they share; ties go to the smaller key."""
    group = Window.partitionBy(by)

    def mean_rank(c: str) -> Column:
        return F.rank().over(group.orderBy(c)) + (F.count("*").over(group.partitionBy(by, c)) - 1) / 2

    def top(c: str) -> Column:
        return F.row_number().over(group.orderBy(F.desc(c), key)) <= k

    ranked = long.select(by, mean_rank("reference").alias("a"), mean_rank("value").alias("b"), (top("reference") & top("value")).alias("both"))
    return ranked.groupBy(by).agg(F.corr("a", "b").alias("spearman"), F.count_if("both").alias("kept"))


def drawn_weights(spark: SparkSession, draws: int, parts: int, shape: int, seed: int) -> DataFrame:
    """(draw, w): weights that sum to 1, of a symmetric Dirichlet law with an integer shape; every engine draws the same."""
    return spark.range(draws).select(F.col("id").alias("draw"), dirichlet(seed, parts, shape, F.col("id")).alias("w"))


def sensitivity(scored: DataFrame, key: str, parts: list[str], draws: DataFrame, k: int) -> DataFrame:
    """(key, frequency, rank_median, rank_min, rank_max): ranks of the weighted sums over all draws; frequency is that of ranks up to k.

    The draws, whose number is a parameter, go to every task; each draw ranks the units on its own, mean
    ranks for ties.
    """
    units = scored.select(key, *parts)
    value = _sum([F.col("w")[i] * F.col(p) for i, p in enumerate(parts)])
    rows = units.crossJoin(F.broadcast(draws)).select("draw", key, F.round(value, 9).alias("value"))
    group = Window.partitionBy("draw")
    rank = F.rank().over(group.orderBy(F.desc("value"))) + (F.count("*").over(Window.partitionBy("draw", "value")) - 1) / 2
    ranked = rows.withColumn("rank", rank)
    return ranked.groupBy(key).agg(F.avg((F.col("rank") <= k).cast("double")).alias("frequency"), F.median("rank").alias("rank_median"), F.min("rank").alias("rank_min"), F.max("rank").alias("rank_max"))


def mean_spearman(scored: DataFrame, key: str, parts: list[str], draws: DataFrame, reference: str) -> DataFrame:
    """One row (draws, mean_spearman): the mean, over all draws, of the rank correlation of the weighted sums with `reference`."""
    units = scored.select(F.col(reference).alias("reference"), *parts)
    value = _sum([F.col("w")[i] * F.col(p) for i, p in enumerate(parts)])
    rows = units.crossJoin(F.broadcast(draws)).select("draw", "reference", F.round(value, 9).alias("value"))

    def mean_rank(c: str) -> Column:
        return F.rank().over(Window.partitionBy("draw").orderBy(c)) + (F.count("*").over(Window.partitionBy("draw", c)) - 1) / 2

    each = rows.select("draw", mean_rank("reference").alias("a"), mean_rank("value").alias("b")).groupBy("draw").agg(F.corr("a", "b").alias("s"))
    return each.agg(F.count("*").alias("draws"), F.avg("s").alias("mean_spearman"))


def robust(frequencies: DataFrame, least: float = 0.90) -> DataFrame:
    return frequencies.filter(F.col("frequency") >= least)


def reweighted(indexed: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """(key, new_score, new_rank, moved): arbitrary weights, brought to a sum of 1; moved is the old rank less the new one."""
    total = float(sum(weights.values()))
    t = indexed.withColumn("new_score", composed({c: w / total for c, w in weights.items()}))
    t = descending_rank(t, "new_score", "new_rank")
    t = descending_rank(t, "score", "old_rank")
    return t.select(key, "new_score", "new_rank", (F.col("old_rank") - F.col("new_rank")).alias("moved"))


def movement(old: DataFrame, new: DataFrame, key: str, rank: str) -> DataFrame:
    """(key, old_rank, new_rank, moved): two rankings of the same units, paired by key; a unit that one of them lacks fails the job."""
    both = paired(old.select(key, F.col(rank).alias("old_rank")), new.select(key, F.col(rank).alias("new_rank")), key)
    return both.withColumn("moved", F.col("old_rank") - F.col("new_rank"))


def breakdown(indexed: DataFrame, key: str) -> DataFrame:
    """(key, c_d1..c_d4, dominant, dominant_share): each component's part of the score; ties go to the first component."""
    parts = {c: F.col(f"n_{c}") * w for c, w in WEIGHTS.items()}
    ranked = F.array_max(F.array(*[F.struct(v.alias("v"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, (c, v) in enumerate(parts.items())]))
    return indexed.select(key, *[v.alias(f"c_{c}") for c, v in parts.items()], ranked["c"].alias("dominant"), F.when(F.col("score") != 0, ranked["v"] / F.col("score")).alias("dominant_share"))


# The coverage-gap index's components; more is worse.
GAP_PARTS = {"r1": ("distance_km", 1), "r2": ("witness_density", -1), "r3": ("n_operators", -1), "r4": ("log_density", -1)}


def gap_index(zones: DataFrame, key: str, parts: tuple[str, ...] = tuple(GAP_PARTS)) -> DataFrame:
    """Adds the parts (percentiles), risk (their mean), risk_rank and class: high from the 90th percentile on or without witness, watch from the 75th on."""
    zones = staged(zones.withColumn("log_density", F.log10("density")), "zones")
    ranked = ranks_of(zones, key, {p: F.col(GAP_PARTS[p][0]) * GAP_PARTS[p][1] for p in parts}, "percentile")
    t = staged(zones.drop("log_density").join(ranked, key).withColumn("risk", _sum([F.col(p) for p in parts]) / len(parts)), "risks")
    cuts = t.agg(F.percentile("risk", F.lit(0.90)).alias("__p90"), F.percentile("risk", F.lit(0.75)).alias("__p75"))
    risk_class = F.when((F.col("risk") >= F.col("__p90")) | (F.col("witnesses") == 0), "high").when(F.col("risk") >= F.col("__p75"), "watch").otherwise("low")
    return staged(descending_rank(t, "risk", "risk_rank").crossJoin(F.broadcast(cuts)).withColumn("class", risk_class).drop("__p90", "__p75"), "gaps")


def gap_variant_scores(gaps: DataFrame, key: str) -> DataFrame:
    """(variant, key, reference, value): the mean of the gap index's parts with one left out, for every part."""
    rows = [F.struct(F.lit(f"without_{left}").alias("variant"), F.round(_sum([F.col(p) for p in GAP_PARTS if p != left]) / (len(GAP_PARTS) - 1), 9).alias("value")) for left in GAP_PARTS]
    return gaps.select(key, F.round("risk", 9).alias("reference"), F.explode(F.array(*rows)).alias("v")).select("v.variant", key, "reference", "v.value")
