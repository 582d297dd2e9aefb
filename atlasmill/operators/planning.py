"""From indicators to plans: density model, critical quadrant, points to open, rule-based levers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import log_fit, ratio, running_sums

# The relative gap from which a unit counts as under-equipped, and the levers' names.
UNDER_EQUIPPED = -0.30
LEVERS = ("no_branch", "few_points", "far_away", "single_operator", "unknown_operators")


def density_model(units: DataFrame, density: str, rate: str, population: str, gap_limit: float = UNDER_EQUIPPED) -> DataFrame:
    """Adds expected (rate by the log-log fit), gap, missing (points to reach it, never below 0) and under_equipped."""
    fit = F.broadcast(log_fit(units, density, rate))
    t = units.crossJoin(fit).withColumn("expected", F.when(F.col(density) > 0, F.pow(F.lit(10.0), F.col("intercept") + F.col("slope") * F.log10(density))))
    t = t.withColumn("gap", ratio(F.col(rate), F.col("expected")) - 1)
    missing = F.greatest(F.ceil(F.col(population) / 1e4 * (F.col("expected") - F.coalesce(F.col(rate), F.lit(0.0)))), F.lit(0)).cast("long")
    return t.withColumns({"missing": missing, "under_equipped": F.col("gap") <= gap_limit}).drop("slope", "intercept", "r2")


def critical_quadrant(units: DataFrame, population: str = "population", points: str = "points") -> DataFrame:
    """Units with more inhabitants per point than the whole and more inhabitants than the median unit."""
    whole = units.agg((F.sum(population) / F.sum(points)).alias("__national"), F.median(population).alias("__median"))
    per_point = ratio(F.col(population), F.col(points))
    return units.crossJoin(F.broadcast(whole)).filter((per_point > F.col("__national")) & (F.col(population) > F.col("__median"))).drop("__national", "__median")


def to_open(population: Column, points: Column, objective: float) -> Column:
    """Points that bring inhabitants per point down to the objective; never below 0."""
    return F.greatest(F.ceil(population / objective).cast("long") - points, F.lit(0).cast("long"))


def coverage_plan(units: DataFrame, key: str, rank: str, objective: float, first: int) -> DataFrame:
    """The first units in rank order: opened points, extra branches (1 for a unit with none), and both plan's and population's running sums."""
    chosen = units.filter(F.col(rank) <= first).withColumn("opened", to_open(F.col("population"), F.col("points"), objective))
    chosen = chosen.withColumn("extra_branch", (F.col("active_branches") == 0).cast("long")).select(key, rank, "population", "opened", "extra_branch")
    return running_sums(chosen, rank, ["opened", "population", "extra_branch"], ties=[key], ranges=1)


def levers(units: DataFrame, most_per_point: float = 800, far_km: float = 25, unknown_share: float = 0.15) -> DataFrame:
    """Adds `levers`, the names of the measures that a unit calls for; their populations overlap."""
    rules = {
        "no_branch": F.col("active_branches") == 0,
        "few_points": F.col("inhabitants_per_point") > most_per_point,
        "far_away": F.col("distance_km") >= far_km,
        "single_operator": (F.col("points_a") == 0) | (F.col("points_b") == 0),
        "unknown_operators": ratio(F.col("points_unknown"), F.col("points")) > unknown_share,
    }
    named = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])
    return units.withColumn("levers", F.filter(named, lambda x: x.isNotNull()))


def lever_rows(units: DataFrame) -> DataFrame:
    """One row per unit and lever."""
    return units.withColumn("lever", F.explode("levers")).drop("levers")


def lever_matrix(units: DataFrame, key: str, names: list[str]) -> DataFrame:
    """One row per unit, one boolean column per lever."""
    return units.select(key, *[F.array_contains("levers", n).alias(n) for n in names])
