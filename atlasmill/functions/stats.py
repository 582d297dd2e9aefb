"""Ranks, percentiles, running sums, concentration and fits over whole tables, without one-task sorts.

A window over a whole table would put all rows into one task. Here rows are first summed by
distinct value; the values are then dealt to ranges whose bounds come from approximate quantiles,
summed within each range, and shifted by the totals of the ranges before: a distributed prefix sum.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

#: Ranges of a prefix sum: the table of their totals is this long at most.
RANGES = 64
#: Up to so many rows are summed in one range.
ONE_RANGE = 200_000


def running_sums(df: DataFrame, order: str, values: list[str], by: list[str] | None = None, ties: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """Adds sum_<v> for each value: the sum over rows up to and with this one, in ascending order.

    `order` is numeric, without nulls; `ties` orders equal values and must make rows distinct.
    With `by`, sums start anew in each group. Without `ranges`, rows are counted: up to ONE_RANGE are
    one range, more are RANGES.
    """
    by, ties = by or [], ties or []
    bounds = []
    if ranges is None or ranges > 1:
        cuts = [k / (ranges or RANGES) for k in range(1, ranges or RANGES)]
        found = df.agg(F.count("*").alias("n"), F.percentile_approx(order, cuts, 1000).alias("b")).first()
        bounds = sorted(set(found.b or [])) if ranges is not None or found.n > ONE_RANGE else []
    cut = F.lit(0)
    if bounds:
        cut = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(order)))
    ranged = df.withColumn("__range", cut)
    local = Window.partitionBy(*by, "__range").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumns({f"sum_{v}": F.sum(v).over(local) for v in values})
    if bounds:
        totals = ranged.groupBy(*by, "__range").agg(*[F.sum(v).alias(f"__{v}") for v in values])
        before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1) if by else Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.select(*by, "__range", *[F.coalesce(F.sum(f"__{v}").over(before), F.lit(0)).alias(f"__{v}") for v in values])
        out = out.join(totals, [*by, "__range"]).withColumns({f"sum_{v}": F.col(f"sum_{v}") + F.col(f"__{v}") for v in values}).drop(*[f"__{v}" for v in values])
    return out.drop("__range")


def value_ranks(df: DataFrame, value: str, by: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """By distinct non-null value: ties, first_rank and mean_rank (ascending, from 1)."""
    by = by or []
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("ties"))
    summed = running_sums(counts, value, ["ties"], by, ranges=ranges)
    first = F.col("sum_ties") - F.col("ties") + 1
    return summed.select(*by, value, "ties", first.alias("first_rank"), (first + (F.col("ties") - 1) / 2).alias("mean_rank"))


def percent_rank_of(df: DataFrame, value: str, to: str, ranges: int | None = None) -> DataFrame:
    """Adds `to`: mean rank / number of non-null values x 100; null for null."""
    n = df.agg(F.count(value).alias("__n"))
    ranked = df.join(value_ranks(df, value, ranges=ranges).select(value, "mean_rank"), value, "left").crossJoin(F.broadcast(n))
    return ranked.withColumn(to, F.col("mean_rank") / F.col("__n") * 100).drop("mean_rank", "__n")


def percentile_of(df: DataFrame, value: str, to: str, ranges: int | None = None) -> DataFrame:
    """Adds `to`: (mean rank - 1) / (number of rows, nulls included, - 1) x 100; null for null."""
    n = df.agg(F.count("*").alias("__n"))
    ranked = df.join(value_ranks(df, value, ranges=ranges).select(value, "mean_rank"), value, "left").crossJoin(F.broadcast(n))
    return ranked.withColumn(to, F.when(F.col("__n") > 1, (F.col("mean_rank") - 1) / (F.col("__n") - 1) * 100)).drop("mean_rank", "__n")


def ranks_of(df: DataFrame, key: str, columns: dict[str, Column], scale: str, ranges: int | None = None) -> DataFrame:
    """(key, each name): ranks of several columns in one pass, by component; null stays null.

    scale="percent": mean rank / number of non-null values x 100. scale="percentile": (mean rank - 1)
    / (number of rows, nulls included, - 1) x 100.
    """
    rows = df.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("value")) for n, c in columns.items()])).alias("r")).select(key, "r.name", "r.value")
    sizes = rows.groupBy("name").agg(F.count("value").alias("filled"), F.count("*").alias("rows"))
    mean = value_ranks(rows, "value", ["name"], ranges).select("name", "value", "mean_rank")
    share = F.col("mean_rank") / F.col("filled") * 100 if scale == "percent" else F.when(F.col("rows") > 1, (F.col("mean_rank") - 1) / (F.col("rows") - 1) * 100)
    ranked = rows.join(mean, ["name", "value"], "left").join(F.broadcast(sizes), "name").withColumn("share", share)
    return ranked.groupBy(key).agg(*[F.max(F.when(F.col("name") == n, F.col("share"))).alias(n) for n in columns])


def descending_rank(df: DataFrame, value: str, to: str, ties: str = "min", by: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """Adds `to`: rank by falling value; ties="min", or "average" (truncated to an integer)."""
    by = by or []
    table = value_ranks(df.withColumn("__down", -F.col(value)), "__down", by, ranges)
    rank = F.col("first_rank") if ties == "min" else F.floor("mean_rank")
    return df.withColumn("__down", -F.col(value)).join(table, [*by, "__down"], "left").withColumn(to, rank.cast("long")).drop("__down", "ties", "first_rank", "mean_rank")


def min_max(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds each target column: its source scaled to 0-100; 50 where all values are equal; null stays null."""
    ends = df.agg(*[f(c).alias(f"__{k}_{n}") for c, k in columns.items() for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.crossJoin(F.broadcast(ends))
    for c, k in columns.items():
        lo, hi = F.col(f"__{k}_lo"), F.col(f"__{k}_hi")
        out = out.withColumn(k, F.when(F.col(c).isNull(), None).when(hi > lo, (F.col(c) - lo) / (hi - lo) * 100).otherwise(50.0))
    return out.drop(*ends.columns)


def spearman(df: DataFrame, a: str, b: str, ranges: int | None = None) -> DataFrame:
    """One row, `spearman`: Pearson's correlation of mean ranks, over rows with both values."""
    both = df.select(a, b).filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    ra = value_ranks(both, a, ranges=ranges).select(a, F.col("mean_rank").alias("ra"))
    rb = value_ranks(both, b, ranges=ranges).select(b, F.col("mean_rank").alias("rb"))
    return both.join(ra, a).join(rb, b).agg(F.corr("ra", "rb").alias("spearman"))


#: Ranges that a group's values are dealt to for a weighted median.
MEDIAN_RANGES = 512


def weighted_median(df: DataFrame, by: list[str], value: str, weight: str, to: str, ranges: int = MEDIAN_RANGES) -> DataFrame:
    """(by, to): in order of value, the first at which the weights reach half of the group's; nulls in `by` are a group.

    A group's values are dealt to ranges by approximate percentiles, and weights are summed by range,
    which combines before the shuffle. Only the values of the range in which half is reached are summed
    one by one and sorted, so a group's rows never meet in one task. Weights are added as decimals of
    nine places: the sums do not depend on their order.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v"), F.col(weight).cast("decimal(28,9)").alias("__w"))
    cuts = [k / ranges for k in range(1, ranges)]
    ends = rows.groupBy(*by).agg(F.percentile_approx(F.col("__v").cast("double"), cuts, 10_000).alias("__ends")).withColumn("__ends", F.array_distinct("__ends"))
    same = lambda a, b: reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in by])
    ends = staged(ends, "median-ranges")
    # a value's range: how many of its group's ends lie below it
    dealt = rows.join(ends, same(rows, ends)).select(*[rows[c] for c in by], "__v", "__w", F.aggregate("__ends", F.lit(0), lambda n, e: n + (e < F.col("__v").cast("double")).cast("int")).alias("__r"))
    group, upto = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("__r").rowsBetween(Window.unboundedPreceding, 0)
    sums = dealt.groupBy(*by, "__r").agg(F.sum("__w").alias("__s")).withColumns({"__upto": F.sum("__s").over(upto), "__all": F.sum("__s").over(group)})
    half = staged(sums.filter("2 * __upto >= __all").groupBy(*by).agg(F.min_by(F.struct("__r", (F.col("__upto") - F.col("__s")).alias("before"), "__all"), "__r").alias("__h")), "median-halves")
    inside = dealt.join(half, same(dealt, half) & (dealt["__r"] == half["__h.__r"])).groupBy(*[dealt[c] for c in by], "__h", "__v").agg(F.sum("__w").alias("__w"))
    order = Window.partitionBy(*by).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    reached = inside.withColumn("__upto", F.sum("__w").over(order) + F.col("__h.before")).filter(2 * F.col("__upto") >= F.col("__h.__all"))
    return reached.groupBy(*by).agg(F.min("__v").alias(to))


#: Rank error of the approximate percentiles that bracket an exact one, as a share of the group: 1 / ACCURACY.
ACCURACY = 10_000


def group_percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], more: list[Column] | None = None) -> DataFrame:
    """(by, each name, and the aggregates `more`): exact percentiles with linear interpolation, by group; nulls do not count.

    Approximate percentiles, which combine before the shuffle, bracket the two values that each exact
    one lies between; only rows inside a bracket are sorted, so a group's rows never meet in one task.
    """
    names = list(shares)
    ends = sorted({round(min(max(q + d / ACCURACY, 0.0), 1.0), 9) for q in shares.values() for d in (-3, 3)})
    rows = df.withColumn("__v", F.col(value).cast("double"))
    bounds = rows.groupBy(*by).agg(F.count("__v").alias("__n"), F.percentile_approx("__v", ends, ACCURACY).alias("__b"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), *(more or []))
    few = F.col("__n") <= ACCURACY  # such groups are sorted whole

    def end(q: float, d: int) -> Column:
        share = round(min(max(q + d / ACCURACY, 0.0), 1.0), 9)
        outer = F.col("__lo") if d < 0 else F.col("__hi")
        return F.when(few | F.lit(share in (0.0, 1.0)), outer).otherwise(F.get("__b", F.lit(ends.index(share))))

    brackets = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("q"), end(q, -3).alias("lo"), end(q, 3).alias("hi")) for n, q in shares.items()])
    bounds = staged(bounds.withColumn("__b", brackets), "brackets")
    same = [rows[c].eqNullSafe(bounds[c]) for c in by]
    met = rows.join(bounds.select(*by, "__n", "__b"), reduce(lambda a, b: a & b, same)) if by else rows.crossJoin(F.broadcast(bounds.select("__n", "__b")))
    met = met.filter("__v IS NOT NULL").select(*[rows[c] for c in by], "__v", "__n", F.explode("__b").alias("__k"))
    below = met.filter("__v < __k.lo").groupBy(*by, F.col("__k.name").alias("__name")).agg(F.count("*").alias("__below"))
    inside = met.filter("__v BETWEEN __k.lo AND __k.hi").groupBy(*by, F.col("__k.name").alias("__name"), F.col("__k.q").alias("__q"), "__n", "__v").agg(F.count("*").alias("__same"))
    order = Window.partitionBy(*by, "__name").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("__upto", F.sum("__same").over(order))
    pairs = [inside[c].eqNullSafe(below[c]) for c in (*by, "__name")]
    ranked = inside.join(below, reduce(lambda a, b: a & b, pairs), "left").select(*[inside[c] for c in by], inside["__name"], "__q", "__n", "__v", (F.col("__upto") + F.coalesce("__below", F.lit(0))).alias("__upto"))
    place = F.col("__q") * (F.col("__n") - 1)
    value_at = lambda rank: F.min(F.when(F.col("__upto") > rank, F.col("__v")))
    found = ranked.groupBy(*by, "__name").agg(value_at(F.floor(place)).alias("__a"), value_at(F.ceil(place)).alias("__c"), F.max(place - F.floor(place)).alias("__f"))
    each = found.groupBy(*by).agg(*[F.max(F.when(F.col("__name") == n, F.col("__a") + (F.col("__c") - F.col("__a")) * F.col("__f"))).alias(n) for n in names])
    if not by:
        return bounds.drop("__n", "__b", "__lo", "__hi").crossJoin(each) if more else each
    kept = bounds.drop("__n", "__b", "__lo", "__hi")
    both = kept.join(each, reduce(lambda a, b: a & b, [kept[c].eqNullSafe(each[c]) for c in by]), "left")
    return both.select(*[kept[c] for c in by], *[each[n] for n in names], *[kept[c] for c in kept.columns if c not in by])


def lorenz(df: DataFrame, key: str, population: str, points: str, ranges: int | None = None) -> DataFrame:
    """(key, x, y, px, py): cumulated shares of population and points by rising points per inhabitant, with the shares before; rows with nobody are left out."""
    rated = df.filter(F.col(population) > 0).withColumn("__rate", F.col(points) / F.col(population))
    summed = running_sums(rated, "__rate", [population, points], ties=[key], ranges=ranges)
    total = rated.agg(F.sum(population).alias("__p"), F.sum(points).alias("__q"))
    at = summed.crossJoin(F.broadcast(total))
    share = lambda c, t, less: (F.col(f"sum_{c}") - (F.col(c) if less else 0)) / F.col(t)
    return at.select(key, share(population, "__p", False).alias("x"), share(points, "__q", False).alias("y"), share(population, "__p", True).alias("px"), share(points, "__q", True).alias("py"))


def lorenz_at(curve: DataFrame, x: float = 0.5) -> DataFrame:
    """One row, `share`: the curve's height at x, by linear interpolation from the origin on."""
    inside = curve.filter((F.col("px") < x) & (F.col("x") >= x))
    return inside.agg(F.min(F.col("py") + (F.col("y") - F.col("py")) * (x - F.col("px")) / (F.col("x") - F.col("px"))).alias("share"))


def gini(curve: DataFrame, from_origin: bool = True) -> DataFrame:
    """One row, `gini`: 1 less twice the trapezoids under the curve; from_origin=False leaves the first one out."""
    area = F.when(F.lit(from_origin) | (F.col("px") > 0), (F.col("x") - F.col("px")) * (F.col("y") + F.col("py")))
    return curve.agg((1 - F.sum(area)).alias("gini"))


def log_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row, slope, intercept and r2 of log10(y) on log10(x); rows that are not positive are left out."""
    ok = df.filter((F.col(x) > 0) & (F.col(y) > 0)).select(F.log10(x).alias("lx"), F.log10(y).alias("ly"))
    return ok.agg(F.regr_slope("ly", "lx").alias("slope"), F.regr_intercept("ly", "lx").alias("intercept"), F.regr_r2("ly", "lx").alias("r2"))


def ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    """a / b x scale, null where b is 0 or null."""
    return F.when(b != 0, a / b * scale)
