"""Unions of exports, dedupe under stable ids, source overlap, exploding of operators, counts by unit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio


def union_exports(exports: list[tuple[str, DataFrame]]) -> DataFrame:
    """All rows, with the export's name (source) and its place in the list (src_rank)."""
    tagged = [df.withColumns({"source": F.lit(name), "src_rank": F.lit(k)}) for k, (name, df) in enumerate(exports)]
    return reduce(DataFrame.unionByName, tagged)


def keep_first(df: DataFrame, key: list[str], order: list[str], listing: str | None = None) -> DataFrame:
    """The first row of each key in the given order; with `listing`, `present_in` lists that column's distinct values.

    A grouped minimum, so that rows meet only their task's best before the shuffle.
    """
    rest = [c for c in df.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("__first")
    more = [F.concat_ws(", ", F.array_sort(F.collect_set(listing))).alias("present_in")] if listing else []
    return df.groupBy(*key).agg(first, *more).select(*key, "__first.*", *(["present_in"] if listing else []))


def source_overlap(rows: DataFrame, key: list[str], source: str = "source") -> DataFrame:
    """(a, b, n): keys that sources a <= b have in common; n with a = b is a's own number. Keys are grouped, not joined."""
    sets = rows.groupBy(*key).agg(F.array_sort(F.collect_set(source)).alias("s"))
    return sets.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).filter("a <= b").groupBy("a", "b").agg(F.count("*").alias("n"))


def exclusive_to(rows: DataFrame, key: list[str], source: str = "source") -> DataFrame:
    """(source, n): keys that only this source has."""
    sets = rows.groupBy(*key).agg(F.collect_set(source).alias("s")).filter(F.size("s") == 1)
    return sets.groupBy(F.col("s")[0].alias("source")).agg(F.count("*").alias("n"))


def with_unit_counts(base: DataFrame, rows: DataFrame, unit: list[str], counts: dict[str, Column]) -> DataFrame:
    """`base` with conditional counts of `rows` by unit: every unit stays, and what it lacks is a true zero."""
    sums = rows.groupBy(*unit).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    return base.join(sums, unit, "left").na.fill(0, list(counts))


def value_shares(rows: DataFrame, column: str) -> DataFrame:
    """(column, n, share): counts by value, nulls included, and their share of all rows."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("__t")))).select(column, "n", (F.col("n") / F.col("__t")).alias("share"))


def access_ratios(df: DataFrame, reliable: Column | None = None) -> DataFrame:
    """Inhabitants per point, points per 10,000 and branches per 100,000 inhabitants; null where they cannot be told."""
    known = F.lit(True) if reliable is None else reliable
    pop, points, active = F.col("population"), F.col("points"), F.col("active_branches")
    return df.withColumns({
        "inhabitants_per_point": F.when(known, ratio(pop, points)),
        "points_per_10k": F.when(known, ratio(points, pop, 1e4)),
        "branches_per_100k": F.when(known, ratio(active, pop, 1e5)),
    })


def in_scope(df: DataFrame, **levels: list) -> DataFrame:
    """Rows whose column is in each list; an empty list stands for all."""
    for column, chosen in levels.items():
        if chosen:
            df = df.filter(F.col(column).isin(*chosen))
    return df


def within_box_of(cells: DataFrame, scope: DataFrame, x: str, y: str) -> DataFrame:
    """Cells inside the box around the scope's positions."""
    box = scope.agg(F.min(x).alias("__x0"), F.max(x).alias("__x1"), F.min(y).alias("__y0"), F.max(y).alias("__y1"))
    return cells.crossJoin(F.broadcast(box)).filter(F.col(x).between(F.col("__x0"), F.col("__x1")) & F.col(y).between(F.col("__y0"), F.col("__y1"))).drop("__x0", "__x1", "__y0", "__y1")


def top_per_parent(df: DataFrame, parent: str, value: str, key: str, k: int = 1) -> DataFrame:
    """The k children with the largest value in each parent; ties go to the smaller key. Spark stops ranking at k in each task."""
    order = [F.desc_nulls_last(value), F.col(key)]
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(parent).orderBy(*order))).filter(F.col("__n") <= k).drop("__n")


def top_k(df: DataFrame, value: str, key: str, k: int, largest: bool = True) -> DataFrame:
    """The k rows with the largest (or smallest) value; ties go to the smaller key."""
    return df.orderBy(F.desc_nulls_last(value) if largest else F.asc_nulls_last(value), key).limit(k)


def name_join(left: DataFrame, right: DataFrame, left_name: str, right_name: str, key) -> DataFrame:
    """Left join on the names' normalised key; right columns are null where no name fits."""
    return left.withColumn("__key", key(F.col(left_name))).join(right.withColumn("__key", key(F.col(right_name))), "__key", "left").drop("__key")
