"""Names and codes between references: canonical spelling, code fusion, votes, spread of children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical(rows: DataFrame, reference: DataFrame, name: str, ref_name: str, key, to: str) -> DataFrame:
    """Adds `to`: the reference's spelling of the name, or the name itself where the reference has none."""
    refs = reference.select(key(F.col(ref_name)).alias("__key"), F.col(ref_name).alias("__ref")).groupBy("__key").agg(F.min("__ref").alias("__ref"))
    return rows.withColumn("__key", key(F.col(name))).join(refs, "__key", "left").withColumn(to, F.coalesce("__ref", F.col(name))).drop("__key", "__ref")


def missing_both_ways(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(side, key): keys of one side that the other lacks."""
    only_a = a.select(key).distinct().join(b.select(key), key, "left_anti").select(F.lit("left").alias("side"), key)
    return only_a.unionByName(b.select(key).distinct().join(a.select(key), key, "left_anti").select(F.lit("right").alias("side"), key))


def fused(units: DataFrame, code: str, order: str, first: list[str], sums: list[str], lists: list[str]) -> DataFrame:
    """One row per code: first attributes by `order`, sums, and distinct sorted lists joined by " + "."""
    return units.groupBy(code).agg(
        *[F.min_by(c, order).alias(c) for c in first], *[F.sum(c).alias(c) for c in sums], *[F.concat_ws(" + ", F.array_sort(F.collect_set(c))).alias(c) for c in lists]
    )


def majority(votes: DataFrame, zone: str, unit: str, least: float = 0.80) -> DataFrame:
    """(zone, unit, votes, total, confidence, status): the unit with most votes in each zone; ties go to the smaller name. status: sure, split or none."""
    counts = votes.groupBy(zone, unit).agg(F.count("*").alias("n"))
    cast = counts.filter(F.col(unit).isNotNull()).groupBy(zone).agg(F.min_by(F.struct(unit, "n"), F.struct((-F.col("n")).alias("v"), F.col(unit).alias("u"))).alias("best"), F.sum("n").alias("total"))
    out = votes.select(zone).distinct().join(cast, zone, "left").select(zone, F.col(f"best.{unit}").alias(unit), F.coalesce("best.n", F.lit(0)).alias("votes"), F.coalesce("total", F.lit(0)).alias("total"))
    confidence = F.when(F.col("total") > 0, F.col("votes") / F.col("total"))
    return out.withColumn("confidence", confidence).withColumn("status", F.when(F.col("confidence") >= least, "sure").when(F.col("total") > 0, "split").otherwise("none"))


def children_spread(rows: DataFrame, parent: str, child: str) -> DataFrame:
    """One row: min_n, median_n and max_n of distinct children per parent, and the parent with most (ties: the smaller name)."""
    counts = rows.groupBy(parent).agg(F.countDistinct(child).alias("n"))
    return counts.agg(F.min("n").alias("min_n"), F.median("n").alias("median_n"), F.max("n").alias("max_n"), F.min_by(parent, F.struct((-F.col("n")).alias("v"), F.col(parent).alias("p"))).alias("most"))


def shared_values(units: DataFrame, published: DataFrame, unit: str, label: str, value: str) -> DataFrame:
    """Published values on units; a label `A + B` stands for both: each gets the whole value and `shared_with` names the label. Nothing is divided."""
    rows = published.select(F.explode(F.split(label, r"\s*\+\s*")).alias(unit), F.col(label).alias("__label"), F.col(value).alias(value))
    return units.join(rows, unit, "left").withColumn("shared_with", F.when(F.col("__label") != F.col(unit), F.col("__label"))).drop("__label")


def attached_by_prefix(units: DataFrame, shared: DataFrame, unit: str, prefix: str, label: str, value: str) -> DataFrame:
    """Adds `value` and `shared_with` to units whose name begins with a prefix of `shared` (prefix, label, value); of several the longest counts.

    One published total stands for all of those units: each gets the whole value and the label that
    says so; nothing is divided. Units without such a prefix have null in both. The join is on the
    name's first characters, for each length that prefixes have, so no unit meets a prefix it does not
    begin with. Of equal prefixes the smallest (label, value) counts.
    """
    once = shared.filter(F.length(prefix) > 0).groupBy(F.col(prefix).alias("__prefix")).agg(F.min(F.struct(F.col(label).alias("label"), F.col(value).alias("value"))).alias("__found"))
    lengths = once.agg(F.array_sort(F.collect_set(F.length("__prefix"))).alias("__lengths"))  # as many as a prefix has characters at most
    keys = units.select(unit).distinct().crossJoin(F.broadcast(lengths)).select(unit, F.explode("__lengths").alias("__n")).filter(F.length(unit) >= F.col("__n"))
    met = keys.withColumn("__prefix", F.expr(f"substring(`{unit}`, 1, __n)")).join(once, "__prefix")
    best = met.groupBy(unit).agg(F.max_by("__found", "__n").alias("__found"))
    return units.join(best, unit, "left").withColumns({value: F.col("__found.value"), "shared_with": F.col("__found.label")}).drop("__found")


def paired(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of both sides by key, never by position. A key that one side lacks, or holds twice, fails the job where the rows are made."""
    left, right = (side.withColumn("__n", F.count("*").over(Window.partitionBy(key))) for side in (a, b))
    both = left.withColumnRenamed("__n", "__a").join(right.withColumnRenamed("__n", "__b"), key, "full")
    wrong = F.col("__a").isNull() | F.col("__b").isNull() | (F.col("__a") > 1) | (F.col("__b") > 1)
    message = F.concat(F.lit(f"{key} is not on both sides once: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return both.withColumn("__ok", F.when(wrong, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))).filter("__ok").drop("__a", "__b", "__ok")


def agreement(rows: DataFrame, declared: str, found: str) -> Column:
    """Share of rows with a finding that agree with it."""
    return F.avg(F.when(F.col(found).isNotNull(), (F.col(declared) == F.col(found)).cast("double")))


def several_parents(rows: DataFrame, child: str, parent: str) -> DataFrame:
    """(child, n_parents): children under more than one parent."""
    return rows.groupBy(child).agg(F.countDistinct(parent).alias("n_parents")).filter("n_parents > 1")


def spelling_variants(rows: DataFrame, name: str, key: Column) -> DataFrame:
    """(key, n_spellings, spellings): keys that stand for several raw names."""
    return rows.select(key.alias("key"), F.col(name).alias("n")).groupBy("key").agg(F.countDistinct("n").alias("n_spellings"), F.concat_ws(", ", F.array_sort(F.collect_set("n"))).alias("spellings")).filter("n_spellings > 1")


