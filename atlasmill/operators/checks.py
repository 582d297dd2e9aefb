"""Data-quality checks: each gives rows (step, name, ok, detail); profiles of columns, positions and hierarchies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import at_null_island, outside_box
from ..functions.text import is_null_token, stripped


#: Sample values of a column.
SAMPLES = 4
#: A check's name, whether it holds and its detail, as aggregates over one table.
Check = tuple[str, Column, Column]


def checked(df: DataFrame, step: str, *checks: Check) -> DataFrame:
    """A row per check, all from one aggregation of df; an aggregate that is null counts as failed."""
    rows = [F.struct(F.lit(name).alias("name"), F.coalesce(ok, F.lit(False)).alias("ok"), F.coalesce(detail.cast("string"), F.lit("")).alias("detail")) for name, ok, detail in checks]
    return df.agg(F.array(*rows).alias("c")).select(F.lit(step).alias("step"), F.explode("c").alias("c")).select("step", "c.*")


def has_count(expected: int) -> Check:
    return f"rows = {expected}", F.count("*") == expected, F.count("*")


def is_complete(column: str) -> Check:
    n = F.count_if(F.col(column).isNull())
    return f"{column} is complete", n == 0, n


def is_unique(column: str) -> Check:
    n = F.count(column) - F.countDistinct(column)
    return f"{column} is unique", n == 0, n


def is_share(name: str, condition: Column, least: float) -> Check:
    share = F.avg(condition.cast("double"))
    return name, share >= least, F.round(share, 6)


def no_estimate(flagged: Column, columns: list[str]) -> Check:
    """Flagged rows have no value in these columns."""
    n = F.count_if(flagged & reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns]))
    return "flagged rows have null ratios", n == 0, n


def check(df: DataFrame, step: str, name: str, ok: Column, detail: Column) -> DataFrame:
    return checked(df, step, (name, ok, detail))


def has_rows(df: DataFrame, step: str, expected: int) -> DataFrame:
    return checked(df, step, has_count(expected))


def complete(df: DataFrame, step: str, column: str) -> DataFrame:
    return checked(df, step, is_complete(column))


def unique(df: DataFrame, step: str, column: str) -> DataFrame:
    return checked(df, step, is_unique(column))


def share_at_least(df: DataFrame, step: str, name: str, condition: Column, least: float) -> DataFrame:
    return checked(df, step, is_share(name, condition, least))


def same_sum(a: DataFrame, x: str, b: DataFrame, y: str, step: str, name: str, tolerance: float = 0) -> DataFrame:
    """Conservation: both tables' sums agree."""
    both = a.agg(F.sum(x).alias("p")).crossJoin(b.agg(F.sum(y).alias("q")))
    return check(both, step, name, F.max(F.abs(F.col("p") - F.col("q"))) <= tolerance, F.max(F.abs(F.col("p") - F.col("q"))))


def same_keys(a: DataFrame, b: DataFrame, key: str, step: str, name: str) -> DataFrame:
    """No key is lost or added: symmetric difference is empty."""
    sides = a.select(key).distinct().withColumn("a", F.lit(1)).unionByName(b.select(key).distinct().withColumn("a", F.lit(2)))
    odd = sides.groupBy(key).agg(F.sum("a").alias("s"))
    n = F.count_if(F.col("s") != 3)
    return check(odd, step, name, n == 0, n)


def nulls_where(df: DataFrame, step: str, flagged: Column, columns: list[str]) -> DataFrame:
    return checked(df, step, no_estimate(flagged, columns))


def registry(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def tally(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if("ok").alias("n_ok"), F.count("*").alias("n_checks"))


def column_profile(df: DataFrame) -> DataFrame:
    """A row per column: rows, nulls, null_tokens, distinct_values, dirty_edges, smallest and largest value as text, and samples. One pass.

    samples are up to SAMPLES different values, sorted and joined by ` | `: for each of so many parts of
    a value's md5, the value with the smallest. They are the same however the rows are dealt out.
    """

    def samples(c: str) -> Column:
        digest = F.md5(F.col(c).cast("binary"))
        least = [F.min(F.concat(F.substring(digest, 1 + 8 * k, 8), F.col(c))) for k in range(SAMPLES)]
        return F.concat_ws(" | ", F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.substring(x, 9, 1 << 30) for x in least])))))

    text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    parts = [
        F.struct(
            F.lit(c).alias("column"), F.count("*").alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count_if(F.col(c).isNotNull() & is_null_token(F.col(c))).alias("null_tokens"),
            F.countDistinct(c).alias("distinct_values"), F.count_if(F.col(c) != stripped(F.col(c))).alias("dirty_edges"), F.min(c).alias("smallest"), F.max(c).alias("largest"), samples(c).alias("samples"),
        )
        for c in df.columns
    ]
    return text.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def geometry_profile(df: DataFrame, lon: str, lat: str, box: tuple[float, float, float, float]) -> DataFrame:
    """One row: extent, rows outside the box, at (0, 0), and rows at a position that others share."""
    west, south, east, north = box
    shared = df.groupBy(lon, lat).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("at_shared_positions"))
    flat = df.agg(
        F.min(lon).alias("west"), F.max(lon).alias("east"), F.min(lat).alias("south"), F.max(lat).alias("north"),
        F.count_if(outside_box(F.col(lon), F.col(lat), west, south, east, north)).alias("outside"), F.count_if(at_null_island(F.col(lon), F.col(lat))).alias("at_null_island"),
    )
    return flat.crossJoin(shared)


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """One row: duplicate rows by key, and by all columns but the key."""
    rest = [c for c in df.columns if c not in key]
    extra = lambda cols: df.groupBy(*cols).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n"))
    return extra(key).withColumnRenamed("n", "by_key").crossJoin(extra(rest).withColumnRenamed("n", "by_content"))


def inventory(expected: DataFrame, listing: DataFrame, key: list[str]) -> DataFrame:
    """Expected (dataset, format) pairs with status: present, empty or missing. `listing` has the key and n_rows."""
    status = F.when(F.col("n_rows").isNull(), "missing").when(F.col("n_rows") == 0, "empty").otherwise("present")
    return expected.join(listing, key, "left").withColumn("status", status)


def provenance(expected: DataFrame, catalogue: DataFrame, key: str, is_open: str) -> DataFrame:
    """Expected ids with status in the catalogue: open, closed or not found."""
    status = F.when(F.col(is_open).isNull(), "not found").when(F.col(is_open), "open").otherwise("closed")
    return expected.join(catalogue.select(key, is_open), key, "left").select(key, status.alias("status"))


def largest_gap(a: DataFrame, b: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """One row: paired, missing and max_gap of a recomputed value against the published one, by key."""
    both = a.select(key, F.col(x).alias("__x")).join(b.select(key, F.col(y).alias("__y")), key, "left")
    return both.agg(F.count("__y").alias("paired"), F.count_if(F.col("__y").isNull()).alias("missing"), F.max(F.abs(F.col("__x") - F.col("__y"))).alias("max_gap"))
