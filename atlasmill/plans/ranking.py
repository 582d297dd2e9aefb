"""Queries on indices, sensitivity, concentration, models and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions.draws import sql_uniform
from ..operators import index as I
from ..operators import planning as P
from ..operators.checks import largest_gap
from ..operators.crosswalk import paired
from ..sources.staging import staged
from . import fixtures as X
from .access import SQL_PIP, SQL_ZD, active_branches, located, zone_centres, zone_distances
from .inventory import SQL_IND2, densities2, indicators2, rounded
from .registry import query
from ..operators.spatial import nearest_km
from ..functions.text import operators_of


def units(spark: SparkSession, d: str, near: DataFrame | None = None) -> DataFrame:
    """Indicators with distance_km, the area-weighted median distance of the unit's zones (`near`, if the caller has the zone distances)."""
    near = zone_distances(spark, d) if near is None else near
    far = S.weighted_median(near, ["level2"], "dist_km", "area_sqkm", "distance_km")
    return indicators2(spark, d, near).join(F.broadcast(far), "level2", "left")


def indexed(spark: SparkSession, d: str, near: DataFrame | None = None) -> DataFrame:
    return I.priority_index(units(spark, d, near), "level2")


SQL_UNITS = SQL_IND2 + "," + SQL_ZD + ", un AS MATERIALIZED (SELECT ind2.*, median_km AS distance_km FROM ind2 LEFT JOIN wm USING (level2))\n"
_MINMAX = "CASE WHEN {c} IS NULL THEN NULL WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) * 100 ELSE 50 END AS n_{n}"
_PCT = "CASE WHEN {c} IS NOT NULL THEN (rank() OVER (ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY {c}) - 1) / 2) / count({c}) OVER () * 100 END AS r_{n}"
_DIRS = {"d1": "inhabitants_per_point", "d2": "(-branches_per_100k)", "d3": "distance_km", "d4": "population"}
SQL_INDEX = SQL_UNITS + f""", cp AS (SELECT *, {', '.join(_MINMAX.format(c=c, n=n) for n, c in _DIRS.items())}, {', '.join(_PCT.format(c=c, n=n) for n, c in _DIRS.items())} FROM un),
sc AS (SELECT *, n_d1 * 0.3 + n_d2 * 0.25 + n_d3 * 0.25 + n_d4 * 0.2 AS score, r_d1 * 0.3 + r_d2 * 0.25 + r_d3 * 0.25 + r_d4 * 0.2 AS rank_score FROM cp),
ix AS MATERIALIZED (SELECT *, CASE WHEN score IS NOT NULL THEN floor(rank() OVER (ORDER BY score DESC NULLS LAST) + (count(*) OVER (PARTITION BY score) - 1) / 2)::BIGINT END AS rank FROM sc)
"""


@query(SQL_INDEX + "SELECT level2, rank, round(score, 6) AS score, round(rank_score, 6) AS rank_score, round(n_d1, 6) AS n_d1, round(n_d2, 6) AS n_d2, round(n_d3, 6) AS n_d3, round(n_d4, 6) AS n_d4 FROM ix")
def priority_index(spark: SparkSession, d: str) -> DataFrame:
    cols = ("score", "rank_score", "n_d1", "n_d2", "n_d3", "n_d4")
    return rounded(indexed(spark, d), cols).select("level2", "rank", *cols)


def _sql_weights(w: dict[str, float], prefix: str) -> str:
    return " + ".join(f"{prefix}{c} * {v!r}" for c, v in w.items() if v)


SQL_VARIANTS = ", vs AS (" + " UNION ALL ".join(f"SELECT '{n}' AS variant, level2, score AS reference, {_sql_weights(w, p)} AS value FROM ix WHERE score IS NOT NULL" for n, (w, p) in I.variants().items()) + """),
vr AS (SELECT variant, rank() OVER (PARTITION BY variant ORDER BY reference) + (count(*) OVER (PARTITION BY variant, reference) - 1) / 2 AS a, rank() OVER (PARTITION BY variant ORDER BY value) + (count(*) OVER (PARTITION BY variant, value) - 1) / 2 AS b,
 row_number() OVER (PARTITION BY variant ORDER BY reference DESC, level2) <= 10 AND row_number() OVER (PARTITION BY variant ORDER BY value DESC, level2) <= 10 AS in_both FROM vs)
"""


@query(SQL_INDEX + SQL_VARIANTS + "SELECT variant, round(corr(a, b), 6) AS spearman, count(*) FILTER (in_both) AS kept FROM vr GROUP BY 1")
def priority_variants(spark: SparkSession, d: str) -> DataFrame:
    scores = I.variant_scores(indexed(spark, d).filter("score IS NOT NULL"), "level2")
    return rounded(I.compared(scores, "variant", "level2", 10), ("spearman",))


# The number of draws, the law's shape and the seed.
DRAWS, SHAPE, SEED = 2000, 8, 20260908
GAP_SHAPE, GAP_SEED = 1, 20220


def _sql_draws(parts: int, shape: int, seed: int) -> str:
    return f"""en AS (SELECT draw, part, -ln({sql_uniform(seed, 'draw', 'part', 'k')}) AS e FROM range({DRAWS}) t(draw), range({parts}) p(part), range({shape}) s(k)),
gs AS (SELECT draw, part, sum(e) AS g FROM en GROUP BY 1, 2), ws AS (SELECT draw, {', '.join(f'max(g) FILTER (part = {k}) / sum(g) AS w{k}' for k in range(parts))} FROM gs GROUP BY 1)
"""


_RANKED = """rk AS (SELECT draw, {key}, rank() OVER (PARTITION BY draw ORDER BY value DESC) + (count(*) OVER (PARTITION BY draw, value) - 1) / 2 AS r FROM dr)
SELECT {key}, round(avg((r <= {k})::INT), 6) AS frequency, median(r) AS rank_median, min(r) AS rank_min, max(r) AS rank_max FROM rk GROUP BY 1"""


_SQL_ALL = SQL_INDEX + "," + _sql_draws(4, SHAPE, SEED) + ", dr AS (SELECT draw, level2, score AS reference, round(w0 * n_d1 + w1 * n_d2 + w2 * n_d3 + w3 * n_d4, 9) AS value FROM ws, ix WHERE score IS NOT NULL),"
_MEAN_SPEARMAN = """cr AS (SELECT draw, rank() OVER (PARTITION BY draw ORDER BY reference) + (count(*) OVER (PARTITION BY draw, reference) - 1) / 2 AS a, rank() OVER (PARTITION BY draw ORDER BY value) + (count(*) OVER (PARTITION BY draw, value) - 1) / 2 AS b FROM dr),
cs AS (SELECT draw, corr(a, b) AS s FROM cr GROUP BY 1) SELECT count(*) AS draws, round(avg(s), 6) AS mean_spearman FROM cs"""


def _all_priority(spark: SparkSession, d: str, near: DataFrame | None = None) -> tuple[DataFrame, str, list[str], DataFrame]:
    return indexed(spark, d, near).filter("score IS NOT NULL"), "level2", [f"n_{c}" for c in I.COMPONENTS], I.drawn_weights(spark, DRAWS, 4, SHAPE, SEED)


@query(_SQL_ALL + _RANKED.format(key="level2", k=10))
def priority_sensitivity(spark: SparkSession, d: str, near: DataFrame | None = None) -> DataFrame:
    return rounded(I.sensitivity(*_all_priority(spark, d, near), 10), ("frequency",))


@query(_SQL_ALL + _MEAN_SPEARMAN)
def priority_mean_spearman(spark: SparkSession, d: str) -> DataFrame:
    return rounded(I.mean_spearman(*_all_priority(spark, d), "score"), ("mean_spearman",))


@query("SELECT level2, frequency FROM (" + _SQL_ALL + _RANKED.format(key="level2", k=10) + ") WHERE frequency >= 0.9")
def priority_robust(spark: SparkSession, d: str, near: DataFrame | None = None) -> DataFrame:
    """The units among the first ten in nine of ten draws."""
    return I.robust(priority_sensitivity(spark, d, near)).select("level2", "frequency")


@query(SQL_INDEX + ", nw AS (SELECT level2, score, n_d1 * 0.1 + n_d2 * 0.2 + n_d3 * 0.5 + n_d4 * 0.2 AS new_score FROM ix WHERE score IS NOT NULL), rr AS (SELECT level2, new_score, rank() OVER (ORDER BY new_score DESC) AS new_rank, rank() OVER (ORDER BY score DESC) AS old_rank FROM nw) SELECT level2, round(new_score, 6) AS new_score, new_rank, old_rank - new_rank AS moved FROM rr")
def reweight(spark: SparkSession, d: str) -> DataFrame:
    return rounded(I.reweighted(indexed(spark, d).filter("score IS NOT NULL"), "level2", {"d1": 1, "d2": 2, "d3": 5, "d4": 2}), ("new_score",))


@query(SQL_INDEX + ", nw AS (SELECT level2, score, n_d1 * 0.25 + n_d2 * 0.15 + n_d3 * 0.15 + n_d4 * 0.45 AS new_score FROM ix WHERE score IS NOT NULL) SELECT level2, rank() OVER (ORDER BY score DESC) AS old_rank, rank() OVER (ORDER BY new_score DESC) AS new_rank, rank() OVER (ORDER BY score DESC) - rank() OVER (ORDER BY new_score DESC) AS moved FROM nw")
def rank_movement(spark: SparkSession, d: str) -> DataFrame:
    """The published ranking against one that stresses population, paired by unit; a unit without a partner would fail the job."""
    scored = indexed(spark, d).filter("score IS NOT NULL").select("level2", "score", *[f"n_{c}" for c in I.COMPONENTS])
    old = S.descending_rank(scored, "score", "place")
    new = S.descending_rank(scored.withColumn("other", I.composed(dict(zip(I.COMPONENTS, (0.25, 0.15, 0.15, 0.45), strict=True)))), "other", "place")
    return I.movement(old, new, "level2", "place")


@query(SQL_INDEX + """, pt AS (SELECT level2, score, n_d1 * 0.3 AS c_d1, n_d2 * 0.25 AS c_d2, n_d3 * 0.25 AS c_d3, n_d4 * 0.2 AS c_d4 FROM ix WHERE score IS NOT NULL), g AS (SELECT *, greatest(c_d1, c_d2, c_d3, c_d4) AS m FROM pt)
SELECT level2, round(c_d1, 6) AS c_d1, round(c_d2, 6) AS c_d2, round(c_d3, 6) AS c_d3, round(c_d4, 6) AS c_d4, CASE m WHEN c_d1 THEN 'd1' WHEN c_d2 THEN 'd2' WHEN c_d3 THEN 'd3' ELSE 'd4' END AS dominant, round(m / score, 6) AS dominant_share FROM g""")
def score_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return rounded(I.breakdown(indexed(spark, d).filter("score IS NOT NULL"), "level2"), ("c_d1", "c_d2", "c_d3", "c_d4", "dominant_share"))


@query(SQL_INDEX + ", pb AS (SELECT level2, round(score, 2) AS published FROM ix WHERE level2 <> 'FRANCE') SELECT count(published) AS paired, count(*) - count(published) AS missing, round(max(abs(score - published)), 6) AS max_gap FROM ix LEFT JOIN pb USING (level2)")
def published_gap(spark: SparkSession, d: str) -> DataFrame:
    now = indexed(spark, d)
    published = now.filter("level2 <> 'FRANCE'").select("level2", F.round("score", 2).alias("published"))
    return rounded(largest_gap(now, published, "level2", "score", "published"), ("max_gap",))


@query(SQL_INDEX + """, nw AS (SELECT level2, score, n_d1 * 0.3 + n_d2 * 0.25 + n_d3 * 0.25 + n_d4 * 0.2 AS again FROM ix WHERE score IS NOT NULL), rk AS (SELECT *, rank() OVER (ORDER BY score) AS a, rank() OVER (ORDER BY again) AS b FROM nw)
SELECT count(*) AS paired, round(max(abs(score - again)), 9) AS max_gap, round(corr(a, b), 9) AS spearman, max(abs(score - again)) < 1e-9 AND abs(corr(a, b) - 1) < 1e-9 AS ok FROM rk""")
def reweight_invariance(spark: SparkSession, d: str) -> DataFrame:
    """The reference's weights, given as a user's, against the published index (a written table), paired by unit: the same scores and ranks."""
    published = staged(indexed(spark, d).filter("score IS NOT NULL"), "published")
    again = I.reweighted(published, "level2", {c: 100 * w for c, w in I.WEIGHTS.items()}).select("level2", "new_score")
    both = paired(published.select("level2", "score"), again, "level2")
    ranked = both.select("score", "new_score", F.rank().over(Window.orderBy("score")).alias("a"), F.rank().over(Window.orderBy("new_score")).alias("b"))  # a row per unit
    gap, same = F.max(F.abs(F.col("score") - F.col("new_score"))), F.corr("a", "b")
    return ranked.agg(F.count("*").alias("paired"), F.round(gap, 9).alias("max_gap"), F.round(same, 9).alias("spearman"), ((gap < 1e-9) & (F.abs(same - 1) < 1e-9)).alias("ok"))


def gap_zones(spark: SparkSession, d: str, operator: str | None = None, status: str | None = None, near: DataFrame | None = None) -> DataFrame:
    """Zones with witnesses (of a status, if named), their density and operators, distance to a branch (`near`, if the caller has the zone distances) and population density of their unit; of one operator if named."""
    held = located(spark, d, status).withColumn("ops", operators_of(F.col("operators")))
    held = held.filter(F.array_contains("ops", operator)) if operator else held
    seen = held.groupBy("pcode").agg(F.count("*").alias("witnesses"), F.count_if(F.array_contains("ops", "OpA")).alias("wa"), F.count_if(F.array_contains("ops", "OpB")).alias("wb"))
    if operator:
        near = nearest_km(zone_centres(spark, d), active_branches(spark, d).filter(F.col("target_group") == operator), "pcode", carry=("level2", "area_sqkm"))
    elif near is None:
        near = zone_distances(spark, d)
    out = near.select("pcode", "level2", "area_sqkm", F.col("dist_km").alias("distance_km")).join(seen, "pcode", "left").na.fill(0, ["witnesses", "wa", "wb"])
    out = out.join(F.broadcast(densities2(spark, d, near).select("level2", "density")), "level2")
    return out.withColumns({"witness_density": F.col("witnesses") / F.col("area_sqkm") * 100, "n_operators": (F.col("wa") > 0).cast("int") + (F.col("wb") > 0).cast("int")}).drop("wa", "wb")


def _sql_gap(operator: str | None = None) -> str:
    have = f"WHERE contains(operators, '{operator}')" if operator else ""
    act = f"WHERE operator = '{operator}'" if operator else ""
    parts = ["r1", "r2", "r4"] if operator else ["r1", "r2", "r3", "r4"]
    pct = "CASE WHEN {c} IS NOT NULL THEN (rank() OVER (ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 - 1) / (count(*) OVER () - 1) * 100 END AS {n}"
    src = {"r1": "distance_km", "r2": "(-witness_density)", "r3": "(-n_operators)", "r4": "(-log10(density))"}
    sums = " + ".join(parts)
    s = "o" if operator else ""
    return f"""se{s} AS (SELECT pcode, count(*) AS witnesses, count(*) FILTER (contains(operators, 'OpA')) AS wa, count(*) FILTER (contains(operators, 'OpB')) AS wb FROM pz {have} GROUP BY 1),
dz{s} AS (SELECT pcode, min(sqrt((mx - b.x) * (mx - b.x) + (my - b.y) * (my - b.y))) / 1000 AS distance_km FROM zc CROSS JOIN (SELECT * FROM act {act}) b GROUP BY 1),
gz{s} AS (SELECT zc.pcode, zc.level2, area_sqkm, distance_km, coalesce(witnesses, 0) AS witnesses, coalesce(witnesses, 0) / area_sqkm * 100 AS witness_density, (coalesce(wa, 0) > 0)::INT + (coalesce(wb, 0) > 0)::INT AS n_operators, density
  FROM zc JOIN dz{s} USING (pcode) LEFT JOIN se{s} USING (pcode) JOIN (SELECT level2, density FROM ind2) i ON i.level2 = zc.level2),
gr{s} AS (SELECT *, {', '.join(pct.format(c=src[p], n=p) for p in parts)} FROM gz{s}),
gs0{s} AS (SELECT *, ({sums}) / {len(parts)} AS risk FROM gr{s}), ct{s} AS (SELECT quantile_cont(risk, 0.9) AS p90, quantile_cont(risk, 0.75) AS p75 FROM gs0{s}),
gp{s} AS MATERIALIZED (SELECT gs0{s}.*, CASE WHEN risk IS NOT NULL THEN rank() OVER (ORDER BY risk DESC NULLS LAST) END AS risk_rank, CASE WHEN risk >= p90 OR witnesses = 0 THEN 'high' WHEN risk >= p75 THEN 'watch' ELSE 'low' END AS class FROM gs0{s}, ct{s})
"""


SQL_GAP = SQL_IND2 + "," + SQL_ZD + ", pz AS MATERIALIZED " + SQL_PIP.split("pz AS ", 1)[1] + "," + _sql_gap()
#: The same with the points that are being set up as the only witnesses: some zones have none.
SQL_GAP_PENDING = SQL_GAP.replace("FROM pts JOIN zn", f"FROM (SELECT * FROM pts WHERE status = '{X.PENDING}') pts JOIN zn")
_GAP_COLS = ("distance_km", "witness_density", "r1", "r2", "r3", "r4", "risk")


@query(SQL_GAP + f"SELECT pcode, witnesses, n_operators, risk_rank, class, {', '.join(f'round({c}, 6) AS {c}' for c in _GAP_COLS)} FROM gp")
def coverage_gap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(I.gap_index(gap_zones(spark, d), "pcode"), _GAP_COLS).select("pcode", "witnesses", "n_operators", "risk_rank", "class", *_GAP_COLS)


@query(SQL_GAP + "," + _sql_gap("OpA") + "SELECT o.pcode, round(o.risk, 6) AS risk, o.class, o.class = 'high' AND g.class <> 'high' AS only_here FROM gpo o JOIN gp g USING (pcode)")
def coverage_gap_operator(spark: SparkSession, d: str) -> DataFrame:
    """The gap index of one operator, without the number of operators, and zones at risk for it alone."""
    own = I.gap_index(gap_zones(spark, d, "OpA"), "pcode", ("r1", "r2", "r4")).select("pcode", F.round("risk", 6).alias("risk"), "class")
    every = I.gap_index(gap_zones(spark, d), "pcode").select("pcode", F.col("class").alias("overall"))
    return own.join(every, "pcode").select("pcode", "risk", "class", ((F.col("class") == "high") & (F.col("overall") != "high")).alias("only_here"))


_SQL_ALL_GAP = SQL_GAP + "," + _sql_draws(4, GAP_SHAPE, GAP_SEED) + ", dr AS (SELECT draw, pcode, risk AS reference, round(w0 * r1 + w1 * r2 + w2 * r3 + w3 * r4, 9) AS value FROM ws, gp),"


def _all_gap(spark: SparkSession, d: str) -> tuple[DataFrame, str, list[str], DataFrame]:
    return I.gap_index(gap_zones(spark, d), "pcode"), "pcode", list(I.GAP_PARTS), I.drawn_weights(spark, DRAWS, 4, GAP_SHAPE, GAP_SEED)


@query(_SQL_ALL_GAP + _RANKED.format(key="pcode", k="(SELECT round_even(count(*) * 0.1, 0) FROM gp)"))
def gap_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """Frequency is that of the first tenth of the zones."""
    gaps, *rest = _all_gap(spark, d)
    return rounded(I.sensitivity(gaps, *rest, round(gaps.count() * 0.1)), ("frequency",))


@query(_SQL_ALL_GAP + _MEAN_SPEARMAN)
def gap_mean_spearman(spark: SparkSession, d: str) -> DataFrame:
    return rounded(I.mean_spearman(*_all_gap(spark, d), "risk"), ("mean_spearman",))


_GAP_LEFT = ", vs AS (" + " UNION ALL ".join(f"SELECT 'without_{x}' AS variant, pcode, round(risk, 9) AS reference, round(({' + '.join(p for p in I.GAP_PARTS if p != x)}) / 3, 9) AS value FROM gp" for x in I.GAP_PARTS) + """),
vr AS (SELECT variant, rank() OVER (PARTITION BY variant ORDER BY reference) + (count(*) OVER (PARTITION BY variant, reference) - 1) / 2 AS a, rank() OVER (PARTITION BY variant ORDER BY value) + (count(*) OVER (PARTITION BY variant, value) - 1) / 2 AS b,
 row_number() OVER (PARTITION BY variant ORDER BY reference DESC, pcode) <= n AND row_number() OVER (PARTITION BY variant ORDER BY value DESC, pcode) <= n AS in_both FROM vs, (SELECT round_even(count(*) * 0.1, 0) AS n FROM gp))
"""


@query(SQL_GAP + _GAP_LEFT + "SELECT variant, round(corr(a, b), 6) AS spearman, count(*) FILTER (in_both) AS kept FROM vr GROUP BY 1")
def gap_variants(spark: SparkSession, d: str) -> DataFrame:
    """The gap index with one part left out: rank correlation, and how many of its first tenth stay."""
    gaps = I.gap_index(gap_zones(spark, d), "pcode")
    return rounded(I.compared(I.gap_variant_scores(gaps, "pcode"), "variant", "pcode", round(gaps.count() * 0.1)), ("spearman",))


def sql_hotspots(k: int) -> str:
    return f", hz AS (SELECT level2, count(*) FILTER (class = 'high') AS high_zones, round(sum(CASE WHEN class = 'high' THEN area_sqkm ELSE 0 END) / sum(area_sqkm), 6) AS high_area_share FROM gp GROUP BY 1) SELECT * FROM hz WHERE high_zones > 0 ORDER BY high_zones DESC, level2 LIMIT {k}"


def hotspots(gaps: DataFrame, k: int) -> DataFrame:
    """The k units with most high-risk zones, and the share of their area in them."""
    high = F.col("class") == "high"
    by_unit = gaps.groupBy("level2").agg(F.count_if(high).alias("high_zones"), F.round(F.sum(F.when(high, F.col("area_sqkm")).otherwise(0.0)) / F.sum("area_sqkm"), 6).alias("high_area_share"))
    return by_unit.filter("high_zones > 0").orderBy(F.desc("high_zones"), "level2").limit(k)


@query(SQL_GAP + sql_hotspots(5))
def gap_hotspots(spark: SparkSession, d: str) -> DataFrame:
    return hotspots(I.gap_index(gap_zones(spark, d), "pcode"), 5)


SQL_LORENZ = """, lz AS (SELECT level2, population AS p, points AS q, sum(population) OVER o / (SELECT sum(population) FROM {t} WHERE population > 0) AS x, sum(points) OVER o / (SELECT sum(points) FROM {t} WHERE population > 0) AS y, population / (SELECT sum(population) FROM {t} WHERE population > 0) AS dx, points / (SELECT sum(points) FROM {t} WHERE population > 0) AS dy
 FROM {t} WHERE population > 0 WINDOW o AS (ORDER BY points / population, level2 ROWS UNBOUNDED PRECEDING))
"""


@query(SQL_IND2 + SQL_LORENZ.format(t="ind2") + "SELECT round(min((y - dy) + dy * (0.5 - (x - dx)) / dx), 6) AS share FROM lz WHERE x >= 0.5 AND x - dx < 0.5")
def lorenz_half(spark: SparkSession, d: str) -> DataFrame:
    """The share of the points that the worst served half of the population has."""
    return rounded(S.lorenz_at(S.lorenz(indicators2(spark, d), "level2", "population", "points")), ("share",))


@query(SQL_IND2 + SQL_LORENZ.format(t="ind2") + "SELECT round(1 - sum(dx * (y + y - dy)), 6) AS gini FROM lz")
def gini_index(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.gini(S.lorenz(indicators2(spark, d), "level2", "population", "points")), ("gini",))


@query(SQL_IND2 + SQL_LORENZ.format(t="ind2") + "SELECT round(1 - (SELECT sum(dx * (y + y - dy)) FROM (SELECT *, row_number() OVER (ORDER BY q / p, level2) AS n FROM lz) WHERE n > 1), 6) AS gini")
def gini_without_origin(spark: SparkSession, d: str) -> DataFrame:
    """The form that starts at the curve's first point, not at the origin."""
    return rounded(S.gini(S.lorenz(indicators2(spark, d), "level2", "population", "points"), from_origin=False), ("gini",))


@query("WITH ind2 AS (SELECT l_orderkey::VARCHAR AS level2, sum(l_quantity)::BIGINT AS population, count(*) AS points FROM lineitem GROUP BY 1)" + SQL_LORENZ.format(t="ind2") + "SELECT round(1 - sum(dx * (y + y - dy)), 6) AS gini FROM lz")
def gini_of_many(spark: SparkSession, d: str) -> DataFrame:
    """The same over every order: running sums by ranges, no single sort."""
    rows = X.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("level2")).agg(F.sum("l_quantity").cast("long").alias("population"), F.count("*").alias("points"))
    return rounded(S.gini(S.lorenz(rows, "level2", "population", "points", ranges=S.RANGES)), ("gini",))


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice, round((rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2) / count(*) OVER () * 100, 6) AS price_rank FROM lineitem""")
def price_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Percent ranks over every line item: ranges of distinct prices, no single sort."""
    rows = X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return rounded(S.percent_rank_of(rows, "l_extendedprice", "price_rank", ranges=S.RANGES), ("price_rank",))


SQL_FIT = """, ft AS (SELECT regr_slope(log10(points_per_10k), log10(density)) AS slope, regr_intercept(log10(points_per_10k), log10(density)) AS intercept, regr_r2(log10(points_per_10k), log10(density)) AS r2 FROM ind2 WHERE density > 0 AND points_per_10k > 0)
"""


@query(SQL_IND2 + SQL_FIT + "SELECT round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2 FROM ft")
def density_fit(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.log_fit(indicators2(spark, d), "density", "points_per_10k"), ("slope", "intercept", "r2"))


@query(SQL_IND2 + SQL_FIT + """, ex AS (SELECT level2, population, points_per_10k, pow(10, intercept + slope * log10(density)) AS expected FROM ind2, ft)
SELECT level2, round(expected, 6) AS expected, round(points_per_10k / expected - 1, 6) AS gap, greatest(ceil(population / 1e4 * (expected - coalesce(points_per_10k, 0))), 0)::BIGINT AS missing, points_per_10k / expected - 1 <= -0.3 AS under_equipped FROM ex""")
def density_model(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.density_model(indicators2(spark, d), "density", "points_per_10k", "population"), ("expected", "gap")).select("level2", "expected", "gap", "missing", "under_equipped")


@query(SQL_IND2 + """, rk AS (SELECT rank() OVER (ORDER BY density) + (count(*) OVER (PARTITION BY density) - 1) / 2 AS a, rank() OVER (ORDER BY points_per_10k) + (count(*) OVER (PARTITION BY points_per_10k) - 1) / 2 AS b FROM ind2 WHERE density IS NOT NULL AND points_per_10k IS NOT NULL) SELECT round(corr(a, b), 6) AS spearman FROM rk""")
def density_spearman(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.spearman(indicators2(spark, d), "density", "points_per_10k"), ("spearman",))


@query(SQL_IND2 + "SELECT level2, population, points FROM ind2 WHERE population / nullif(points, 0) > (SELECT sum(population) / sum(points) FROM ind2) AND population > (SELECT median(population) FROM ind2)")
def quadrant(spark: SparkSession, d: str) -> DataFrame:
    return P.critical_quadrant(indicators2(spark, d)).select("level2", "population", "points")


@query(SQL_INDEX + """, op AS (SELECT level2, rank, population, greatest(ceil(population / 409.0)::BIGINT - points, 0) AS opened, (active_branches = 0)::BIGINT AS extra_branch FROM ix WHERE rank <= 9)
SELECT level2, rank, opened, extra_branch, sum(opened) OVER w::BIGINT AS sum_opened, sum(population) OVER w::BIGINT AS sum_population, sum(extra_branch) OVER w::BIGINT AS sum_extra_branch FROM op WINDOW w AS (ORDER BY rank, level2 ROWS UNBOUNDED PRECEDING)""")
def coverage_plan(spark: SparkSession, d: str) -> DataFrame:
    plan = P.coverage_plan(indexed(spark, d), "level2", "rank", 409.0, 9)
    return plan.select("level2", "rank", "opened", "extra_branch", "sum_opened", "sum_population", "sum_extra_branch")


SQL_LEVERS = SQL_UNITS + """, lv AS (SELECT level2, population, active_branches = 0 AS no_branch, coalesce(inhabitants_per_point > 800, false) AS few_points, coalesce(distance_km >= 25, false) AS far_away, points_a = 0 OR points_b = 0 AS single_operator, coalesce(points_unknown / nullif(points, 0) > 0.15, false) AS unknown_operators FROM un)
"""


@query(SQL_LEVERS + " UNION ALL ".join(f"SELECT '{n}' AS lever, count(*) AS n_units, sum(population)::BIGINT AS population FROM lv WHERE {n} HAVING count(*) > 0" for n in P.LEVERS))
def action_levers(spark: SparkSession, d: str) -> DataFrame:
    return P.lever_rows(P.levers(units(spark, d))).groupBy("lever").agg(F.count("*").alias("n_units"), F.sum("population").alias("population"))


@query(SQL_LEVERS + f"SELECT level2, {', '.join(P.LEVERS)} FROM lv")
def lever_matrix(spark: SparkSession, d: str) -> DataFrame:
    return P.lever_matrix(P.levers(units(spark, d)), "level2", list(P.LEVERS))
