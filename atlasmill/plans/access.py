"""Queries on projection, polygons, nearest facilities, distance profiles and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import grid, projected, unprojected
from ..functions.stats import group_percentiles, weighted_median
from ..functions.text import operators_of
from ..operators.crosswalk import agreement, majority
from ..operators.spatial import nearest_km, point_in_polygon
from ..sources.staging import staged
from . import fixtures as X
from .inventory import PRELUDE, branches
from .registry import query

#: Side of the cells of point-in-polygon joins, in micro-degrees.
SIDE = 100_000.0
#: Step of the grid of void cells, in metres.
STEP = 1_000.0


def active_branches(spark: SparkSession, d: str) -> DataFrame:
    """(x, y, target_group) of the branches that are open, one group per operator."""
    return X.metres(branches(spark, d).filter("active")).select("x", "y", F.col("operator").alias("target_group"))


def zone_centres(spark: SparkSession, d: str) -> DataFrame:
    """zones with area_sqkm and their centre's grid position."""
    z = X.with_area(X.zones(spark, d)).withColumn("area_sqkm", F.round("area_sqkm", 6))
    ring = F.col("rings")[0]
    x, y = projected((ring[0]["x"] + ring[2]["x"]) / 2e6, (ring[0]["y"] + ring[2]["y"]) / 2e6)
    return z.withColumns({"x": x, "y": y})


def located(spark: SparkSession, d: str, status: str | None = None) -> DataFrame:
    """(id, level2, pcode, found2): service points (of a status) and the zone that holds them."""
    z = X.zones(spark, d).select("pcode", F.col("level2").alias("found2"), "rings")
    return point_in_polygon(X.points(spark, d, status), z, SIDE, "lon_u", "lat_u").drop("rings")


SQL_PIP = PRELUDE + """pz AS (SELECT pts.*, pcode, zn.level2 AS found2 FROM pts JOIN zn ON lon_u > x0 AND lon_u < x1 AND lat_u > y0 AND lat_u < y1)
"""


@query(PRELUDE + "q AS (SELECT 1) SELECT id, round(x, 3) AS x, round(y, 3) AS y, lon_u / 1e6 AS lon, lat_u / 1e6 AS lat FROM pts")
def projected_points(spark: SparkSession, d: str) -> DataFrame:
    p = X.metres(X.points(spark, d))
    lon, lat = unprojected(F.col("x"), F.col("y"))
    return p.select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query(SQL_PIP + "SELECT id, pcode FROM pz")
def point_zone(spark: SparkSession, d: str) -> DataFrame:
    return located(spark, d).select("id", "pcode")


@query(SQL_PIP + "SELECT count(*) AS n, count(pcode) AS attached, round(count(pcode) / count(*), 6) AS attached_share, round(avg((level2 = found2)::INT), 6) AS agreement FROM pts LEFT JOIN (SELECT id, pcode, found2 FROM pz) USING (id)")
def spatial_agreement(spark: SparkSession, d: str) -> DataFrame:
    every = X.points(spark, d).select("id", "level2").join(located(spark, d).select("id", "pcode", "found2"), "id", "left")
    return every.agg(F.count("*").alias("n"), F.count("pcode").alias("attached"), F.round(F.count("pcode") / F.count("*"), 6).alias("attached_share"), F.round(agreement(every, "level2", "found2"), 6).alias("agreement"))


@query(SQL_PIP + """, c AS (SELECT pcode, level2, count(*) AS n FROM pz GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY pcode) AS total, row_number() OVER (PARTITION BY pcode ORDER BY n DESC, level2) AS k FROM c)
SELECT pcode, t.level2, coalesce(n, 0) AS votes, coalesce(total, 0)::BIGINT AS total, round(n / total, 6) AS confidence, CASE WHEN n / total >= 0.8 THEN 'sure' WHEN n > 0 THEN 'split' ELSE 'none' END AS status
FROM zn LEFT JOIN (SELECT * FROM t WHERE k = 1) t USING (pcode)""")
def zone_vote(spark: SparkSession, d: str) -> DataFrame:
    votes = X.zones(spark, d).select("pcode").join(located(spark, d).select("pcode", "level2"), "pcode", "left")
    return majority(votes, "pcode", "level2").withColumn("confidence", F.round("confidence", 6))


SQL_NEAR = PRELUDE + """act AS (SELECT * FROM br WHERE active),
nb AS MATERIALIZED (SELECT p.id, p.level2, min(sqrt((p.x - b.x) * (p.x - b.x) + (p.y - b.y) * (p.y - b.y))) / 1000 AS dist_km FROM pts p CROSS JOIN act b GROUP BY 1, 2)
"""


@query(SQL_NEAR + "SELECT id, round(dist_km, 6) AS dist_km FROM nb")
def nearest_branch(spark: SparkSession, d: str) -> DataFrame:
    return nearest_km(X.metres(X.points(spark, d)), active_branches(spark, d), "id").withColumn("dist_km", F.round("dist_km", 6))


@query(PRELUDE + """ctr AS (SELECT k, name, x, y FROM br) SELECT c.k AS id, round(min(sqrt((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y))) / 1000, 6) AS dist_km FROM ctr c CROSS JOIN pts p GROUP BY 1""")
def nearest_point_of_many(spark: SparkSession, d: str) -> DataFrame:
    """Both sides may be large: by cells of growing size."""
    b = X.metres(X.facilities(spark, d).filter("NOT data_centre")).select(F.col("k").alias("id"), "x", "y")
    return nearest_km(b, X.metres(X.points(spark, d)).select("x", "y"), "id").withColumn("dist_km", F.round("dist_km", 6))


@query(PRELUDE + """act AS (SELECT * FROM br WHERE active), zc AS (SELECT za.*, (x_0 + x_1) / 2 AS mx FROM za)
SELECT p.id, round(min(CASE WHEN operator = 'OpA' THEN sqrt((p.x - b.x) * (p.x - b.x) + (p.y - b.y) * (p.y - b.y)) END) / 1000, 6) AS dist_km_OpA,
round(min(CASE WHEN operator = 'OpB' THEN sqrt((p.x - b.x) * (p.x - b.x) + (p.y - b.y) * (p.y - b.y)) END) / 1000, 6) AS dist_km_OpB FROM pts p CROSS JOIN act b GROUP BY 1""")
def nearest_by_operator(spark: SparkSession, d: str) -> DataFrame:
    near = nearest_km(X.metres(X.points(spark, d)), active_branches(spark, d), "id", groups=["OpA", "OpB"])
    return near.withColumns({c: F.round(c, 6) for c in ("dist_km_OpA", "dist_km_OpB")})


@query(SQL_NEAR + """SELECT level2, count(*) AS n, round(median(dist_km), 6) AS median_km, round(quantile_cont(dist_km, 0.9), 6) AS p90_km, round(min(dist_km), 6) AS min_km, round(max(dist_km), 6) AS max_km,
round(avg((dist_km <= 5)::INT), 6) AS within_5, round(avg((dist_km <= 10)::INT), 6) AS within_10, round(avg((dist_km <= 20)::INT), 6) AS within_20 FROM nb GROUP BY 1""")
def distance_profile(spark: SparkSession, d: str) -> DataFrame:
    near = nearest_km(X.metres(X.points(spark, d)), active_branches(spark, d), "id", carry=("level2",))
    within = [F.round(F.avg((F.col("dist_km") <= s).cast("double")), 6).alias(f"within_{s}") for s in (5, 10, 20)]
    sums = [F.count("*").alias("n"), F.round(F.min("dist_km"), 6).alias("min_km"), F.round(F.max("dist_km"), 6).alias("max_km"), *within]
    found = group_percentiles(staged(near, "distances"), ["level2"], "dist_km", {"median_km": 0.5, "p90_km": 0.9}, sums)
    return found.withColumns({c: F.round(c, 6) for c in ("median_km", "p90_km")})


def zone_distances(spark: SparkSession, d: str) -> DataFrame:
    """(pcode, k2, level2, area_sqkm, dist_km): zones with their distance to the nearest active branch, written once."""
    return staged(nearest_km(zone_centres(spark, d), active_branches(spark, d), "pcode", carry=("k2", "level2", "area_sqkm")), "zone-distances")


_MX, _MY = X.sql_projected(f"((x0 + {X.CELL_W // X.PARTS // 2}) / 1e6)", f"((y0 + {X.CELL_H // X.PARTS // 2}) / 1e6)")
SQL_ZD = f"""act AS (SELECT * FROM br WHERE active),
zc AS MATERIALIZED (SELECT pcode, k2, level2, round(area_sqkm, 6) AS area_sqkm, {_MX} AS mx, {_MY} AS my FROM za),
zd AS MATERIALIZED (SELECT pcode, zc.k2, zc.level2, area_sqkm, min(sqrt((mx - b.x) * (mx - b.x) + (my - b.y) * (my - b.y))) / 1000 AS dist_km FROM zc CROSS JOIN act b GROUP BY 1, 2, 3, 4),
wm AS MATERIALIZED (SELECT level2, k2, min(dist_km) FILTER (share >= 0.5) AS median_km FROM
     (SELECT *, sum(w) OVER (PARTITION BY level2 ORDER BY dist_km) / sum(w) OVER (PARTITION BY level2) AS share FROM (SELECT level2, k2, dist_km, sum(area_sqkm) AS w FROM zd GROUP BY 1, 2, 3)) GROUP BY 1, 2)
"""


@query(PRELUDE + SQL_ZD + """, m AS (SELECT zd.level2, zd.k2, median_km, max(dist_km) AS max_km FROM zd JOIN wm USING (level2) GROUP BY 1, 2, 3)
SELECT k2 // 2 AS code, round(min(median_km), 6) AS median_km, round(max(max_km), 6) AS max_km, round(median(median_km), 6) AS typical_km, count(*) AS n_units FROM m GROUP BY 1""")
def weighted_medians(spark: SparkSession, d: str) -> DataFrame:
    """Area-weighted median distance by unit, then the least of the units that share a code."""
    z = zone_distances(spark, d)
    by_unit = weighted_median(z, ["level2", "k2"], "dist_km", "area_sqkm", "median_km").join(z.groupBy("level2").agg(F.max("dist_km").alias("max_km")), "level2")
    return by_unit.groupBy(F.floor(F.col("k2") / 2).alias("code")).agg(
        F.round(F.min("median_km"), 6).alias("median_km"), F.round(F.max("max_km"), 6).alias("max_km"), F.round(F.median("median_km"), 6).alias("typical_km"), F.count("*").alias("n_units")
    )


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """Grid cells inside zones: (cell, x, y, pcode, area_sqkm); zones as polygons in metres."""
    z = zone_centres(spark, d)

    def flat(p):
        x, y = projected(p["x"] / 1e6, p["y"] / 1e6)
        return F.struct(x.alias("x"), y.alias("y"))

    polygons = z.select("pcode", "area_sqkm", F.transform("rings", lambda r: F.transform(r, flat)).alias("rings"))
    box = polygons.select(F.explode(F.flatten("rings")).alias("p")).agg(*[F.floor(f(F.col("p")[c]) / STEP).alias(f"{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))]).first()
    cells = grid(spark, box.lox * STEP, box.loy * STEP, (box.hix + 1) * STEP, (box.hiy + 1) * STEP, STEP).withColumn("cell", F.concat_ws(":", F.col("ix").cast("string"), F.col("iy").cast("string")))
    return point_in_polygon(cells, polygons, STEP * 4).drop("rings")


SQL_CELLS = PRELUDE + f"""b AS (SELECT floor(least(min(x_0), min(x_1), min(x_2), min(x_3)) / {STEP}) * {STEP} AS bx0, floor(greatest(max(x_0), max(x_1), max(x_2), max(x_3)) / {STEP}) * {STEP} AS bx1,
  floor(least(min(y_0), min(y_1), min(y_2), min(y_3)) / {STEP}) * {STEP} AS by0, floor(greatest(max(y_0), max(y_1), max(y_2), max(y_3)) / {STEP}) * {STEP} AS by1 FROM za),
g AS MATERIALIZED (SELECT i, j, bx0 + i * {STEP} AS x, by0 + j * {STEP} AS y FROM b, range(2000) r(i), range(2000) s(j) WHERE bx0 + i * {STEP} <= bx1 AND by0 + j * {STEP} <= by1),
e AS (SELECT pcode, [[x_0, y_0, x_1, y_1], [x_1, y_1, x_2, y_2], [x_2, y_2, x_3, y_3], [x_3, y_3, x_0, y_0]] AS es, least(x_0, x_3) AS a, greatest(x_1, x_2) AS c, least(y_0, y_1) AS f, greatest(y_2, y_3) AS h FROM za),
ins AS MATERIALIZED (SELECT pcode, i, j, x, y FROM g JOIN e ON x BETWEEN a AND c AND y BETWEEN f AND h WHERE len(list_filter(es, lambda k: ((k[2] > y) <> (k[4] > y)) AND x < k[1] + (k[3] - k[1]) * (y - k[2]) / nullif(k[4] - k[2], 0))) % 2 = 1),
"""


def _sql_void(having: str = "") -> str:
    return SQL_CELLS + f"""w AS MATERIALIZED (SELECT x AS px, y AS py, contains(operators, 'OpA') AS a, contains(operators, 'OpB') AS b FROM pts {having}),
nn AS MATERIALIZED (SELECT pcode, i, j, x, y, sqrt(min((x - px) * (x - px) + (y - py) * (y - py))) / 1000 AS d, sqrt(min(CASE WHEN a THEN (x - px) * (x - px) + (y - py) * (y - py) END)) / 1000 AS da, sqrt(min(CASE WHEN b THEN (x - px) * (x - px) + (y - py) * (y - py) END)) / 1000 AS db FROM ins CROSS JOIN w GROUP BY ALL)
"""


#: Suffixes of the void grid's columns: of any operator, and of each.
READINGS = ("", "_OpA", "_OpB")


def _void_distances(spark: SparkSession, d: str, status: str | None = None) -> DataFrame:
    """Grid cells inside zones with their distance to the nearest service point (of a status): of any operator, and of each, in one descent."""
    cells = staged(_cells(spark, d), "cells")
    points = X.metres(X.points(spark, d, status)).withColumn("ops", operators_of(F.col("operators"))).select("x", "y", "ops")
    groups = {o: F.array_contains("ops", o[1:]) if o else F.lit(True) for o in READINGS}
    return nearest_km(cells, points, "cell", groups, carry=("pcode", "ix", "iy", "x", "y"))


_VOID_SHARES = """SELECT pcode, count(*) AS n_cells, round(avg((d > 10)::INT), 6) AS void_share, round(avg((da > 10)::INT), 6) AS void_share_OpA, round(avg((db > 10)::INT), 6) AS void_share_OpB, round(avg(d), 6) AS mean_km, round(max(d), 6) AS max_km FROM nn GROUP BY 1"""


def _void_shares(near: DataFrame) -> DataFrame:
    void = [F.round(F.avg((F.col(f"dist_km{o}") > 10).cast("double")), 6).alias(f"void_share{o}") for o in READINGS]
    return near.groupBy("pcode").agg(F.count("*").alias("n_cells"), *void, F.round(F.avg("dist_km"), 6).alias("mean_km"), F.round(F.max("dist_km"), 6).alias("max_km"))


@query(_sql_void() + _VOID_SHARES)
def void_grid(spark: SparkSession, d: str) -> DataFrame:
    """Share of each zone's 1 km cells without a service point within 10 km: of any operator, and of each."""
    return _void_shares(_void_distances(spark, d))


@query(_sql_void(f"WHERE status = '{X.PENDING}'") + _VOID_SHARES)
def void_grid_pending(spark: SparkSession, d: str) -> DataFrame:
    """The same with the points that are still being set up as the only witnesses, which leaves gaps."""
    return _void_shares(_void_distances(spark, d, X.PENDING))


_LON, _LAT = X.sql_unprojected("x", "y")


@query(_sql_void(f"WHERE status = '{X.PENDING}'") + f"""SELECT pcode, i AS ix, j AS iy, round({_LON}, 6) AS lon, round({_LAT}, 6) AS lat, round(d, 3) AS dist_km, round(da, 3) AS dist_km_OpA, round(db, 3) AS dist_km_OpB FROM nn WHERE greatest(d, da, db) > 10 AND i % 2 = 0 AND j % 2 = 0""")
def void_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells to show: one of four, void for any operator or for one at least, with position and rounded distances; witnesses are the points that are being set up."""
    void = F.greatest(*[f"dist_km{o}" for o in READINGS]) > 10
    shown = _void_distances(spark, d, X.PENDING).filter(void & (F.pmod("ix", F.lit(2)) == 0) & (F.pmod("iy", F.lit(2)) == 0))
    lon, lat = unprojected(F.col("x"), F.col("y"))
    return shown.select("pcode", "ix", "iy", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"), *[F.round(f"dist_km{o}", 3).alias(f"dist_km{o}") for o in READINGS])
