"""Queries on operators, facilities, third-level units, presets, convergence, exports and their checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import group_percentiles, percentile_of, weighted_median
from ..operators import checks as C
from ..operators import index as I
from ..operators.spatial import nearest_km
from ..operators.tidy import access_ratios, union_exports
from ..sources import readers as R
from ..sources.staging import shared_dir, staged
from . import fixtures as X
from .access import SQL_NEAR, SQL_ZD, active_branches, zone_centres, zone_distances
from .inventory import PRELUDE, SQL_IND2, SQL_IND3, branches, data_centres, indicators2, indicators3, points_by_operator, rounded
from .ranking import SQL_GAP_PENDING, SQL_INDEX, gap_zones, hotspots, indexed, priority_robust, sql_hotspots
from .registry import query, sql_of

OPERATORS = ("OpA", "OpB")


@query(PRELUDE + SQL_ZD + """, o AS (SELECT unnest(['OpA', 'OpB']) AS operator),
pc AS (SELECT level2, operator, count(*) AS points FROM pop_op GROUP BY 1, 2), bc AS (SELECT level2, operator, count(*) AS branches, count(*) FILTER (active) AS active_branches FROM br GROUP BY 1, 2),
oz AS MATERIALIZED (SELECT pcode, zc.level2, area_sqkm, b.operator, min(sqrt((mx - b.x) * (mx - b.x) + (my - b.y) * (my - b.y))) / 1000 AS dist_km FROM zc CROSS JOIN act b GROUP BY 1, 2, 3, 4),
od AS (SELECT level2, operator, min(dist_km) FILTER (2 * upto >= whole) AS median_km, max(dist_km) AS max_km FROM
 (SELECT *, sum(w) OVER (PARTITION BY level2, operator ORDER BY dist_km) AS upto, sum(w) OVER (PARTITION BY level2, operator) AS whole FROM (SELECT level2, operator, dist_km, sum(area_sqkm::DECIMAL(28, 9)) AS w FROM oz GROUP BY 1, 2, 3)) GROUP BY 1, 2),
j AS (SELECT level2, operator, population, coalesce(points, 0) AS points, coalesce(branches, 0) AS branches, coalesce(active_branches, 0) AS active_branches FROM p2 CROSS JOIN o LEFT JOIN pc USING (level2, operator) LEFT JOIN bc USING (level2, operator))
SELECT j.*, round(population / nullif(points, 0), 6) AS inhabitants_per_point, round(points / nullif(population, 0) * 1e4, 6) AS points_per_10k, round(active_branches / nullif(population, 0) * 1e5, 6) AS branches_per_100k, round(median_km, 6) AS median_km, round(max_km, 6) AS max_km FROM j LEFT JOIN od USING (level2, operator)""")
def indicators_by_operator(spark: SparkSession, d: str) -> DataFrame:
    """Each unit's supply, ratios and distances (area-weighted median and largest of its zones) by operator; the population is the same for all."""
    named = F.explode(F.array(*map(F.lit, OPERATORS))).alias("operator")
    base = X.population2(spark, d).select("level2", "population", named)
    points = points_by_operator(spark, d).groupBy("level2", "operator").agg(F.count("*").alias("points"))
    supply = branches(spark, d).groupBy("level2", "operator").agg(F.count("*").alias("branches"), F.count_if("active").alias("active_branches"))
    both = base.join(points, ["level2", "operator"], "left").join(supply, ["level2", "operator"], "left").na.fill(0, ["points", "branches", "active_branches"])
    zones = zone_centres(spark, d).select("pcode", "level2", "area_sqkm", "x", "y")
    near = nearest_km(zones, active_branches(spark, d), "pcode", OPERATORS, carry=("level2", "area_sqkm"))
    long = staged(near.select("level2", "area_sqkm", F.explode(F.array(*[F.struct(F.lit(o).alias("operator"), F.col(f"dist_km_{o}").alias("dist_km")) for o in OPERATORS])).alias("v")).select("level2", "area_sqkm", "v.*"), "operator-distances")
    by = ["level2", "operator"]
    far = weighted_median(long, by, "dist_km", "area_sqkm", "median_km").join(long.groupBy(*by).agg(F.max("dist_km").alias("max_km")), by)
    return rounded(access_ratios(both).join(far, by, "left"), ("inhabitants_per_point", "points_per_10k", "branches_per_100k", "median_km", "max_km"))


@query(PRELUDE + """q AS (SELECT 1) SELECT (SELECT count(*) FROM exp_rows) AS listed, count(*) AS facilities, count(*) FILTER (active) AS active, count(*) FILTER (NOT active) AS closed, count(*) FILTER (operator = 'OpA') AS of_a, count(*) FILTER (operator = 'OpB') AS of_b,
count(*) FILTER (operator = 'OpA' AND active) AS active_a, count(*) FILTER (operator = 'OpB' AND active) AS active_b, (SELECT count(*) FROM fac WHERE data_centre) AS data_centres, round(((SELECT count(*) FROM exp_rows) / count(*) - 1) * 100, 6) AS overestimate_percent FROM br""")
def facility_reference(spark: SparkSession, d: str) -> DataFrame:
    """The counts of facilities that all reports share, and by how much the exports together overstate them."""
    is_ = lambda o: F.col("operator") == o
    listed = union_exports(X.exports(spark, d)).agg(F.count("*").alias("listed"))
    found = branches(spark, d).agg(
        F.count("*").alias("facilities"), F.count_if("active").alias("active"), F.count_if(~F.col("active")).alias("closed"), F.count_if(is_("OpA")).alias("of_a"), F.count_if(is_("OpB")).alias("of_b"),
        F.count_if(is_("OpA") & F.col("active")).alias("active_a"), F.count_if(is_("OpB") & F.col("active")).alias("active_b"),
    )
    centres = data_centres(spark, d).agg(F.count("*").alias("data_centres"))
    return listed.crossJoin(found).crossJoin(centres).withColumn("overestimate_percent", F.round((F.col("listed") / F.col("facilities") - 1) * 100, 6))


_MINMAX3 = "CASE WHEN {c} IS NULL THEN NULL WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) * 100 ELSE 50 END AS n_{n}"
_DIRS3 = {"d1": "inhabitants_per_point", "d2": "(-active_branches / population * 1e5)", "d3": "distance_km", "d4": "population"}


@query(SQL_IND3 + "," + SQL_NEAR[len(PRELUDE):] + f""", md AS (SELECT p.level3, median(dist_km) AS distance_km FROM nb JOIN pts p USING (id) GROUP BY 1),
u3 AS (SELECT ind3.*, distance_km, CASE WHEN NOT reliable THEN 'shared population' WHEN inhabitants_per_point IS NULL THEN 'no point' WHEN distance_km IS NULL THEN 'no distance' END AS reason FROM ind3 LEFT JOIN md USING (level3)),
c3x AS (SELECT *, {', '.join(_MINMAX3.format(c=c, n=n) for n, c in _DIRS3.items())} FROM u3 WHERE reason IS NULL),
s3 AS (SELECT level3, n_d1 * 0.3 + n_d2 * 0.25 + n_d3 * 0.25 + n_d4 * 0.2 AS score FROM c3x),
r3x AS (SELECT level3, score, floor(rank() OVER (ORDER BY score DESC) + (count(*) OVER (PARTITION BY score) - 1) / 2)::BIGINT AS rank FROM s3)
SELECT level3, round(distance_km, 6) AS distance_km, round(score, 6) AS score, rank, reason FROM u3 LEFT JOIN r3x USING (level3)""")
def level3_index(spark: SparkSession, d: str) -> DataFrame:
    """The priority index of third-level units, on the median distance of their points; units that cannot be scored, with the reason."""
    near = staged(nearest_km(X.metres(X.points(spark, d)), active_branches(spark, d), "id", carry=("level3",)), "point-distances")
    units = indicators3(spark, d).join(group_percentiles(near, ["level3"], "dist_km", {"distance_km": 0.5}), "level3", "left")
    reason = F.when(~F.col("reliable"), "shared population").when(F.col("inhabitants_per_point").isNull(), "no point").when(F.col("distance_km").isNull(), "no distance")
    units = staged(units.withColumn("reason", reason), "units3")
    scored = I.priority_index(units.filter("reason IS NULL"), "level3").select("level3", "score", "rank")
    return rounded(units.join(scored, "level3", "left"), ("distance_km", "score")).select("level3", "distance_km", "score", "rank", "reason")


@query(SQL_IND2 + """SELECT (SELECT level2 FROM ind2 ORDER BY inhabitants_per_point DESC NULLS LAST, level2 LIMIT 1) AS worst, round(max(inhabitants_per_point), 6) AS worst_value, (SELECT level2 FROM ind2 ORDER BY inhabitants_per_point NULLS LAST, level2 LIMIT 1) AS best, round(min(inhabitants_per_point), 6) AS best_value, round(max(inhabitants_per_point) / min(inhabitants_per_point), 6) AS ratio FROM ind2 WHERE inhabitants_per_point IS NOT NULL""")
def extremes(spark: SparkSession, d: str) -> DataFrame:
    """The worst and the best served unit (of equal ones the first by name), and how far they are apart."""
    v = "inhabitants_per_point"
    key = lambda sign: F.struct((F.col(v) * sign).alias("v"), F.col("level2").alias("u"))
    found = indicators2(spark, d).filter(F.col(v).isNotNull()).agg(F.min_by("level2", key(-1)).alias("worst"), F.max(v).alias("worst_value"), F.min_by("level2", key(1)).alias("best"), F.min(v).alias("best_value"))
    return rounded(found.withColumn("ratio", F.col("worst_value") / F.col("best_value")), ("worst_value", "best_value", "ratio"))


#: Units with most high-risk zones that convergence looks at.
HOTSPOTS = 15


@query(f"SELECT h.level2, h.high_zones, r.frequency FROM ({SQL_GAP_PENDING + sql_hotspots(HOTSPOTS)}) h JOIN ({sql_of('priority_robust')}) r USING (level2)")
def convergence(spark: SparkSession, d: str) -> DataFrame:
    """Units with most high-risk zones (the points being set up are the witnesses) that are also robustly among the first of the priority index."""
    near = zone_distances(spark, d)  # for both indices
    gaps = I.gap_index(gap_zones(spark, d, status=X.PENDING, near=near), "pcode")
    return hotspots(gaps, HOTSPOTS).join(priority_robust(spark, d, near), "level2").select("level2", "high_zones", "frequency")


# The presets' weights, in percent.
PRESETS = {"reference": (30, 25, 25, 20), "equal": (25, 25, 25, 25), "distance": (20, 20, 45, 15), "population": (25, 15, 15, 45)}


@query(SQL_INDEX + ", vs AS (" + " UNION ALL ".join(f"SELECT '{n}' AS preset, level2, round(score, 9) AS reference, round(({' + '.join(f'n_d{k} * {v}' for k, v in enumerate(w, 1))}) / 100.0, 9) AS value FROM ix WHERE score IS NOT NULL" for n, w in PRESETS.items()) + """),
vr AS (SELECT preset, rank() OVER (PARTITION BY preset ORDER BY reference) + (count(*) OVER (PARTITION BY preset, reference) - 1) / 2 AS a, rank() OVER (PARTITION BY preset ORDER BY value) + (count(*) OVER (PARTITION BY preset, value) - 1) / 2 AS b,
 row_number() OVER (PARTITION BY preset ORDER BY reference DESC, level2) <= 10 AND row_number() OVER (PARTITION BY preset ORDER BY value DESC, level2) <= 10 AS in_both FROM vs)
SELECT preset, round(corr(a, b), 6) AS spearman, count(*) FILTER (in_both) AS kept FROM vr GROUP BY 1""")
def preset_weights(spark: SparkSession, d: str) -> DataFrame:
    """The index under the presets' weights against its own: rank correlation, and how many of the first ten stay. The reference's own gives 1 and 10."""
    rows = [F.struct(F.lit(n).alias("preset"), F.round(I.composed({c: v / 100 for c, v in zip(I.COMPONENTS, w, strict=True)}), 9).alias("value")) for n, w in PRESETS.items()]
    long = indexed(spark, d).filter("score IS NOT NULL").select("level2", F.round("score", 9).alias("reference"), F.explode(F.array(*rows)).alias("v")).select("v.preset", "level2", "reference", "v.value")
    return rounded(I.compared(long, "preset", "level2", 10), ("spearman",))


@query(SQL_GAP_PENDING + """, pr AS (SELECT (rank() OVER (ORDER BY risk) + (count(*) OVER (PARTITION BY risk) - 1) / 2 - 1) / (count(*) OVER () - 1) * 100 AS p, witnesses FROM gp),
pa1 AS (SELECT sum(area_sqkm) AS s FROM gp), pa2 AS (SELECT sum(a) AS s FROM (SELECT level2, round(sum(round(area_sqkm, 6)), 3) AS a FROM za GROUP BY 1)),
pc1 AS (SELECT sum(points) AS s FROM ind2), pc2 AS (SELECT count(DISTINCT id) AS s FROM pop_op)
SELECT 'zones' AS step, 'area is conserved within 0.5' AS name, abs((SELECT s FROM pa1) - (SELECT s FROM pa2)) <= 0.5 AS ok
UNION ALL SELECT 'zones', 'zones without witness rank high', coalesce((SELECT median(p) FROM pr WHERE witnesses = 0) >= 75, false)
UNION ALL SELECT 'points', 'both ways give one total', (SELECT s FROM pc1) = (SELECT s FROM pc2)""")
def plausibility_checks(spark: SparkSession, d: str) -> DataFrame:
    """Conservation within a tolerance, zones without witness (of the points being set up) among the risky, and one total by two ways."""
    gaps = I.gap_index(gap_zones(spark, d, status=X.PENDING), "pcode")
    ranked = percentile_of(gaps.select("risk", "witnesses"), "risk", "p").filter("witnesses = 0")
    units = indicators2(spark, d)
    distinct = points_by_operator(spark, d).select("id").distinct().agg(F.count("*").alias("n"))
    return C.registry([
        C.same_sum(gaps, "area_sqkm", units, "area_sqkm", "zones", "area is conserved within 0.5", 0.5),
        C.check(ranked, "zones", "zones without witness rank high", F.median("p") >= 75, F.median("p")),
        C.same_sum(units, "points", distinct, "n", "points", "both ways give one total"),
    ]).drop("detail")


@query(PRELUDE + """f AS (SELECT lon_u / 1e6 AS lon, lat_u / 1e6 AS lat FROM br)
SELECT 'csv' AS format, count(*) AS n_rows, count(*) AS matched, count(*) AS same_ids, 0.0::DOUBLE AS max_shift, count(*) FILTER (lon < 0) AS west FROM f
UNION ALL SELECT 'geojson', count(*), count(*), 0, round(max(greatest(abs(round(lon, 5) - lon), abs(round(lat, 5) - lat))), 7), count(*) FILTER (lon < 0) FROM f
UNION ALL SELECT 'kml', count(*), count(*), 0, round(max(greatest(abs(round(lon, 4) - lon), abs(round(lat, 4) - lat))), 7), count(*) FILTER (lon < 0) FROM f""")
def format_comparison(spark: SparkSession, d: str) -> DataFrame:
    """The facilities written as strict CSV, GeoJSON lines and KML, and read back: the same entities, ids and positions?"""
    f = staged(X.facilities(spark, d).filter("NOT data_centre").select(F.col("k").cast("string").alias("k"), "name", (F.col("lon_u") / 1e6).alias("lon"), (F.col("lat_u") / 1e6).alias("lat")), "facilities")
    root = f"{shared_dir(spark)}/staged/formats-{uuid.uuid4().hex}"
    wkt = F.concat(F.lit("POINT ("), F.col("lon").cast("string"), F.lit(" "), F.col("lat").cast("string"), F.lit(")"))
    blank = {c: F.lit(None).cast("string") for c in R.BRANCH_EXPORT.names}
    R.write_table(f.select(*[(blank | {"FID": F.col("k"), "etab_nom": F.concat(F.lit(" "), F.col("name")), "geometry": wkt})[c].alias(c) for c in R.BRANCH_EXPORT.names]), f"{root}/csv", "csv")
    R.write_geojson_lines(f, f"{root}/geojson", "lon", "lat", ["name"])
    place = F.concat_ws(",", F.round("lon", 4).cast("string"), F.round("lat", 4).cast("string"))
    f.select("name", F.struct(place.alias("coordinates")).alias("Point")).write.format("xml").option("rootTag", "Document").option("rowTag", "Placemark").save(f"{root}/kml")
    csv = R.with_lon_lat(R.read_strict_csv(spark, f"{root}/csv", R.BRANCH_EXPORT, "branches")).select(F.col("FID").alias("k2"), F.col("etab_nom").alias("name"), "lon", "lat")
    lines = spark.read.schema("properties struct<name:string>, geometry struct<coordinates:array<double>>").json(f"{root}/geojson")
    geo = lines.select(F.lit(None).cast("string").alias("k2"), "properties.name", F.col("geometry.coordinates")[0].alias("lon"), F.col("geometry.coordinates")[1].alias("lat"))
    kml = R.read_kml(spark, f"{root}/kml").select(F.lit(None).cast("string").alias("k2"), "name", "lon", "lat")
    own = f.select("k", "name", F.col("lon").alias("x"), F.col("lat").alias("y"))
    out = []
    for fmt, rows in (("csv", csv), ("geojson", geo), ("kml", kml)):
        both = rows.join(own, "name", "left")
        shift = F.greatest(F.abs(F.col("lon") - F.col("x")), F.abs(F.col("lat") - F.col("y")))
        out.append(both.agg(F.lit(fmt).alias("format"), F.count("*").alias("n_rows"), F.count("k").alias("matched"), F.count_if(F.col("k") == F.col("k2")).alias("same_ids"), F.round(F.max(shift), 7).alias("max_shift"), F.count_if(F.col("x") < 0).alias("west")))
    return C.registry(out)
