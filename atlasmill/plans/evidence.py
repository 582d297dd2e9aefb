"""Queries on paged files, merged outlines, shared totals, availability, catalogues and the tally of checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import ring_area_km2
from ..functions.text import facility_label, without_prefix
from ..operators import checks as C
from ..operators.crosswalk import attached_by_prefix
from ..operators.spatial import dissolved, outline_edges
from ..sources import readers as R
from ..sources.staging import shared_dir
from . import fixtures as X
from .decisions import plausibility_checks
from .inventory import PRELUDE, branches, quality_checks
from .registry import query, sql_of

#: Documents in a written file of pages.
PAGES = 100


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/staged/{label}-{uuid.uuid4().hex}"


@query(f"""SELECT coalesce(lang, 'none') || '-' || (doc_id // {PAGES}) AS file, row_number() OVER (PARTITION BY lang, doc_id // {PAGES} ORDER BY doc_id) AS page, length(t) AS n_chars, md5(t) AS digest
FROM (SELECT lang, doc_id, replace(coalesce(text, ''), chr(12), ' ') AS t FROM documents)""")
def paged_text(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as files of pages between form feeds, and read back with their page numbers, whatever the splits."""
    path = _folder(spark, "pages")
    file = F.concat_ws("-", F.coalesce("lang", F.lit("none")), F.floor(F.col("doc_id") / PAGES).cast("string"))
    body = F.regexp_replace(F.coalesce("text", F.lit("")), "\f", " ")
    rows = X.table(spark, d, "documents").select(file.alias("file"), "doc_id", body.alias("value"))
    rows.repartition("file").sortWithinPartitions("file", "doc_id").select("file", "value").write.partitionBy("file").option("lineSep", "\f").text(path)
    found = R.read_page_texts(spark, path)
    return found.select(F.regexp_extract("path", "file=([^/]+)/", 1).alias("file"), "page", F.char_length("body").alias("n_chars"), F.md5(F.col("body").cast("binary")).alias("digest"))


_CORNERS = ((0, 0), (1, 0), (1, 1), (0, 1))


@query(PRELUDE + f"""ed AS (SELECT k2 // 2 AS code, unnest([{', '.join(f"[x0 + {min(a, c)} * {X.CELL_W // X.PARTS}, y0 + {min(b, e)} * {X.CELL_H // X.PARTS}, x0 + {max(a, c)} * {X.CELL_W // X.PARTS}, y0 + {max(b, e)} * {X.CELL_H // X.PARTS}]" for (a, b), (c, e) in zip(_CORNERS, _CORNERS[1:] + _CORNERS[:1], strict=True))}]) AS s FROM zn),
oe AS (SELECT code, count(*) AS n_edges FROM (SELECT code, s FROM ed GROUP BY 1, 2 HAVING count(*) = 1) GROUP BY 1)
SELECT code, n_edges, count(DISTINCT k2 // 5) AS n_rings, 0 AS inner_edges, round(sum(area_sqkm), 4) AS area_sqkm FROM za JOIN oe ON oe.code = k2 // 2 GROUP BY 1, 2""")
def dissolved_units(spark: SparkSession, d: str) -> DataFrame:
    """The zones of each code merged to outlines: their rings, edges, area, and how many edges of the parts are left twice."""
    parts = X.zones(spark, d).withColumn("code", F.floor(F.col("k2") / 2))
    merged = dissolved(parts, "code")

    def flat(p):
        x, y = X.projected(p["x"] / 1e6, p["y"] / 1e6)
        return F.struct(x.alias("x"), y.alias("y"))

    area = F.aggregate(F.transform("rings", lambda r: ring_area_km2(F.transform(r, flat))), F.lit(0.0), lambda a, b: a + b)
    edges = F.aggregate("rings", F.lit(0), lambda n, r: n + F.size(r) - 1)
    twice = outline_edges(parts, "code").groupBy("code", F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).count().groupBy("code").agg(F.count_if(F.col("count") > 1).cast("int").alias("inner_edges"))
    return merged.select("code", edges.cast("long").alias("n_edges"), F.size("rings").cast("long").alias("n_rings"), F.round(area, 4).alias("area_sqkm")).join(twice, "code")


@query(PRELUDE + """s3 AS (SELECT level2, level3, population, regexp_extract(level3, '(\\d+)$', 1)::INT AS seg FROM p3),
sh AS (SELECT level2 || ' ' AS prefix, string_agg(level3, ' + ' ORDER BY level3) AS label, sum(population)::BIGINT AS total FROM s3 WHERE seg >= 4 GROUP BY level2)
SELECT level3, CASE WHEN seg < 4 THEN s3.population ELSE total END AS population, CASE WHEN seg >= 4 THEN label END AS shared_with FROM s3 LEFT JOIN sh ON starts_with(level3, prefix)""")
def shared_totals(spark: SparkSession, d: str) -> DataFrame:
    """Third-level populations where a unit's last children are published as one total: they all get it, flagged, undivided."""
    s3 = X.population3(spark, d).withColumn("seg", F.regexp_extract("level3", r"(\d+)$", 1).cast("int"))
    lines = s3.filter("seg >= 4").groupBy("level2").agg(F.array_join(F.array_sort(F.collect_list("level3")), " + ").alias("label"), F.sum("population").alias("total"))  # some children of a unit
    shared = lines.select(F.concat("level2", F.lit(" ")).alias("prefix"), "label", "total")
    found = attached_by_prefix(s3, shared, "level3", "prefix", "label", "total")
    own = F.col("seg") < 4
    return found.select("level3", F.when(own, F.col("population")).otherwise(F.col("total")).alias("population"), F.when(~own, F.col("shared_with")).alias("shared_with"))


@query(PRELUDE + """q AS (SELECT 1) SELECT 'branches_a' AS dataset, count(*) AS n_rows, 'present' AS status FROM br WHERE operator = 'OpA' UNION ALL SELECT 'branches_b', count(*), 'present' FROM br WHERE operator = 'OpB'
UNION ALL SELECT 'branches_c', 0, 'empty' UNION ALL SELECT 'branches_d', 0, 'missing'""")
def export_availability(spark: SparkSession, d: str) -> DataFrame:
    """Exports written as strict CSV, one of them a header only and one not at all, and read back with a report."""
    root = _folder(spark, "exports")
    f = X.facilities(spark, d).filter("NOT data_centre")
    blank = {c: F.lit(None).cast("string") for c in R.BRANCH_EXPORT.names}
    for name, rows in (("a", f.filter("operator = 'OpA'")), ("b", f.filter("operator = 'OpB'")), ("c", f.filter("operator = 'OpC'"))):
        own = blank | {"FID": F.col("k").cast("string"), "etab_nom": F.col("name"), "activite_statut": F.col("status")}
        R.write_table(rows.select(*[own[c].alias(c) for c in R.BRANCH_EXPORT.names]), f"{root}/branches_{name}", "csv")
    datasets = {f"branches_{n}": f"/branches_{n}/[^/]*[.]csv$" for n in "abcd"}
    _, report = R.read_exports(spark, root, datasets, R.BRANCH_EXPORT)
    return report.select("dataset", "n_rows", "status")


_CATALOGUE = "p_retailprice < (SELECT avg(p_retailprice) FROM part)"


@query(f"""WITH cat AS (SELECT p_partkey AS id, p_size < 25 AS is_open FROM part WHERE {_CATALOGUE}), ex AS (SELECT DISTINCT l_partkey AS id FROM lineitem)
SELECT ex.id::VARCHAR AS id, CASE WHEN is_open IS NULL THEN 'not found' WHEN is_open THEN 'open' ELSE 'closed' END AS status FROM ex LEFT JOIN cat USING (id)""")
def catalogue_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The parts that were ordered, looked up in a catalogue (written as JSON lines) that lists the cheaper half: open, closed or not found."""
    return C.provenance(_expected(spark, d), _catalogue(spark, d), "id", "is_open")


def _expected(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("id")).distinct()


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "catalogue")
    part = X.table(spark, d, "part")
    cheap = part.crossJoin(F.broadcast(part.agg(F.avg("p_retailprice").alias("mean")))).filter("p_retailprice < mean")
    cheap.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), (F.col("p_size") < 25).alias("is_open")).write.json(path)
    return spark.read.schema("id string, title string, is_open boolean").json(path)


@query(f"""WITH cat AS (SELECT p_partkey AS id, p_name AS title, p_size < 25 AS is_open FROM part WHERE {_CATALOGUE}), ex AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity > 49)
SELECT cat.id::VARCHAR AS id, title, is_open, ex.id IS NOT NULL AS is_member FROM cat LEFT JOIN ex USING (id) WHERE regexp_matches(title, '(?i)RING|widget')""")
def catalogue_names(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue titles that match an expression, with whether large orders name them."""
    large = X.table(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").cast("string").alias("id"))
    return R.flagged_names(_catalogue(spark, d), "title", "RING|widget", large, "id")


@query(PRELUDE + "q AS (SELECT 1) SELECT name, level2, operator FROM br WHERE NOT active")
def closed_facilities(spark: SparkSession, d: str) -> DataFrame:
    """The branches that are closed, by name and unit."""
    return branches(spark, d).filter("NOT active").select("name", "level2", "operator")


@query(PRELUDE + "q AS (SELECT 1) SELECT CASE WHEN data_centre THEN 'Data centre' ELSE 'Branch ' || operator END AS label, level1, count(*) AS n FROM fac GROUP BY 1, 2")
def facility_labels(spark: SparkSession, d: str) -> DataFrame:
    """Facilities by category label and first-level unit."""
    kind = F.when(F.col("data_centre"), "data centre").otherwise("branch")
    return X.facilities(spark, d).groupBy(facility_label(kind, F.col("operator")).alias("label"), "level1").agg(F.count("*").alias("n"))


@query(f"SELECT count(*) FILTER (ok) AS n_ok, count(*) AS n_checks FROM (SELECT ok FROM ({sql_of('quality_checks')}) UNION ALL SELECT ok FROM ({sql_of('plausibility_checks')}))")
def check_tally(spark: SparkSession, d: str) -> DataFrame:
    """How many of all registered checks hold."""
    return C.tally(C.registry([quality_checks(spark, d), plausibility_checks(spark, d)]))


@query(PRELUDE + "q AS (SELECT 1) SELECT pcode AS adm3_pcode, level2 AS adm2_name, level1 AS adm1_name, 'Polygon' AS geometry_type, round(area_sqkm, 4) AS area_sqkm FROM za")
def geojson_zones(spark: SparkSession, d: str) -> DataFrame:
    """The zones written as a GeoJSON collection for each first-level unit, and read back: properties, and the area of the rings."""
    path = _folder(spark, "geojson")
    ring = F.transform(F.col("rings")[0], lambda p: F.array(p["x"] / 1e6, p["y"] / 1e6))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    properties = F.struct(F.col("level1").alias("adm1_name"), F.col("level2").alias("adm2_name"), F.col("pcode").alias("adm3_pcode"))
    features = X.zones(spark, d).select("level1", F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))).alias("f"))
    files = features.groupBy("level1").agg(F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.array_join(F.array_sort(F.collect_list("f")), ",\n"), F.lit("]}")).alias("value"))  # a unit's zones
    files.repartition("level1").write.partitionBy("level1").text(path)
    found = R.read_geojson(spark, f"{path}/*/*")

    def flat(p):
        x, y = X.projected(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    area = F.aggregate(F.transform("rings", lambda r: ring_area_km2(F.transform(r, flat))), F.lit(0.0), lambda a, b: a + b)
    return found.select("adm3_pcode", "adm2_name", "adm1_name", "geometry_type", F.round(area, 4).alias("area_sqkm"))


@query(PRELUDE + "q AS (SELECT 1) SELECT replace(name, 'Supplier', 'Point') AS name, operator, round(lon_u / 1e6, 6) AS lon, round(lat_u / 1e6, 6) AS lat, 'all' AS prov_scope, 'exports a, b' AS prov_sources FROM br")
def thin_package(spark: SparkSession, d: str) -> DataFrame:
    """The branches as an application reads them: positions in place of geometry, names without their kind, needed columns only, with provenance; written and read back."""
    path = _folder(spark, "package")
    wkt = F.concat(F.lit("POINT ("), (F.col("lon_u") / 1e6).cast("string"), F.lit(" "), (F.col("lat_u") / 1e6).cast("string"), F.lit(")"))
    own = X.facilities(spark, d).filter("NOT data_centre").select(F.concat(F.lit("Agence "), F.regexp_replace("name", "Supplier", "Point")).alias("raw"), "operator", "status", wkt.alias("geometry"))
    thin = R.with_lon_lat(own.withColumn("name", without_prefix(F.col("raw"), "Agence"))).select("name", "operator", "lon", "lat")
    R.write_table(R.with_provenance(thin, scope="all", sources="exports a, b"), path)
    return spark.read.parquet(path)
