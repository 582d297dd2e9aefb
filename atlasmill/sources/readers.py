"""Sources and sinks: strict CSV, GeoJSON, KML, paged text, catalogues; tables, GeoJSON lines, provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip_all, wkt_lat, wkt_lon
from .staging import staged

_UNITS = ["region_nom_bdd", "prefecture_nom_bdd", "commune_nom_bdd", "canton_nom_bdd"]
_SITE = ["nom_localite", "etab_nom", "etab_adresse", "etab_jour", "etab_creation_date", "activite_statut"]


def strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# The exports' columns, all read as text.
BRANCH_EXPORT = strings(["FID", *_UNITS, *_SITE, "activite_categorie", "toilette_type", "geometry"])
DATA_CENTRE_EXPORT = strings(["FID", *_UNITS, *_SITE, "terrain", "toilette_type", "geometry"])
SERVICE_POINT_EXPORT = strings(["FID", *_UNITS, "operateur", "geometry"])

_RINGS = T.ArrayType(T.ArrayType(T.DoubleType()))
ADMIN_FEATURE = T.StructType([
    T.StructField("properties", T.StructType([*[T.StructField(f"adm{k}_{n}", T.StringType()) for k in (1, 2, 3) for n in ("name", "pcode")], *[T.StructField(n, T.DoubleType()) for n in ("area_sqkm", "center_lat", "center_lon")]])),
    T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])),
])


def read_strict_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, source: str | None = None, pattern: str | None = None) -> DataFrame:
    """Columns as text; only the empty string is null; edges stripped. `source` tags the rows; `pattern` picks files by name, whatever their stamps.

    An export with a header only gives no rows; a path that is missing raises, so that "no data" is not mistaken for zero.
    """
    reader = spark.read.schema(schema).option("header", True).option("nullValue", "").option("multiLine", True).option("escape", '"').option("mode", "FAILFAST")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    df = strip_all(reader.csv(path))
    return df.withColumn("_source", F.lit(source)) if source else df.withColumn("_source", F.col("_metadata.file_name")) if pattern else df


def read_geojson(spark: SparkSession, path: str, feature: T.StructType = ADMIN_FEATURE) -> DataFrame:
    """A row per feature: its properties, the geometry's type and `rings`: all rings of all parts, as arrays of (x, y)."""
    schema = T.StructType([T.StructField("features", T.ArrayType(feature))])
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    polygon = F.from_json("f.geometry.coordinates", T.ArrayType(_RINGS))
    multi = F.flatten(F.from_json("f.geometry.coordinates", T.ArrayType(T.ArrayType(_RINGS))))
    rings = F.when(F.col("f.geometry.type") == "Polygon", polygon).otherwise(multi)
    points = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return rows.select("f.properties.*", F.col("f.geometry.type").alias("geometry_type"), points.alias("rings"))


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """A row per placemark: name, lon, lat."""
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("Point", T.StructType([T.StructField("coordinates", T.StringType())]))])
    rows = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)
    parts = F.split(F.trim("Point.coordinates"), ",")
    return rows.select("name", parts[0].try_cast("double").alias("lon"), parts[1].try_cast("double").alias("lat"))


def read_page_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, page, body, path): text files cut at form feeds, pages numbered from 1; doc_id is the file's name.

    Files are read in splits, so that a large one is many tasks' work. A page belongs to the split in
    which it begins; its number is its place there and the pages of all splits before. An empty page
    after a last form feed is none.
    """
    lines = spark.read.option("lineSep", "\f").text(path)
    rows = lines.select(F.col("_metadata.file_name").alias("doc_id"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__at"), F.col("value").alias("body"))
    # a row per split: where its rows begin, and how many pages the file has before it
    each = rows.groupBy("path", "__start").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy("path").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)
    splits = staged(each.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n"), "splits")
    return rows.join(splits, ["path", "__start"]).select("doc_id", (F.col("__before") + F.col("__at") - F.col("__first") + 1).alias("page"), "body", "path")


def _datasets(datasets: dict[str, str]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("dataset"), F.lit(v).alias("pattern")) for k, v in datasets.items()])


def listed(spark: SparkSession, root: str, datasets: dict[str, str]) -> DataFrame:
    """(dataset, n_files, n_bytes) of the files under `root` whose path matches a dataset's pattern (a regular expression); files are listed, not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    met = files.withColumn("d", F.explode(_datasets(datasets))).filter(F.rlike(F.col("path"), F.col("d.pattern")))
    return met.groupBy("d.dataset").agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))


def read_exports(spark: SparkSession, root: str, datasets: dict[str, str], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """The rows of all datasets (strict CSV, tagged by `_source`), and a report (dataset, n_files, n_rows, status).

    status is present, empty (files without rows) or missing (no file): an export that is absent adds
    no rows and is reported, so that it is not mistaken for zero. A file whose path several patterns
    match counts for each. `root` itself must exist.
    """
    reader = spark.read.schema(schema).option("header", True).option("nullValue", "").option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").option("recursiveFileLookup", True)
    own = strip_all(reader.csv(root).withColumn("__path", F.col("_metadata.file_path")))
    rows = own.withColumn("__d", F.explode(_datasets(datasets))).filter(F.rlike(F.col("__path"), F.col("__d.pattern"))).withColumn("_source", F.col("__d.dataset")).drop("__path", "__d")
    counts = rows.groupBy(F.col("_source").alias("dataset")).agg(F.count("*").alias("n_rows"))
    wanted = spark.range(1).select(F.explode(F.array(*map(F.lit, datasets))).alias("dataset"))
    status = F.when(F.col("n_files").isNull(), "missing").when(F.coalesce("n_rows", F.lit(0)) == 0, "empty").otherwise("present")
    both = wanted.join(listed(spark, root, datasets), "dataset", "left").join(counts, "dataset", "left")
    return rows, both.select("dataset", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), status.alias("status"))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, is_open) of a catalogue given as JSON lines or an array."""
    return spark.read.schema("id string, title string, is_open boolean").option("multiLine", True).json(path)


def flagged_names(rows: DataFrame, name: str, pattern: str, members: DataFrame, key: str) -> DataFrame:
    """Rows whose name matches the expression, in either case, with `is_member`: whether their key is among the members'."""
    known = members.select(key).distinct().withColumn("__member", F.lit(True))
    return filter_names(rows, name, pattern).join(known, key, "left").withColumn("is_member", F.coalesce("__member", F.lit(False))).drop("__member")


def filter_names(rows: DataFrame, name: str, pattern: str) -> DataFrame:
    """Rows whose name matches the expression, in either case."""
    return rows.filter(F.col(name).rlike(f"(?i){pattern}"))


def with_lon_lat(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Positions with six decimals in place of WKT points."""
    return df.withColumns({"lon": wkt_lon(F.col(geometry)), "lat": wkt_lat(F.col(geometry))}).drop(geometry)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def geojson_lines(df: DataFrame, lon: str, lat: str, properties: list[str], digits: int = 5) -> DataFrame:
    """One point feature as JSON text per row, with rounded coordinates."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.round(lon, digits), F.round(lat, digits)).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))).alias("value"))


def write_geojson_lines(df: DataFrame, path: str, lon: str, lat: str, properties: list[str]) -> None:
    geojson_lines(df, lon, lat, properties).write.mode("overwrite").text(path)


def with_provenance(df: DataFrame, **facts: str) -> DataFrame:
    """Scope, sources, weights and the like as constant columns prov_<name>."""
    return reduce(lambda d, kv: d.withColumn(f"prov_{kv[0]}", F.lit(kv[1])), sorted(facts.items()), df)
