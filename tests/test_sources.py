import json

import pytest
from pyspark.sql import functions as F

from atlasmill.sources import readers


def test_strict_csv(spark, tmp_path):
    (tmp_path / "points_2024.csv").write_text('FID,region_nom_bdd,prefecture_nom_bdd,commune_nom_bdd,canton_nom_bdd,operateur,geometry\n01, R ,P,C,K,"Moov, Togocom",POINT (1.5 8.25)\n02,,P,C,K,Nsp,POINT (0 0)\n')
    df = readers.read_strict_csv(spark, str(tmp_path), readers.SERVICE_POINT_EXPORT, pattern="points_*.csv")
    got = [(r.FID, r.region_nom_bdd, r.operateur, r._source) for r in df.orderBy("FID").collect()]
    assert got == [("01", "R", "Moov, Togocom", "points_2024.csv"), ("02", None, "Nsp", "points_2024.csv")]
    assert [(r.lon, r.lat) for r in readers.with_lon_lat(df).orderBy("FID").collect()] == [(1.5, 8.25), (0.0, 0.0)]


def test_an_empty_export_has_no_rows_and_a_missing_one_raises(spark, tmp_path):
    (tmp_path / "e.csv").write_text(",".join(readers.SERVICE_POINT_EXPORT.names) + "\n")
    assert readers.read_strict_csv(spark, str(tmp_path / "e.csv"), readers.SERVICE_POINT_EXPORT, source="e").count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_strict_csv(spark, str(tmp_path / "none.csv"), readers.SERVICE_POINT_EXPORT).count()


def test_geojson_kml_pages(spark, tmp_path):
    square = [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    features = [{"type": "Feature", "properties": {"adm1_name": n, "area_sqkm": 1.5}, "geometry": {"type": t, "coordinates": c}} for n, t, c in (("p", "Polygon", square), ("m", "MultiPolygon", [square, square]))]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    got = {r.adm1_name: (len(r.rings), r.rings[0][1].x) for r in readers.read_geojson(spark, str(tmp_path / "a.geojson")).collect()}
    assert got == {"p": (1, 1.0), "m": (2, 1.0)}
    (tmp_path / "a.kml").write_text("<kml><Document><Placemark><name>x</name><Point><coordinates>1.5,8.25,0</coordinates></Point></Placemark></Document></kml>")
    assert [tuple(r) for r in readers.read_kml(spark, str(tmp_path / "a.kml")).collect()] == [("x", 1.5, 8.25)]
    (tmp_path / "doc.txt").write_text("one\ftwo")
    assert [(r.doc_id, r.page, r.body) for r in readers.read_page_texts(spark, str(tmp_path / "doc.txt")).orderBy("page").collect()] == [("doc.txt", 1, "one"), ("doc.txt", 2, "two")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.234567, 8.0)], "n string, lon double, lat double")
    readers.write_geojson_lines(df, str(tmp_path / "g"), "lon", "lat", ["n"])
    line = json.loads(spark.read.text(str(tmp_path / "g")).first().value)
    assert line["geometry"]["coordinates"] == [1.23457, 8.0] and line["properties"] == {"n": "a"}
    readers.write_table(readers.with_provenance(df, scope="all"), str(tmp_path / "t"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).first().prov_scope == "all"
    assert readers.filter_names(df, "n", "A").select(F.count("*")).first()[0] == 1
