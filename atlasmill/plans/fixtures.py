"""The test tables in the roles of the library's inputs, as DataFrames and as DuckDB SQL.

Integer arithmetic in micro-degrees keeps both engines equal; positions are odd and polygon edges
even numbers, so no point lies on an edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import projected, ring_area_km2, with_position

CELL_W, CELL_H, WEST, SOUTH = 390_000, 1_048_000, -150_000, 5_900_000
PARTS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units2(spark: SparkSession, d: str) -> DataFrame:
    """(k2, level2, level1, cx, cy): second-level units and the corner of their cell."""
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey").cast("long")
    return n.select(k.alias("k2"), F.col("n_name").alias("level2"), F.col("r_name").alias("level1"), (WEST + k % 5 * CELL_W).alias("cx"), (SOUTH + F.floor(k / 5) * CELL_H).alias("cy"))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "customer").select("c_mktsegment").distinct()
    return named.withColumn("seg_no", F.row_number().over(Window.orderBy("c_mktsegment")))


def customers(spark: SparkSession, d: str) -> DataFrame:
    """(c_custkey, k2, seg_no, inhabitants)."""
    c = table(spark, d, "customer").join(F.broadcast(_segments(spark, d)), "c_mktsegment")
    return c.select("c_custkey", F.col("c_nationkey").cast("long").alias("k2"), "seg_no", (100 * (F.col("c_custkey") % 97 + 1)).alias("inhabitants"))


def level3_name() -> Column:
    return F.concat_ws(" ", "level2", F.col("seg_no").cast("string"))


def population2(spark: SparkSession, d: str) -> DataFrame:
    """units2 with population."""
    sums = customers(spark, d).groupBy("k2").agg(F.sum("inhabitants").alias("population"))
    return units2(spark, d).join(F.broadcast(sums), "k2", "left").na.fill(0, ["population"])


def population3(spark: SparkSession, d: str) -> DataFrame:
    """(level1, level2, level3, population)."""
    sums = customers(spark, d).groupBy("k2", "seg_no").agg(F.sum("inhabitants").alias("population"))
    return sums.join(F.broadcast(units2(spark, d)), "k2").select("level1", "level2", level3_name().alias("level3"), "population")


def _position(k: Column) -> tuple[Column, Column]:
    lon = F.col("cx") - 10_000 + 2 * ((k * 7919 + 104_729) % 205_000) + 1
    lat = F.col("cy") - 11_000 + 2 * ((k * 15_485_863 + 32_452_843) % 535_000) + 1
    return lon, lat


#: Service points of this status are the few that are still being set up; as witnesses they leave gaps.
PENDING = "P"


def points(spark: SparkSession, d: str, status: str | None = None) -> DataFrame:
    """(id, level1, level2, level3, operators, lon_u, lat_u): service points, or those of one status; operators is multivalued."""
    rows = table(spark, d, "orders")
    o = (rows.filter(F.col("o_orderstatus") == status) if status else rows).join(customers(spark, d), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(units2(spark, d)), "k2")
    lon, lat = _position(F.col("o_orderkey"))
    p = F.substring("o_orderpriority", 1, 1)
    raw = F.when(p.isin("1", "2"), "OpA, OpB").when(p == "3", "OpB").when(p == "5", "OpA").otherwise("Nsp")
    return o.select(F.col("o_orderkey").alias("id"), "level1", "level2", level3_name().alias("level3"), raw.alias("operators"), lon.alias("lon_u"), lat.alias("lat_u"))


def facilities(spark: SparkSession, d: str) -> DataFrame:
    """(name, k2, level1, level2, level3, operator, status, data_centre, lon_u, lat_u); some units have none."""
    s = table(spark, d, "supplier").filter("s_nationkey % 4 <> 3").join(F.broadcast(units2(spark, d)), F.col("s_nationkey") == F.col("k2"))
    k = F.col("s_suppkey")
    lon, lat = _position(k + 1_000_003)
    status = F.when(k % 25 == 3, "{Ferme}").when(k % 25 != 7, "{Utilise}")
    return s.withColumn("seg_no", k % 5 + 1).select(
        F.col("s_name").alias("name"), k.alias("k"), "k2", "level1", "level2", level3_name().alias("level3"), F.when(k % 3 == 0, "OpA").otherwise("OpB").alias("operator"),
        status.alias("status"), (k % 33 == 1).alias("data_centre"), lon.alias("lon_u"), lat.alias("lat_u"),
    )


def exports(spark: SparkSession, d: str) -> list[tuple[str, DataFrame]]:
    """Three branch exports: one by operator each, and a third that repeats the first region; ids differ from export to export, names have stray blanks."""
    f = facilities(spark, d).filter("NOT data_centre")
    first = table(spark, d, "region").filter("r_regionkey = 0").select(F.col("r_name").alias("level1"))
    picks = [("a", f.filter("operator = 'OpA'")), ("b", f.filter("operator = 'OpB'")), ("c", f.join(F.broadcast(first), "level1", "left_semi"))]
    return [(n, x.withColumns({"fid": F.concat_ws("-", F.lit(n), F.col("k").cast("string")), "raw_name": F.concat(F.lit(" "), F.col("name"), F.lit("  ")), "line_no": F.col("k")})) for n, x in picks]


def zones(spark: SparkSession, d: str) -> DataFrame:
    """(pcode, level2, level1, rings): 16 rectangles per second-level unit, in micro-degrees."""
    z = units2(spark, d).withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(PARTS * PARTS - 1))))
    w, h = CELL_W // PARTS, CELL_H // PARTS
    x0, y0 = (F.col("cx") + F.col("z") % PARTS * w).cast("double"), (F.col("cy") + F.floor(F.col("z") / PARTS) * h).cast("double")
    corners = F.array(*[F.struct((x0 + a * w).alias("x"), (y0 + b * h).alias("y")) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    return z.select(F.concat(F.lit("Z"), F.lpad((F.col("k2") * 16 + F.col("z")).cast("string"), 4, "0")).alias("pcode"), "k2", "level2", "level1", F.array(corners).alias("rings"))


def with_area(polygons: DataFrame) -> DataFrame:
    """Adds area_sqkm of the rings' grid projection."""

    def flat(p: Column) -> Column:
        x, y = projected(p["x"] / 1e6, p["y"] / 1e6)
        return F.struct(x.alias("x"), y.alias("y"))

    areas = F.transform("rings", lambda r: ring_area_km2(F.transform(r, flat)))
    return polygons.withColumn("area_sqkm", F.aggregate(areas, F.lit(0.0), lambda a, b: a + b))


def metres(df: DataFrame, lon: str = "lon_u", lat: str = "lat_u") -> DataFrame:
    """Adds x and y, the grid position of micro-degrees."""
    return with_position(df, F.col(lon) / 1e6, F.col(lat) / 1e6)


def sql_projected(lon: str, lat: str) -> tuple[str, str]:
    """The projection of degrees in SQL: Krüger's series, zone 31."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    e, r = 2 * n**0.5 / (1 + n), 0.9996 * 6378137 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    a = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    s = f"sin(radians({lat}))"
    t = f"sinh(atanh({s}) - {e!r} * atanh({e!r} * {s}))"
    dl = f"radians({lon} - 3)"
    xi, eta = f"atan2({t}, cos({dl}))", f"atanh(sin({dl}) / sqrt(1 + ({t}) * ({t})))"
    x = f"({eta}" + "".join(f" + {c!r} * cos({2 * j} * {xi}) * cosh_sinh_{j}" for j, c in enumerate(a, 1)) + ")"
    for j in (1, 2, 3):
        x = x.replace(f"cosh_sinh_{j}", f"sinh({2 * j} * {eta})")
    y = f"({xi}" + "".join(f" + {c!r} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, c in enumerate(a, 1)) + ")"
    return f"(500000 + {r!r} * {x})", f"({r!r} * {y})"


def sql_unprojected(x: str, y: str) -> tuple[str, str]:
    """Degrees of grid positions in SQL: the inverse series, zone 31."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    r = 0.9996 * 6378137 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    b = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    d = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    xi, eta = f"({y} / {r!r})", f"(({x} - 500000) / {r!r})"
    xi1 = f"({xi}" + "".join(f" - {c!r} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, c in enumerate(b, 1)) + ")"
    eta1 = f"({eta}" + "".join(f" - {c!r} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, c in enumerate(b, 1)) + ")"
    chi = f"asin(sin({xi1}) / cosh({eta1}))"
    phi = f"({chi}" + "".join(f" + {c!r} * sin({2 * j} * {chi})" for j, c in enumerate(d, 1)) + ")"
    return f"(3 + degrees(atan2(sinh({eta1}), cos({xi1}))))", f"degrees({phi})"


def _corner(a: int, b: int) -> tuple[str, str]:
    return sql_projected(f"((x0 + {a * CELL_W // PARTS}) / 1e6)", f"((y0 + {b * CELL_H // PARTS}) / 1e6)")


def _sql_prelude() -> str:
    lon = "cx - 10000 + 2 * (({k} * 7919 + 104729) % 205000) + 1"
    lat = "cy - 11000 + 2 * (({k} * 15485863 + 32452843) % 535000) + 1"
    px, py = sql_projected("(lon_u / 1e6)", "(lat_u / 1e6)")
    c = [_corner(*p) for p in ((0, 0), (1, 0), (1, 1), (0, 1))]
    corners = ", ".join(f"{x} AS x_{i}, {y} AS y_{i}" for i, (x, y) in enumerate(c))
    shoelace = " + ".join(f"(x_{i} * y_{(i + 1) % 4} - x_{(i + 1) % 4} * y_{i})" for i in range(4))
    return f"""WITH
u2 AS (SELECT n_nationkey::BIGINT AS k2, n_name AS level2, r_name AS level1, {WEST} + (n_nationkey % 5)::BIGINT * {CELL_W} AS cx, {SOUTH} + (n_nationkey // 5)::BIGINT * {CELL_H} AS cy
       FROM nation JOIN region ON n_regionkey = r_regionkey),
seg AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) AS seg_no FROM (SELECT DISTINCT c_mktsegment FROM customer)),
cust AS (SELECT c_custkey, c_nationkey::BIGINT AS k2, seg_no, 100 * (c_custkey % 97 + 1) AS inhabitants FROM customer JOIN seg USING (c_mktsegment)),
p2 AS (SELECT u2.*, coalesce(population, 0)::BIGINT AS population FROM u2 LEFT JOIN (SELECT k2, sum(inhabitants) AS population FROM cust GROUP BY 1) USING (k2)),
p3 AS (SELECT level1, level2, level2 || ' ' || seg_no AS level3, sum(inhabitants)::BIGINT AS population FROM cust JOIN u2 USING (k2) GROUP BY 1, 2, 3),
pts0 AS (SELECT o_orderkey AS id, level1, level2, level2 || ' ' || seg_no AS level3,
        CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'OpA, OpB' WHEN substr(o_orderpriority, 1, 1) = '3' THEN 'OpB' WHEN substr(o_orderpriority, 1, 1) = '5' THEN 'OpA' ELSE 'Nsp' END AS operators,
        o_orderstatus AS status, {lon.format(k="o_orderkey")} AS lon_u, {lat.format(k="o_orderkey")} AS lat_u
        FROM orders JOIN cust ON o_custkey = c_custkey JOIN u2 USING (k2)),
pts AS MATERIALIZED (SELECT *, {px} AS x, {py} AS y FROM pts0),
fac0 AS (SELECT s_name AS name, s_suppkey AS k, k2, level1, level2, level2 || ' ' || (s_suppkey % 5 + 1) AS level3, CASE WHEN s_suppkey % 3 = 0 THEN 'OpA' ELSE 'OpB' END AS operator,
        CASE WHEN s_suppkey % 25 = 3 THEN '{{Ferme}}' WHEN s_suppkey % 25 <> 7 THEN '{{Utilise}}' END AS status, s_suppkey % 33 = 1 AS data_centre,
        {lon.format(k="(s_suppkey + 1000003)")} AS lon_u, {lat.format(k="(s_suppkey + 1000003)")} AS lat_u
        FROM supplier JOIN u2 ON s_nationkey = k2 WHERE s_nationkey % 4 <> 3),
fac AS MATERIALIZED (SELECT *, {px} AS x, {py} AS y, NOT coalesce(contains(status, 'Ferm'), false) AS active FROM fac0),
br AS (SELECT * FROM fac WHERE NOT data_centre),
exp_rows AS (SELECT 'a' AS source, 0 AS src_rank, * FROM br WHERE operator = 'OpA' UNION ALL SELECT 'b', 1, * FROM br WHERE operator = 'OpB'
        UNION ALL SELECT 'c', 2, * FROM br WHERE level1 = (SELECT r_name FROM region WHERE r_regionkey = 0)),
pop_op AS (SELECT id, level1, level2, level3, operators, CASE WHEN trim(o) = 'Nsp' THEN 'unknown' ELSE trim(o) END AS operator, lon_u, lat_u, x, y FROM (SELECT *, unnest(string_split(operators, ',')) AS o FROM pts)),
z0 AS (SELECT *, cx + (z % 4) * {CELL_W // PARTS} AS x0, cy + (z // 4) * {CELL_H // PARTS} AS y0 FROM u2, range(16) AS t(z)),
zn AS (SELECT 'Z' || lpad((k2 * 16 + z)::VARCHAR, 4, '0') AS pcode, k2, level2, level1, x0, y0, x0 + {CELL_W // PARTS} AS x1, y0 + {CELL_H // PARTS} AS y1 FROM z0),
za AS MATERIALIZED (SELECT *, abs({shoelace}) / 2e6 AS area_sqkm FROM (SELECT *, {corners} FROM zn)),
"""


PRELUDE = _sql_prelude()
