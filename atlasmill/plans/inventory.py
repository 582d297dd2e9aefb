"""Queries on exports, names, operators, hierarchies and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import ratio
from ..functions.text import branch_is_active, data_centre_is_active, name_key, operators_of, stable_id, stripped
from ..operators import checks as C
from ..operators.crosswalk import canonical, children_spread, fused, missing_both_ways, several_parents, spelling_variants
from ..operators.ordered import carried, hierarchical_sums, segment_sums
from ..operators.tidy import access_ratios, exclusive_to, in_scope, keep_first, name_join, source_overlap, top_k, top_per_parent, union_exports, value_shares, with_unit_counts, within_box_of
from . import fixtures as X
from .registry import query

PRELUDE = X.PRELUDE


def branches(spark: SparkSession, d: str) -> DataFrame:
    """The three exports as one table of unique branches."""
    rows = union_exports(X.exports(spark, d)).withColumn("name", stripped(F.col("raw_name"))).drop("raw_name")
    rows = rows.withColumn("id", stable_id(F.col("name"), F.col("lon_u"), F.col("lat_u")))
    return keep_first(rows, ["id"], ["src_rank", "line_no"], listing="source").withColumn("active", branch_is_active(F.col("status")))


def data_centres(spark: SparkSession, d: str) -> DataFrame:
    return X.facilities(spark, d).filter("data_centre").withColumn("active", data_centre_is_active(F.col("status")))


def points_by_operator(spark: SparkSession, d: str) -> DataFrame:
    return X.points(spark, d).withColumn("operator", F.explode_outer(operators_of(F.col("operators"))))


SQL_KEY = "upper(regexp_replace(strip_accents({}), '[^A-Za-z0-9]', '', 'g'))"


def _sql_degrees(c: str) -> str:
    f = f"rtrim(lpad((abs({c}) % 1000000)::VARCHAR, 6, '0'), '0')"
    return f"(CASE WHEN {c} < 0 THEN '-' ELSE '' END || (abs({c}) // 1000000)::VARCHAR || '.' || CASE WHEN {f} = '' THEN '0' ELSE {f} END)"


SQL_ID = f"substr(sha1({SQL_KEY.format('name')} || '|' || {_sql_degrees('lon_u')} || '|' || {_sql_degrees('lat_u')}), 1, 16)"


@query(PRELUDE + f"""e AS (SELECT {SQL_ID} AS id, * FROM exp_rows)
SELECT id, min_by(name, src_rank * 1000000 + k) AS name, min_by(operator, src_rank * 1000000 + k) AS operator, min_by(level2, src_rank * 1000000 + k) AS level2,
       bool_or(active) AS active, string_agg(DISTINCT source, ', ' ORDER BY source) AS present_in FROM e GROUP BY id""")
def facilities_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return branches(spark, d).select("id", "name", "operator", "level2", "active", "present_in")


@query(PRELUDE + f"""e AS (SELECT DISTINCT {SQL_ID} AS id, source FROM exp_rows)
SELECT x.source AS a, y.source AS b, count(*) AS n FROM e x JOIN e y ON x.id = y.id AND x.source <= y.source GROUP BY 1, 2""")
def source_overlap_sizes(spark: SparkSession, d: str) -> DataFrame:
    rows = union_exports(X.exports(spark, d)).withColumn("name", stripped(F.col("raw_name")))
    return source_overlap(rows.withColumn("id", stable_id(F.col("name"), F.col("lon_u"), F.col("lat_u"))), ["id"])


@query(PRELUDE + f"""e AS (SELECT DISTINCT {SQL_ID} AS id, source FROM exp_rows), o AS (SELECT id, min(source) AS source, count(*) AS k FROM e GROUP BY 1)
SELECT source, count(*) AS n FROM o WHERE k = 1 GROUP BY 1""")
def exclusive_sources(spark: SparkSession, d: str) -> DataFrame:
    rows = union_exports(X.exports(spark, d)).withColumn("name", stripped(F.col("raw_name")))
    return exclusive_to(rows.withColumn("id", stable_id(F.col("name"), F.col("lon_u"), F.col("lat_u"))), ["id"])


@query(PRELUDE + """t AS (SELECT count(*) AS t FROM pop_op)
SELECT operator, count(*) AS n, round(count(*) / (SELECT t FROM t), 6) AS share FROM pop_op GROUP BY operator""")
def operator_explode(spark: SparkSession, d: str) -> DataFrame:
    return value_shares(points_by_operator(spark, d), "operator").withColumn("share", F.round("share", 6))


def counted(spark: SparkSession, d: str, base: DataFrame, level: str) -> DataFrame:
    """`base` with counts of points, branches and data centres at its level."""
    has = lambda o: F.array_contains(operators_of(F.col("operators")), o)
    out = with_unit_counts(base, X.points(spark, d), [level], {"points": F.lit(True), "points_a": has("OpA"), "points_b": has("OpB"), "points_unknown": has("unknown")})
    is_ = lambda o: F.col("operator") == o
    out = with_unit_counts(out, branches(spark, d), [level], {"branches": F.lit(True), "active_branches": F.col("active"), "branches_a": is_("OpA"), "branches_b": is_("OpB")})
    return with_unit_counts(out, data_centres(spark, d), [level], {"data_centres": F.lit(True)})


def densities2(spark: SparkSession, d: str, zones: DataFrame | None = None) -> DataFrame:
    """(level1, level2, population, area_sqkm, density): what needs no counts of points. `zones` have level2 and area_sqkm, if the caller has them."""
    areas = (X.with_area(X.zones(spark, d)) if zones is None else zones).groupBy("level2").agg(F.round(F.sum(F.round("area_sqkm", 6)), 3).alias("area_sqkm"))
    base = X.population2(spark, d).join(F.broadcast(areas), "level2", "left").select("level1", "level2", "population", "area_sqkm")
    return base.withColumn("density", F.col("population") / F.col("area_sqkm"))


def indicators2(spark: SparkSession, d: str, zones: DataFrame | None = None) -> DataFrame:
    out = access_ratios(counted(spark, d, densities2(spark, d, zones), "level2"))
    return out.withColumn("points_per_1000km2", ratio(F.col("points"), F.col("area_sqkm"), 1000))


def sql_counts(level: str) -> str:
    return f"""pc AS (SELECT {level}, count(*) AS points, count(*) FILTER (contains(operators, 'OpA')) AS points_a, count(*) FILTER (contains(operators, 'OpB')) AS points_b, count(*) FILTER (operators = 'Nsp') AS points_unknown FROM pts GROUP BY 1),
bc AS (SELECT {level}, count(*) AS branches, count(*) FILTER (active) AS active_branches, count(*) FILTER (operator = 'OpA') AS branches_a, count(*) FILTER (operator = 'OpB') AS branches_b FROM br GROUP BY 1),
dc AS (SELECT {level}, count(*) AS data_centres FROM fac WHERE data_centre GROUP BY 1),
"""


_C = "points points_a points_b points_unknown branches active_branches branches_a branches_b data_centres".split()
_COALESCED = ", ".join(f"coalesce({c}, 0) AS {c}" for c in _C)
_RATIOS = "population / nullif(points, 0) AS inhabitants_per_point, points / nullif(population, 0) * 1e4 AS points_per_10k, active_branches / nullif(population, 0) * 1e5 AS branches_per_100k"
SQL_IND2 = PRELUDE + sql_counts("level2") + f"""
ar AS (SELECT level2, round(sum(round(area_sqkm, 6)), 3) AS area_sqkm FROM za GROUP BY 1),
c2 AS (SELECT level1, level2, population, area_sqkm, {_COALESCED} FROM p2 LEFT JOIN ar USING (level2) LEFT JOIN pc USING (level2) LEFT JOIN bc USING (level2) LEFT JOIN dc USING (level2)),
ind2 AS MATERIALIZED (SELECT *, {_RATIOS}, population / area_sqkm AS density, points / area_sqkm * 1000 AS points_per_1000km2 FROM c2)
"""
_ROUNDED = ("inhabitants_per_point", "points_per_10k", "branches_per_100k", "density", "points_per_1000km2")


def rounded(df: DataFrame, columns: tuple[str, ...], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(SQL_IND2 + f"SELECT level1, level2, population, area_sqkm, {', '.join(_C)}, {', '.join(f'round({c}, 6) AS {c}' for c in _ROUNDED)} FROM ind2")
def indicators_level2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(indicators2(spark, d), _ROUNDED)


def indicators3(spark: SparkSession, d: str) -> DataFrame:
    """Level-3 units; those whose number is 5 have a population that is shared with others: no ratio per inhabitant."""
    counted3 = counted(spark, d, X.population3(spark, d), "level3").withColumn("reliable", ~F.col("level3").endswith(" 5"))
    return access_ratios(counted3, F.col("reliable"))


SQL_IND3 = PRELUDE + sql_counts("level3") + f"""
c3 AS (SELECT level1, level2, level3, population, {_COALESCED}, NOT level3 LIKE '% 5' AS reliable FROM p3 LEFT JOIN pc USING (level3) LEFT JOIN bc USING (level3) LEFT JOIN dc USING (level3)),
ind3 AS MATERIALIZED (SELECT * EXCLUDE (inhabitants_per_point, points_per_10k, branches_per_100k), CASE WHEN reliable THEN inhabitants_per_point END AS inhabitants_per_point, CASE WHEN reliable THEN points_per_10k END AS points_per_10k,
         CASE WHEN reliable THEN branches_per_100k END AS branches_per_100k FROM (SELECT *, {_RATIOS} FROM c3))
"""


@query(SQL_IND3 + f"SELECT level1, level2, level3, population, reliable, {', '.join(_C)}, {', '.join(f'round({c}, 6) AS {c}' for c in _ROUNDED[:3])} FROM ind3")
def indicators_level3(spark: SparkSession, d: str) -> DataFrame:
    return rounded(indicators3(spark, d), _ROUNDED[:3])


@query(SQL_IND2 + """SELECT 'level2' AS level, count(*) AS n_units, count(*) FILTER (active_branches = 0) AS n_deserts, coalesce(sum(population) FILTER (active_branches = 0), 0)::BIGINT AS inhabitants,
round(coalesce(sum(population) FILTER (active_branches = 0), 0) / sum(population), 6) AS share, round(sum(population) / sum(points), 6) AS national_per_point FROM ind2""")
def deserts(spark: SparkSession, d: str) -> DataFrame:
    without = F.coalesce(F.sum(F.when(F.col("active_branches") == 0, F.col("population"))), F.lit(0))
    return indicators2(spark, d).agg(
        F.lit("level2").alias("level"), F.count("*").alias("n_units"), F.count_if(F.col("active_branches") == 0).alias("n_deserts"), without.alias("inhabitants"),
        F.round(without / F.sum("population"), 6).alias("share"), F.round(F.sum("population") / F.sum("points"), 6).alias("national_per_point"),
    )


@query(f"""WITH w AS (SELECT unnest(string_split_regex(text, '[^\\p{{L}}]+')) AS word FROM documents), k AS (SELECT {SQL_KEY.format("word")} AS key, word FROM w)
SELECT key, count(DISTINCT word) AS n_spellings, string_agg(DISTINCT word, ', ' ORDER BY word) AS spellings FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT word) > 1""")
def norm_keys(spark: SparkSession, d: str) -> DataFrame:
    words = X.table(spark, d, "documents").select(F.explode(F.split("text", r"[^\p{L}]+")).alias("word")).distinct()
    return spelling_variants(words, "word", name_key(F.col("word"))).filter("key <> ''")


_PROFILED = ("o_orderstatus", "o_orderpriority", "o_totalprice", "o_custkey")


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) FILTER ({c} IS NULL) AS nulls, count(*) FILTER (trim({c}::VARCHAR) IN ('Nsp', 'nsp', 'NSP', 'Néant', 'Neant', 'néant', '', 'None', 'null', 'NULL')) AS null_tokens,
count(DISTINCT {c}) AS distinct_values, count(*) FILTER ({c}::VARCHAR <> trim({c}::VARCHAR)) AS dirty_edges, min({c}::VARCHAR) AS smallest, max({c}::VARCHAR) AS largest,
array_to_string(list_sort(list_distinct([{', '.join(f"substr(min(substr(md5({c}::VARCHAR), {1 + 8 * k}, 8) || {c}::VARCHAR), 9)" for k in range(C.SAMPLES))}])), ' | ') AS samples FROM orders""" for c in _PROFILED))
def column_profile(spark: SparkSession, d: str) -> DataFrame:
    return C.column_profile(X.table(spark, d, "orders").select(*_PROFILED))


@query(PRELUDE + """s AS (SELECT lon_u, lat_u, count(*) AS n FROM pts GROUP BY 1, 2)
SELECT min(lon_u) / 1e6 AS west, max(lon_u) / 1e6 AS east, min(lat_u) / 1e6 AS south, max(lat_u) / 1e6 AS north, count(*) FILTER (NOT (lon_u / 1e6 BETWEEN -0.15 AND 1.8 AND lat_u / 1e6 BETWEEN 5.9 AND 11.14)) AS outside,
count(*) FILTER (abs(lon_u / 1e6) < 1e-9 AND abs(lat_u / 1e6) < 1e-9) AS at_null_island, (SELECT coalesce(sum(n) FILTER (n > 1), 0)::BIGINT FROM s) AS at_shared_positions FROM pts""")
def geometry_profile(spark: SparkSession, d: str) -> DataFrame:
    p = X.points(spark, d).select((F.col("lon_u") / 1e6).alias("lon"), (F.col("lat_u") / 1e6).alias("lat"))
    return C.geometry_profile(p, "lon", "lat", (-0.15, 5.9, 1.8, 11.14))


@query(PRELUDE + """h AS (SELECT DISTINCT substr(level2, 1, 1) AS initial, level1 FROM p3) SELECT initial, count(DISTINCT level1) AS n_parents FROM h GROUP BY 1 HAVING count(DISTINCT level1) > 1""")
def hierarchy_integrity(spark: SparkSession, d: str) -> DataFrame:
    rows = X.population3(spark, d).select(F.substring("level2", 1, 1).alias("initial"), "level1")
    return several_parents(rows, "initial", "level1")


@query(PRELUDE + """r AS (SELECT level2 AS name, population FROM p2 UNION ALL SELECT level3, CASE WHEN level3 LIKE 'FRANCE 2' THEN population + 1 ELSE population END FROM p3),
c AS (SELECT regexp_extract(name, '^(.+?)\\s+(\\d+)$', 1) AS parent, sum(population)::BIGINT AS children, count(*) AS n_children FROM r WHERE regexp_matches(name, '^(.+?)\\s+(\\d+)$') GROUP BY 1)
SELECT parent, population AS declared, children, n_children, population = children AS ok FROM r JOIN c ON name = parent""")
def hierarchical_sum_check(spark: SparkSession, d: str) -> DataFrame:
    wrong = F.col("population") + F.when(F.col("level3") == "FRANCE 2", 1).otherwise(0)  # one child that does not fit
    rows = X.population2(spark, d).select(F.col("level2").alias("name"), "population").unionByName(X.population3(spark, d).select(F.col("level3").alias("name"), wrong.alias("population")))
    return hierarchical_sums(rows, "name", "population")


@query("""WITH s AS (SELECT *, length(text) AS n, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS segment FROM conversations)
SELECT conv_id, segment::BIGINT AS segment, sum(CASE WHEN role = 'user' THEN n END)::BIGINT AS parent, coalesce(sum(CASE WHEN role <> 'user' THEN n END), 0)::BIGINT AS children,
sum(CASE WHEN role = 'user' THEN n END) = coalesce(sum(CASE WHEN role <> 'user' THEN n END), 0) AS ok FROM s WHERE segment > 0 GROUP BY 1, 2""")
def segment_sum_check(spark: SparkSession, d: str) -> DataFrame:
    rows = X.table(spark, d, "conversations").select("conv_id", "turn", "role", F.char_length("text").alias("n"))
    return segment_sums(rows, ["conv_id"], ["turn"], F.col("role") == "user", "n")


@query("""SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS question FROM conversations""")
def context_carry(spark: SparkSession, d: str) -> DataFrame:
    rows = X.table(spark, d, "conversations")
    return carried(rows, ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("text")), "question").select("conv_id", "turn", "role", "question")


@query(PRELUDE + """o AS (SELECT level2, operator FROM pop_op)
SELECT level2, count(*) FILTER (operator = 'OpA') AS OpA, count(*) FILTER (operator = 'OpB') AS OpB, count(*) FILTER (operator = 'unknown') AS unknown FROM u2 LEFT JOIN o USING (level2) GROUP BY level2""")
def operator_pivot(spark: SparkSession, d: str) -> DataFrame:
    wide = points_by_operator(spark, d).groupBy("level2").pivot("operator", ["OpA", "OpB", "unknown"]).count()
    return X.units2(spark, d).select("level2").join(wide, "level2", "left").na.fill(0)


@query(PRELUDE + """q AS (SELECT 1) SELECT level2, count(*) FILTER (operators = 'OpA') AS only_a, count(*) FILTER (operators = 'OpB') AS only_b, count(*) FILTER (operators = 'OpA, OpB') AS both FROM pts GROUP BY 1""")
def exclusive_operators(spark: SparkSession, d: str) -> DataFrame:
    is_ = lambda v: F.count_if(F.col("operators") == v)
    return X.points(spark, d).groupBy("level2").agg(is_("OpA").alias("only_a"), is_("OpB").alias("only_b"), is_("OpA, OpB").alias("both"))


@query(PRELUDE + """n AS (SELECT lower(level2) || '!' AS raw, k2 FROM u2 WHERE k2 % 5 <> 4 UNION ALL SELECT 'nowhere', 99)
SELECT raw, coalesce(level2, raw) AS canonical, population FROM n LEFT JOIN p2 ON regexp_replace(upper(raw), '[^A-Z0-9]', '', 'g') = regexp_replace(upper(level2), '[^A-Z0-9]', '', 'g')""")
def name_join_units(spark: SparkSession, d: str) -> DataFrame:
    raw = X.units2(spark, d).filter("k2 % 5 <> 4").select(F.concat(F.lower("level2"), F.lit("!")).alias("raw"))
    raw = raw.unionByName(raw.agg(F.lit("nowhere").alias("raw")))
    named = canonical(raw, X.units2(spark, d), "raw", "level2", name_key, "canonical")
    return name_join(named, X.population2(spark, d).select("level2", "population"), "raw", "level2", name_key).select("raw", "canonical", "population")


@query(PRELUDE + """a AS (SELECT DISTINCT level2 FROM fac), b AS (SELECT level2 FROM u2 WHERE k2 % 6 <> 1)
SELECT 'left' AS side, level2 FROM a WHERE level2 NOT IN (SELECT level2 FROM b) UNION ALL SELECT 'right', level2 FROM b WHERE level2 NOT IN (SELECT level2 FROM a)""")
def missing_names(spark: SparkSession, d: str) -> DataFrame:
    return missing_both_ways(X.facilities(spark, d), X.units2(spark, d).filter("k2 % 6 <> 1"), "level2")


@query(PRELUDE + """m AS (SELECT k2 // 2 AS code, k2, level2, level1 FROM u2), z AS (SELECT k2, round(sum(round(area_sqkm, 6)), 3) AS a FROM za GROUP BY 1)
SELECT code, min_by(level2, k2) AS name, round(sum(a), 3) AS area_sqkm, string_agg(DISTINCT level1, ' + ' ORDER BY level1) AS level1 FROM m JOIN z USING (k2) GROUP BY 1""")
def reconcile_codes(spark: SparkSession, d: str) -> DataFrame:
    areas = X.with_area(X.zones(spark, d)).groupBy("k2").agg(F.round(F.sum(F.round("area_sqkm", 6)), 3).alias("area_sqkm"))
    units = X.units2(spark, d).join(F.broadcast(areas), "k2").withColumns({"code": F.floor(F.col("k2") / 2), "name": F.col("level2")})
    return fused(units, "code", "k2", ["name"], ["area_sqkm"], ["level1"]).withColumn("area_sqkm", F.round("area_sqkm", 3))


@query(PRELUDE + """c AS (SELECT level2, count(DISTINCT level3) AS n FROM fac GROUP BY 1) SELECT min(n) AS min_n, median(n) AS median_n, max(n) AS max_n, (SELECT level2 FROM c ORDER BY n DESC, level2 LIMIT 1) AS most FROM c""")
def children_spread_of_units(spark: SparkSession, d: str) -> DataFrame:
    return children_spread(X.facilities(spark, d), "level2", "level3")


@query(PRELUDE + """s AS (SELECT min(lon_u) AS a, max(lon_u) AS b, min(lat_u) AS c, max(lat_u) AS e FROM fac WHERE level1 = 'EUROPE')
SELECT id, level2, operators FROM pts, s WHERE level1 IN ('EUROPE', 'ASIA') AND lon_u BETWEEN a AND b AND lat_u BETWEEN c AND e""")
def scope_filter(spark: SparkSession, d: str) -> DataFrame:
    chosen = in_scope(X.points(spark, d), level1=["EUROPE", "ASIA"], level2=[])
    return within_box_of(chosen, X.facilities(spark, d).filter("level1 = 'EUROPE'"), "lon_u", "lat_u").select("id", "level2", "operators")


@query(SQL_IND2 + "SELECT level2, population, points FROM ind2 ORDER BY population DESC, level2 LIMIT 10")
def top_units(spark: SparkSession, d: str) -> DataFrame:
    return top_k(indicators2(spark, d), "population", "level2", 10).select("level2", "population", "points")


@query(SQL_IND3 + "SELECT level2, level3, round(inhabitants_per_point, 6) AS inhabitants_per_point FROM (SELECT *, row_number() OVER (PARTITION BY level2 ORDER BY inhabitants_per_point DESC NULLS LAST, level3) AS n FROM ind3) WHERE n = 1")
def top_child(spark: SparkSession, d: str) -> DataFrame:
    return rounded(top_per_parent(indicators3(spark, d), "level2", "inhabitants_per_point", "level3"), ("inhabitants_per_point",)).select("level2", "level3", "inhabitants_per_point")


@query(PRELUDE + """k AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ()))
SELECT * FROM k""")
def grouped_levels(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query(PRELUDE + """k AS (SELECT count(*) AS n, count(DISTINCT (l_orderkey, l_linenumber)) AS u FROM lineitem), f AS (SELECT count(*) AS n, count(DISTINCT (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)) AS u FROM lineitem),
g AS (SELECT count(DISTINCT (l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)) AS u FROM lineitem)
SELECT k.n - k.u AS by_key, k.n - g.u AS by_content FROM k, g""")
def duplicate_rows(spark: SparkSession, d: str) -> DataFrame:
    return C.duplicates(X.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(PRELUDE + """e AS (SELECT unnest(['events', 'orders', 'parts', 'none']) AS dataset), l AS (SELECT 'orders' AS dataset, count(*) AS n_rows FROM orders UNION ALL SELECT 'parts', count(*) FROM part UNION ALL SELECT 'none', count(*) FROM part WHERE p_partkey < 0)
SELECT dataset, n_rows, CASE WHEN n_rows IS NULL THEN 'missing' WHEN n_rows = 0 THEN 'empty' ELSE 'present' END AS status FROM e LEFT JOIN l USING (dataset)""")
def dataset_inventory(spark: SparkSession, d: str) -> DataFrame:
    count = lambda name, df: df.agg(F.lit(name).alias("dataset"), F.count("*").alias("n_rows"))
    listing = count("orders", X.table(spark, d, "orders")).unionByName(count("parts", X.table(spark, d, "part"))).unionByName(count("none", X.table(spark, d, "part").filter("p_partkey < 0")))
    expected = spark.range(1).select(F.explode(F.array(*map(F.lit, ("events", "orders", "parts", "none")))).alias("dataset"))
    return C.inventory(expected, listing, ["dataset"])


@query(SQL_IND3 + """, b AS (SELECT DISTINCT k FROM exp_rows), x AS (SELECT
 (SELECT count(*) FROM pts) AS n, (SELECT count(DISTINCT id) FROM pts) AS u, (SELECT sum(population) FROM p2) AS a2, (SELECT sum(population) FROM p3) AS a3, (SELECT count(DISTINCT id) FROM pop_op) AS o)
SELECT 'points' AS step, 'id is unique' AS name, n = u AS ok FROM x UNION ALL SELECT 'points', 'no point is lost by exploding', o = n FROM x
UNION ALL SELECT 'population', 'level 3 adds up to level 2', a2 = a3 FROM x UNION ALL SELECT 'points', 'operators is complete', (SELECT count(*) FROM pts WHERE operators IS NULL) = 0
UNION ALL SELECT 'branches', 'rows = 10', (SELECT count(*) FROM b) = 10 UNION ALL SELECT 'level3', 'flagged rows have null ratios', (SELECT count(*) FROM ind3 WHERE NOT reliable AND (inhabitants_per_point IS NOT NULL OR points_per_10k IS NOT NULL)) = 0 UNION ALL SELECT 'points', 'most points have a known operator', (SELECT avg((operators <> 'Nsp')::INT) FROM pts) >= 0.5""")
def quality_checks(spark: SparkSession, d: str) -> DataFrame:
    p, exploded = X.points(spark, d), points_by_operator(spark, d)
    return C.registry([
        C.checked(p, "points", C.is_unique("id"), C.is_complete("operators"), C.is_share("most points have a known operator", F.col("operators") != "Nsp", 0.5)),
        C.same_keys(p, exploded, "id", "points", "no point is lost by exploding"),
        C.same_sum(X.population2(spark, d), "population", X.population3(spark, d), "population", "population", "level 3 adds up to level 2"),
        C.checked(branches(spark, d), "branches", C.has_count(10)),
        C.checked(indicators3(spark, d), "level3", C.no_estimate(~F.col("reliable"), ["inhabitants_per_point", "points_per_10k"])),
    ]).drop("detail")
