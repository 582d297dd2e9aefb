"""Pages across splits, outlines, grouped distances, bracketed medians, prefixes, pairing, availability, checks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from atlasmill.functions import stats
from atlasmill.operators import checks
from atlasmill.operators.crosswalk import attached_by_prefix, paired
from atlasmill.operators.index import movement
from atlasmill.operators.spatial import dissolved, nearest_km, outline_edges
from atlasmill.sources import readers


def test_pages_are_numbered_across_splits(spark, tmp_path):
    rng = random.Random(1)
    bodies = {f"f{k}.txt": ["x" * rng.randint(0, 3000) + f"\n é {k}-{n}" for n in range(60)] for k in range(3)}
    bodies["empty.txt"], bodies["one.txt"] = [], ["a\nb"]
    bodies["gaps.txt"] = ["", "", "z", "", "y"]
    for name, pages in bodies.items():
        (tmp_path / name).write_bytes("\f".join(pages).encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        df = readers.read_page_texts(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 3
        got = sorted((r.doc_id, r.page, r.body) for r in df.collect())
        lines = spark.read.option("lineSep", "\f").text(str(tmp_path)).select("_metadata.file_name", "_metadata.file_block_start").distinct().count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == sorted((name, n, body) for name, pages in bodies.items() for n, body in enumerate(pages, 1))
    assert lines > len(bodies)  # files were read in several splits


def squares(cells, code="c"):
    return [(code, [[(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1), (x, y)]]) for x, y in cells]


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2


def test_parts_are_merged_to_outlines(spark):
    rng = random.Random(7)
    cells = {"block": [(x, y) for x in range(4) for y in range(3)], "ring": [(x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)], "corner": [(0, 0), (1, 1)], "apart": [(0, 0), (5, 5)], "one": [(2, 2)], "random": [(x, y) for x in range(9) for y in range(9) if rng.random() < 0.6]}
    rows = [r for code, c in cells.items() for r in squares([(float(x), float(y)) for x, y in c], code)]
    rows = [(c, [list(reversed(g)) if k % 3 == 0 else g for g in rings]) for k, (c, rings) in enumerate(rows)]  # turned either way
    df = spark.createDataFrame(rows, "code string, rings array<array<struct<x: double, y: double>>>").repartition(5)
    got = {r.code: [[(p.x, p.y) for p in ring] for ring in r.rings] for r in dissolved(df, "code").collect()}
    assert set(got) == set(cells)
    for code, rings in got.items():
        assert all(r[0] == r[-1] for r in rings) and math.isclose(sum(map(area, rings)), len(cells[code]))
        edges = [frozenset((a, b)) for r in rings for a, b in zip(r, r[1:], strict=False)]
        sides = [frozenset(((x + a, y + b), (x + c, y + d))) for x, y in cells[code] for (a, b), (c, d) in (((0, 0), (1, 0)), ((1, 0), (1, 1)), ((1, 1), (0, 1)), ((0, 1), (0, 0)))]
        assert len(edges) == len(set(edges)) and set(edges) == {s for s in sides if sides.count(s) == 1}
    assert {code: len(got[code]) for code in ("block", "ring", "apart", "one")} == {"block": 1, "ring": 2, "apart": 2, "one": 1}
    assert sorted(map(area, got["ring"])) == [-1.0, 9.0]
    assert outline_edges(df.filter("code = 'block'"), "code").count() == 14
    assert dissolved(df.limit(0), "code").collect() == []


@pytest.mark.parametrize("few,leaf", [(2048, 16), (3, 2), (3, 30)])
def test_grouped_distances_in_one_descent(spark, few, leaf):
    rng = random.Random(few + leaf)
    targets = [(rng.gauss(0, 1) * 1000, rng.random() * 5000, rng.choice("ab")) for _ in range(200)] + [(50.0, 50.0, "a")] * 5 + [(50.0, 50.0, "b"), (None, 1.0, "a"), (9e4, 9e4, "c")]
    sources = [(k, rng.random() * 9000 - 4000, rng.random() * 9000 - 2000) for k in range(300)] + [(900, None, 0.0), (901, -8e5, 7e5)]
    t = spark.createDataFrame(targets, "x double, y double, target_group string")
    s = spark.createDataFrame(sources, "id long, x double, y double").repartition(3)
    groups = {"": F.lit(True), "_a": F.col("target_group") == "a", "_bc": F.col("target_group").isin("b", "c"), "_none": F.col("target_group") == "z"}
    got = {r.id: r for r in nearest_km(s, t, "id", groups, few=few, leaf=leaf).collect()}
    for k, x, y in sources:
        for suffix, ok in (("", "abc"), ("_a", "a"), ("_bc", "bc"), ("_none", "")):
            held = [math.hypot(x - a, y - b) / 1000 for a, b, g in targets if g in ok and ok and a is not None] if x is not None else []
            value = got[k][f"dist_km{suffix}"]
            assert (value is None) == (not held) and (not held or math.isclose(value, min(held), rel_tol=1e-9, abs_tol=1e-12))
    named = {r.id: r.dist_km_a for r in nearest_km(s, t, "id", ["a"], few=few, leaf=leaf).collect()}
    assert all(named[k] == got[k].dist_km_a for k in named)


@pytest.mark.parametrize("ranges", [2, 16, 512])
def test_weighted_median_of_hot_groups(spark, ranges):
    rng = random.Random(ranges)
    rows = [("hot", round(rng.gauss(5, 2), rng.choice((1, 6))), rng.choice((0.5, 1.0, 2.25))) for _ in range(3000)]
    rows += [(None, 1.0, 1.0), (None, 2.0, 3.0), ("tie", 1.0, 1.0), ("tie", 2.0, 1.0), ("one", 4.0, 0.0), ("heavy", 1.0, 1.0), ("heavy", 9.0, 50.0), ("null", None, 1.0)]
    got = dict(map(tuple, stats.weighted_median(spark.createDataFrame(rows, "g string, v double, w double").repartition(4), ["g"], "v", "w", "m", ranges).collect()))
    for g in {r[0] for r in rows} - {"null"}:
        own = sorted((v, w) for k, v, w in rows if k == g)
        total, upto = sum(w for _, w in own), 0.0
        for v, w in own:
            upto += w
            if 2 * upto >= total and sum(x for u, x in own if u <= v) * 2 >= total:
                assert got[g] == v
                break
    assert "null" not in got


def test_totals_are_shared_by_prefix(spark):
    units = spark.createDataFrame([("Danyi 1",), ("Danyi 2",), ("Danyi Elevagnon 1",), ("Agou 1",), ("Dan",), (None,)], "u string")
    shared = spark.createDataFrame([("Danyi", "D1 + D2", 100), ("Danyi Elevagnon", "E", 7), ("", "all", 1), (None, "x", 2)], "prefix string, label string, total long")
    got = {r.u: (r.total, r.shared_with) for r in attached_by_prefix(units, shared, "u", "prefix", "label", "total").collect()}
    assert got == {"Danyi 1": (100, "D1 + D2"), "Danyi 2": (100, "D1 + D2"), "Danyi Elevagnon 1": (7, "E"), "Agou 1": (None, None), "Dan": (None, None), None: (None, None)}


def test_rankings_are_paired_by_key_or_fail(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "u string, r int")
    assert sorted(map(tuple, movement(a, spark.createDataFrame([("y", 1), ("x", 2)], "u string, r int"), "u", "r").collect())) == [("x", 1, 2, -1), ("y", 2, 1, 1)]
    for other in ([("x", 1)], [("x", 1), ("y", 2), ("z", 3)], [("x", 1), ("y", 2), ("y", 3)]):
        with pytest.raises(Exception, match="not on both sides once"):
            paired(a, spark.createDataFrame(other, "u string, q int"), "u").collect()


def test_absent_exports_are_reported(spark, tmp_path):
    schema = readers.strings(["FID", "name"])
    for name, text in (("a_2026.csv", "FID,name\n1, x \n2,y\n"), ("b_2026.csv", "FID,name\n"), ("notes.txt", "no export")):
        (tmp_path / name).write_text(text)
    rows, report = readers.read_exports(spark, str(tmp_path), {"a": "/a_[^/]*csv$", "b": "/b_[^/]*csv$", "c": "/c_[^/]*csv$"}, schema)
    assert sorted(map(tuple, report.collect())) == [("a", 1, 2, "present"), ("b", 1, 0, "empty"), ("c", 0, 0, "missing")]
    assert sorted((r.FID, r.name, r._source) for r in rows.collect()) == [("1", "x", "a"), ("2", "y", "a")]


def test_checks_of_a_table_take_one_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    suite = checks.checked(df, "orders", checks.is_unique("o_orderkey"), checks.is_complete("o_custkey"), checks.has_count(3), checks.is_share("priced", F.col("o_totalprice") > 0, 0.9), checks.no_estimate(F.col("o_custkey") < 0, ["o_totalprice"]))
    plan = suite._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 or plan.count("Scan parquet") == 1
    assert [(r.name, r.ok) for r in suite.collect()] == [("o_orderkey is unique", True), ("o_custkey is complete", True), ("rows = 3", False), ("priced", True), ("flagged rows have null ratios", True)]
    tally = checks.tally(suite).first()
    assert (tally.n_ok, tally.n_checks) == (4, 5)
    assert [r.ok for r in checks.checked(df.limit(0), "none", checks.is_share("s", F.lit(True), 0.5)).collect()] == [False]


def test_samples_do_not_depend_on_partitions(spark):
    rows = [(f"v{k % 40}", None) for k in range(300)] + [(None, None)]
    df = spark.createDataFrame(rows, "a string, b string")
    one, many = ({r["column"]: r.samples for r in checks.column_profile(df.repartition(n)).collect()} for n in (1, 9))
    assert one == many and one["b"] == ""
    assert set(one["a"].split(" | ")) <= {r[0] for r in rows} and 1 <= len(one["a"].split(" | ")) <= checks.SAMPLES


def test_flagged_names(spark):
    rows = spark.createDataFrame([("1", "Tour A"), ("2", "fibre"), ("3", "road")], "id string, title string")
    got = readers.flagged_names(rows, "title", "tour|FIBRE", spark.createDataFrame([("1",), ("1",)], "id string"), "id")
    assert sorted((r.id, r.is_member) for r in got.collect()) == [("1", True), ("2", False)]
