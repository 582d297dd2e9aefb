import math
import random

import pytest
from pyspark.sql import functions as F

from atlasmill.operators import checks, crosswalk, index, ordered, planning, tidy
from atlasmill.operators.spatial import nearest_km, point_in_polygon

RINGS = "array<array<struct<x:double,y:double>>>"


def ring(*points):
    return [{"x": float(a), "y": float(b)} for a, b in (*points, points[0])]


def test_point_in_polygon_concave_hole_parts_edge(spark):
    polygons = spark.createDataFrame([
        ("concave", [ring((0, 0), (10, 0), (10, 10), (5, 5), (0, 10))]),
        ("hole", [ring((20, 0), (30, 0), (30, 10), (20, 10)), ring((23, 3), (27, 3), (27, 7), (23, 7))]),
        ("parts", [ring((40, 0), (42, 0), (42, 2), (40, 2)), ring((45, 5), (47, 5), (47, 7), (45, 7))]),
    ], f"name string, rings {RINGS}")
    points = [(1, 2, 2), (2, 5, 8), (3, 21, 1), (4, 25, 5), (5, 41, 1), (6, 46, 6), (7, 43.5, 3), (8, 10, 5), (9, 0, 0), (10, 24, 3)]
    df = spark.createDataFrame([(i, float(x), float(y)) for i, x, y in points], "id int, x double, y double")
    for side in (3.0, 100.0):
        got = {(r.id, r.name) for r in point_in_polygon(df, polygons, side).collect()}
        assert got == {(1, "concave"), (3, "hole"), (5, "parts"), (6, "parts")}


def test_nearest_is_brute_force_either_way(spark):
    rng = random.Random(3)
    src = [(i, rng.uniform(0, 1e5), rng.uniform(0, 1e5)) for i in range(60)] + [(99, 9e5, -3e5)]
    tgt = [(rng.gauss(3e4, 1e4), rng.gauss(5e4, 2e4)) for _ in range(80)]
    want = {i: min(math.hypot(x - a, y - b) for a, b in tgt) / 1000 for i, x, y in src}
    s, t = spark.createDataFrame(src, "id int, x double, y double"), spark.createDataFrame(tgt, "x double, y double")
    for few, leaf in ((1000, 16), (10, 1), (10, 16)):
        got = {r.id: r.dist_km for r in nearest_km(s, t, "id", few=few, leaf=leaf).collect()}
        assert got == pytest.approx(want)
    assert {r.dist_km for r in nearest_km(s, t.filter("x < -1e9"), "id").collect()} == {None}


def test_nearest_in_crowds_and_without_positions(spark):
    """Many targets in one place, sources far off, repeated targets, null positions."""
    rng = random.Random(8)
    tgt = [(rng.gauss(0, 1e-3), rng.gauss(0, 1e-3)) for _ in range(150)] + [(5.0, 5.0)] * 50 + [(1e6, 1e6), (None, 1.0)]
    src = [(i, rng.uniform(-1e6, 2e6), rng.uniform(-1e6, 2e6)) for i in range(40)] + [(50, 0.0, 0.0), (51, 1e6, 1e6), (52, None, 1.0)]
    want = {i: None if x is None else min(math.hypot(x - a, y - b) for a, b in tgt if a is not None) / 1000 for i, x, y in src}
    s, t = spark.createDataFrame(src, "id int, x double, y double"), spark.createDataFrame(tgt, "x double, y double")
    for few in (1000, 10):
        got = {r.id: r.dist_km for r in nearest_km(s, t, "id", few=few, leaf=4).collect()}
        assert got.pop(52) is None and got == pytest.approx({k: v for k, v in want.items() if k != 52})


def test_keep_first_follows_source_order(spark):
    df = spark.createDataFrame([("k", 1, 5, "b"), ("k", 0, 9, "a"), ("k", 0, 2, "c"), ("z", 2, 1, "d")], "id string, src_rank int, line_no int, v string").repartition(3)
    got = {r.id: (r.v, r.present_in) for r in tidy.keep_first(df, ["id"], ["src_rank", "line_no"], listing="v").collect()}
    assert got == {"k": ("c", "a, b, c"), "z": ("d", "d")}


def test_counts_have_true_zeros(spark):
    base = spark.createDataFrame([("a",), ("b",)], "u string")
    rows = spark.createDataFrame([("a", 1), ("a", None)], "u string, v int")
    got = {r.u: (r.n, r.m) for r in tidy.with_unit_counts(base, rows, ["u"], {"n": F.lit(True), "m": F.col("v") == 1}).collect()}
    assert got == {"a": (2, 1), "b": (0, 0)}


def test_overlap_and_exclusive(spark):
    df = spark.createDataFrame([("x", "a"), ("y", "a"), ("x", "b"), ("z", "b")], "k string, source string")
    assert {(r.a, r.b): r.n for r in tidy.source_overlap(df, ["k"]).collect()} == {("a", "a"): 2, ("b", "b"): 2, ("a", "b"): 1}
    assert {r.source: r.n for r in tidy.exclusive_to(df, ["k"]).collect()} == {"a": 1, "b": 1}


def test_empty_scope_is_everything(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "u string, v int")
    assert tidy.in_scope(df, u=[]).count() == 2 and tidy.in_scope(df, u=["a"]).count() == 1


def test_segments_and_hierarchies(spark):
    rows = spark.createDataFrame([("d", 0, False, 9), ("d", 1, True, 5), ("d", 2, False, 2), ("d", 3, False, 3), ("d", 4, True, 1)], "doc string, n int, p boolean, v int")
    got = {r.segment: (r.parent, r.children, r.ok) for r in ordered.segment_sums(rows, ["doc"], ["n"], F.col("p"), "v").collect()}
    assert got == {1: (5, 5, True), 2: (1, 0, False)}
    names = spark.createDataFrame([("KOZAH", 7), ("KOZAH 1", 3), ("KOZAH 2", 4), ("ALONE", 1)], "n string, v int")
    assert [tuple(r) for r in ordered.hierarchical_sums(names, "n", "v").collect()] == [("KOZAH", 7, 7, 2, True)]


def test_page_context_skips_summaries(spark):
    pages = spark.createDataFrame([("d", "T: one\fplain\fT: a T: b\fmore\fT: two")], "doc string, text string")
    got = [(r.page, r.context) for r in ordered.page_context(ordered.pages(pages, "doc", "text"), "doc", r"T: (\w+)").orderBy("page").collect()]
    assert got == [(1, "one"), (2, "one"), (4, "one"), (5, "two")]


def test_pairing_needs_equal_lengths(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "page int, o int, label string")
    b = spark.createDataFrame([(1, 1, 10), (1, 2, 20), (2, 1, 5), (2, 2, 6)], "page int, o int, value int")
    assert sorted((r.label, r.value) for r in ordered.paired(a, b, ["page"], "o").collect()) == [("x", 10), ("y", 20)]


def test_merge_labels(spark):
    texts = ["TOTAL BAS- ", " MONO 2", "VILLE de", "LOME", "ZONE", "sans NOM", "FIN", "", "ET", "X-"]
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "page int, o int, label string")
    got = [r.label for r in ordered.merge_labels(rows, ["page"], "o", "label", ("DE",), ("SANS", "ET")).orderBy("o").collect()]
    assert got == ["TOTAL BAS-MONO 2", "VILLE de LOME", "ZONE sans NOM", "FIN", "ET", "X-"]


def test_sub_units_and_totals_do_not_count(spark):
    rows = spark.createDataFrame([("MARITIME",), (" - DAGL",), ("TOTAL KARA",), ("Togo",), ("KARA",)], "l string")
    assert [r.l for r in ordered.without_sub_units(rows, "l", "TOGO").collect()] == ["MARITIME", "KARA"]


def test_majority_and_shared_values(spark):
    votes = spark.createDataFrame([("z1", "a"), ("z1", "a"), ("z1", "b"), ("z2", "b"), ("z2", "a"), ("z3", None)], "z string, u string")
    got = {r.z: (r.u, r.votes, r.status) for r in crosswalk.majority(votes, "z", "u", 0.6).collect()}
    assert got == {"z1": ("a", 2, "sure"), "z2": ("a", 1, "split"), "z3": (None, 0, "none")}
    units = spark.createDataFrame([("D 1",), ("D 2",), ("E",)], "u string")
    published = spark.createDataFrame([("D 1 + D 2", 70), ("E", 5)], "label string, v int")
    got = {r.u: (r.v, r.shared_with) for r in crosswalk.shared_values(units, published, "u", "label", "v").collect()}
    assert got == {"D 1": (70, "D 1 + D 2"), "D 2": (70, "D 1 + D 2"), "E": (5, None)}


def test_priority_index_by_hand(spark):
    df = spark.createDataFrame([("a", 100.0, 0.0, 10.0, 1000), ("b", 200.0, 5.0, 20.0, 500), ("c", 300.0, 10.0, 30.0, 2000)], "u string, inhabitants_per_point double, branches_per_100k double, distance_km double, population long")
    got = {r.u: (round(r.score, 6), r["rank"]) for r in index.priority_index(df, "u").collect()}
    d4 = (1000 - 500) / 1500 * 100
    assert got == {"a": (round(25 + 0.2 * d4, 6), 3), "b": (40.0, 2), "c": (75.0, 1)}


def test_drawn_weights_sum_to_one_and_repeat(spark):
    one, two = (sorted(map(tuple, index.drawn_weights(spark, 50, 4, 3, 7).select("draw", F.transform("w", lambda x: F.round(x, 9)).alias("w")).collect())) for _ in range(2))
    assert one == two and all(abs(sum(w) - 1) < 1e-6 and min(w) > 0 for _, w in one)


def test_levers_and_plan(spark):
    df = spark.createDataFrame([("a", 0, 900.0, 30.0, 5, 0, 1, 5, 4500, 1), ("b", 2, 100.0, 5.0, 5, 5, 0, 10, 1000, 2)], "u string, active_branches int, inhabitants_per_point double, distance_km double, points_a int, points_b int, points_unknown int, points int, population long, rank long")
    got = {r.u: r.levers for r in planning.levers(df).collect()}
    assert got == {"a": list(planning.LEVERS), "b": []}
    plan = [(r.u, r.opened, r.sum_opened, r.sum_extra_branch) for r in planning.coverage_plan(df, "u", "rank", 100.0, 2).orderBy("rank").collect()]
    assert plan == [("a", 40, 40, 1), ("b", 0, 40, 1)]


def test_profiles_and_checks(spark):
    df = spark.createDataFrame([(" a", 1), ("Nsp", 2), (None, 2), ("", 3)], "s string, k int")
    p = {r["column"]: r for r in checks.column_profile(df).collect()}
    assert (p["s"].nulls, p["s"].null_tokens, p["s"].dirty_edges, p["s"].distinct_values) == (1, 2, 1, 3)
    results = checks.registry([checks.unique(df, "t", "k"), checks.complete(df, "t", "s"), checks.has_rows(df, "t", 4)])
    assert {(r.name, r.ok) for r in results.collect()} == {("k is unique", False), ("s is complete", False), ("rows = 4", True)}
    assert tuple(checks.tally(results).first()) == (1, 3)


def test_no_branch_no_division(spark):
    df = spark.createDataFrame([("a", 10, 0, 0)], "u string, population long, points long, active_branches long")
    r = tidy.access_ratios(df).first()
    assert r.inhabitants_per_point is None and r.points_per_10k == 0


def test_single_sources_meet_few_targets(spark):
    """The rows of the last join are a few a source: targets that the block's box leaves out meet no source."""
    rng = random.Random(12)
    spots = lambda n: [(i, rng.uniform(0, 1e5), rng.uniform(0, 1e5)) for i in range(n)]
    sources, targets = spots(4000), spots(1500)
    near = nearest_km(spark.createDataFrame(sources, "id long, x double, y double"), spark.createDataFrame(targets, "k long, x double, y double"), "id", few=0, carry=("x",))
    got = {r.id: r for r in near.collect()}
    assert all(got[i].x == x and got[i].dist_km == pytest.approx(min(math.hypot(x - a, y - b) for _, a, b in targets) / 1000) for i, x, y in sources[:200])

    def join_rows(plan):
        inner = [plan.executedPlan()] if plan.nodeName() == "AdaptiveSparkPlan" else [plan.plan()] if "QueryStage" in plan.nodeName() else []
        children = plan.children()
        below = max([join_rows(p) for p in [*inner, *(children.apply(i) for i in range(children.size()))]], default=0)
        return max(below, plan.metrics().apply("numOutputRows").value()) if "Join" in plan.nodeName() else below

    assert len(got) == len(sources) <= join_rows(near._jdf.queryExecution().executedPlan()) < 12 * len(sources)


@pytest.mark.parametrize("groups", [None, ["a", "b", "z"]])
def test_few_sources_stream_many_targets(spark, tmp_path, monkeypatch, groups):
    """Up to `few` sources and more targets: the same distances with no tables but the targets' and the sources' own."""
    from atlasmill.operators import spatial

    rng = random.Random(21)
    targets = [(rng.gauss(0, 9e3), rng.gauss(0, 9e3), rng.choice("ab")) for _ in range(900)] + [(None, 1.0, "a")]
    sources = [("s%d" % k, k, rng.uniform(-9e4, 9e4), rng.uniform(-9e4, 9e4)) for k in range(30)] + [("none", 30, None, 1.0), (None, 31, 5.0, 5.0)]
    written = []
    monkeypatch.setattr(spatial, "staged", lambda df, label, own=spatial.staged: written.append(label) or own(df, label))
    t = spark.createDataFrame(targets, "x double, y double, target_group string").repartition(5)
    near = nearest_km(spark.createDataFrame(sources, "id string, no int, x double, y double"), t, "id", groups, few=40, carry=("no",))
    got = {r.no: r for r in near.collect()}
    assert written == ["targets", "sources-placed"] and len(got) == len(sources)
    for name, no, x, y in sources:
        assert got[no].id == name
        for g in groups or [""]:
            held = [math.hypot(x - a, y - b) / 1000 for a, b, o in targets if g in ("", o) and a is not None] if x is not None else []
            value = got[no]["dist_km" + (g and f"_{g}")]
            assert value == pytest.approx(min(held)) if held else value is None


def test_point_in_polygon_tests_boxed_pairs_only(spark):
    """Polygons that share a cell with a point, but not its place, do not reach the exact test; edges are made once a polygon."""
    polygons = spark.createDataFrame([(f"p{k}", [ring((k, 0), (k + 1, 0), (k + 1, 1), (k, 1))]) for k in range(50)], f"name string, rings {RINGS}")
    points = spark.range(50).select("id", (F.col("id") + 0.5).alias("x"), F.lit(0.5).alias("y"))
    found = point_in_polygon(points, polygons, 100.0)
    assert {(r.id, r.name) for r in found.collect()} == {(k, f"p{k}") for k in range(50)}
    join = next(line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line)
    assert "zip_with" not in join and join.index("__lox") < join.index("exists(")
