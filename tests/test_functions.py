import hashlib
import math
import random
import re
import unicodedata

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from atlasmill.functions import geo, stats, text


def test_name_key_folds_accents(spark):
    df = spark.createDataFrame([(" Éç-ole n° 3 ",), ("ECOLE N 3",), (None,), ("",)], "n string")
    got = [r.k for r in df.select(text.name_key(F.col("n")).alias("k")).collect()]
    assert got == ["ECOLEN3", "ECOLEN3", None, ""]


def test_name_key_of_every_kind_of_letter(spark):
    names = ["Straße", "ẹlẹ", "Ĳssel", "ı", "ﬁn", "œuf", "Ａ１", "𝐁ac", "日本 2", "½", "é"]
    plain = lambda s: re.sub("[^A-Z0-9]", "", unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().upper())
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n: r.k for r in df.select("n", text.name_key(F.col("n")).alias("k")).collect()}
    assert got == {n: plain(n) for n in names} and got["Straße"] == "STRAE" and got["Ĳssel"] == "IJSSEL" and got["ı"] == ""


def test_name_key_looks_letters_up(spark):
    """No class of hundreds of characters, which an expression tries one by one; words of ASCII are not translated."""
    names = ["plain", "Ĳssel", "œuvre ﬁn", "½", "🄐x", "日本", None]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.name_key(F.col("n")).alias("k"))
    assert "RLIKE" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert {r.n: r.k for r in df.collect()} == {"plain": "PLAIN", "Ĳssel": "IJSSEL", "œuvre ﬁn": "UVREFIN", "½": "12", "🄐x": "AX", "日本": "", None: None}


def test_position_terms_are_computed_once(spark):
    df = spark.createDataFrame([(0.5, 6.25), (1.75, 11.0), (None, 1.0), (3.0, 0.0)], "lon double, lat double")
    x, y = geo.projected(F.col("lon"), F.col("lat"))
    there = geo.with_position(df, F.col("lon"), F.col("lat"))
    assert there.columns == ["lon", "lat", "x", "y"]
    assert there.collect() == df.withColumns({"x": x, "y": y}).collect()
    used = there.select("x", "y", F.floor(F.col("x") / 10), F.floor(F.col("y") / 10))
    assert used._jdf.queryExecution().optimizedPlan().toString().upper().count("ATANH(") == 3


def test_counts_are_digits_blanks_and_no_break_spaces_only(spark):
    df = spark.createDataFrame([(x,) for x in ("1 234", "1\u00a0234", "-5", "+7", "1\t2", "1\u202f2", "", " ", "x", None)], "c string")
    assert [r.n for r in df.select(text.parsed_count(F.col("c")).alias("n")).collect()] == [1234, 1234, *[None] * 8]


def test_stable_id_is_the_digest_of_key_and_degrees(spark):
    df = spark.createDataFrame([("Agence Été", 977073, 8560677), ("x", -5, 10000000)], "n string, lon long, lat long")
    got = [r.i for r in df.select(text.stable_id(F.col("n"), F.col("lon"), F.col("lat")).alias("i")).collect()]
    want = [hashlib.sha1(s.encode()).hexdigest()[:16] for s in ("AGENCEETE|0.977073|8.560677", "X|-0.000005|10.0")]
    assert got == want


def test_statuses_are_asymmetric(spark):
    df = spark.createDataFrame([("{Utilise}",), ("{Ferme}",), (None,), ("Nsp",)], "s string")
    got = df.select(text.branch_is_active(F.col("s")).alias("b"), text.data_centre_is_active(F.col("s")).alias("d")).collect()
    assert [(r.b, r.d) for r in got] == [(True, True), (False, False), (True, False), (True, False)]


def test_operators_keep_null_apart_from_unknown(spark):
    df = spark.createDataFrame([("Moov, Togocom",), ("Nsp",), (None,)], "o string")
    assert [r.a for r in df.select(text.operators_of(F.col("o")).alias("a")).collect()] == [["Moov", "Togocom"], ["unknown"], None]


def test_small_parsers(spark):
    df = spark.createDataFrame([("1 234 567", "KOZAH 2", "POINT (0.97707333 8.5606766)", " x ", "Agence Moov", "TOTAL"), ("12a", "KOZAH", "nowhere", "Nsp", "Moov", "Danyi 1")], "c string, n string, g string, t string, k string, u string")
    got = df.select(
        text.parsed_count(F.col("c")), text.parent_name(F.col("n")), text.wkt_lon(F.col("g")), text.wkt_lat(F.col("g")), text.is_null_token(F.col("t")), text.without_prefix(F.col("k"), "Agence"), text.unit_kind(F.col("u"))
    ).collect()
    assert tuple(got[0]) == (1234567, "KOZAH", 0.977073, 8.560677, False, "Moov", "total")
    assert tuple(got[1]) == (None, None, None, None, True, "Moov", "level3")


def test_projection_there_and_back(spark):
    df = spark.createDataFrame([(3.0, 0.0), (1.2, 8.5), (0.1, 6.0)], "lon double, lat double")
    x, y = geo.projected(F.col("lon"), F.col("lat"))
    lon, lat = geo.unprojected(F.col("x"), F.col("y"))
    got = df.withColumns({"x": x, "y": y}).withColumns({"lon2": lon, "lat2": lat}).collect()
    assert (got[0].x, got[0].y) == pytest.approx((500000, 0))
    for r in got:
        assert (r.lon2, r.lat2) == pytest.approx((r.lon, r.lat), abs=1e-8)


def test_ring_area_and_grid(spark):
    ring = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ((0, 0), (2000, 0), (2000, 3000), (0, 3000), (0, 0))])
    assert spark.range(1).select(geo.ring_area_km2(ring).alias("a")).first().a == 6.0
    assert geo.grid(spark, 0, 0, 10, 5, 1).count() == 50
    assert geo.grid(spark, 0, 0, 10, 5, 1, thin=2).count() == 15


@pytest.mark.parametrize("ranges", [1, 7])
def test_ranks_match_pandas(spark, ranges):
    rng = random.Random(ranges)
    data = [(i, None if rng.random() < 0.1 else float(rng.randint(0, 40))) for i in range(300)]
    df = spark.createDataFrame(data, "k int, v double").repartition(5)
    s = pd.Series([v for _, v in data], dtype=float)
    got = {r.k: r.p for r in stats.percent_rank_of(df, "v", "p", ranges).collect()}
    want = s.rank(pct=True) * 100
    assert all(got[k] is None if pd.isna(w) else got[k] == pytest.approx(w) for k, w in enumerate(want))
    got = {r.k: r.p for r in stats.percentile_of(df, "v", "p", ranges).collect()}
    want = (s.rank() - 1) / (len(s) - 1) * 100
    assert all(got[k] is None if pd.isna(w) else got[k] == pytest.approx(w) for k, w in enumerate(want))
    got = {r.k: r.p for r in stats.descending_rank(df, "v", "p", ranges=ranges).collect()}
    want = s.rank(ascending=False, method="min")
    assert all(got[k] is None if pd.isna(w) else got[k] == w for k, w in enumerate(want))


def test_min_max_of_a_constant_and_of_null(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, None)], "a double, b double")
    got = sorted(map(tuple, stats.min_max(df, {"a": "na", "b": "nb"}).select("na", "nb").collect()), key=str)
    assert got == [(0.0, 50.0), (100.0, 50.0), (None, None)]


def test_weighted_median_is_the_lower_one(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 9.0, 2.0), ("b", 4.0, 1.0), ("b", None, 5.0)], "g string, v double, w double")
    assert sorted(map(tuple, stats.weighted_median(df, ["g"], "v", "w", "m").collect())) == [("a", 2.0), ("b", 4.0)]


def test_exact_percentiles_by_group(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(g, rng.choice((None, rng.gauss(0, 1), 3.0))) for g in ("a", "b", None) for _ in range(400)] + [("one", 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    want = {g: ([float(x) for x in np.percentile(v, [50, 90])] if (v := [y for h, y in rows if h == g and y is not None]) else [None, None]) for g in {r[0] for r in rows}}
    for accuracy in (10_000, 20):
        monkeypatch.setattr(stats, "ACCURACY", accuracy)
        got = {r.g: [r.median, r.p90] for r in stats.group_percentiles(df, ["g"], "v", {"median": 0.5, "p90": 0.9}, [F.count("*").alias("n")]).collect()}
        assert got.keys() == want.keys() and all(a == b if a is None else a == pytest.approx(b) for g in got for a, b in zip(got[g], want[g], strict=True))


def test_concentration(spark):
    df = spark.createDataFrame([("a", 10, 0), ("b", 10, 10), ("c", 20, 30), ("d", 0, 5)], "k string, p long, q long")
    curve = stats.lorenz(df, "k", "p", "q")
    assert stats.lorenz_at(curve).first().share == pytest.approx(0.25)
    x, y = [0, 0.25, 0.5, 1], [0, 0, 0.25, 1]
    area = sum((b - a) * (c + d) for a, b, c, d in zip(x, x[1:], y, y[1:], strict=False))
    assert stats.gini(curve).first().gini == pytest.approx(1 - area)
    assert stats.gini(stats.lorenz(df, "k", "p", "q", ranges=3)).first().gini == pytest.approx(1 - area)


def test_running_sums_by_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.lit(1).alias("one")).repartition(6)
    got = stats.running_sums(df, "v", ["one"], ranges=16).collect()
    assert all(r.sum_one == r.v + 1 for r in got)


@pytest.mark.parametrize("shape,seed", [(8, 20260908), (1, 20220)])
def test_dirichlet_weights_have_the_law_s_moments(spark, shape, seed):
    from atlasmill.operators.index import drawn_weights

    w = np.array([r.w for r in drawn_weights(spark, 2000, 4, shape, seed).collect()])
    assert np.allclose(w.sum(1), 1)
    total = 4 * shape
    deviation = math.sqrt(0.25 * 0.75 / (total + 1))
    assert np.allclose(w.mean(0), 0.25, rtol=0.05)
    assert np.allclose(w.std(0), deviation, rtol=0.05)
    off = np.corrcoef(w.T)[~np.eye(4, dtype=bool)]
    assert np.allclose(off, -1 / 3, atol=0.05)


def test_numbers_do_not_depend_on_partitions(spark):
    from atlasmill.functions.draws import uniform

    one, many = (sorted(tuple(r) for r in spark.range(0, 500, 1, n).select("id", uniform(7, F.col("id"), 3).alias("u")).collect()) for n in (1, 7))
    assert one == many and all(0 < u < 1 for _, u in one)
