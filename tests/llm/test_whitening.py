import numpy as np
import pytest

from atlasmill.llm import whitening as W
from atlasmill.llm.registry import op12_whitening


def calls(c):
    made = []

    def product(block):
        made.append(block.shape[1])
        return c @ block

    return product, made


@pytest.mark.parametrize("d,k,kind", [(1, 16, "random"), (5, 16, "random"), (40, 16, "random"), (64, 16, "flat"), (150, 16, "random"), (64, 16, "steep"), (30, 8, "rank"), (64, 16, "same")])
def test_jacobi_davidson_reaches_double_precision(d, k, kind):
    rng = np.random.default_rng(d)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    e = {"random": lambda: rng.random(d) + 0.1, "flat": lambda: 1 + 1e-3 * rng.random(d), "steep": lambda: 10.0 ** -np.linspace(0, 14, d), "rank": lambda: np.append(np.ones(5), np.zeros(d - 5)), "same": lambda: np.ones(d)}[kind]()
    c = (q * e) @ q.T
    product, made = calls((c + c.T) / 2)
    values, vectors = W.jacobi_davidson(product, d, k)
    k = min(k, d)
    assert np.abs(values - np.sort(e)[::-1][:k]).max() <= 1e-12 * e.max()
    assert np.linalg.norm(c @ vectors - vectors * values, axis=0).max() <= 1e-12 * e.max()
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() <= 1e-12
    assert len(made) <= 200


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((12, 12))
    a = a + a.T
    b = rng.standard_normal((12, 3))
    x = W.minres(lambda v: a @ v, b, 40, 1e-13)
    assert np.abs(a @ x - b).max() < 1e-8


def expected(rows, k=16):
    """Distinct vectors, sums, deviation, whitened (up to sign), explained, by numpy."""
    keep = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    x = np.floor(64 * np.array([v for _, v in keep])).astype(int) + 1_000_000
    f = np.unique(x, axis=0)
    n, s = len(f), f.sum(0)
    c = (n * f - s) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return [i for i, _ in keep], n, ((n * x - s) ** 2).sum(1), (n * x - s) / n @ q / np.sqrt(e), e / np.trace(c.T @ c / n)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.standard_normal(6).astype(np.float32).tolist()) for i in range(60)]
    rows += [(60, rows[0][1]), (0, rows[0][1]), (None, rows[3][1]), (61, None), (62, []), (63, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (64, [float("nan")] * 6), (65, [float("-inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (66, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, n string, x string").repartition(5)
    got = W.whiten(df, components=4).toPandas()
    ids, n, deviation, whitened, explained = expected([r for r in rows if r[0] != 66], 4)
    assert len(got) == 4 * len(ids) and set(got["n"]) == {n}
    dev = dict(zip(ids, deviation.tolist(), strict=True))
    assert all(int(d) == dev[None if i != i else i] for i, d in zip(got["vec_id"].astype(object), got["deviation"], strict=True))
    for k in range(4):
        one = got[got["component"] == k + 1].drop_duplicates("vec_id").set_index("vec_id")["whitened"]
        want = {i: w for i, w in zip(ids, whitened[:, k], strict=True) if i is not None}
        a, b = np.array([one[i] for i in want]), np.array([*want.values()])
        assert np.abs(a * np.sign(a @ b) - b).max() < 1e-9
        assert np.allclose(got[got["component"] == k + 1]["explained"], explained[k], rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-10


def test_deviation_beyond_long_is_exact():
    centre = W.Centre.of(10**10 + 1, [10**16 + 7, 5])
    x = np.array([[2_000_000, 3]])
    assert centre.deviation(x) == [((10**10 + 1) * 2_000_000 - 10**16 - 7) ** 2 + ((10**10 + 1) * 3 - 5) ** 2]


def test_no_spread_gives_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert W.whiten(spark.createDataFrame([], schema)).collect() == []
    assert W.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []
    assert W.whiten(spark.createDataFrame([(1, None)], schema)).collect() == []
    one = W.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.5, 2.0])], schema)).collect()
    assert {r.component for r in one} == {1} and {round(r.whitened, 9) for r in one} == {-1.0, 1.0}  # rank one


def test_query_columns(spark):
    df = op12_whitening(spark, "/root/testdata/sf0.001")
    assert dict(df.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    assert df.count() == 16 * 500
