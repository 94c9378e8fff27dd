import math

import numpy as np
import pytest

from rookery.llm.whitening import Spectrum, deviations, secular_roots, spectrum_of, whiten, whole_vectors


def scatter(x):
    off = x - x.mean(0)
    return off.T @ off


def close_to(spectrum, x):
    want = scatter(x)
    got = spectrum.vectors @ np.diag(spectrum.values) @ spectrum.vectors.T
    assert np.abs(got - want).max() <= 1e-9 * max(1.0, np.abs(want).max())
    assert np.abs(spectrum.vectors.T @ spectrum.vectors - np.eye(len(want))).max() < 1e-12
    assert (np.diff(spectrum.values) >= 0).all()
    assert spectrum.n == len(x) and spectrum.sums.tolist() == x.sum(0).tolist()


CASES = {
    "plain": lambda r: r.integers(-30, 30, (400, 12)),
    "few": lambda r: r.integers(-30, 30, (5, 12)),
    "one": lambda r: r.integers(-30, 30, (1, 12)),
    "two values": lambda r: r.integers(0, 2, (200, 12)),
    "constant": lambda r: np.full((50, 4), 7),
    "equal columns": lambda r: np.repeat(r.integers(-9, 9, (100, 3)), 3, 1),
    "hot": lambda r: np.where(r.random((300, 1)) < 0.5, np.arange(6), r.integers(-99, 99, (300, 6))),
    "scales": lambda r: r.integers(-9, 9, (200, 5)) * np.array([1, 10, 1000, 100000, 1]),
    "one column": lambda r: r.integers(-9, 9, (60, 1)),
}


@pytest.mark.parametrize("case", CASES)
def test_updates_and_joins_against_the_scatter(case):
    x = CASES[case](np.random.default_rng(4)).astype(np.int64) + 1_000_000
    for cut in (len(x), len(x) // 3):
        spectra = []
        for part in (x[:cut], x[cut:]):
            own = Spectrum(x.shape[1])
            for row in part:
                own.add(row)
            if own.n:
                close_to(own, part)
                spectra.append(Spectrum.of(own.row()))
        first, *others = spectra
        for other in others:
            first.join(other)
        close_to(first, x)


def test_secular_roots_against_eigenvalues():
    rng = np.random.default_rng(9)
    for _ in range(300):
        k = int(rng.integers(1, 20))
        d = np.cumsum(10.0 ** rng.uniform(-6, 3, k))
        z = 10.0 ** rng.uniform(-4, 2, k) * rng.choice([-1, 1], k)
        pole, x = secular_roots(d, z)
        want = np.linalg.eigvalsh(np.diag(d) + np.outer(z, z))
        assert np.abs(d[pole] + x - want).max() <= 1e-12 * want.max()
        assert (np.diff(d[pole] + x) > 0).all()


def reference(vectors, k):
    x = np.floor(64 * np.array(vectors)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    off = n * x - sums
    v = (off / n).T @ (off / n) / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    return (off * off).sum(1), (off / n) @ q[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


@pytest.mark.parametrize("parts", [1, 40])
def test_whiten_against_one_eigh(spark, parts):
    rng = np.random.default_rng(6)
    vectors = rng.normal(0, np.linspace(0.05, 0.5, 10), (400, 10))
    vectors[::3] = vectors[0]
    df = spark.createDataFrame([(i, v.tolist(), 1, "x") for i, v in enumerate(vectors)], "id long, vector array<double>, n int, component string").repartition(parts)
    rows = whiten(df, 6).collect()
    dev, white, explained = reference(vectors, 6)
    assert len(rows) == 2400
    found = np.empty((400, 6))
    for r in rows:
        found[r.vec_id, r.component - 1] = r.whitened
        assert r.n == 400 and r.deviation == dev[r.vec_id]
        assert math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-9)
        assert r.identity_error < 1e-9
    signs = np.sign((found * white).sum(0))
    assert np.abs(found - white * signs).max() < 1e-8


def test_unusable_rows_and_none(spark):
    rows = [(1, [0.0, 1.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 0.0]), (5, [float("inf"), 0.0]), (None, [1.0, 0.5]), (6, []), (7, [1e300, 0.0]), (1, [0.25, -1.0]), (8, [3.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    out = whiten(df).collect()
    assert sorted(str(r.vec_id) for r in out) == sorted(["1", "1", "None", "8"] * 2)
    assert {r.n for r in out} == {4}
    assert whiten(df.limit(0)).collect() == []
    assert whiten(df.where("id = 2")).collect() == []


def test_constant_vectors_have_no_whitening(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "id long, vector array<float>")
    rows = whiten(df).collect()
    assert len(rows) == 10
    assert {(r.whitened, r.explained, r.deviation, r.identity_error) for r in rows} == {(None, 0.0, 0, 0.0)}
    plane = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "id long, vector array<float>")
    rows = whiten(plane).collect()
    assert {r.component for r in rows if r.whitened is None} == {2} and all(r.identity_error < 1e-9 for r in rows)


def test_vectors_of_different_lengths_are_an_error(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, vector array<double>")
    with pytest.raises(Exception, match="different lengths"):
        whiten(df).collect()


def test_deviations_beyond_a_long():
    assert deviations(np.array([[3, 4], [1 << 40, 0]])) == [25, None]
    assert deviations(np.array([[3, 4], [5, 12]])) == [25, 169]


def test_spectrum_is_the_same_whatever_the_partitions(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, rng.normal(size=5).tolist()) for i in range(300)], "id long, vector array<double>")
    one = spectrum_of(whole_vectors(df.coalesce(1)), 5)
    many = spectrum_of(whole_vectors(df.repartition(37)), 5)
    assert one.n == many.n == 300 and (one.sums == many.sums).all()
    assert np.allclose(one.values, many.values, rtol=1e-9)


def test_query(spark):
    from rookery.llm.queries import op13_whitening

    sf = "/root/testdata/sf0.001"
    out = op13_whitening(spark, sf)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids = sorted(vectors)
    dev, white, explained = reference([vectors[i] for i in ids], 32)
    rows = out.collect()
    assert len(rows) == 32 * len(ids)
    found = np.empty((len(ids), 32))
    for r in rows:
        at = ids.index(r.vec_id)
        found[at, r.component - 1] = r.whitened
        assert r.deviation == dev[at] and math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-9)
    assert np.abs(np.abs(found) - np.abs(white)).max() < 1e-7
