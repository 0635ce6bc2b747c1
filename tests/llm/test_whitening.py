import numpy as np
import pytest
from lodestar.llm import fixedpoint, whitening

SCHEMA = "vec_id long, embedding array<double>, n string"


def rows(rnd, n=300, dim=10):
    mix = rnd.standard_normal((dim, dim))
    x = (rnd.standard_normal((n, dim)) @ mix + 3).round(2)
    return [(i, v.tolist(), "theirs") for i, v in enumerate(x)]


def plain(vectors, most=4):
    x = np.floor(np.array(vectors) * 256)
    u = np.unique(x, axis=0)
    mean = u.mean(axis=0)
    e, v = np.linalg.eigh((u - mean).T @ (u - mean) / len(u))
    e, v = e[::-1], v[:, ::-1]
    s = [int(c) for c in u.sum(axis=0)]
    far = [sum((len(u) * int(a) - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    return len(u), far, (x - mean) @ v[:, :most] / np.sqrt(e[:most]), e[:most] / e.sum()


def test_matches_plain_covariance(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)  # a deep tree
    monkeypatch.setattr(fixedpoint, "BLOCK_BYTES", 1600)
    data = rows(np.random.default_rng(1))
    data += data[:40] * 3  # copies count once in the fit, each row gets its result
    data += [(900, None, None), (901, [None] * 10, None), (902, [float("inf")] + [0.0] * 9, None), (None, data[3][1], None)]
    df = spark.createDataFrame(data, SCHEMA).repartition(23)
    good = [v for _, v, _ in data if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    n, far, white, share = plain(good)
    got = whitening.whiten(df).collect()
    assert len(got) == 4 * len(good) and {r.n for r in got} == {n} and len(whitening.whiten(df).columns) == 7
    want = {(i, c + 1): (far[k], white[k, c], share[c]) for k, (i, _, _) in enumerate(r for r in data if r[1] in good) for c in range(4)}
    sign = {c: np.sign(next(r.whitened for r in got if r.component == c and r.vec_id == 5) / want[5, c][1]) for c in range(1, 5)}
    for r in got:
        f, w, e = want[r.vec_id, r.component]
        assert int(r.deviation) == f and abs(r.whitened - sign[r.component] * w) < 1e-9 and abs(r.explained / e - 1) < 1e-9
        assert r.identity_error < 1e-9


def test_far_mean_keeps_digits(spark):
    """A mean a million times the spread: a covariance formed from products would lose all digits."""
    rnd = np.random.default_rng(4)
    x = rnd.standard_normal((200, 3)) * [1, 0.5, 0.25] + 250_000
    got = whitening.whiten(spark.createDataFrame([(i, v.tolist(), "") for i, v in enumerate(x)], SCHEMA)).collect()
    n, far, white, share = plain(x)
    assert {int(r.deviation) for r in got} == set(far)
    assert max(r.identity_error for r in got) < 1e-9
    assert np.allclose(sorted({r.explained for r in got}, reverse=True), share, rtol=1e-9)


def test_exact_deviation_of_extremes():
    """Also where 64 bits don't hold the products."""
    big = fixedpoint.MOST
    x = np.array([[big, -big], [-big, big], [0, 1]], np.int64)
    n, s = 10**11, [-5 * 10**17, 7]
    model = whitening.Whitening(2, n, np.array([v // n for v in s]), tuple(v % n for v in s), np.zeros((2, 0)), np.zeros(0), 1.0)
    assert model.deviations(x) == [sum((n * int(a) - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x.tolist()]


@pytest.mark.parametrize("vectors,components", [([], 0), ([[1.0, 2.0]] * 3, 0), ([[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]], 1), ([[1.0], [2.0, 3.0], []], 2)])
def test_few_or_flat_vectors(spark, vectors, components):
    """Components without variance aren't returned; short vectors are padded by zeros."""
    df = spark.createDataFrame([(1, v, "") for v in vectors], SCHEMA)
    got = whitening.whiten(df).collect()
    assert len(got) == components * len(vectors) and (not got or got[0].identity_error < 1e-9)
