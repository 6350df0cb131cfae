"""p-values against closed forms."""

import math

import pytest

from keelson.functions.special import betainc, chi2_sf, gammaincc, t_two_sided_p


@pytest.mark.parametrize("t", [0.0, 0.3, 1.0, 2.5, 10.0, -4.0])
def test_t_df1_is_cauchy(t):
    assert t_two_sided_p(t, 1.0) == pytest.approx(1 - 2 / math.pi * math.atan(abs(t)), abs=1e-12)


@pytest.mark.parametrize("t", [0.1, 1.0, 3.0, 20.0])
def test_t_df2_closed_form(t):
    assert t_two_sided_p(t, 2.0) == pytest.approx(1 - abs(t) / math.sqrt(2 + t * t), abs=1e-12)


@pytest.mark.parametrize("x", [0.0, 0.5, 2.0, 7.3, 40.0])
def test_chi2_dof2_is_exponential(x):
    assert chi2_sf(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-12, abs=1e-300)


@pytest.mark.parametrize("x", [0.1, 1.0, 3.84, 10.0])
def test_chi2_dof1_is_erfc(x):
    assert chi2_sf(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-10)


def test_t_large_dof_tends_to_normal():
    assert t_two_sided_p(1.959963984540054, 1e7) == pytest.approx(0.05, abs=1e-6)


def test_edges():
    assert t_two_sided_p(None, 3) is None
    assert t_two_sided_p(1.0, 0) is None
    assert betainc(2, 3, 0) == 0 and betainc(2, 3, 1) == 1
    assert gammaincc(3, 0) == 1
    # symmetric beta: I_0.5(a, a) = 0.5
    assert betainc(4.5, 4.5, 0.5) == pytest.approx(0.5, abs=1e-13)


def _brute_chi2(pairs):
    import numpy as np
    rows = sorted({a for a, _ in pairs})
    cols = sorted({b for _, b in pairs})
    o = np.zeros((len(rows), len(cols)))
    for a, b in pairs:
        o[rows.index(a), cols.index(b)] += 1
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    dof = (len(rows) - 1) * (len(cols) - 1)
    if dof == 0:
        return 0.0, 0
    if dof == 1:
        diff = e - o
        o = o + np.minimum(0.5, np.abs(diff)) * np.sign(diff)
    return float(((o - e) ** 2 / e).sum()), dof


@pytest.mark.parametrize("pairs", [
    [("x", 1)] * 7 + [("x", 2)] * 3 + [("y", 1)] * 2 + [("y", 2)] * 9,     # 2x2
    [("x", 1)] * 7 + [("y", 1)] * 2 + [("y", 2)] * 9,                      # 2x2 with a zero cell
    [("x", i % 3) for i in range(20)] + [("y", i % 2) for i in range(11)] + [("z", 2)] * 5,  # 3x3
    [("x", 1)] * 4 + [("y", 1)] * 3,                                          # one column: dof 0
])
def test_chi_square_matches_brute_force(spark, pairs):
    from keelson.operators import stats
    df = spark.createDataFrame(pairs, "usage_bucket string, mrr int")
    r = stats.chi_square_stats(df).first()
    want, dof = _brute_chi2(pairs)
    assert r["dof"] == dof and r["n"] == len(pairs)
    assert r["chi2"] == pytest.approx(want, rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("k", [1e6, 1e8])
@pytest.mark.parametrize("z", [-1.5, 0.3, 2.0])
def test_chi2_large_dof_matches_wilson_hilferty(k, z):
    # Wilson-Hilferty: (X/k)^(1/3) is close to normal with mean 1 - 2/(9k), variance 2/(9k)
    m, v = 1 - 2 / (9 * k), 2 / (9 * k)
    x = k * (m + z * math.sqrt(v)) ** 3
    want = 0.5 * math.erfc(z / math.sqrt(2))
    assert chi2_sf(x, k) == pytest.approx(want, abs=2e-4)


def test_t_large_dof_is_normal():
    for t in (0.5, 1.0, 3.0):
        assert t_two_sided_p(t, 1e9) == pytest.approx(math.erfc(t / math.sqrt(2)), abs=1e-6)
