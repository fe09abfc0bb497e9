"""Driver-side functions: accountant, options, statistics, calibration."""

import math
import random

import numpy as np
import pytest

from kinweave.functions import accountant as A
from kinweave.functions.options import parse
from kinweave.functions.stats import holm, paired_p, paired_t, signed_rank
from kinweave.operators import calibrate as C

DELTA = 1 / 1_056_320


@pytest.mark.parametrize(
    "epsilon, sigma33, sigma45",
    [
        (0.1, 295.9578272037, 345.6042839916),
        (0.2, 154.7585811609, 180.7190880505),
        (0.4, 80.8820023800, 94.4498301818),
        (0.8, 42.3448114088, 49.4480864588),
        (1.6, 22.2882377967, 26.0270543880),
        (3.2, 11.8617312375, 13.8515178664),
    ],
)
def test_golden_scales(epsilon, sigma33, sigma45):
    assert math.isclose(A.equal_sigma(epsilon, DELTA, 33), sigma33, rel_tol=1e-9)
    assert math.isclose(A.equal_sigma(epsilon, DELTA, 45), sigma45, rel_tol=1e-9)


def test_budget_is_spent_whole_for_any_weights():
    for w in ((1, 1), (1, 4), (0.3, 2)):
        s = A.split_sigmas(0.8, DELTA, ["a", "b"], ["c", "d", "e"], *w)
        assert math.isclose(sum(1 / x**2 for x in s.values()), A.gamma(0.8, DELTA) ** 2 / 2, rel_tol=1e-9)
    with pytest.raises(ValueError):
        A.gamma(0, 0.1)


def test_size_grids():
    edges, reps = A.geometric_bins(500, 12)
    assert edges[0] == 1 and edges == sorted(set(edges)) and len(edges) <= 12
    assert all(a <= r for a, r in zip(edges, reps, strict=True)) and all(
        r < b for r,
        b in zip(reps, edges[1:], strict=False)
    )
    exact, reps = A.hybrid_bins(8, 100)
    assert exact[:8] == reps[:8] == list(range(1, 9)) and A.hybrid_bins(8, 5) == (list(range(1, 9)),) * 2
    assert A.tau_of(3.0) == 12 and A.tau_of(99.7) == 99 and A.tau_of(1e9) == 1024


def test_totals_and_debias():
    assert A.accepted_total(90.0, 100.0) == 90.0 and A.accepted_total(-3, 100) == 100 and A.accepted_total(float("nan"), 7) == 7
    assert np.allclose(A.debiased([0, 10], 1.0), [0, 9.60106])


def test_options():
    o = parse("pubn,szthresh:0.5,repair", "chain3")
    assert "pubn" in o and o.numbers("szthresh") == (0.5,) and str(o) == "pubn,szthresh:0.5,repair"
    assert str(parse("off")) == "off" and parse(str(parse("all", "star")), "star") == parse("all", "star")
    for text, rail in (("nonsense", None), ("ipf", "star"), ("bins,tailbins", None), ("repair:1", None)):
        with pytest.raises(ValueError):
            parse(text, rail)


def test_signed_rank_and_holm():
    assert signed_rank([1, 2, 3], [1, 2, 3]) == 1.0
    assert math.isclose(signed_rank(range(1, 11), [0] * 10), 2 / 1024)
    x = [random.Random(1).gauss(0.5, 1) for _ in range(40)]
    assert 0 < signed_rank(x, [0] * 40) < 0.2
    assert math.isclose(paired_t([1, 2, 3, 4, 5], [0] * 5), 0.01324, abs_tol=1e-4)
    assert paired_p([1, 1, 1], [0, 0, 0]) == 0.0
    assert np.allclose(holm([0.01, 0.04, 0.03]), [0.03, 0.06, 0.06]) and np.allclose(
        holm([0.01, 0.04, 0.03], False),
        [0.03, 0.04, 0.06],
    )


def test_known_calibrations():
    assert C.grown_at_cap([1, 2, 5, 5, 5], 24, 5) == [1, 2, 7, 7, 7]
    assert C.largest_remainder([0.5, 0.3, 0.2], 1000) == [500, 300, 200]
    assert C.leaf_target([[10, 0], [0, 10]], [1, 100], np.eye(2), 1010) == [10, 1000]
    assert C.row_target([10, 10], 1010) == [505, 505]
    x = C.shrunk_joint([[100, 1], [1, 100]], [50, 150], [100, 100], 1.0, 2.0, 202)
    assert math.isclose(x[0, 1], 13.125)


def test_rescaling_is_exact_within_bounds():
    r = random.Random(3)
    for _ in range(200):
        n = r.randint(1, 30)
        sizes = [r.randint(0, 20) for _ in range(n)]
        lo, hi = r.randint(0, 2), r.randint(10, 30)
        target = r.randint(0, 35 * n)
        out = C.rescaled(sizes, target, lo, hi)
        assert all(lo <= s <= hi for s in out)
        assert sum(out) == min(max(target, lo * n), hi * n)


def test_ipf_meets_both_margins():
    cells = {(i, j, k): 1.0 for i in (0, 1) for j in (0, 1) for k in (0, 1)}
    t0 = {(0, 0): 60, (0, 1): 40, (1, 0): 40, (1, 1): 60}
    t1 = {(0, 0): 55, (0, 1): 45, (1, 0): 45, (1, 1): 55}
    x = C.ipf(cells, [((0, 2), t0), ((1, 2), t1)])
    for axes, goal in (((0, 2), t0), ((1, 2), t1)):
        for key, v in goal.items():
            assert math.isclose(sum(w for c, w in x.items() if tuple(c[a] for a in axes) == key), v, rel_tol=1e-8)
