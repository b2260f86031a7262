import math

import pytest

from paramlens.functions import kernel

# Fixed values, from an independent implementation of the same distributions.
EXPECTED = [
    (kernel.beta_inc, (0.3, 2, 3), 0.34829999999999994),
    (kernel.beta_inc, (0.2, 1000, 3000), 8.069693549528465e-15),
    (kernel.f_survival, (1.5, 3, 100), 0.2192139599752708),
    (kernel.f_survival, (25, 8, 46730), 7.811105423682336e-39),
    (kernel.t_cdf, (-2.5, 3), 0.04385332350403278),
    (kernel.t_inv, (0.975, 29), 2.045229642132704),
    (kernel.t_inv, (0.025, 2), -4.302652729749464),
    (kernel.norm_inv, (0.025,), -1.9599639845400545),
    (kernel.norm_cdf, (-8,), 6.22096057427174e-16),
    (kernel.chi2_survival, (3.84, 1), 0.050043521248705085),
    (kernel.chi2_survival, (500, 400), 0.00048221275959343273),
    (kernel.expected_max_z, (10,), 1.57459830134575),
]


@pytest.mark.parametrize("function,args,value", EXPECTED)
def test_distributions(function, args, value):
    assert function(*args) == pytest.approx(value, rel=1e-9)


def test_edges():
    assert kernel.f_survival(0, 3, 5) == 1 and kernel.f_survival(math.inf, 3, 5) == 0
    assert kernel.chi2_survival(0, 2) == 1 and math.isnan(kernel.chi2_survival(1, 0))
    assert math.isnan(kernel.expected_max_z(1)) and kernel.z_p(0) == 1
    assert kernel.wilson(0, 1150) == pytest.approx((0, 0.0033292778581733074))


def test_bh_skips_missing():
    q = kernel.bh([0.01, math.nan, 0.04, 0.03, 0.005, 0.5, 0.2, 0.049])
    assert math.isnan(q[1])
    assert [x for x in q if x == x] == pytest.approx([0.035, 0.0686, 0.0686, 0.035, 0.5, 0.23333333, 0.0686])
