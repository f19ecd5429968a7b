import math

import numpy as np
import pytest

from skylattice.functions import cosmology, distance, healpix, polygon, signal, special
from skylattice.operators import contours, density, localize, simulate


@pytest.mark.parametrize("order", range(6))
def test_pixels_are_a_bijection(order):
    p = np.arange(12 * 4**order)
    theta, phi = healpix.pix2ang(order, p)
    assert (healpix.ang2pix(order, theta, phi) == p).all()
    ring = healpix.nest2ring(order, p)
    assert (np.sort(ring) == p).all() and (healpix.ring2nest(order, ring) == p).all()
    by = np.argsort(ring)
    assert (np.diff(theta[by]) > -1e-12).all()
    near = healpix.neighbours(order, p)
    assert (near < 0).sum() == 24
    for k in range(8):
        ok = near[:, k] >= 0
        assert (near[near[ok, k]] == p[ok][:, None]).any(axis=1).all()


def test_interpolation_weights():
    rng = np.random.default_rng(0)
    t, f = np.arccos(rng.uniform(-1, 1, 500)), rng.uniform(0, 2 * np.pi, 500)
    pix, w = healpix.interpolation(4, t, f)
    assert np.allclose(w.sum(axis=1), 1) and (w > -1e-9).all()
    assert (pix >= 0).all() and (pix < 12 * 4**4).all()


def test_moments_roundtrip():
    m, s = np.meshgrid(np.arange(1.0, 99, 7), np.arange(1.0, 99, 7))
    mu, sigma, norm = distance.moments_to_parameters(m, s)
    a, b, c = distance.parameters_to_moments(mu, sigma)
    ok = norm > 0
    assert ok.any() and np.allclose(a[ok], m[ok], rtol=6e-5) and np.allclose(b[ok], s[ok], rtol=6e-5)
    assert np.isinf(mu[~ok]).all() and (sigma[~ok] == 1).all()
    mean, std, norm = distance.parameters_to_moments(np.array([np.inf, 0.0]), np.array([1.0, 1.0]))
    assert np.isinf(mean[0]) and std[0] == 1 and norm[0] == 0
    assert mean[1] == pytest.approx(math.sqrt(8 / math.pi))


def test_distance_cdf_is_the_integral():
    norm = distance.parameters_to_moments(100, 20)[2]
    r = np.linspace(0, 400, 40001)
    p = distance.pdf(r, 100, 20, norm)
    assert np.trapezoid(p, r) == pytest.approx(1)
    assert float(distance.cdf(np.inf, 100, 20, norm)) == pytest.approx(1)
    q = distance.ppf(np.array([0.1, 0.5, 0.9]), 100, 20, norm)
    assert np.allclose(distance.cdf(q, 100, 20, norm), [0.1, 0.5, 0.9])
    assert float(distance.ppf(0.0, 100, 20, norm)) == 0 and np.isinf(distance.ppf(1.0, 100, 20, norm))


@pytest.mark.parametrize("r1,r2,p,b,k,expected", [(1e-9, 1, 0, 0, 0, 0), (3, 6, 0, 0, 2, math.log(63)), (1, 2, 1, 0, 0, -0.480238), (1, 2, 1, 0, 2, 0.432919), (1e-9, 1, 1, 0, 2, -2.76076), (1e-9, 4, 1, 1, 2, 2.94548), (0.5, 4, 1, 1, 2, 2.94545), (1, 4, 1, 1, 2, 2.94085), (1e-9, 1, 1, 1, 2, -2.43264), (0.5, 1, 1, 1, 2, -2.43808), (1, 1.5, 1, 1, 2, -0.707038)])
def test_radial_integral(r1, r2, p, b, k, expected):
    assert localize.log_radial_integral(r1, r2, p, b, k) == pytest.approx(expected, abs=2e-5)


def test_cosmology_derivative():
    z = np.logspace(-6, 2, 50)
    numeric = (cosmology.luminosity_distance(z * 1.00001) - cosmology.luminosity_distance(z * 0.99999)) / (2e-5 * z)
    assert np.allclose(numeric, cosmology.ddl_dz(z), rtol=1e-6)
    assert np.allclose(cosmology.z_for_dl(cosmology.luminosity_distance(z)), z)


def test_signal_kernels():
    y = np.random.default_rng(0).normal(size=64) + 0j
    assert np.allclose(signal.truncated_ifft(y, 13), np.fft.ifft(y)[:13])
    with pytest.raises(ValueError):
        signal.truncated_ifft(y[:60], 7)
    t = np.arange(-5, 6)
    x = np.exp(-0.5 * ((t - 0.3) / 3) ** 2) * np.exp(0.2j * t)
    for method in ("quadratic-fit", "catmull-rom", "lanczos"):
        assert signal.interpolate_max(5, x, 4, method)[0] == pytest.approx(5.3, abs=0.06)
    assert signal.interpolate_max(5, x, 4, "nearest") == (5.0, x[5])
    assert signal.interpolate_max(0, x, 4, "catmull-rom")[0] == 0
    d = np.diag([0.5, -0.5, 0.0])
    assert abs(signal.antenna_factor(d, 0.0, np.pi / 2, 0.0)) == pytest.approx(1.0)


def test_sampler_and_ladder():
    x, evidence = localize.sample(lambda v: -0.5 * ((v - 0.5) ** 2 / 0.01).sum(axis=1), [0, 0], [1, 1], n_independent=100)
    assert np.allclose(x.mean(axis=0), 0.5, atol=0.03) and np.allclose(x.std(axis=0), 0.1, atol=0.02)
    assert np.isfinite(evidence)
    assert localize.temper_ladder(4, 5)[0] == 1 and localize.temper_ladder(4, 5)[-1] == 0


def test_sampler_is_as_long_as_asked_or_raises():
    modes = lambda v: np.logaddexp(*(-0.5 * ((v - m) ** 2 / 0.001).sum(axis=1) for m in (0.2, 0.8)))
    x, _ = localize.sample(modes, [0, 0], [1, 1])
    assert len(x) >= 200 * 8 and abs((x[:, 0] < 0.5).mean() - 0.5) < 0.1
    with pytest.raises(RuntimeError):
        localize.sample(modes, [0, 0], [1, 1], most_steps=100)


def test_no_detectors():
    with pytest.raises(ValueError):
        localize.Event([])


def test_kernels_integrate_to_one():
    rng = np.random.default_rng(1)
    k = density.BoundedKDE(rng.uniform(0, 1, (300, 1)), 0.0, 1.0)
    x = np.linspace(0, 1, 2001)
    assert np.trapezoid(k(x[:, None]), x) == pytest.approx(1, abs=5e-3)
    assert (k(np.array([[-0.1], [1.1]])) == 0).all()
    two = np.concatenate([rng.normal(0, 0.1, (200, 2)), rng.normal(3, 0.1, (200, 2))])
    assert density.cluster(two, 2, 0).bic > density.cluster(two, 1, 0).bic


def test_ray_moments_match_quadrature():
    rng = np.random.default_rng(2)
    kde = density.ClusteredKDE([density.GaussianKDE(rng.normal([10, 0, 0], 1, (50, 3)))], np.ones(1), 0.0)
    n = np.array([1.0, 0, 0])
    r = np.linspace(1e-6, 25, 4001)
    f = density.conditional_kde(n, kde, r) * r**2
    total, mean, std = density.ray_moments(n, kde)
    norm = np.trapezoid(f, r)
    m = np.trapezoid(f * r, r) / norm
    assert mean[0] == pytest.approx(m, rel=1e-3)
    assert std[0] == pytest.approx(math.sqrt(np.trapezoid(f * r * r, r) / norm - m * m), rel=1e-2)


def test_polygons():
    assert len(polygon.cut_dateline(polygon.rectangle(0.5, 0.5, 1.5, np.pi))) == 2
    assert len(polygon.cut_dateline(polygon.rectangle(0.5, 0.5, 1.5, 0.0))) == 1
    square = polygon.to_vectors(polygon.subdivide([[0, 0], [0.2, 0], [0.2, 0.2], [0, 0.2]], 0.01))
    assert len(polygon.simplify(square, 1e-4)) < len(square)


def test_cell_max_and_beta():
    assert (simulate.cell_max(np.arange(9).reshape(3, 3)) == [[4, 5], [7, 8]]).all()
    assert float(special.beta_quantile(0.5, 2, 2)) == pytest.approx(0.5)


def test_directions_on_the_edges_of_pixels():
    """The meridian 0 opens base cells 0 and 8 of the caps; on edges between, a direction given by z keeps to the published formula."""
    z = np.array([0.998, -0.995, -0.997, 0.0, 0.5, -0.5])
    assert healpix.zphi2pix(3, z, np.zeros(6)).tolist() == [63, 512, 512, 282, 317, 257]
    near = np.linspace(0.6667, 0.9999, 2000)
    assert (healpix.ang2pix(3, np.arccos(near), np.zeros(2000)) < 64).all() and (healpix.ang2pix(3, np.arccos(-near), np.zeros(2000)) // 64 == 8).all()
    rng = np.random.default_rng(1)
    z, phi = rng.uniform(-1, 1, 20_000), rng.uniform(0, 2 * np.pi, 20_000)
    assert (healpix.zphi2pix(9, z, phi) == healpix.ang2pix(9, np.arccos(z), phi)).all()
    assert (healpix.zphi2pix(29, z, phi) >> 40 == healpix.zphi2pix(9, z, phi)).all()
