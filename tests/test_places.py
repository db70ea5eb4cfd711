"""Places of units against planted sources, differences and a search of the neighbourhood."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from eventloom.functions import places, transforms
from eventloom.operators import places as tables
from eventloom.sources import session

SITES = np.array([[16.0 * (k % 2), 20.0 * k] for k in range(8)])


def source(place, noise=0.0, n=80, samples=32, seed=0):
    """Events of a unit at a place: a trough at sample 15 that falls with distance, louder and quieter."""
    r = np.random.default_rng(seed)
    a, _ = places.field(np.asarray(place, float), SITES)
    shape = np.exp(-0.5 * ((np.arange(samples) - 15) / 1.6) ** 2)
    return -r.uniform(0.9, 1.1, n)[:, None, None] * shape[None, :, None] * a + r.normal(0, noise, (n, samples, len(SITES)))


@pytest.mark.parametrize("place", [[8, 60, 20, 5000], [20, 75, 40, 9000, 0], [3, 50, 15, 4000, 30_000.0]])
def test_derivatives(place):
    p = np.asarray(place, float)
    _, slopes = places.field(p, SITES)
    for k in range(len(p)):
        h = np.zeros(len(p))
        h[k] = 1e-5 * max(abs(p[k]), 1)
        plain = (places.field(p + h, SITES)[0] - places.field(p - h, SITES)[0]) / (2 * h[k])
        assert np.allclose(slopes[:, k], plain, rtol=1e-4, atol=1e-8)


@pytest.mark.parametrize("place", [[8, 60, 20, 5000], [-10, 75, 30, 9000], [20, 90, 12, 3000]])
def test_planted_source_is_found(place):
    fit = places.fitted(places.field(np.asarray(place, float), SITES)[0], SITES, dipole=False)
    assert np.allclose(fit.place, place, rtol=1e-3, atol=1e-2) and fit.residual < 1e-5


def soft(a, p, sites, scale):
    return float((np.sqrt(1 + ((a - places.field(p, sites)[0]) / scale) ** 2) - 1).sum())


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("dipole", [False, True])
def test_no_place_nearby_is_better(seed, dipole):
    r = np.random.default_rng(seed)
    a = places.field(np.array([r.uniform(0, 16), r.uniform(30, 110), r.uniform(10, 50), 6000.0]), SITES)[0] * r.uniform(0.9, 1.1, len(SITES))
    p, scale = places.fitted(a, SITES, dipole).place, a.max() * 0.05
    low = np.array([-60, -40, 3, 1, -1e11])[: len(p)]
    high = np.array([76, 180, 300, 1e9, 1e11])[: len(p)]
    best = soft(a, p, SITES, scale)
    for step in (1e-4, 1e-3, 1e-2):
        near = np.clip(p + step * r.normal(size=(500, len(p))) * np.maximum(np.abs(p), 1), low, high)
        assert min(soft(a, q, SITES, scale) for q in near) > best - 1e-7 * max(best, 1e-3)


def test_deviations_shrink_with_noise():
    a = places.field(np.array([8.0, 60, 20, 5000]), SITES)[0]
    r = np.random.default_rng(1).normal(size=len(a))
    few, many = (places.fitted(a + s * r, SITES, False).sigma for s in (0.5, 5.0))
    assert (few < many).all() and np.isfinite(many).all()


def test_beyond_the_end():
    """Amplitudes that rise to the last site: the unconstrained place leaves the probe, the other stays within a step of the end."""
    a = places.field(np.array([16.0, 190, 30, 9000]), SITES)[0]
    assert places.one_flank(a, SITES) and not places.one_flank(a[::-1][np.r_[4, 5, 6, 7, 0, 1, 2, 3]], SITES)
    fit = places.fitted_at_end(a, SITES)
    assert 120 <= fit.place[1] <= 160 and fit.place[0] == 16 and fit.place[4] == 0 and len(fit.sigma) == 5
    got = places.placed(source([16.0, 190, 30, 9000]), SITES, dipole=False)
    assert got["edge_fit"] == 1 and got["one_flank"] == 1 and 120 <= got["y0"] <= 160


@pytest.mark.parametrize("kind", ["ptp", "wave", "pc1"])
def test_profiles_find_the_place(kind):
    got = places.placed(source([8, 65, 20, 6000], noise=2.0), SITES, dipole=False, kind=kind)
    assert abs(got["y0"] - 65) < 4 and abs(got["z0"] - 20) < 8 and got["y_lo"] < got["y0"] < got["y_hi"] and not got["at_bound"] and np.isfinite(got["depth_shift"])


def test_profile_on_bases():
    w = source([8, 65, 20, 6000], noise=20.0)
    x = w.reshape(len(w), -1)
    basis = places.principal(len(x), x.sum(0), x.T @ x, 12)
    plain = x - x.mean(0)
    assert np.allclose(np.abs(basis[1] @ np.linalg.svd(plain, full_matrices=False)[2][:12].T), np.eye(12), atol=1e-6)
    true = places.field(np.array([8.0, 65, 20, 6000]), SITES)[0]
    assert np.abs(places.profile(w, basis=basis) - true).max() < np.abs(places.profile(w, "ptp") - true).max()
    means, directions = transforms.fit_basis(w[:, 5:25], 3)
    stored = places.profile(w, basis=transforms.Basis(means, directions, 5))
    assert np.allclose(stored, [abs(np.median(w[:, 5:25, c] @ directions[c, 0])) for c in range(len(SITES))])


def test_few_and_silent_events():
    assert np.isnan(places.placed(source([8, 65, 20, 6000], n=5), SITES)["depth_shift"])
    flat = places.placed(np.zeros((20, 32, 8)), SITES)
    assert np.isfinite([flat["x0"], flat["y0"], flat["z0"]]).all()
    drawn = places.placed(source([8, 65, 20, 6000], noise=5.0), SITES, draws=10)
    assert drawn["y_lo"] <= drawn["y_hi"] and drawn["z_lo"] <= drawn["z_hi"]


def frame(spark, units):
    rows = [(1000 * c + k, c, w.ravel().tolist()) for c, waves in units.items() for k, w in enumerate(waves)]
    return spark.createDataFrame(rows, "event bigint, cluster int, w array<double>")


def test_tables(spark, tmp_path):
    units = {1: source([8, 65, 20, 6000], 2.0, 120), 2: source([10, 100, 30, 8000], 2.0, 60, seed=1), 3: source([8, 40, 20, 6000], n=9), -1: source([8, 40, 20, 6000], n=30)}
    w = frame(spark, units)
    basis = tables.common_basis(w, 32, 8, 6)
    assert basis[1].shape == (6, 256) and np.allclose(basis[1] @ basis[1].T, np.eye(6), atol=1e-8)
    found = tables.located(w, 32, 8, SITES, dipole=False, basis=basis).persist()
    rows = {r.cluster: r for r in found.collect()}
    assert set(rows) == {1, 2} and rows[1].n == 120 and abs(rows[1].y0 - 65) < 3 and abs(rows[2].y0 - 100) < 3 and len(rows[1].template) == 256 and rows[1].snr > 10
    plain = places.placed(units[2], SITES, dipole=False, basis=basis)
    assert all(np.isclose(plain[k], rows[2][k], rtol=1e-6, equal_nan=True) for k in plain)
    text = tables.report(found).collect()
    assert [r.unit for r in text] == [1, 2] and text[0].asDict()["reliable"] == 1 and len(text[0]) == 19
    labels = w.select(F.row_number().over(Window.orderBy("event")).cast("bigint").alias("spike_idx"), F.col("cluster").alias("label")).withColumn("spike_idx", F.col("spike_idx") - 1)
    each = tables.event_places(labels, found)
    path = session.write_positions(each, str(tmp_path / "s.cpos.1"))
    back = {r.spike_idx: r for r in session.read_positions(spark, path).collect()}
    assert len(back) == 219 and all(np.isclose(back[r.spike_idx].y0, r.y0, equal_nan=True) and back[r.spike_idx].one_flank == r.one_flank for r in each.collect())
    none = each.join(labels.where("label in (-1, 3)"), "spike_idx")
    assert none.where(F.isnan("x0") & (F.col("one_flank") == 1)).count() == 39
    found.unpersist()


def test_sample_and_empty_table(spark):
    w = spark.range(30_000).selectExpr("id AS event", "int(id % 3) * 0 AS cluster", "array(1D, 2D) AS w")
    n = tables.sampled(w, 2000).count()
    assert 1700 < n < 2300 and tables.sampled(w.limit(50), 2000).count() == 50
    empty = w.where("false")
    assert tables.common_basis(empty, 2, 1) is None and tables.located(empty, 2, 1, [(0.0, 0.0)]).count() == 0 and tables.profiles(empty, 2, 1).count() == 0
