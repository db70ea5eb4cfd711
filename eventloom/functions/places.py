"""Where a unit lies beside its probe: a point source whose field falls with distance, fitted to the amplitudes of the channels.

Sites are (channels, 2): across and along the probe, in micrometres. A place is (x, y, distance from the plane of the probe, amplitude at distance 1, and with ``dipole`` its moment along the probe).
Waves must be raw: on differences of channels amplitude no longer falls with distance.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from . import transforms

# The box in which a place is looked for, and where the search starts.
AROUND_X, AROUND_Y = 60.0, 40.0
NEAREST, FARTHEST = 3.0, 300.0
WEAKEST, STRONGEST, MOMENT = 1.0, 1e9, 1e11
START_DISTANCE, START_GAIN = 25.0, 30.0
LOSS_SHARE = 0.05


@dataclass
class Fit:
    """A place, one standard deviation of each of its numbers, and the root mean square of what is left, as a share of the loudest channel."""

    place: np.ndarray
    sigma: np.ndarray
    residual: float


def field(place, sites) -> tuple[np.ndarray, np.ndarray]:
    """Amplitude of a place at each site, and its derivatives (sites, numbers)."""
    x, y, z, amplitude = place[:4]
    dx, dy = x - sites[:, 0], y - sites[:, 1]
    d = np.sqrt(dx**2 + dy**2 + z**2)
    slope = -amplitude / d**3
    value, by = amplitude / d, [slope * dx, slope * dy, slope * z, 1 / d]
    if len(place) > 4:
        moment = place[4]
        value = value - moment * dy / d**3
        steep = 3 * moment * dy / d**5
        by = [by[0] + steep * dx, by[1] + steep * dy - moment / d**3, by[2] + steep * z, by[3], -dy / d**3]
    return value, np.stack(by, 1)


def least_squares(a, model: Callable, start, low, high, scale: float = np.inf, rounds: int = 500) -> tuple[np.ndarray, np.ndarray, float]:
    """Numbers within bounds that minimise the soft sum of squares, 2 scale^2 (sqrt(1 + (r / scale)^2) - 1) for each residual r, or the plain one without a scale, by damped steps; what bounds hold stays
    where it is. Also the derivatives, weighted by the loss's curvature, and half the loss."""
    low, high = np.asarray(low, float), np.asarray(high, float)
    p = np.clip(np.asarray(start, float), low, high)
    cost = lambda r: float((r**2 / (np.sqrt(1 + (r / scale) ** 2) + 1)).sum())
    value, slopes = model(p)
    now, damping = cost(a - value), 1e-3
    for _ in range(rounds):
        r = a - value
        weight = 1 / np.sqrt(1 + (r / scale) ** 2)
        pull = slopes.T @ (weight * r)
        free = ~(((p <= low) & (pull < 0)) | ((p >= high) & (pull > 0)))
        if not free.any():
            break
        j = slopes[:, free]
        normal = j.T @ (weight[:, None] * j)
        size = np.sqrt(np.maximum(np.diag(normal), 1e-300))
        moved = False
        while damping < 1e12:
            step = np.linalg.lstsq(normal / np.outer(size, size) + damping * np.eye(len(size)), pull[free] / size, rcond=None)[0] / size
            q = p.copy()
            q[free] = np.clip(p[free] + step, low[free], high[free])
            value_q, slopes_q = model(q)
            then = cost(a - value_q)
            if then < now:
                moved = True
                break
            damping *= 4
        if not moved:
            break
        gain, shift = now - then, np.abs(q - p).max() / (np.abs(p).max() + 1e-12)
        p, value, slopes, now, damping = q, value_q, slopes_q, then, max(damping / 4, 1e-12)
        if gain < 1e-13 * now and shift < 1e-9:
            break
    return p, slopes * ((1 + ((a - value) / scale) ** 2) ** -0.75)[:, None], now


def deviations(slopes, half: float, n: int) -> np.ndarray:
    """Standard deviations from the derivatives; nan where they say nothing."""
    try:
        spread = np.linalg.inv(slopes.T @ slopes) * (2 * half / max(1, n - slopes.shape[1]))
    except np.linalg.LinAlgError:
        return np.full(slopes.shape[1], np.nan)
    return np.sqrt(np.maximum(np.diag(spread), 0))


def left(a, value) -> float:
    return float(np.sqrt(((a - value) ** 2).mean()) / a.max())


def pitch(sites) -> float:
    """Mean step between the levels of the sites along the probe."""
    y = np.unique(sites[:, 1])
    return float((y[-1] - y[0]) / max(1, len(y) - 1))


def fitted(amplitudes, sites, dipole: bool = True) -> Fit:
    """The place for the amplitudes of the channels, from their centre of gravity on."""
    a, sites = np.maximum(np.asarray(amplitudes, float), 1e-3), np.asarray(sites, float)
    x, y = a @ sites / a.sum()
    (x0, y0), (x1, y1) = sites.min(0), sites.max(0)
    n = 5 if dipole else 4
    start = [x, y, START_DISTANCE, a.max() * START_GAIN, 0.0][:n]
    low = [x0 - AROUND_X, y0 - AROUND_Y, NEAREST, WEAKEST, -MOMENT][:n]
    high = [x1 + AROUND_X, y1 + AROUND_Y, FARTHEST, STRONGEST, MOMENT][:n]
    place, slopes, half = least_squares(a, lambda p: field(p, sites), start, low, high, max(a.max() * LOSS_SHARE, 1e-6))
    return Fit(place, deviations(slopes, half, len(a)), left(a, field(place, sites)[0]))


def fitted_at_end(amplitudes, sites, dipole: bool = True) -> Fit:
    """The place of a unit of which only one flank is seen: beside its loudest channel, within a step of it along the probe, without a dipole; the fall of the amplitudes gives the distance."""
    a, sites = np.maximum(np.asarray(amplitudes, float), 1e-3), np.asarray(sites, float)
    x, y = sites[a.argmax()]
    step = pitch(sites)

    def model(q):
        value, slopes = field([x, *q], sites)
        return value, slopes[:, 1:]

    q, slopes, half = least_squares(a, model, [y, START_DISTANCE, a.max() * START_GAIN], [y - step, NEAREST, WEAKEST], [y + step, FARTHEST, STRONGEST], max(a.max() * LOSS_SHARE, 1e-6))
    more = [0.0] if dipole else []
    return Fit(np.array([x, *q, *more]), np.array([1.0, *deviations(slopes, half, len(a)), *more]), left(a, model(q)[0]))


def one_flank(amplitudes, sites) -> bool:
    """Whether the loudest channel is at an end of the probe."""
    y = np.asarray(sites, float)[:, 1]
    at = y[int(np.argmax(amplitudes))]
    return bool(at <= y.min() + 1e-6 or at >= y.max() - 1e-6)


def amplitudes(waves) -> np.ndarray:
    """Peak to peak of each event and channel."""
    w = np.asarray(waves, float)
    return w.max(1) - w.min(1)


def profile(waves, kind: str = "pc1", basis=None) -> np.ndarray:
    """A unit's amplitude on each channel.

    ptp: the median of its events' peaks to peaks; also for fewer than 8 events. wave: peak to peak of the median of the aligned events. pc1: peak to peak of a template cleared of noise: the mean
    of the aligned events, projected on ``basis`` = (mean, directions) of many units, or without a basis on the events' own first direction. A ``transforms.Basis`` gives the median of the events'
    first components in place of all these."""
    w = np.asarray(waves, float)
    if isinstance(basis, transforms.Basis):
        x = transforms.projected_waves(w, basis).reshape(len(w), len(basis.directions), -1)
        return np.abs(np.median(x[:, :, 0], 0))
    if kind == "ptp" or len(w) < 8:
        return np.median(amplitudes(w), 0)
    w = transforms.aligned(w)[0]
    if kind == "wave":
        return np.ptp(np.median(w, 0), axis=0)
    x = w.reshape(len(w), -1)
    if basis is not None:
        mean, directions = basis
        clear = mean + (x.mean(0) - mean) @ directions.T @ directions
    else:
        first = np.linalg.svd(x, full_matrices=False)[2][0]
        clear = (x @ first).mean() * first
    return np.ptp(clear.reshape(w.shape[1:]), axis=0)


def principal(n: float, sums, products, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and principal directions of flat waves, from their number, sums and sums of products."""
    mean = np.asarray(sums) / max(n, 1)
    vectors = np.linalg.eigh(np.asarray(products) - n * np.outer(mean, mean))[1][:, ::-1][:, :parts]
    return mean, vectors.T


def placed(waves, sites, dipole: bool = True, draws: int = 0, least_for_thirds: int = 60, kind: str = "pc1", basis=None, seed: int = 0) -> dict:
    """A unit's place, from its waves (events, samples, channels).

    A place over a step beyond an end of the probe is fitted anew by ``fitted_at_end`` (edge_fit). y_lo to z_hi are one standard deviation, or with ``draws`` the 16th to 84th percentile of places of events
    drawn with replacement. depth_shift is how much farther along the probe the loudest third of events lies than the quietest, nan below ``least_for_thirds`` events."""
    w, sites = np.asarray(waves, float), np.asarray(sites, float)
    a = profile(w, kind, basis)
    fit, refit = fitted(a, sites, dipole), fitted
    y0, y1, step = sites[:, 1].min(), sites[:, 1].max(), pitch(sites)
    beyond = bool(fit.place[1] < y0 - step or fit.place[1] > y1 + step)
    if beyond:
        refit = fitted_at_end
        fit = refit(a, sites, dipole)
    x, y, z, amplitude = fit.place[:4]
    at = sites[a.argmax()]
    y_range, z_range = (y - fit.sigma[1], y + fit.sigma[1]), (max(z - fit.sigma[2], 0.0), z + fit.sigma[2])
    if draws and not beyond and len(w) >= 8:
        r, each = np.random.default_rng(seed), amplitudes(w)
        drawn = np.array([fitted(np.median(each[r.integers(0, len(w), len(w))], 0), sites, dipole).place[1:3] for _ in range(draws)])
        (y_range, z_range) = np.percentile(drawn, [16, 84], axis=0).T
    shift = np.nan
    if len(w) >= least_for_thirds:
        order, third = np.argsort(amplitudes(w).max(1), kind="stable"), len(w) // 3
        quiet, loud = (refit(profile(w[k], kind, basis), sites, dipole).place[1] for k in (order[:third], order[2 * third :]))
        shift = float(loud - quiet)
    return {
        "x0": float(x), "y0": float(y), "z0": float(z), "A": float(amplitude), "dist": float(np.sqrt(((at - [x, y]) ** 2).sum() + z**2)), "dipoleB": float(fit.place[4]) if dipole else 0.0,
        "resid": fit.residual, "sig_y": float(fit.sigma[1]), "z_lo": float(z_range[0]), "z_hi": float(z_range[1]), "y_lo": float(y_range[0]), "y_hi": float(y_range[1]), "depth_shift": shift,
        "one_flank": int(one_flank(a, sites)), "edge_fit": int(beyond), "at_bound": int(z < NEAREST + 1 or z > FARTHEST - 1),
    }


def template(waves, before: int = 6) -> tuple[np.ndarray, float]:
    """Median of the aligned events, and its largest peak to peak over the noise of the first samples."""
    w = np.asarray(waves, float)
    t = np.median(transforms.aligned(w)[0], 0)
    return t, float(np.ptp(t, axis=0).max() / (np.median(w[:, :before].std(1)) + 1e-6))
