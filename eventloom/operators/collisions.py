"""Events that are two waveforms at once, told apart with a bank of shifted templates.

The bank holds every template at every shift; its size is checked, since it goes to each task with the plan. Events are measured against it in Arrow batches, two matrix products a batch: the
first waveform is the best without a shift (or within a few samples), the second the best of the other templates at any shift in what is left. ``joint`` then fits
both amplitudes together by least squares, whose normal equations need only the bank's Gram matrix and the products that are there already.

Defined results: events with a null waveform are left out, templates with a null one too. Equal fits go to the smaller template, then the smaller shift. With one
template the second is null. A waveform of zeros fits the first template with amplitude 0. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .moments import matrix

#: Bytes that a bank and its Gram matrix may have together.
MOST = 256_000_000
SPLIT = "event bigint, k1 bigint, shift1 int, a1 double, k2 bigint, shift2 int, a2 double, r1 double, r2 double, gain double, joint_a1 double, joint_a2 double, joint_r2 double"


class Bank(NamedTuple):
    """Atoms (template, shift) as rows, template by template."""

    keys: np.ndarray
    shifts: np.ndarray
    atoms: np.ndarray
    norms: np.ndarray
    gram: np.ndarray


def bank(templates: DataFrame, channels: int, shifts: range = range(-8, 9), whitener: tuple[np.ndarray, np.ndarray] | None = None) -> Bank:
    """Templates (cluster, w), w sample by sample, rolled over ``shifts`` samples and then whitened by (mean, matrix), if there is one."""
    rows = templates.where("cluster IS NOT NULL AND w IS NOT NULL")
    count, width = rows.agg(F.count(F.lit(1)), F.max(F.size("w"))).first()
    n = count * len(shifts)
    if 8 * n * ((width or 0) + n) > MOST:
        raise ValueError(f"{count} templates at {len(shifts)} shifts are more than {MOST} bytes: take fewer shifts, or deal templates and events by place")
    some = rows.orderBy("cluster").collect()
    keys = np.array([r.cluster for r in some], np.int64)
    waves = np.array([r.w for r in some], float).reshape(count, (width or 0) // channels, channels)
    atoms = np.stack([np.roll(waves, s, axis=1).reshape(count, width or 0) for s in shifts], 1).reshape(n, width or 0)
    if whitener is not None:
        atoms = (atoms - whitener[0]) @ whitener[1]
    return Bank(np.repeat(keys, len(shifts)), np.tile(np.array(shifts, np.int32), count), atoms, (atoms**2).sum(1) + 1e-12, atoms @ atoms.T)


def split(x: np.ndarray, held: Bank, near: int = 0, pinned: tuple[np.ndarray, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """The columns of SPLIT but the event for waveforms as rows. ``near``: the shifts that the first waveform may have. ``pinned``: its template and the norm that it is known to have, for each row."""
    rows, n = np.arange(len(x)), len(held.keys)
    product = x @ held.atoms.T
    power = np.einsum("ij,ij->i", x, x)
    fit = product**2 / held.norms
    allowed = np.broadcast_to(np.abs(held.shifts) <= near, (len(x), n))
    if pinned is not None:
        allowed = allowed & (held.keys[None, :] == pinned[0][:, None])
    first = np.where(allowed, fit, -1.0).argmax(1)
    a1 = product[rows, first] / held.norms[first]
    if pinned is not None:
        a1 = np.sign(a1) * pinned[1] / np.sqrt(held.norms[first])
    # what is left has these products with all atoms, and this power
    rest = product - a1[:, None] * held.gram[first]
    r1 = np.maximum(power - 2 * a1 * product[rows, first] + a1**2 * held.gram[first, first], 0)
    gains = np.where(held.keys[None, :] == held.keys[first][:, None], -1.0, rest**2 / held.norms)
    second = gains.argmax(1)
    there = gains[rows, second] >= 0
    a2 = rest[rows, second] / held.norms[second]
    r2 = np.maximum(r1 - 2 * a2 * rest[rows, second] + a2**2 * held.gram[second, second], 0)
    # both amplitudes together
    g11, g22, g12 = held.norms[first], held.norms[second], held.gram[first, second]
    p1, p2 = product[rows, first], product[rows, second]
    det = np.maximum(g11 * g22 - g12**2, 1e-12 * g11 * g22)
    b1, b2 = (g22 * p1 - g12 * p2) / det, (g11 * p2 - g12 * p1) / det
    left = np.maximum(power - b1 * p1 - b2 * p2, 0)
    blank = lambda v: np.ma.masked_array(v, ~there)
    return {
        "k1": held.keys[first], "shift1": held.shifts[first], "a1": a1,
        "k2": blank(held.keys[second]), "shift2": blank(held.shifts[second]), "a2": blank(a2),
        "r1": np.sqrt(r1), "r2": blank(np.sqrt(r2)), "gain": blank(1 - r2 / (r1 + 1e-12)), "joint_a1": blank(b1), "joint_a2": blank(b2), "joint_r2": blank(np.sqrt(left)),
    }


def decomposed(waves: DataFrame, held: Bank, near: int = 0, whitener: tuple[np.ndarray, np.ndarray] | None = None, pin: str | None = None) -> DataFrame:
    """See SPLIT, for waves (event, w). r1 and r2 are norms of what is left after one and two waveforms, gain the share of r1's power that the second takes.

    ``pin``: a column with the norm that the event's own waveform is known to have; the first template is then that of ``cluster`` and its amplitude isn't fitted, so a second one much
    like it isn't drawn into it. Events without a template are left out then."""
    if not len(held.keys):
        return waves.sparkSession.createDataFrame([], SPLIT)
    known = waves.where("w IS NOT NULL")
    if pin:
        known = known.where(F.col("cluster").isin(sorted(set(held.keys.tolist()))) & F.col(pin).isNotNull())
    names = [f.split() for f in SPLIT.split(", ")][1:]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch.column(1))
            if whitener is not None:
                x = (x - whitener[0]) @ whitener[1]
            got = split(x, held, near, (batch.column(2).to_numpy(), batch.column(3).to_numpy()) if pin else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ma.getdata(got[n]), kinds[t], mask=np.ma.getmaskarray(got[n])) for n, t in names)], ["event", *(n for n, _ in names)])

    more = [F.col("cluster").cast("bigint").alias("cluster"), F.col(pin).cast("double").alias("_pin")] if pin else []
    return known.select("event", F.col("w").cast("array<double>").alias("w"), *more).mapInArrow(run, SPLIT)


def misfit(waves: DataFrame, held: Bank, whitener: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """event, k1, a1, residual: the norm of what the best single template without a shift leaves; large where one waveform doesn't explain an event."""
    still = held.shifts == 0
    one = Bank(held.keys[still], held.shifts[still], held.atoms[still], held.norms[still], held.gram[np.ix_(still, still)])
    return decomposed(waves, one, 0, whitener).select("event", "k1", "a1", F.col("r1").alias("residual"))
