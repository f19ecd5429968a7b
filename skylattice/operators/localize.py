"""Localisation of events: adaptive sky maps with distance from triggers, and posterior samples.

An event is one row: ``event_id`` and ``singles``, an array of structs (detector, horizon,
response: 9 doubles by rows, location: 3 light seconds, epoch, rate, snr_re, snr_im).  Many events are one
group of a grouped function each; few ones are split over the cells of their grids.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions import healpix, signal
from ..functions import index as ix
from ..functions.cosmology import log_dvc_dvl
from ..functions.special import log_bessel_i0e, log_sum_exp
from ..functions.types import fields
from ..storage import spill

SCALE = 0.83  # rescaling of the log-likelihood
MAP = "event_id:string,uniq:long,probdensity:double,distmu:double,distsigma:double,distnorm:double,log_bci:double,log_bsn:double"


def log_radial_integral(r1: float, r2: float, p: float, b: float, k: int, cosmology: bool = False, n: int = 400) -> float:
    """log of the integral over r from r1 to r2 of exp(-p^2 / r^2 + b / r) I0e(b / r) r^k (times dVC/dVL)."""
    peak = 2 * p * p / b if b > 0 else r2
    peak = min(max(peak, r1), r2)
    # panels that close in on the peak on both sides; Gauss-Legendre in each
    width = max(peak * 0.02, (r2 - r1) * 1e-6)
    edges = sorted({r1, r2, *[x for j in range(40) for x in (peak - width * 1.6**j, peak + width * 1.6**j) if r1 < x < r2], *([peak] if r1 < peak < r2 else [])})
    x, w = np.polynomial.legendre.leggauss(max(8, n // 40))
    a, c = np.array(edges[:-1]), np.array(edges[1:])
    r = ((c - a)[:, None] * (x + 1) / 2 + a[:, None]).ravel()
    w = ((c - a)[:, None] * w / 2).ravel()
    with np.errstate(divide="ignore"):
        f = -((p / r) ** 2) + b / r + log_bessel_i0e(b / r) + k * np.log(r) + np.log(w)
    if cosmology:
        f = f + log_dvc_dvl(r)
    return float(log_sum_exp(f))


class RadialTable:
    """log_radial_integral for the powers k, k + 1, k + 2 over a grid of (log p, log b), read by bilinear interpolation.

    The exponent at its maximum over [r1, r2] is taken out before, which leaves a smooth remainder.
    """

    def __init__(self, r1, r2, k, p_max, b_max, cosmology=False, n=160, panels=16):
        self.r1, self.r2 = r1, r2
        self.x = np.linspace(math.log(p_max * 1e-4), math.log(p_max), n)
        self.y = np.linspace(math.log(b_max * 1e-5), math.log(b_max), n)
        u, w = np.polynomial.legendre.leggauss(8)
        share = np.linspace(0, 1, panels + 1)
        p, b = np.exp(self.x)[:, None], np.exp(self.y)[None, :]
        peak = np.clip(2 * p * p / b, r1, r2)
        top = self.top(p, b)
        total = np.zeros((3, n, n))
        # panels whose edges crowd around the peak, the same number on either side of it; all terms are relative to the peak's
        for low, high, crowd in ((r1 + 0 * peak, peak, 1 - share[::-1] ** 4), (peak, r2 + 0 * peak, share**4)):
            for s, t in zip(crowd[:-1], crowd[1:]):
                a, c = low + (high - low) * s, low + (high - low) * t
                for ui, wi in zip(u, w):
                    r = np.maximum(a + (c - a) * (ui + 1) / 2, 1e-300)
                    f = np.exp(b / r - (p / r) ** 2 - top + log_bessel_i0e(b / r)) * (r / r2) ** k * (c - a) * (wi / 2)
                    if cosmology:
                        f = f * np.exp(log_dvc_dvl(r))
                    for m in range(3):
                        total[m] += f
                        f = f * (r / r2)
        with np.errstate(divide="ignore"):
            # an integral that underflows is next to nothing, but no infinity: those have no differences
            self.rest = np.maximum(np.moveaxis(np.log(total) + (k + np.arange(3))[:, None, None] * math.log(r2), 0, 2), -1e30)

    def top(self, p, b):
        r = np.clip(2 * p * p / np.maximum(b, 1e-300), self.r1, self.r2)
        return b / r - (p / r) ** 2

    def __call__(self, p, b):
        """(pixels, samples, 3) logarithms of the integrals, for p of shape (pixels,) and b of shape (pixels, samples)."""
        i, s = self._at(self.x, np.log(np.maximum(p, 1e-300)))
        j, t = self._at(self.y, np.log(np.maximum(b, 1e-300)))
        line = self.rest[i] * (1 - s)[:, None, None] + self.rest[i + 1] * s[:, None, None]
        step = np.diff(line, axis=1).reshape(-1, 3)
        n = line.shape[1]
        own = np.arange(len(p))[:, None]
        return self.top(p[:, None], b)[..., None] + line.reshape(-1, 3)[own * n + j] + step[own * (n - 1) + j] * t[..., None]

    @staticmethod
    def _at(grid, v):
        f = np.clip((v - grid[0]) / (grid[1] - grid[0]), 0, len(grid) - 1 - 1e-9)
        k = f.astype(np.int64)
        return k, f - k


@functools.lru_cache(8)
def _table(r1, r2, power, p_max, b_max, cosmology):
    return RadialTable(r1, r2, power, p_max, b_max, cosmology)


def radial_table(r1, r2, power, p_max, b_max, cosmology=False):
    """(table, unit, logarithms to add to the three integrals): in units of r2, and for bounds rounded up, so that events share tables.

    The cosmological weight has a scale of its own, so there a table is made for each event.
    """
    if cosmology:
        return _table(r1, r2, power, p_max, b_max, True), 1.0, np.zeros(3)
    up = lambda v: 2.0 ** math.ceil(math.log2(max(v, 1e-300)))
    return _table(r1 / r2, 1.0, power, up(p_max / r2), up(b_max / r2), False), r2, (power + 1 + np.arange(3)) * math.log(r2)


class Event:
    """Arrays of one event: series cut to a common length and centred on one epoch."""

    def __init__(self, singles):
        if not len(singles):
            raise ValueError("an event needs at least one detector")
        self.horizons = np.array([s["horizon"] for s in singles], float)
        self.responses = np.array([np.reshape(s["response"], (3, 3)) for s in singles], float)
        self.locations = np.array([s["location"] for s in singles], float)
        series = [np.asarray(s["snr_re"], float) + 1j * np.asarray(s["snr_im"], float) for s in singles]
        n = min(len(x) for x in series)
        n -= 1 - n % 2  # odd, so that there is a middle sample
        cut = [(len(x) - n) // 2 for x in series]
        self.series = np.array([x[c : c + n] for x, c in zip(series, cut)])
        rates = {float(s["rate"]) for s in singles}
        if len(rates) != 1:
            raise ValueError("all series must have one sample rate")
        self.rate = rates.pop()
        middles = np.array([s["epoch"] + (c + n // 2) / self.rate for s, c in zip(singles, cut)])
        weight = np.maximum(np.abs(self.series[:, n // 2]) ** 2, 1e-12)
        self.epoch = float((middles * weight).sum() / weight.sum())
        self.toas = middles - self.epoch
        self.n = n
        self.gmst = math.fmod(2 * math.pi * (0.7790572732640 + 1.00273781191135448 * ((self.epoch + 315964782 - 946728000) / 86400)), 2 * math.pi)


def condition_prior(horizons, min_distance=None, max_distance=None, power=None, cosmology=False):
    """Defaults: from 0 to a quarter of the farthest horizon, uniform in volume."""
    low = 0.0 if min_distance is None else min_distance
    high = float(np.max(horizons)) / 4 if max_distance is None else max_distance
    power = 2 if power is None else power
    if low > high:
        raise ValueError("the smallest distance exceeds the largest")
    if power == -1 and low == 0:
        raise ValueError("this prior cannot be normalised from distance 0")
    if cosmology and power != 2:
        raise ValueError("the cosmological prior needs power 2")
    return low, high, power


def pixel_log_evidence(event: Event, theta, phi, prior, cosmology=False, which=None, n_psi=10, n_u=10, block=64):
    """(log of the integrals with r^k, k+1, k+2) of each direction, over polarisation, inclination, time and distance."""
    low, high, power = prior
    use = np.arange(len(event.horizons)) if which is None else np.array([which])
    f = np.stack([signal.antenna_factor(event.responses[i], phi, np.pi / 2 - theta, event.gmst) * event.horizons[i] for i in use])
    shift = signal.toa_errors(theta, phi, event.gmst, event.locations[use], event.toas[use]).T  # seconds by detector and pixel
    u, wu = np.polynomial.legendre.leggauss(n_u)
    b_top = float(np.abs(event.series[use]).max()) * float(event.horizons[use].sum()) * SCALE**2
    table, unit, add = radial_table(max(low, high * 1e-4), high, power, float(SCALE * np.sqrt((event.horizons[use] ** 2).sum() / 2)), b_top, cosmology)
    # turning the polarisation by half a turn of 2 psi changes the sign of all amplitudes, and nothing else
    turns = [(a, 2.0) for a in range(n_psi // 2)] if n_psi % 2 == 0 else [(a, 1.0) for a in range(n_psi)]
    out = np.empty((3, len(theta)))
    t = np.arange(event.n)
    for start in range(0, len(theta), block):
        s = slice(start, start + block)
        # each series on the time grid of the geocentre: shifted once, before any quadrature
        snr = np.stack([signal.eval_snr(event.series[k], t[None, :] - shift[j, s][:, None] * event.rate) for j, k in enumerate(use)])
        top = np.full(snr.shape[1], -np.inf)
        got = np.zeros((snr.shape[1], 3))
        for a, twice in turns:
            turn = signal.exp_i(2 * np.pi * a / n_psi)
            for v, w in zip(u, wu):
                z = signal.signal_amplitude(f[:, s], turn, v)
                p = SCALE * np.sqrt((signal.abs2(z)).sum(axis=0) / 2) / unit
                b = (SCALE**2 / unit) * np.abs(np.einsum("ij,ijk->jk", np.conj(z), snr))
                value = table(p, b)
                higher = np.maximum(top, value.max(axis=(1, 2)))
                part = np.exp(value - higher[:, None, None]).sum(axis=1)
                got = got * np.exp(top - higher)[:, None] + (w * twice) * part
                top = higher
        with np.errstate(divide="ignore"):
            out[:, s] = (np.log(got) + top[:, None] + add - math.log(2 * n_psi * event.n)).T
    return out


CELLS = "event_id:string,cell_order:int,ipix:long,v0:double,v1:double,v2:double,single:boolean"


def _cells_of(event, prior, cosmology, n_psi, n_u, order, ipix, single):
    """(integrals of the cells, and of those of the first grid the sum over detectors of each one's own log evidence)"""
    value = pixel_log_evidence(event, *healpix.pix2ang(order, ipix), prior, cosmology, None, n_psi, n_u)
    alone = [pixel_log_evidence(event, *healpix.pix2ang(order, ipix), prior, cosmology, d, n_psi, n_u)[0] for d in range(len(event.horizons))] if single else []
    return value, alone


def _chosen(order, ipix, value, top):
    """Mask of the quarter of the first grid's number of cells with most probability; ties by cell."""
    rank = np.lexsort((ipix, order, value[0] - order * math.log(4)))
    best = np.zeros(len(rank), bool)
    best[rank[-(top // 4) :]] = True
    return best


def _map_of(order, ipix, value, prior, n_detectors, singles, top):
    """(map, log_bci, log_bsn) from all cells of an event; ``singles``: log mean evidence of each detector alone."""
    area = np.pi / 3 * 0.25**order
    low, high, k = prior
    norm = math.log((high ** (k + 1) - max(low, high * 1e-4) ** (k + 1)) / (k + 1)) if k != -1 else math.log(math.log(high / low))
    evidence = float(log_sum_exp(value[0] + np.log(area / (4 * np.pi)))) - norm
    single = sum(x - math.log(top) - norm for x in singles)
    density = np.exp(value[0] - value[0].max())
    density /= (density * area).sum()
    mean = np.exp(value[1] - value[0])
    var = np.exp(value[2] - value[0]) - mean**2
    mu, sigma, n = D.moments_to_parameters(np.where(var > 0, mean, np.inf), np.sqrt(np.where(var > 0, var, 1.0)))
    by = np.argsort(ipix + 4 ** (order + 1), kind="stable")
    table = pd.DataFrame({"uniq": ipix + 4 ** (order + 1), "probdensity": density, "distmu": mu, "distsigma": sigma, "distnorm": n}).iloc[by]
    return table, evidence - single, evidence


def localize_event(event: Event, min_distance=None, max_distance=None, power=None, cosmology=False, top_order=4, rounds=7, n_psi=10, n_u=10):
    """(map, log_bci, log_bsn): uniq, probdensity and distance of the cells of an adaptive grid, in this process.

    The first grid has 12 * 4^top_order cells; each round splits the quarter with most probability.
    """
    prior = condition_prior(event.horizons, min_distance, max_distance, power, cosmology)
    top = 12 * 4**top_order
    order, ipix = np.full(top, top_order), np.arange(top)
    value, alone = _cells_of(event, prior, cosmology, n_psi, n_u, order, ipix, True)
    singles = [float(log_sum_exp(a)) for a in alone]
    for _ in range(rounds):
        best = _chosen(order, ipix, value, top)
        o, i = np.repeat(order[best] + 1, 4), (ipix[best][:, None] * 4 + np.arange(4)).ravel()
        value = np.concatenate([value[:, ~best], _cells_of(event, prior, cosmology, n_psi, n_u, o, i, False)[0]], axis=1)
        order, ipix = np.concatenate([order[~best], o]), np.concatenate([ipix[~best], i])
    return _map_of(order, ipix, value, prior, len(event.horizons), singles, top)


def only_row(key: tuple, rows: pd.DataFrame):
    if len(rows) != 1:
        raise ValueError(f"event {key[0]} has {len(rows)} rows")
    return rows.iloc[0]


#: What data that can't be localised raise; anything else is an error of the program.
BAD_DATA = (ValueError, ArithmeticError, TypeError, KeyError, np.linalg.LinAlgError)


def localize(events: DataFrame, keep_going: bool = False, split: bool | None = None, block: int = 192, min_distance=None, max_distance=None, power=None, cosmology=False, top_order=4, rounds=7, n_psi=10, n_u=10) -> DataFrame:
    """Maps of all events: (event_id, uniq, probdensity, distmu, distsigma, distnorm, log_bci, log_bsn).

    An identifier must have one row.  With ``keep_going`` a failing event gives a row with a null uniq instead of
    ending the job.  With ``split`` each round deals the cells of every event in blocks of ``block`` to all cores, and is one aggregate's
    shuffle; else an event is one task.  By default events are split where there are fewer of them than twice the cores.
    """
    plain = events.select(F.col("event_id").cast("string"), "singles")
    options = dict(min_distance=min_distance, max_distance=max_distance, power=power, cosmology=cosmology, top_order=top_order, rounds=rounds, n_psi=n_psi, n_u=n_u)
    names = [f.split(":")[0] for f in MAP.split(",")]
    failed = lambda key: pd.DataFrame([[key, None, *[math.nan] * 6]], columns=names).astype({"uniq": "Int64"})

    if split is None:
        few = 2 * events.sparkSession.sparkContext.defaultParallelism
        split = len(plain.select("event_id").take(few)) < few
    if not split:

        def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            try:
                table, bci, bsn = localize_event(Event(list(only_row(key, rows)["singles"])), **options)
            except BAD_DATA:
                if not keep_going:
                    raise
                return failed(key[0])
            return table.assign(event_id=key[0], log_bci=bci, log_bsn=bsn)[names]

        return plain.groupBy("event_id").applyInPandas(one, fields(MAP))

    spark, top = events.sparkSession, 12 * 4**top_order
    held = spill(plain.withColumn("_row", F.row_number().over(Window.partitionBy("event_id").orderBy(F.xxhash64("singles")))))
    cells = [f.split(":")[0] for f in CELLS.split(",")]

    def evaluate(batches):
        """Rows (event_id, singles, _row, order, cells) -> integrals; v0 of a ``single`` row is a detector's, cell_order -1 a failure."""
        for b in batches:
            for key, singles, row, order, ipix in zip(b["event_id"], b["singles"], b["_row"], b["o"], b["cells"]):
                try:
                    if row > 1:
                        raise ValueError(f"event {key} has several rows")
                    event = Event(list(singles))
                    prior = condition_prior(event.horizons, min_distance, max_distance, power, cosmology)
                    ipix = np.asarray(ipix, np.int64)
                    first = order < 0  # the first grid is marked by the complement of its order
                    orders = np.full(len(ipix), ~order if first else order)
                    value, alone = _cells_of(event, prior, cosmology, n_psi, n_u, orders, ipix, first)
                except BAD_DATA:
                    if not keep_going:
                        raise
                    yield pd.DataFrame([[key, -1, -1, math.nan, math.nan, math.nan, False]], columns=cells)
                    continue
                yield pd.DataFrame({"event_id": key, "cell_order": orders, "ipix": ipix, "v0": value[0], "v1": value[1], "v2": value[2], "single": False})
                for d, a in enumerate(alone):
                    yield pd.DataFrame([[key, d, -1, float(log_sum_exp(a)), 0.0, 0.0, True]], columns=cells)

    start = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(top - 1).cast("long"), F.lit(block).cast("long"))).alias("_at")
    blocks = held.select("event_id", "singles", "_row", start).withColumn("cells", F.sequence("_at", F.least(F.col("_at") + (block - 1), F.lit(top - 1).cast("long")))).withColumn("o", F.lit(~top_order))
    tasks = 4 * spark.sparkContext.defaultParallelism
    now = spill(blocks.drop("_at").repartition(tasks).mapInPandas(evaluate, fields(CELLS)))
    nth = F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc(F.col("v0") - F.col("cell_order") * math.log(4)), F.desc("cell_order"), F.desc("ipix")))
    done = None
    for _ in range(rounds):
        live = now.where("cell_order >= 0 AND NOT single")
        ranked = live.withColumn("_best", nth <= top // 4)
        rest = now.where("cell_order < 0 OR single").withColumn("_best", F.lit(False))
        ranked = spill(ranked.unionByName(rest))
        kept = ranked.where("NOT _best").drop("_best")
        split_ = ranked.where("_best").select("event_id", (F.col("cell_order") + 1).alias("o"), F.explode(ix.children(F.col("ipix"))).alias("c"))
        dealt = split_.groupBy("event_id", "o", F.floor(F.col("c") / block).alias("_b")).agg(F.sort_array(F.collect_list("c")).alias("cells")).drop("_b")
        asked = dealt.join(held.where("_row = 1"), "event_id").select("event_id", "singles", "_row", "o", "cells")
        now = spill(kept.unionByName(asked.repartition(tasks).mapInPandas(evaluate, fields(CELLS))))
        done = now
    done = now if done is None else done

    def whole(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if (rows["cell_order"] < 0).any():
            return failed(key[0])
        alone = rows[rows["single"]].groupby("cell_order")["v0"].apply(lambda v: float(log_sum_exp(v.to_numpy(float)))).tolist()
        rows = rows[~rows["single"]]
        try:
            prior = condition_prior(np.asarray(rows["horizons"].iloc[0], float), min_distance, max_distance, power, cosmology)
            table, bci, bsn = _map_of(rows["cell_order"].to_numpy(), rows["ipix"].to_numpy(), rows[["v0", "v1", "v2"]].to_numpy(float).T, prior, len(alone), alone, top)
        except BAD_DATA:
            if not keep_going:
                raise
            return failed(key[0])
        return table.assign(event_id=key[0], log_bci=bci, log_bsn=bsn)[names]

    far = held.where("_row = 1").select("event_id", F.transform("singles", lambda x: x["horizon"].cast("double")).alias("horizons"))
    return done.join(far, "event_id").groupBy("event_id").applyInPandas(whole, fields(MAP))


def log_posterior(event: Event, prior, ra, sin_dec, distance, u, twopsi, t):
    """log density at points of the six parameters."""
    low, high, k = prior
    ra, sin_dec, r, u, twopsi, t = (np.atleast_1d(np.asarray(v, float)) for v in (ra, sin_dec, distance, u, twopsi, t))
    dec = np.arcsin(np.clip(sin_dec, -1, 1))
    total = np.zeros(len(ra))
    shift = signal.toa_errors(np.pi / 2 - dec, ra, event.gmst, event.locations, event.toas)
    for i in range(len(event.horizons)):
        f = signal.antenna_factor(event.responses[i], ra, dec, event.gmst) * event.horizons[i]
        z = signal.signal_amplitude(f, signal.exp_i(twopsi), u) / r
        snr = signal.eval_snr(event.series[i], event.n // 2 + (t - shift[:, i]) * event.rate)
        total = total - 0.5 * SCALE**2 * signal.abs2(z)
        total = total + 0  # phases are integrated below
        product = np.conj(z) * snr
        coherent = product if i == 0 else coherent + product
    b = SCALE**2 * np.abs(coherent)
    inside = (r > low) & (r < high) & (np.abs(sin_dec) <= 1) & (np.abs(u) <= 1)
    with np.errstate(divide="ignore"):
        return np.where(inside, total + b + log_bessel_i0e(b) + k * np.log(np.where(r > 0, r, 1)), -np.inf)


def autocorrelation_length(x: np.ndarray, window: float = 5.0) -> float:
    """Integrated autocorrelation time of a chain, averaged over walkers; x has (steps, walkers).  Infinite if the chain is too short to tell."""
    y = x - x.mean(axis=0)
    n = signal.ceil_pow_2(2 * len(y))
    f = np.fft.rfft(y, n, axis=0)
    acf = np.fft.irfft(f * np.conj(f), n, axis=0)[: len(y)].mean(axis=1)
    if acf[0] <= 0:
        return 1.0
    tau = 2 * np.cumsum(acf / acf[0]) - 1
    m = np.arange(len(tau)) >= window * tau
    return float(tau[np.argmax(m)]) if m.any() else math.inf


def temper_ladder(dim: int, n: int, t_max: float = math.inf) -> np.ndarray:
    """Inverse temperatures from 1 downwards, spaced for about a quarter of swaps to pass; the last is 0 if t_max is infinite."""
    step = 1 + math.sqrt(2 / dim) * 1.2
    beta = step ** -np.arange(n, dtype=float)
    if math.isinf(t_max) and n > 1:
        beta[-1] = 0.0
    return beta


def thermodynamic_evidence(betas: np.ndarray, mean_log_likelihood: np.ndarray) -> float:
    """log evidence: integral of the mean log-likelihood over inverse temperature, by trapezoids."""
    order = np.argsort(betas)
    return float(np.trapezoid(mean_log_likelihood[order], betas[order]))


def sample(log_likelihood, low, high, n_independent: int = 200, n_temps: int = 10, n_walkers: int | None = None, n_burn: int = 500, seed: int = 0, most_steps: int | None = None):
    """Parallel-tempered stretch-move sampling within a box: (samples, log evidence).

    Stops when the steps are ``n_independent`` autocorrelation lengths, so that at least as many rows of each walker are
    kept.  Raises if that isn't reached within ``most_steps``, if given.
    """
    rng = np.random.default_rng(seed)
    low, high = np.asarray(low, float), np.asarray(high, float)
    d = len(low)
    w = n_walkers or 4 * d
    w += w % 2
    beta = temper_ladder(d, n_temps)
    x = rng.uniform(low, high, (n_temps, w, d))

    def evaluate(points):
        flat = points.reshape(-1, d)
        inside = ((flat >= low) & (flat <= high)).all(axis=1)
        out = np.full(len(flat), -np.inf)
        if inside.any():
            out[inside] = log_likelihood(flat[inside])
        return out.reshape(points.shape[:-1]), inside.reshape(points.shape[:-1])

    value, _ = evaluate(x)
    chain, heat = [], []
    step, next_look = 0, 64  # looks at ever longer chains, so that their cost per step is constant
    while True:
        for half in (slice(0, w // 2), slice(w // 2, w)):
            other = slice(w // 2, w) if half.start == 0 else slice(0, w // 2)
            z = (1 + rng.random((n_temps, w // 2))) ** 2 / 2
            mate = np.take_along_axis(x[:, other], rng.integers(0, w // 2, (n_temps, w // 2))[..., None].repeat(d, -1), 1)
            new = mate + z[..., None] * (x[:, half] - mate)
            v, inside = evaluate(new)
            with np.errstate(invalid="ignore"):
                ratio = (d - 1) * np.log(z) + beta[:, None] * np.where(np.isfinite(v), v, -1e300) - beta[:, None] * np.where(np.isfinite(value[:, half]), value[:, half], -1e300)
            ok = inside & (np.log(rng.random(z.shape)) < ratio) & (np.isfinite(v) | (beta[:, None] == 0))
            x[:, half] = np.where(ok[..., None], new, x[:, half])
            value[:, half] = np.where(ok, v, value[:, half])
        for k in range(n_temps - 1, 0, -1):
            mate = rng.permutation(w)
            a, b = value[k], value[k - 1][mate]
            with np.errstate(invalid="ignore"):
                swap = np.log(rng.random(w)) < (beta[k - 1] - beta[k]) * (np.maximum(a, -1e300) - np.maximum(b, -1e300))
            i, j = np.flatnonzero(swap), mate[swap]
            x[k, i], x[k - 1, j] = x[k - 1, j].copy(), x[k, i].copy()
            value[k, i], value[k - 1, j] = value[k - 1, j].copy(), value[k, i].copy()
        step += 1
        if step > n_burn:
            chain.append(x[0].copy())
            heat.append(np.where(np.isfinite(value), value, np.nan))
        last = len(chain) == most_steps
        if len(chain) == next_look or last:
            next_look = 2 * next_look + 64
            c = np.array(chain)
            length = max(1, *(autocorrelation_length(c[:, :, k]) for k in range(d)))
            if len(c) >= n_independent * length:
                keep = c[:: int(length)].reshape(-1, d)
                mean = np.nan_to_num(np.nanmean(np.array(heat), axis=(0, 2)))
                return keep, thermodynamic_evidence(beta, mean)
            if last:
                raise RuntimeError(f"not converged: {len(c)} steps at an autocorrelation length of {length:.1f}, {n_independent} lengths wanted")


CHAIN = "event_id:string,ra:double,dec:double,distance:double,inclination:double,polarization:double,time:double"


def sample_events(events: DataFrame, ra=None, dec=None, distance=None, seed: int = 0, **options) -> DataFrame:
    """Posterior samples of each event; parameters that are given are pinned and not sampled."""
    pins = {0: ra, 1: None if dec is None else math.sin(dec), 2: distance}

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        event = Event(list(only_row(key, rows)["singles"]))
        prior = condition_prior(event.horizons)
        half = event.n / 2 / event.rate
        low = np.array([0, -1, prior[0], -1, 0, -half])
        high = np.array([2 * np.pi, 1, prior[1], 1, 2 * np.pi, half])
        free = [k for k in range(6) if pins.get(k) is None]

        def full(x):
            out = np.empty((len(x), 6))
            out[:, free] = x
            for k, v in pins.items():
                if v is not None:
                    out[:, k] = v
            return out

        x, _ = sample(lambda x: log_posterior(event, prior, *full(x).T), low[free], high[free], seed=seed, **options)
        x = full(x)
        return pd.DataFrame({"event_id": key[0], "ra": x[:, 0], "dec": np.arcsin(x[:, 1]), "distance": x[:, 2], "inclination": np.arccos(x[:, 3]), "polarization": x[:, 4] / 2, "time": event.epoch + x[:, 5]})

    return events.select(F.col("event_id").cast("string"), "singles").groupBy("event_id").applyInPandas(one, fields(CHAIN))


def chain_maps(chains: DataFrame, n: int = 1000, seed: int = 0, **options) -> dict:
    """A 3-D map from each event's samples (event_id, ra, dec, distance): event_id -> map, from ``n`` of them drawn by a seeded hash.

    The kernel step behind the sampler; the events named are those of one batch, so their number is small.
    """
    from .density import from_samples

    chains = spill(chains)
    names = sorted(r[0] for r in chains.select("event_id").distinct().collect())
    return {name: from_samples(chains.where(F.col("event_id") == name), n, seed, **options) for name in names}
