"""Simulated events: injections within the sensitive volume, their triggers, model spectra."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cosmology as C
from ..functions import signal
from ..functions.types import fields, vectorized


def model_spectra(spark, detectors: dict[str, float], df: float = 1.0, f_max: float = 2048.0, kind: str = "aligo") -> DataFrame:
    """(ifo, f0, df, data): analytic spectra, each scaled by its detector's factor."""
    n = int(f_max / df) + 1
    data = signal.model_psd(signal.abscissa(0.0, df, n), kind)
    rows = [(name, 0.0, df, (data * scale**2).tolist()) for name, scale in detectors.items()]
    return spark.createDataFrame(rows, fields("ifo:string,f0:double,df:double,data:array<double>"))


def horizon(m1: float, m2: float, psds: list, f_low: float = 10.0, f_max: float = 2048.0) -> list[float]:
    """Distance in Mpc at which an optimally placed binary has SNR 1, for each spectrum."""
    strain = 1 / (3.0856775814913673e22 / signal.LIGHT)  # one Mpc in seconds
    out = []
    for psd in psds:
        power = signal.inspiral_psd(m1, m2, f_low, min(f_max, signal.get_f_lso(m1, m2)))
        out.append(signal.SignalModel(lambda f: signal.signal_psd(power, psd, f), f_max, 0.25).horizon * strain)
    return out


def z_at_snr(m1: float, m2: float, psds: list, threshold: float, min_triggers: int = 1, f_low: float = 10.0) -> float:
    """Redshift at which the k-th loudest detector sees exactly the threshold; masses grow with redshift."""

    def snr(z):
        reach = sorted(horizon(m1 * (1 + z), m2 * (1 + z), psds, f_low), reverse=True)
        return reach[min_triggers - 1] / float(C.luminosity_distance(z))

    low, high = 1e-6, 1e-3
    while snr(high) > threshold and high < 100:
        low, high = high, high * 2
    for _ in range(40):
        middle = math.sqrt(low * high)
        low, high = (middle, high) if snr(middle) > threshold else (low, middle)
    return math.sqrt(low * high)


def sensitive_volume(m1: float, m2: float, psds: list, threshold: float, min_triggers: int = 1, n: int = 64) -> float:
    """Comoving volume times time dilation, within the redshift of the threshold, in Mpc^3."""
    z = np.linspace(0, z_at_snr(m1, m2, psds, threshold, min_triggers), n + 1)[1:] - 0.5 * z_at_snr(m1, m2, psds, threshold, min_triggers) / n
    dz = z[1] - z[0] if n > 1 else 2 * z[0]
    return float((4 * np.pi * C.comoving_distance(z) ** 2 * C.C / C.H0 / C.efunc(z) / (1 + z)).sum() * dz)


def sensitive_distance(*args, **kw) -> float:
    return (3 * sensitive_volume(*args, **kw) / (4 * math.pi)) ** (1 / 3)


def cell_max(values) -> np.ndarray:
    """Largest value at the corners of each cell of an n-dimensional grid."""
    out = np.asarray(values)
    for axis in range(out.ndim):
        a = np.moveaxis(out, axis, 0)
        out = np.moveaxis(np.maximum(a[:-1], a[1:]), 0, axis)
    return out


def inject(spark, n: int, reach: DataFrame, seed: int = 0) -> DataFrame:
    """``n`` injections: (id, mass1, mass2, longitude, latitude, inclination, distance, redshift, geocent_end_time).

    ``reach`` holds the mass distribution on a grid (m1_low, m1_high, m2_low, m2_high, weight, z_max).  A cell
    is drawn by weight times volume through a cumulative sum and a range lookup; redshift is drawn
    uniformly in comoving volume over time dilation.  Draws are hashes of (seed, id), the same on every run.
    """
    cells = reach.toPandas()  # a grid of parameters, not data
    grid = np.linspace(0, float(cells["z_max"].max()), 2049)
    shell = 4 * np.pi * C.comoving_distance(grid) ** 2 * C.C / C.H0 / C.efunc(grid) / (1 + grid)
    volume = np.concatenate([[0], np.cumsum((shell[1:] + shell[:-1]) / 2 * np.diff(grid))])
    vmax = np.interp(cells["z_max"], grid, volume)
    upto = np.cumsum(cells["weight"].to_numpy(float) * vmax)
    upto /= upto[-1]
    box = cells[["m1_low", "m1_high", "m2_low", "m2_high"]].to_numpy(float)

    @vectorized("struct<mass1:double,mass2:double,redshift:double,distance:double>")
    def draw(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        k = np.minimum(np.searchsorted(upto, a.to_numpy(float), "right"), len(upto) - 1)
        m1 = box[k, 0] + (box[k, 1] - box[k, 0]) * b.to_numpy(float)
        m2 = box[k, 2] + (box[k, 3] - box[k, 2]) * c.to_numpy(float)
        z = np.interp(d.to_numpy(float) * vmax[k], volume, grid)
        return pd.DataFrame({"mass1": np.maximum(m1, m2) * (1 + z), "mass2": np.minimum(m1, m2) * (1 + z), "redshift": z, "distance": C.luminosity_distance(z)})

    def u(k):
        return (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.lit(k)), F.lit(1 << 52)) + 0.5) / float(1 << 52)

    out = spark.range(n).withColumn("_d", draw(u(0), u(1), u(2), u(3)))
    return out.select("id", "_d.*", (u(4) * 2 * math.pi).alias("longitude"), F.asin(2 * u(5) - 1).alias("latitude"), F.acos(2 * u(6) - 1).alias("inclination"), (u(7) * 2 * math.pi).alias("polarization"), (F.lit(1e9) + F.col("id") * 32.0).alias("geocent_end_time"))


TRIGGERS = "id:long,ifo:string,snr:double,phase:double,time:double,horizon:double,snr_re:array<double>,snr_im:array<double>,rate:double,epoch:double"


def realize(injections: DataFrame, detectors: list[dict], measurement_error: str = "zero-noise", f_low: float = 10.0, duration: float = 0.05, rate: float = 2048.0, seed: int = 0) -> DataFrame:
    """Triggers of injections in each detector: SNR, phase, time and the SNR series around it.

    ``detectors`` are dicts (ifo, response 3 x 3, location in light seconds, psd callable).  Noise, where asked
    for, is correlated like the signal's own autocorrelation and seeded by injection and detector.
    """

    def run(batches):
        for rows in batches:
            out = []
            for r in rows.itertuples():
                gmst = 2 * math.pi * ((0.7790572732640 + 1.00273781191135448 * ((r.geocent_end_time + 315964782 - 946728000) / 86400)) % 1)
                for j, d in enumerate(detectors):
                    power = signal.inspiral_psd(r.mass1, r.mass2, f_low)
                    acf, fs = signal.autocorrelation(lambda f: signal.signal_psd(power, d["psd"], f), duration, rate / 2)
                    reach = horizon(r.mass1, r.mass2, [d["psd"]], f_low)[0]
                    f = signal.antenna_factor(d["response"], r.longitude, r.latitude, gmst)
                    u = math.cos(r.inclination)
                    z = complex(signal.signal_amplitude(f, np.exp(2j * r.polarization), u)) * reach / r.distance
                    delay = float(-signal.toa_errors(math.pi / 2 - r.latitude, r.longitude, gmst, [d["location"]], [0.0])[0])
                    series = z * np.concatenate([np.conj(acf[:0:-1]), acf])
                    if measurement_error == "gaussian-noise":
                        rng = np.random.default_rng([seed, int(r.id), j])
                        white = rng.normal(size=(2, len(series) + len(acf) - 1)) @ np.eye(len(series) + len(acf) - 1)
                        kernel = acf / np.sqrt((np.abs(acf) ** 2).sum())
                        series = series + np.convolve(white[0] + 1j * white[1], kernel, "valid")[: len(series)]
                    k = int(np.argmax(np.abs(series)))
                    t, value = signal.interpolate_max(k, series, 8, "quadratic-fit")
                    middle = len(acf) - 1
                    out.append((r.id, d["ifo"], abs(value), float(np.angle(value)), r.geocent_end_time + delay + (t - middle) / fs, reach, series.real.tolist(), series.imag.tolist(), fs, r.geocent_end_time + delay - middle / fs))
            yield pd.DataFrame(out, columns=[f.split(":")[0] for f in TRIGGERS.split(",")])

    return injections.mapInPandas(run, fields(TRIGGERS))
