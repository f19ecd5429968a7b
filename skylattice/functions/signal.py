"""Matched-filter signals: spectra, correlation, peaks, detector response.  NumPy kernels for grouped functions."""

from __future__ import annotations

import math

import numpy as np

#: Solar mass in seconds and c in m/s.  Fixed values.
MSUN_S, LIGHT = 4.925490947641267e-06, 299792458.0


def exp_i(x):
    return np.cos(x) + 1j * np.sin(x)


def abs2(x):
    return np.square(np.real(x)) + np.square(np.imag(x))


def ceil_pow_2(n: int) -> int:
    return 1 if n <= 1 else 1 << (int(n) - 1).bit_length()


def abscissa(f0: float, df: float, n: int) -> np.ndarray:
    return f0 + df * np.arange(n)


def unwrap(y):
    """Phase without jumps of more than half a turn; entries that aren't finite are passed over."""
    y = np.array(y, float)
    good = np.isfinite(y)
    y[good] = np.unwrap(y[good])
    return y


def truncated_ifft(y, nsamples_out: int | None = None):
    """The first samples of an inverse FFT, from folded input where that is shorter."""
    y = np.asarray(y, complex)
    n = len(y)
    m = n if nsamples_out is None else int(nsamples_out)
    if m > n:
        raise ValueError("more samples are asked for than there are")
    if m == n:
        return np.fft.ifft(y)
    if n & (n - 1):
        raise ValueError("the input must be a power of two long to be truncated")
    size = ceil_pow_2(m)
    # sample t of the long transform, t < size: sum over residues of short transforms with twiddles
    parts = y.reshape(size, n // size)
    twiddle = exp_i(2 * np.pi * np.outer(np.arange(size), np.arange(n // size)) / n)
    return ((np.fft.ifft(parts, axis=0) * twiddle).sum(axis=1) * (size / n))[:m]


def get_f_lso(m1: float, m2: float) -> float:
    """Gravitational-wave frequency at the last stable orbit, masses in solar masses."""
    return 1 / (6**1.5 * math.pi * (m1 + m2) * MSUN_S)


def inspiral_psd(m1: float, m2: float, f_low: float = 10.0, f_high: float | None = None):
    """Power of an inspiral signal as a function of frequency: f^(-7/3) up to the last stable orbit."""
    end = get_f_lso(m1, m2) if f_high is None else f_high
    chirp = (m1 * m2) ** 0.6 * (m1 + m2) ** -0.2 * MSUN_S
    scale = 5 / 24 * math.pi ** (-4 / 3) * chirp ** (5 / 3)

    def power(f):
        f = np.asarray(f, float)
        inside = (f >= f_low) & (f < end)
        return np.where(inside, scale * np.where(f > 0, f, 1.0) ** (-7 / 3), 0.0)

    return power


#: Names of waveform families, and the words for post-Newtonian orders with twice the order.  Fixed values of the format.
APPROXIMANTS = ("TaylorT1", "TaylorT2", "TaylorT3", "TaylorT4", "TaylorF2", "TaylorF2RedSpin", "TaylorF2RedSpinTidal", "SpinTaylorF2", "SpinTaylorT4", "SpinTaylorT4Fourier", "EOBNRv2", "SEOBNRv2", "SEOBNRv2_ROM_DoubleSpin", "SEOBNRv4", "SEOBNRv4_ROM", "IMRPhenomA", "IMRPhenomB", "IMRPhenomC", "IMRPhenomD", "IMRPhenomPv2")
ORDERS = {"newtonian": 0, "oneHalfPN": 1, "onePN": 2, "onePointFivePN": 3, "twoPN": 4, "twoPointFivePN": 5, "threePN": 6, "threePointFivePN": 7, "pseudoFourPN": 8}
INSPIRAL_ONLY = ("TaylorT1", "TaylorT2", "TaylorT3", "TaylorT4", "TaylorF2", "TaylorF2RedSpin", "TaylorF2RedSpinTidal", "SpinTaylorF2", "SpinTaylorT4", "SpinTaylorT4Fourier")


def approximant_and_orders(text: str) -> tuple[str, int, int]:
    """(family, amplitude order, phase order) of a name such as TaylorT4threePointFivePN; -1 where no order is named.

    The longest family that the text holds counts; a restricted waveform has amplitude order 0.
    """
    families = [a for a in APPROXIMANTS if a in text]
    if not families:
        raise ValueError(f"no known waveform in {text!r}")
    family = max(families, key=len)
    words = [w for w in ORDERS if w in text.replace(family, "", 1)]
    phase = ORDERS[max(words, key=len)] if words else -1
    return family, 0 if "estricted" in text else phase, phase


def waveform_of(name: str, m1: float, m2: float) -> str:
    """The waveform of a bank that changes with mass: inspirals below a total of 4 solar masses, else a model with merger."""
    banks = {"o1-uberbank": "SEOBNRv2_ROM_DoubleSpin", "o2-uberbank": "SEOBNRv4_ROM"}
    return name if name not in banks else "TaylorF2threePointFivePN" if m1 + m2 < 4 else banks[name]


#: Coefficients of the symmetric mass ratio squared, itself and 1, for the frequencies of a published inspiral-merger-ringdown amplitude.  Fixed values.
MERGER = {"merger": (2.9740e-1, 4.4810e-2, 9.5560e-2), "ring": (5.9411e-1, 8.9794e-2, 1.9111e-1), "width": (5.0801e-1, 7.7515e-2, 2.2369e-2), "cut": (8.4845e-1, 1.2848e-1, 2.7299e-1)}


def merger_psd(m1: float, m2: float, f_low: float = 10.0, f_high: float | None = None):
    """Power with merger and ringdown: f^(-7/3) up to the merger, f^(-4/3) up to the ringdown, then a Lorentzian, squared, to its cut."""
    eta, total = m1 * m2 / (m1 + m2) ** 2, (m1 + m2) * MSUN_S
    f = {k: (a * eta * eta + b * eta + c) / (math.pi * total) for k, (a, b, c) in MERGER.items()}
    end = min(f["cut"], math.inf if f_high is None else f_high)
    inspiral = inspiral_psd(m1, m2, f_low, math.inf)
    at_merger = float(inspiral_psd(m1, m2, 0.0, math.inf)(f["merger"]))
    ring = math.pi * f["width"] / 2 * (f["ring"] / f["merger"]) ** (-2 / 3)

    def power(x):
        x = np.asarray(x, float)
        y = np.where(x > 0, x, 1.0)
        lorentz = ring / (2 * math.pi) * f["width"] / ((y - f["ring"]) ** 2 + f["width"] ** 2 / 4)
        late = np.where(y < f["ring"], (y / f["merger"]) ** (-4 / 3), lorentz**2) * at_merger
        return np.where((x >= f_low) & (x < end), np.where(y < f["merger"], inspiral(x), late), 0.0)

    return power


def template_psd(name: str, m1: float, m2: float, f_low: float = 10.0, f_final: float | None = None):
    """Signal power of a named waveform: inspirals end at the last stable orbit, all others have merger and ringdown.

    All of them end at ``f_final`` (2048 Hz unless given).
    """
    family = approximant_and_orders(waveform_of(name, m1, m2))[0]
    end = 2048.0 if f_final is None else f_final
    if family in INSPIRAL_ONLY:
        return inspiral_psd(m1, m2, f_low, min(end, get_f_lso(m1, m2)))
    return merger_psd(m1, m2, f_low, end)


def vectorized_psd(f):
    """A spectrum given as a function of one frequency, as a function of arrays; infinite where it fails or isn't positive."""

    def one(x: float) -> float:
        try:
            s = float(f(float(x)))
        except (ValueError, ArithmeticError, RuntimeError):
            return math.inf
        return s if s > 0 else math.inf

    return np.vectorize(one, otypes=[float])


def derivative(f, x, dx: float = 1.0):
    """Central difference; ``f`` may take numbers, arrays or Columns."""
    return (f(x + dx) - f(x - dx)) / (2 * dx)


def interpolated_psd(f, s, f_high_truncate: float = 1.0, fill: float = math.inf):
    """Log-log linear interpolation of a sampled spectrum; ``fill`` outside and above the truncation."""
    f, s = np.asarray(f, float), np.asarray(s, float)
    good = (f > 0) & np.isfinite(s) & (s > 0)
    x, y = np.log(f[good]), np.log(s[good])
    top = f_high_truncate * f[good].max() if good.any() else 0.0

    def power(g):
        g = np.asarray(g, float)
        inside = (g >= (np.exp(x[0]) if len(x) else np.inf) * (1 - 1e-12)) & (g <= top * (1 + 1e-12))
        return np.where(inside, np.exp(np.interp(np.log(np.where(g > 0, g, 1.0)), x, y)) if len(x) else fill, fill)

    return power


def signal_psd(h, s, f):
    """Signal power over noise; 0 where the noise is infinite or zero."""
    a, b = h(f), s(f)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.isfinite(b) & (b > 0), a / b, 0.0)


def autocorrelation(power, out_duration: float, f_max: float, normalize: bool = True, df: float = 1 / 64):
    """(samples, rate): autocorrelation of a signal of the given power over frequency."""
    n = ceil_pow_2(int(math.ceil(f_max / df)))
    rate = 2 * n * df
    h = np.zeros(2 * n, complex)
    h[:n] = power(df * np.arange(n))
    out = truncated_ifft(h, min(2 * n, max(1, int(math.ceil(out_duration * rate)))))
    return (out / out[0] if normalize and out[0] != 0 else out), rate


class SignalModel:
    """Moments of the whitened signal and the bounds on measurements that follow from them."""

    def __init__(self, power, f_max: float = 2048.0, df: float = 1 / 16):
        f = df * np.arange(1, int(f_max / df) + 1)
        w = power(f)
        self.df = df
        self.horizon = 2 * math.sqrt(float(w.sum() * df))
        total = float(w.sum())
        self.m1 = 2 * math.pi * float((w * f).sum() / total) if total else 0.0
        self.m2 = (2 * math.pi) ** 2 * float((w * f * f).sum() / total) if total else 0.0

    def fisher(self, snr: float) -> np.ndarray:
        """Information on (amplitude, phase, time)."""
        return np.array([[1.0, 0, 0], [0, snr**2, -(snr**2) * self.m1], [0, -(snr**2) * self.m1, snr**2 * self.m2]])

    def covariance(self, snr: float) -> np.ndarray:
        return np.linalg.inv(self.fisher(snr))

    def time_uncertainty(self, snr: float) -> float:
        """Cramer-Rao bound on the arrival time, in seconds."""
        return 1 / (snr * math.sqrt(self.m2 - self.m1**2))


def antenna_factor(response, ra, dec, gmst):
    """Complex response F+ + i Fx of a 3 x 3 detector tensor, or of one for each direction, to directions."""
    d = np.asarray(response, float)
    gha = np.asarray(gmst, float) - np.asarray(ra, float)
    cg, sg, cd, sd = np.cos(gha), np.sin(gha), np.cos(dec), np.sin(dec)
    zero = np.zeros(np.broadcast(cg, cd).shape)
    x = np.stack([-sg + zero, -cg + zero, zero], axis=-1)
    y = np.stack([-cg * sd + zero, sg * sd + zero, cd + zero], axis=-1)
    product = lambda a, b: np.einsum("...i,...ij,...j", a, d, b)
    return product(x, x) - product(y, y) + 1j * (product(x, y) + product(y, x))


def signal_amplitude(f, exp_i_twopsi, u, u2=None):
    """Complex amplitude in a detector of antenna factor f, at polarisation psi and cosine of inclination u."""
    u2 = u * u if u2 is None else u2
    turned = f * np.conj(exp_i_twopsi)
    return 0.5 * (1 + u2) * turned.real - 1j * u * turned.imag


def toa_errors(theta, phi, gmst, locations, toas):
    """Arrival times minus those of a plane wave from (theta, phi); locations in light seconds."""
    st = np.sin(theta)
    n = np.stack([st * np.cos(phi - gmst), st * np.sin(phi - gmst), np.cos(theta) + 0 * np.asarray(phi)], axis=-1)
    return np.asarray(toas) + n @ np.asarray(locations).T


def catmull_rom(x0, x1, x2, x3, t):
    return x1 + 0.5 * t * (x2 - x0 + t * (2 * x0 - 5 * x1 + 4 * x2 - x3 + t * (3 * (x1 - x2) + x3 - x0)))


def eval_snr(series, t):
    """Complex series at fractional sample positions: cubic in amplitude and in unwrapped phase; 0 outside."""
    x = np.asarray(series, complex)
    t = np.asarray(t, float)
    k = np.floor(t).astype(int)
    inside = (k >= 1) & (k < len(x) - 2)
    k = np.where(inside, k, 1)
    four = x[np.stack([k - 1, k, k + 1, k + 2])] if len(x) >= 4 else np.zeros((4, *t.shape), complex)
    step = np.angle(four[1:] * np.conj(four[:-1]))
    phase = np.concatenate([np.angle(four[:1]), np.angle(four[:1]) + np.cumsum(step, axis=0)])
    amp = catmull_rom(*np.abs(four), t - np.floor(t))
    return np.where(inside, amp * exp_i(catmull_rom(*phase, t - np.floor(t))), 0)


def _nearest(y, i, window):
    return float(i), y[i]


def _quadratic(y, i, window):
    a, b, c = np.abs(y[i - 1]), np.abs(y[i]), np.abs(y[i + 1])
    curve = a - 2 * b + c
    t = 0.0 if curve == 0 else 0.5 * (a - c) / curve
    if not -0.5 <= t <= 0.5:
        return float(i), y[i]
    phase = np.unwrap(np.angle(y[i - 1 : i + 2]))
    p = phase[1] + 0.5 * t * (phase[2] - phase[0]) + 0.5 * t * t * (phase[0] - 2 * phase[1] + phase[2])
    return i + t, (b - 0.25 * (a - c) * t) * exp_i(p)


def _on_grid(f, low, high, n=2001, rounds=3):
    """Argument of the largest f in [low, high], by ever finer grids."""
    best = low
    for _ in range(rounds):
        t = np.linspace(low, high, n)
        best = t[int(np.argmax(f(t)))]
        span = (high - low) / (n - 1)
        low, high = best - span, best + span
    return best


def _catmull_rom(y, i, window):
    def at(t):
        k = np.clip(np.floor(t).astype(int), i - 1, i)
        return catmull_rom(y[k - 1], y[k], y[k + 1], y[k + 2], t - k)

    t = _on_grid(lambda t: np.abs(at(t)), i - 1.0, i + 1.0)
    return float(t), complex(at(np.array([t]))[0])


def _catmull_rom_amp_phase(y, i, window):
    """Peak at a root of the amplitude's polynomial in either half, else at the sample itself."""
    amp, phase = np.abs(y), unwrap(np.angle(y))
    best = (float(i), amp[i])
    for k in (i - 1, i):
        a = amp[k - 1 : k + 3]
        poly = 0.5 * np.array([-a[0] + 3 * a[1] - 3 * a[2] + a[3], 2 * a[0] - 5 * a[1] + 4 * a[2] - a[3], -a[0] + a[2], 2 * a[1]])
        for r in np.roots(poly):
            if abs(r.imag) < 1e-12 and 0 <= r.real <= 1:
                value = np.polyval(poly, r.real)
                if value > best[1]:
                    best = (k + r.real, value)
    t = best[0]
    k = min(int(t), len(y) - 3)
    return t, best[1] * exp_i(catmull_rom(*phase[k - 1 : k + 3], t - k))


def _lanczos(y, i, window):
    """Band-limited interpolation with a windowed sinc kernel."""
    k = np.arange(i - window, i + window + 1)
    k = k[(k >= 0) & (k < len(y))]

    def at(t):
        x = np.asarray(t, float)[:, None] - k
        return (np.sinc(x) * np.sinc(x / (window + 1)) * (np.abs(x) < window + 1)) @ y[k]

    t = _on_grid(lambda t: np.abs(at(t)), i - 1.0, i + 1.0, 401)
    return float(t), complex(at(np.array([t]))[0])


_METHODS = {"nearest": (_nearest, 0), "nearest-neighbor": (_nearest, 0), "quadratic-fit": (_quadratic, 1), "catmull-rom": (_catmull_rom, 2), "catmull-rom-amp-phase": (_catmull_rom_amp_phase, 2), "lanczos": (_lanczos, 1)}


def interpolate_max(imax: int, y, window: int, method: str = "catmull-rom-amp-phase") -> tuple[float, complex]:
    """(position, value) of the peak of |y| near sample ``imax``; ``window`` samples on each side may be used."""
    f, need = _METHODS[method]
    y = np.asarray(y, complex)
    if not 0 <= imax < len(y):
        raise IndexError("the sample lies outside the series")
    if window < need or imax - need < 0 or imax + need >= len(y):
        f = _nearest
    return f(y, int(imax), int(window))


def model_psd(f, kind: str = "aligo") -> np.ndarray:
    """Analytic noise spectra: a published fit to the advanced design, and white noise."""
    f = np.asarray(f, float)
    if kind == "flat":
        return np.where(f > 0, 1e-46, np.inf)
    x = np.where(f > 0, f, 1.0) / 215.0
    s = 1e-49 * (x**-4.14 - 5 * x**-2 + 111 * (1 - x**2 + x**4 / 2) / (1 + x**2 / 2))
    return np.where(f >= 10, s, np.inf)
