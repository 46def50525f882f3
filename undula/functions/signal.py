"""Small NumPy helpers of the spectral and filtering operators; they see one batch of equal-length rows at a time."""

from __future__ import annotations

import functools
import re

import numpy as np


def hann(n: int) -> np.ndarray:
    """The periodic window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


WINDOWS = {
    "hann": hann,
    "hamming": lambda n: 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / n),
    "blackman": lambda n: 0.42 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n) + 0.08 * np.cos(4 * np.pi * np.arange(n) / n),
    "boxcar": np.ones,
}


#: Mother wavelets: the function, half the span over which it is tabulated, and its centre frequency.
MOTHERS = {
    "cmor1.5-1.0": (lambda t: np.exp(2j * np.pi * t - t * t / 1.5) / np.sqrt(1.5 * np.pi), 8.0, 1.0),
    "mexh": (lambda t: 2 / (np.sqrt(3) * np.pi**0.25) * (1 - t * t) * np.exp(-t * t / 2), 8.0, 0.25),
    "morl": (lambda t: np.exp(-t * t / 2) * np.cos(5 * t), 8.0, 0.8125),
    "gaus1": (lambda t: -2 * t * np.exp(-t * t) / (np.pi / 2) ** 0.25, 5.0, 0.2),
}
MOTHER_POINTS = 1 << 12
#: Complex Morlet wavelets of any bandwidth and centre frequency.
MORLET = re.compile(r"cmor(\d+(?:\.\d+)?)-(\d+(?:\.\d+)?)")


def mother(name: str):
    """A mother wavelet by its name, one of MOTHERS or cmor<bandwidth>-<centre>."""
    if name in MOTHERS:
        return MOTHERS[name]
    found = MORLET.fullmatch(name)
    if not found or not float(found[1]) or not float(found[2]):
        raise ValueError(f"unknown wavelet {name}: there are {', '.join(MOTHERS)} and cmor<bandwidth>-<centre>")
    width, centre = float(found[1]), float(found[2])
    return lambda t: np.exp(2j * np.pi * centre * t - t * t / width) / np.sqrt(width * np.pi), 8.0, centre


def wavelet_kernel(name: str, freq: float, fs: float) -> tuple[float, np.ndarray]:
    """The root of the scale, and the wavelet's integral stretched to it, backwards."""
    psi, span, centre = mother(name)
    at = np.linspace(-span, span, MOTHER_POINTS)
    total = np.cumsum(psi(at)) * (at[1] - at[0])
    if np.iscomplexobj(total):
        total = total.conj()
    scale = centre * fs / freq
    places = (np.arange(scale * 2 * span + 1) / (scale * (at[1] - at[0]))).astype(int)
    return float(np.sqrt(scale)), total[places[places < len(total)]][::-1]


def one_sided(n: int) -> np.ndarray:
    """2 for the bins that stand for two, 1 for the mean and the Nyquist bin."""
    w = np.full(n // 2 + 1, 2.0)
    w[0] = 1
    if n % 2 == 0:
        w[-1] = 1
    return w


def analytic(x: np.ndarray) -> np.ndarray:
    """Rows with their negative frequencies removed."""
    n = x.shape[-1]
    keep = np.zeros(n)
    keep[0] = 1
    keep[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        keep[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * keep)


def butterworth(order: int, kind: str, cutoff: float | tuple[float, float], fs: float) -> np.ndarray:
    """Second-order sections (b0, b1, b2, a1, a2) of a digital Butterworth filter: lowpass, highpass, bandpass or bandstop."""
    edges = np.atleast_1d(np.asarray(cutoff, float))
    if not (0 < edges.min() and edges.max() < fs / 2) or (len(edges) == 2 and edges[0] >= edges[1]):
        raise ValueError("cut-off frequencies must rise between 0 and half the sampling rate")
    warped = 2 * fs * np.tan(np.pi * edges / fs)
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    if kind == "lowpass":
        p, z = poles * warped[0], np.array([])
    elif kind == "highpass":
        p, z = warped[0] / poles, np.zeros(order)
    else:
        centre, width = np.sqrt(warped[0] * warped[1]), warped[1] - warped[0]
        half = poles * width / 2 if kind == "bandpass" else width / 2 / poles
        root = np.sqrt(half * half - centre * centre + 0j)
        p = np.concatenate([half + root, half - root])
        z = np.zeros(order) if kind == "bandpass" else np.repeat([1j * centre, -1j * centre], order)
    dp = (2 * fs + p) / (2 * fs - p)
    dz = np.concatenate([(2 * fs + z) / (2 * fs - z), -np.ones(len(p) - len(z))])
    at = {"lowpass": 0.0, "highpass": np.pi, "bandstop": 0.0}.get(kind, 2 * np.arctan(np.sqrt(np.tan(np.pi * edges / fs).prod())))
    dp, dz = _in_pairs(dp), _in_pairs(dz)
    rows = []
    for a in range(0, len(dp), 2):
        den, num = np.real(np.poly(dp[a : a + 2])), np.real(np.poly(dz[a : a + 2]))
        den, num = np.pad(den, (0, 3 - len(den))), np.pad(num, (0, 3 - len(num)))
        e = np.exp(-1j * at * np.arange(3))
        gain = abs((den @ e) / (num @ e))  # each section passes the reference frequency as it is
        rows.append([*(num * gain), *den[1:]])
    return np.array(rows)


def _in_pairs(roots: np.ndarray) -> np.ndarray:
    """Conjugates side by side, real ones last."""
    up = sorted((r for r in roots if r.imag > 1e-12), key=lambda r: abs(abs(r) - 1))
    real = sorted((r.real for r in roots if abs(r.imag) <= 1e-12), key=lambda r: (abs(r), r))
    real = [x for pair in zip(real[: len(real) // 2], real[::-1], strict=False) for x in pair] + ([real[len(real) // 2]] if len(real) % 2 else [])
    return np.array([x for r in up for x in (r, r.conjugate())] + real, complex)


def notch(freq: float, quality: float, fs: float) -> np.ndarray:
    """One section that takes out `freq`, its width at half power freq / quality."""
    w = 2 * np.pi * freq / fs
    beta = np.tan(w / quality / 2)
    gain = 1 / (1 + beta)
    return np.array([[gain, -2 * np.cos(w) * gain, gain, -2 * gain * np.cos(w), 2 * gain - 1]])


#: Samples that the sections take at a step.
STEP = 64


def steady(sos: np.ndarray) -> np.ndarray:
    """The memories (section, 2) that sections have after an endless input of ones."""
    z, level = np.zeros((len(sos), 2)), 1.0
    for k, (b0, b1, b2, a1, a2) in enumerate(sos):
        out = level * (b0 + b1 + b2) / (1 + a1 + a2)
        z[k, 1] = b2 * level - a2 * out
        z[k, 0] = b1 * level - a1 * out + z[k, 1]
        level = out
    return z


def sections(sos: np.ndarray, x: np.ndarray, settled: bool = False) -> np.ndarray:
    """Rows of x through the sections; `settled` starts in the steady state of each row's first value."""
    x = np.asarray(x, float)
    start = steady(sos)[None] * x[:, :1, None] if settled and x.shape[1] else np.zeros((len(x), len(sos), 2))
    return sections_from(sos, x, start)[0]


def sections_from(sos: np.ndarray, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x through the sections, from memories (row, section, 2) on, and the memories that they leave.

    A section's two memories and STEP values give STEP results and the next two memories by one matrix, so a row takes
    len / STEP steps of matrix products, not one step a sample.
    """
    y, ends = np.array(x, float), np.array(start, float)
    n = y.shape[1]
    for k, (b0, b1, b2, a1, a2) in enumerate(sos):
        z = ends[:, k]
        size = min(STEP, n)
        unit, memory = _step(b0, b1, b2, a1, a2, size)
        out = np.empty_like(y)
        whole = n - n % size if size else 0
        for a in range(0, whole, max(size, 1)):
            state = np.concatenate([y[:, a : a + size], z], axis=1)
            out[:, a : a + size], z = state @ unit, state @ memory
        for t in range(whole, n):
            v = y[:, t]
            o = b0 * v + z[:, 0]
            z = np.stack([b1 * v - a1 * o + z[:, 1], b2 * v - a2 * o], axis=1)
            out[:, t] = o
        y, ends[:, k] = out, z
    return y, ends


@functools.lru_cache(64)
def _step(b0: float, b1: float, b2: float, a1: float, a2: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """What each unit value and each unit memory of a section leaves behind, sample by sample, and in the memories."""
    unit, memory = np.zeros((size + 2, size)), np.zeros((size + 2, 2))
    memory[size:] = np.eye(2)
    for t in range(size):
        v = np.zeros(size + 2)
        v[t] = 1
        o = b0 * v + memory[:, 0]
        memory = np.stack([b1 * v - a1 * o + memory[:, 1], b2 * v - a2 * o], axis=1)
        unit[:, t] = o
    return unit, memory


def transition(sos: np.ndarray, n: int) -> np.ndarray:
    """The matrix by which n samples of silence change the sections' memories, one after the other in a row."""
    size = 2 * len(sos)
    return sections_from(sos, np.zeros((size, n)), np.eye(size).reshape(size, -1, 2))[1].reshape(size, size).T


def settle_length(sos: np.ndarray, tolerance: float = 1e-10) -> int:
    """Samples after which what the filter remembers has fallen to `tolerance`."""
    poles = np.concatenate([np.roots([1, a1, a2]) for *_, a1, a2 in sos])
    return int(np.ceil(np.log(tolerance) / np.log(min(np.abs(poles).max(), 1 - 1e-9)))) + 10


def resampling_taps(up: int, down: int) -> np.ndarray:
    """Lowpass taps for a change of rate by up / down under a Kaiser window (beta 5), ten zeros to a side."""
    most = max(up, down)
    half = 10 * most
    m = np.arange(-half, half + 1)
    h = np.sinc(m / most) / most * np.kaiser(2 * half + 1, 5.0)
    return up * h / h.sum()


def windowed_sinc(taps: int, kind: str, cutoff: float | tuple[float, float], fs: float) -> np.ndarray:
    """Linear-phase FIR taps under a Hamming window, scaled to pass the middle of the band."""
    edges = np.atleast_1d(np.asarray(cutoff, float)) * 2 / fs
    bands = {"lowpass": [(0, edges[0])], "highpass": [(edges[0], 1)], "bandpass": [(edges[0], edges[-1])], "bandstop": [(0, edges[0]), (edges[-1], 1)]}[kind]
    m = np.arange(taps) - (taps - 1) / 2
    h = sum(r * np.sinc(r * m) - q * np.sinc(q * m) for q, r in bands) * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(taps) / (taps - 1)))
    low, high = bands[0]
    at = 0.0 if low == 0 else 1.0 if high == 1 else (low + high) / 2
    return h / (h * np.cos(np.pi * m * at)).sum()


def savgol_taps(window: int, order: int) -> np.ndarray:
    """Weights by which a least-squares polynomial gives the middle of a window."""
    half = window // 2
    return np.linalg.pinv(np.vander(np.arange(-half, half + 1), order + 1, increasing=True))[0]
