"""Signal kernels on NumPy arrays, called by the Arrow functions of operators/features.py.

Filters work in the frequency domain: a zero-phase pass of a digital Butterworth filter forward and
backward multiplies the spectrum by the squared magnitude of its response, which is known in closed form.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

#: The low-pass decomposition filter of the Daubechies wavelet with four vanishing moments.
DB4 = np.array([-0.010597401784997278, 0.032883011666982945, 0.030841381835986965, -0.18703481171888114, -0.02798376941698385, 0.6308807679295904, 0.7148465705525415, 0.23037781330885523])
EPS = 1e-12


def _response(freq: np.ndarray, rate: float, low: float | None, high: float | None, order: int) -> np.ndarray:
    warp = lambda f: np.tan(np.pi * np.clip(f, 0, rate / 2 * (1 - 1e-9)) / rate)
    w = np.maximum(warp(freq), 1e-15)
    if low and high:
        a, b = warp(np.float64(low)), warp(np.float64(high))
        x = (w * w - a * b) / ((b - a) * w)
    else:
        x = warp(np.float64(low)) / w if low else w / warp(np.float64(high))
    with np.errstate(over="ignore"):
        return 1 / (1 + x ** (2 * order))


def zero_phase(x: np.ndarray, rate: float, low: float | None = None, high: float | None = None, order: int = 4) -> np.ndarray:
    """Butterworth high-pass (low), low-pass (high) or band-pass (both), forward and backward, ends mirrored about their last value."""
    n = len(x)
    if n < 2:
        return x.astype(np.float64)
    pad = min(n - 1, int(rate // 4) + 1)
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    spectrum = np.fft.rfft(y)
    return np.fft.irfft(spectrum * _response(np.fft.rfftfreq(len(y), 1 / rate), rate, low, high, order), len(y))[pad : pad + n]


def preprocess(x: np.ndarray, rate: float, high_pass: float = 20.0, trim: float = 0.5, level: float = 0.1) -> np.ndarray:
    """Finite samples, high-passed, trimmed at both ends where long enough, at a fixed RMS."""
    x = x[np.isfinite(x)].astype(np.float64)
    x = zero_phase(x, rate, low=high_pass)
    cut = int(trim * rate)
    if len(x) > 2 * cut + rate:
        x = x[cut:-cut]
    rms = math.sqrt(float(np.mean(x * x))) if len(x) else 0.0
    return (x * (level / rms) if rms > EPS else x).astype(np.float32)


def stft_power(x: np.ndarray, size: int = 256, hop: int = 128) -> np.ndarray:
    """(frequencies, frames) power of periodic-Hann windows, scaled by the window's sum; no padding."""
    if len(x) < size:
        x = np.pad(x, (0, size - len(x)))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
    return (np.abs(np.fft.rfft(frames * window, axis=1)) ** 2 / window.sum() ** 2).T


@lru_cache(64)
def mel_bank(rate: float, size: int = 256, rows: int = 40, area: bool = True) -> np.ndarray:
    """Triangles on the HTK mel scale, of equal area or of row sum one."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), rows + 2) / 2595) - 1)
    f = np.fft.rfftfreq(size, 1 / rate)
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    bank = np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid)))
    return bank * (2 / (high - low)) if area else bank / np.maximum(bank.sum(1, keepdims=True), EPS)


def decibels(power: np.ndarray, floor: float = 1e-10, top: float = 80.0) -> np.ndarray:
    db = 10 * np.log10(np.maximum(power, floor) / max(float(power.max(initial=0)), floor))
    return np.maximum(db, db.max(initial=-top) - top)


def pcen(energy: np.ndarray, frame_rate: float, time: float = 0.4, alpha: float = 0.98, delta: float = 2.0, r: float = 0.5, eps: float = 1e-6, normalise: bool = True) -> np.ndarray:
    """Per-channel energy normalisation of (rows, frames); the smoother starts from the median of the first frames."""
    if normalise:
        positive = energy[energy > 0]
        energy = np.clip(energy / (np.median(positive) if len(positive) else 1.0), 0, 1e6)
    t = max(time * frame_rate, 1e-6)
    s = 2 / (math.sqrt(1 + 4 * t * t) + 1)
    smooth = np.empty_like(energy)
    last = np.median(energy[:, : max(3, round(1 / s))], axis=1)
    for k in range(energy.shape[1]):
        last = (1 - s) * last + s * energy[:, k]
        smooth[:, k] = last
    return (energy / (eps + smooth) ** alpha + delta) ** r - delta**r


def wavelet(x: np.ndarray, level: int = 5) -> list[np.ndarray]:
    """[approximation, coarsest detail, ..., finest detail] with mirrored ends."""
    high = DB4[::-1] * np.where(np.arange(8) % 2, 1, -1)
    out, low = [], np.asarray(x, np.float64)
    for _ in range(level):
        if len(low) < 8:
            break
        y = np.pad(low, 7, mode="symmetric")
        out.append(np.convolve(y, high, "valid")[1::2])
        low = np.convolve(y, DB4, "valid")[1::2]
    return [low, *out[::-1]]


def envelope(x: np.ndarray) -> np.ndarray:
    """Magnitude of the analytic signal."""
    n = len(x)
    if not n:
        return x
    spectrum = np.fft.fft(x)
    weight = np.zeros(n)
    weight[0] = 1
    weight[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        weight[n // 2] = 1
    return np.abs(np.fft.ifft(spectrum * weight))


def peaks(x: np.ndarray, prominence: float, distance: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(places, prominences) of local maxima, higher ones first where they are nearer than distance."""
    change = np.flatnonzero(np.diff(x) != 0)
    if not len(change):
        return np.zeros(0, np.int64), np.zeros(0)
    starts, ends = np.append(0, change + 1), np.append(change, len(x) - 1)
    value = x[starts]
    top = np.flatnonzero((value[1:-1] > value[:-2]) & (value[1:-1] > value[2:])) + 1
    place = (starts[top] + ends[top]) // 2
    keep = np.ones(len(place), bool)
    for k in np.argsort(-x[place], kind="stable"):
        if keep[k]:
            near = np.abs(place - place[k]) < distance
            near[k] = False
            keep &= ~near
    place = place[keep]
    height = []
    for p in place:
        left, right = x[: p + 1], x[p:]
        above = np.flatnonzero(left > x[p])
        low_left = left[above[-1] if len(above) else 0 :].min()
        above = np.flatnonzero(right > x[p])
        low_right = right[: above[0] if len(above) else len(right)].min()
        height.append(x[p] - max(low_left, low_right))
    height = np.array(height)
    good = height >= prominence if len(height) else np.zeros(0, bool)
    return place[good], height[good]


def frames(x: np.ndarray, width: int, hop: int) -> np.ndarray:
    """Windows of a series; a last one aligned to the end where samples remain, one short one where it is short."""
    width, hop = max(1, width), max(1, hop)
    if len(x) <= width:
        return x[None, :]
    starts = list(range(0, len(x) - width + 1, hop))
    if starts[-1] + width < len(x):
        starts.append(len(x) - width)
    return x[np.add.outer(starts, np.arange(width))]


def kurtosis(x: np.ndarray, excess: bool = False, unbiased: bool = False) -> np.ndarray:
    """Along the last axis; 0 (3 if not excess) where nothing varies or too few values are there."""
    n = x.shape[-1]
    d = x - x.mean(-1, keepdims=True)
    m2 = (d**2).mean(-1)
    k = np.where(m2 > EPS**2, (d**4).mean(-1) / np.maximum(m2, EPS**2) ** 2, 3.0)
    if unbiased and n > 3:
        k = np.where(m2 > EPS**2, ((n * n - 1) * k - 3 * (n - 1) ** 2) / ((n - 2) * (n - 3)) + 3, 3.0)
    return k - 3 if excess else k


def crest(x: np.ndarray) -> np.ndarray:
    return np.abs(x).max(-1) / np.maximum(np.sqrt((x * x).mean(-1)), EPS)


def impulse(x: np.ndarray) -> np.ndarray:
    return np.abs(x).max(-1) / np.maximum(np.abs(x).mean(-1), EPS)


def crossings(x: np.ndarray) -> np.ndarray:
    n = x.shape[-1]
    return (x[..., 1:] * x[..., :-1] < 0).sum(-1) / max(n - 1, 1)


def robust_scale(x: np.ndarray, floor: float = 1e-9) -> float:
    q1, q2, q3 = np.percentile(x, [25, 50, 75])
    return max(1.4826 * float(np.median(np.abs(x - q2))), float(q3 - q1) / 1.349, floor)


def longest_true(x: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], x.astype(np.int8), [0]])))
    return int((edges[1::2] - edges[::2]).max(initial=0))


#: Order and ripple in decibels of the low-pass before samples are left out, its edge as a share of the new limit.
DECIMATION = (8, 0.05, 0.8)


def decimated(x: np.ndarray, step: int) -> np.ndarray:
    """Every step-th value after a zero-phase Chebyshev low-pass, ends mirrored about their last value."""
    n = len(x)
    if step < 2 or n < 2:
        return x
    order, ripple, edge = DECIMATION
    pad = min(n - 1, 27 * step)
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    w = np.tan(np.pi * np.clip(np.fft.rfftfreq(len(y)), 0, 0.5 - 1e-9)) / np.tan(np.pi * edge / step / 2)
    chebyshev = np.where(w <= 1, np.cos(order * np.arccos(np.minimum(w, 1))), np.cosh(order * np.arccosh(np.maximum(w, 1))))
    with np.errstate(over="ignore"):
        # Even orders begin at the ripple's depth; forward and backward squares the magnitude.
        gain = 1 / (1 + (10 ** (ripple / 10) - 1) * chebyshev**2)
    return np.fft.irfft(np.fft.rfft(y) * gain, len(y))[pad : pad + n][::step]


def biased_kurtosis(x: np.ndarray) -> float:
    """Fourth moment over the squared variance, 0 for fewer than four values or none that differ."""
    if len(x) < 4:
        return 0.0
    d = x - x.mean()
    m2 = float((d * d).mean())
    return float((d**4).mean()) / (m2 * m2) if m2 > 0 else 0.0


def prefix_moments(x: np.ndarray) -> np.ndarray:
    """Sums of the first to fourth powers before each place, about the mean of all, from which any segment's moments follow."""
    d = x - x.mean() if len(x) else x
    out = np.zeros((4, len(x) + 1))
    np.cumsum(np.stack([d, d**2, d**3, d**4]), axis=1, out=out[:, 1:])
    return out


def segment_kurtosis(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, biased: bool = True, fisher: bool = False) -> np.ndarray:
    """Kurtosis of segments in constant time each; 0 for three values or fewer, NaN where none differ."""
    n = (ends - starts).astype(float)
    m1, e2, e3, e4 = (sums[:, ends] - sums[:, starts]) / np.maximum(n, 1)
    m2 = e2 - m1 * m1
    m4 = e4 - 4 * m1 * e3 + 6 * m1 * m1 * e2 - 3 * m1**4
    # What is left of the sums of all where a segment's cancel.
    noise = 1e-13 * sums[1, -1] / np.maximum(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        k = m4 / (m2 * m2)
        if not biased:
            k = ((n * n - 1) * k - 3 * (n - 1) ** 2) / ((n - 2) * (n - 3)) + 3
    k = np.where(m2 <= noise, np.nan, k - 3 * fisher)
    return np.where(n > 3, k, 0.0)


def smoothed(x: np.ndarray, width: int) -> np.ndarray:
    """Each value by the parabola that fits the odd number of values around it best; the ends by the parabolas of the first and last of them."""
    if len(x) < width or width < 4:
        return x
    half = width // 2
    t = np.arange(-half, half + 1)
    base = np.stack([t**0, t, t**2], 1).astype(float)
    fit = np.linalg.pinv(base)
    out = np.convolve(x, fit[0][::-1], "same")
    out[:half], out[-half:] = (base @ (fit @ x[:width]))[:half], (base @ (fit @ x[-width:]))[-half:]
    return out
