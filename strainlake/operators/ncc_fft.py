"""The transform kernel: correlation maps of batches of windows by FFT.

Only lags within half a window count, so transforms are padded to one and a half windows, not two, and lines that are
not needed are left out of the way back. The energies of the overlaps are sums over boxes and come from prefix sums,
without a transform.
"""

from __future__ import annotations

import numpy as np


def taper(n: int, alpha: float) -> np.ndarray:
    if n == 1 or alpha == 0:
        return np.ones(n)
    edge = alpha * (n - 1) / 2
    near = np.minimum(np.arange(n), np.arange(n)[::-1]).astype(float)
    return np.where(near < edge, 0.5 * (1 + np.cos(np.pi * (near / edge - 1))), 1.0)


def prepared(v: np.ndarray, m: np.ndarray | None, alpha: float) -> np.ndarray:
    """Windows (batch, z, y, x) less their masked mean, tapered, zero where masked; without a mask all is valid."""
    axes = (1, 2, 3)
    if m is None:
        out = v - v.mean(axes, keepdims=True, dtype=float).astype(v.dtype)
    else:
        mean = (v * m).sum(axes, keepdims=True, dtype=float) / np.maximum(1, m.sum(axes, keepdims=True))
        out = (v - mean.astype(v.dtype)) * m
    if alpha:
        tz, ty, tx = (taper(n, alpha).astype(v.dtype) for n in v.shape[1:])
        out *= tz[:, None, None] * ty[:, None] * tx
    return out


def padded(w: int) -> int:
    """The least length without primes beyond 5 at which no lag within half a window wraps onto another."""
    n = w + w // 2
    while True:
        rest = n
        for p in (2, 3, 5):
            while rest % p == 0:
                rest //= p
        if rest == 1:
            return n
        n += 1


def window_bytes(window: tuple[int, int, int], mode: str = "linear", single: bool = False) -> int:
    """Bytes in flight for each window of a batch: two spectra and their product, and maps of the window's size."""
    pz, py, px = window if mode == "cyclic" else map(padded, window)
    spectrum = pz * py * (px // 2 + 1) * (8 if single else 16)
    return 3 * spectrum + 8 * window[0] * window[1] * window[2] * (5 if single else 8)


def overlap_energy(v: np.ndarray, sign: int) -> np.ndarray:
    """Sums of v over the overlap at each lag in wrapped order; sign 1 for the reference, -1 for the deformed window."""
    e = v.astype(float)
    e *= e
    for axis, w in enumerate(v.shape[1:], 1):
        upto = np.concatenate([np.zeros_like(e.take([0], axis)), np.cumsum(e, axis)], axis)
        lag = np.r_[0 : w - w // 2, -(w // 2) : 0] * sign
        # Lag k >= 0: the first w - k samples; k < 0: all but the first -k.
        e = upto.take(np.where(lag >= 0, w - lag, w), axis) - upto.take(np.where(lag >= 0, 0, -lag), axis)
    return np.maximum(0, e, out=e)


def correlation(r: np.ndarray, d: np.ndarray, mode: str = "linear", normalization: str = "overlap", eps: float = 1e-12) -> np.ndarray:
    """Maps over lags in wrapped order (0, 1, ..., then the negative ones) on each axis."""
    window, axes = r.shape[1:], (1, 2, 3)
    size = window if mode == "cyclic" else tuple(map(padded, window))
    spectrum = np.fft.rfftn(r, s=size, axes=axes)
    np.conj(spectrum, out=spectrum)
    spectrum *= np.fft.rfftn(d, s=size, axes=axes)
    kept = [np.r_[0 : w - w // 2, s - w // 2 : s] for w, s in zip(window, size, strict=True)]
    for axis in (1, 2):  # each axis is cut to the lags before the next is transformed
        spectrum = np.fft.ifft(spectrum, axis=axis).take(kept[axis - 1], axis)
    rd = np.fft.irfft(spectrum, n=size[2], axis=3).take(kept[2], 3)
    if normalization == "global":
        energy = (r.astype(float) ** 2).sum(axes, keepdims=True) * (d.astype(float) ** 2).sum(axes, keepdims=True)
    else:
        energy = overlap_energy(r, 1)
        energy *= overlap_energy(d, -1)
    energy += eps
    return rd / np.sqrt(energy, out=energy)


def peak_of(corr: np.ndarray, eps: float = 1e-12, digits: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integer lags, refined lags and the value at the integer lag. digits: the map is rounded to so many before."""
    if digits is not None:
        corr = np.round(corr, digits)
    b, *window = corr.shape
    flat = corr.reshape(b, -1)
    best = flat.argmax(1)
    value = flat[np.arange(b), best]
    index = np.stack(np.unravel_index(best, window), 1)
    lag, fine = np.empty((b, 3), np.int64), np.empty((b, 3))
    for a, w in enumerate(window):
        lag[:, a] = np.where(index[:, a] < w - w // 2, index[:, a], index[:, a] - w)
        side = []
        for step in (-1, 1):
            i = index.copy()
            i[:, a] = (i[:, a] + step) % w
            side.append(corr[np.arange(b), i[:, 0], i[:, 1], i[:, 2]])
        m, p = side
        pos = (m > 0) & (value > 0) & (p > 0)
        lm, l0, lp = (np.log(np.where(pos, x, 1)) for x in (m, value, p))
        m, z, p = np.where(pos, lm, m), np.where(pos, l0, value), np.where(pos, lp, p)
        den = 2 * (m - 2 * z + p)
        fine[:, a] = lag[:, a] + np.clip((m - p) / np.where(np.abs(den) < eps, eps, den), -0.5, 0.5)
    return lag, fine, value
