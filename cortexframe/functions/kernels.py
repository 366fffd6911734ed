"""Windows, filters and tapers: small arrays designed once and sent to tasks."""

from __future__ import annotations

import math

import numpy as np

LENGTH_FACTOR = {"hamming": 3.3, "hann": 3.1, "blackman": 5.0}


def taper(n: int, kind: str) -> np.ndarray:
    """Symmetric window of ``n`` points."""
    if kind == "none" or n == 1:
        return np.ones(n)
    x = 2 * np.pi * np.arange(n) / (n - 1)
    if kind == "hann":
        w = 0.5 - 0.5 * np.cos(x)
        return w / w.max() if w.max() > 0 else w
    if kind == "hamming":
        return 0.54 - 0.46 * np.cos(x)
    if kind == "blackman":
        return np.maximum(0.42 - 0.5 * np.cos(x) + 0.08 * np.cos(2 * x), 0)
    raise ValueError(f"unknown window {kind!r}")


def transition_widths(low: float | None, high: float | None, rate: float) -> tuple[float | None, float | None]:
    left = None if low is None else min(max(0.25 * low, 2.0), low)
    right = None if high is None else min(max(0.25 * high, 2.0), rate / 2 - high)
    return left, right


def filter_length(left: float | None, right: float | None, rate: float, window: str) -> int:
    """Odd length for the narrower of two transition bands."""
    narrow = min(x for x in (left, right) if x is not None)
    n = math.ceil(LENGTH_FACTOR[window] / narrow * rate)
    return n + 1 - n % 2


def lowpass_taps(n: int, cutoff: float, window: str) -> np.ndarray:
    """Windowed sinc with unit gain at 0; ``cutoff`` in parts of Nyquist."""
    h = cutoff * np.sinc(cutoff * (np.arange(n) - (n - 1) / 2)) * taper(n, window)
    return h / h.sum()


def fir_taps(n: int, freq: list[float], gain: list[int], window: str = "hamming") -> np.ndarray:
    """Multi-band kernel as a sum of low-passes, one at each change of gain.

    A low-pass that ends at a falling edge passes what lies below it, so the kernel is the
    all-pass (if Nyquist is passed) plus or minus those, centred in ``n`` taps.
    """
    h = np.zeros(n)
    if gain[-1] == 1:
        h[n // 2] = 1.0
    for (f0, g0), (f1, g1) in zip(zip(freq, gain, strict=True), zip(freq[1:], gain[1:], strict=True), strict=False):
        if g0 == g1:
            continue
        size = round(LENGTH_FACTOR.get(window, 3.3) / ((f1 - f0) / 2))
        size += 1 - size % 2
        if size > n:
            raise ValueError(f"{n} taps are too few for a transition that takes {size}")
        at = (n - size) // 2
        h[at : at + size] += (1 if g0 else -1) * lowpass_taps(size, (f0 + f1) / 2, window)
    return h


def band_edges(low: float | None, high: float | None, rate: float, left: float | None, right: float | None) -> tuple[list[float], list[int]]:
    """Frequencies in parts of Nyquist and gains of a high-, low- or band-pass."""
    nyq = rate / 2
    points: list[tuple[float, int]] = []
    points += [((low - left) / nyq, 0), (low / nyq, 1)] if low is not None else [(0.0, 1)]
    points += [(high / nyq, 1), ((high + right) / nyq, 0)] if high is not None else [(1.0, 1)]
    points = [(min(1.0, max(0.0, f)), g) for f, g in points]
    if points[0][0] > 0:
        points.insert(0, (0.0, points[0][1]))
    if points[-1][0] < 1:
        points.append((1.0, points[-1][1]))
    return [p[0] for p in points], [p[1] for p in points]


def notch_edges(freqs: list[float], widths: list[float], rate: float, transition: float) -> tuple[list[float], list[int]]:
    nyq = rate / 2
    points: list[tuple[float, int]] = [(0.0, 1)]
    for f, w in sorted(zip(freqs, widths, strict=True)):
        inner, outer = w / 2, w / 2 + transition / 2
        new = [((f - outer) / nyq, 1), ((f - inner) / nyq, 0), ((f + inner) / nyq, 0), ((f + outer) / nyq, 1)]
        if new[0][0] <= points[-1][0]:
            raise ValueError("notches overlap or reach 0")
        points += new
    if points[-1][0] >= 1:
        raise ValueError("a notch reaches Nyquist")
    points.append((1.0, 1))
    return [p[0] for p in points], [p[1] for p in points]


def reflect_pad(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` values on either side by odd reflection; zeros where the signal is too short."""
    k = min(n, len(x) - 1)
    left = 2 * x[0] - x[k:0:-1] if k else x[:0]
    right = 2 * x[-1] - x[-2 : -k - 2 : -1] if k else x[:0]
    zeros = np.zeros(n - k)
    return np.concatenate([zeros, left, x, right, zeros])


def fast_length(n: int) -> int:
    """Least product of powers of 2, 3 and 5 that is at least ``n``: lengths that transform fast."""
    best, five = 1 << max(0, n - 1).bit_length(), 1
    while five < best:
        three = five
        while three < best:
            best = min(best, three << max(0, (-(-n // three) - 1).bit_length()))
            three *= 3
        five *= 5
    return best


def convolve_valid(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """``np.convolve(x, h, "valid")`` for ``len(x) >= len(h)``, by transforms where the kernel is long."""
    if len(h) < 64:
        return np.convolve(x, h, mode="valid")
    size = fast_length(len(x))
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(h, size), size)[len(h) - 1 : len(x)]


def fir_apply(x: np.ndarray, h: np.ndarray, zero_phase: bool = True) -> np.ndarray:
    """Convolution with reflected edges; the output is as long as ``x``, without delay if asked."""
    edge = max(min(len(h), len(x)) - 1, 0)
    padded = reflect_pad(x, edge)
    size = fast_length(len(padded) + len(h) - 1)
    full = np.fft.irfft(np.fft.rfft(padded, size) * np.fft.rfft(h, size), size)
    shift = edge + ((len(h) - 1) // 2 if zero_phase else 0)
    return full[shift : shift + len(x)]


def butter_lowpass(order: int, cutoff: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Butterworth low-pass as second-order sections (bilinear transform); ``cutoff`` in parts of Nyquist."""
    if not 0 < cutoff < 1:
        raise ValueError("the cutoff must lie between 0 and Nyquist")
    warped = math.tan(math.pi * cutoff / 2)
    sections = []
    for k in range(order // 2):
        damp = 2 * math.sin(math.pi * (2 * k + 1) / (2 * order))
        a0 = 1 + damp * warped + warped**2
        sections.append((np.array([1, 2, 1]) * warped**2 / a0, np.array([1, 2 * (warped**2 - 1) / a0, (1 - damp * warped + warped**2) / a0])))
    if order % 2:
        a0 = 1 + warped
        sections.append((np.array([1, 1, 0]) * warped / a0, np.array([1, (warped - 1) / a0, 0])))
    return sections


class Section:
    """A second-order section with its responses, laid out once for blocks of ``size`` samples.

    Within a block the recursion is a product with the section's impulse responses, and
    only two state values pass from block to block.
    """

    size = 256

    def __init__(self, b: np.ndarray, a: np.ndarray):
        self.b, self.a = b, a
        impulse = np.zeros((3, self.size))  # responses to an input, to either state
        for r, (v, s1, s2) in enumerate(((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))):
            for i in range(self.size):
                y = b[0] * v + s1
                s1, s2 = b[1] * v - a[1] * y + s2, b[2] * v - a[2] * y
                impulse[r, i], v = y, 0.0
        lag = np.subtract.outer(np.arange(self.size), np.arange(self.size))
        self.own = np.where(lag >= 0, impulse[0][np.maximum(lag, 0)], 0.0)
        self.states = impulse[1:]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """``x`` filtered, started in the steady state of its first value."""
        b, a, size = self.b, self.a, self.size
        gain = b.sum() / a.sum()
        z2 = (b[2] - a[2] * gain) * x[0]
        z1 = (b[1] - a[1] * gain) * x[0] + z2
        whole = len(x) // size * size
        # all blocks' own parts in one product; states are added block by block
        out = np.empty(len(x))
        out[:whole] = (x[:whole].reshape(-1, size) @ self.own.T).ravel()
        out[whole:] = self.own[: len(x) - whole, : len(x) - whole] @ x[whole:]
        for at in range(0, len(x), size):
            u, y = x[at : at + size], out[at : at + size]
            y += z1 * self.states[0, : len(u)] + z2 * self.states[1, : len(u)]
            # states after the block follow from its last two inputs and outputs
            before = b[2] * u[-2] - a[2] * y[-2] if len(u) > 1 else z2
            z1, z2 = b[1] * u[-1] - a[1] * y[-1] + before, b[2] * u[-1] - a[2] * y[-1]
        return out


def settling(sections: list[tuple[np.ndarray, np.ndarray]], least: float = 1e-18) -> int:
    """Samples after which what came before has faded to ``least`` of it, in all sections together."""
    slowest = max(max(abs(np.roots(a))) for _, a in sections)
    return math.ceil(math.log(least) / math.log(slowest)) + 2 * len(sections)


def edge_length(n_sections: int) -> int:
    """Samples by which a signal is reflected at its ends before it is filtered both ways."""
    return 3 * (2 * n_sections + 1)


def filtfilt(sections: list[Section], x: np.ndarray) -> np.ndarray:
    """Forward and backward through all sections, with odd reflection at the edges."""
    if len(x) < 2:
        return x.copy()
    pad = min(len(x) - 1, edge_length(len(sections)))
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        for section in sections:
            y = section(y)
        y = y[::-1]
    return y[pad : pad + len(x)]


def top_eigenvalues(diag: np.ndarray, off: np.ndarray, k: int, points: int = 64) -> np.ndarray:
    """The ``k`` largest eigenvalues of a symmetric tridiagonal matrix, largest first.

    Each eigenvalue's interval is cut at ``points`` places at once; the signs of the pivots
    of ``T - x`` count the eigenvalues below each place.
    """
    n, squares = len(diag), np.concatenate([[0.0], off**2])
    reach = np.concatenate([np.abs(off), [0.0]]) + np.concatenate([[0.0], np.abs(off)])
    low, high = np.full(k, (diag - reach).min()), np.full(k, (diag + reach).max())
    tiny = np.finfo(float).tiny / np.finfo(float).eps * max(1.0, squares.max())
    wanted = n - np.arange(k)  # so many are below or at it
    while ((high - low) > 4 * np.finfo(float).eps * np.maximum(np.abs(low), np.abs(high))).any():
        at = low[:, None] + (high - low)[:, None] * np.arange(1, points + 1) / (points + 1)
        pivot, below = np.ones_like(at), np.zeros(at.shape, np.int64)
        for d, s in zip(diag, squares, strict=True):
            pivot = d - at - s / pivot
            pivot[np.abs(pivot) < tiny] = -tiny
            below += pivot < 0
        over = below >= wanted[:, None]
        first = np.where(over.any(1), over.argmax(1), points)
        row = np.arange(k)
        new_high = np.where(first < points, at[row, np.minimum(first, points - 1)], high)
        new_low = np.where(first > 0, at[row, np.maximum(first - 1, 0)], low)
        if (new_high - new_low >= high - low).all():
            break
        low, high = new_low, new_high
    return (low + high) / 2


def _solve_tridiagonal(diag: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Solution of a symmetric tridiagonal system by elimination with row exchanges; a pivot of 0 becomes tiny."""
    n = len(diag)
    d, up, up2, y = diag.tolist(), [*off.tolist(), 0.0], [0.0] * n, x.tolist()
    down = off.tolist()
    tiny = np.finfo(float).eps * float(np.abs(diag).max() or 1.0)
    for i in range(n - 1):
        if abs(d[i]) >= abs(down[i]):
            m = down[i] / d[i] if d[i] else 0.0
            d[i + 1] -= m * up[i]
            y[i + 1] -= m * y[i]
        else:
            m = d[i] / down[i]
            d[i], up[i], d[i + 1], up[i + 1], up2[i] = down[i], d[i + 1], up[i] - m * d[i + 1], -m * up[i + 1], up[i + 1]
            y[i], y[i + 1] = y[i + 1], y[i] - m * y[i + 1]
    for i in range(n - 1, -1, -1):
        rest = (up[i] * y[i + 1] if i + 1 < n else 0.0) + (up2[i] * y[i + 2] if i + 2 < n else 0.0)
        y[i] = (y[i] - rest) / (d[i] if abs(d[i]) > tiny else tiny)
    return np.array(y)


def dpss(n: int, nw: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``k`` Slepian tapers (rows, unit energy, first value positive) and their concentrations.

    Eigenvalues by bisection, tapers by inverse iteration, concentrations from the tapers'
    correlations: memory and time grow with ``n * k``.
    """
    i = np.arange(n)
    w, k = nw / n, min(k, n)
    diag = ((n - 1 - 2 * i) / 2.0) ** 2 * np.cos(2 * np.pi * w)
    off = i[1:] * (n - i[1:]) / 2.0
    v = np.zeros((k, n))
    for j, value in enumerate(top_eigenvalues(diag, off, k)):
        # tapers are even and odd by turns; a start of the right symmetry has no part of the neighbours
        x = np.cos(np.pi * j * (i + 0.5) / n)
        for _ in range(3):
            x = _solve_tridiagonal(diag - value, off, x / np.linalg.norm(x))
            x = (x + (-1) ** j * x[::-1]) / 2
            x -= v[:j].T @ (v[:j] @ x)
        v[j] = x / np.linalg.norm(x)
    v = v * np.where(v[:, :1] < 0, -1, 1)
    size = fast_length(2 * n)
    lags = np.fft.irfft(np.abs(np.fft.rfft(v, size)) ** 2, size)[:, :n]
    kernel = np.concatenate([[2 * w], 2 * np.sin(2 * np.pi * w * i[1:]) / (np.pi * i[1:])])
    return v, np.minimum(1.0, lags @ kernel)


def median_bias(n: int) -> float:
    """Expected median over expected mean of ``n`` averaged periodograms; 1 for n < 3."""
    return 1 + sum(1 / (2 * i + 1) - 1 / (2 * i) for i in range(1, (n - 1) // 2 + 1))
