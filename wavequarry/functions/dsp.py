"""Filters without SciPy: Butterworth design, recursion, zero-phase filtering, resampling."""

from __future__ import annotations

import numpy as np


def _roots(low: float, high: float, rate: float, order: int, stop: bool) -> tuple[np.ndarray, np.ndarray, float]:
    """Zeros, poles and gain of a digital Butterworth band-pass, or band-stop, of twice ``order`` poles.

    The analogue low-pass poles are moved to the band, whose edges are warped,
    and mapped to the unit disc by the bilinear transform.
    """
    warped = 2 * np.tan(np.pi * np.array([low, high]) / rate)
    centre, width = np.sqrt(warped[0] * warped[1]), warped[1] - warped[0]
    k = np.arange(1, order + 1)
    poles = np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))
    half = (width / poles if stop else width * poles) / 2
    root = np.sqrt(half**2 - centre**2)
    poles = np.concatenate([half + root, half - root])
    zeros = np.concatenate([np.full(order, 1j * centre), np.full(order, -1j * centre)]) if stop else np.zeros(order)
    gain = 1.0 if stop else width**order
    gain *= np.prod(2 - zeros + 0j).real if stop else np.prod(2 - zeros)
    gain = (gain / np.prod(2 - poles)).real
    to_disc = lambda s: (2 + s) / (2 - s)
    return np.concatenate([to_disc(zeros), -np.ones(len(poles) - len(zeros))]), to_disc(poles), gain


def butterworth(low: float, high: float, rate: float, order: int = 4, stop: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a digital Butterworth band-pass, or band-stop, of twice ``order`` poles."""
    zeros, poles, gain = _roots(low, high, rate, order, stop)
    return (gain * np.poly(zeros)).real, np.poly(poles).real


def butterworth_sections(low: float, high: float, rate: float, order: int = 4, stop: bool = False) -> np.ndarray:
    """The same filter as ``order`` filters of two poles, one after another: rows b0, b1, b2, a1, a2."""
    zeros, poles, gain = _roots(low, high, rate, order, stop)
    real = np.sort(poles[np.abs(poles.imag) < 1e-12].real)
    pairs = [(p, p.conjugate()) for p in poles[poles.imag >= 1e-12]] + list(zip(real[::2], real[1::2]))
    top = np.poly([zeros[0], zeros[0].conjugate()] if stop else [1.0, -1.0]).real * gain ** (1 / order)
    return np.array([[*top, *np.poly(p).real[1:]] for p in pairs])


def notch(frequency: float, rate: float, quality: float = 30.0, order: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Band-stop of width frequency / quality."""
    half = frequency / quality / 2
    return butterworth(frequency - half, frequency + half, rate, order, stop=True)


def steady_state(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Filter state after an endless input of ones."""
    n = max(len(a), len(b))
    b, a = (np.pad(x / a[0], (0, n - len(x))) for x in (b, a))
    system = np.eye(n - 1) - np.vstack([-a[1:], np.eye(n - 1)[:-1]]).T
    return np.linalg.solve(system, b[1:] - a[1:] * b[0])


def run_filter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Causal filtering (transposed direct form II) of x (samples, ...); returns the output and the state to go on from."""
    n = max(len(a), len(b))
    b, a = (np.pad(v / a[0], (0, n - len(v))) for v in (b, a))
    state = np.zeros((n - 1, *x.shape[1:])) if state is None else state.copy()
    shape = (-1,) + (1,) * (x.ndim - 1)
    b_, a_ = b[1:].reshape(shape), a[1:].reshape(shape)
    out = np.empty(x.shape)
    for t, v in enumerate(x):
        out[t] = b[0] * v + state[0]
        state[:-1] = state[1:]
        state[-1] = 0
        state += b_ * v - a_ * out[t]
    return out, state


class Recursion:
    """A recursive filter as an affine map: a stretch of samples takes state z to ``power(len) @ z + after(samples)``.

    So stretches can be filtered at once when their maps are composed first.
    Within a stretch CHUNK samples at a time go through matrices: the response
    to the samples and that to the state. The state is that of a cascade of
    filters of two poles; powers of the matrix of a single long recursion lose
    too many digits.
    """

    CHUNK = 64

    def __init__(self, sections: np.ndarray):
        n = 2 * len(sections)
        self.edge = 3 * (n + 1)
        self.matrix, self.input, self.output, self.direct = np.zeros((n, n)), np.zeros(n), np.zeros(n), 1.0
        for k, (b0, b1, b2, a1, a2) in enumerate(sections):
            here = slice(2 * k, 2 * k + 2)
            gain = np.array([b1 - a1 * b0, b2 - a2 * b0])  # what this section's state takes from the output of those before
            self.matrix[here] = np.outer(gain, self.output)
            self.matrix[here, here] = [[-a1, 1.0], [-a2, 0.0]]
            self.input[here] = gain * self.direct
            self.output = b0 * self.output
            self.output[2 * k] = 1.0
            self.direct *= b0
        self.steady = np.linalg.solve(np.eye(n) - self.matrix, self.input)
        states = [np.eye(n)]
        for _ in range(self.CHUNK):
            states.append(self.matrix @ states[-1])
        self.powers = np.array(states)
        self.from_state = self.output @ self.powers[: self.CHUNK]
        impulse = np.concatenate([[self.direct], self.from_state[:-1] @ self.input])
        lag = np.subtract.outer(np.arange(self.CHUNK), np.arange(self.CHUNK))
        self.from_input = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)
        self.into_state = (self.powers[: self.CHUNK] @ self.input)[::-1].T

    def power(self, length: int) -> np.ndarray:
        """What ``length`` samples of nothing make of a state."""
        return np.linalg.matrix_power(self.matrix, length)

    def run(self, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Output over samples x (samples, or samples by channels) and the state after them, from ``state`` or from rest."""
        if x.ndim == 1:
            out, after = self.run(x[:, None], None if state is None else np.asarray(state, float)[:, None])
            return out[:, 0], after[:, 0]
        state = np.zeros((len(self.matrix), x.shape[1])) if state is None else np.asarray(state, float)
        whole = len(x) // self.CHUNK * self.CHUNK
        parts = x[:whole].reshape(-1, self.CHUNK, x.shape[1])
        pushed, states = self.into_state @ parts, np.empty((len(parts), *state.shape))
        for k, add in enumerate(pushed):
            states[k] = state
            state = self.powers[-1] @ state + add
        out = [(self.from_input @ parts + self.from_state @ states).reshape(whole, x.shape[1])]
        if rest := len(x) - whole:
            tail = x[whole:]
            out.append(self.from_input[:rest, :rest] @ tail + self.from_state[:rest] @ state)
            state = self.powers[rest] @ state + self.into_state[:, -rest:] @ tail
        return np.concatenate(out), state

    def settled(self, sample: np.ndarray) -> np.ndarray:
        """The state after an endless input of ``sample``."""
        return np.multiply.outer(self.steady, sample)


def extended(x: np.ndarray, edge: int, left: bool = True, right: bool = True) -> np.ndarray:
    """x with ``edge`` samples more at its ends, turned about the end samples."""
    head = 2 * x[0] - x[edge:0:-1] if left else x[:0]
    tail = 2 * x[-1] - x[-2 : -edge - 2 : -1] if right else x[:0]
    return np.concatenate([head, x, tail])


def line_notches(rate: float, lines: tuple[float, ...] = (50.0, 60.0), quality: float | None = 30.0, half_width: float = 1.0) -> list[np.ndarray]:
    """Sections of notches at the mains' frequencies that lie below half the rate: of width line / ``quality``, or ``half_width`` to each side if that is None."""
    half = lambda f: f / quality / 2 if quality else half_width
    return [butterworth_sections(f - half(f), f + half(f), rate, 2, stop=True) for f in lines if f + half(f) < rate / 2]


def cleaning_chain(rate: float, low: float = 1.0, high: float = 30.0, quality: float | None = 30.0) -> list[np.ndarray]:
    """The notches, then the band: sections of what a recording goes through without phase shift."""
    return [*line_notches(rate, quality=quality), butterworth_sections(low, high, rate)]


def zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Filtered forwards and backwards, with odd extensions of three filter lengths and steady initial states.

    Series shorter than the extension are extended as far as they go.
    """
    edge = min(3 * max(len(a), len(b)), len(x) - 1)
    if edge < 1:
        return x.astype(float)
    padded = extended(x, edge)
    start = steady_state(b, a).reshape((-1,) + (1,) * (x.ndim - 1))
    for _ in range(2):
        padded = run_filter(b, a, padded, start * padded[0])[0][::-1]
    return padded[edge : edge + len(x)]


def resample(x: np.ndarray, n: int) -> np.ndarray:
    """x (samples, ...) at n samples, through its spectrum, cut or padded with zeros."""
    spectrum = np.fft.rfft(x, axis=0)
    m = min(len(x), n)
    kept = np.zeros((n // 2 + 1, *x.shape[1:]), complex)
    kept[: m // 2 + 1] = spectrum[: m // 2 + 1]
    if m % 2 == 0 and len(x) != n:
        kept[m // 2] *= 2 if n < len(x) else 0.5  # the bin at half the rate stands for two
    return np.fft.irfft(kept, n, axis=0) * n / len(x)


def welch(x: np.ndarray, rate: float, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and one-sided power density: Hann windows of ``segment`` samples, half overlapping, each without its mean."""
    segment = min(segment, len(x))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(segment) / segment)
    starts = range(0, len(x) - segment + 1, max(1, segment - segment // 2))
    parts = np.array([x[s : s + segment] for s in starts])
    parts = (parts - parts.mean(1, keepdims=True)) * window
    power = (np.abs(np.fft.rfft(parts, axis=1)) ** 2).mean(0) / (rate * (window**2).sum())
    power[1 : -1 if segment % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(segment, 1 / rate), power
