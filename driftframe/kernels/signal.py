"""Second-order low-pass filters: causal with carried state, and forward-backward for calibration."""

from __future__ import annotations

import numpy as np

from driftframe.operators.features import biquad

#: Samples added at both ends before filtering forward and backward, mirrored through the end point.
PAD = 9


class LowPass:
    """Causal Butterworth low-pass of several channels, primed so that a constant passes unchanged from the first row."""

    def __init__(self, cutoff_hz: float, rate_hz: float):
        self.c = biquad(cutoff_hz, rate_hz)
        self.z: np.ndarray | None = None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        b0, b1, b2, a1, a2 = self.c
        if self.z is None:
            z2 = (b2 - a2) * x
            self.z = np.stack([(b1 - a1) * x + z2, z2])
        z1, z2 = self.z
        y = b0 * x + z1
        self.z = np.stack([b1 * x - a1 * y + z2, b2 * x - a2 * y])
        return y

    def block(self, x: np.ndarray) -> np.ndarray:
        """All rows of a block, one after the other."""
        out = np.empty_like(x, dtype=float)
        for i, row in enumerate(x):
            out[i] = self(row)
        return out


def _run(x: np.ndarray, c: tuple[float, ...]) -> np.ndarray:
    b0, b1, b2, a1, a2 = c
    z2 = (b2 - a2) * x[0]
    z1 = (b1 - a1) * x[0] + z2
    out = np.empty(len(x))
    for i, v in enumerate(x.tolist()):
        y = b0 * v + z1
        z1, z2 = b1 * v - a1 * y + z2, b2 * v - a2 * y
        out[i] = y
    return out


def smooth(x: np.ndarray, rate_hz: float, cutoff_hz: float = 0.5) -> np.ndarray:
    """Forward-backward low-pass without phase shift; signals under 30 samples stay as they are."""
    if len(x) < 30:
        return x
    c = biquad(cutoff_hz, rate_hz)
    ends = np.concatenate([2 * x[0] - x[PAD:0:-1], x, 2 * x[-1] - x[-2 : -PAD - 2 : -1]])
    back = _run(_run(ends, c)[::-1], c)[::-1]
    return back[PAD:-PAD]
