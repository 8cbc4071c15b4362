"""Speed models over a window of motion features: a linear one, and forward passes of GRU and dilated convolution networks."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np

from driftframe.schema import model_features

LOGVAR = (-6.0, 6.0)


def _softplus(x: float) -> float:
    return max(x, 0.0) + math.log1p(math.exp(-abs(x)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def gru(x: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """Last hidden state of a gated recurrent unit over rows of x; gates stacked as reset, update, new, with two biases."""
    h = np.zeros(w["hh"].shape[1])
    n = len(h)
    inputs = x @ w["ih"].T + w["b_ih"]
    for row in inputs:
        own = w["hh"] @ h + w["b_hh"]
        reset, update = _sigmoid(row[:n] + own[:n]), _sigmoid(row[n : 2 * n] + own[n : 2 * n])
        new = np.tanh(row[2 * n :] + reset * own[2 * n :])
        h = (1 - update) * new + update * h
    return h


def tcn(x: np.ndarray, layers: list[dict[str, np.ndarray]]) -> np.ndarray:
    """Last row of causal convolutions (kernel (out, in, width)) with dilation 1, 2, 4, ..., ReLU, and a shortcut of equal width."""
    for depth, layer in enumerate(layers):
        k, step = layer["kernel"], 2**depth
        width = k.shape[2]
        padded = np.vstack([np.zeros(((width - 1) * step, x.shape[1])), x])
        y = sum(padded[i * step : i * step + len(x)] @ k[:, :, i].T for i in range(width)) + layer["bias"]
        y = np.maximum(y, 0.0)
        x = y + x if y.shape == x.shape else y
    return x[-1]


@dataclass
class SpeedModel:
    """kind: linear, gru or tcn. predict() gives speed and its standard deviation for one window (rows, features), oldest first."""

    kind: str
    weights: dict
    features: list[str]
    window: int
    mean: np.ndarray
    std: np.ndarray
    sigma_scale: float = 1.0
    about: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        model_features(self.features)

    def _head(self, h: np.ndarray) -> tuple[float, float]:
        w = self.weights["head"]
        for layer in w[:-1]:
            h = np.maximum(layer["kernel"] @ h + layer["bias"], 0.0)
        speed, logvar = w[-1]["kernel"] @ h + w[-1]["bias"]
        return _softplus(float(speed)), math.exp(0.5 * min(max(float(logvar), LOGVAR[0]), LOGVAR[1]))

    def predict(self, rows: np.ndarray) -> tuple[float, float]:
        rows = np.asarray(rows, float)
        if rows.shape != (self.window, len(self.features)):
            raise ValueError(f"a window is {(self.window, len(self.features))}, not {rows.shape}")
        x = (rows - self.mean) / self.std
        if self.kind == "linear":
            speed, sigma = max(float(summary(x) @ self.weights["coef"] + self.weights["intercept"]), 0.0), self.weights["sigma"]
        else:
            h = gru(x, self.weights["gru"]) if self.kind == "gru" else tcn(x, self.weights["tcn"])
            speed, sigma = self._head(h)
        return speed, sigma * self.sigma_scale

    def batch(self, windows: np.ndarray) -> np.ndarray:
        """Rows of (speed, sigma)."""
        return np.array([self.predict(w) for w in windows]).reshape(-1, 2)

    def to_json(self) -> str:
        plain = lambda v: v.tolist() if isinstance(v, np.ndarray) else {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else [plain(x) for x in v] if isinstance(v, list) else v
        return json.dumps({k: plain(getattr(self, k)) for k in ("kind", "weights", "features", "window", "mean", "std", "sigma_scale", "about")})

    @staticmethod
    def from_json(text: str) -> SpeedModel:
        d = json.loads(text)
        arrays = lambda v: {k: arrays(x) for k, x in v.items()} if isinstance(v, dict) else [arrays(x) for x in v] if isinstance(v, list) and v and isinstance(v[0], dict) else np.array(v) if isinstance(v, list) else v
        d["weights"], d["mean"], d["std"] = arrays(d["weights"]), np.array(d["mean"]), np.array(d["std"])
        return SpeedModel(**d)

    @property
    def size(self) -> int:
        """Number of parameters."""
        count = lambda v: v.size if isinstance(v, np.ndarray) else sum(map(count, v.values())) if isinstance(v, dict) else sum(map(count, v)) if isinstance(v, list) else 1
        return count(self.weights)


def summary(x: np.ndarray) -> np.ndarray:
    """Mean, deviation and last row of a window: what the linear model sees."""
    return np.concatenate([x.mean(0), x.std(0), x[-1]])
