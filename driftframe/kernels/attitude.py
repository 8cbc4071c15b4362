"""Rotations, and the tracked direction of gravity."""

from __future__ import annotations

import math

import numpy as np

Triple = tuple[float, float, float]


def unit(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, float)
    return v / math.sqrt(float(v @ v))


def rotation_to_up(v: np.ndarray) -> np.ndarray:
    """The least rotation that takes a direction to +z; straight down turns half a turn about x."""
    x, y, z = unit(v)
    if z <= -1.0 + 1e-15 or x * x + y * y < 1e-18:
        return np.eye(3) if z > 0 else np.diag([1.0, -1.0, -1.0])
    k = 1.0 / (1.0 + z)
    return np.array([[1 - x * x * k, -x * y * k, -x], [-x * y * k, 1 - y * y * k, -y], [x, y, z]])


def rotation_between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least rotation from one direction to another, as two reflections; opposite ones count as parallel."""
    a, b = unit(a), unit(b)
    middle = a + b
    if np.linalg.norm(np.cross(a, b)) < 1e-9:
        return np.eye(3)
    middle = unit(middle)
    # reflecting first at a, then at what lies half-way, turns a into b within their plane
    mirror = lambda m: np.eye(3) - 2.0 * np.outer(m, m)
    return mirror(middle) @ mirror(a)


def about_z(angle: float) -> np.ndarray:
    c, s = math.cos(angle), math.sin(angle)
    return np.array([[c, -s, 0.0], [s, c, 0.0], [0.0, 0.0, 1.0]])


def level_all(rows: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Each row turned by the least rotation that takes its own up to +z: rotation_to_up() of all rows at once."""
    flat = np.hypot(up[:, 0], up[:, 1]) < 1e-9
    k = np.where(up[:, 2] <= -1.0 + 1e-15, 0.0, 1.0 / np.maximum(1.0 + up[:, 2], 1e-15))
    along = (rows * up).sum(1)
    side = (rows[:, 0] * up[:, 0] + rows[:, 1] * up[:, 1]) * k + rows[:, 2]
    out = np.column_stack([rows[:, 0] - up[:, 0] * side, rows[:, 1] - up[:, 1] * side, along])
    down = flat & (up[:, 2] < 0)
    out[flat] = rows[flat]
    out[down] = rows[down] * np.array([1.0, -1.0, -1.0])
    return out


def unlevel(u: Triple, east: float, north: float) -> Triple:
    """A level vector (east, north, 0) in the frame in which up is u: rotation_to_up(u) undone."""
    x, y, z = u
    if z <= -1.0 + 1e-15 or x * x + y * y < 1e-18:
        return (east, north, 0.0) if z > 0 else (east, -north, 0.0)
    side = (x * east + y * north) / (1.0 + z)
    return east - x * side, north - y * side, -(x * east + y * north)


class Gravity:
    """Direction of gravity in the phone frame, in plain numbers: carried by the gyro (if used), drawn toward the accelerometer while that
    is quiet. A sample counts if its part across the present estimate is under the gate and its length is within three gates of
    gravity; the vehicle's own acceleration, if known, is taken off first."""

    def __init__(self, up: np.ndarray, gravity: float, pre: dict, gyro_bias: np.ndarray | None = None):
        self.u: Triple = tuple(unit(up).tolist())
        self.bias: Triple = (0.0, 0.0, 0.0) if gyro_bias is None else tuple(np.asarray(gyro_bias, float).tolist())
        self.gravity, self.gate, self.tau, self.use_gyro = float(gravity), pre["attitude_acc_gate"], pre["attitude_tau_s"], pre["attitude_use_gyro"]

    @property
    def up(self) -> np.ndarray:
        return np.array(self.u)

    @up.setter
    def up(self, value: np.ndarray) -> None:
        self.u = tuple(np.asarray(value, float).tolist())

    def follow(self, acc: Triple, gyro: Triple, dt: float, own: Triple = (0.0, 0.0, 0.0)) -> Triple:
        """The direction after one more sample."""
        if dt <= 0:
            return self.u
        x, y, z = self.u
        if self.use_gyro:
            p, q, r = gyro[0] - self.bias[0], gyro[1] - self.bias[1], gyro[2] - self.bias[2]
            x, y, z = x + dt * (r * y - q * z), y + dt * (p * z - r * x), z + dt * (q * x - p * y)
        a, b, c = acc[0] - own[0], acc[1] - own[1], acc[2] - own[2]
        force = math.sqrt(a * a + b * b + c * c)
        if force > 0 and abs(force - self.gravity) < 3 * self.gate:
            along = (a * x + b * y + c * z) / math.sqrt(x * x + y * y + z * z)
            if math.sqrt(max(force * force - along * along, 0.0)) < self.gate:
                pull = min(dt / self.tau, 1.0)
                x, y, z = x + pull * (a / force - x), y + pull * (b / force - y), z + pull * (c / force - z)
        size = math.sqrt(x * x + y * y + z * z)
        self.u = (x / size, y / size, z / size)
        return self.u


class OwnMotion:
    """The vehicle's own acceleration, from its speed (NaN: unknown) and turn rate: forward as a smoothed derivative, sideways as v times the rate."""

    def __init__(self):
        self.before, self.gain = math.nan, 0.0

    def forward(self, speed: float, dt: float) -> float | None:
        known = speed == speed
        if known and self.before == self.before and dt > 0:
            self.gain += min(dt, 1.0) * ((speed - self.before) / dt - self.gain)
        self.before = speed
        return self.gain if known else None
