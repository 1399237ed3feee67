"""Keyed sequences: folds over a key's rows in time order, in batch form. The state classes also serve the streaming twins.

Rows that are older than their key's last one are refused in streams and sorted in batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class LowPass:
    """First-order low-pass with its rate: exact for a held input."""

    def __init__(self, tau: float) -> None:
        self.tau, self.time, self.value = tau, None, None

    def step(self, time: float, x: float) -> tuple[float, float]:
        if self.time is None:
            self.time, self.value = time, x
            return x, 0.0
        share = 1 - math.exp(-(time - self.time) / self.tau)
        self.time, self.value = time, self.value + share * (x - self.value)
        return self.value, (x - self.value) / self.tau


class WheelSpeed:
    """Median consensus of the channels' newest packets, with expiry and a standstill rule."""

    def __init__(self, expiry: float, spread: float, still: float) -> None:
        self.expiry, self.spread, self.still, self.newest = expiry, spread, still, {}

    def step(self, time: float, channel: str, value: float) -> tuple[float | None, int]:
        self.newest[channel] = (time, value)
        self.newest = {c: p for c, p in self.newest.items() if time - p[0] <= self.expiry}
        values = sorted(v for _, v in self.newest.values())
        n = len(values)
        middle = (values[(n - 1) // 2] + values[n // 2]) / 2
        if n == 2 and values[1] - values[0] > 2 * self.spread:
            return None, 0
        kept = [v for v in values if abs(v - middle) <= self.spread] if n >= 3 else values
        speed = sum(kept) / len(kept) if kept else None
        if speed is not None and all(abs(v) <= 1e-6 * self.still for v in values):
            speed = 0.0
        return speed, len(kept)


class Horizon:
    """The newest sources of a key: at most ``most``, none older than ``age``; a new segment clears them. A second source of the same time takes the place of the first."""

    def __init__(self, most: int, age: float) -> None:
        self.most, self.age, self.held, self.segment = most, age, [], None

    def step(self, time: float, value: float, segment: int) -> tuple[int, float, bool]:
        if segment != self.segment:
            self.held, self.segment = [], segment
        if self.held and time < self.held[-1][0]:
            raise ValueError("time must not fall")
        self.held = [(t, v) for t, v in self.held if time - t <= self.age and t < time][-(self.most - 1) :] if self.most > 1 else []
        self.held.append((time, value))
        return len(self.held), sum(v for _, v in self.held) / len(self.held), len(self.held) >= 2


class PlanarObserver:
    """x, speed and bias with scalar gains: predicts at every row, corrects by position rows ("view") and speed rows ("click")."""

    def __init__(self, gain_x: float = 0.3, gain_v: float = 0.2, decay: float = 3600.0) -> None:
        self.gx, self.gv, self.decay, self.time, self.x, self.v = gain_x, gain_v, decay, None, 0.0, 0.0

    def step(self, time: float, kind: str, value: float) -> tuple[float, float]:
        if self.time is not None:
            dt = time - self.time
            hold = math.exp(-dt / self.decay)
            self.x += self.v * self.decay * (1 - hold)
            self.v *= hold
        self.time = time
        if kind == "view":
            self.x += self.gx * (value - self.x)
        elif kind == "click":
            self.v += self.gv * (value / 3600 - self.v)
        return self.x, self.v


class KalmanTrack:
    """Iterated extended Kalman filter of a planar track: state (x, y, heading, speed), ranges to the origin and headings as measurements."""

    def __init__(self, spread: float = 1.0, rounds: int = 2) -> None:
        self.x, self.p, self.time, self.spread, self.rounds = np.array([1.0, 0.0, 0.0, 0.0]), np.eye(4) * 100.0, None, spread, rounds

    def predict(self, dt: float) -> None:
        x, y, h, v = self.x
        self.x = np.array([x + v * dt * math.cos(h), y + v * dt * math.sin(h), h, v])
        f = np.eye(4)
        f[0, 2], f[0, 3], f[1, 2], f[1, 3] = -v * dt * math.sin(h), dt * math.cos(h), v * dt * math.cos(h), dt * math.sin(h)
        self.p = f @ self.p @ f.T + np.diag([1e-4, 1e-4, 1e-3, 1e-2]) * dt

    def correct(self, kind: str, value: float) -> None:
        prior, at = self.x, self.x.copy()
        for _ in range(self.rounds):
            if kind == "range":
                r = max(1e-6, math.hypot(at[0], at[1]))
                h, seen = np.array([at[0] / r, at[1] / r, 0.0, 0.0]), r
                error = value - seen - h @ (prior - at)
            else:
                h = np.array([0.0, 0.0, 1.0, 0.0])
                error = math.atan2(math.sin(value - prior[2]), math.cos(value - prior[2]))
            gain = self.p @ h / (h @ self.p @ h + self.spread**2)
            at = prior + gain * error
        keep = np.eye(4) - np.outer(gain, h)
        self.x, self.p = at, keep @ self.p @ keep.T + np.outer(gain, gain) * self.spread**2

    def step(self, time: float, kind: str, value: float) -> tuple[float, float, float, float]:
        if self.time is not None:
            self.predict(time - self.time)
        self.time = time
        self.correct(kind, value)
        return tuple(map(float, self.x))


def fold(df: DataFrame, key: str, order: list[str], start: Callable, step: Callable, columns: str) -> DataFrame:
    """One row out for each row in: step(state, row) of the key's rows in order. Rows of one key are one drive's, a bounded sequence."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        state = start()
        rows = group.sort_values(order, kind="stable")
        out = pd.DataFrame([step(state, r) for r in rows.itertuples(index=False)], columns=names)
        out.insert(0, "event_id", rows["event_id"].to_numpy())
        out.insert(0, key, rows[key].to_numpy())
        return out

    return df.groupBy(key).applyInPandas(run, f"{key} long, event_id long, {columns}")


def low_pass(df: DataFrame, key: str, time: str, value: str, tau: float) -> DataFrame:
    return fold(df, key, [time, "event_id"], lambda: LowPass(tau), lambda s, r: s.step(getattr(r, time), getattr(r, value)), "filtered double, rate double")


def filtered_speed(df: DataFrame, key: str, time: str, channel: str, value: str, expiry: float, still: float, spread: float) -> DataFrame:
    return fold(df, key, [time, "event_id"], lambda: WheelSpeed(expiry, spread, still), lambda s, r: s.step(getattr(r, time), getattr(r, channel), getattr(r, value)), "speed double, used long")


def horizon(df: DataFrame, key: str, time: str, value: str, most: int, age: float) -> DataFrame:
    return fold(df, key, [time, "event_id"], lambda: Horizon(most, age), lambda s, r: s.step(getattr(r, time), getattr(r, value), int(getattr(r, time) // 864000)), "sources long, pooled double, emits boolean")


def observe(df: DataFrame, key: str, time: str, kind: str, value: str) -> DataFrame:
    return fold(df, key, [time, "event_id"], PlanarObserver, lambda s, r: s.step(getattr(r, time), getattr(r, kind), getattr(r, value)), "x double, v double")


def track(df: DataFrame, key: str, time: str, kind: str, value: str, spread: float) -> DataFrame:
    return fold(df, key, [time, "event_id"], lambda: KalmanTrack(spread), lambda s, r: s.step(getattr(r, time), getattr(r, kind), getattr(r, value)), "x double, y double, heading double, speed double")
