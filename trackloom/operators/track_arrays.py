"""Metrics of a track that need its whole series: hull, fluctuation, spectrum, correlation times, lateral amplitude.

One Arrow group a track after the shuffle that the step windows need anyway; a track is bounded by its recording.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

COLUMNS = ("hull_area", "hull_perimeter", "exploration_ratio", "speed_hurst", "beat_frequency", "beat_power_ratio", "speed_dominant_freq", "dir_autocorr_time", "vel_autocorr_time", "lateral_amplitude")


def hull(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Area and perimeter of the convex hull; NaN for fewer than three points or points on a line."""
    points = sorted(set(zip(x.tolist(), y.tolist(), strict=True)))
    if len(points) < 3:
        return math.nan, math.nan
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    chains = []
    for order in (points, points[::-1]):
        chain: list = []
        for p in order:
            while len(chain) > 1 and cross(chain[-2], chain[-1], p) <= 0:
                chain.pop()
            chain.append(p)
        chains.append(chain[:-1])
    ring = np.array(chains[0] + chains[1])
    following = np.roll(ring, -1, axis=0)
    area = abs((ring[:, 0] * following[:, 1] - ring[:, 1] * following[:, 0]).sum()) / 2
    return (float(area), float(np.hypot(*(following - ring).T).sum())) if len(ring) > 2 and area > 0 else (math.nan, math.nan)


def fluctuation(x: np.ndarray, least: int = 8) -> float:
    """Slope of the logarithm of detrended fluctuation on that of the window, twelve windows up to a quarter."""
    n = len(x)
    if n < 4 * least:
        return math.nan
    y = np.cumsum(x - x.mean())
    sizes = [w for w in np.unique(np.rint(np.geomspace(least, n // 4, 12)).astype(int)) if w >= least]
    if len(sizes) < 4:
        return math.nan
    size, level = [], []
    for w in sizes:
        part = y[: n // w * w].reshape(-1, w)
        t = np.arange(w) - (w - 1) / 2
        part = part - part.mean(1, keepdims=True)
        rest = part - np.outer(part @ t / (t @ t), t)
        f = math.sqrt((rest**2).mean())
        if f > 0:
            size.append(math.log(w))
            level.append(math.log(f))
    return float(np.polyfit(size, level, 1)[0]) if len(size) >= 4 else math.nan


def dominant(x: np.ndarray, rate: float) -> tuple[float, float]:
    """Frequency of the strongest line of the Hann-windowed spectrum without its mean, and the line's share."""
    if len(x) < 16 or not rate > 0 or not np.any(x - x.mean()):
        return math.nan, math.nan
    power = np.abs(np.fft.rfft((x - x.mean()) * np.hanning(len(x)))) ** 2
    power[0] = 0
    k = int(power.argmax())
    return (float(np.fft.rfftfreq(len(x), 1 / rate)[k]), float(power[k] / power.sum())) if power.sum() > 0 else (math.nan, math.nan)


def crossing(c: np.ndarray, dt: float) -> float:
    """Time at which a correlation curve falls below 1/e, interpolated; its length if it never does."""
    below = np.flatnonzero(c < 1 / math.e)
    if not len(below):
        return len(c) * dt
    k = int(below[0])
    return 0.0 if k == 0 else (k - 1 + (c[k - 1] - 1 / math.e) / max(c[k - 1] - c[k], 1e-12)) * dt


def correlation_time(x: np.ndarray, dt: float) -> float:
    n = len(x)
    if n < 8:
        return math.nan
    x = x - x.mean()
    power = float(x @ x)
    return crossing(np.array([x[: n - k] @ x[k:] / power for k in range(max(2, n // 2))]), dt) if power > 0 else math.nan


def heading_time(h: np.ndarray, dt: float) -> float:
    n = len(h)
    return crossing(np.array([np.cos(h[k:] - h[: n - k]).mean() for k in range(max(2, n // 2))]), dt) if n > 8 else math.nan


def lateral(x: np.ndarray, y: np.ndarray) -> float:
    """Root mean square distance from the path smoothed by a moving average that repeats its end points."""
    n = len(x)
    if n < 9:
        return math.nan
    w = max(5, min(n // 3, 31)) | 1

    def smooth(v: np.ndarray) -> np.ndarray:
        s = np.cumsum(np.r_[0, np.pad(v, w // 2, "edge")])
        return (s[w:] - s[:-w]) / w

    return float(np.sqrt(((x - smooth(x)) ** 2 + (y - smooth(y)) ** 2).mean()))


def smoothed(v: np.ndarray, window: int) -> np.ndarray:
    """Savitzky-Golay of order two; the ends take the polynomial of the first and last window."""
    w = window | 1
    if window < 5 or len(v) <= window:
        return v
    t = np.arange(w) - w // 2
    fit = np.linalg.pinv(np.vander(t, 3, increasing=True))
    out = v.astype(float).copy()
    out[w // 2 : len(v) - w // 2] = np.lib.stride_tricks.sliding_window_view(v, w) @ fit[0]
    for part, at in ((v[:w], slice(0, w // 2)), (v[-w:], slice(len(v) - w // 2, len(v)))):
        curve = np.vander(t, 3, increasing=True) @ (fit @ part)
        out[at] = curve[: w // 2] if at.start == 0 else curve[-(w // 2) :]
    return out


def smooth(spots: DataFrame, window: int) -> DataFrame:
    """spots with smoothed x and y, a track at a time, ordered by t, of equal times by x and y; spots itself for windows under five."""
    if window < 5:
        return spots

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("t", "x", "y")])
        for c in ("x", "y"):
            t = t.set_column(t.schema.get_field_index(c), t.schema.field(c), pa.array(smoothed(t[c].to_numpy(), window), t.schema.field(c).type))
        return t

    return spots.groupBy("uid").applyInArrow(one, spots.schema)


def of_track(t: pa.Table) -> pa.Table:
    t = t.sort_by("i")
    c = {k: t[k].to_numpy() for k in ("x", "y", "dt", "speed", "heading", "ang_vel")}
    good = lambda k: c[k][np.isfinite(c[k])]
    gaps = c["dt"][1:]
    dt = float(np.median(gaps)) if len(gaps) else math.nan
    rate = 1 / dt if dt > 0 else math.nan
    area, around = hull(c["x"], c["y"])
    spread = float(c["x"].var() + c["y"].var())
    beat = dominant(good("ang_vel"), rate)
    known = dt > 0
    values = (area, around, area / (math.pi * spread) if spread > 0 else math.nan, fluctuation(good("speed")), *beat, dominant(good("speed"), rate)[0], heading_time(good("heading"), dt) if known else math.nan, correlation_time(good("speed"), dt) if known else math.nan, lateral(c["x"], c["y"]))
    return pa.table({"uid": t["uid"].slice(0, 1), **{k: pa.array([v if math.isfinite(v) else None], pa.float64()) for k, v in zip(COLUMNS, values, strict=True)}})


def series_metrics(steps: DataFrame) -> DataFrame:
    """uid and COLUMNS of every track of kinematics() rows."""
    return steps.select("uid", "i", "x", "y", "dt", "speed", "heading", "ang_vel").groupBy("uid").applyInArrow(of_track, "uid string, " + ", ".join(f"{c} double" for c in COLUMNS))
