"""A proximal master: minimise c.x + t + weight |x - ref|^2 over a box, where t lies on or above every given tangent.

Active-set steps in x alone: one active tangent stands for t, further ones and bounds only narrow the directions that are left, so
a step is the projection of the steepest descent onto them and no matrix is larger than the number of parameters.
"""

from __future__ import annotations

import numpy as np

#: Steps of less than this share of the numbers at hand count as none, and multipliers that small as zero.
SMALL = 1e-12


def proximal(c: np.ndarray, lower: np.ndarray, upper: np.ndarray, g: np.ndarray, h: np.ndarray, ref: np.ndarray, weight: float, start: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """x, t, a multiplier for each tangent ``t >= g_i.x + h_i`` (they sum to 1) and reduced costs of x (zero off its bounds)."""
    n = len(c)
    x = np.clip(start, lower, upper)
    v = g @ x + h
    tangents, side = [int(v.argmax())], np.zeros(n, int)  # side: -1 held at lower, 1 at upper, 2 can't move
    side[lower == upper] = 2
    t, idle = float(v.max()), 0
    for _ in range(200 * (n + len(h)) + 1000):
        free = side == 0
        first, others = g[tangents[0]], g[tangents[1:]] - g[tangents[0]]
        slope = c + 2 * weight * (x - ref) + first
        mu = np.linalg.lstsq(others[:, free].T, slope[free], rcond=None)[0] if len(others) and free.any() else np.zeros(len(others))
        step = np.zeros(n)
        step[free] = -(slope[free] - others[:, free].T @ mu) / (2 * weight)
        size = np.abs(slope).max(initial=1.0) / (2 * weight) + np.abs(x).max(initial=1.0)
        if np.abs(step).max(initial=0.0) <= SMALL * size:
            share = np.append(1 + mu.sum(), -mu)
            cost = slope - others.T @ mu
            # What may be let go: tangents with a share below zero, bounds that push outwards.
            wrong = np.concatenate([-share if len(share) > 1 else np.zeros(1), np.where(side == -1, -cost, np.where(side == 1, cost, 0.0))])
            wrong /= np.concatenate([np.ones(len(share)), np.full(n, np.abs(slope).max(initial=1.0))])
            if wrong.max() <= SMALL * 100:
                out = np.zeros(len(h))
                out[tangents] = np.maximum(share, 0.0)
                return x, t, out / out.sum(), np.where(side == 0, 0.0, cost)
            worst = int(np.flatnonzero(wrong > SMALL * 100)[0]) if idle > 2 * n + 20 else int(wrong.argmax())
            if worst < len(share):
                tangents.pop(worst)
            else:
                side[worst - len(share)] = 0
            continue
        rise = float(first @ step)
        with np.errstate(divide="ignore", invalid="ignore"):
            room = np.where(step > 0, (upper - x) / step, np.where(step < 0, (lower - x) / step, np.inf))
            steeper = g @ step - rise
            steeper[tangents] = 0.0
            above = np.where(steeper > SMALL * max(1.0, abs(rise)), np.maximum(t - g @ x - h, 0.0) / steeper, np.inf)
        room[~free] = np.inf
        far = min(1.0, float(room.min(initial=np.inf)), float(above.min(initial=np.inf)))
        idle = idle + 1 if far <= SMALL else 0
        if far < 1.0 and room.min(initial=np.inf) <= far:
            k = int(room.argmin())
            side[k] = 1 if step[k] > 0 else -1
        elif far < 1.0:
            tangents.append(int(above.argmin()))
        x = np.clip(x + far * step, lower, upper)
        x[side == -1], x[side == 1] = lower[side == -1], upper[side == 1]
        t = float((g[tangents] @ x + h[tangents]).max())
    raise ArithmeticError("no end of active-set steps")
