"""Draws of how many tables the customers of a dish take in a Pitman-Yor restaurant.

Given the tables of all other dishes, `c` customers of a dish sit at `t` tables with weight
parent ** t * strength (strength + d) ... (strength + d (t - 1)) * S(c, t), where `strength`
holds those other tables, d is the discount and S(c, t) sums the seatings at t tables. A draw
from it is what endless Gibbs moves of each single customer of the dish would give, so it
seats all of them anew in one step, whatever their number.

Up to DIRECT customers S comes from its recurrence. Above, it is a coefficient of a power
series, (c! / t! d ** t) [z ** c] (1 - (1 - z) ** d) ** t, found by quadrature through the
saddle point, on a parabola around the cut or, far from it, on a circle; weights are computed at POINTS places of the window that matters
and interpolated between them.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

DIRECT = 1024
CELLS = 1 << 18  # weights computed at a time
NODES = 24
POINTS = 25
STAGES = 4  # each narrows the window until it holds only what matters
LEAST = 30.0  # log weights this far below the largest do not matter


@lru_cache(maxsize=4)
def log_seatings(discount: float) -> np.ndarray:
    """log S(c, t) in row c and column t - 1, for c up to DIRECT."""
    found = np.full((DIRECT + 1, DIRECT), -np.inf)
    found[1, 0] = 0.0
    for c in range(1, DIRECT):
        t = np.arange(1, c + 1)
        found[c + 1, :c] = found[c, :c] + np.log(c - discount * t)
        found[c + 1, 1 : c + 1] = np.logaddexp(found[c + 1, 1 : c + 1], found[c, :c])
    return found


@lru_cache(maxsize=4)
def saddles(discount: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Customers per table (ascending) of saddle points, their logs, and the curvature per table times the square."""
    log_u = np.linspace(np.log(1e-14), np.log(30.0), 6000)
    u = np.exp(log_u)
    v = -np.expm1(-u)
    ratio = discount * v ** (discount - 1) * np.exp(-u) / -np.expm1(discount * np.log(v))
    curve = -u * np.gradient(ratio, log_u)
    return ratio[::-1], log_u[::-1], np.maximum(curve[::-1], 1e-300)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series ten places further up."""
    shift = sum(np.log(x + i) for i in range(10))
    x = x + 10
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 / 12 - (1 / 360 - 1 / 1260 / x**2) / x**2) / x - shift


def log_coefficient(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """log [z ** c] (1 - (1 - z) ** d) ** t."""
    ratio, log_u, curve = saddles(discount)
    at = np.interp(c / t, ratio, log_u)
    u = np.maximum(np.exp(at), 6 / c)
    spread = np.maximum(t * np.interp(np.log(u), log_u[::-1], curve[::-1]), 1e-12)
    circle = u > 1
    step = np.where(circle, np.minimum(np.pi / NODES, 0.3 * u / np.sqrt(spread)), np.minimum(1 / 8, 0.3 / np.sqrt(spread)))
    s = step[..., None] * (np.arange(NODES) + 0.5)
    turn = np.where(circle[..., None], 1, 1 + 1j * s)
    path = np.where(circle[..., None], u[..., None] + 1j * s, u[..., None] * turn**2)
    log_f = t[..., None] * np.log(1 - np.exp(discount * np.log(1 - np.exp(-path)))) + c[..., None] * path
    top = log_f.real.max(axis=-1)
    total = (np.exp(log_f - top[..., None]) * turn).real.sum(axis=-1)
    inner = np.log(np.maximum(total, 1e-300)) + top + np.log(np.where(circle, 1, 2 * u) * step / np.pi)
    return np.where(t >= c, c * np.log(discount), inner)


def few(customers: int, strength: np.ndarray, parent: np.ndarray, discount: float, chance: np.ndarray) -> np.ndarray:
    t = np.arange(customers)
    weight = np.log(strength[:, None] + discount * t)
    weight += np.log(parent)[:, None]
    np.cumsum(weight, axis=1, out=weight)
    weight += log_seatings(discount)[customers, :customers]
    weight -= weight.max(axis=1, keepdims=True)
    np.cumsum(np.exp(weight, out=weight), axis=1, out=weight)
    return np.minimum((weight <= chance[:, None] * weight[:, -1:]).sum(axis=1) + 1, customers)


def many(customers: np.ndarray, strength: np.ndarray, parent: np.ndarray, discount: float, chance: np.ndarray) -> np.ndarray:
    c = customers.astype(float)[:, None]
    low, high = np.zeros(len(customers)), np.log(c[:, 0])  # in logs at first, as the scale is unknown
    rank = np.arange(POINTS)
    for stage in range(STAGES):
        t = low[:, None] + (high - low)[:, None] * rank / (POINTS - 1)
        t = np.minimum(np.exp(t), c) if stage == 0 else t
        start = strength[:, None] / discount
        weight = t * np.log(parent)[:, None] + log_gamma(start + t) - log_gamma(start) - log_gamma(t + 1) + log_coefficient(np.broadcast_to(c, t.shape), t, discount)
        if stage < STAGES - 1:
            matters = weight > weight.max(axis=1, keepdims=True) - LEAST
            first = np.maximum(matters.argmax(axis=1) - 1, 0)
            last = np.minimum(POINTS - matters[:, ::-1].argmax(axis=1), POINTS - 1)
            row = np.arange(len(t))
            low, high = t[row, first], np.maximum(t[row, last], t[row, first] + 1e-9)
    bend = np.zeros_like(weight)
    bend[:, 1:-1] = weight[:, 2:] - 2 * weight[:, 1:-1] + weight[:, :-2]
    bend[:, 0], bend[:, -1] = bend[:, 1], bend[:, -2]
    drawn = np.empty(len(customers), dtype=np.int64)
    for i in range(len(customers)):
        whole = np.arange(np.ceil(low[i] - 1e-6), np.floor(high[i] + 1e-6) + 1)
        at = np.clip((whole - low[i]) / (high[i] - low[i]) * (POINTS - 1), 0, POINTS - 1)
        part = at - np.floor(at)
        log_weight = np.interp(at, rank, weight[i]) - 0.5 * part * (1 - part) * np.interp(at, rank, bend[i])
        sums = np.cumsum(np.exp(log_weight - log_weight.max()))
        drawn[i] = whole[min(np.searchsorted(sums, chance[i] * sums[-1], side="right"), len(whole) - 1)]
    return drawn


def drawn_tables(customers: np.ndarray, strength: np.ndarray, parent: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish; `strength` is that of the restaurant plus the discount for each table of its other dishes."""
    tables = np.ones(len(customers), dtype=np.int64)
    chance = rng.random(len(customers))
    order = np.argsort(customers, kind="stable")
    ordered = customers[order]
    start, end = np.searchsorted(ordered, 2), np.searchsorted(ordered, DIRECT, side="right")
    borders = start + np.flatnonzero(np.diff(ordered[start:end], prepend=-1))
    for a, b in zip(borders, np.append(borders, end)[1:], strict=True):
        size = int(ordered[a])
        rows = max(1, CELLS // size)
        for i in range(a, b, rows):
            some = order[i : min(i + rows, b)]
            tables[some] = few(size, strength[some], parent[some], discount, chance[some])
    rows = max(1, CELLS // (NODES * POINTS))
    for i in range(end, len(order), rows):
        some = order[i : i + rows]
        tables[some] = many(customers[some], strength[some], parent[some], discount, chance[some])
    return tables
