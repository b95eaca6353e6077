"""Brute force on small fixtures, in plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter


def dist(a, b) -> float:
    dx, dy = a[0] - b[0], a[1] - b[1]
    return math.sqrt(dx * dx + dy * dy)


def pairs(left, right, radius) -> Counter:
    """Rows are (id, x, y); the result is a bag of (left id, right id)."""
    return Counter(
        (a[0], b[0])
        for a in left if None not in a
        for b in right if None not in b
        if dist(a[1:], b[1:]) < radius
    )


def nearest(points, centre, k, farthest=False):
    known = [(dist(p[1:], centre), p[0]) for p in points if None not in p]
    known.sort(key=lambda t: (-t[0] if farthest else t[0], t[1]))
    return known[:k]


def scattered(n: int, seed: int, hot_share: float = 0.0, hot=(10.0, 20.0), span: float = 20.0):
    """Points with ids; a share of them are copies of one point."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rng.random() < hot_share:
            rows.append((i, *hot))
        else:
            rows.append((i, rng.uniform(0, span), rng.uniform(0, span)))
    return rows
