"""Sizes and error bounds of the sketches."""

from __future__ import annotations

import math


def cms_size(epsilon: float, delta: float) -> tuple[int, int]:
    """Width and depth of a Count-Min sketch that over-counts by more than epsilon * N with a probability of at most delta."""
    if not (0 < epsilon < 1 and 0 < delta < 1):
        raise ValueError("epsilon and delta must lie between 0 and 1")
    return math.ceil(math.e / epsilon), math.ceil(math.log(1 / delta))


def cms_bounds(width: int, depth: int) -> tuple[float, float]:
    return math.e / width, math.exp(-depth)


def hll_alpha(m: int) -> float:
    """Bias constants for 16, 32 and 64 registers, and the formula above."""
    return {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))


def hll_precision(p: int) -> int:
    """The number of registers; p is 4 to 18."""
    if not 4 <= p <= 18:
        raise ValueError("p must be 4 to 18")
    return 1 << p


def hll_error(p: int) -> float:
    return 1.04 / math.sqrt(hll_precision(p))
