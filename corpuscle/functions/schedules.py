"""Schedules: Column expressions of a step."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Schedule = Callable[[Column], Column]


def constant(value: float) -> Schedule:
    return lambda step: F.lit(float(value))


def increment(start: float = 0.0, by: float = 1.0) -> Schedule:
    return lambda step: start + by * step


def linear(start: float, end: float, total: int) -> Schedule:
    """From start to end over ``total`` steps, then end."""
    return lambda step: start + (end - start) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), step / float(total)))


def exponential(start: float, rate: float, lower: float = float("-inf"), upper: float = float("inf")) -> Schedule:
    """start rate^step, kept between the bounds."""
    return lambda step: F.greatest(F.lit(lower), F.least(F.lit(upper), start * F.pow(F.lit(float(rate)), step)))


def cosine(lowest: float, highest: float, total: int) -> Schedule:
    """From highest to lowest along half a cosine, then lowest."""
    return lambda step: lowest + 0.5 * (highest - lowest) * (1 + F.cos(math.pi * F.least(F.lit(1.0), F.greatest(F.lit(0.0), step / float(total)))))


def steps(at: Sequence[float], values: Sequence[float]) -> Schedule:
    """Value of the last boundary that is not beyond the step; the first before all."""
    def f(step: Column) -> Column:
        out = F.lit(float(values[0]))
        for a, v in zip(at, values, strict=True):
            out = F.when(step >= a, float(v)).otherwise(out)
        return out

    return f


def composed(first: Schedule, second: Schedule, transition: float) -> Schedule:
    """The first before ``transition``, then the second from its own beginning."""
    return lambda step: F.when(step < transition, first(step)).otherwise(second(step - transition))
