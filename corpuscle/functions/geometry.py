"""Geometry as Column expressions: lower-triangular cells, wrapping, small matrices, quaternions, roots.

A cell has the rows a = (ax, 0, 0), b = (bx, by, 0), c = (cx, cy, cz); a position is a row vector, r = f . cell.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]
CELL = ("ax", "bx", "by", "cx", "cy", "cz")


def vec(prefix: str = "", of: str = "") -> Vec:
    """Columns prefix + x, y, z (of the struct or alias ``of``)."""
    dot = f"{of}." if of else ""
    return tuple(F.col(f"{dot}{prefix}{c}") for c in "xyz")  # type: ignore[return-value]


def cell(prefix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(prefix + c) for c in CELL)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def scaled(a: Vec, k: Column | float) -> Vec:
    return a[0] * k, a[1] * k, a[2] * k


def plus(a: Vec, b: Vec) -> Vec:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def minus(a: Vec, b: Vec) -> Vec:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def lattice(a: Column, b: Column, c: Column, alpha: Column, beta: Column, gamma: Column) -> dict[str, Column]:
    """Lower-triangular cell from lengths and angles in degrees."""
    ca, cb, cg, sg = F.cos(F.radians(alpha)), F.cos(F.radians(beta)), F.cos(F.radians(gamma)), F.sin(F.radians(gamma))
    cy = c * (ca - cb * cg) / sg
    return {"ax": a, "bx": b * cg, "by": b * sg, "cx": c * cb, "cy": cy, "cz": F.sqrt(c * c - (c * cb) * (c * cb) - cy * cy)}


def to_lower_triangular(rows: Sequence[Sequence[float]]) -> tuple[list[float], list[list[float]]]:
    """Lower-triangular cell of three lattice rows, and the rotation (rows) that takes positions to it. Driver-side."""
    import numpy as np

    q, r = np.linalg.qr(np.asarray(rows, float).T)
    sign = np.where(np.diag(r) < 0, -1.0, 1.0)
    low, turn = (r * sign[:, None]).T, (q * sign).T
    return [float(low[i][j]) for i, j in ((0, 0), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2))], turn.tolist()


def volume(h: Sequence[Column]) -> Column:
    return h[0] * h[2] * h[5]


def to_real(f: Vec, h: Sequence[Column]) -> Vec:
    ax, bx, by, cx, cy, cz = h
    return f[0] * ax + f[1] * bx + f[2] * cx, f[1] * by + f[2] * cy, f[2] * cz


def to_fractional(r: Vec, h: Sequence[Column]) -> Vec:
    ax, bx, by, cx, cy, cz = h
    fc = r[2] / cz
    fb = (r[1] - fc * cy) / by
    return (r[0] - fb * bx - fc * cx) / ax, fb, fc


def wrap_fractional(f: Column) -> Column:
    """To [-1/2, 1/2)."""
    return F.pmod(f + 0.5, F.lit(1.0)) - 0.5


def wrap(r: Vec, h: Sequence[Column], periodic: tuple[bool, bool, bool] = (True, True, True)) -> Vec:
    """The image of a vector nearest to the origin, in fractional coordinates."""
    f = to_fractional(r, h)
    return to_real(tuple(wrap_fractional(c) if p else c for c, p in zip(f, periodic, strict=True)), h)  # type: ignore[arg-type]


def perpendicular(h: Sequence[Column]) -> Vec:
    """Distances between opposite faces of the cell."""
    zero = F.lit(0.0)
    a, b, c = (h[0], zero, zero), (h[1], h[2], zero), (h[3], h[4], h[5])
    v = volume(h)
    return v / norm(cross(b, c)), v / norm(cross(c, a)), v / norm(cross(a, b))


def min_multiplicity(h: Sequence[Column], cutoff: Column, periodic: tuple[bool, bool, bool] = (True, True, True)) -> Vec:
    """Copies of the cell along each axis so that the cutoff is at most half of it; 1 where it isn't periodic."""
    return tuple(F.ceil(2 * cutoff / p).cast("int") if on else F.lit(1) for p, on in zip(perpendicular(h), periodic, strict=True))  # type: ignore[return-value]


def det_and_inverse(m: Sequence[Sequence[Column]]) -> tuple[Column, list[list[Column]]]:
    """Determinant and inverse of a 3 x 3 matrix, by cofactors; the inverse of a singular one is null."""
    def minor(i: int, j: int) -> Column:
        (a, b), (c, d) = [[m[r][k] for k in range(3) if k != j] for r in range(3) if r != i]
        return a * d - b * c

    det = m[0][0] * minor(0, 0) - m[0][1] * minor(0, 1) + m[0][2] * minor(0, 2)
    return det, [[F.try_divide(minor(j, i) * (-1) ** (i + j), det) for j in range(3)] for i in range(3)]


def triangular_inverse(h: Sequence[Column]) -> tuple[Column, ...]:
    """Inverse of a lower-triangular cell, as a lower-triangular one."""
    ax, bx, by, cx, cy, cz = h
    return 1 / ax, -bx / (ax * by), 1 / by, (bx * cy - cx * by) / (ax * by * cz), -cy / (by * cz), 1 / cz


def largest_and_smallest_cubic_root(b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """Largest and smallest real root of x^3 + b x^2 + c x + d (one value twice if there is only one)."""
    p, q = c - b * b / 3, 2 * b * b * b / 27 - b * c / 3 + d
    disc = q * q / 4 + p * p * p / 27
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    one = F.cbrt(-q / 2 + root) + F.cbrt(-q / 2 - root)
    m = 2 * F.sqrt(F.greatest(-p / 3, F.lit(0.0)))
    ratio = F.when(m == 0, 0.0).otherwise(3 * q / (F.when(p == 0, -1.0).otherwise(p) * F.when(m == 0, 1.0).otherwise(m)))
    theta = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio))) / 3
    high, low = m * F.cos(theta), m * F.cos(theta + 2 * math.pi / 3)
    return F.when(disc > 0, one).otherwise(high) - b / 3, F.when(disc > 0, one).otherwise(low) - b / 3


def next_higher_power(value: Column, base: float) -> Column:
    """Smallest power of the base that is not less; with a base of 1 or less, the value rounded up."""
    return F.ceil(value).cast("double") if base <= 1 else F.pow(F.lit(float(base)), F.ceil(F.ln(value) / math.log(base)))


# --- quaternions (w, x, y, z) ------------------------------------------------------------------------------------

Quat = tuple[Column, Column, Column, Column]


def quat_random(u1: Column, u2: Column, u3: Column) -> Quat:
    """Uniform rotation from three uniforms."""
    s, t = F.sqrt(1 - u1), F.sqrt(u1)
    return t * F.cos(2 * math.pi * u3), s * F.sin(2 * math.pi * u2), s * F.cos(2 * math.pi * u2), t * F.sin(2 * math.pi * u3)


def quat_multiply(p: Quat, q: Quat) -> Quat:
    return (
        p[0] * q[0] - p[1] * q[1] - p[2] * q[2] - p[3] * q[3], p[0] * q[1] + p[1] * q[0] + p[2] * q[3] - p[3] * q[2],
        p[0] * q[2] - p[1] * q[3] + p[2] * q[0] + p[3] * q[1], p[0] * q[3] + p[1] * q[2] - p[2] * q[1] + p[3] * q[0],
    )


def quat_inverse(q: Quat) -> Quat:
    n = q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3]
    return q[0] / n, -q[1] / n, -q[2] / n, -q[3] / n


def quat_power(q: Quat, k: Column | float) -> Quat:
    """The rotation by k times the (shorter) angle about the same axis."""
    sign = F.when(q[0] < 0, -1.0).otherwise(1.0)
    w, v = q[0] * sign, (q[1] * sign, q[2] * sign, q[3] * sign)
    s = norm(v)
    half = F.atan2(s, w) * k
    ratio = F.when(s == 0, 0.0).otherwise(F.sin(half) / F.when(s == 0, 1.0).otherwise(s))
    return F.cos(half), v[0] * ratio, v[1] * ratio, v[2] * ratio


def quat_matrix(q: Quat) -> list[Vec]:
    w, x, y, z = q
    return [
        (1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)), (2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)),
        (2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)),
    ]


def quat_rotate(q: Quat, v: Vec) -> Vec:
    return tuple(dot(row, v) for row in quat_matrix(q))  # type: ignore[return-value]


# --- counter-based random numbers ---------------------------------------------------------------------------------


def uniform(seed: int, *key: Column | int) -> Column:
    """A uniform in (0, 1) that depends on seed and key alone, however rows are partitioned."""
    h = F.xxhash64(F.lit(seed), *(k if isinstance(k, Column) else F.lit(k) for k in key))
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)


def normal(seed: int, *key: Column | int) -> Column:
    """A standard normal by Box-Muller, from the same counters."""
    return F.sqrt(-2 * F.ln(uniform(seed, 1, *key))) * F.cos(2 * math.pi * uniform(seed, 2, *key))
