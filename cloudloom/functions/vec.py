"""Three-component vectors as SQL expression text, for selectExpr, spark.sql and DuckDB alike.

A vector is a triple of expressions; `vec("n")` names the columns nx, ny, nz. Every
division is guarded, so rows that a later predicate removes can't raise.
"""

from __future__ import annotations

from collections.abc import Sequence

Vec = tuple[str, str, str]

#: Below this norm a vector isn't normalised.
EPS = "1.1920929e-7"


def vec(prefix: str) -> Vec:
    return (f"{prefix}x", f"{prefix}y", f"{prefix}z")


def of(alias: str, prefix: str = "") -> Vec:
    return (f"{alias}.{prefix}x", f"{alias}.{prefix}y", f"{alias}.{prefix}z")


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(f"({x} - {y})" for x, y in zip(a, b, strict=True))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(f"({x} + {y})" for x, y in zip(a, b, strict=True))


def scale(a: Vec, k: str) -> Vec:
    return tuple(f"({x} * {k})" for x in a)


def dot(a: Vec, b: Vec) -> str:
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b, strict=True)) + ")"


def cross(a: Vec, b: Vec) -> Vec:
    return tuple(f"({a[i]} * {b[j]} - {a[j]} * {b[i]})" for i, j in ((1, 2), (2, 0), (0, 1)))


def norm2(a: Vec) -> str:
    return dot(a, a)


def norm(a: Vec) -> str:
    return f"sqrt({norm2(a)})"


def unit(a: Vec) -> Vec:
    """The vector over its norm, or itself where the norm is at most EPS."""
    n = norm(a)
    return tuple(f"(CASE WHEN {n} > {EPS} THEN {x} / nullif({n}, 0) ELSE {x} END)" for x in a)


def clamp1(x: str) -> str:
    return f"greatest(-1e0, least(1e0, {x}))"


def angle(a: Vec, b: Vec) -> str:
    """Angle between unit vectors, clamped against rounding."""
    return f"acos({clamp1(dot(a, b))})"


def angle_atan2(a: Vec, b: Vec) -> str:
    """The same angle for vectors of any length, precise near 0 and pi."""
    return f"atan2({norm(cross(a, b))}, {dot(a, b)})"


def flip(n: Vec, p: Vec, view: Vec) -> Vec:
    """Normals that look away from the viewpoint, turned round."""
    away = dot(sub(view, p), n)
    return tuple(f"(CASE WHEN {away} < 0 THEN -{x} ELSE {x} END)" for x in n)


def dist_l1(a: Vec, b: Vec) -> str:
    return "(" + " + ".join(f"abs({x} - {y})" for x, y in zip(a, b, strict=True)) + ")"


def dist_so2(a: str, b: str) -> str:
    """Signed difference b - a of two angles, wrapped once into [-pi, pi]."""
    d = f"({b} - {a})"
    return f"(CASE WHEN {d} > pi() THEN {d} - 2 * pi() WHEN {d} < -pi() THEN {d} + 2 * pi() ELSE {d} END)"


def dist_so3(a: Sequence[str], b: Sequence[str]) -> str:
    """Sum of the squared differences of two rotations' quaternion components, as they stand."""
    return "(" + " + ".join(f"({x} - {y}) * ({x} - {y})" for x, y in zip(a, b, strict=True)) + ")"


def angle_so3(a: Sequence[str], b: Sequence[str]) -> str:
    """Angle between two rotations given as unit quaternions."""
    d = "abs(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b, strict=True)) + ")"
    return f"(2 * acos(least(1e0, {d})))"


def fixed(x: str, digits: int = 6) -> str:
    """A whole number of 10**-digits: sums of these don't depend on their order."""
    return f"cast(floor(({x}) * 1e{digits} + 0.5) AS bigint)"


def shrink(h: str, p: str, mu: str, steps: int = 3) -> str:
    """Proximal value of |z|^p + mu/2 |z - h|^2 as a factor of h, by a fixed number of fixed-point steps.

    Zero under the threshold (2/mu (1-p))^(1/(2-p)) + p/mu (2/mu (1-p))^((p-1)/(2-p)).
    """
    alpha = f"power(2e0 / {mu} * (1 - {p}), 1e0 / (2 - {p}))"
    least = f"({alpha} + {p} / {mu} * power({alpha}, {p} - 1))"
    beta = f"(({alpha} / nullif({h}, 0) + 1) / 2)"
    for _ in range(steps):
        beta = f"(1 - {p} / {mu} * power({h}, {p} - 2) * power({beta}, {p} - 1))"
    return f"(CASE WHEN {h} > {least} THEN {beta} ELSE 0e0 END)"
