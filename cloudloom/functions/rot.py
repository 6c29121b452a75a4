"""Rotations as nine SQL expressions in row order, for columns r00 to r22."""

from __future__ import annotations

from .vec import EPS, Vec, clamp1, dot

Rot = tuple[str, ...]

NAMES = tuple(f"r{i}{j}" for i in range(3) for j in range(3))


def named(alias: str = "") -> Rot:
    return tuple(f"{alias}.{n}" if alias else n for n in NAMES)


def aliased(r: Rot) -> list[str]:
    return [f"{e} AS {n}" for e, n in zip(r, NAMES, strict=True)]


def rows(r: Rot) -> list[Vec]:
    return [r[0:3], r[3:6], r[6:9]]


def columns(r: Rot) -> list[Vec]:
    return [r[0::3], r[1::3], r[2::3]]


def times(a: Rot, b: Rot) -> Rot:
    return tuple(dot(x, y) for x in rows(a) for y in columns(b))


def transpose(r: Rot) -> Rot:
    return tuple(e for c in columns(r) for e in c)


def apply(r: Rot, v: Vec) -> Vec:
    return tuple(dot(x, v) for x in rows(r))


def axis(which: str, angle: str) -> Rot:
    """Rotation by `angle` about x, y or z."""
    c, s = f"cos({angle})", f"sin({angle})"
    return {
        "x": ("1e0", "0e0", "0e0", "0e0", c, f"(-{s})", "0e0", s, c),
        "y": (c, "0e0", s, "0e0", "1e0", "0e0", f"(-{s})", "0e0", c),
        "z": (c, f"(-{s})", "0e0", s, c, "0e0", "0e0", "0e0", "1e0"),
    }[which]


def euler(a: Vec) -> Rot:
    """Rx(a0) (Ry(a1) Rz(a2))."""
    return times(axis("x", a[0]), times(axis("y", a[1]), axis("z", a[2])))


def axis_angle(n: Vec, angle: str) -> Rot:
    """Rotation about the unit axis n: cos I + (1 - cos) n n' + sin [n]x."""
    c, s = f"cos({angle})", f"sin({angle})"
    skew = (("0e0", f"(-{n[2]})", n[1]), (n[2], "0e0", f"(-{n[0]})"), (f"(-{n[1]})", n[0], "0e0"))
    return tuple(
        f"({c if i == j else '0e0'} + (1 - {c}) * {n[i]} * {n[j]} + {s} * {skew[i][j]})" for i in range(3) for j in range(3)
    )


def quat(q: tuple[str, str, str, str]) -> Rot:
    """Rotation of a unit quaternion, w first, in the transposed convention (r01 = 2 (q1 q2 + q3 q0))."""
    w, x, y, z = q
    sq = lambda a: f"{a} * {a}"
    return (
        f"({sq(w)} + {sq(x)} - {sq(y)} - {sq(z)})", f"(2 * ({x} * {y} + {z} * {w}))", f"(2 * ({x} * {z} - {y} * {w}))",
        f"(2 * ({x} * {y} - {z} * {w}))", f"({sq(w)} - {sq(x)} + {sq(y)} - {sq(z)})", f"(2 * ({y} * {z} + {x} * {w}))",
        f"(2 * ({x} * {z} + {y} * {w}))", f"(2 * ({y} * {z} - {x} * {w}))", f"({sq(w)} - {sq(x)} - {sq(y)} + {sq(z)})",
    )


def to_quat(r: Rot) -> tuple[str, str, str, str]:
    """Quaternion (w first, not negative where it leads) of a rotation, in the convention of `quat`.

    Four times the square of each component is a sum of the diagonal; the largest gives the
    divisor, the off-diagonal sums and differences the rest.
    """
    d = [r[0], r[4], r[8]]
    squares = [f"(1 + {d[0]} + {d[1]} + {d[2]})", f"(1 + {d[0]} - {d[1]} - {d[2]})", f"(1 - {d[0]} + {d[1]} - {d[2]})", f"(1 - {d[0]} - {d[1]} + {d[2]})"]
    minus = lambda a, b: f"({r[a]} - {r[b]})"
    plus = lambda a, b: f"({r[a]} + {r[b]})"
    wx, wy, wz = minus(5, 7), minus(6, 2), minus(1, 3)
    xy, xz, yz = plus(1, 3), plus(2, 6), plus(5, 7)
    table = [[squares[0], wx, wy, wz], [wx, squares[1], xy, xz], [wy, xy, squares[2], yz], [wz, xz, yz, squares[3]]]
    lead = [f"{squares[i]} >= greatest({', '.join(squares[j] for j in range(4) if j != i)})" for i in range(3)]
    half = [f"(2 * sqrt(greatest({s}, 1e-30)))" for s in squares]
    return tuple(
        "(CASE " + " ".join(f"WHEN {lead[i]} THEN {table[i][k]} / {half[i]}" for i in range(3)) + f" ELSE {table[3][k]} / {half[3]} END)"
        for k in range(4)
    )


def angle(r: Rot) -> str:
    """Angle of a rotation by its trace; 0 and pi where the trace is within EPS of 3 and -1."""
    t = f"({r[0]} + {r[4]} + {r[8]})"
    return f"(CASE WHEN abs({t} - 3) <= {EPS} THEN 0e0 WHEN abs({t} + 1) <= {EPS} THEN pi() ELSE acos({clamp1(f'(({t} - 1) / 2)')}) END)"


def to_x(n: Vec) -> Rot:
    """Rotation that takes the unit vector n onto +x, without trigonometry; for n = -x half a turn about y."""
    a, b, c = n
    k = f"nullif(1 + {a}, 0)"
    near = (a, b, c, f"(-{b})", f"({a} + {c} * {c} / {k})", f"(-{b} * {c} / {k})", f"(-{c})", f"(-{b} * {c} / {k})", f"({a} + {b} * {b} / {k})")
    back = ("-1e0", "0e0", "0e0", "0e0", "1e0", "0e0", "0e0", "0e0", "-1e0")
    return tuple(f"(CASE WHEN {a} <= -1 + 1e-12 THEN {y} ELSE {x} END)" for x, y in zip(near, back, strict=True))


def to_axis(r: Rot) -> Vec:
    """Axis of a rotation (not at 0 or pi), of unit length."""
    v = (f"({r[7]} - {r[5]})", f"({r[2]} - {r[6]})", f"({r[3]} - {r[1]})")
    n = f"nullif(sqrt({dot(v, v)}), 0)"
    return tuple(f"({x} / {n})" for x in v)
