"""Geometry of points, planes, lines and rotations as column expressions.

Vectors are lists of three columns, quaternions lists of four (real part first). A NULL part makes the result
NULL; directions of length 0 have no normal form and give NULL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = list[Column]


def dot(a: Vector, b: Vector) -> Column:
    parts = [x * y for x, y in zip(a, b)]
    return sum(parts[1:], parts[0])


def cross(a: Vector, b: Vector) -> Vector:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Vector) -> Vector:
    n = F.nullif(norm(a), F.lit(0.0))
    return [x / n for x in a]


def homogeneous(a: Vector) -> Vector:
    return [*a, F.lit(1.0)]


def from_homogeneous(a: Vector) -> Vector:
    w = F.nullif(a[-1], F.lit(0.0))
    return [x / w for x in a[:-1]]


def plane_through(a: Vector, b: Vector, c: Vector) -> list[Column]:
    """Unit normal and offset: dot(normal, p) + offset = 0; NULL if the points are in line."""
    n = normalized(cross([y - x for x, y in zip(a, b)], [y - x for x, y in zip(a, c)]))
    return [*n, -dot(n, a)]


def plane_distance(plane: list[Column], p: Vector) -> Column:
    """Signed distance of a point."""
    return dot(plane[:3], p) + plane[3]


def line_plane(origin: Vector, direction: Vector, plane: list[Column]) -> Vector:
    """Where a line meets a plane; NULL if they are parallel."""
    t = -plane_distance(plane, origin) / F.nullif(dot(plane[:3], direction), F.lit(0.0))
    return [o + t * d for o, d in zip(origin, direction)]


def line_distance(origin: Vector, direction: Vector, p: Vector) -> Column:
    d = normalized(direction)
    return norm(cross([y - x for x, y in zip(origin, p)], d))


def rotate2(angle: Column, x: Column, y: Column) -> Vector:
    return [F.cos(angle) * x - F.sin(angle) * y, F.sin(angle) * x + F.cos(angle) * y]


def from_axis_angle(axis: Vector, angle: Column) -> list[Column]:
    return [F.cos(angle / 2), *(x * F.sin(angle / 2) for x in normalized(axis))]


def from_euler(x: Column, y: Column, z: Column) -> list[Column]:
    """The turn by z about the third, then y about the second, then x about the first own axis."""
    one = lambda k, angle: [F.cos(angle / 2), *(F.sin(angle / 2) if j == k else F.lit(0.0) for j in range(3))]
    return multiply(multiply(one(2, z), one(1, y)), one(0, x))


def multiply(p: list[Column], q: list[Column]) -> list[Column]:
    return [
        p[0] * q[0] - p[1] * q[1] - p[2] * q[2] - p[3] * q[3], p[0] * q[1] + p[1] * q[0] + p[2] * q[3] - p[3] * q[2],
        p[0] * q[2] - p[1] * q[3] + p[2] * q[0] + p[3] * q[1], p[0] * q[3] + p[1] * q[2] - p[2] * q[1] + p[3] * q[0],
    ]


def rotate(q: list[Column], p: Vector) -> Vector:
    """The vector turned by a unit quaternion."""
    inner = [a + q[0] * b for a, b in zip(cross(q[1:], p), p)]
    return [a + 2 * b for a, b in zip(p, cross(q[1:], inner))]


def slerp(p: list[Column], q: list[Column], t: Column) -> list[Column]:
    """Between two unit quaternions along the shorter way; linear where they nearly agree."""
    cos = dot(p, q)
    angle = F.acos(F.least(F.abs(cos), F.lit(1.0)))
    near = angle < 1e-7
    sin = F.when(near, 1.0).otherwise(F.sin(angle))
    a = F.when(near, 1 - t).otherwise(F.sin((1 - t) * angle) / sin)
    b = F.when(near, t).otherwise(F.sin(t * angle) / sin) * F.when(cos < 0, -1.0).otherwise(1.0)
    return [a * x + b * y for x, y in zip(p, q)]


def degrees(radians: Column) -> Column:
    return radians * (180 / math.pi)
