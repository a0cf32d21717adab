"""Column functions: places and ids, digits, 3 x 3 algebra, percentages and rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = list[list[Column]]


def div(a: Column, b: int) -> Column:
    """Whole division of numbers that aren't negative."""
    return F.floor(a / b).cast("long") if b & (b - 1) else F.shiftright(a, b.bit_length() - 1)


def point_id(x: Column, y: Column, z: Column, nx: int, ny: int, nz: int) -> Column:
    """x + nx y + nx ny z, or -1 outside."""
    outside = (x < 0) | (x >= nx) | (y < 0) | (y >= ny) | (z < 0) | (z >= nz)
    return F.when(outside, -1).otherwise(x + nx * y + nx * ny * z).cast("long")


def digit(value: Column, shift: int, bits: int = 2) -> Column:
    return F.shiftright(value, shift).bitwiseAND((1 << bits) - 1)


def lattice_coords(ix: Column, iy: Column, iz: Column, nx: int, ny: int, nz: int) -> tuple[Column, Column, Column]:
    """Unit-cube coordinates of nodes of nx x ny x nz cells."""
    return ix / nx, iy / ny, iz / nz


def running_coords(node: Column, nx: int, ny: int, nz: int) -> tuple[Column, Column, Column]:
    """Coordinates whose y and z run on within a line and a plane: they carry the remainder of the id, not its floor."""
    a, plane = nx + 1, (nx + 1) * (ny + 1)
    return (node % a) / nx, (node % plane) / a / ny, node / plane / nz


def det3(m: Matrix) -> Column:
    minor = lambda c, d: m[1][c] * m[2][d] - m[1][d] * m[2][c]
    return m[0][0] * minor(1, 2) - m[0][1] * minor(0, 2) + m[0][2] * minor(0, 1)


def inverse3(m: Matrix) -> tuple[Matrix, Column]:
    """The inverse and the determinant, in closed form."""
    det = det3(m)

    def cofactor(r: int, c: int) -> Column:
        (a, b), (p, q) = ([x for x in range(3) if x != r], [x for x in range(3) if x != c])
        return (m[a][p] * m[b][q] - m[a][q] * m[b][p]) * (-1) ** (r + c)

    return [[cofactor(c, r) / det for c in range(3)] for r in range(3)], det


def matmul3(a: Matrix, b: Matrix) -> Matrix:
    return [[a[r][0] * b[0][c] + a[r][1] * b[1][c] + a[r][2] * b[2][c] for c in range(len(b[0]))] for r in range(3)]


def transpose3(m: Matrix) -> Matrix:
    return [list(c) for c in zip(*m, strict=True)]


def percent_off(value: Column, mean: Column) -> Column:
    """Distance from the mean in percent of it; -1 where the mean is 0."""
    return F.when(mean == 0, -1.0).otherwise(F.abs(value - mean) / F.nullif(mean, F.lit(0.0)) * 100)


def gigabytes_per_second(values: Column, width: int, seconds: Column) -> Column:
    return values * width / float(1 << 30) / seconds


def gflops(flops: Column, seconds: Column) -> Column:
    return flops / float(1 << 30) / seconds


def mflops(flops: Column, seconds: Column) -> Column:
    """Millions a second, as text: ``inf`` for times too short to measure."""
    return F.when(seconds <= 1e-4, "inf").otherwise((flops / 1e6 / seconds).cast("string"))
