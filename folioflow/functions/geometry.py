"""Points, polygons and boxes as array columns."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

Point = Sequence[float]


def polygon_box(polygon: Column) -> Column:
    """[x0, y0, x1, y1] of an array of points; NULL for an empty one."""
    xs, ys = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    return F.when(F.size(polygon) > 0, F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def box_polygon(box: Column) -> Column:
    x0, y0, x1, y1 = (box[i] for i in range(4))
    return F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1))


def clip(polygon: Column, width: Column, height: Column) -> Column:
    return F.transform(polygon, lambda p: F.array(F.greatest(F.lit(0.0), F.least(width, p[0])), F.greatest(F.lit(0.0), F.least(height, p[1]))))


def clip_box(box: Column, width: Column, height: Column) -> Column:
    """The box within the page; NULL where nothing is left."""
    b = F.array(*[F.greatest(F.lit(0.0), F.least(width if i % 2 == 0 else height, box[i])) for i in range(4)])
    return F.when((b[2] > b[0]) & (b[3] > b[1]), b)


def area(polygon: Column) -> Column:
    """Shoelace area of a simple polygon."""
    nxt = F.concat(F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0))), F.slice(polygon, 1, 1))
    cross = F.zip_with(polygon, nxt, lambda p, q: p[0] * q[1] - q[0] * p[1])
    return F.when(F.size(polygon) >= 3, F.abs(F.aggregate(cross, F.lit(0.0), lambda a, x: a + x)) / 2).otherwise(0.0)


def box_iou(a: Column, b: Column) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    size = lambda x: F.greatest(F.lit(0.0), x[2] - x[0]) * F.greatest(F.lit(0.0), x[3] - x[1])
    return F.coalesce(F.try_divide(w * h, size(a) + size(b) - w * h), F.lit(0.0))


def rotation(width: Column, height: Column, angle: Column) -> Column:
    """Forward and inverse 3x3 matrices and the canvas size of a counter-clockwise turn.

    The y axis points down; the canvas is enlarged so that the turned page
    lies in it from (0, 0) on.  The inverse of a rigid motion is closed-form.
    """
    r = F.radians(F.pmod(angle, F.lit(360.0)))
    c, s = F.cos(r), F.sin(r)
    w, h = width.cast("double"), height.cast("double")
    half = lambda a, b: (F.abs(a) * w + F.abs(b) * h) / 2
    ex, ey = half(c, s), half(s, c)
    tx, ty = ex - (c * w + s * h) / 2, ey - (-s * w + c * h) / 2
    one, zero = F.lit(1.0), F.lit(0.0)
    return F.struct(
        F.array(F.array(c, s, tx), F.array(-s, c, ty), F.array(zero, zero, one)).alias("forward"),
        F.array(F.array(c, -s, -(c * tx - s * ty)), F.array(s, c, -(s * tx + c * ty)), F.array(zero, zero, one)).alias("inverse"),
        F.greatest(F.lit(1), F.ceil(2 * ex - 1e-9)).cast("int").alias("width"), F.greatest(F.lit(1), F.ceil(2 * ey - 1e-9)).cast("int").alias("height"),
    )


def apply(matrix: Column, polygon: Column) -> Column:
    """Points through a 3x3 matrix in homogeneous coordinates."""
    row = lambda p, i: matrix[i][0] * p[0] + matrix[i][1] * p[1] + matrix[i][2]
    return F.transform(polygon, lambda p: F.array(row(p, 0) / row(p, 2), row(p, 1) / row(p, 2)))


def to_thousand(box: Column, width: Column, height: Column) -> Column:
    """Box in thousandths of the page, rounded half-even; an error where it leaves the page."""
    bad = (box[0] < 0) | (box[1] < 0) | (box[2] > width) | (box[3] > height) | (box[2] < box[0]) | (box[3] < box[1])
    scaled = F.array(*[F.least(F.lit(1000), F.greatest(F.lit(0), F.rint(box[i] * 1000 / (width if i % 2 == 0 else height)).cast("int"))) for i in range(4)])
    return F.when(bad, F.raise_error(F.lit("box outside its page")).cast("array<int>")).otherwise(scaled)


def tiles(width: Column, height: Column, columns: int = 2, rows: int = 2, overlap: float = 0.15) -> Column:
    """Overlapping tiles that cover the page: array of (index, row, column, x0, y0, x1, y1)."""
    bw, bh = F.ceil(width / columns), F.ceil(height / rows)
    ox, oy = F.rint(bw * overlap).cast("bigint"), F.rint(bh * overlap).cast("bigint")
    cells = []
    for r in range(rows):
        for c in range(columns):
            x0, y0 = bw * c - (ox if c else 0), bh * r - (oy if r else 0)
            x1, y1 = F.least(width, bw * (c + 1)) + (ox if c < columns - 1 else 0), F.least(height, bh * (r + 1)) + (oy if r < rows - 1 else 0)
            cells.append(F.struct(F.lit(r * columns + c).alias("tile"), F.lit(r).alias("tile_row"), F.lit(c).alias("tile_column"), F.greatest(F.lit(0), x0).cast("bigint").alias("x0"), F.greatest(F.lit(0), y0).cast("bigint").alias("y0"), F.least(width, x1).cast("bigint").alias("x1"), F.least(height, y1).cast("bigint").alias("y1")))
    return F.array(*cells)


def resample(values: Column, bins: int) -> Column:
    """Linear interpolation of an array to ``bins`` points."""
    n = F.size(values)

    def at(i: Column) -> Column:
        x = i * (n - 1) / F.lit(float(max(1, bins - 1)))
        lo = F.least(F.floor(x), F.lit(n - 1)).cast("int")
        hi = F.least(lo + 1, n - 1)
        return F.element_at(values, lo + 1) + (F.element_at(values, hi + 1) - F.element_at(values, lo + 1)) * (x - lo)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), at))


def entropy(values: Column) -> Column:
    """Shannon entropy of non-negative weights as a share of its maximum."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.greatest(x, F.lit(0.0)))
    p = F.filter(F.transform(values, lambda x: F.greatest(x, F.lit(0.0)) / total), lambda x: x > 0)
    h = F.aggregate(p, F.lit(0.0), lambda a, x: a - x * F.log2(x))
    return F.when((total > 0) & (F.size(values) > 1), h / F.log2(F.size(values))).otherwise(0.0)


# --- convex polygons: half-plane clipping, for Arrow kernels ---------------------
def signed_area(p: Sequence[Point]) -> float:
    return sum(p[i - 1][0] * p[i][1] - p[i][0] * p[i - 1][1] for i in range(len(p))) / 2


def convex_intersection(a: Sequence[Point], b: Sequence[Point]) -> float:
    """Area common to two convex polygons."""
    region = [(float(x), float(y)) for x, y in a]
    knife = [(float(x), float(y)) for x, y in b]
    if signed_area(knife) < 0:
        knife.reverse()
    for (ax, ay), (bx, by) in zip(knife, knife[1:] + knife[:1]):
        side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in region]
        cut = []
        for i, (p, s) in enumerate(zip(region, side)):
            q, t = region[i - 1], side[i - 1]
            if (s >= 0) != (t >= 0):
                k = t / (t - s)
                cut.append((q[0] + k * (p[0] - q[0]), q[1] + k * (p[1] - q[1])))
            if s >= 0:
                cut.append(p)
        region = cut
        if len(region) < 3:
            return 0.0
    return abs(signed_area(region))


def convex_iou(a: Sequence[Point] | None, b: Sequence[Point] | None) -> float:
    if a is None or b is None or len(a) < 3 or len(b) < 3:
        return 0.0
    common = convex_intersection(a, b)
    whole = abs(signed_area(a)) + abs(signed_area(b)) - common
    return common / whole if whole > 0 else 0.0


@F.pandas_udf(T.DoubleType())
def polygon_iou(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([convex_iou(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.BooleanType())
def crosses_itself(polygon: pd.Series) -> pd.Series:
    """Do two sides that aren't neighbours cross properly?"""

    def turn(p, q, r):
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    def one(p):
        n = 0 if p is None else len(p)
        for i in range(n):
            for j in range(i + 2, n - (i == 0)):
                a, b, c, d = p[i], p[(i + 1) % n], p[j], p[(j + 1) % n]
                if turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0:
                    return True
        return False

    return polygon.map(one)
