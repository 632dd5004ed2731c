"""Column expressions for points, poses, voxels, descriptors, losses and schedules.

Poses are arrays of 16 doubles, row-major, camera to world. All of it stays inside generated code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def total(xs) -> Column:
    return reduce(lambda a, b: a + b, list(xs))


def xyz(prefix: str = "") -> Vec:
    return F.col(f"{prefix}x"), F.col(f"{prefix}y"), F.col(f"{prefix}z")


def dot(a, b) -> Column:
    return total(p * q for p, q in zip(a, b, strict=True))


def sub(a, b) -> Vec:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm2(a) -> Column:
    return dot(a, a)


# --- descriptors ---


def sq_l2(a: Column, b: Column) -> Column:
    """Squared distance of two arrays, summed in double; empty arrays give 0."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(sq_l2(a, b))


def tdf_transform(d: Column, margin: float) -> Column:
    """1 at distance 0, falling to 0 at the margin and beyond."""
    return 1 - F.least(d, F.lit(float(margin))) / float(margin)


def trunc_similarity(d: Column, limit: float = 0.25) -> Column:
    return tdf_transform(d, limit)


# --- camera ---


def backproject(u: Column, v: Column, depth: Column, k: Vec | tuple, pixel_offset: float = 0.0) -> Vec:
    fx, fy, cx, cy = k
    return (u + pixel_offset - cx) * depth / fx, (v + pixel_offset - cy) * depth / fy, depth


def project(p: Vec, k: tuple, pixel_offset: float = 0.0) -> tuple[Column, Column]:
    """Pixel, rounded half away from zero; null where the point isn't in front."""
    fx, fy, cx, cy = k
    z = F.when(p[2] > 0, p[2])
    return F.round(fx * p[0] / z + cx - pixel_offset), F.round(fy * p[1] / z + cy - pixel_offset)


def transform(pose: Column, p: Vec) -> Vec:
    """R p + t."""
    return tuple(pose[4 * i] * p[0] + pose[4 * i + 1] * p[1] + pose[4 * i + 2] * p[2] + pose[4 * i + 3] for i in range(3))


def inverse_transform(pose: Column, p: Vec) -> Vec:
    """R' (p - t), for an orthonormal R."""
    d = [p[i] - pose[4 * i + 3] for i in range(3)]
    return tuple(pose[i] * d[0] + pose[4 + i] * d[1] + pose[8 + i] * d[2] for i in range(3))


def matmul4(a: Column, b: Column) -> Column:
    return F.array(*[total(a[4 * i + k] * b[4 * k + j] for k in range(4)) for i in range(4) for j in range(4)])


def rigid_inverse(pose: Column) -> Column:
    rows = []
    for i in range(3):
        rows += [pose[i], pose[4 + i], pose[8 + i], -(pose[i] * pose[3] + pose[4 + i] * pose[7] + pose[8 + i] * pose[11])]
    return F.array(*rows, *[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])


def determinant3(m: Column) -> Column:
    return m[0] * (m[5] * m[10] - m[6] * m[9]) - m[1] * (m[4] * m[10] - m[6] * m[8]) + m[2] * (m[4] * m[9] - m[5] * m[8])


def affine_inverse(m: Column) -> Column:
    """Inverse of any affine 4x4; null where it is singular."""
    det = determinant3(m)
    g = lambda i, j: m[4 * i + j]
    cof = [[g((j + 1) % 3, (i + 1) % 3) * g((j + 2) % 3, (i + 2) % 3) - g((j + 1) % 3, (i + 2) % 3) * g((j + 2) % 3, (i + 1) % 3) for j in range(3)] for i in range(3)]
    out = []
    for i in range(3):
        row = [c / det for c in cof[i]]
        out += [*row, -(row[0] * m[3] + row[1] * m[7] + row[2] * m[11])]
    return F.when(det != 0, F.array(*out, *[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)]))


def relative_pose(base: Column, pose: Column) -> Column:
    return matmul4(rigid_inverse(base), pose)


def valid_pose(pose: Column) -> Column:
    return ~F.exists(pose, lambda x: F.isnan(x) | x.isNull())


def quaternion_to_matrix(w: Column, x: Column, y: Column, z: Column) -> list[Column]:
    """Nine entries, row-major, of a unit quaternion's rotation."""
    return [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]


def matrix_to_quaternion(pose: Column) -> tuple[Column, Column, Column, Column]:
    """(w, x, y, z) with w >= 0 of any rotation: the largest component comes from the diagonal, the others are divided by it."""
    a, b, c = pose[0], pose[5], pose[10]
    squares = [1 + a + b + c, 1 + a - b - c, 1 - a + b - c, 1 - a - b + c]  # of w, x, y, z, four times
    half = [F.sqrt(F.greatest(F.lit(0.0), q)) / 2 for q in squares]
    wx, wy, wz = pose[9] - pose[6], pose[2] - pose[8], pose[4] - pose[1]
    xy, xz, yz = pose[1] + pose[4], pose[2] + pose[8], pose[6] + pose[9]
    part = lambda v, h: F.try_divide(v, 4 * h)
    rows = [
        (half[0], part(wx, half[0]), part(wy, half[0]), part(wz, half[0])),
        (part(wx, half[1]), half[1], part(xy, half[1]), part(xz, half[1])),
        (part(wy, half[2]), part(xy, half[2]), half[2], part(yz, half[2])),
        (part(wz, half[3]), part(xz, half[3]), part(yz, half[3]), half[3]),
    ]
    top = F.greatest(*squares)
    out = []
    for k in range(4):
        value, sign = F.lit(None).cast("double"), F.lit(None).cast("double")
        for row, square in reversed(list(zip(rows, squares, strict=True))):
            value, sign = F.when(square == top, row[k]).otherwise(value), F.when(square == top, F.when(row[0] < 0, -1.0).otherwise(1.0)).otherwise(sign)
        out.append(value * sign)
    return tuple(out)


def euler_zyx(pose: Column) -> Vec:
    """Degrees about z, y and x."""
    return F.degrees(F.atan2(pose[4], pose[0])), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -pose[8])))), F.degrees(F.atan2(pose[9], pose[10]))


def fold_symmetry(error: Column, symmetry: Column) -> Column:
    """Rotation error under a symmetry of 90, 180 or 360 degrees about its axis."""
    e = F.abs(error)
    quarter = F.abs(e - 90)
    return F.when(symmetry == 360, F.lit(0.0)).when(symmetry == 180, F.least(e, 180 - e)).when(symmetry == 90, F.least(quarter, 90 - quarter)).otherwise(e)


# --- voxels ---


def voxel_index(p: Vec, origin: Vec | tuple, size: float) -> Vec:
    return tuple(F.round((a - o) / size).cast("int") for a, o in zip(p, origin, strict=True))


def linear_index(ix: Column, iy: Column, iz: Column, dim_x: int, dim_y: int) -> Column:
    return iz.cast("long") * dim_x * dim_y + iy.cast("long") * dim_x + ix.cast("long")


def unravel(i: Column, dim_x: int, dim_y: int) -> Vec:
    return (i % dim_x).cast("int"), (F.floor(i / dim_x) % dim_y).cast("int"), F.floor(i / (dim_x * dim_y)).cast("int")


def voxel_center(ix, origin, size: float, half: bool = False) -> Vec:
    return tuple(o + (i + (0.5 if half else 0.0)) * size for i, o in zip(ix, origin, strict=True))


# --- shapes ---


def point_line2(p: Vec, q: Vec, direction: Vec) -> Column:
    """Squared distance to the line through q; direction has length 1."""
    d = sub(p, q)
    return F.greatest(F.lit(0.0), norm2(d) - dot(d, direction) * dot(d, direction))


def point_plane(p: Vec, normal, offset: float) -> Column:
    return dot(p, normal) + offset


def point_box(p: Vec, low, high) -> Column:
    gap = [F.greatest(F.lit(0.0), F.lit(float(a)) - x, x - F.lit(float(b))) for x, a, b in zip(p, low, high, strict=True)]
    return F.sqrt(norm2(gap))


def point_sphere(p: Vec, center, radius: float) -> Column:
    return F.greatest(F.lit(0.0), F.sqrt(norm2(sub(p, tuple(F.lit(float(c)) for c in center)))) - radius)


def in_box(p: Vec, low, high) -> Column:
    return reduce(lambda a, b: a & b, [(x >= float(a)) & (x <= float(b)) for x, a, b in zip(p, low, high, strict=True)])


def triangle_area(a: Vec, b: Vec, c: Vec) -> Column:
    return F.sqrt(norm2(cross(sub(b, a), sub(c, a)))) / 2


# --- losses and schedules ---


def contrastive(d: Column, same: Column, margin: float = 1.0) -> Column:
    gap = F.greatest(margin - d, F.lit(0.0))
    return 0.5 * (same * d * d + (1 - same) * gap * gap)


def smooth_l1(diff: Column) -> Column:
    a = F.abs(diff)
    return F.when(a < 1, 0.5 * a * a).otherwise(a - 0.5)


def half_sse(diff: Column, weight: float = 1.0) -> Column:
    return 0.5 * (weight * diff) * (weight * diff)


def learning_rate(policy: str, it: Column, base: float, gamma: float = 0.1, power: float = 0.75, step: int = 1000, most: int = 10000, steps: tuple = ()) -> Column:
    n = F.floor(it / step)
    if policy == "fixed":
        return F.lit(base)
    if policy == "step":
        return base * F.pow(F.lit(gamma), n)
    if policy == "exp":
        return base * F.pow(F.lit(gamma), it)
    if policy == "inv":
        return base * F.pow(1 + gamma * it, F.lit(-power))
    if policy == "multistep":
        return base * F.pow(F.lit(gamma), total((it >= s).cast("int") for s in steps))
    if policy == "poly":
        return base * F.pow(1 - it / most, F.lit(power))
    if policy == "sigmoid":
        return base / (1 + F.exp(-gamma * (it - step)))
    if policy == "cyclical":
        return F.lit(0.0)
    raise ValueError(f"unknown policy {policy}")


# --- lines, boxes and rotations ---


def homogeneous(x: Column, y: Column, w: Column) -> tuple[Column, Column]:
    """A point scaled to w = 1; null at infinity."""
    return F.try_divide(x, w), F.try_divide(y, w)


def cross_matrix(v: Vec) -> list[Column]:
    """Nine entries of the matrix whose product with u is v x u."""
    zero = F.lit(0.0)
    return [zero, -v[2], v[1], v[2], zero, -v[0], -v[1], v[0], zero]


def gaussian_kernel(x: Column, sigma: float) -> Column:
    return F.exp(-(x * x) / (2.0 * sigma * sigma))


def linear_kernel(x: Column, limit: float) -> Column:
    """1 at 0, falling to 0 at the limit."""
    return F.greatest(F.lit(0.0), 1 - F.abs(x) / float(limit))


def rotate(q: tuple, p: Vec) -> Vec:
    """A point turned by a unit quaternion (w, x, y, z)."""
    m = quaternion_to_matrix(*q)
    return tuple(m[3 * i] * p[0] + m[3 * i + 1] * p[1] + m[3 * i + 2] * p[2] for i in range(3))


def slerp(a: tuple, b: tuple, t: Column | float) -> tuple:
    """Unit quaternion at share t of the shorter arc from a to b; the straight line where they are nearly equal."""
    cos = total(x * y for x, y in zip(a, b, strict=True))
    sign, size = F.when(cos < 0, -1.0).otherwise(1.0), F.least(F.lit(1.0), F.abs(cos))
    angle = F.acos(size)
    near = size > 1 - 1e-12
    part = lambda share: F.when(near, share).otherwise(F.try_divide(F.sin(share * angle), F.sin(angle)))
    t = t if isinstance(t, Column) else F.lit(float(t))
    return tuple(part(1 - t) * x + part(t) * sign * y for x, y in zip(a, b, strict=True))


def box_union(a_low: Vec, a_high: Vec, b_low: Vec, b_high: Vec) -> tuple[Vec, Vec]:
    """The least box around two boxes; the same for intervals of one axis."""
    return tuple(F.least(x, y) for x, y in zip(a_low, b_low, strict=True)), tuple(F.greatest(x, y) for x, y in zip(a_high, b_high, strict=True))


def box_intersection(a_low: Vec, a_high: Vec, b_low: Vec, b_high: Vec) -> tuple[Vec, Vec]:
    """What two boxes share; empty where an end is below its start."""
    return tuple(F.greatest(x, y) for x, y in zip(a_low, b_low, strict=True)), tuple(F.least(x, y) for x, y in zip(a_high, b_high, strict=True))


def symmetric_range(centre: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """The least range around two ends that is symmetric to the centre."""
    reach = F.greatest(F.abs(centre - low), F.abs(high - centre))
    return centre - reach, centre + reach


def range_in_image(low: Column, high: Column, size: int) -> Column:
    """Whether a pixel range counted from 1 lies in the image."""
    return (low > 0) & (high <= size)
