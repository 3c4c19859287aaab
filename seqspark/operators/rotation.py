"""Quaternion algebra as column arithmetic on (w, x, y, z) tuples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.operators.stats import by_time, whole

Quaternion = tuple[Column, Column, Column, Column]


def quaternion(prefix: str = "q") -> Quaternion:
    return tuple(F.col(prefix + k) for k in "wxyz")


def unit(q: Quaternion) -> Quaternion:
    """q of length 1; the identity where it has next to no length or a null part."""
    norm = F.sqrt(sum(c * c for c in q))
    return tuple(F.when(norm > 1e-8, c / norm).otherwise(1.0 if i == 0 else 0.0) for i, c in enumerate(q))


def conjugate(q: Quaternion) -> Quaternion:
    return (q[0], -q[1], -q[2], -q[3])


def product(a: Quaternion, b: Quaternion) -> Quaternion:
    return (
        a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3],
        a[0] * b[1] + a[1] * b[0] + a[2] * b[3] - a[3] * b[2],
        a[0] * b[2] - a[1] * b[3] + a[2] * b[0] + a[3] * b[1],
        a[0] * b[3] + a[1] * b[2] - a[2] * b[1] + a[3] * b[0],
    )


def rotate(q: Quaternion, v: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """The vector v turned by the unit quaternion q."""
    w, x, y, z = q
    a, b, c = v
    return (
        (1 - 2 * (y * y + z * z)) * a + 2 * (x * y - w * z) * b + 2 * (x * z + w * y) * c,
        2 * (x * y + w * z) * a + (1 - 2 * (x * x + z * z)) * b + 2 * (y * z - w * x) * c,
        2 * (x * z - w * y) * a + 2 * (y * z + w * x) * b + (1 - 2 * (x * x + y * y)) * c,
    )


def euler(q: Quaternion) -> tuple[Column, Column, Column]:
    """Angles about x, y and z."""
    w, x, y, z = q
    s = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (w * y - z * x)))
    return F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)), F.asin(s), F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))


def following(q: Quaternion) -> Quaternion:
    """The quaternion of the next row; null in the last."""
    return tuple(F.lead(c).over(by_time()) for c in q)


def log_map(q: Quaternion) -> tuple[Column, Column, Column]:
    """The rotation vector of a unit quaternion, the short way round."""
    sign = F.when(q[0] < 0, -1.0).otherwise(1.0)
    length = F.sqrt(q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    angle = 2 * F.atan2(length, F.abs(q[0]))
    return tuple(F.when(length > 1e-12, sign * c * angle / length).otherwise(0.0) for c in q[1:])


def angular_velocity(df: DataFrame, q: Quaternion, dt: float, frame: str = "world", tail: str = "repeat", names: tuple = ("ox", "oy", "oz")) -> DataFrame:
    """``df`` with the rotation per second from each row to the next, in world or body axes.

    The last row of a sequence repeats the one before, or is 0 with ``tail`` "zero"; a single row is 0.
    """
    ahead = following(q)
    turn = product(ahead, conjugate(q)) if frame == "world" else product(conjugate(q), ahead)
    out = df.withColumns({n: F.when(ahead[0].isNotNull(), c / dt) for n, c in zip(names, log_map(turn))})
    last = {n: F.lag(n).over(by_time()) if tail == "repeat" else F.lit(0.0) for n in names}
    return out.withColumns({n: F.coalesce(F.col(n), last[n], F.lit(0.0)) for n in names})


def without_static_gravity(df: DataFrame, columns: tuple = ("wx", "wy", "wz"), out: tuple = ("gx", "gy", "gz"), gate: float = 0.1, gravity: float = 9.8) -> DataFrame:
    """World acceleration less its mean over the first tenth of the rows (z keeps ``gravity``), for sequences of more than 10 rows whose calmest axis has a variance below ``gate``."""
    p = whole()
    df = df.withColumn("_n", F.count("*").over(p)).withColumn("_low", F.least(*(F.var_pop(c).over(p) for c in columns)))
    early, still = F.expr("idx < greatest(_n div 10, 1)"), (F.col("_n") > 10) & (F.col("_low") < gate)
    shifted = {}
    for c, name, shift in zip(columns, out, (0.0, 0.0, gravity)):
        shifted[name] = F.when(still, F.col(c) - (F.avg(F.when(early, F.col(c))).over(p) - shift)).otherwise(F.col(c))
    return df.withColumns(shifted).drop("_n", "_low")


def angular_distance(q: Quaternion) -> Column:
    """The angle from each row to the next."""
    dot = sum(a * b for a, b in zip(q, following(q)))
    return 2 * F.acos(F.least(F.lit(1.0), F.abs(dot)))
