"""Fixed channels of a frame for sequence models: motion, angular velocity, and aggregates of depth and thermal sensors. A missing modality is 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqspark.operators import rotation as R
from seqspark.operators import spectral as P
from seqspark.operators import stats as S

_AGGREGATES = ("mean", "std", "min", "max", "valid_ratio")
#: Names and order of the channels.
CHANNELS_18 = [*(f"linear_acc_{k}" for k in "xyz"), *(f"omega_{k}" for k in "xyz"), "linear_acc_mag", "omega_mag", *(f"{m}_{a}" for m in ("tof", "thm") for a in _AGGREGATES)]
CHANNELS_41 = [
    *(f"linear_acc_{k}" for k in "xyz"), "rot_x", "rot_y", "rot_z", "acc_mag", "linear_acc_mag", "rot_angle", "acc_mag_jerk", "linear_acc_mag_jerk", "rot_angle_vel", *(f"omega_{k}" for k in "xyz"), "omega_mag",
    *(f"tof_{s}_{a}" for s in range(1, 6) for a in ("mean", "std", "min", "max")), *(f"thm_{s}" for s in range(1, 6)),
]
KEY = ["sequence_id", "idx"]


def _length(*parts: Column) -> Column:
    return F.sqrt(sum(p * p for p in parts))


def _aggregated(frames: DataFrame, prefix: str) -> DataFrame:
    d = F.col("d")
    return frames.groupBy(*KEY).agg(F.avg(d).alias(f"{prefix}_mean"), F.stddev_pop(d).alias(f"{prefix}_std"), F.min(d).alias(f"{prefix}_min"), F.max(d).alias(f"{prefix}_max"), (F.count(d) / F.count("*")).alias(f"{prefix}_valid_ratio"))


def beside(frames: DataFrame, *parts: DataFrame) -> DataFrame:
    """The left join of ``frames`` with ``parts``, each of which has one row a frame.

    Frames whose sequences lie together stay where they are: a join on both keys
    would shuffle all their columns once more, a window within the sequence does
    not. Only the parts are dealt, by sequence like the frames.
    """
    seen = parts[0]
    for part in parts[1:]:
        seen = seen.join(part, KEY, "full")
    names = [c for c in seen.columns if c not in KEY]
    seen = seen.select(*KEY, F.struct(*names).alias("_seen"), F.lit(False).alias("_frame")).dropna(subset=KEY).repartition("sequence_id")
    kept = frames.columns
    both = frames.withColumn("_frame", F.lit(True)).unionByName(seen, allowMissingColumns=True)
    both = both.withColumn("_seen", F.max("_seen").over(Window.partitionBy(*KEY))).where("_frame")
    return both.select(*kept, *(F.col(f"_seen.{c}").alias(c) for c in names))


def linear_acceleration(df: DataFrame, method: str = "lowpass", fs: float = 20.0, columns: tuple = ("wx", "wy", "wz"), out: tuple = CHANNELS_18[:3]) -> DataFrame:
    """World acceleration without gravity: less its low-pass part (``lowpass``), its median over the sequence (``median``), or 9.81 along z (``subtract``)."""
    if method == "subtract":
        return df.withColumns({o: F.col(c) - (9.81 if c == columns[2] else 0.0) for c, o in zip(columns, out)})
    if method == "median":
        return df.withColumns({o: F.col(c) - F.percentile(c, F.lit(0.5)).over(S.whole()) for c, o in zip(columns, out)})
    if method != "lowpass":
        raise ValueError(f"no method {method}")
    for c, o in zip(columns, out):
        slow = P.filtered(df.select(*KEY, c), 2, 0.75, fs, value=c, out="_slow")
        df = df.join(slow.select(*KEY, "_slow"), KEY).withColumn(o, F.col(c) - F.col("_slow")).drop("_slow")
    return df


def frame_channels(motion: DataFrame, depth: DataFrame | None = None, thermal: DataFrame | None = None, dt: float = 0.05, method: str = "lowpass") -> DataFrame:
    """18 channels a frame. ``motion``: sequence_id, idx, ax ay az, qw qx qy qz; ``depth`` and ``thermal``: sequence_id, idx, d, many rows a frame, null where there is no echo."""
    world = motion.withColumns(dict(zip(("wx", "wy", "wz"), R.rotate(R.quaternion(), tuple(F.col(c) for c in ("ax", "ay", "az"))))))
    df = R.angular_velocity(linear_acceleration(world, method, 1 / dt), R.quaternion(), dt, names=tuple(CHANNELS_18[3:6]))
    df = df.withColumns({"linear_acc_mag": _length(*map(F.col, CHANNELS_18[:3])), "omega_mag": _length(*map(F.col, CHANNELS_18[3:6]))})
    df = df.select(*KEY, *CHANNELS_18[:8])
    if parts := [_aggregated(part, prefix) for part, prefix in ((depth, "tof"), (thermal, "thm")) if part is not None]:
        df = beside(df, *parts)
    return df.select(*KEY, *(F.coalesce(F.col(c), F.lit(0.0)).alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in CHANNELS_18))


def wide_channels(motion: DataFrame, depth: DataFrame, thermal: DataFrame, dt: float = 0.05, gravity: float = 9.81) -> DataFrame:
    """16 motion and 25 sensor channels a frame: ``depth`` (sequence_id, idx, sensor 1-5, d) by sensor, one thermal number a sensor. Gravity is turned into the sensor's axes and taken off."""
    q = R.quaternion()
    down = R.rotate(R.conjugate(q), (F.lit(0.0), F.lit(0.0), F.lit(gravity)))
    df = motion.withColumns({o: F.col(c) - g for o, c, g in zip(CHANNELS_41[:3], ("ax", "ay", "az"), down)})
    df = df.withColumns({"rot_x": q[1], "rot_y": q[2], "rot_z": q[3], "acc_mag": _length(*(F.col(c) for c in ("ax", "ay", "az"))), "linear_acc_mag": _length(*map(F.col, CHANNELS_41[:3])), "rot_angle": 2 * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q[0])))})
    w = S.by_time()
    df = df.withColumns({o: F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0)) for o, c in (("acc_mag_jerk", "acc_mag"), ("linear_acc_mag_jerk", "linear_acc_mag"), ("rot_angle_vel", "rot_angle"))})
    df = R.angular_velocity(df, q, dt, "body", "zero", tuple(f"omega_{k}" for k in "xyz"))
    df = df.withColumn("omega_mag", _length(*(F.col(f"omega_{k}") for k in "xyz")))
    of = lambda s: F.when(F.col("sensor") == s, F.col("d"))
    sensors = depth.groupBy(*KEY).agg(*(f(of(s)).alias(f"tof_{s}_{a}") for s in range(1, 6) for a, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))))
    heat = thermal.groupBy(*KEY).agg(*(F.max(of(s)).alias(f"thm_{s}") for s in range(1, 6)))
    df = beside(df.select(*KEY, *CHANNELS_41[:16]), sensors, heat)
    return df.select(*KEY, *(F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in CHANNELS_41))
