"""Queries: rotation (F) and spectra (Q)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seqspark.operators import rotation as R
from seqspark.operators import spectral as P
from seqspark.operators import stats as S
from seqspark.plans.registry import query

ACC = ("ax", "ay", "az")
_WORLD = (
    "w0 AS (SELECT *, (1 - 2 * (qy * qy + qz * qz)) * ax + 2 * (qx * qy - qw * qz) * ay + 2 * (qx * qz + qw * qy) * az AS wx, "
    "2 * (qx * qy + qw * qz) * ax + (1 - 2 * (qx * qx + qz * qz)) * ay + 2 * (qy * qz - qw * qx) * az AS wy, "
    "2 * (qx * qz - qw * qy) * ax + 2 * (qy * qz + qw * qx) * ay + (1 - 2 * (qx * qx + qy * qy)) * az AS wz FROM fv)"
)


def _acc():
    return tuple(F.col(c) for c in ACC)


def _world(t):
    return t.fv.withColumns(dict(zip(("wx", "wy", "wz"), R.rotate(R.quaternion(), _acc()))))


@query("f01_unit", "sequence_id idx", "w x y z", "WITH n AS (SELECT sequence_id, idx, ax, ay, az, idx % 7 AS k, sqrt(ax * ax + ay * ay + az * az + (idx % 7) * (idx % 7)) AS n FROM fv) SELECT sequence_id, idx, CASE WHEN n > 1e-8 THEN ax / n ELSE 1 END AS w, CASE WHEN n > 1e-8 THEN ay / n ELSE 0 END AS x, CASE WHEN n > 1e-8 THEN az / n ELSE 0 END AS y, CASE WHEN n > 1e-8 THEN k / n ELSE 0 END AS z FROM n")
def _(t):
    return t.fv.withColumns(dict(zip("wxyz", R.unit((*_acc(), (F.col("idx") % 7).cast("double"))))))


@query("f02_world_vector", "sequence_id idx", "wx wy wz", f"WITH {_WORLD} SELECT sequence_id, idx, wx, wy, wz FROM w0")
def _(t):
    return _world(t)


@query(
    "f03_static_gravity", "sequence_id idx", "gx gy gz",
    f"WITH {_WORLD}, u AS (SELECT sequence_id, idx, wx / 10 AS wx, wy / 10 AS wy, wz / 10 AS wz FROM w0), s AS (SELECT *, count(*) OVER p AS n, least(var_pop(wx) OVER p, var_pop(wy) OVER p, var_pop(wz) OVER p) AS low FROM u WINDOW p AS (PARTITION BY sequence_id)), m AS (SELECT *, avg(CASE WHEN idx < greatest(n // 10, 1) THEN wx END) OVER p AS mx, avg(CASE WHEN idx < greatest(n // 10, 1) THEN wy END) OVER p AS my, avg(CASE WHEN idx < greatest(n // 10, 1) THEN wz END) OVER p AS mz FROM s WINDOW p AS (PARTITION BY sequence_id)) SELECT sequence_id, idx, CASE WHEN n > 10 AND low < 0.1 THEN wx - mx ELSE wx END AS gx, CASE WHEN n > 10 AND low < 0.1 THEN wy - my ELSE wy END AS gy, CASE WHEN n > 10 AND low < 0.1 THEN wz - (mz - 9.8) ELSE wz END AS gz FROM m", digits=5,
)
def _(t):
    """Tenths of the table's numbers, which are near the gate of 0.1."""
    return R.without_static_gravity(_world(t).withColumns({c: F.col(c) / 10 for c in ("wx", "wy", "wz")}))


@query("f04_linear_acceleration", "sequence_id idx", "lx ly lz", f"WITH {_WORLD} SELECT sequence_id, idx, wx AS lx, wy AS ly, wz - 9.81 AS lz FROM w0")
def _(t):
    return _world(t).select("sequence_id", "idx", F.col("wx").alias("lx"), F.col("wy").alias("ly"), (F.col("wz") - 9.81).alias("lz"))


@query("f05_median_acceleration", "sequence_id idx", "lx ly lz", f"WITH {_WORLD} SELECT sequence_id, idx, " + ", ".join(f"w{c} - quantile_cont(w{c}, 0.5) OVER (PARTITION BY sequence_id) AS l{c}" for c in "xyz") + " FROM w0")
def _(t):
    return _world(t).withColumns({f"l{c}": F.col(f"w{c}") - F.percentile(f"w{c}", F.lit(0.5)).over(S.whole()) for c in "xyz"})


@query("f06_gravity_removed", "sequence_id idx", "gx gy gz", "SELECT sequence_id, idx, ax - 9.81 * 2 * (qx * qz - qw * qy) AS gx, ay - 9.81 * 2 * (qy * qz + qw * qx) AS gy, az - 9.81 * (1 - 2 * (qx * qx + qy * qy)) AS gz FROM fv")
def _(t):
    g = R.rotate(R.conjugate(R.quaternion()), (F.lit(0.0), F.lit(0.0), F.lit(9.81)))
    return t.fv.withColumns({f"g{c}": F.col(f"a{c}") - v for c, v in zip("xyz", g)})


_EULER = "atan2(2 * (qw * qx + qy * qz), 1 - 2 * (qx * qx + qy * qy)) AS roll, asin(greatest(-1, least(1, 2 * (qw * qy - qz * qx)))) AS pitch, atan2(2 * (qw * qz + qx * qy), 1 - 2 * (qy * qy + qz * qz)) AS yaw"


@query("f07_euler", "sequence_id idx", "roll pitch yaw", f"SELECT sequence_id, idx, {_EULER} FROM fv")
def _(t):
    return t.fv.withColumns(dict(zip(("roll", "pitch", "yaw"), R.euler(R.quaternion()))))


def _velocity_sql(frame: str) -> str:
    nxt = ", ".join(f"lead(q{k}) OVER (PARTITION BY sequence_id ORDER BY idx) AS n{k}" for k in "wxyz")
    if frame == "world":
        vec = "nw * qw + nx * qx + ny * qy + nz * qz AS dw, -nw * qx + nx * qw - ny * qz + nz * qy AS dx, -nw * qy + nx * qz + ny * qw - nz * qx AS dy, -nw * qz - nx * qy + ny * qx + nz * qw AS dz"
    else:
        vec = "qw * nw + qx * nx + qy * ny + qz * nz AS dw, qw * nx - qx * nw - qy * nz + qz * ny AS dx, qw * ny + qx * nz - qy * nw - qz * nx AS dy, qw * nz - qx * ny + qy * nx - qz * nw AS dz"
    one = lambda c: f"CASE WHEN len > 1e-12 THEN sgn * {c} * 2 * atan2(len, abs(dw)) / len ELSE 0 END / 0.05"
    tail = lambda c: f"coalesce(o{c}, lag(o{c}) OVER (PARTITION BY sequence_id ORDER BY idx), 0) AS o{c}" if frame == "world" else f"coalesce(o{c}, 0) AS o{c}"
    return f"WITH n AS (SELECT *, {nxt} FROM fv), d AS (SELECT sequence_id, idx, nw, {vec} FROM n), l AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS len, CASE WHEN dw < 0 THEN -1 ELSE 1 END AS sgn FROM d), o AS (SELECT sequence_id, idx, {', '.join(f'CASE WHEN nw IS NOT NULL THEN {one("d" + c)} END AS o{c}' for c in 'xyz')} FROM l) SELECT sequence_id, idx, {', '.join(map(tail, 'xyz'))} FROM o"


@query("f08_angular_velocity_world", "sequence_id idx", "ox oy oz", _velocity_sql("world"), digits=5)
def _(t):
    return R.angular_velocity(t.fv, R.quaternion(), 0.05)


@query("f09_angular_velocity_body", "sequence_id idx", "ox oy oz", _velocity_sql("body"), digits=5)
def _(t):
    return R.angular_velocity(t.fv, R.quaternion(), 0.05, "body", "zero")


_DISTANCE = "d AS (SELECT sequence_id, idx, abs(" + " + ".join(f"q{k} * lead(q{k}) OVER (PARTITION BY sequence_id ORDER BY idx)" for k in "wxyz") + ") AS dot FROM fv)"


@query("f10_angular_distance", "sequence_id idx", "angle", f"WITH {_DISTANCE} SELECT sequence_id, idx, 2 * acos(least(1, dot)) AS angle FROM d", digits=5)
def _(t):
    return t.fv.withColumn("angle", R.angular_distance(R.quaternion()))


@query("f11_angular_energy", "sequence_id", "energy", f"WITH {_DISTANCE} SELECT sequence_id, avg((2 * acos(least(1, dot)) / 0.05) ** 2) AS energy FROM d GROUP BY 1", digits=3)
def _(t):
    return S.summarise(t.fv.withColumn("o", R.angular_distance(R.quaternion()) / 0.05), {"energy": F.avg(F.col("o") ** 2)})


@query("f12_robust_normalise", "sequence_id idx", "z", "SELECT sequence_id, idx, (v - quantile_cont(v, 0.5) OVER p) / (quantile_cont(v, 0.75) OVER p - quantile_cont(v, 0.25) OVER p + 1e-8) AS z FROM fe WINDOW p AS (PARTITION BY sequence_id)")
def _(t):
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(S.whole())
    return t.fe.withColumn("q", q).withColumn("z", (F.col("v") - F.col("q")[1]) / (F.col("q")[2] - F.col("q")[0] + 1e-8))


@query("f13_zscore", "sequence_id idx", "z", "SELECT sequence_id, idx, (v - avg(v) OVER p) / CASE WHEN stddev_pop(v) OVER p = 0 THEN 1 ELSE stddev_pop(v) OVER p END AS z FROM fe WINDOW p AS (PARTITION BY sequence_id)")
def _(t):
    sd = F.stddev_pop("v").over(S.whole())
    return t.fe.withColumn("z", (F.col("v") - F.avg("v").over(S.whole())) / F.when(sd == 0, 1.0).otherwise(sd))


@query("f14_sampling_rate", "sequence_id", "fs", "WITH s AS (SELECT sequence_id, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY sequence_id ORDER BY idx) AS dt FROM fe), m AS (SELECT sequence_id, quantile_cont(dt, 0.5) AS dt FROM s GROUP BY 1) SELECT sequence_id, CASE WHEN 1 / dt BETWEEN 5 AND 200 THEN 1 / dt WHEN 1e3 / dt BETWEEN 5 AND 200 THEN 1e3 / dt WHEN 1e6 / dt BETWEEN 5 AND 200 THEN 1e6 / dt WHEN 1e9 / dt BETWEEN 5 AND 200 THEN 1e9 / dt ELSE 20 END AS fs FROM m", digits=4)
def _(t):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    df = t.fe.withColumn("dt", at - F.lag(at).over(S.by_time()))
    m = S.summarise(df, {"dt": F.percentile("dt", F.lit(0.5))})
    fs = F.lit(20.0)
    for scale in (1e9, 1e6, 1e3, 1.0):
        rate = F.try_divide(F.lit(scale), F.col("dt"))
        fs = F.when(rate.between(5, 200), rate).otherwise(fs)
    return m.withColumn("fs", fs)


@query("a27_orientation", "sequence_id", "roll_mean roll_std pitch_mean pitch_std yaw_range step_mean step_max", f"WITH {_DISTANCE}, e AS (SELECT sequence_id, idx, {_EULER} FROM fv) SELECT sequence_id, avg(roll) AS roll_mean, stddev_pop(roll) AS roll_std, avg(pitch) AS pitch_mean, stddev_pop(pitch) AS pitch_std, max(yaw) - min(yaw) AS yaw_range, avg(2 * acos(least(1, dot))) AS step_mean, max(2 * acos(least(1, dot))) AS step_max FROM e JOIN d USING (sequence_id, idx) GROUP BY 1", digits=5)
def _(t):
    df = t.fv.withColumns(dict(zip(("roll", "pitch", "yaw"), R.euler(R.quaternion()))) | {"step": R.angular_distance(R.quaternion())})
    return S.summarise(df, {"roll_mean": F.avg("roll"), "roll_std": F.stddev_pop("roll"), "pitch_mean": F.avg("pitch"), "pitch_std": F.stddev_pop("pitch"), "yaw_range": F.max("yaw") - F.min("yaw"), "step_mean": F.avg("step"), "step_max": F.max("step")})


@query("w15_sign_continuity", "sequence_id idx", "w x", "WITH d AS (SELECT sequence_id, idx, CASE WHEN l_orderkey % 3 = 0 THEN -1 ELSE 1 END * qw AS w, CASE WHEN l_orderkey % 3 = 0 THEN -1 ELSE 1 END * qx AS x, CASE WHEN l_orderkey % 3 = 0 THEN -1 ELSE 1 END * qy AS y, CASE WHEN l_orderkey % 3 = 0 THEN -1 ELSE 1 END * qz AS z FROM fv), n AS (SELECT *, w * lag(w) OVER o + x * lag(x) OVER o + y * lag(y) OVER o + z * lag(z) OVER o < 0 AS neg FROM d WINDOW o AS (PARTITION BY sequence_id ORDER BY idx)), p AS (SELECT *, count(*) FILTER (neg) OVER (PARTITION BY sequence_id ORDER BY idx ROWS UNBOUNDED PRECEDING) % 2 AS flip FROM n) SELECT sequence_id, idx, CASE WHEN flip = 1 THEN -w ELSE w END AS w, CASE WHEN flip = 1 THEN -x ELSE x END AS x FROM p")
def _(t):
    side = F.when(F.col("l_orderkey") % 3 == 0, -1).otherwise(1)
    df = t.fv.select("sequence_id", "idx", *((side * F.col("q" + k)).alias(k) for k in "wxyz"))
    o = S.by_time()
    negative = sum(F.col(k) * F.lag(k).over(o) for k in "wxyz") < 0
    df = df.withColumn("neg", F.when(negative, 1).otherwise(0))
    flip = F.sum("neg").over(o.rowsBetween(Window.unboundedPreceding, 0)) % 2 == 1
    return df.withColumn("flip", flip).select("sequence_id", "idx", *(F.when(F.col("flip"), -F.col(k)).otherwise(F.col(k)).alias(k) for k in "wxyz"))


_DFT = (
    "nn AS (SELECT *, count(*) OVER (PARTITION BY sequence_id) AS n FROM fe), kk AS (SELECT sequence_id, n, unnest(range(1, n // 2 + 1)) AS k FROM (SELECT DISTINCT sequence_id, n FROM nn)), "
    "sp AS (SELECT kk.sequence_id, kk.k, kk.k * 20.0 / kk.n AS freq, sum(v * cos(2 * pi() * kk.k * idx / kk.n)) ** 2 + sum(v * sin(2 * pi() * kk.k * idx / kk.n)) ** 2 AS power FROM kk JOIN nn ON nn.sequence_id = kk.sequence_id GROUP BY kk.sequence_id, kk.k, kk.n)"
)


def spectrum(t):
    return P.power_spectrum(t.fe)


@query("q01_power_spectrum", "sequence_id", "mean_power std_power total_power max_power", f"WITH {_DFT} SELECT sequence_id, avg(power) AS mean_power, stddev_pop(power) AS std_power, sum(power) AS total_power, max(power) AS max_power FROM sp GROUP BY 1", digits=1)
def _(t):
    return S.summarise(spectrum(t), {"mean_power": F.avg("power"), "std_power": F.stddev_pop("power"), "total_power": F.sum("power"), "max_power": F.max("power")})


@query("q02_magnitudes", "sequence_id", "mean_mag max_mag", f"WITH {_DFT} SELECT sequence_id, avg(sqrt(power)) AS mean_mag, max(sqrt(power)) AS max_mag FROM sp GROUP BY 1", digits=4)
def _(t):
    m = F.sqrt("power")
    return S.summarise(spectrum(t), {"mean_mag": F.avg(m), "max_mag": F.max(m)})


@query("q03_band_sums", "sequence_id", "b0 b2 b5 r0", f"WITH {_DFT} SELECT sequence_id, coalesce(sum(power) FILTER (freq < 2), 0) AS b0, coalesce(sum(power) FILTER (freq >= 2 AND freq < 5), 0) AS b2, coalesce(sum(power) FILTER (freq >= 5 AND freq < 9.99), 0) AS b5, coalesce(sum(power) FILTER (freq < 2), 0) / sum(power) AS r0 FROM sp GROUP BY 1", digits=1)
def _(t):
    f, p = F.col("freq"), F.col("power")
    part = lambda c: F.coalesce(F.sum(F.when(c, p)), F.lit(0.0))
    return S.summarise(spectrum(t), {"b0": part(f < 2), "b2": part((f >= 2) & (f < 5)), "b5": part((f >= 5) & (f < 9.99)), "r0": S.ratio(part(f < 2), F.sum(p))})


def _welch_sql() -> str:
    return (
        "sg AS (SELECT *, count(*) OVER (PARTITION BY sequence_id) AS n FROM fe), mm AS (SELECT DISTINCT sequence_id, n, least(n, 32) AS m FROM sg), st AS (SELECT sequence_id, m, unnest(range(0, n - m + 1, greatest(m - m // 2, 1))) AS s FROM mm WHERE m > 1), "
        "wf AS (SELECT st.sequence_id, st.s, st.m, idx - st.s AS i, v - avg(v) OVER (PARTITION BY st.sequence_id, st.s) AS x, 0.5 - 0.5 * cos(2 * pi() * (idx - st.s) / st.m) AS h FROM st JOIN sg ON sg.sequence_id = st.sequence_id AND idx >= st.s AND idx < st.s + st.m), "
        "wk AS (SELECT wf.sequence_id, s, k, m, sum(x * h * cos(2 * pi() * k * i / m)) ** 2 + sum(x * h * sin(2 * pi() * k * i / m)) ** 2 AS p, sum(h * h) AS u FROM wf, (SELECT unnest(range(0, 17)) AS k) AS ks WHERE k <= m // 2 GROUP BY ALL), "
        "wp AS (SELECT sequence_id, k, k * 20.0 / m AS freq, avg(CASE WHEN k = 0 OR (m % 2 = 0 AND k = m // 2) THEN 1 ELSE 2 END * p / (20.0 * u)) AS power FROM wk GROUP BY sequence_id, k, m)"
    )


_PSD = _welch_sql()


def psd(t):
    return P.welch(t.fe, 32)


@query("q04_welch", "sequence_id k", "freq power", f"WITH {_PSD} SELECT sequence_id, k, freq, power FROM wp", digits=5)
def _(t):
    return psd(t)


@query("q05_periodogram", "sequence_id", "max_freq max_power prominence", f"WITH {_DFT}, r AS (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY round(power, 3) DESC, k) AS place, avg(power) OVER (PARTITION BY sequence_id) AS mean FROM sp) SELECT sequence_id, freq AS max_freq, power AS max_power, power / mean AS prominence FROM r WHERE place = 1", digits=2)
def _(t):
    best = F.max(F.struct(F.round("power", 3).alias("r"), (-F.col("k")).alias("k"), "freq", "power"))
    s = S.summarise(spectrum(t), {"best": best, "mean": F.avg("power")})
    return s.select("sequence_id", F.col("best.freq").alias("max_freq"), F.col("best.power").alias("max_power"), (F.col("best.power") / F.col("mean")).alias("prominence"))


@query("q06_band_power", "sequence_id", "low mid high low_share log_low", f"WITH {_PSD}, b AS (SELECT sequence_id, coalesce(sum(power) FILTER (freq BETWEEN 0.3 AND 3), 0) AS low, coalesce(sum(power) FILTER (freq BETWEEN 3 AND 8), 0) AS mid, coalesce(sum(power) FILTER (freq BETWEEN 8 AND 9.999), 0) AS high, sum(power) AS total FROM wp GROUP BY 1) SELECT sequence_id, low, mid, high, coalesce(low / nullif(total, 0), 0) AS low_share, ln(1 + low) AS log_low FROM b", digits=4)
def _(t):
    f, p = F.col("freq"), F.col("power")
    part = lambda lo, hi: F.coalesce(F.sum(F.when(f.between(lo, hi), p)), F.lit(0.0))
    b = S.summarise(psd(t), {"low": part(0.3, 3), "mid": part(3, 8), "high": part(8, 9.999), "total": F.sum("power")})
    return b.withColumns({"low_share": S.ratio(F.col("low"), F.col("total")), "log_low": F.log1p("low")})


@query("q07_band_ratio", "sequence_id", "low_high", f"WITH {_PSD} SELECT sequence_id, coalesce(coalesce(sum(power) FILTER (freq < 3), 0) / nullif(coalesce(sum(power) FILTER (freq >= 3), 0), 0), 0) AS low_high FROM wp GROUP BY 1", digits=5)
def _(t):
    low = F.col("freq") < 3
    return S.summarise(psd(t), {"low_high": S.ratio(F.coalesce(F.sum(F.when(low, F.col("power"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~low, F.col("power"))), F.lit(0.0)))})


@query("q08_centroid", "sequence_id", "centroid", f"WITH {_PSD} SELECT sequence_id, coalesce(sum(freq * power) / nullif(sum(power), 0), 0) AS centroid FROM wp GROUP BY 1", digits=5)
def _(t):
    return S.summarise(psd(t), {"centroid": S.ratio(F.sum(F.col("freq") * F.col("power")), F.sum("power"))})


_CUM = "c AS (SELECT *, sum(power) OVER (PARTITION BY sequence_id) AS total, sum(power) OVER (PARTITION BY sequence_id ORDER BY freq ROWS UNBOUNDED PRECEDING) AS cum FROM wp)"


@query("q09_rolloff", "sequence_id", "rolloff", f"WITH {_PSD}, {_CUM} SELECT sequence_id, min(freq) FILTER (cum >= 0.85 * total) AS rolloff FROM c GROUP BY 1")
def rolloffs(t):
    return S.summarise(P.with_shares(psd(t)), {"rolloff": P.share_edge(None, 0.85)})


@query("q10_bandwidth", "sequence_id", "bandwidth", f"WITH {_PSD}, c AS (SELECT sequence_id, sum(freq * power) / sum(power) AS mu FROM wp GROUP BY 1) SELECT wp.sequence_id, sqrt(sum((freq - mu) ** 2 * power) / sum(power)) AS bandwidth FROM wp JOIN c USING (sequence_id) GROUP BY 1", digits=5)
def _(t):
    w = S.whole()
    s = psd(t).withColumn("mu", F.sum(F.col("freq") * F.col("power")).over(w) / F.sum("power").over(w))
    return S.summarise(s, {"bandwidth": F.sqrt(S.ratio(F.sum((F.col("freq") - F.col("mu")) ** 2 * F.col("power")), F.sum("power")))})


@query("q11_flatness", "sequence_id", "flatness", f"WITH {_PSD} SELECT sequence_id, CASE WHEN min(power) > 0 THEN exp(avg(ln(power))) / avg(power) ELSE 0 END AS flatness FROM wp WHERE k > 0 GROUP BY 1", digits=4)
def _(t):
    return S.summarise(psd(t).where("k > 0"), {"flatness": F.when(F.min("power") > 0, F.exp(F.avg(F.ln("power"))) / F.avg("power")).otherwise(0.0)})


@query("q12_entropy", "sequence_id", "nats bits", f"WITH {_PSD}, p AS (SELECT sequence_id, power / sum(power) OVER (PARTITION BY sequence_id) AS p FROM wp) SELECT sequence_id, -sum(p * ln(p + 1e-8)) AS nats, -sum(p * log2(p + 1e-10)) AS bits FROM p GROUP BY 1", digits=5)
def _(t):
    p = psd(t).withColumn("p", F.col("power") / F.sum("power").over(S.whole()))
    return S.summarise(p, {"nats": -F.sum(F.col("p") * F.ln(F.col("p") + 1e-8)), "bits": -F.sum(F.col("p") * F.log2(F.col("p") + 1e-10))})


@query("q13_dominant", "sequence_id k", "freq power", f"WITH {_PSD}, r AS (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY round(power, 4) DESC, k) AS place FROM wp) SELECT sequence_id, k, freq, power FROM r WHERE place = 1", digits=4)
def _(t):
    s = S.summarise(psd(t), {"b": F.max(F.struct(F.round("power", 4).alias("r"), (-F.col("k")).alias("m"), "freq", "power"))})
    return s.select("sequence_id", (-F.col("b.m")).alias("k"), "b.freq", "b.power")


@query("q14_psd_stats", "sequence_id", "max mean std", f"WITH {_PSD} SELECT sequence_id, max(power) AS max, avg(power) AS mean, stddev_pop(power) AS std FROM wp GROUP BY 1", digits=4)
def _(t):
    return S.summarise(psd(t), {"max": F.max("power"), "mean": F.avg("power"), "std": F.stddev_pop("power")})


@query("q15_psd_edges", "sequence_id", "median_freq edge_freq integral", f"WITH {_PSD}, {_CUM}, l AS (SELECT *, lead(power) OVER o AS np, lead(freq) OVER o AS nf FROM c WINDOW o AS (PARTITION BY sequence_id ORDER BY freq)) SELECT sequence_id, min(freq) FILTER (cum >= 0.5 * total) AS median_freq, min(freq) FILTER (cum >= 0.95 * total) AS edge_freq, sum((power + np) / 2 * (nf - freq)) AS integral FROM l GROUP BY 1", digits=4)
def _(t):
    w = Window.partitionBy("sequence_id").orderBy("freq")
    s = P.with_shares(psd(t)).withColumn("area", (F.col("power") + F.lead("power").over(w)) / 2 * (F.lead("freq").over(w) - F.col("freq")))
    return S.summarise(s, {"median_freq": P.share_edge(None, 0.5), "edge_freq": P.share_edge(None, 0.95), "integral": F.sum("area")})


@query("q17_lowpass_split", "sequence_id idx", "v gravity rest")
def _(t):
    return P.filtered(t.fe, 2, 0.75, out="gravity").withColumn("rest", F.col("v") - F.col("gravity"))


@query("q18_highpass", "sequence_id idx", "v high")
def _(t):
    return P.filtered(t.fe, 4, 2.0, high=True, out="high")


@query("q19_slow_lowpass", "sequence_id idx", "v slow")
def _(t):
    return P.filtered(t.fe, 3, 0.3, out="slow")
