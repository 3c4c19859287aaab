"""Missing values, casts, alignment and validation of frame tables."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from seqspark.operators.stats import by_time
from seqspark.sources.shared import written


def fill_both_ways(column: str, default: float = 0.0, sequence: str = "sequence_id", idx: str = "idx") -> Column:
    """The last known value, else the next one, else ``default``; never across sequences."""
    to_here = lambda order: Window.partitionBy(sequence).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    # backwards for the next value: a frame that runs to the end of a sequence is read again for every row
    before, after = (F.last(column, True).over(to_here(order)) for order in (F.asc(idx), F.desc(idx)))
    return F.coalesce(before, after, F.lit(default))


def fill_quaternion(df: DataFrame, columns: tuple = ("qw", "qx", "qy", "qz")) -> DataFrame:
    """Fill every component both ways (identity where nothing is known) and normalise."""
    filled = df.withColumns({c: fill_both_ways(c, 1.0 if i == 0 else 0.0) for i, c in enumerate(columns)})
    norm = F.sqrt(sum(F.col(c) * F.col(c) for c in columns))
    unit = {c: F.when(norm > 1e-8, F.col(c) / norm).otherwise(1.0 if i == 0 else 0.0) for i, c in enumerate(columns)}
    return filled.select(*(unit[c].alias(c) if c in unit else F.col(c) for c in filled.columns))


def linear_fill(df: DataFrame, column: str, out: str, sequence: str = "sequence_id", idx: str = "idx") -> DataFrame:
    """Linear interpolation between known values; the nearest one beyond the first and last."""
    # both ways a known value comes before rows of its idx without one, so that it is seen from either side
    back, ahead = (Window.partitionBy(sequence).orderBy(order, F.col(column).isNull()).rowsBetween(Window.unboundedPreceding, 0) for order in (F.asc(idx), F.desc(idx)))
    at = F.when(F.col(column).isNotNull(), F.col(idx))
    d = df.withColumns({"_a": F.last(column, True).over(back), "_i": F.last(at, True).over(back), "_b": F.last(column, True).over(ahead), "_j": F.last(at, True).over(ahead)})
    between = F.col("_a") + (F.col("_b") - F.col("_a")) * F.try_divide(F.col(idx) - F.col("_i"), F.col("_j") - F.col("_i"))
    return d.withColumn(out, F.coalesce(F.col(column), between, "_a", "_b")).drop("_a", "_b", "_i", "_j")


def to_number(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(default))


def handedness(c: Column) -> Column:
    """1 for anything that begins with r or is 1 or more, else 0."""
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.startswith("r"), 1).when(text.startswith("l"), 0).otherwise(F.coalesce((text.try_cast("double") >= 1).cast("int"), F.lit(0)))


def finite(c: Column) -> Column:
    """0 for null, NaN and infinities."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), 0.0).otherwise(c)


def align(df: DataFrame, names: list[str]) -> DataFrame:
    """Exactly the columns ``names``, in that order; those that are missing are 0, extra ones go."""
    return df.select(*(F.coalesce(F.col(n), F.lit(0.0)).alias(n) if n in df.columns else F.lit(0.0).alias(n) for n in names))


def family(columns: list[str], prefixes: tuple[str, ...]) -> list[str]:
    """Columns that begin with one of the prefixes, whatever their case."""
    return [c for c in columns if c.lower().startswith(tuple(p.lower() for p in prefixes))]


def numeric_columns(df: DataFrame, prefixes: tuple[str, ...] = (), excluded: tuple[str, ...] = ()) -> list[str]:
    """Columns of numbers that don't begin with one of ``prefixes``, whatever their case, and aren't ``excluded``."""
    drop = {*family(df.columns, prefixes), *excluded} if prefixes else {*excluded}
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in drop]


def full_quaternion(df: DataFrame, columns: dict[str, str], out: tuple = ("qw", "qx", "qy", "qz")) -> DataFrame:
    """All four components; ``columns`` names those there are (w, x, y, z -> column). A missing w column is 1, other missing ones are null; null values stay."""
    part = lambda k: F.col(columns[k]) if columns.get(k) in df.columns else F.lit(1.0 if k == "w" else None)
    return df.withColumns({o: part(k).cast("double") for k, o in zip("wxyz", out)})


#: Column families of sensor tables: alternative names, the first that fits is taken.
QUATERNIONS = (("rot_w", "rot_x", "rot_y", "rot_z"), ("quat_w", "quat_x", "quat_y", "quat_z"))
THERMAL = ("thm_", "therm_", "thermal_")


def families(columns: list[str]) -> dict[str, list]:
    """The quaternion, thermal and time-of-flight columns of a table, by their names alone; ``sensors`` are the ids of the latter."""
    rotation = next((list(q) for q in QUATERNIONS if all(c in columns for c in q)), [])
    thermal = next((found for p in THERMAL if (found := [c for c in columns if c.startswith(p)])), [])
    pixels = [c for c in columns if re.fullmatch(r"tof_\d+_v.+", c)]
    return {"rotation": rotation, "thermal": thermal, "tof": pixels, "sensors": sorted({int(c.split("_")[1]) for c in pixels})}


def unified(df: DataFrame, keys: list[str], n_thermal: int = 5, n_sensors: int = 5, n_pixels: int = 64) -> DataFrame:
    """``keys`` and every family under fixed names (rot_w.., thm_1.., tof_1_v0..); what the table lacks is a null of type double."""
    found = families(df.columns)
    at = dict(zip(QUATERNIONS[0], found["rotation"])) | {f"thm_{m[1]}": c for c in found["thermal"] if (m := re.search(r"_(\d+)$", c))} | {c: c for c in found["tof"]}
    names = [*QUATERNIONS[0], *(f"thm_{i + 1}" for i in range(n_thermal)), *(f"tof_{s + 1}_v{p}" for s in range(n_sensors) for p in range(n_pixels))]
    return df.select(*keys, *((F.col(at[n]) if n in at else F.lit(None)).cast("double").alias(n) for n in names))


def variant(df: DataFrame, kind: str) -> DataFrame:
    """``full``, or ``imu_only``: the same columns with the thermal and time-of-flight families null."""
    if kind not in ("full", "imu_only"):
        raise ValueError(f"no variant {kind}")
    found = families(df.columns)
    gone = [] if kind == "full" else [*found["thermal"], *found["tof"]]
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in gone}) if gone else df


def draw(seed: int, *keys: str) -> Column:
    """A uniform number in [0, 1) that depends on the seed and the keys alone, bit for bit the same everywhere."""
    mixed = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))
    return F.conv(F.substring(mixed, 1, 8), 16, 10).cast("double") / 4294967296.0


def validation(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n_violations) of every rule, in one pass."""
    one = df.agg(F.array(*(F.struct(F.lit(k).alias("rule"), F.count_if(c).alias("n_violations")) for k, c in rules.items())).alias("r"))
    return one.select(F.explode("r").alias("x")).select("x.*")


def in_slices(batches, size: int = 512):
    """Record batches of ``size`` rows at most, none of them empty."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def repeated(batch: pa.RecordBatch, columns: tuple[str, ...], rows: list[int], name: str, values: list[int], size: int = 8192):
    """Record batches of ``size`` rows at most: ``columns`` of the given rows, and ``values`` beside them."""
    for at in range(0, len(rows), size):
        take = pa.array(rows[at : at + size], pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in columns), pa.array(values[at : at + size], pa.int64())], names=[*columns, name])


def nearest_of_class(df: DataFrame, k: int, block: int = 1024, pivots: int | None = None, compared=None) -> DataFrame:
    """(vec_id, label, neighbour, dist, k) of the ``k`` nearest other rows of a row's class, exactly. ``df``: vec_id, label, x, and n, the size of the class.

    The square root of n rows of each class, drawn by hash (or ``pivots`` of them),
    are its pivots; a row lies in the cell of the nearest. What a row finds in its
    own cell bounds how far its neighbours are; by the triangle inequality a cell
    whose rows all lie further from its pivot, or nearer, than the row does by more
    than this has none of them, and only the other cells are searched. A cell is
    searched in blocks of about ``block`` rows, so equal rows make no large group.
    Ties go to the smaller neighbour. ``compared``, an accumulator, counts pairs.
    """
    spark, limit = df.sparkSession, 256 << 20
    id_type, label_type = (df.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    wanted = F.lit(pivots) if pivots else F.ceil(F.sqrt("n"))
    # about as many as wanted, by hash; the first of all always, so no class is without
    chosen = df.withColumn("_h", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)))
    least = chosen.groupBy("label").agg(F.min("_h").alias("_least"))
    chosen = chosen.join(least, "label").where((F.col("_h") * F.col("n") < wanted * F.lit(1 << 40)) | (F.col("_h") == F.col("_least"))).select("label", "x").distinct()
    size = chosen.agg(F.sum(F.size("x") * 8)).head()[0] or 0
    if size > limit:
        raise ValueError(f"{size} bytes of pivots; {limit} may be sent to every executor: ask for fewer")
    centres: dict = {}
    for r in sorted(chosen.collect(), key=lambda r: (str(r["label"]), r["x"])):
        centres.setdefault(r["label"], []).append(r["x"])
    centres = {c: np.array(v, float) for c, v in centres.items()}
    known = spark.sparkContext.broadcast(centres)

    def distances(x, labels):
        """Rows by label: (where they are, their distances to the pivots of the class)."""
        for c in dict.fromkeys(labels):
            at = [i for i, y in enumerate(labels) if y == c]
            p = known.value[c]
            yield at, c, np.sqrt(np.maximum(((x[at] ** 2).sum(1)[:, None] - 2 * x[at] @ p.T + (p**2).sum(1)[None]), 0))

    def placed(batches):
        for batch in in_slices(batches):
            x, labels = np.array(batch.column("x").to_pylist(), float), batch.column("label").to_pylist()
            cell, off = np.zeros(len(x), np.int64), np.zeros(len(x))
            for at, _, d in distances(x, labels):
                cell[at] = d.argmin(1)
                off[at] = d.min(1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "x")), pa.array(cell), pa.array(off)], names=["vec_id", "label", "x", "cell", "off"])

    rows = written(df.select("vec_id", "label", "x").mapInArrow(placed, f"vec_id {id_type}, label {label_type}, x array<double>, cell long, off double"), "nearest-cells")
    cells = rows.groupBy("label", "cell").agg(F.min("off").alias("near"), F.max("off").alias("far"), F.count("*").alias("m"))  # a row for each pivot
    shapes = {(r["label"], r["cell"]): (r["near"], r["far"], r["m"]) for r in cells.collect()}
    shape = spark.sparkContext.broadcast(shapes)

    def best(queries, there):
        id_kind, label_kind = queries.column("vec_id").type, queries.column("label").type
        out = {"vec_id": [], "neighbour": [], "dist": []}
        label = queries.column("label")[0].as_py() if queries.num_rows else None
        if queries.num_rows and there.num_rows:
            ids, near = queries.column("vec_id").to_pylist(), np.array(there.column("near").to_pylist())
            x, y = np.array(queries.column("x").to_pylist(), float), np.array(there.column("near_x").to_pylist(), float)
            if compared is not None:
                compared.add(len(ids) * len(near))
            for i, v in enumerate(ids):
                d = ((y - x[i]) ** 2).sum(1)
                d[near == v] = np.inf
                order = np.lexsort((near, d))[:k]
                order = order[np.isfinite(d[order])]
                out["vec_id"] += [v] * len(order)
                out["neighbour"] += near[order].tolist()
                out["dist"] += d[order].tolist()
        return pa.table({"vec_id": pa.array(out["vec_id"], id_kind), "label": pa.array([label] * len(out["dist"]), label_kind), "neighbour": pa.array(out["neighbour"], id_kind), "dist": pa.array(out["dist"], pa.float64())})

    many = lambda n: F.greatest(F.ceil(n / block), F.lit(1)).cast("int")
    sized = rows.join(cells.select("label", "cell", "m"), ["label", "cell"])

    def search(asked: DataFrame) -> DataFrame:
        """The best of each cell asked for: queries (vec_id, label, x, cell)."""
        crowd = asked.groupBy("label", "cell").agg(F.count("*").alias("q"))
        left = asked.join(crowd, ["label", "cell"]).join(cells.select("label", "cell", "m"), ["label", "cell"])
        left = left.select("vec_id", "label", "x", "cell", F.pmod(F.xxhash64("vec_id"), many(F.col("q"))).cast("int").alias("mine"), F.explode(F.sequence(F.lit(0), many(F.col("m")) - 1)).alias("other"))
        right = sized.join(crowd, ["label", "cell"]).select(
            F.col("label").alias("near_label"), F.col("cell").alias("near_cell"), F.col("vec_id").alias("near"), F.col("x").alias("near_x"),
            F.explode(F.sequence(F.lit(0), many(F.col("q")) - 1)).alias("near_mine"), F.pmod(F.xxhash64("vec_id"), many(F.col("m"))).cast("int").alias("near_other"),
        )
        found = left.groupBy("label", "cell", "mine", "other").cogroup(right.groupBy("near_label", "near_cell", "near_mine", "near_other"))
        return found.applyInArrow(best, f"vec_id {id_type}, label {label_type}, neighbour {id_type}, dist double")

    top = Window.partitionBy("vec_id").orderBy("dist", "neighbour")
    own = written(search(rows.select("vec_id", "label", "x", "cell")).withColumn("_k", F.row_number().over(top)).where(F.col("_k") <= k).drop("_k"), "nearest-own")
    bound = own.groupBy("vec_id").agg(F.when(F.count("*") == k, F.sqrt(F.max("dist"))).alias("bound"))

    def open_cells(batches):
        for batch in in_slices(batches):
            x, labels, mine, bounds = np.array(batch.column("x").to_pylist(), float), batch.column("label").to_pylist(), batch.column("cell").to_numpy(), batch.column("bound").to_pylist()
            rows_, cells_ = [], []
            for at, c, d in distances(x, labels):
                held = [shape.value.get((c, j), (np.inf, -np.inf, 0)) for j in range(d.shape[1])]
                near, far, m = (np.array([h[i] for h in held]) for i in range(3))
                for i, row in zip(at, d):
                    most = np.inf if bounds[i] is None else bounds[i]
                    if not np.isfinite(most):  # a small cell: as far as the cells that have k rows for certain
                        order = np.argsort(row + far)
                        enough = np.flatnonzero(np.cumsum(m[order]) > k)
                        most = (row + far)[order][enough[0]] if len(enough) else np.inf
                    slack = 1e-9 * (1 + row)
                    meets = np.flatnonzero((m > 0) & (row - far <= most + slack) & (near - row <= most + slack))
                    meets = meets[meets != mine[i]]
                    rows_ += [i] * len(meets)
                    cells_ += meets.tolist()
            yield from repeated(batch, ("vec_id", "label", "x"), rows_, "cell", cells_)

    asked = rows.join(bound, "vec_id", "left").select("vec_id", "label", "x", "cell", "bound").mapInArrow(open_cells, f"vec_id {id_type}, label {label_type}, x array<double>, cell long")
    found = own.unionByName(search(asked))
    return found.withColumn("k", F.row_number().over(top)).where(F.col("k") <= k)


def partners(df: DataFrame, key: str, seed: int, block: int = 1024) -> DataFrame:
    """Every row with the next one of its block in an order drawn by ``seed`` (the last with the first): ``other``, and the other's columns as ``other_*``.

    Blocks are drawn as well, about ``block`` rows each, so no window grows with the table. A row alone in its block is its own partner.
    """
    blocks = max(1, -(-df.count() // block))
    w = Window.partitionBy("_block").orderBy(draw(seed, key), key)
    cols = [c for c in df.columns if c != key]
    struct = F.struct(F.col(key).alias("other"), *(F.col(c).alias(f"other_{c}") for c in cols))
    rows = df.withColumn("_block", F.floor(draw(seed + 7, key) * blocks)).withColumn("_me", struct)
    nxt = F.coalesce(F.lead("_me").over(w), F.first("_me").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rows.withColumn("_other", nxt).select(key, *cols, "_other.*")


def normal(seed: int, *keys: str) -> Column:
    """A standard normal number drawn by seed and keys."""
    u = F.greatest(draw(seed, *keys), F.lit(2.0**-32))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * draw(seed + 1000, *keys))


def augmented(df: DataFrame, sigma: float = 0.2, noise: float = 0.05, share: float = 0.5, value: str = "v") -> DataFrame:
    """sequence_id, idx, v and four versions of it: ``noisy``, ``magnitude`` (each frame times 1 + sigma x normal), ``warped`` (time runs by such steps, read
    back at the frames by linear interpolation), ``mixed`` (from ``share`` of the sequence on, the frames of a partner, where it has them)."""
    key = ("sequence_id", "idx")
    w = by_time()
    whole = Window.partitionBy("sequence_id")
    base = df.select(*key, F.col(value).alias("v"))
    base = base.withColumns({"noisy": F.col("v") + noise * normal(1, *key), "magnitude": F.col("v") * (1 + sigma * normal(2, *key))})
    timed = base.withColumn("_t", F.sum(1 + sigma * normal(3, *key)).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.count("*").over(whole))
    timed = timed.withColumn("_at", F.col("_t") / F.last("_t").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * F.col("_n"))
    knots = timed.select("sequence_id", F.col("_at").alias("pos"), F.col("v").alias("k"), F.lit(None).cast("long").alias("idx"))
    asked = timed.select("sequence_id", F.col("idx").cast("double").alias("pos"), F.lit(None).cast("double").alias("k"), "idx")
    warped = linear_fill(knots.unionByName(asked), "k", "warped", idx="pos").where("idx IS NOT NULL").select(*key, "warped")
    pairs = partners(base.select("sequence_id").distinct(), "sequence_id", seed=4)
    theirs = base.select(F.col("sequence_id").alias("other"), "idx", F.col("v").alias("_theirs")).join(pairs, "other").select("sequence_id", "idx", "_theirs")
    out = timed.join(warped, list(key)).join(theirs, list(key), "left")
    mixed = F.when(F.col("idx") >= F.floor(F.col("_n") * share), F.coalesce("_theirs", "v")).otherwise(F.col("v"))
    return out.withColumn("mixed", mixed).select(*key, "v", "noisy", "magnitude", "warped", "mixed")
