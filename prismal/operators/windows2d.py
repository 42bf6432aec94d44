"""Two-dimensional windows over grids of rows (scene_id, r, c, ...).

Sums over boxes are separable: a range window along the rows, then one along
the columns. What isn't a sum gathers neighbours by an offset join: each pixel
is sent to the places it is a neighbour of, which is an equi-join with as many
rows as offsets. Border rules: truncate (no neighbour), edge (the border pixel
again), reflect (mirror without repeating the edge), symmetric (mirror that
repeats it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def offsets_box(k: int) -> list[tuple[int, int]]:
    h = k // 2
    return [(i, j) for i in range(-h, h + 1) for j in range(-h, h + 1)]


def offsets_diamond(radius: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if abs(i) + abs(j) <= radius]


def _folded(x: Column, size: Column, mode: str) -> Column:
    if mode == "edge":
        return F.least(size - 1, F.greatest(F.lit(0), x))
    if mode == "symmetric":
        period = 2 * size
        y = F.pmod(x, period)
        return F.when(y < size, y).otherwise(period - 1 - y)
    period = F.greatest(F.lit(1), 2 * (size - 1))
    y = F.pmod(x, period)
    return F.when(y < size, y).otherwise(period - y)


def shape(grid: DataFrame) -> DataFrame:
    """_scene, _h, _w: one row a scene."""
    return grid.groupBy(F.col("scene_id").alias("_scene")).agg((F.max("r") + 1).alias("_h"), (F.max("c") + 1).alias("_w"))


def neighbours(grid: DataFrame, offsets: list[tuple[int, int]], values: list[str], *, mode: str = "truncate", out: str = "n_") -> DataFrame:
    """scene_id, r, c, and each neighbour's values as n_<value>: one row a pixel and offset."""
    where = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets))
    want = grid.select("scene_id", "r", "c").withColumn("_o", F.explode(where))
    want = want.select("scene_id", "r", "c", (F.col("r") + F.col("_o.i")).alias("_r"), (F.col("c") + F.col("_o.j")).alias("_c"))
    if mode != "truncate":
        want = want.join(shape(grid), F.col("scene_id") == F.col("_scene")).withColumn("_r", _folded(F.col("_r"), F.col("_h"), mode)).withColumn("_c", _folded(F.col("_c"), F.col("_w"), mode)).drop("_scene", "_h", "_w")
    have = grid.select(F.col("scene_id").alias("_s"), F.col("r").alias("_nr"), F.col("c").alias("_nc"), *(F.col(v).alias(f"{out}{v}") for v in values))
    return want.join(have, (F.col("scene_id") == F.col("_s")) & (F.col("_r") == F.col("_nr")) & (F.col("_c") == F.col("_nc"))).drop("_s", "_nr", "_nc", "_r", "_c")


def integral_image(grid: DataFrame, value: str, out: str = "integral") -> DataFrame:
    """Sum of all values up and left of each pixel, itself included; missing values count as 0."""
    along = Window.partitionBy("scene_id", "r").orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("scene_id", "c").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    return grid.withColumn("_row", F.sum(F.coalesce(F.col(value), F.lit(0))).over(along)).withColumn(out, F.sum("_row").over(down)).drop("_row")


def box_sums(grid: DataFrame, values: dict[str, Column], half: int) -> DataFrame:
    """Sums over the (2 half + 1) square around each pixel, cut at the borders: out name -> summed expression."""
    along = Window.partitionBy("scene_id", "r").orderBy("c").rangeBetween(-half, half)
    down = Window.partitionBy("scene_id", "c").orderBy("r").rangeBetween(-half, half)
    x = grid.withColumns({f"_{k}": F.sum(F.coalesce(v, F.lit(0))).over(along) for k, v in values.items()})
    return x.withColumns({k: F.sum(f"_{k}").over(down) for k in values}).drop(*(f"_{k}" for k in values))


def ring_rx_2(grid: DataFrame, a: str, b: str, *, inner: int = 3, outer: int = 7, reg: float = 1e-4, least: int = 4) -> DataFrame:
    """Local RX of two bands in closed form, from box sums alone."""
    ok = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.col(a), F.col(b)
    sums = {"n": F.when(ok, 1.0), "x": F.when(ok, x), "y": F.when(ok, y), "xx": F.when(ok, x * x), "xy": F.when(ok, x * y), "yy": F.when(ok, y * y)}
    big = box_sums(grid, {f"_o{k}": v for k, v in sums.items()}, outer // 2)
    both = box_sums(big, {f"_i{k}": v for k, v in sums.items()}, inner // 2)
    g = {k: F.col(f"_o{k}") - F.col(f"_i{k}") for k in sums}
    both = both.withColumns({f"_g{k}": v for k, v in g.items()})
    n = F.col("_gn")
    mx, my = F.col("_gx") / n, F.col("_gy") / n
    sxx, sxy, syy = F.col("_gxx") / n - mx * mx + reg, F.col("_gxy") / n - mx * my, F.col("_gyy") / n - my * my + reg
    dx, dy = x - mx, y - my
    score = (syy * dx * dx - 2 * sxy * dx * dy + sxx * dy * dy) / (sxx * syy - sxy * sxy)
    drop = [f"_{p}{k}" for p in "oig" for k in sums]
    return both.withColumn("local_rx", F.when(ok & (n >= least), score)).drop(*drop)


def spatial_context(scores: DataFrame, *, k: int = 7, score: str = "score") -> DataFrame:
    """context = how far a score exceeds the median of the k x k square around it, never below 0.

    Borders are symmetric; missing neighbours count as the scene's median, and
    a missing score stays missing.
    """
    middle = scores.groupBy(F.col("scene_id").alias("_scene2")).agg(F.percentile(score, F.lit(0.5)).alias("_m"))
    filled = scores.join(middle, F.col("scene_id") == F.col("_scene2")).drop("_scene2").withColumn("_f", F.coalesce(F.col(score), F.col("_m")))
    near = neighbours(filled, offsets_box(k), ["_f"], mode="symmetric").groupBy("scene_id", "r", "c").agg(F.percentile("n__f", F.lit(0.5)).alias("_median"))
    return scores.join(near, ["scene_id", "r", "c"]).withColumn("context", F.greatest(F.lit(0.0), F.col(score) - F.col("_median"))).withColumn("context", F.when(F.col(score).isNotNull(), F.col("context"))).drop("_median")


def _morphed(mask: DataFrame, radius: int, grow: bool) -> DataFrame:
    """One erosion or dilation with a diamond; outside the grid counts as background."""
    near = neighbours(mask, offsets_diamond(radius), ["m"]).groupBy("scene_id", "r", "c").agg(F.max("n_m").alias("_hi"), F.min("n_m").alias("_lo"), F.count(F.lit(1)).alias("_k"))
    full = len(offsets_diamond(radius))
    m = F.col("_hi") if grow else F.when(F.col("_k") == full, F.col("_lo")).otherwise(0)
    return near.select("scene_id", "r", "c", m.cast("int").alias("m"))


def eroded(mask: DataFrame, radius: int = 1) -> DataFrame:
    return _morphed(mask, radius, grow=False)


def dilated(mask: DataFrame, radius: int = 1) -> DataFrame:
    return _morphed(mask, radius, grow=True)


def cleaned_up(mask: DataFrame, *, open_radius: int = 1, close_radius: int = 2) -> DataFrame:
    """Opening, then closing."""
    return eroded(dilated(dilated(eroded(mask, open_radius), open_radius), close_radius), close_radius)
