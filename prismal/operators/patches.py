"""Patches of scenes: crops, pools, splits by scene, and models that see a window at a time.

A model is any function of arrays: [windows, patch, patch, bands] with NaN where
there is no pixel, to [windows, patch, patch] probabilities. It runs in Arrow
batches of whole windows; a task holds a few windows, never a scene.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismal.operators.regions import whole_groups
from prismal.session import ship

Model = Callable[[np.ndarray], np.ndarray]
#: Values that a model is given at once, but for a single larger window.
HELD = 1 << 21


def four_corners(h: Column, w: Column, size: int = 64) -> Column:
    """The places (crop, r0, c0) of four crops, one in each corner."""
    return F.array(*(F.struct(F.lit(k).alias("crop"), r.cast("long").alias("r0"), c.cast("long").alias("c0")) for k, (r, c) in enumerate([(F.lit(0), F.lit(0)), (F.lit(0), w - size), (h - size, F.lit(0)), (h - size, w - size)])))


def cropped(px: DataFrame, places: DataFrame, size: int) -> DataFrame:
    """px inside of places(scene_id, crop, r0, c0), with pr and pc, the pixel's place in its crop. Crops are few a scene."""
    x = px.join(F.broadcast(places.withColumnRenamed("scene_id", "_scene")), F.col("scene_id") == F.col("_scene")).drop("_scene")
    inside = F.col("r").between(F.col("r0"), F.col("r0") + size - 1) & F.col("c").between(F.col("c0"), F.col("c0") + size - 1)
    return x.where(inside).withColumns({"pr": F.col("r") - F.col("r0"), "pc": F.col("c") - F.col("c0")}).drop("r0", "c0")


def pooled(*pools: DataFrame) -> DataFrame:
    """One pool of several, whose spectra must have one length by then: harmonise them first."""
    out = pools[0]
    for p in pools[1:]:
        out = out.unionByName(p)
    widths = out.agg(F.countDistinct(F.size("spectrum")).alias("_widths"))
    ok = F.when(F.col("_widths") <= 1, F.lit(True)).otherwise(F.raise_error(F.lit("the pools have different bands")))
    return out.join(F.broadcast(widths), F.lit(True)).where(ok).drop("_widths")  # one row


def split_by_scene(px: DataFrame, *, share: float = 0.2, seed: int = 0, by: str = "scene_id") -> DataFrame:
    """px with split = val or train: the scenes whose seeded digests come first are val, that share of them (rounded up); no scene is in both."""
    order = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.md5(F.concat_ws("/", F.lit(str(seed)), by)), by))
    scenes = px.select(by).distinct().withColumn("_i", order).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))  # one row a scene
    named = scenes.select(F.col(by).alias("_by"), F.when(F.col("_i") <= F.ceil(F.col("_n") * share), "val").otherwise("train").alias("split"))
    return px.join(named, F.col(by) == F.col("_by")).drop("_by")


def held_out(source: str, split: str, *, wavelengths: bool) -> None:
    """Real scenes serve evaluation alone, and only with wavelengths: anything else raises."""
    if split != "eval":
        raise ValueError(f"real scenes are for evaluation, not for {split}")
    if not wavelengths:
        raise ValueError(f"{source} has no wavelengths and can't be harmonised")


def scan_windows(h: int, w: int, patch: int, stride: int | None = None) -> list[tuple[int, int, int]]:
    """(turn, r0, c0) of a scan in row order; windows with a side under two pixels are left out."""
    step = stride or patch
    places = [(r, c) for r in range(0, h, step) for c in range(0, w, step) if min(r + patch, h) - r >= 2 and min(c + patch, w) - c >= 2]
    return [(k, r, c) for k, (r, c) in enumerate(places)]


def predicted(px: DataFrame, windows: DataFrame, patch: int, model: Model) -> DataFrame:
    """scene_id, turn, r, c, prob: the model's answer for every pixel of windows(scene_id, turn, r0, c0); a missing pixel has none."""
    ship(px.sparkSession)
    # A pixel meets the windows of its cell of the grid and of the cells before it: an equi-join on cells.
    cell = lambda x: F.floor(x / patch).cast("long")
    covers = F.array(F.lit(0), F.lit(1))
    w = windows.select(F.col("scene_id").alias("_scene"), "turn", "r0", "c0", F.explode(covers).alias("_i"), F.lit(0).alias("_z")).select("_scene", "turn", "r0", "c0", (cell(F.col("r0")) + F.col("_i")).alias("_wr"), F.explode(covers).alias("_j")).withColumn("_wc", cell(F.col("c0")) + F.col("_j"))
    x = px.select("scene_id", "r", "c", "spectrum", cell(F.col("r")).alias("_pr"), cell(F.col("c")).alias("_pc"))
    x = x.join(w, (F.col("scene_id") == F.col("_scene")) & (F.col("_pr") == F.col("_wr")) & (F.col("_pc") == F.col("_wc")))
    x = x.where(F.col("r").between(F.col("r0"), F.col("r0") + patch - 1) & F.col("c").between(F.col("c0"), F.col("c0") + patch - 1))

    def run(batches):
        for table, window in whole_groups(batches, ["scene_id", "turn", "r0", "c0"], HELD // patch**2):
            r, c = (table[x].to_numpy() - table[f"{x}0"].to_numpy() for x in "rc")
            spectra = table["spectrum"].combine_chunks()
            n = pc.fill_null(pc.list_value_length(spectra), 0).to_numpy(zero_copy_only=False)
            given = spectra.is_valid().to_numpy(zero_copy_only=False)
            start = np.flatnonzero(np.diff(window, prepend=-1))
            bands = np.ones(len(start), np.int64)
            bands[window[given]] = n[given]
            prob = np.full(len(window), np.nan)
            for b in np.unique(bands):  # windows with as many bands go to the model together, so many that an array stays small
                alike = np.flatnonzero(bands == b)
                for some in np.array_split(alike, -(-len(alike) * patch**2 * int(b) // HELD)):
                    place = np.full(len(start), -1)
                    place[some] = np.arange(len(some))
                    rows = np.flatnonzero((place[window] >= 0) & given)
                    cube = np.full((len(some), patch, patch, b), np.nan)
                    cube[place[window[rows]], r[rows], c[rows]] = spectra.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), b)
                    prob[rows] = np.asarray(model(cube), float)[place[window[rows]], r[rows], c[rows]]
            yield pa.RecordBatch.from_pydict({x: table[x].combine_chunks() for x in ("scene_id", "turn", "r", "c")} | {"prob": prob})

    keys = ["scene_id", "turn", "r0", "c0"]
    together = x.select(*keys, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("spectrum").cast("array<double>").alias("spectrum")).repartition(*keys).sortWithinPartitions(*keys)
    out = together.mapInArrow(run, "scene_id string, turn bigint, r bigint, c bigint, prob double")
    return out.withColumn("prob", F.when(~F.isnan("prob"), F.col("prob")))


def scanned(px: DataFrame, h: int, w: int, patch: int, model: Model, *, stride: int | None = None) -> DataFrame:
    """scene_id, r, c, prob over whole scenes of a size: where windows overlap, the last one counts."""
    places = px.sparkSession.createDataFrame(scan_windows(h, w, patch, stride), "turn long, r0 long, c0 long")
    windows = px.select("scene_id").distinct().crossJoin(F.broadcast(places))  # a grid of windows a scene: as many rows as there are windows
    return predicted(px, windows, patch, model).groupBy("scene_id", "r", "c").agg(F.max_by("prob", "turn").alias("prob"))


def segmented(rois: DataFrame, members: DataFrame, px: DataFrame, windows: DataFrame, patch: int, model: Model) -> DataFrame:
    """roi_id, seg_prob: the mean probability over each region's pixels, of windows(scene_id, turn, r0, c0); of several windows over a pixel the first counts."""
    each = predicted(px, windows, patch, model).where(F.col("prob").isNotNull()).groupBy("scene_id", "r", "c").agg(F.min_by("prob", "turn").alias("prob"))
    found = members.join(each, ["scene_id", "r", "c"]).groupBy("roi_id").agg(F.avg("prob").alias("seg_prob"))
    return rois.select("roi_id").join(found, "roi_id", "left")
