"""Queries on crops, splits and models that see windows. The models are plain functions of a window, so that SQL can follow."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismal.operators import patches
from prismal.plans.dialect import GR, PX, Q, q
from prismal.plans.queries import _C8, _labelled
from prismal.plans.registry import query
from prismal.sources import scenes


def _window_mean(cube: np.ndarray) -> np.ndarray:
    """Each pixel over its window's mean."""
    grey = cube[..., 0]
    return grey / np.nanmean(grey, axis=(1, 2), keepdims=True)


def _grid(spark, d):
    return scenes.score_map(spark, d).withColumn("spectrum", F.array("score"))


@query(f"WITH {PX}, o AS (SELECT * FROM (VALUES (0, 0, 0), (1, 0, 17), (2, 12, 0), (3, 12, 17)) t(crop, r0, c0)) SELECT crop, r - r0 AS pr, c - c0 AS pc, {Q('s[1]')} AS v FROM px JOIN o ON r BETWEEN r0 AND r0 + 7 AND c BETWEEN c0 AND c0 + 7")
def corner_patches(spark, d) -> DataFrame:
    """Four crops of eight pixels, one in each corner of a scene of 20 x 25."""
    px = scenes.pixels(spark, d)
    places = px.select("scene_id").distinct().select("scene_id", F.explode(patches.four_corners(F.lit(20), F.lit(25), 8)).alias("p")).select("scene_id", "p.*")
    return patches.cropped(px, places, 8).select("crop", "pr", "pc", q(F.get("spectrum", F.lit(0))).alias("v"))


@query("WITH s AS (SELECT DISTINCT c_nationkey AS k FROM customer), o AS (SELECT k, row_number() OVER (ORDER BY md5('0/' || k), CAST(k AS VARCHAR)) AS i, count(*) OVER () AS n FROM s) SELECT k, CASE WHEN i <= ceil(n * 0.2) THEN 'val' ELSE 'train' END AS split, count(*) AS n_px FROM customer JOIN o ON k = c_nationkey GROUP BY 1, 2")
def scene_split(spark, d) -> DataFrame:
    x = scenes.table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("scene_id"))
    return patches.split_by_scene(x).groupBy(F.col("scene_id").cast("long").alias("k"), "split").agg(F.count(F.lit(1)).alias("n_px"))


@query(f"WITH {PX} SELECT label % 2 AS pool, count(*) AS n, CAST(64 AS INTEGER) AS bands FROM px GROUP BY 1")
def pooled_patches(spark, d) -> DataFrame:
    px = scenes.pixels(spark, d)
    both = patches.pooled(px.where("label % 2 = 0"), px.where("label % 2 = 1"))
    return both.groupBy((F.col("label") % 2).alias("pool")).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("spectrum")).alias("bands"))


_TILE = "(SELECT wr, wc, row_number() OVER (ORDER BY wr, wc) AS turn FROM (SELECT unnest(range(0, 40, 6)) AS wr), (SELECT unnest(range(0, 100, 6)) AS wc) WHERE least(wr + 8, 40) - wr >= 2 AND least(wc + 8, 100) - wc >= 2)"


@query(f"WITH {GR}, g AS (SELECT * FROM gr WHERE r < 40), w AS (SELECT * FROM {_TILE}), p AS (SELECT g.r, g.c, turn, score / avg(score) OVER (PARTITION BY turn) AS prob FROM g JOIN w ON r BETWEEN wr AND wr + 7 AND c BETWEEN wc AND wc + 7) SELECT r, c, {Q('arg_max(prob, turn)')} AS prob FROM p GROUP BY 1, 2")
def patch_scan(spark, d) -> DataFrame:
    """A model over windows of eight pixels every six: the last window over a pixel counts."""
    x = patches.scanned(_grid(spark, d).where("r < 40"), 40, 100, 8, _window_mean, stride=6)
    return x.select("r", "c", q(F.col("prob")).alias("prob"))


@query(f"WITH RECURSIVE {_C8}, w AS (SELECT wr, wc, row_number() OVER (ORDER BY wr, wc) AS turn FROM (SELECT DISTINCT (r // 5) * 5 AS wr, (c // 5) * 5 AS wc FROM lb)), p AS (SELECT g.r, g.c, turn, g.score / avg(g.score) OVER (PARTITION BY turn) AS prob FROM gr g JOIN w ON g.r BETWEEN wr AND wr + 7 AND g.c BETWEEN wc AND wc + 7), f AS (SELECT r, c, arg_min(prob, turn) AS prob FROM p GROUP BY 1, 2) SELECT lb.label, {Q('avg(prob)')} AS seg_prob FROM lb JOIN f USING (r, c) GROUP BY 1")
def segmented_rois(spark, d) -> DataFrame:
    """A model over windows that cover the regions, and its mean over each region: the first window over a pixel counts."""
    from pyspark.sql import Window

    labelled = _labelled(spark, d)
    members = labelled.select(F.col("label").cast("string").alias("roi_id"), "scene_id", "r", "c")
    corners = labelled.select("scene_id", F.expr("r div 5 * 5").alias("r0"), F.expr("c div 5 * 5").alias("c0")).distinct()
    windows = corners.withColumn("turn", F.row_number().over(Window.partitionBy("scene_id").orderBy("r0", "c0")).cast("long"))
    rois = members.select("roi_id").distinct()
    x = patches.segmented(rois, members, _grid(spark, d), windows, 8, _window_mean)
    return x.select(F.col("roi_id").cast("long").alias("label"), q(F.col("seg_prob")).alias("seg_prob"))
