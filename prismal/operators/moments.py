"""Means and covariances of scenes, and what is solved with them.

Two passes, both with partial sums on the map side: the band means, then the
centred cross products of each Arrow batch, summed cell by cell. Centring
first keeps the sums accurate where the means are large. The model is a table
with one row a scene (B + B * B doubles); nothing comes to the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismal.session import ship

MODEL = "scene_id string, n bigint, mean array<double>, whitener array<double>"


def band_means(px: DataFrame) -> DataFrame:
    """scene_id, n, mean: valid pixels only."""
    x = px.where(F.col("spectrum").isNotNull()).select("scene_id", F.posexplode("spectrum").alias("b", "v"))
    x = x.groupBy("scene_id", "b").agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return x.groupBy("scene_id").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("b", "m"))), lambda e: e["m"]).alias("mean"))


def stacked(lists: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def _products(batches):
    for batch in batches:
        scenes = batch.column(0).dictionary_encode()
        codes = scenes.indices.to_numpy(zero_copy_only=False)
        rows = stacked(batch.column(1)) - stacked(batch.column(2)) if batch.num_rows else np.zeros((0, 0))
        names, sums = [], []
        for k, name in enumerate(scenes.dictionary.to_pylist()):
            part = rows[codes == k]
            names.append(name)
            sums.append((part.T @ part).ravel())
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sums, pa.list_(pa.float64()))], names=["scene_id", "p"])


def covariance(px: DataFrame, *, ddof: int = 0) -> DataFrame:
    """scene_id, i, j, v: every cell of each scene's covariance matrix."""
    ship(px.sparkSession)
    means = band_means(px)
    x = px.where(F.col("spectrum").isNotNull()).select("scene_id", "spectrum").join(means, "scene_id")
    parts = x.select("scene_id", "spectrum", "mean").mapInArrow(_products, "scene_id string, p array<double>")
    cells = parts.select("scene_id", F.posexplode("p").alias("k", "v")).groupBy("scene_id", "k").agg(F.sum("v").alias("v"))
    x = cells.join(means.select("scene_id", "n", F.size("mean").alias("_b")), "scene_id")
    return x.select("scene_id", F.expr("k div _b").cast("int").alias("i"), (F.col("k") % F.col("_b")).cast("int").alias("j"), F.try_divide(F.col("v"), F.col("n") - ddof).alias("v"))


def model(px: DataFrame, *, reg: float = 1e-6, relative: bool = True) -> DataFrame:
    """One row a scene: mean and the inverse Cholesky factor of covariance + ridge, row by row.

    The ridge is reg, times the mean variance if `relative`. The matrix is
    factored, never inverted: the whitener solves L z = x - mean.
    """
    cells = covariance(px)
    means = band_means(px)

    def solve(cell: pd.DataFrame) -> pd.DataFrame:
        size = int(cell["i"].max()) + 1
        sigma = np.zeros((size, size))
        sigma[cell["i"], cell["j"]] = cell["v"]
        ridge = reg * (np.trace(sigma) / size if relative else 1.0)
        factor = np.linalg.cholesky(sigma + ridge * np.eye(size))
        return pd.DataFrame({"scene_id": [cell["scene_id"].iloc[0]], "whitener": [np.linalg.solve(factor, np.eye(size)).ravel()]})

    solved = cells.groupBy("scene_id").applyInPandas(solve, "scene_id string, whitener array<double>")
    return means.join(solved, "scene_id").select("scene_id", "n", "mean", "whitener")


#: Pixels of one scene that a task scores at a time, roughly.
CHUNK = 8192


def whitened(px: DataFrame, fitted: DataFrame, score, *, extra: list[str] = (), out: str = "score") -> DataFrame:
    """px(scene_id, pix, r, c) with score(white pixels, white extras) per pixel; missing pixels stay missing.

    Pixels are dealt into chunks of their scene, and the model (B * B doubles)
    meets each chunk once, not each pixel.
    """
    ship(px.sparkSession)
    keep = ["scene_id", "pix", "r", "c"]
    chunks = F.greatest(F.lit(1), F.ceil(F.col("n") / CHUNK)).cast("long")
    counts = fitted.select(F.col("scene_id").alias("_scene"), chunks.alias("_chunks"))  # one row a scene
    valid = px.where(F.col("spectrum").isNotNull()).join(counts, F.col("scene_id") == F.col("_scene"))
    dealt = valid.select(*keep, "spectrum", F.pmod(F.xxhash64("pix"), "_chunks").alias("_chunk"))
    models = fitted.select(F.col("scene_id").alias("_scene"), "mean", "whitener", *extra, F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("_of"))

    def run(part: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(model):
            return part[keep].iloc[:0].assign(**{out: pd.Series(dtype=float)})
        one = model.iloc[0]
        mean = np.asarray(one["mean"], float)
        whitener = np.asarray(one["whitener"], float).reshape(len(mean), -1)
        white = (np.stack(part["spectrum"].to_list()) - mean) @ whitener.T
        more = [whitener @ (np.asarray(one[e], float) - mean) for e in extra]
        return part[keep].assign(**{out: score(white, *more)})

    scored = dealt.groupBy("scene_id", "_chunk").cogroup(models.groupBy("_scene", "_of")).applyInPandas(run, f"scene_id string, pix bigint, r bigint, c bigint, {out} double")
    missing = px.where(F.col("spectrum").isNull()).select(*keep, F.lit(None).cast("double").alias(out))
    return scored.unionByName(missing)


def standardized(px: DataFrame) -> DataFrame:
    """Each band less its mean over its deviation, by scene; a flat band is divided by 1."""
    x = px.where(F.col("spectrum").isNotNull()).select("scene_id", F.posexplode("spectrum").alias("b", "v"))
    x = x.groupBy("scene_id", "b").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"))
    spread = F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))
    stats = x.groupBy(F.col("scene_id").alias("_scene")).agg(F.array_sort(F.collect_list(F.struct("b", "m", spread.alias("sd")))).alias("_stats"))  # one row a scene
    scaled = F.zip_with("spectrum", "_stats", lambda v, e: (v - e["m"]) / e["sd"])
    return px.join(stats, F.col("scene_id") == F.col("_scene"), "left").withColumn("spectrum", scaled).drop("_scene", "_stats")
