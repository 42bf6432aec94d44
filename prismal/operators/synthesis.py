"""Made scenes: implanted targets, pseudo anomalies, change pairs. Blobs are a small table; what they do to pixels is an expression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PERTURBATIONS = ("shift", "scale", "swap", "noise")


def random_blob(rng: np.random.Generator, h: int, w: int, area: int, taken: np.ndarray, *, tries: int = 2000) -> np.ndarray:
    """[pixels, 2]: a connected piece of up to `area` pixels that isn't taken, grown pixel by pixel from a random place."""
    free = np.argwhere(~taken)
    if not len(free):
        return np.zeros((0, 2), int)
    seed = tuple(int(v) for v in free[rng.integers(len(free))])
    blob, edge = {seed}, [seed]
    for _ in range(tries):
        if len(blob) >= area or not edge:
            break
        k = int(rng.integers(len(edge)))
        r, c = edge[k]
        ways = [(r + i, c + j) for i, j in ((-1, 0), (1, 0), (0, -1), (0, 1)) if 0 <= r + i < h and 0 <= c + j < w and not taken[r + i, c + j] and (r + i, c + j) not in blob]
        if not ways:
            edge.pop(k)
            continue
        new = ways[int(rng.integers(len(ways)))]
        blob.add(new)
        edge.append(new)
    return np.array(sorted(blob))


def blobs(spark: SparkSession, h: int, w: int, n: int, *, sizes: tuple[int, int] = (1, 40), abundances: tuple[float, float] = (0.1, 1.0), n_spectra: int = 1, seed: int = 0, scene_id: str = "scene0") -> DataFrame:
    """scene_id, target, r, c, abundance, spectrum_id: up to n blobs that don't overlap, a row a pixel. Bounded by n and the largest size."""
    rng, taken, rows = np.random.default_rng(seed), np.zeros((h, w), bool), []
    for target in range(n):
        blob = random_blob(rng, h, w, int(rng.integers(sizes[0], sizes[1] + 1)), taken)
        abundance, spectrum = float(rng.uniform(*abundances)), int(rng.integers(n_spectra))
        for r, c in blob.tolist():
            taken[r, c] = True
            rows.append((scene_id, target, r, c, abundance, spectrum))
    return spark.createDataFrame(rows, "scene_id string, target int, r long, c long, abundance double, spectrum_id int")


def mixed(target: Column, background: Column, abundance: Column) -> Column:
    """abundance * target + (1 - abundance) * background, band by band."""
    return F.zip_with(target, background, lambda t, s: abundance * t + (1 - abundance) * s)


def implanted(px: DataFrame, placed: DataFrame, spectra: DataFrame) -> DataFrame:
    """px with the blobs' spectra(spectrum_id, target_spectrum) mixed in, and m = 1 where that was done. Spectra of another length raise."""
    what = placed.join(spectra, "spectrum_id").select("scene_id", "r", "c", "abundance", "target_spectrum")
    x = px.join(F.broadcast(what), ["scene_id", "r", "c"], "left")  # as many rows as the blobs have pixels
    fits = F.when(F.size("target_spectrum") == F.size("spectrum"), mixed(F.col("target_spectrum"), F.col("spectrum"), F.col("abundance"))).otherwise(F.raise_error(F.lit("target and background have different bands")))
    changed = F.col("target_spectrum").isNotNull() & F.col("spectrum").isNotNull()
    return x.withColumn("spectrum", F.when(changed, fits).otherwise(F.col("spectrum"))).withColumn("m", F.col("target_spectrum").isNotNull().cast("int")).drop("abundance", "target_spectrum")


def targets_of(placed: DataFrame) -> DataFrame:
    """One row a target: abundance, spectrum, centre, size."""
    return placed.groupBy("scene_id", "target").agg(F.first("abundance").alias("abundance"), F.first("spectrum_id").alias("spectrum_id"), F.avg("r").alias("centre_r"), F.avg("c").alias("centre_c"), F.count(F.lit(1)).alias("area"))


def gained(px: DataFrame, gain: float) -> DataFrame:
    """All values times 1 + gain, never below 0; a gain of 0 changes nothing."""
    return px if gain == 0 else px.withColumn("spectrum", F.transform("spectrum", lambda v: F.greatest(F.lit(0.0), v * (1 + gain))))


def change_pair(px: DataFrame, placed: DataFrame, spectra: DataFrame, *, gain: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(t1, t2): the scene, and the same under another light with targets in it."""
    return px, implanted(gained(px, gain), placed, spectra)


def smoothed(values: Column, taps: int = 5) -> Column:
    """Moving mean of `taps` values; beyond the ends there is 0."""
    half = taps // 2
    return F.transform(values, lambda _, i: sum((F.coalesce(F.when(i + k >= 0, F.get(values, i + k)), F.lit(0.0)) for k in range(-half, half + 1)), F.lit(0.0)) / taps)


def perturbed(px: DataFrame, placed: DataFrame, *, kind: str = "mixed", seed: int = 0, donors: DataFrame | None = None) -> DataFrame:
    """px with pseudo anomalies in the blobs and m = 1 there: an offset in proportion to each band's spread, a gain, another pixel's spectrum, or noise smoothed along the bands.

    "mixed" draws one of them for each blob. Draws are hashes of the seed, the blob, the pixel and the band, the same
    on every run. donors(spectrum) are spectra to swap in, a small table; without it the scene's own pixels serve.
    """
    if kind != "mixed" and kind not in PERTURBATIONS:
        raise ValueError(f"{kind} is none of {PERTURBATIONS}")
    x = px.join(F.broadcast(placed.select("scene_id", "r", "c", "target")), ["scene_id", "r", "c"], "left")  # as many rows as the blobs have pixels
    bands = px.select("scene_id", F.posexplode("spectrum").alias("b", "v")).groupBy("scene_id", "b").agg(F.stddev_pop("v").alias("sd"))
    spread = bands.groupBy("scene_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("b", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0).alias("sd")))), lambda e: e["sd"]).alias("_sd"))  # one row a scene
    pool = donors if donors is not None else px.where(F.col("spectrum").isNotNull()).orderBy(F.xxhash64("pix", F.lit(seed))).limit(16).select("spectrum")
    held = pool.agg(F.array_sort(F.collect_list("spectrum")).alias("_pool"))  # one row of a few spectra

    def uniform(*of) -> Column:
        return (F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 30)) + 0.5) / float(1 << 30)

    def normal(*of) -> Column:
        return F.sqrt(-2 * F.log(uniform(F.lit("r"), *of))) * F.cos(2 * np.pi * uniform(F.lit("a"), *of))

    chosen = F.lit(kind) if kind != "mixed" else F.get(F.array(*map(F.lit, PERTURBATIONS)), F.pmod(F.xxhash64(F.lit(seed), F.lit("kind"), "target"), F.lit(4)).cast("int"))
    s, sd = F.col("spectrum"), F.col("_sd")
    noise = smoothed(F.transform(sd, lambda d, i: 0.5 * d * normal("target", "pix", i)))
    new = (
        F.when(F.col("_kind") == "shift", F.zip_with(s, F.transform(sd, lambda d, i: d * normal("target", i)), lambda v, n: v + n))
        .when(F.col("_kind") == "scale", F.transform(s, lambda v: v * (0.5 + 1.5 * uniform("target"))))
        .when(F.col("_kind") == "swap", F.get("_pool", F.pmod(F.xxhash64(F.lit(seed), F.lit("swap"), "target"), F.size("_pool")).cast("int")))
        .otherwise(F.zip_with(s, noise, lambda v, n: v + n))
    )
    x = x.join(F.broadcast(spread), "scene_id", "left").join(F.broadcast(held), F.lit(True)).withColumn("_kind", chosen)  # one row a scene, one row
    inside = F.col("target").isNotNull()
    return x.withColumn("spectrum", F.when(inside & s.isNotNull(), new).otherwise(s)).withColumn("m", inside.cast("int")).drop("target", "_sd", "_pool", "_kind")
