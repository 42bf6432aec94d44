"""Shifts between two epochs of a scene, below a pixel: phase correlation of their mean bands, then a bilinear move.

A task has one scene of both epochs: a Fourier transform needs it whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismal.session import ship

KEY = ["scene_id", "pix", "r", "c"]


def panchromatic(px: DataFrame) -> DataFrame:
    """scene_id, pix, r, c, v: the mean over bands; a missing pixel has the scene's mean."""
    x = px.select(*KEY, (F.aggregate("spectrum", F.lit(0.0), lambda t, v: t + v) / F.size("spectrum")).alias("v"))
    middle = x.groupBy(F.col("scene_id").alias("_scene")).agg(F.avg("v").alias("_m"))
    return x.join(middle, F.col("scene_id") == F.col("_scene")).withColumn("v", F.coalesce("v", "_m")).drop("_scene", "_m")


def shift_of(a: np.ndarray, b: np.ndarray, *, upsample: int = 20) -> tuple[float, float]:
    """(rows, columns) by which b must be moved to lie on a, to 1 / upsample of a pixel."""
    product = np.fft.fft2(a - a.mean()) * np.fft.fft2(b - b.mean()).conj()
    product /= np.maximum(np.abs(product), 1e-12)
    peak = np.unravel_index(np.abs(np.fft.ifft2(product)).argmax(), a.shape)
    whole = np.array([p - n if p > n // 2 else p for p, n in zip(peak, a.shape)], float)
    # Around the peak the correlation is evaluated on a fine grid by two small matrix products.
    fine = np.arange(-upsample, upsample + 1) / upsample
    rows = np.exp(2j * np.pi * np.outer(whole[0] + fine, np.fft.fftfreq(a.shape[0])))
    cols = np.exp(2j * np.pi * np.outer(np.fft.fftfreq(a.shape[1]), whole[1] + fine))
    i, j = np.unravel_index(np.abs(rows @ product @ cols).argmax(), (len(fine), len(fine)))
    return float(whole[0] + fine[i]), float(whole[1] + fine[j])


def moved(cube: np.ndarray, dr: float, dc: float) -> np.ndarray:
    """cube[h, w, ...] moved by (dr, dc), bilinear; what comes from outside or from missing pixels is NaN."""
    h, w = cube.shape[:2]
    r, c = np.meshgrid(np.arange(h) - dr, np.arange(w) - dc, indexing="ij")
    r0, c0 = np.floor(r).astype(int), np.floor(c).astype(int)
    out = np.zeros(cube.shape)
    for i, j in ((0, 0), (0, 1), (1, 0), (1, 1)):
        weight = (1 - abs(r - (r0 + i))) * (1 - abs(c - (c0 + j)))
        inside = (r0 + i >= 0) & (r0 + i < h) & (c0 + j >= 0) & (c0 + j < w)
        value = np.where(inside[..., None], cube[np.clip(r0 + i, 0, h - 1), np.clip(c0 + j, 0, w - 1)], np.nan)
        out += np.where(weight[..., None] > 1e-12, weight[..., None] * value, 0)
    return out


def _grid(part: pd.DataFrame, column: str, shape: tuple[int, int], bands: int) -> np.ndarray:
    cube = np.full((*shape, bands), np.nan)
    given = [k for k, s in enumerate(part[column]) if s is not None]
    cube[part["r"].to_numpy()[given], part["c"].to_numpy()[given]] = np.array([part[column].iloc[k] for k in given], float)
    return cube


def coregistered(t1: DataFrame, t2: DataFrame, *, upsample: int = 20, most_rmse: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(t2 on t1's grid, report): report(scene_id, dr, dc, rmse), rmse being the shift that is left after the move, in pixels; more than most_rmse raises."""
    ship(t1.sparkSession)
    both = t1.select(*KEY, F.col("spectrum").alias("s1")).join(t2.select("scene_id", "pix", F.col("spectrum").alias("s2")), ["scene_id", "pix"]).select(*KEY, "s1", "s2")

    def align(part: pd.DataFrame):
        shape = (int(part["r"].max()) + 1, int(part["c"].max()) + 1)
        bands = len(next(s for s in part["s1"] if s is not None))
        a, b = _grid(part, "s1", shape, bands), _grid(part, "s2", shape, bands)

        def grey(cube):
            g = cube.mean(2)
            return np.where(np.isnan(g), np.nanmean(g), g)

        dr, dc = shift_of(grey(a), grey(b), upsample=upsample)
        out = moved(b, dr, dc)
        left = shift_of(grey(a), grey(out), upsample=upsample)
        rmse = float(np.hypot(*left))
        if rmse > most_rmse:
            raise ValueError(f"{part['scene_id'].iloc[0]}: {rmse} pixels are left after registration")
        return out, dr, dc, rmse

    def cube_of(part: pd.DataFrame) -> pd.DataFrame:
        out, *_ = align(part)
        values = out[part["r"].to_numpy(), part["c"].to_numpy()]
        return part[KEY].assign(spectrum=[None if np.isnan(v).any() else [float(x) for x in v] for v in values])

    def report_of(part: pd.DataFrame) -> pd.DataFrame:
        _, dr, dc, rmse = align(part)
        return pd.DataFrame({"scene_id": [part["scene_id"].iloc[0]], "dr": [dr], "dc": [dc], "rmse": [rmse]})

    cube = both.groupBy("scene_id").applyInPandas(cube_of, "scene_id string, pix bigint, r bigint, c bigint, spectrum array<double>")
    return cube, both.groupBy("scene_id").applyInPandas(report_of, "scene_id string, dr double, dc double, rmse double")
