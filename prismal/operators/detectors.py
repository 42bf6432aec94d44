"""Anomaly detectors: pixels in, one score a pixel out; higher is more anomalous.

Each takes px(scene_id, pix, r, c, spectrum) and returns scene_id, pix, r, c,
score. Missing pixels get a missing score and take no part in any statistic.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismal.operators import moments, scoring, windows2d
from prismal.session import ship, stored

KEEP = ["scene_id", "pix", "r", "c"]
#: Pixels that one task of kernel_rx scores against the background at most, roughly.
CHUNK = 8192


def global_rx(px: DataFrame, *, reg: float = 1e-6) -> DataFrame:
    """Squared Mahalanobis distance to the scene's mean."""
    return moments.whitened(px, moments.model(px, reg=reg), lambda white: (white * white).sum(1))


def ace(px: DataFrame, signature: DataFrame, *, reg: float = 1e-6) -> DataFrame:
    """Squared cosine to a signature(scene_id, b, v) in whitened space, within [0, 1]."""
    fitted = moments.model(px, reg=reg, relative=False)
    rows = signature.groupBy("scene_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "v"))), lambda e: e["v"]).alias("signature"))

    def score(white, target):
        below = (white * white).sum(1) * (target @ target)
        return np.clip(np.divide((white @ target) ** 2, below, out=np.zeros(len(white)), where=below > 0), 0, 1)

    return moments.whitened(px, fitted.join(rows, "scene_id"), score, extra=["signature"])


def _tiled(px: DataFrame, halo: int, tile: int) -> DataFrame:
    """Each pixel once for every tile whose halo holds it: _tr, _tc."""
    def span(col: str):
        return F.sequence(F.floor((F.col(col) - halo) / tile).cast("long"), F.floor((F.col(col) + halo) / tile).cast("long"))

    return px.select(*KEEP, "spectrum", F.explode(span("r")).alias("_tr")).select(*KEEP, "spectrum", "_tr", F.explode(span("c")).alias("_tc"))


def _per_tile(px: DataFrame, halo: int, tile: int, score) -> DataFrame:
    """score(cube, valid, rows, cols) -> [rows, cols] for the pixels of each tile, with `halo` pixels around it at hand.

    A task holds one tile with its halo, (tile + 2 halo) ** 2 pixels at most.
    """
    ship(px.sparkSession)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        own = (part["r"] // tile == part["_tr"]) & (part["c"] // tile == part["_tc"])
        if not own.any():
            return pd.DataFrame({"scene_id": [], "pix": [], "r": [], "c": [], "score": []}).astype({"scene_id": object})
        r0, c0 = int(part["r"].min()), int(part["c"].min())
        shape = (int(part["r"].max()) - r0 + 1, int(part["c"].max()) - c0 + 1)
        bands = next((len(s) for s in part["spectrum"] if s is not None), 1)
        cube, valid = np.zeros((*shape, bands)), np.zeros(shape, bool)
        for r, c, s in zip(part["r"], part["c"], part["spectrum"]):
            if s is not None:
                cube[r - r0, c - c0], valid[r - r0, c - c0] = s, True
        rows, cols = part.loc[own, "r"].to_numpy() - r0, part.loc[own, "c"].to_numpy() - c0
        mine = part.loc[own, KEEP]
        return pd.DataFrame({k: mine[k].to_list() for k in KEEP} | {"score": pd.Series([score(cube, valid, r, c) for r, c in zip(rows, cols)], dtype=float)})

    return _tiled(px, halo, tile).groupBy("scene_id", "_tr", "_tc").applyInPandas(run, "scene_id string, pix bigint, r bigint, c bigint, score double")


def _ring(valid: np.ndarray, r: int, c: int, inner: int, outer: int):
    """Valid places of the square ring around (r, c), cut at the borders."""
    o, i = outer // 2, inner // 2
    r0, c0 = max(0, r - o), max(0, c - o)
    box = valid[r0 : r + o + 1, c0 : c + o + 1].copy()
    box[max(0, r - i) - r0 : r + i + 1 - r0, max(0, c - i) - c0 : c + i + 1 - c0] = False
    rows, cols = np.nonzero(box)
    return rows + r0, cols + c0


def _ring_checked(inner: int, outer: int) -> None:
    if not (inner % 2 and outer % 2 and 0 < inner < outer):
        raise ValueError("inner and outer are odd, inner the smaller")


def local_rx(px: DataFrame, *, inner: int = 5, outer: int = 21, reg: float = 1e-4, components: int = 20, tile: int = 64) -> DataFrame:
    """Mahalanobis distance to the ring around each pixel, after a projection onto the scene's first principal components.

    NULL where fewer than 2 * components ring pixels are valid.
    """
    _ring_checked(inner, outer)
    reduced = projected(px, components)

    def score(cube, valid, r, c):
        size = cube.shape[2]
        rows, cols = _ring(valid, r, c, inner, outer)
        if not valid[r, c] or len(rows) < 2 * size:
            return None
        ring = cube[rows, cols]
        mean = ring.mean(0)
        sigma = (ring - mean).T @ (ring - mean) / len(ring) + reg * np.eye(size)
        gap = cube[r, c] - mean
        return float(gap @ np.linalg.solve(sigma, gap))

    return _per_tile(reduced, outer // 2, tile, score)


def projected(px: DataFrame, components: int) -> DataFrame:
    """px with the spectrum replaced by its first principal components; each axis points to its largest loading."""
    ship(px.sparkSession)

    def axes(cell: pd.DataFrame) -> pd.DataFrame:
        size = int(cell["i"].max()) + 1
        sigma = np.zeros((size, size))
        sigma[cell["i"], cell["j"]] = cell["v"]
        vectors = np.linalg.eigh(sigma)[1][:, ::-1][:, :components]
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
        return pd.DataFrame({"scene_id": [cell["scene_id"].iloc[0]], "axes": [[list(v) for v in vectors.T]]})

    fitted = moments.covariance(px).groupBy("scene_id").applyInPandas(axes, "scene_id string, axes array<array<double>>").join(moments.band_means(px), "scene_id")
    x = px.select(*KEEP, "spectrum").join(fitted, "scene_id", "left")
    centred = F.zip_with("spectrum", "mean", lambda a, m: a - m)
    spectrum = F.transform("axes", lambda axis: F.aggregate(F.zip_with(centred, axis, lambda a, v: a * v), F.lit(0.0), lambda t, v: t + v))
    return x.select(*KEEP, F.when(F.col("spectrum").isNotNull(), spectrum).alias("spectrum"))


def crd(px: DataFrame, *, inner: int = 5, outer: int = 15, lam: float = 1e-2, tile: int = 32) -> DataFrame:
    """Length of what the ring around a pixel can't represent: neighbours are weighed by their distance to it."""
    _ring_checked(inner, outer)

    def score(cube, valid, r, c):
        if not valid[r, c]:
            return None
        y = cube[r, c]
        rows, cols = _ring(valid, r, c, inner, outer)
        if not len(rows):
            return float(np.linalg.norm(y))
        ring = cube[rows, cols]
        gram = ring @ ring.T
        gram[np.diag_indices(len(ring))] += lam * ((ring - y) ** 2).sum(1) + 1e-9
        return float(np.linalg.norm(y - ring.T @ np.linalg.solve(gram, ring @ y)))

    return _per_tile(px, outer // 2, tile, score)


def kernel_rx(px: DataFrame, *, gamma: float | None = None, n_background: int = 2000, reg: float = 1e-2, seed: int = 0) -> DataFrame:
    """RX in the feature space of an RBF kernel, over a bounded background sample of each scene.

    The sample is the `n_background` valid pixels with the smallest seeded
    hashes. A scene is scored in chunks of pixels, each of which factors the
    sample's centred kernel matrix once. gamma defaults to one over twice the
    median squared distance inside the sample, equal pixels included, and to 1
    where that is 0.
    """
    from pyspark.sql import Window

    ship(px.sparkSession)
    valid = px.where(F.col("spectrum").isNotNull())
    number = F.xxhash64("pix", F.lit(seed))
    sizes = valid.groupBy("scene_id").agg(F.count(F.lit(1)).alias("_size")).withColumn("_chunks", F.ceil(F.col("_size") / F.lit(CHUNK)))
    sized = valid.join(sizes, "scene_id")
    # Twice the pixels that are needed, and 100, lie under this bound, whatever the scene's size: only they are sorted.
    low = sized.where(number.cast("double") <= F.lit(-(2.0**63)) + F.lit(2.0**64 * (2 * n_background + 100)) / F.col("_size"))
    turn = F.row_number().over(Window.partitionBy("scene_id").orderBy(number, "pix"))
    sample = low.select("scene_id", "pix", "spectrum", "_chunks").withColumn("_i", turn).where(F.col("_i") <= n_background)  # n_background rows a scene at most
    dealt = sized.select(*KEEP, "spectrum", F.pmod(F.xxhash64("pix", F.lit(~seed)), "_chunks").alias("_chunk"))
    backgrounds = sample.select(F.col("scene_id").alias("_scene"), F.col("pix").alias("_pix"), F.col("spectrum").alias("_spectrum"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1)).alias("_of"))

    def gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        size = (a * a).sum(1)[:, None] + (b * b).sum(1)
        found = size - 2 * a @ b.T
        return np.where(found > 1e-12 * size, found, 0)

    def run(part: pd.DataFrame, background: pd.DataFrame) -> pd.DataFrame:
        mine = part[KEEP]
        if not len(part):
            return mine.assign(score=pd.Series(dtype=float))
        b = np.stack(background.sort_values("_pix")["_spectrum"].to_list())
        n, squared = len(b), gaps(b, b)
        middle = float(np.median(squared[np.triu_indices(n, 1)])) if n > 1 else 0.0
        g = gamma or (1 / (2 * middle) if middle > 0 else 1.0)
        kernel = np.exp(-g * squared)
        means = kernel.mean(0)
        # Of (covariance + reg) in feature space only the sample's kernel matrix has to be factored (Woodbury).
        factor = np.linalg.inv(np.linalg.cholesky(kernel - means - means[:, None] + means.mean() + n * reg * np.eye(n)))
        score = np.zeros(len(part))
        for k in range(0, len(part), 512):
            x = np.stack(part["spectrum"].iloc[k : k + 512].to_list())
            row = np.exp(-g * gaps(x, b))
            own = row.mean(1)
            length = 1 - 2 * own + means.mean()  # of the pixel less the mean, in feature space
            explained = (((row - own[:, None] - means + means.mean()) @ factor.T) ** 2).sum(1)
            score[k : k + 512] = (length - explained) / reg
        return mine.assign(score=score)

    scored = dealt.groupBy("scene_id", "_chunk").cogroup(backgrounds.groupBy("_scene", "_of")).applyInPandas(run, "scene_id string, pix bigint, r bigint, c bigint, score double")
    return scored.unionByName(px.where(F.col("spectrum").isNull()).select(*KEEP, F.lit(None).cast("double").alias("score")))


def ring_params(h: int, w: int) -> dict:
    """Ring and components of local RX for a scene of this size: small scenes would starve the wide ring."""
    return {"inner": 3, "outer": 15, "components": 12} if min(h, w) <= 64 else {}


def fused(px: DataFrame, *, local: dict | None = None, top: float = 0.001, k: int = 7, index: DataFrame | None = None, weights: dict[str, float] = scoring.WEIGHTS) -> DataFrame:
    """Local RX, ACE against the best pixels of global RX, and the spatial context of global RX, fused by rank.

    index(scene_id, pix, index) joins in where the scene has wavelengths; a component that is absent is left out, never filled.
    """
    base = stored(global_rx(px), "base")
    parts = base.select(*KEEP).join(local_rx(px, **(local or {})).select("scene_id", "pix", F.col("score").alias("rx")), ["scene_id", "pix"])
    parts = parts.join(ace(px, scoring.target_signature(px, base, top=top)).select("scene_id", "pix", F.col("score").alias("ace")), ["scene_id", "pix"])
    parts = parts.join(windows2d.spatial_context(base, k=k).select("scene_id", "pix", F.col("context").alias("spatial")), ["scene_id", "pix"])
    names = ["ace", "rx", "spatial"]
    if index is not None:
        parts, names = parts.join(index, ["scene_id", "pix"]), ["ace", "index", "rx", "spatial"]
    return scoring.fused(stored(parts, "components"), names, weights=weights).select(*KEEP, "score")


#: name -> pixels to scores.
DETECTORS = {"global_rx": global_rx, "local_rx": local_rx, "crd": crd, "kernel_rx": kernel_rx, "fused": fused}


def detect(name: str, px: DataFrame, **params) -> DataFrame:
    if name not in DETECTORS:
        raise KeyError(f"{name} is none of {sorted(DETECTORS)}")
    return DETECTORS[name](px, **params)
