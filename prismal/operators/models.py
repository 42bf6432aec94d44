"""Estimators: fitted on a bounded sample of a split (it is the feature: some arms cost much a row), then scored on all pixels in parallel.

An arm has fit(X, y) and score(X); higher scores are more anomalous. What is
sent to the executors is the fitted arm, bounded by its training rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismal.operators import moments
from prismal.session import ship

#: Rows that an arm is fitted on at most.
MOST_ROWS = 600


def rbf(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    squared = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(squared, 0))


def scale_gamma(x: np.ndarray) -> float:
    spread = x.var()
    return 1 / (x.shape[1] * spread) if spread > 0 else 1.0


class AutoencoderArm:
    """A small autoencoder of one hidden bottleneck, fitted to background rows by full-batch Adam; the score is the squared error of what it gives back."""

    supervision = "background"

    def __init__(self, *, hidden: int = 16, code: int = 3, epochs: int = 300, rate: float = 1e-2, seed: int = 0) -> None:
        self.hidden, self.code, self.epochs, self.rate, self.seed = hidden, code, epochs, rate, seed

    def _forward(self, x):
        w = self.weights
        h1 = np.tanh(x @ w[0] + w[1])
        z = h1 @ w[2] + w[3]
        h2 = np.tanh(z @ w[4] + w[5])
        return h1, z, h2, h2 @ w[6] + w[7]

    def fit(self, x: np.ndarray, y: np.ndarray) -> AutoencoderArm:
        x = np.asarray(x, float)[np.asarray(y) == 0]
        if not len(x):
            raise ValueError("no background row")
        self.mean, self.spread = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
        x = (x - self.mean) / self.spread
        rng, size = np.random.default_rng(self.seed), x.shape[1]
        shapes = [(size, self.hidden), (self.hidden, self.code), (self.code, self.hidden), (self.hidden, size)]
        self.weights = [w for a, b in shapes for w in (rng.normal(0, np.sqrt(1 / a), (a, b)), np.zeros(b))]
        first, second = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        for step in range(1, self.epochs + 1):
            w = self.weights
            h1, z, h2, out = self._forward(x)
            d_out = 2 * (out - x) / x.size
            d_h2 = (d_out @ w[6].T) * (1 - h2**2)
            d_z = d_h2 @ w[4].T
            d_h1 = (d_z @ w[2].T) * (1 - h1**2)
            slopes = [x.T @ d_h1, d_h1.sum(0), h1.T @ d_z, d_z.sum(0), z.T @ d_h2, d_h2.sum(0), h2.T @ d_out, d_out.sum(0)]
            for k, g in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] = w[k] - self.rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        x = (np.asarray(x, float) - self.mean) / self.spread
        return ((self._forward(x)[3] - x) ** 2).mean(1)


class OneClassArm:
    """One-class support vectors over a kernel, fitted to background rows; the score is the distance outside."""

    supervision = "background"

    def __init__(self, *, nu: float = 0.1, gamma: float | None = None, kernel=None, rounds: int = 20_000) -> None:
        self.nu, self.gamma, self.kernel, self.rounds = nu, gamma, kernel, rounds

    def _gram(self, a, b):
        return self.kernel(a, b) if self.kernel else rbf(a, b, self.g)

    def fit(self, x: np.ndarray, y: np.ndarray) -> OneClassArm:
        x = np.asarray(x, float)[np.asarray(y) == 0]
        if not len(x):
            raise ValueError("no background row")
        n = len(x)
        self.x, self.g = x, self.gamma or scale_gamma(x)
        k = self._gram(x, x)
        most = 1 / (self.nu * n)
        a = np.zeros(n)
        full = int(self.nu * n)
        a[:full] = most
        if full < n:
            a[full] = 1 - full * most
        slope = k @ a
        for _ in range(self.rounds):  # the pair that violates the optimum most, solved exactly
            up, down = np.where(a < most - 1e-12, slope, np.inf), np.where(a > 1e-12, slope, -np.inf)
            i, j = int(up.argmin()), int(down.argmax())
            if slope[j] - slope[i] < 1e-6:
                break
            step = min((slope[j] - slope[i]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12), most - a[i], a[j])
            a[i] += step
            a[j] -= step
            slope += step * (k[:, i] - k[:, j])
        inside = (a > 1e-9) & (a < most - 1e-9)
        self.a = a
        self.rho = float(slope[inside].mean()) if inside.any() else float((slope[a > 1e-9].max() + slope[a < most - 1e-9].min()) / 2 if (a < most - 1e-9).any() else slope.max())
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.rho - self._gram(np.asarray(x, float), self.x) @ self.a


class TwoClassArm:
    """Support vectors between background and anomalies over an RBF kernel, classes weighed by their sizes; the score is the decision value."""

    supervision = "full"

    def __init__(self, *, c: float = 1.0, gamma: float | None = None, rounds: int = 20_000) -> None:
        self.c, self.gamma, self.rounds = c, gamma, rounds

    def fit(self, x: np.ndarray, y: np.ndarray) -> TwoClassArm:
        x, sign = np.asarray(x, float), np.where(np.asarray(y) == 1, 1.0, -1.0)
        if len(set(sign)) < 2:
            raise ValueError("both classes are needed")
        n = len(x)
        self.x, self.g = x, self.gamma or scale_gamma(x)
        k = rbf(x, x, self.g)
        most = np.where(sign > 0, self.c * n / (2 * (sign > 0).sum()), self.c * n / (2 * (sign < 0).sum()))
        a, slope = np.zeros(n), -np.ones(n)
        for _ in range(self.rounds):
            rise = np.where((sign > 0) & (a < most - 1e-12) | (sign < 0) & (a > 1e-12), -sign * slope, -np.inf)
            fall = np.where((sign < 0) & (a < most - 1e-12) | (sign > 0) & (a > 1e-12), -sign * slope, np.inf)
            i, j = int(rise.argmax()), int(fall.argmin())
            if rise[i] - fall[j] < 1e-4:
                break
            step = (rise[i] - fall[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
            step = min(step, most[i] - a[i] if sign[i] > 0 else a[i], a[j] if sign[j] > 0 else most[j] - a[j])
            a[i] += sign[i] * step
            a[j] -= sign[j] * step
            slope += sign * step * (k[:, i] - k[:, j])
        self.w = a * sign
        free = (a > 1e-9) & (a < most - 1e-9)
        value = k @ self.w
        self.b = float((sign - value)[free].mean()) if free.any() else float((sign - value).mean())
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return rbf(np.asarray(x, float), self.x, self.g) @ self.w + self.b


def phase_states(x: np.ndarray, *, reps: int = 2, pairs: bool = True) -> np.ndarray:
    """[rows, 2 ** features] amplitudes of the phase feature map of angles: Hadamards, then phases of single and of paired features, `reps` times."""
    x = np.atleast_2d(np.asarray(x, float))
    n = x.shape[1]
    bits = (np.arange(2**n)[:, None] >> np.arange(n)) & 1
    phase = 2 * x @ bits.T.astype(float)
    if pairs:
        for i in range(n):
            for j in range(i + 1, n):
                phase = phase + 2 * ((np.pi - x[:, i]) * (np.pi - x[:, j]))[:, None] * (bits[:, i] ^ bits[:, j])
    state = np.zeros((len(x), 2**n), complex)
    state[:, 0] = 1
    for _ in range(reps):
        for q in range(n):  # a Hadamard on each feature
            s = state.reshape(len(x), -1, 2, 2**q)
            state = (np.stack([s[:, :, 0] + s[:, :, 1], s[:, :, 0] - s[:, :, 1]], 2) / np.sqrt(2)).reshape(len(x), -1)
        state = state * np.exp(1j * phase)
    return state


def fidelity(a: np.ndarray, b: np.ndarray, *, reps: int = 2, pairs: bool = True) -> np.ndarray:
    """Squared overlaps of the states of two sets of rows."""
    return np.abs(phase_states(a, reps=reps, pairs=pairs) @ phase_states(b, reps=reps, pairs=pairs).conj().T) ** 2


class StateKernelArm(OneClassArm):
    """One-class support vectors over the fidelity of feature states; angles are scaled first."""

    def __init__(self, *, nu: float = 0.1, reps: int = 2, pairs: bool = True, angle_scale: float = 1.0) -> None:
        super().__init__(nu=nu, kernel=self._overlap)
        self.reps, self.pairs, self.angle_scale = reps, pairs, angle_scale

    def _overlap(self, a, b):
        return fidelity(a * self.angle_scale, b * self.angle_scale, reps=self.reps, pairs=self.pairs)


ARMS = {"autoencoder": AutoencoderArm, "one_class": OneClassArm, "two_class": TwoClassArm, "state_kernel": StateKernelArm}


def fitted(arm, split: DataFrame, *, features: str = "features", positive: str = "gt"):
    """The arm fitted on a split of MOST_ROWS rows at most; a larger one raises, for the split's quotas are its bound."""
    rows = split.select(features, positive).limit(MOST_ROWS + 1).toPandas()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a split has {MOST_ROWS} rows at most")
    return arm.fit(np.array(rows[features].to_list(), float), rows[positive].to_numpy().astype(int))


def scored(px: DataFrame, arm, *, features: str = "features", keep: list[str]) -> DataFrame:
    """px's columns `keep` and the arm's score of each row."""
    ship(px.sparkSession)
    schema = px.select(*keep, F.lit(0.0).alias("score")).schema

    def run(batches):
        for part in batches:
            if len(part):
                yield part[keep].assign(score=np.asarray(arm.score(np.array(part[features].to_list(), float)), float))

    return px.select(*keep, features).mapInPandas(run, schema)


# --- features ---------------------------------------------------------------


def fitted_axes(px: DataFrame, n: int) -> DataFrame:
    """scene_id, mean, axes: the first principal axes of each scene, each pointing to its largest loading; fit on one table, apply to others."""
    ship(px.sparkSession)

    def axes(cell: pd.DataFrame) -> pd.DataFrame:
        size = int(cell["i"].max()) + 1
        sigma = np.zeros((size, size))
        sigma[cell["i"], cell["j"]] = cell["v"]
        vectors = np.linalg.eigh(sigma)[1][:, ::-1][:, :n]
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
        return pd.DataFrame({"scene_id": [cell["scene_id"].iloc[0]], "axes": [[list(v) for v in vectors.T]]})

    return moments.covariance(px).groupBy("scene_id").applyInPandas(axes, "scene_id string, axes array<array<double>>").join(moments.band_means(px).drop("n"), "scene_id")


def reduced(px: DataFrame, axes: DataFrame, *, fitted_on: str | None = None) -> DataFrame:
    """px projected onto fitted axes: its own scene's, or those of one named scene or pool, which then only transform."""
    model = axes.where(F.col("scene_id") == fitted_on) if fitted_on else axes
    model = model.select(F.col("scene_id").alias("_scene"), "mean", "axes")  # one row a scene
    x = px.join(F.broadcast(model), F.lit(True) if fitted_on else F.col("scene_id") == F.col("_scene"))
    centred = F.zip_with("spectrum", "mean", lambda a, m: a - m)
    spectrum = F.transform("axes", lambda axis: F.aggregate(F.zip_with(centred, axis, lambda a, v: a * v), F.lit(0.0), lambda t, v: t + v))
    return x.withColumn("spectrum", F.when(F.col("spectrum").isNotNull(), spectrum)).drop("_scene", "mean", "axes")


class KernelAxes:
    """Principal axes in the feature space of an RBF kernel, fitted on a bounded sample."""

    def __init__(self, n: int, *, gamma: float | None = None) -> None:
        self.n, self.gamma = n, gamma

    def fit(self, x: np.ndarray, y=None) -> KernelAxes:
        self.x = np.asarray(x, float)
        self.g = self.gamma or scale_gamma(self.x)
        k = rbf(self.x, self.x, self.g)
        self.means, self.total = k.mean(0), k.mean()
        values, vectors = np.linalg.eigh(k - self.means - self.means[:, None] + self.total)
        order = values.argsort()[::-1][: self.n]
        vectors = vectors[:, order] * np.sign(vectors[np.abs(vectors[:, order]).argmax(0), order])
        self.vectors = vectors / np.sqrt(np.maximum(values[order], 1e-12))
        return self

    def transform(self, x: np.ndarray) -> np.ndarray:
        k = rbf(np.asarray(x, float), self.x, self.g)
        return (k - k.mean(1)[:, None] - self.means + self.total) @ self.vectors


def angles(px: DataFrame, ranges: DataFrame, *, features: str = "features") -> DataFrame:
    """Features onto [0, pi] by ranges(lo, hi) of the training rows, arrays in one row; what lies outside is clipped."""
    span = F.zip_with("lo", "hi", lambda a, b: F.when(a == b, F.lit(1.0)).otherwise(b - a))
    share = F.zip_with(F.zip_with(features, "lo", lambda v, a: v - a), span, lambda v, s: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v / s)) * np.pi)
    return px.join(F.broadcast(ranges), F.lit(True)).withColumn(features, share).drop("lo", "hi")  # one row


def ranges(px: DataFrame, *, features: str = "features") -> DataFrame:
    """lo, hi: least and greatest value of each feature, as arrays in one row."""
    x = px.select(F.posexplode(features).alias("b", "v")).groupBy("b").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    rows = F.array_sort(F.collect_list(F.struct("b", "lo", "hi")))
    return x.agg(F.transform(rows, lambda e: e["lo"]).alias("lo"), F.transform(rows, lambda e: e["hi"]).alias("hi"))


def mahalanobis(px: DataFrame, background: DataFrame, *, reg: float = 1e-6) -> DataFrame:
    """RX fitted on background pixels alone and scored on all."""
    return moments.whitened(px, moments.model(background, reg=reg), lambda white: (white * white).sum(1))
