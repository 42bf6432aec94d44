"""Queries of estimators, made scenes and registration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismal.operators import detectors, evaluation, models, registration, synthesis
from prismal.plans.dialect import GR, PX, Q, inverse, q
from prismal.plans.registry import query
from prismal.sources import scenes

T = scenes.table

# --- estimators -------------------------------------------------------------

_BACK = f"{PX}, pb AS (SELECT pix, unnest(s) AS v, generate_subscripts(s, 1) - 1 AS b FROM px WHERE NOT gt)"


@query(f"WITH RECURSIVE {_BACK}, {inverse('1e-6 * tr.t / tr.n')}, al AS (SELECT pix, u.b, u.v - mu.m AS d FROM (SELECT pix, unnest(s) AS v, generate_subscripts(s, 1) - 1 AS b FROM px) u JOIN mu USING (b)) SELECT x.pix, {Q('sum(x.d * inv.v * y.d) / 100')} AS score FROM al x JOIN inv ON inv.i = x.b JOIN al y ON y.pix = x.pix AND y.b = inv.j GROUP BY x.pix")
def mahalanobis_arm(spark, d) -> DataFrame:
    """Fitted on background pixels only, scored on all."""
    px = scenes.pixels(spark, d)
    return models.mahalanobis(px, px.where(~F.col("gt"))).select("pix", q(F.col("score") / 100).alias("score"))


def _split(spark, d, cap: int = 200) -> tuple[DataFrame, DataFrame]:
    """(all pixels with eight angles as features, a split of `cap` rows)."""
    px = scenes.pixels(spark, d).withColumn("line", F.col("pix") % 7)
    px = models.reduced(px, models.fitted_axes(px, 8)).withColumn("features", F.col("spectrum"))
    train = evaluation.assembled(px, cap)
    return models.angles(px, models.ranges(train)), models.angles(train, models.ranges(train))


def _arm(spark, d, arm) -> DataFrame:
    px, train = _split(spark, d)
    return models.scored(px, models.fitted(arm, train), keep=["pix", "gt"])


@query()
def reduced_bands(spark, d) -> DataFrame:
    """First eight principal components, fitted on one half of the pixels and applied to all."""
    px = scenes.pixels(spark, d)
    axes = models.fitted_axes(px.where("pix % 2 = 0"), 8)
    return models.reduced(px, axes, fitted_on="scene0").select("pix", F.posexplode("spectrum").alias("k", "v"))


@query(f"WITH {PX}, f AS (SELECT pix, s[1] AS x, s[2] AS y FROM px), lh AS (SELECT min(x) AS xl, max(x) AS xh, min(y) AS yl, max(y) AS yh FROM f WHERE pix % 3 = 0) SELECT pix, {Q('3.141592653589793 * least(1, greatest(0, (x - xl) / (xh - xl)))')} AS a, {Q('3.141592653589793 * least(1, greatest(0, (y - yl) / (yh - yl)))')} AS b FROM f, lh")
def angle_features(spark, d) -> DataFrame:
    """Angles by the ranges of the training rows; what lies outside is clipped."""
    px = scenes.pixels(spark, d).select("pix", F.slice("spectrum", 1, 2).alias("features"))
    x = models.angles(px, models.ranges(px.where("pix % 3 = 0")))
    return x.select("pix", q(F.get("features", F.lit(0))).alias("a"), q(F.get("features", F.lit(1))).alias("b"))


@query()
def autoencoder_arm(spark, d) -> DataFrame:
    return _arm(spark, d, models.AutoencoderArm())


@query()
def one_class_arm(spark, d) -> DataFrame:
    return _arm(spark, d, models.OneClassArm())


@query()
def two_class_arm(spark, d) -> DataFrame:
    return _arm(spark, d, models.TwoClassArm())


@query()
def state_kernel_arm(spark, d) -> DataFrame:
    return _arm(spark, d, models.StateKernelArm(angle_scale=0.2))


_OVERLAP = "pow(cos((x.a - y.a)), 2)"


@query(f"WITH f AS (SELECT s_suppkey AS i, CAST(s_suppkey % 17 AS DOUBLE) / 10 AS a FROM supplier WHERE s_suppkey < 40) SELECT count(*) AS n, {Q('avg(v)')} AS mean_offdiag, {Q('quantile_cont(v, 0.99)')} AS p99_offdiag FROM (SELECT {_OVERLAP} AS v FROM f x, f y WHERE x.i <> y.i)")
def kernel_concentration(spark, d) -> DataFrame:
    """Overlaps of one-feature states beside the diagonal; a single feature's overlap is the square of a cosine."""

    def gram(batches):
        import numpy as np
        import pandas as pd

        for part in batches:
            v = models.fidelity(np.array(part["a"])[:, None], np.array(part["b"])[:, None], reps=1, pairs=False).diagonal()
            yield pd.DataFrame({"i": part["i"], "j": part["j"], "v": v})

    f = T(spark, d, "supplier").where("s_suppkey < 40").select(F.col("s_suppkey").alias("i"), ((F.col("s_suppkey") % 17).cast("double") / 10).alias("a"))
    from prismal.session import ship

    ship(spark)
    pairs = f.crossJoin(F.broadcast(f.select(F.col("i").alias("j"), F.col("a").alias("b"))))  # 40 rows
    x = evaluation.off_diagonal(pairs.mapInPandas(gram, "i long, j long, v double"))
    return x.select("n", q(F.col("mean_offdiag")).alias("mean_offdiag"), q(F.col("p99_offdiag")).alias("p99_offdiag"))


# --- made scenes ------------------------------------------------------------

_BLOBS = "bl AS (SELECT r, c, CASE WHEN r < 5 THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END AS a, CASE WHEN r < 5 THEN 0 ELSE 1 END AS k FROM (SELECT DISTINCT r, c FROM px) WHERE (r BETWEEN 2 AND 3 AND c BETWEEN 4 AND 6) OR (r BETWEEN 9 AND 11 AND c BETWEEN 10 AND 12))"


def _placed(spark):
    rows = [("scene0", 0, r, c, 0.25, 0) for r in (2, 3) for c in (4, 5, 6)] + [("scene0", 1, r, c, 0.75, 1) for r in (9, 10, 11) for c in (10, 11, 12)]
    return spark.createDataFrame(rows, "scene_id string, target int, r long, c long, abundance double, spectrum_id int")


def _spectra(spark):
    each = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i + 1) / 64.0 * F.when(F.col("id") == 0, 1.0).otherwise(-1.0))
    return spark.range(2).select(F.col("id").cast("int").alias("spectrum_id"), each.alias("target_spectrum"))


@query(f"WITH {PX}, {_BLOBS} SELECT pix, CASE WHEN a IS NULL THEN 0 ELSE 1 END AS m, {Q('CASE WHEN a IS NULL THEN s[10] ELSE a * (10 / 64.0::DOUBLE * CASE WHEN k = 0 THEN 1 ELSE -1 END) + (1 - a) * s[10] END')} AS v FROM px LEFT JOIN bl USING (r, c)")
def implanted_targets(spark, d) -> DataFrame:
    x = synthesis.implanted(scenes.pixels(spark, d), _placed(spark), _spectra(spark))
    return x.select("pix", "m", q(F.get("spectrum", F.lit(9))).alias("v"))


@query(f"WITH {PX}, {_BLOBS}, g AS (SELECT pix, r, c, greatest(0, s[10] * 1.1::DOUBLE) AS v, s[10] AS before FROM px) SELECT pix, CASE WHEN a IS NULL THEN 0 ELSE 1 END AS m, {Q('before')} AS before, {Q('CASE WHEN a IS NULL THEN v ELSE a * (10 / 64.0::DOUBLE * CASE WHEN k = 0 THEN 1 ELSE -1 END) + (1 - a) * v END')} AS after FROM g LEFT JOIN bl USING (r, c)")
def change_pair(spark, d) -> DataFrame:
    """The scene, and itself in brighter light with targets in it."""
    t1, t2 = synthesis.change_pair(scenes.pixels(spark, d), _placed(spark), _spectra(spark), gain=0.1)
    x = t1.select("pix", F.get("spectrum", F.lit(9)).alias("before")).join(t2.select("pix", "m", F.get("spectrum", F.lit(9)).alias("after")), "pix")
    return x.select("pix", "m", q(F.col("before")).alias("before"), q(F.col("after")).alias("after"))


@query()
def pseudo_anomalies(spark, d) -> DataFrame:
    """Blobs of pixels shifted, scaled, swapped or noised."""
    px = scenes.pixels(spark, d)
    placed = synthesis.blobs(spark, 20, 25, 4, sizes=(4, 30), seed=3)
    return synthesis.perturbed(px, placed, seed=3).select("pix", "m", F.get("spectrum", F.lit(9)).alias("v"))


@query(f"WITH {PX} SELECT pix, {Q('(s[1] + s[2] + s[3]) / 5')} AS first, {Q('(s[30] + s[31] + s[32] + s[33] + s[34]) / 5')} AS middle, {Q('(s[62] + s[63] + s[64]) / 5')} AS last FROM px")
def smoothed_bands(spark, d) -> DataFrame:
    x = scenes.pixels(spark, d).select("pix", synthesis.smoothed(F.col("spectrum")).alias("s"))
    return x.select("pix", *(q(F.get("s", F.lit(k))).alias(n) for k, n in ((0, "first"), (31, "middle"), (63, "last"))))


# --- registration -----------------------------------------------------------


@query(f"WITH {PX}, g AS (SELECT pix, CASE WHEN pix % 17 <> 0 THEN list_sum(s) / 64 END AS v FROM px) SELECT pix, {Q('coalesce(v, (SELECT avg(v) FROM g))')} AS v FROM g")
def panchromatic(spark, d) -> DataFrame:
    return registration.panchromatic(scenes.pixels(spark, d, nodata_every=17)).select("pix", q(F.col("v")).alias("v"))


@query("SELECT 2.0::DOUBLE AS dr, -3.0::DOUBLE AS dc, true AS close")
def coregistered(spark, d) -> DataFrame:
    """An epoch that was moved by whole pixels is found again and moved back."""
    t1 = scenes.score_map(spark, d).where("r < 10 AND c < 100").select("scene_id", "pix", "r", "c", F.array("score").alias("spectrum"))
    moved = t1.select("scene_id", (F.pmod(F.col("r") - 2, F.lit(10))).alias("r"), (F.pmod(F.col("c") + 3, F.lit(100))).alias("c"), "spectrum")
    t2 = moved.join(t1.select("r", "c", "pix"), ["r", "c"]).select("scene_id", "pix", "r", "c", "spectrum")
    _, report = registration.coregistered(t1, t2)
    return report.select(F.round("dr", 1).alias("dr"), F.round("dc", 1).alias("dc"), (F.col("rmse") < 1).alias("close"))


@query(f"WITH {PX}, ix AS (SELECT pix, s[3] + 0.5 AS blue, s[39] + 0.5 AS swir, (s[15] - s[9]) / nullif(s[15] + s[9] + 1, 0) AS ndvi FROM px) SELECT pix, coalesce(blue > 0.25 AND swir < 0.20 AND ndvi < 0.20, false) AS cloudy FROM ix")
def cloud_rule(spark, d) -> DataFrame:
    """The spectral cloud rule at its own limits."""
    from prismal.functions import spectral
    from prismal.plans.queries import BAND_OF

    px = scenes.reflectance(scenes.pixels(spark, d))
    return px.select("pix", spectral.cloudy(F.col("spectrum"), BAND_OF).alias("cloudy"))


@query(f"WITH {GR} SELECT r // 40 AS strip, count(*) AS n, {Q('avg(score)')} AS mean FROM gr GROUP BY 1")
def strip_source(spark, d) -> DataFrame:
    x = scenes.strips(scenes.score_map(spark, d), 40)
    return x.groupBy("strip").agg(F.count(F.lit(1)).alias("n"), q(F.avg("score")).alias("mean"))


@query("SELECT source, count(*) AS n, count(DISTINCT scene) AS n_scenes FROM (SELECT c_mktsegment AS source, c_nationkey AS scene FROM customer) GROUP BY 1")
def patch_summary(spark, d) -> DataFrame:
    from prismal import sinks

    x = T(spark, d, "customer").select(F.col("c_mktsegment").alias("source"), F.col("c_nationkey").cast("string").alias("scene_id"), F.col("c_name").alias("content"))
    return sinks.patch_summary(x).select("source", "n", "n_scenes")


@query()
def fused_with_index(spark, d) -> DataFrame:
    """All four components: the scene has wavelengths."""
    from prismal.functions import spectral
    from prismal.plans.queries import BAND_OF

    px = scenes.reflectance(scenes.pixels(spark, d))
    index = spectral.index_score(px, ["ndbi", "iron_oxide_ratio", "clay_ratio", "brightness"], BAND_OF)
    return detectors.fused(px, local=detectors.ring_params(20, 25), index=index).select("pix", "score")
