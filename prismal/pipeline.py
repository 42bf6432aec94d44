"""The anomaly query end to end: pixels, normaliser, detector, normalised score, mask, regions, features."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismal import schema, sinks
from prismal.functions import spectral
from prismal.operators import archive, detectors, geo, moments, regions, scoring, windows2d
from prismal.session import stored
from prismal.sources import scenes

#: name -> pixels to pixels.
NORMALIZERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "standardize": moments.standardized,
    "l2": lambda px: px.withColumn("spectrum", spectral.l2_normalised(F.col("spectrum"))),
}
#: Detectors that take a stream of strips in place of a table of pixels.
STREAM_DETECTORS = ("streaming_rx",)


def detect(name: str, px: DataFrame, **params) -> DataFrame:
    if name in STREAM_DETECTORS:
        raise ValueError(f"{name} takes a stream of strips, see prismal.streaming.strips")
    return detectors.detect(name, px, **params)


def regions_of(scores: DataFrame, *, pct: float, branch: str, profile: str, clean: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mask, labelled, rois with their mean normalised score) of scores(scene_id, pix, r, c, norm)."""
    mask = scoring.thresholded(scores, pct=pct, score="norm").select("scene_id", "r", "c", "m")
    mask = stored(windows2d.cleaned_up(mask) if clean else mask, "mask")
    labelled = stored(regions.connected_components(mask), "labelled")
    means = labelled.join(scores.select("scene_id", "r", "c", "norm"), ["scene_id", "r", "c"]).groupBy("scene_id", "label").agg(F.avg("norm").alias(f"{branch}_score"))
    return mask, labelled, regions.rois(labelled, branch=branch, profile=profile).join(means, ["scene_id", "label"])


def featured(rois: DataFrame, labelled: DataFrame, *, transform: dict[str, float], zone: int | None, timestamp: Column, georef: str) -> DataFrame:
    """rois with the sixteen properties of an exported region and its polygon; columns that are absent count as missing."""
    absent = [c for c in scoring.CONFIDENCE if c not in rois.columns]
    x = rois.withColumns({c: F.lit(None).cast("double") for c in absent})
    if "linked_roi_ids" not in x.columns:
        x = x.withColumn("linked_roi_ids", F.array().cast("array<string>"))
    named = {f"_{name}": F.col(c) for c, (name, _) in scoring.CONFIDENCE.items()}
    value, names = scoring.confidence({f"_{name}": w for name, w in scoring.CONFIDENCE.values()})
    x = x.withColumns(named).withColumn("confidence", value).withColumn("confidence_components", F.transform(names, lambda n: F.substring(n, 2, 40))).drop(*named)
    outlines = geo.placed(regions.rings(geo.boundary_edges(labelled)), transform, zone)
    x = x.join(outlines, ["scene_id", "label"])
    return x.withColumns({"timestamp": timestamp, "source_scene": F.col("scene_id"), "class": F.lit("UNKNOWN"), "georef": F.lit(georef)})


def run(px: DataFrame, *, detector: str = "global_rx", params: dict | None = None, normalizer: str = "standardize", pct: float = 99.0, profile: str = "object", clean: bool = True, transform: dict[str, float] | None = None, zone: int | None = None, acquired: str | None = None, georef: str = "synthetic", out: str | None = None, progress: Callable[[int, str], None] = lambda _, __: None) -> dict[str, DataFrame]:
    """scores, tags, mask, rois, features, manifest of one or more scenes; with `out` they are written there as well."""
    if normalizer not in NORMALIZERS:
        raise KeyError(f"{normalizer} is none of {sorted(NORMALIZERS)}")
    regions.profile_of(profile)
    seconds: dict[str, float] = {}

    def stage(name: str, make):
        began = time.perf_counter()
        made = make()
        seconds[name] = time.perf_counter() - began
        progress(len(seconds), name)
        return made

    raw = stage("detector", lambda: stored(detect(detector, NORMALIZERS[normalizer](schema.cleaned(px)), **(params or {})), "scores"))
    scores, tags = stage("normalise", lambda: sinks.score_map(raw, method=detector, georef=georef))
    mask, labelled, rois = stage("regions", lambda: regions_of(scores, pct=pct, branch="anomaly", profile=profile, clean=clean))
    when = archive.resolved_time(F.lit(None).cast("string"), F.lit(acquired), F.current_timestamp())
    found = stage("features", lambda: stored(featured(rois, labelled, transform=transform or scenes.SYNTHETIC, zone=zone, timestamp=when, georef=georef), "featured"))
    features = regions.features(found)
    settings = {"detector": detector, "params": params or {}, "normalizer": normalizer, "pct": pct, "profile": profile}
    result = {"scores": scores, "tags": tags, "mask": mask, "rois": found, "features": features, "manifest": sinks.run_manifest(px.sparkSession, settings, seconds, found)}
    if out:
        sinks.written(scores, f"{out}/scores", "scene_id", "method")
        sinks.written(tags, f"{out}/tags")
        sinks.written(mask, f"{out}/mask", "scene_id")
        sinks.written_text(features, "feature", f"{out}/features")
        result["manifest"].write.mode("overwrite").json(f"{out}/manifest")
    return result


def change_run(t1: DataFrame, t2: DataFrame, *, clouds: DataFrame | None = None, pct: float = 95.0, patch: int = 7, arm: str = "sam_fusion", clean: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(scores with norm, mask, labelled, rois) of the change between two epochs; clouds(scene_id, pix, cloudy) is the union of both."""
    from prismal.operators import change

    scored = change.ARMS[arm](t1, t2, clouds=clouds, patch=patch)
    scores = scoring.percentile_normalised(scored)
    return (scores, *regions_of(scores, pct=pct, branch="change", profile="landcover", clean=clean))


def benchmark(px: DataFrame, truth: DataFrame, names: list[str], params: dict[str, dict] | None = None) -> DataFrame:
    """One row a detector and scene with its status and figures; a detector that fails is a row that says so."""
    from prismal.operators import evaluation

    rows = None
    for name in names:
        try:
            scored = stored(detect(name, px, **(params or {}).get(name, {})).join(truth, ["scene_id", "pix"]), f"scored-{name}")
            one = evaluation.judged(scored, by=["scene_id"]).withColumn("note", F.lit(""))
        except Exception as failed:  # noqa: BLE001  a failure is a result of the harness
            counts = truth.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n_px"), F.count_if("gt").alias("n_anom"))
            one = counts.withColumn("status", F.lit(f"FAILED:{type(failed).__name__}")).withColumn("note", F.lit(str(failed)[:200]))
        one = one.withColumn("detector", F.lit(name))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    return rows
