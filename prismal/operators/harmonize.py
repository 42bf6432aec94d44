"""Spectral axes: nearest bands, water gaps, coverage, interpolation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest_bands(bands: DataFrame, targets: DataFrame, *, tolerance: float = 15.0) -> DataFrame:
    """targets(name, target) with the nearest band; the first of equally near ones, NULL beyond the tolerance.

    Both sides are axes of one instrument, some hundreds of rows.
    """
    x = targets.join(F.broadcast(bands), F.abs(F.col("wl") - F.col("target")) <= tolerance, "left")
    return x.groupBy("name", "target").agg(F.min(F.struct(F.abs(F.col("wl") - F.col("target")).alias("gap"), "b")).alias("_m")).select("name", "target", F.col("_m.b").alias("b"), F.col("_m.gap").alias("gap"))


def without_water(bands: DataFrame) -> DataFrame:
    """The two bands of water vapour in nm, both ends out."""
    return bands.where(~(F.col("wl").between(1350, 1450) | F.col("wl").between(1800, 1950)))


def plan(bands: DataFrame, targets: DataFrame) -> DataFrame:
    """(t, wl, lo, hi, frac): the brackets of each target wavelength, clamped at both ends."""
    axis = bands.agg(F.array_sort(F.collect_list(F.struct("wl", "b"))).alias("axis"))  # one row
    x = targets.join(F.broadcast(axis), F.lit(True))
    below = F.filter("axis", lambda e: e["wl"] <= F.col("wl"))
    above = F.filter("axis", lambda e: e["wl"] >= F.col("wl"))
    x = x.withColumn("_lo", F.coalesce(F.element_at(F.when(F.size(below) > 0, below), -1), F.get("axis", F.lit(0))))
    x = x.withColumn("_hi", F.coalesce(F.get(above, F.lit(0)), F.element_at("axis", -1)))
    frac = F.when(F.col("_hi.wl") == F.col("_lo.wl"), 0.0).otherwise((F.col("wl") - F.col("_lo.wl")) / (F.col("_hi.wl") - F.col("_lo.wl")))
    return x.select("t", "wl", F.col("_lo.b").alias("lo"), F.col("_hi.b").alias("hi"), frac.alias("frac"))


def interpolated(px: DataFrame, planned: DataFrame) -> DataFrame:
    """px on the planned axis; a bracket of weight 0 isn't read, so that its missing value doesn't spread."""
    row = planned.agg(F.array_sort(F.collect_list(F.struct("t", "lo", "hi", "frac"))).alias("_plan"))  # one row, an element a target band
    blend = F.transform("_plan", lambda e: F.when(e["frac"] == 0, F.get("spectrum", e["lo"])).when(e["frac"] == 1, F.get("spectrum", e["hi"])).otherwise(F.get("spectrum", e["lo"]) * (1 - e["frac"]) + F.get("spectrum", e["hi"]) * e["frac"]))
    return px.join(F.broadcast(row), F.lit(True)).withColumn("spectrum", blend).drop("_plan")


def coverage(bands: DataFrame, targets: DataFrame) -> DataFrame:
    """(step, worst, ok): whether each target lies within the median step of some band."""
    axis = bands.agg(F.array_sort(F.collect_list("wl")).alias("axis"))
    step = F.zip_with(F.expr("slice(axis, 1, size(axis) - 1)"), F.expr("slice(axis, 2, size(axis) - 1)"), lambda a, b: b - a)
    middle = axis.select(F.explode(step).alias("s")).agg(F.percentile("s", F.lit(0.5)).alias("step"))
    gaps = targets.join(F.broadcast(axis), F.lit(True)).select(F.array_min(F.transform("axis", lambda w: F.abs(w - F.col("wl")))).alias("gap")).agg(F.max("gap").alias("worst"))
    return gaps.join(F.broadcast(middle), F.lit(True)).select("step", "worst", (F.col("worst") <= F.col("step")).alias("ok"))


def selected_bands(bands: DataFrame, targets: DataFrame, *, tolerance: float = 15.0) -> DataFrame:
    """nearest_bands(), all or nothing: a target without a band within the tolerance raises."""
    x = nearest_bands(bands, targets, tolerance=tolerance)
    found = F.when(F.col("b").isNotNull(), F.col("b")).otherwise(F.raise_error(F.concat(F.lit("no band near "), F.col("target").cast("string"))))
    return x.withColumn("b", found)


def sorted_axis(px: DataFrame, bands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(px, bands) in ascending wavelengths; bands of the same wavelength become one, their mean, and a missing value stays missing."""
    groups = bands.groupBy("wl").agg(F.array_sort(F.collect_list("b")).alias("of"))
    order = groups.agg(F.array_sort(F.collect_list(F.struct("wl", "of"))).alias("_axis"))  # one row of some hundreds of elements
    mean = lambda e: F.aggregate(F.transform(e["of"], lambda b: F.get("spectrum", b)), F.lit(0.0), lambda t, v: t + v) / F.size(e["of"])
    out = px.join(F.broadcast(order), F.lit(True)).withColumn("spectrum", F.when(F.col("spectrum").isNotNull(), F.transform("_axis", mean))).drop("_axis")
    return out, order.select(F.posexplode("_axis").alias("b", "_e")).select("b", F.col("_e.wl").alias("wl"))


def harmonized(px: DataFrame, bands: DataFrame, targets: DataFrame) -> DataFrame:
    """px on the target axis t, wl: axis sorted, water bands out of the targets, coverage checked (a gap raises), then interpolated."""
    sorted_px, axis = sorted_axis(px, bands)
    dry = without_water(targets)
    gate = coverage(axis, dry).select(F.when(F.col("ok"), F.lit(True)).otherwise(F.raise_error(F.lit("a target lies beyond the median step of the axis"))).alias("_ok"))
    return interpolated(sorted_px, plan(axis, dry)).join(F.broadcast(gate), F.lit(True)).where("_ok").drop("_ok")  # one row
