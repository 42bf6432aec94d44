"""Relations of the engine and the contracts that rows must satisfy.

A scene is a table of pixels, one row each; nodata is NULL, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIXELS = T.StructType([T.StructField("scene_id", T.StringType()), T.StructField("pix", T.LongType()), T.StructField("r", T.LongType()), T.StructField("c", T.LongType()), T.StructField("spectrum", T.ArrayType(T.DoubleType()))])
SCORES = T.StructType([T.StructField("scene_id", T.StringType()), T.StructField("pix", T.LongType()), T.StructField("r", T.LongType()), T.StructField("c", T.LongType()), T.StructField("score", T.DoubleType())])
BANDS = T.StructType([T.StructField("b", T.IntegerType()), T.StructField("wl", T.DoubleType())])

#: Closed enumerations of the contracts.
SOURCES = ("indian_pines", "abu", "hydice_urban_anomaly", "had100", "enmap", "sentinel2", "aviris")
GEOREFS = ("real", "synthetic")
BRANCHES = ("anomaly", "change", "fused")
PROFILES = ("object", "landcover")
#: The sixteen properties of an exported region, each with the kinds of JSON value that it may have.
FEATURE_KEYS = {
    "lat": ("number",),
    "lon": ("number",),
    "area": ("number",),
    "perimeter": ("number",),
    "anomaly_score": ("number", "null"),
    "change_score": ("number", "null"),
    "confidence": ("number",),
    "timestamp": ("string",),
    "source_scene": ("string",),
    "class": ("string",),
    "roi_id": ("string",),
    "source_branch": ("string",),
    "target_profile": ("string",),
    "linked_roi_ids": ("array",),
    "confidence_components": ("array",),
    "georef": ("string",),
}
#: The tags of a normalised score map.
SCORE_TAGS = ("NORM_METHOD", "NORM_P_LO", "NORM_P_HI", "NORM_V_LO", "NORM_V_HI", "SCORE_METHOD", "SCENE_ID", "GEOREF")


def is_valid(spectrum: Column) -> Column:
    """True if no band is missing; NaN counts as missing."""
    return spectrum.isNotNull() & ~F.exists(F.coalesce(spectrum, F.array().cast("array<double>")), lambda x: x.isNull() | F.isnan(x))


def cleaned(px: DataFrame) -> DataFrame:
    """Pixels with any missing band get a NULL spectrum."""
    return px.withColumn("spectrum", F.when(is_valid(F.col("spectrum")), F.col("spectrum")))


def scene_violations(px: DataFrame, bands: DataFrame) -> DataFrame:
    """One row a broken rule of a scene: how many pixels or bands break it."""
    size = bands.agg(F.count(F.lit(1)).alias("n_bands"))
    order = bands.agg(F.array_sort(F.collect_list(F.struct("b", "wl"))).alias("w")).select(F.size(F.filter(F.zip_with(F.expr("w.wl"), F.expr("slice(w.wl, 2, size(w))"), lambda a, b: b <= a), lambda x: x)).alias("n"))
    per_pixel = px.crossJoin(F.broadcast(size)).agg(  # one row beside the pixels
        F.count_if(F.size("spectrum") != F.col("n_bands")).alias("band_count"),
        F.count_if(F.exists("spectrum", lambda x: F.abs(x) == float("inf"))).alias("infinite"),
    )
    return per_pixel.select(F.expr("stack(2, 'band_count', band_count, 'infinite', infinite) as (rule, n)")).unionByName(order.select(F.lit("ascending").alias("rule"), F.col("n").cast("long").alias("n")))


def mask_violations(mask: DataFrame, column: str = "m") -> DataFrame:
    return mask.agg(F.count_if(F.col(column).isNull() | ~F.col(column).isin(0, 1)).alias("n"))


def roi_violations(rois: DataFrame) -> DataFrame:
    """Regions whose box is degenerate, whose branch or profile is unknown, or whose id doesn't name scene and branch."""
    part = F.split("roi_id", ":")
    bad = (F.col("r1") <= F.col("r0")) | (F.col("c1") <= F.col("c0")) | ~F.col("source_branch").isin(*BRANCHES) | ~F.col("target_profile").isin(*PROFILES) | (F.size(part) != 3) | (F.get(part, F.lit(1)) != F.col("source_branch")) | (F.get(part, F.lit(0)) != F.col("scene_id"))
    return rois.where(bad)


def score_violations(scores: DataFrame, tags: DataFrame) -> DataFrame:
    """scene_id, rule: normalised scores outside [0, 1], and tags(scene_id, tags map) that lack a required one."""
    outside = scores.where(F.col("norm").isNotNull() & ~F.col("norm").between(0, 1)).select("scene_id", F.lit("range").alias("rule")).distinct()
    lacking = F.array_except(F.array(*map(F.lit, SCORE_TAGS)), F.map_keys("tags"))
    return outside.unionByName(tags.select("scene_id", F.explode(F.transform(lacking, lambda t: F.concat(F.lit("tag "), t))).alias("rule")))


def meta_violations(meta: DataFrame) -> DataFrame:
    """scene_id, rule: scenes(scene_id, source, georef) of an unknown source or georeference."""
    bad = F.array_compact(F.array(F.when(~F.col("source").isin(*SOURCES), "source"), F.when(~F.col("georef").isin(*GEOREFS), "georef")))
    return meta.select("scene_id", F.explode(bad).alias("rule"))


def feature_violations(features: DataFrame, column: str = "feature") -> DataFrame:
    """roi_id, rule: features (JSON text) of another type or geometry, with missing, unexpected or wrongly typed properties, or values outside the enumerations."""
    doc = F.col(column)
    # Each text is parsed once: rules that repeated these expressions would parse it for every key.
    read = features.select(
        F.json_object_keys(F.get_json_object(doc, "$.properties")).alias("_names"), F.from_json(doc, "properties map<string, string>")["properties"].alias("_parsed"),
        F.json_tuple(doc, "type", "geometry").alias("_type", "_geometry"),
    )
    names, parsed = F.col("_names"), F.col("_parsed")
    want = F.array(*map(F.lit, FEATURE_KEYS))

    def wrong(key: str, kinds: tuple[str, ...]) -> Column:
        # a string's quotes are gone in the map, and null is NULL
        value = parsed[key]
        given = F.array_contains(names, key)
        kind = F.when(value.isNull(), "null").when(F.substring(value, 1, 1) == "[", "array").when(value.try_cast("double").isNotNull(), "number").otherwise("string")
        fits = kind.isin(*kinds) | (F.lit("string" in kinds) & value.isNotNull())
        return F.when(given & ~fits, F.lit(f"type {key}"))

    rules = F.array_compact(
        F.concat(
            F.array(
                F.when(F.col("_type") != "Feature", "type"),
                F.when(F.coalesce(F.get_json_object("_geometry", "$.type"), F.lit("")) != "Polygon", "geometry"),
                *(wrong(k, v) for k, v in FEATURE_KEYS.items()),
                F.when(~parsed["source_branch"].isin(*BRANCHES), "source_branch"),
                F.when(~parsed["target_profile"].isin(*PROFILES), "target_profile"),
                F.when(~parsed["georef"].isin(*GEOREFS), "georef"),
            ),
            F.transform(F.array_except(want, F.coalesce(names, F.array().cast("array<string>"))), lambda k: F.concat(F.lit("missing "), k)),
            F.transform(F.array_except(F.coalesce(names, F.array().cast("array<string>")), want), lambda k: F.concat(F.lit("unexpected "), k)),
        )
    )
    return read.select(parsed["roi_id"].alias("roi_id"), F.explode(rules).alias("rule"))
