"""Scenes out of tables: pixels, epochs, score maps, bands, strips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 25
GRID = 100
FIRST_WL, WL_STEP, N_BANDS = 400.0, 33.0, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str, *, nodata_every: int = 0) -> DataFrame:
    """One 64-band scene of the embeddings; every nth pixel without data if asked for."""
    x = table(spark, sf_dir, "embeddings")
    spectrum = F.col("embedding").cast("array<double>")
    if nodata_every:
        spectrum = F.when(F.col("vec_id") % nodata_every != 0, spectrum)
    return x.select(F.lit("scene0").alias("scene_id"), F.col("vec_id").alias("pix"), F.expr(f"vec_id div {WIDTH}").alias("r"), (F.col("vec_id") % WIDTH).alias("c"), spectrum.alias("spectrum"), (F.col("label") == 0).alias("gt"), F.col("label"))


def reflectance(px: DataFrame) -> DataFrame:
    return px.withColumn("spectrum", F.transform("spectrum", lambda x: x + 0.5))


def bands(spark: SparkSession) -> DataFrame:
    return spark.range(N_BANDS).select(F.col("id").cast("int").alias("b"), (FIRST_WL + WL_STEP * F.col("id")).alias("wl"))


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel = part, epoch = ship year, four bands of order one."""
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("pix"), F.year("l_shipdate").cast("int").alias("epoch"))
    means = [F.avg("l_quantity") / 50, F.avg("l_extendedprice") / 100000, F.avg("l_discount") * 10, F.avg("l_tax") * 10]
    return x.agg(F.array(*means).alias("spectrum")).select(F.lit("parts").alias("scene_id"), "epoch", "pix", F.expr("pix div 50").alias("r"), (F.col("pix") % 50).alias("c"), "spectrum")


def score_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 2-D map of order prices."""
    return table(spark, sf_dir, "orders").select(F.lit("orders").alias("scene_id"), F.col("o_orderkey").alias("pix"), F.expr(f"o_orderkey div {GRID}").alias("r"), (F.col("o_orderkey") % GRID).alias("c"), (F.col("o_totalprice") / 100000).alias("score"))


def window(px: DataFrame, r0: int, c0: int, h: int, w: int, *, shape: tuple[int, int] | None = None) -> DataFrame:
    """A sub-rectangle; the filter reaches the scan where r and c are stored. With the scene's shape, one that reaches outside raises."""
    if h < 1 or w < 1 or r0 < 0 or c0 < 0 or shape and (r0 + h > shape[0] or c0 + w > shape[1]):
        raise ValueError(f"window {(r0, c0, h, w)} isn't inside {shape}")
    return px.where(F.col("r").between(r0, r0 + h - 1) & F.col("c").between(c0, c0 + w - 1))


def window_transform(transform: dict[str, float], r0: int, c0: int) -> dict[str, float]:
    """The affine grid of a window: its origin moves by the window's corner."""
    t = dict(transform)
    t["c"] += t["a"] * c0 + t["b"] * r0
    t["f"] += t["d"] * c0 + t["e"] * r0
    return t


#: The grid of scenes without one of their own, and the value types that a cube may have.
SYNTHETIC = {"a": 1.0, "b": 0.0, "c": 0.0, "d": 0.0, "e": -1.0, "f": 0.0}
CUBE_TYPES = ("tinyint", "smallint", "int", "float", "double")


def as_floats(df: DataFrame, *columns: str) -> DataFrame:
    """Value columns widened to float; a type that isn't one of CUBE_TYPES raises."""
    kinds = dict(df.dtypes)
    if wrong := {c: kinds[c] for c in columns if kinds[c] not in CUBE_TYPES}:
        raise TypeError(f"no cube has values of {wrong}")
    return df.withColumns({c: F.col(c).cast("float") for c in columns})


def without_nodata(px: DataFrame, sentinel: float) -> DataFrame:
    """The sentinel in any band becomes a missing value."""
    return px.withColumn("spectrum", F.transform("spectrum", lambda v: F.when(v != sentinel, v)))


def band_flags(px: DataFrame) -> DataFrame:
    """scene_id, b, bad: whether a band has no value in any pixel of its scene."""
    x = px.select("scene_id", F.posexplode("spectrum").alias("b", "v"))
    return x.groupBy("scene_id", "b").agg((F.count("v") == 0).alias("bad"))


def without_bad_bands(px: DataFrame, bands: DataFrame, flags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(px, bands) without the flagged bands: spectra get shorter, and the bands left are numbered anew. bands(b, wl) belong to all the scenes."""
    bad = flags.where("bad").groupBy(F.col("scene_id").alias("_scene")).agg(F.collect_set("b").alias("_bad"))  # one row a scene
    x = px.join(bad, F.col("scene_id") == F.col("_scene"), "left")
    kept = F.when(F.col("_bad").isNull(), F.col("spectrum")).otherwise(F.filter("spectrum", lambda _, i: ~F.array_contains(F.col("_bad"), i)))
    left = bands.join(flags.where("bad").select("b").distinct(), "b", "left_anti")
    from pyspark.sql import Window

    numbered = left.withColumn("_k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("b")) - 1).select(F.col("_k").alias("b"), "wl")  # some hundreds of rows
    return x.withColumn("spectrum", kept).drop("_scene", "_bad"), numbered


def strips(px: DataFrame, rows: int) -> DataFrame:
    return px.withColumn("strip", F.floor(F.col("r") / rows).cast("long"))
