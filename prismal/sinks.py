"""What a run leaves behind: score maps, masks, regions, audits, manifests. All but a scene's collection are written in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismal.operators import scoring
from prismal.schema import SCORE_TAGS


def score_map(scores: DataFrame, *, method: str, georef: str = "synthetic", lo: float = 1.0, hi: float = 99.9) -> tuple[DataFrame, DataFrame]:
    """(scores with raw and norm, tags): a raw map and its normalised twin, and the eight tags of each scene."""
    x = scoring.percentile_normalised(scores, lo=lo, hi=hi)
    limits = x.groupBy("scene_id").agg(F.first("v_lo").alias("v_lo"), F.first("v_hi").alias("v_hi"))
    values = {"NORM_METHOD": F.lit("percentile"), "NORM_P_LO": F.lit(str(lo)), "NORM_P_HI": F.lit(str(hi)), "NORM_V_LO": F.col("v_lo").cast("string"), "NORM_V_HI": F.col("v_hi").cast("string"), "SCORE_METHOD": F.lit(method), "SCENE_ID": F.col("scene_id"), "GEOREF": F.lit(georef)}
    tags = limits.select("scene_id", F.map_from_arrays(F.array(*map(F.lit, SCORE_TAGS)), F.array(*(values[t] for t in SCORE_TAGS))).alias("tags"))
    return x.withColumn("method", F.lit(method)).drop("v_lo", "v_hi"), tags


def written(df: DataFrame, path: str, *by: str) -> str:
    """As Parquet, in folders by scene or whatever else the table is read by."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return path


def written_text(rows: DataFrame, column: str, path: str) -> str:
    """One line a row: GeoJSON features one after another, audit records."""
    rows.select(column).write.mode("overwrite").text(path)
    return path


def run_manifest(spark, settings: dict, seconds: dict[str, float], rois: DataFrame) -> DataFrame:
    """One row: what was run, how long each stage took, how many regions came out."""
    n = rois.agg(F.count(F.lit(1)).alias("n_rois"))
    return n.select(F.lit(spark.version).alias("spark"), *(F.lit(str(v)).alias(k) for k, v in settings.items()), F.create_map(*(F.lit(x) for kv in (seconds or {"none": 0.0}).items() for x in kv)).alias("seconds"), "n_rois")


def patch_summary(patches: DataFrame, *, source: str = "source", digest: str = "content") -> DataFrame:
    """By source: patches, different scenes, and a digest of all contents in order."""
    x = patches.withColumn("_d", F.sha2(F.col(digest).cast("binary"), 256))
    return x.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("scene_id").alias("n_scenes"), F.bit_xor(F.xxhash64("_d")).alias("digest"))


def appended(records: DataFrame, path: str) -> str:
    """Profile records, one JSON a line, behind those that are there."""
    records.write.mode("append").json(path)
    return path
