"""Score algebra: normalisation, thresholds, fusion, calibration.

All ranks and percentiles are by scene. Average ranks come from two
aggregates by (scene, value) and one running sum, so that ties cost nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismal.session import stored

#: Default weights of the score components.
WEIGHTS = {"rx": 0.40, "ace": 0.25, "index": 0.15, "spatial": 0.20}
#: What a region's confidence is made of, column -> (name, weight).
CONFIDENCE = {"anomaly_score": ("c_anom", 0.40), "change_score": ("c_change", 0.20), "seg_prob": ("c_seg", 0.25), "clear_fraction": ("c_clear", 0.10), "shape_plausibility": ("c_shape", 0.05)}
CHANGE_WEIGHTS = {"sam": 0.50, "variance": 0.20, "entropy": 0.15, "coherence": 0.15}


def percentile_normalised(scores: DataFrame, *, lo: float = 1.0, hi: float = 99.9, by: str = "scene_id", score: str = "score") -> DataFrame:
    """norm = score clipped to [0, 1] between two percentiles; a zero span counts as 1."""
    limits = scores.groupBy(by).agg(F.percentile(score, F.array(F.lit(lo / 100), F.lit(hi / 100))).alias("_p"))
    limits = limits.select(F.col(by).alias("_by"), F.get("_p", F.lit(0)).alias("v_lo"), F.get("_p", F.lit(1)).alias("v_hi"))
    x = scores.join(limits, F.col(by) == F.col("_by")).drop("_by")
    span = F.when(F.col("v_hi") == F.col("v_lo"), 1.0).otherwise(F.col("v_hi") - F.col("v_lo"))
    return x.withColumn("norm", F.when(F.col(score).isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(score) - F.col("v_lo")) / span))))


def rank_normalised(scores: DataFrame, *, by: str = "scene_id", score: str = "score", out: str = "rank_norm") -> DataFrame:
    """(average rank - 1) / (n - 1) among a scene's values; a single value gives 0.5, NULL stays NULL.

    Values are range-partitioned and counted before they are ranked, and a
    running total over the partitions' counts makes the ranks global: no task
    holds a whole scene.
    """
    ranked = ranked_values(scores, by=by, score=score, out=out)
    return scores.join(ranked, (F.col(by) == F.col("_by")) & (F.col(score) == F.col("_v")), "left").drop("_by", "_v")


def ranked_values(scores: DataFrame, *, by: str, score: str, out: str) -> DataFrame:
    """(_by, _v, out): the normalised rank of each different value of a scene."""
    counts = scores.where(F.col(score).isNotNull()).groupBy(by, F.col(score).alias("_v")).agg(F.count(F.lit(1)).alias("_k"))
    ranged = counts.repartitionByRange(by, "_v").withColumn("_part", F.spark_partition_id())
    parts = ranged.groupBy(by, "_part").agg(F.sum("_k").alias("_in"))
    before = Window.partitionBy(by).orderBy("_part")
    parts = parts.withColumn("_before", F.sum("_in").over(before) - F.col("_in")).withColumn("_n", F.sum("_in").over(Window.partitionBy(by)))
    inside = F.sum("_k").over(Window.partitionBy(by, "_part").orderBy("_v")) - F.col("_k")
    ranked = ranged.join(parts.withColumnsRenamed({by: "_by2", "_part": "_part2"}), (F.col(by) == F.col("_by2")) & (F.col("_part") == F.col("_part2"))).withColumn("_rank", F.col("_before") + inside + (F.col("_k") + 1) / 2)
    norm = F.when(F.col("_n") == 1, 0.5).otherwise((F.col("_rank") - 1) / (F.col("_n") - 1))
    return ranked.select(F.col(by).alias("_by"), "_v", norm.alias(out))


#: Accuracy of the quantile sketch that brackets an exact percentile: the values within two parts in ACCURACY of it are looked at.
ACCURACY = 10_000


def exact_percentile(scores: DataFrame, p: float, *, by: str = "scene_id", score: str = "score") -> DataFrame:
    """(_by, threshold): the percentile of each scene's valid scores, interpolated between two of them, as percentile() has it.

    percentile() holds all the different scores of a scene in one buffer. Here a sketch brackets the two scores, and only
    those between are counted by value. A bracket that missed would be seen by the counts below it, and widened.
    """
    x = scores.select(F.col(by).alias("_by"), F.col(score).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    slack = 2 / ACCURACY
    while True:
        ends = F.percentile_approx("_v", F.array(F.lit(max(0.0, p - slack)), F.lit(min(1.0, p + slack))), F.lit(ACCURACY))
        near = x.groupBy("_by").agg(ends.alias("_ends"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.count("_v").alias("_n"))
        lo = F.col("_least") if p <= slack else F.get("_ends", F.lit(0))
        hi = F.col("_most") if p + slack >= 1 else F.get("_ends", F.lit(1))
        near = stored(near.select("_by", lo.alias("_lo"), hi.alias("_hi"), "_n"), "brackets")
        held = x.join(F.broadcast(near), "_by").where(F.col("_v") <= F.col("_hi"))  # one row a scene
        # The scores below the bracket are one row without a value, which comes first.
        counts = held.groupBy("_by", "_n", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_k"))
        counts = counts.withColumn("_end", F.sum("_k").over(Window.partitionBy("_by").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
        place = (F.col("_n") - 1) * p
        low, high = F.floor(place), F.ceil(place)
        first = lambda k: F.min(F.when(F.col("_end") > k, F.struct("_end", "_v")))["_v"]
        found = counts.groupBy("_by", "_n").agg(first(low).alias("_a"), first(high).alias("_b"))
        between = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise((high - place) * F.col("_a") + (place - low) * F.col("_b"))
        found = stored(found.select("_by", F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), between).alias("threshold")), "thresholds")
        if slack >= 1 or found.where("threshold IS NULL").isEmpty():
            return found
        slack *= 100


def thresholded(scores: DataFrame, *, pct: float = 99.0, by: str = "scene_id", score: str = "score") -> DataFrame:
    """m = 1 where the score reaches the percentile of the scene's valid scores; missing scores give 0."""
    limits = F.broadcast(exact_percentile(scores, pct / 100, by=by, score=score))  # one row a scene
    x = scores.where(F.col(by).isNotNull()).join(limits, F.col(by) == F.col("_by"), "left").drop("_by")
    return x.withColumn("m", F.coalesce((F.col(score) >= F.col("threshold")).cast("int"), F.lit(0)))


def normalised_weights(weights: dict[str, float], present: list[str]) -> dict[str, float]:
    """Weights of the present components, summing to one; a missing component is dropped, never zero-filled."""
    if not present:
        raise ValueError("no components")
    if missing := sorted(set(present) - set(weights)):
        raise ValueError(f"no weight for {missing}")
    total = sum(weights[c] for c in present)
    if total <= 0:
        raise ValueError("weights sum to zero")
    return {c: weights[c] / total for c in sorted(present)}


def fused(components: DataFrame, names: list[str], *, weights: dict[str, float] = WEIGHTS, by: str = "scene_id") -> DataFrame:
    """score = weighted sum of the rank-normalised components, over pixels where all of them are valid."""
    share = normalised_weights(weights, names)
    valid = None
    for n in names:
        valid = F.col(n).isNotNull() if valid is None else valid & F.col(n).isNotNull()
    x = stored(components.withColumns({n: F.when(valid, F.col(n)) for n in names}), "components")
    return _weighed(x, share, by)


def _weighed(x: DataFrame, share: dict[str, float], by: str) -> DataFrame:
    """score = the weighted sum of the columns' ranks. x is a stored table: each column's ranks read it anew, not one another."""
    out, total = x, None
    for n, w in share.items():
        ranks = ranked_values(x, by=by, score=n, out=f"_{n}_rank")
        out = out.join(ranks, (F.col(by) == F.col("_by")) & (F.col(n) == F.col("_v")), "left").drop("_by", "_v")
        term = F.col(f"_{n}_rank") * w
        total = term if total is None else total + term
    return out.withColumn("score", total).drop(*(f"_{n}_rank" for n in share))


def fused_change(signals: DataFrame, *, weights: dict[str, float] = CHANGE_WEIGHTS, cloudy: str | None = None, by: str = "scene_id") -> DataFrame:
    """Weights as given, each signal ranked over its own valid pixels; cloudy pixels score 0, missing ones NULL."""
    if set(weights) - set(CHANGE_WEIGHTS) or set(CHANGE_WEIGHTS) - set(weights) or min(weights.values()) < 0:
        raise ValueError("weights name each signal once, none below zero")
    x = _weighed(stored(signals, "signals"), {n: w for n, w in weights.items() if w}, by)
    if not cloudy:
        return x
    return x.withColumn("score", F.when(F.col("score").isNotNull(), F.when(F.col(cloudy), 0.0).otherwise(F.col("score"))))


def recall_threshold(scored: DataFrame, *, recall: float = 0.98, by: str = "scene_id", score: str = "score", positive: str = "gt") -> DataFrame:
    """The highest threshold that keeps the wanted share of positives, and its false-positive rate.

    Scores are counted by value before the running totals, which then see each
    different score once.
    """
    if not 0 < recall <= 1:
        raise ValueError("recall lies in (0, 1]")
    micro = math.floor(recall * 1e6 + 0.5)
    x = scored.where(F.col(score).isNotNull() & F.col(positive).isNotNull())
    counts = x.groupBy(by, score).agg(F.count_if(positive).alias("_p"), F.count_if(~F.col(positive)).alias("_q"))
    down = Window.partitionBy(by).orderBy(F.col(score).desc())
    every = Window.partitionBy(by)
    c = counts.withColumn("_np", F.sum("_p").over(every)).withColumn("_nq", F.sum("_q").over(every)).withColumn("_cp", F.sum("_p").over(down)).withColumn("_cq", F.sum("_q").over(down))
    k = F.greatest(F.lit(1), F.least(F.col("_np"), F.ceil(F.col("_np") * micro / 1e6)))
    first = c.where((F.col("_np") > 0) & (F.col("_cp") >= k)).groupBy(by).agg(F.max(F.struct(score, "_cq", "_nq")).alias("_x"))
    return first.select(by, F.col(f"_x.{score}").alias("threshold"), F.try_divide(F.col("_x._cq"), F.col("_x._nq")).alias("fp_rate"))


def target_signature(px: DataFrame, scores: DataFrame, *, top: float = 0.001) -> DataFrame:
    """Mean spectrum of the best-scored pixels (at least one); among equal scores the later pixel counts first."""
    n = scores.where(F.col("score").isNotNull()).groupBy("scene_id").agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * top)).cast("long").alias("_k"))
    order = Window.partitionBy("scene_id").orderBy(F.col("score").desc(), F.col("pix").desc())
    best = scores.where(F.col("score").isNotNull()).withColumn("_i", F.row_number().over(order)).join(n, "scene_id").where("_i <= _k").select("scene_id", "pix")
    return px.join(best, ["scene_id", "pix"]).select("scene_id", F.posexplode("spectrum").alias("b", "v")).groupBy("scene_id", "b").agg(F.avg("v").alias("v"))


def confidence(components: dict[str, float]) -> tuple[Column, Column]:
    """(weighted mean of the non-null components, their names in order); none gives 0."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, w in components.items():
        total = total + F.coalesce(F.col(name), F.lit(0.0)) * w
        weight = weight + F.when(F.col(name).isNotNull(), w).otherwise(0.0)
    names = F.array_compact(F.array(*(F.when(F.col(n).isNotNull(), F.lit(n)) for n in components)))
    return F.when(weight > 0, total / weight).otherwise(0.0), names
