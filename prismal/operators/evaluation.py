"""Judging detectors: one row a scene and detector, pooled tables, quotas, budgets, comparisons of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismal.operators import metrics, scoring

# --- one scene --------------------------------------------------------------


def at_thresholds(scored: DataFrame, thresholds: DataFrame, *, by: list[str], score: str = "score", positive: str = "gt", weight: str | None = None) -> DataFrame:
    """precision, recall, f1, iou of each group at its own threshold; weighed if asked for, 0 where a ratio has no denominator."""
    w = F.col(weight) if weight else F.lit(1.0)
    flag, truth = F.col(score) >= F.col("threshold"), F.col(positive)
    x = scored.where(F.col(score).isNotNull() & truth.isNotNull()).join(thresholds.select(*by, "threshold"), by)
    sums = {"tp": flag & truth, "fp": flag & ~truth, "fn": ~flag & truth}
    x = x.groupBy(*by).agg(F.first("threshold").alias("threshold"), *(F.sum(F.when(c, w).otherwise(0.0)).alias(k) for k, c in sums.items()))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    x = x.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return x.withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).withColumn("iou", ratio(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")))


def judged(scored: DataFrame, *, by: list[str], recall: float = 0.98, score: str = "score", positive: str = "gt") -> DataFrame:
    """One row a group: status, n_px, n_valid, n_anom, and where it is ok both areas and the figures at the wanted recall.

    all_nan: no score at all. degenerate_labels: only one class among the scored pixels.
    """
    valid = F.col(score).isNotNull()
    x = scored.groupBy(*by).agg(F.count(F.lit(1)).alias("n_px"), F.count_if(valid).alias("n_valid"), F.count_if(F.col(positive)).alias("n_anom"), F.count_if(valid & F.col(positive)).alias("_p"))
    status = F.when(F.col("n_valid") == 0, "all_nan").when((F.col("_p") == 0) | (F.col("_p") == F.col("n_valid")), "degenerate_labels").otherwise("ok")
    x = x.withColumn("status", status).drop("_p")
    key = F.concat_ws("\x1f", *(F.col(c).cast("string") for c in by))
    named = scored.withColumn("_by", key)
    limits = scoring.recall_threshold(named, recall=recall, by="_by", score=score, positive=positive).drop("fp_rate")
    at = at_thresholds(named, limits, by=["_by"], score=score, positive=positive).drop("tp", "fp", "fn", "iou")
    areas = metrics.roc_auc(named, by=["_by"], score=score, positive=positive).join(metrics.average_precision(named, by=["_by"], score=score, positive=positive), "_by")
    full = x.withColumn("_by", key).join(areas, "_by", "left").join(at, "_by", "left").drop("_by")
    figures = ("roc_auc", "pr_auc", "threshold", "precision", "recall", "f1")
    return full.withColumns({c: F.when(F.col("status") == "ok", F.col(c)) for c in figures})


def threshold_at_recall(scored: DataFrame, recall: float, *, by: list[str], score: str = "score", positive: str = "gt") -> DataFrame:
    """The highest score down to which the share of positives reaches `recall`, and precision, recall and f1 there."""
    c = metrics._by_value(scored, by, score, positive)
    down = Window.partitionBy(*by).orderBy(F.col("_s").desc())
    c = c.withColumn("_tp", F.sum("p").over(down)).withColumn("_np", F.sum("p").over(Window.partitionBy(*by)))
    limits = c.where(F.col("_tp") / F.greatest(F.col("_np"), F.lit(1)) >= recall).groupBy(*by).agg(F.max("_s").alias("threshold"))
    return at_thresholds(scored, limits, by=by, score=score, positive=positive)


def flagged_share(scored: DataFrame, region: Column, threshold: Column, *, by: list[str], score: str = "score") -> DataFrame:
    """The share of a region's scored pixels that reach the threshold; NULL where it has none."""
    return scored.groupBy(*by).agg(F.avg(F.when(region & F.col(score).isNotNull(), (F.col(score) >= threshold).cast("double"))).alias("rate"))


# --- pooled tables ----------------------------------------------------------


def pooled(rows: DataFrame, measures: list[str], *, by: list[str], weight: str = "n_anom", every: DataFrame | None = None) -> DataFrame:
    """By group: n_scenes, n_failed, and of each measure the mean over scenes (_MACRO) and the one weighted by `weight` (_micro).

    Groups without a scene that is ok go, unless `every` lists the groups: then all of those stay.
    """
    good = F.col("status") == "ok"
    out = []
    for m in measures:
        usable = good & F.col(m).isNotNull()
        out += [F.avg(F.when(good, F.col(m))).alias(f"{m}_MACRO"), F.try_divide(F.sum(F.when(usable, F.col(m) * F.col(weight))), F.sum(F.when(usable, F.col(weight).cast("double")))).alias(f"{m}_micro")]
    x = rows.groupBy(*by).agg(F.count_if(good).alias("n_scenes"), F.count_if(~good).alias("n_failed"), *out)
    if every is None:
        return x.where("n_scenes > 0")
    return every.join(x, by, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_scenes", "n_failed")})


def with_deferred(rows: DataFrame, deferred: dict[str, str]) -> DataFrame:
    """rows and one more for each detector that is put off, with its reason as the note."""
    more = rows.sparkSession.createDataFrame([(k, "DEFERRED", v) for k, v in deferred.items()], "detector string, status string, note string")
    return rows.unionByName(more, allowMissingColumns=True)


def best_of_sweep(sweep: DataFrame, *, by: list[str], value: str, order: str) -> DataFrame:
    """The candidate with the greatest value of each group: missing values lose, the first of equals wins."""
    turn = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(value).desc_nulls_last(), F.col(order)))
    return sweep.withColumn("_turn", turn).where("_turn = 1").drop("_turn")


# --- samples and quotas -----------------------------------------------------


def seeded(*parts: Column, seed: int = 0) -> Column:
    """A text that orders rows at random, the same in every engine."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), *(p.cast("string") for p in parts)))


def natural_sample(px: DataFrame, max_background: int, *, by: str = "scene_id", key: str = "pix", positive: str = "gt", seed: int = 0) -> DataFrame:
    """All positives and up to max_background negatives a scene, each with the weight that restores the true prevalence.

    The bound is the feature: what is drawn is scored by arms that cost much a pixel.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(by, positive))
    turn = F.row_number().over(Window.partitionBy(by, positive).orderBy(seeded(F.col(key), seed=seed), F.col(key)))
    x = px.withColumn("_n", n).withColumn("_turn", turn).where(F.col(positive) | (F.col("_turn") <= max_background))
    return x.withColumn("weight", F.when(F.col(positive), 1.0).otherwise(F.col("_n") / F.least(F.col("_n"), F.lit(max_background)))).drop("_n", "_turn")


def capped_scenes(px: DataFrame, n_background: int, n_positive: int, *, by: str = "scene_id", key: str = "pix", positive: str = "gt", seed: int = 0) -> DataFrame:
    """At most so many negatives and positives of each scene."""
    turn = F.row_number().over(Window.partitionBy(by, positive).orderBy(seeded(F.col(key), seed=seed), F.col(key)))
    return px.withColumn("_turn", turn).where(F.col("_turn") <= F.when(F.col(positive), n_positive).otherwise(n_background)).drop("_turn")


def quotas(px: DataFrame, cap: int, *, line: str = "line", positive: str = "gt") -> DataFrame:
    """line, share, n_background, n_positive: `cap` dealt evenly over the lines, the first ones getting the rest.

    Half of a share, rounded up, is background; one of it goes to the positives where they would get none but exist.
    """
    lines = px.groupBy(line).agg(F.count_if(F.col(positive)).alias("_p"))  # one row a line
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(line)) - 1
    x = lines.withColumn("_i", place).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    x = x.withColumn("share", F.floor(F.lit(cap) / F.col("_n")) + (F.col("_i") < F.lit(cap) % F.col("_n")).cast("long"))
    half = F.ceil(F.col("share") / 2)
    borrows = (F.col("share") - half == 0) & (F.col("share") > 0) & (F.col("_p") > 0)
    return x.select(line, "share", F.when(borrows, F.col("share") - 1).otherwise(half).alias("n_background"), F.when(borrows, 1).otherwise(F.col("share") - half).cast("long").alias("n_positive"))


def assembled(px: DataFrame, cap: int, *, line: str = "line", key: str = "pix", positive: str = "gt", seed: int = 0) -> DataFrame:
    """The rows of a split: each line's quota of both classes, drawn at random; what a small line leaves isn't dealt again."""
    dealt = quotas(px, cap, line=line, positive=positive).withColumnRenamed(line, "_line")
    turn = F.row_number().over(Window.partitionBy(line, positive).orderBy(seeded(F.col(key), seed=seed), F.col(key)))
    x = px.withColumn("_turn", turn).join(F.broadcast(dealt), F.col(line) == F.col("_line"))  # one row a line
    return x.where(F.col("_turn") <= F.when(F.col(positive), F.col("n_positive")).otherwise(F.col("n_background"))).drop("_turn", "_line", "share", "n_background", "n_positive")


# --- budgets of the second stage --------------------------------------------


def windows_of(rois: DataFrame, patch: int, h: Column, w: Column) -> DataFrame:
    """scene_id, wr, wc: the different windows that a second stage reads for rois(scene_id, r0, c0, r1, c1).

    A box that fits a patch gets one window around its middle; a larger one is tiled. Windows are moved into the scene.
    """
    fits = (F.col("r1") - F.col("r0") <= patch) & (F.col("c1") - F.col("c0") <= patch)

    def starts(a: str, b: str) -> Column:
        tiled = F.when(F.col(b) - F.col(a) > patch, F.sequence(F.col(a), F.col(b) - 1, F.lit(patch).cast("long"))).otherwise(F.array(F.col(a)))
        return F.when(fits, F.array(F.floor((F.col(a) + F.col(b)) / 2) - patch // 2)).otherwise(tiled)

    def moved(x: str, size: Column) -> Column:
        return F.when(size <= patch, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.col(x), size - patch))).cast("long")

    x = rois.select("*", F.explode(starts("r0", "r1")).alias("_wr")).select("*", F.explode(starts("c0", "c1")).alias("_wc"))
    return x.select("scene_id", moved("_wr", h).alias("wr"), moved("_wc", w).alias("wc")).distinct()


def second_stage(windows: DataFrame, scenes: DataFrame, patch: int, *, most: float = 0.10) -> DataFrame:
    """By scene(scene_id, h, w): pixels that the second stage reads, of the scene, of a full pass, and whether the share is small enough."""
    read = windows.groupBy("scene_id").agg((F.count(F.lit(1)) * patch * patch).alias("_px"))
    x = scenes.join(read, "scene_id", "left").withColumn("px_read", F.coalesce("_px", F.lit(0).cast("long"))).drop("_px")
    x = x.withColumn("px_scene", F.col("h") * F.col("w")).withColumn("px_full", (F.ceil(F.col("h") / patch) * F.ceil(F.col("w") / patch) * patch * patch).cast("long"))
    x = x.withColumn("fraction", F.col("px_read") / F.col("px_scene"))
    return x.withColumn("fraction_met", F.col("fraction") < most)


# --- runs against runs ------------------------------------------------------


def accuracy_delta(before: DataFrame, after: DataFrame, *, by: list[str], figures: tuple[str, ...] = ("roc_auc", "f1", "iou"), most_loss: float = 0.01) -> DataFrame:
    """delta_* of each figure, and whether the loss of area is small enough."""
    x = before.select(*by, *(F.col(f).alias(f"_{f}") for f in figures)).join(after, by)
    x = x.withColumns({f"delta_{f}": F.col(f) - F.col(f"_{f}") for f in figures})
    return x.withColumn("accepted", F.col(f"delta_{figures[0]}") >= -most_loss).select(*by, *(f"delta_{f}" for f in figures), "accepted")


def regressed(baseline: DataFrame, current: DataFrame, *, stage: str = "stage", seconds: str = "seconds", tolerance: float = 0.15) -> DataFrame:
    """Stages of both runs that have become slower by more than the tolerance; a baseline of 0 says nothing."""
    x = baseline.select(stage, F.col(seconds).alias("_base")).join(current.select(stage, F.col(seconds).alias("_now")), stage)
    x = x.where("_base > 0").withColumn("ratio", F.col("_now") / F.col("_base"))
    return x.where(F.col("ratio") > 1 + tolerance).select(stage, "ratio")


# --- profiles of scenes -----------------------------------------------------


def band_profile(px: DataFrame, *, by: list[str]) -> DataFrame:
    """By group and band: values, missing ones, negatives, range."""
    x = px.select(*by, F.posexplode("spectrum").alias("b", "v"))
    return x.groupBy(*by, "b").agg(F.count("v").alias("n"), F.count_if(F.col("v").isNull()).alias("n_missing"), F.count_if(F.col("v") < 0).alias("n_negative"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def scene_profile(px: DataFrame, bands: DataFrame) -> DataFrame:
    """What a scene is checked for: pixels, rows, columns, different band counts, share without data, whether the grid is full and the axis ascends."""
    axis = bands.agg(F.array_sort(F.collect_list(F.struct("b", "wl"))).alias("w"))
    up = axis.select(F.forall(F.zip_with(F.slice(F.col("w")["wl"], 1, F.size("w") - 1), F.slice(F.col("w")["wl"], 2, F.size("w") - 1), lambda a, b: b > a), lambda x: x).alias("ascending"))
    x = px.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n_px"), (F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"), F.countDistinct(F.size("spectrum")).alias("n_widths"), F.avg(F.col("spectrum").isNull().cast("double")).alias("nodata"))
    return x.withColumn("full", F.col("n_px") == F.col("h") * F.col("w")).join(F.broadcast(up), F.lit(True))  # one row


def sensor_confound(intervals: DataFrame) -> DataFrame:
    """Mean of `sam` over intervals(s1, s2, sam) of one sensor and of two."""
    return intervals.groupBy((F.col("s1") == F.col("s2")).alias("same_sensor")).agg(F.count(F.lit(1)).alias("n"), F.avg("sam").alias("mean_sam"))


def interval_pairs(*lists: DataFrame) -> DataFrame:
    """All pairs (i, j) of several lists, once each, in order."""
    return reduce(DataFrame.unionByName, lists).distinct().orderBy("i", "j")


def off_diagonal(kernel: DataFrame) -> DataFrame:
    """Mean and 99th percentile of a kernel matrix(i, j, v) beside its diagonal."""
    return kernel.where("i <> j").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean_offdiag"), F.percentile("v", F.lit(0.99)).alias("p99_offdiag"))


# --- tables to look at ------------------------------------------------------


def first_pixels(px: DataFrame, limit: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """The first pixels in row order, and a row that says how many there are and whether some were left out. The limit is that of a spreadsheet."""
    n = px.agg(F.count(F.lit(1)).alias("n_px")).withColumn("truncated", F.col("n_px") > limit)
    return px.orderBy("scene_id", "r", "c").limit(limit), n


def stretched(px: DataFrame, band_numbers: list[int], *, lo: float = 2.0, hi: float = 98.0) -> DataFrame:
    """pix, and each band's value between two percentiles as 0..255."""
    x = px.select("scene_id", "pix", F.explode(F.array(*(F.struct(F.lit(b).alias("b"), F.get("spectrum", F.lit(b)).alias("score")) for b in band_numbers))).alias("_e")).select(F.concat_ws(":", "scene_id", "_e.b").alias("scene_id"), "pix", "_e.b", "_e.score")
    norm = scoring.percentile_normalised(x, lo=lo, hi=hi)
    return norm.select("pix", "b", F.floor(F.col("norm") * 255).cast("int").alias("level"))


def preview_bands(n: int) -> list[int]:
    """Three bands spread evenly over an axis, its ends included."""
    if n < 3:
        raise ValueError("a preview needs three bands")
    return [0, (n - 1) // 2, n - 1]
