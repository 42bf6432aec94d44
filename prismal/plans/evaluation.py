"""Queries that judge detectors, pool their figures, and deal out samples and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismal.operators import evaluation, metrics, scoring
from prismal.plans.dialect import EP, GR, PX, Q, q
from prismal.plans.queries import _RECT, _rects
from prismal.plans.registry import query
from prismal.sources import scenes

T = scenes.table

# --- one row a scene --------------------------------------------------------

#: Twelve scenes: one without a positive, one without a score.
_SCORED = "sc AS (SELECT l_suppkey % 12 AS scene, CASE WHEN l_suppkey % 12 = 11 OR l_orderkey % 19 = 0 THEN NULL ELSE l_extendedprice END AS score, l_returnflag = 'R' AND l_suppkey % 12 <> 10 AS gt, 1.0::DOUBLE + l_linenumber / 4.0::DOUBLE AS w FROM lineitem)"
_JUDGED = (
    f"{_SCORED}, st AS (SELECT scene, count(*) AS n_px, count(score) AS n_valid, count(*) FILTER (WHERE gt) AS n_anom, count(*) FILTER (WHERE gt AND score IS NOT NULL) AS np FROM sc GROUP BY 1), "
    "vl AS (SELECT scene, score AS s, count(*) FILTER (WHERE gt) AS p, count(*) FILTER (WHERE NOT gt) AS q FROM sc WHERE score IS NOT NULL GROUP BY 1, 2), "
    "ro AS (SELECT scene, sum(p * (below + q / 2.0::DOUBLE)) / nullif(CAST(sum(p) * sum(q) AS DOUBLE), 0) AS roc_auc FROM (SELECT *, sum(q) OVER (PARTITION BY scene ORDER BY s) - q AS below FROM vl) GROUP BY 1), "
    "pr AS (SELECT scene, sum(p * tp / al) / nullif(CAST(sum(p) AS DOUBLE), 0) AS pr_auc FROM (SELECT scene, p::DOUBLE AS p, sum(p) OVER w AS tp, sum(p + q) OVER w AS al FROM vl WINDOW w AS (PARTITION BY scene ORDER BY s DESC)) GROUP BY 1), "
    "th AS (SELECT scene, score AS threshold FROM (SELECT scene, score, row_number() OVER (PARTITION BY scene ORDER BY score DESC) AS k FROM sc WHERE gt AND score IS NOT NULL) JOIN st USING (scene) WHERE k = greatest(1, least(np, CAST(ceil(np * 980000 / 1000000.0::DOUBLE) AS BIGINT)))), "
    "cf AS (SELECT scene, any_value(threshold) AS threshold, count(*) FILTER (WHERE score >= threshold AND gt)::DOUBLE AS tp, count(*) FILTER (WHERE score >= threshold AND NOT gt)::DOUBLE AS fp, count(*) FILTER (WHERE score < threshold AND gt)::DOUBLE AS fn FROM sc JOIN th USING (scene) WHERE score IS NOT NULL GROUP BY 1), "
    "jd AS (SELECT st.*, CASE WHEN n_valid = 0 THEN 'all_nan' WHEN np = 0 OR np = n_valid THEN 'degenerate_labels' ELSE 'ok' END AS status, roc_auc, pr_auc, threshold, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM st LEFT JOIN ro USING (scene) LEFT JOIN pr USING (scene) LEFT JOIN cf USING (scene))"
)
_FIGURES = ("roc_auc", "pr_auc", "precision", "recall", "f1")


def _scored(spark, d):
    scene = F.col("l_suppkey") % 12
    return T(spark, d, "lineitem").select(scene.alias("scene"), F.when((scene != 11) & (F.col("l_orderkey") % 19 != 0), F.col("l_extendedprice")).alias("score"), ((F.col("l_returnflag") == "R") & (scene != 10)).alias("gt"), (1.0 + F.col("l_linenumber") / 4.0).alias("w"))


@query(f"WITH {_JUDGED} SELECT scene, n_px, n_valid, n_anom, status, " + ", ".join(f"CASE WHEN status = 'ok' THEN {Q(f)} END AS {f}" for f in _FIGURES) + ", CASE WHEN status = 'ok' THEN threshold END AS threshold FROM jd")
def scene_metrics(spark, d) -> DataFrame:
    x = evaluation.judged(_scored(spark, d), by=["scene"])
    return x.select("scene", "n_px", "n_valid", "n_anom", "status", *(q(F.col(f)).alias(f) for f in _FIGURES), "threshold")


_DET = "rows_ AS (SELECT scene % 2 AS dataset, scene % 3 AS detector, * FROM jd)"


def _table(spark, d):
    x = evaluation.judged(_scored(spark, d), by=["scene"])
    return x.withColumn("dataset", F.col("scene") % 2).withColumn("detector", F.col("scene") % 3)


@query(
    f"WITH {_JUDGED}, {_DET}, po AS (SELECT dataset, detector, count(*) FILTER (WHERE status = 'ok') AS n_scenes, count(*) FILTER (WHERE status <> 'ok') AS n_failed, avg(CASE WHEN status = 'ok' THEN roc_auc END) AS a, sum(CASE WHEN status = 'ok' THEN roc_auc * n_anom END) / sum(CASE WHEN status = 'ok' THEN n_anom END) AS b, avg(CASE WHEN status = 'ok' THEN f1 END) AS c FROM rows_ GROUP BY 1, 2) "
    f"SELECT dataset, detector, n_scenes, n_failed, {Q('a')} AS roc_auc_macro, {Q('b')} AS roc_auc_micro, {Q('c')} AS f1_macro, row_number() OVER (ORDER BY dataset, a DESC) AS place FROM po WHERE n_scenes > 0"
)
def pooled_table(spark, d) -> DataFrame:
    """Scene means and pixel-weighted means by dataset and detector, in the order of the report."""
    x = evaluation.pooled(_table(spark, d), ["roc_auc", "f1"], by=["dataset", "detector"])
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("dataset", F.desc("roc_auc_MACRO"))).cast("long")
    return x.select("dataset", "detector", "n_scenes", "n_failed", q(F.col("roc_auc_MACRO")).alias("roc_auc_macro"), q(F.col("roc_auc_micro")).alias("roc_auc_micro"), q(F.col("f1_MACRO")).alias("f1_macro"), place.alias("place"))


@query(f"WITH {_JUDGED} SELECT a.arm, count(j.scene) FILTER (WHERE status = 'ok') AS n_scenes, count(j.scene) FILTER (WHERE status <> 'ok') AS n_failed, {Q('avg(CASE WHEN status = ' + chr(39) + 'ok' + chr(39) + ' THEN roc_auc END)')} AS roc_auc_macro FROM (SELECT unnest(range(14)) AS arm) a LEFT JOIN jd j ON j.scene = a.arm GROUP BY 1")
def pooled_arms(spark, d) -> DataFrame:
    """Arms without a single good scene, or without any, stay in the table."""
    arms = spark.range(14).select(F.col("id").alias("scene"))
    x = evaluation.pooled(evaluation.judged(_scored(spark, d), by=["scene"]), ["roc_auc"], by=["scene"], every=arms)
    return x.select(F.col("scene").alias("arm"), "n_scenes", "n_failed", q(F.col("roc_auc_MACRO")).alias("roc_auc_macro"))


@query(f"WITH {_JUDGED}, al AS (SELECT CAST(scene AS VARCHAR) AS detector, status FROM jd UNION ALL SELECT * FROM (VALUES ('deep_detector', 'DEFERRED'), ('kpca_autoencoder', 'DEFERRED'))) SELECT detector, status FROM al")
def deferred_rows(spark, d) -> DataFrame:
    x = evaluation.judged(_scored(spark, d), by=["scene"]).select(F.col("scene").cast("string").alias("detector"), "status")
    return evaluation.with_deferred(x, {"kpca_autoencoder": "not started", "deep_detector": "not started"}).select("detector", "status")


@query(f"WITH {_SCORED}, vl AS (SELECT scene, score AS s, sum(w) FILTER (WHERE gt) AS p, sum(w) FILTER (WHERE NOT gt) AS q FROM sc WHERE score IS NOT NULL AND scene < 10 GROUP BY 1, 2), wv AS (SELECT scene, s, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM vl) SELECT scene, {Q('sum(p * (below + q / 2)) / (sum(p) * sum(q))')} AS roc_auc, {Q('sum(p * tp / al) / sum(p)')} AS pr_auc FROM (SELECT *, sum(q) OVER (PARTITION BY scene ORDER BY s) - q AS below, sum(p) OVER w AS tp, sum(p + q) OVER w AS al FROM wv WINDOW w AS (PARTITION BY scene ORDER BY s DESC)) GROUP BY 1")
def weighted_areas(spark, d) -> DataFrame:
    """Both areas with a weight for each row."""
    x = _scored(spark, d).where("scene < 10")
    both = metrics.roc_auc(x, by=["scene"], weight="w").join(metrics.average_precision(x, by=["scene"], weight="w"), "scene")
    return both.select("scene", q(F.col("roc_auc")).alias("roc_auc"), q(F.col("pr_auc")).alias("pr_auc"))


@query(f"WITH {_SCORED} SELECT scene, {Q('tp / nullif(tp + fp, 0)')} AS precision, {Q('tp / nullif(tp + fn, 0)')} AS recall, {Q('2 * tp / nullif(2 * tp + fp + fn, 0)')} AS f1 FROM (SELECT scene, sum(w) FILTER (WHERE score >= 30000 + 1000 * scene AND gt) AS tp, sum(w) FILTER (WHERE score >= 30000 + 1000 * scene AND NOT gt) AS fp, sum(w) FILTER (WHERE score < 30000 + 1000 * scene AND gt) AS fn FROM sc WHERE scene < 10 GROUP BY 1)")
def weighted_confusion(spark, d) -> DataFrame:
    x = _scored(spark, d).where("scene < 10")
    limits = x.select("scene").distinct().withColumn("threshold", 30000.0 + 1000 * F.col("scene"))
    at = evaluation.at_thresholds(x, limits, by=["scene"], weight="w")
    return at.select("scene", *(q(F.col(f)).alias(f) for f in ("precision", "recall", "f1")))


@query(f"WITH {_SCORED}, rk AS (SELECT *, sum(CAST(gt AS INTEGER)) OVER (PARTITION BY scene ORDER BY score DESC) AS c, sum(CAST(gt AS INTEGER)) OVER (PARTITION BY scene) AS np FROM sc WHERE score IS NOT NULL AND scene < 10), th AS (SELECT scene, max(score) AS t FROM rk WHERE c / np::DOUBLE >= 0.9 GROUP BY 1) SELECT scene, t AS threshold, {Q('avg(CAST(gt AS DOUBLE)) FILTER (WHERE score >= t)')} AS precision, {Q('count(*) FILTER (WHERE gt AND score >= t) / any_value(np)::DOUBLE')} AS recall FROM rk JOIN th USING (scene) GROUP BY 1, 2")
def recall_cutoff(spark, d) -> DataFrame:
    x = evaluation.threshold_at_recall(_scored(spark, d).where("scene < 10"), 0.9, by=["scene"])
    return x.select("scene", "threshold", q(F.col("precision")).alias("precision"), q(F.col("recall")).alias("recall"))


@query(f"WITH {_SCORED} SELECT scene, {Q('avg(CASE WHEN w < 2 AND score IS NOT NULL THEN CAST(score >= 30000 AS INTEGER) END)')} AS rate FROM sc GROUP BY 1")
def pseudo_change_rate(spark, d) -> DataFrame:
    x = evaluation.flagged_share(_scored(spark, d), F.col("w") < 2, F.lit(30000.0), by=["scene"])
    return x.select("scene", q(F.col("rate")).alias("rate"))


@query("SELECT l_suppkey % 7 AS grp, arg_max(k, (v, -k)) AS k FROM (SELECT l_suppkey, l_linenumber AS k, CASE WHEN l_linenumber = 3 THEN NULL ELSE floor(avg(l_quantity) * 10) END AS v FROM (SELECT l_suppkey % 7 AS l_suppkey, l_linenumber, l_quantity FROM lineitem) GROUP BY 1, 2) WHERE v IS NOT NULL GROUP BY 1")
def best_of_sweep(spark, d) -> DataFrame:
    x = T(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("grp"), F.col("l_linenumber").alias("k")).agg(F.floor(F.avg("l_quantity") * 10).alias("v"))
    return evaluation.best_of_sweep(x.withColumn("v", F.when(F.col("k") != 3, F.col("v"))), by=["grp"], value="v", order="k").select("grp", "k")


# --- samples and quotas -----------------------------------------------------

_SAMPLE = "px2 AS (SELECT c_custkey AS pix, c_nationkey AS line, c_mktsegment = 'BUILDING' AS gt FROM customer)"


def _lines(spark, d):
    return T(spark, d, "customer").select(F.col("c_custkey").alias("pix"), F.col("c_nationkey").alias("line"), (F.col("c_mktsegment") == "BUILDING").alias("gt"))


@query(f"WITH {_SAMPLE}, rk AS (SELECT *, count(*) OVER (PARTITION BY line, gt) AS n, row_number() OVER (PARTITION BY line, gt ORDER BY md5('0/' || pix), pix) AS k FROM px2) SELECT line, pix, gt, {Q('CASE WHEN gt THEN 1 ELSE n / least(n, 20)::DOUBLE END')} AS weight FROM rk WHERE gt OR k <= 20")
def natural_sample(spark, d) -> DataFrame:
    return evaluation.natural_sample(_lines(spark, d), 20, by="line").withColumn("weight", q(F.col("weight")))


@query(f"WITH {_SAMPLE} SELECT line, pix FROM (SELECT *, row_number() OVER (PARTITION BY line, gt ORDER BY md5('0/' || pix), pix) AS k FROM px2) WHERE k <= CASE WHEN gt THEN 5 ELSE 9 END")
def capped_scenes(spark, d) -> DataFrame:
    return evaluation.capped_scenes(_lines(spark, d), 9, 5, by="line").select("line", "pix")


_QUOTA = f"{_SAMPLE}, ln AS (SELECT line, count(*) FILTER (WHERE gt) AS p, row_number() OVER (ORDER BY line) - 1 AS i, count(*) OVER () AS n FROM px2 GROUP BY line), sh AS (SELECT *, 130 // n + CASE WHEN i < 130 % n THEN 1 ELSE 0 END AS share FROM ln), qt AS (SELECT line, share, CASE WHEN share // 2 = 0 AND share > 0 AND p > 0 THEN share - 1 ELSE (share + 1) // 2 END AS nb, CASE WHEN share // 2 = 0 AND share > 0 AND p > 0 THEN 1 ELSE share // 2 END AS np FROM sh)"


@query(f"WITH {_QUOTA} SELECT line, share, nb AS n_background, np AS n_positive FROM qt")
def split_quotas(spark, d) -> DataFrame:
    return evaluation.quotas(_lines(spark, d), 130).select("line", *(F.col(c).cast("long").alias(c) for c in ("share", "n_background", "n_positive")))


@query(f"WITH {_QUOTA} SELECT line, pix, gt FROM (SELECT *, row_number() OVER (PARTITION BY line, gt ORDER BY md5('0/' || pix), pix) AS k FROM px2) JOIN qt USING (line) WHERE k <= CASE WHEN gt THEN np ELSE nb END")
def assembled_split(spark, d) -> DataFrame:
    return evaluation.assembled(_lines(spark, d), 130).select("line", "pix", "gt")


# --- budgets ----------------------------------------------------------------

_WINDOWS = (
    f"{_RECT}, bx AS (SELECT scene_id, r0, c0, r0 + h AS r1, c0 + w AS c1 FROM rt), "
    "sr AS (SELECT *, r1 - r0 <= 4 AND c1 - c0 <= 4 AS fits FROM bx), "
    "ws AS (SELECT scene_id, CASE WHEN fits THEN (r0 + r1) // 2 - 2 ELSE r0 + 4 * i END AS r, CASE WHEN fits THEN (c0 + c1) // 2 - 2 ELSE c0 + 4 * j END AS c FROM sr, range(3) a(i), range(3) b(j) WHERE CASE WHEN fits THEN i = 0 AND j = 0 ELSE r0 + 4 * i < r1 AND c0 + 4 * j < c1 AND (r1 - r0 > 4 OR i = 0) AND (c1 - c0 > 4 OR j = 0) END), "
    "wn AS (SELECT DISTINCT scene_id, greatest(0, least(r, 50 - 4)) AS wr, greatest(0, least(c, 46 - 4)) AS wc FROM ws)"
)


def _boxes(spark, d):
    return _rects(spark, d).select("scene_id", "r0", "c0", (F.col("r0") + F.col("h")).alias("r1"), (F.col("c0") + F.col("w")).alias("c1"))


@query(f"WITH {_WINDOWS} SELECT scene_id, wr, wc FROM wn")
def second_stage_windows(spark, d) -> DataFrame:
    return evaluation.windows_of(_boxes(spark, d), 4, F.lit(50), F.lit(46))


@query(f"WITH {_WINDOWS} SELECT scene_id, count(*) * 16 AS px_read, CAST(2300 AS BIGINT) AS px_scene, CAST(13 * 12 * 16 AS BIGINT) AS px_full, {Q('count(*) * 16 / 2300.0::DOUBLE')} AS fraction, count(*) * 16 / 2300.0::DOUBLE < 0.1 AS fraction_met FROM wn GROUP BY 1")
def second_stage_budget(spark, d) -> DataFrame:
    boxes = _boxes(spark, d)
    where = boxes.select("scene_id").distinct().withColumn("h", F.lit(50).cast("long")).withColumn("w", F.lit(46).cast("long"))
    x = evaluation.second_stage(evaluation.windows_of(boxes, 4, F.lit(50), F.lit(46)), where, 4)
    return x.select("scene_id", "px_read", "px_scene", "px_full", q(F.col("fraction")).alias("fraction"), "fraction_met")


@query(f"WITH {_JUDGED} SELECT scene, {Q('-0.002 * scene')} AS delta_roc_auc, {Q('0.1 * scene')} AS delta_f1, -0.002::DOUBLE * scene >= -0.01 AS accepted FROM (SELECT DISTINCT scene::DOUBLE AS scene FROM jd WHERE status = 'ok')")
def accuracy_delta(spark, d) -> DataFrame:
    x = evaluation.judged(_scored(spark, d), by=["scene"]).where("status = 'ok'").select(F.col("scene").cast("double").alias("scene"), "roc_auc", "f1")
    after = x.withColumn("roc_auc", F.col("roc_auc") - 0.002 * F.col("scene")).withColumn("f1", F.col("f1") + 0.1 * F.col("scene"))
    out = evaluation.accuracy_delta(x, after, by=["scene"], figures=("roc_auc", "f1"), most_loss=0.01 + 1e-12)
    return out.select("scene", q(F.col("delta_roc_auc")).alias("delta_roc_auc"), q(F.col("delta_f1")).alias("delta_f1"), "accepted")


@query(f"WITH b AS (SELECT l_linenumber AS stage, avg(l_quantity) AS s FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), c AS (SELECT l_linenumber AS stage, avg(l_quantity) * (1 + l_linenumber / 20.0::DOUBLE) AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT stage, {Q('c.s / b.s')} AS ratio FROM b JOIN c USING (stage) WHERE c.s / b.s > 1.15")
def regressed_stages(spark, d) -> DataFrame:
    x = T(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("stage"), "l_returnflag").agg(F.avg("l_quantity").alias("seconds"))
    now = x.where("l_returnflag = 'R'").withColumn("seconds", F.col("seconds") * (1 + F.col("stage") / 20.0))
    return evaluation.regressed(x.where("l_returnflag = 'A'"), now).select("stage", q(F.col("ratio")).alias("ratio"))


# --- profiles ---------------------------------------------------------------


@query(f"WITH {EP}, lg AS (SELECT epoch, unnest(s) AS v, generate_subscripts(s, 1) - 1 AS b FROM ep), rl AS (SELECT epoch, b, v - 0.5 AS v FROM lg) SELECT epoch, CAST(b AS INTEGER) AS b, count(*) AS n, count(*) FILTER (WHERE v < 0) AS n_negative, {Q('min(v)')} AS lo, {Q('max(v)')} AS hi FROM rl GROUP BY 1, 2")
def epoch_profile(spark, d) -> DataFrame:
    """By date and band: values, negatives, range."""
    px = scenes.epochs(spark, d).withColumn("spectrum", F.transform("spectrum", lambda v: v - 0.5))
    return evaluation.band_profile(px, by=["epoch"]).select("epoch", "b", "n", "n_negative", q(F.col("lo")).alias("lo"), q(F.col("hi")).alias("hi"))


@query(f"WITH {PX} SELECT count(*) AS n_px, max(r) + 1 AS h, max(c) + 1 AS w, count(DISTINCT len(s)) AS n_widths, {Q('avg(CASE WHEN pix % 17 = 0 THEN 1.0 ELSE 0.0 END)')} AS nodata, count(*) = (max(r) + 1) * (max(c) + 1) AS full, true AS ascending FROM px")
def scene_profile(spark, d) -> DataFrame:
    x = evaluation.scene_profile(scenes.pixels(spark, d, nodata_every=17), scenes.bands(spark))
    return x.select("n_px", "h", "w", "n_widths", q(F.col("nodata")).alias("nodata"), "full", "ascending")


@query(f"WITH {EP}, iv AS (SELECT x.epoch AS e1, y.epoch AS e2, avg(abs(x.s[1] - y.s[1])) AS sam FROM ep x JOIN ep y USING (pix) WHERE x.epoch < y.epoch AND y.epoch <= x.epoch + 2 GROUP BY 1, 2) SELECT e1 % 2 = e2 % 2 AS same_sensor, count(*) AS n, {Q('avg(sam)')} AS mean_sam FROM iv GROUP BY 1")
def sensor_confound(spark, d) -> DataFrame:
    e = scenes.epochs(spark, d).select("pix", "epoch", F.get("spectrum", F.lit(0)).alias("v"))
    pairs = e.select("pix", F.col("epoch").alias("e1"), F.col("v").alias("a")).join(e.select("pix", F.col("epoch").alias("e2"), F.col("v").alias("b")), "pix").where("e1 < e2 AND e2 <= e1 + 2")
    iv = pairs.groupBy("e1", "e2").agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("sam")).select((F.col("e1") % 2).alias("s1"), (F.col("e2") % 2).alias("s2"), "sam")
    return evaluation.sensor_confound(iv).select("same_sensor", "n", q(F.col("mean_sam")).alias("mean_sam"))


@query("SELECT i, j, row_number() OVER (ORDER BY i, j) AS place FROM (SELECT c_nationkey AS i, CAST(c_custkey % 5 AS BIGINT) AS j FROM customer UNION SELECT s_nationkey, CAST(s_suppkey % 7 AS BIGINT) FROM supplier)")
def interval_pairs(spark, d) -> DataFrame:
    a = T(spark, d, "customer").select(F.col("c_nationkey").alias("i"), (F.col("c_custkey") % 5).alias("j"))
    b = T(spark, d, "supplier").select(F.col("s_nationkey").alias("i"), (F.col("s_suppkey") % 7).alias("j"))
    return evaluation.interval_pairs(a, b).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("i", "j")).cast("long"))


@query("SELECT p_partkey AS pix, greatest(CASE WHEN p_size % 12 IN (3, 8, 9, 10) THEN 1 ELSE 0 END, CASE WHEN p_partkey % 11 IN (3, 8, 9, 10) THEN 1 ELSE 0 END) AS cloud FROM part")
def cloud_union(spark, d) -> DataFrame:
    """Cloudy in either of two epochs."""
    cloudy = lambda c: c.isin(3, 8, 9, 10).cast("int")
    return T(spark, d, "part").select(F.col("p_partkey").alias("pix"), F.greatest(cloudy(F.col("p_size") % 12), cloudy(F.col("p_partkey") % 11)).alias("cloud"))


@query(f"WITH {GR} SELECT r, c, {Q('score')} AS score, (SELECT count(*) FROM gr) AS n_px, true AS truncated FROM (SELECT * FROM gr ORDER BY r, c LIMIT 300)")
def pixel_sheet(spark, d) -> DataFrame:
    """The first pixels in row order, as a spreadsheet takes them, and that there are more."""
    x, n = evaluation.first_pixels(scenes.score_map(spark, d), 300)
    return x.select("r", "c", q(F.col("score")).alias("score")).join(F.broadcast(n), F.lit(True))  # one row


@query(f"WITH {PX}, lg AS (SELECT pix, b, s[b + 1] AS v FROM px, (SELECT unnest([0, 31, 63]) AS b)), li AS (SELECT b, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM lg GROUP BY 1) SELECT pix, CAST(b AS INTEGER) AS b, CAST(floor(least(1, greatest(0, (v - lo) / (hi - lo))) * 255) AS INTEGER) AS level FROM lg JOIN li USING (b)")
def preview_levels(spark, d) -> DataFrame:
    return evaluation.stretched(scenes.pixels(spark, d), evaluation.preview_bands(64))


_GRID = "sc AS (SELECT label = 0 AS gt, CAST(embedding AS DOUBLE[]) AS s FROM embeddings), wg AS (SELECT a, b FROM (SELECT unnest([0, 1, 2, 3]) AS a), (SELECT unnest([0, 1, 2, 3]) AS b) WHERE a + b > 0)"


@query(f"WITH {_GRID}, vl AS (SELECT a, b, floor((a * s[1] + b * s[2]) / (a + b) * 100000 + 0.3217) AS v, count(*) FILTER (WHERE gt) AS p, count(*) FILTER (WHERE NOT gt) AS q FROM sc, wg GROUP BY 1, 2, 3), au AS (SELECT a, b, sum(p * (below + q / 2.0::DOUBLE)) / CAST(sum(p) * sum(q) AS DOUBLE) AS auc FROM (SELECT *, sum(q) OVER (PARTITION BY a, b ORDER BY v) - q AS below FROM vl) GROUP BY 1, 2) SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, {Q('auc')} AS auc FROM au ORDER BY au.auc DESC, a, b LIMIT 10")
def weight_top10(spark, d) -> DataFrame:
    """The ten best of a small grid of weights."""
    grid = spark.createDataFrame([(a, b) for a in range(4) for b in range(4) if a + b], "a int, b int")
    x = scenes.pixels(spark, d).select("gt", "spectrum").crossJoin(F.broadcast(grid))  # 15 rows
    v = (F.col("a") * F.get("spectrum", F.lit(0)) + F.col("b") * F.get("spectrum", F.lit(1))) / (F.col("a") + F.col("b"))
    areas = metrics.roc_auc(x.withColumn("score", F.floor(v * 100000 + 0.3217)), by=["a", "b"])
    return areas.orderBy(F.desc("roc_auc"), "a", "b").limit(10).select("a", "b", q(F.col("roc_auc")).alias("auc"))


@query("SELECT l_suppkey % 12 AS scene, count(*) FILTER (WHERE gt) AS n_targets, count(*) FILTER (WHERE gt AND hit) AS n_hit, count(*) FILTER (WHERE hit) AS n_flagged FROM (SELECT l_suppkey, l_returnflag = 'R' AS gt, l_extendedprice >= 60000 AS hit FROM lineitem) GROUP BY 1")
def stage_one_recall(spark, d) -> DataFrame:
    """What the first stage flags and finds: recall and saving are ratios of these."""
    x = T(spark, d, "lineitem").select((F.col("l_suppkey") % 12).alias("scene"), (F.col("l_returnflag") == "R").alias("gt"), (F.col("l_extendedprice") >= 60000).alias("hit"))
    return x.groupBy("scene").agg(F.count_if("gt").alias("n_targets"), F.count_if(F.col("gt") & F.col("hit")).alias("n_hit"), F.count_if("hit").alias("n_flagged"))


_CHANGE = f"{GR}, sg AS (SELECT pix, score AS sam, CAST(pix % 97 AS DOUBLE) AS variance, CAST(pix * 31 % 101 AS DOUBLE) AS entropy, CASE WHEN pix % 23 <> 0 THEN CAST(pix * 7 % 89 AS DOUBLE) END AS coherence, pix % 10 = 0 AS cloudy FROM gr)"
_R = "(rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0 - 1) / (count(*) OVER () - 1)"


@query(f"WITH {_CHANGE}, a AS (SELECT pix, cloudy, {_R.format(v='sam')} AS x1, {_R.format(v='variance')} AS x2, {_R.format(v='entropy')} AS x3 FROM sg), b AS (SELECT pix, {_R.format(v='coherence')} AS x4 FROM sg WHERE coherence IS NOT NULL) SELECT pix, CASE WHEN x4 IS NULL THEN NULL WHEN cloudy THEN 0 ELSE {Q('x1 * 0.5 + x2 * 0.2 + x3 * 0.15 + x4 * 0.15')} END AS score FROM a LEFT JOIN b USING (pix)")
def fused_change(spark, d) -> DataFrame:
    """Change signals ranked each over its own pixels; clouds score 0, what is missing stays missing."""
    k = F.col("pix")
    x = scenes.score_map(spark, d).select("scene_id", "pix", F.col("score").alias("sam"), (k % 97).cast("double").alias("variance"), (k * 31 % 101).cast("double").alias("entropy"), F.when(k % 23 != 0, (k * 7 % 89).cast("double")).alias("coherence"), (k % 10 == 0).alias("cloudy"))
    y = scoring.fused_change(x, cloudy="cloudy")
    return y.select("pix", F.when(F.col("score") == 0, F.col("score")).otherwise(q(F.col("score"))).alias("score"))
