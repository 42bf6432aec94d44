"""Every operator as a query over the tables, with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismal import schema
from prismal.functions import spectral
from prismal.operators import change, detectors, geo, harmonize, metrics, moments, regions, scoring, windows2d
from prismal.plans.dialect import BANDS, EP, GR, PB, PX, Q, dot, inverse, q
from prismal.plans.registry import query
from prismal.session import stored
from prismal.sources import scenes
from prismal.streaming import moments as streams

def _table(spark, d, name):
    return scenes.table(spark, d, name)


# --- pixels -----------------------------------------------------------------


@query(f"WITH {PX} SELECT label, count(*) AS n, count(*) FILTER (WHERE pix % 17 <> 0) AS n_valid FROM px GROUP BY label")
def valid_pixels(spark, d) -> DataFrame:
    px = scenes.pixels(spark, d, nodata_every=17)
    return px.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(schema.is_valid(F.col("spectrum"))).alias("n_valid"))


@query(f"WITH {PB}, st AS (SELECT b, avg(v) AS m, stddev_pop(v) AS sd FROM pb GROUP BY b) SELECT pix, CAST(b AS INTEGER) AS b, {Q('(v - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END')} AS z FROM pb JOIN st USING (b)")
def standardize(spark, d) -> DataFrame:
    x = scenes.pixels(spark, d).select("pix", F.posexplode("spectrum").alias("b", "v"))
    stats = x.groupBy("b").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"))
    return x.join(F.broadcast(stats), "b").select("pix", "b", q((F.col("v") - F.col("m")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))).alias("z"))  # one row a band


@query(f"WITH {PX} SELECT pix, {Q('s[1] / CASE WHEN n = 0 THEN 1 ELSE n END')} AS first, {Q('s[64] / CASE WHEN n = 0 THEN 1 ELSE n END')} AS last FROM (SELECT pix, s, sqrt(list_sum([x * x FOR x IN s])) AS n FROM px)")
def l2_normalize(spark, d) -> DataFrame:
    x = scenes.pixels(spark, d).select("pix", spectral.l2_normalised(F.col("spectrum")).alias("s"))
    return x.select("pix", q(F.get("s", F.lit(0))).alias("first"), q(F.get("s", F.lit(63))).alias("last"))


@query(f"WITH {PB}, {inverse('0').split(',\ntr AS')[0]} SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {Q('v * 100')} AS v FROM sg WHERE i <= j")
def band_moments(spark, d) -> DataFrame:
    return moments.covariance(scenes.pixels(spark, d)).where("i <= j").select("i", "j", q(F.col("v") * 100).alias("v"))


_RX = f"WITH RECURSIVE {PB}, {inverse('1e-6 * tr.t / tr.n')}, rx AS (SELECT x.pix, sum(x.d * inv.v * y.d) AS score FROM ce x JOIN inv ON inv.i = x.b JOIN ce y ON y.pix = x.pix AND y.b = inv.j GROUP BY x.pix)"


@query(f"{_RX} SELECT pix, {Q('score / 100')} AS score FROM rx")
def global_rx(spark, d) -> DataFrame:
    return detectors.global_rx(scenes.pixels(spark, d)).select("pix", q(F.col("score") / 100).alias("score"))


@query(f"{_RX} SELECT pix, {Q('score / 100')} AS score FROM rx ORDER BY rx.score DESC, pix LIMIT 20")
def rx_top_k(spark, d) -> DataFrame:
    return detectors.global_rx(scenes.pixels(spark, d)).orderBy(F.desc("score"), "pix").limit(20).select("pix", q(F.col("score") / 100).alias("score"))


@query(
    f"WITH RECURSIVE {PB}, {inverse('1e-6')}, sig AS (SELECT pb.b, avg(pb.v) AS t FROM pb JOIN px USING (pix) WHERE px.gt GROUP BY pb.b), tt AS (SELECT sig.b, t - m AS t FROM sig JOIN mu USING (b)), "
    "wt AS (SELECT inv.i, sum(inv.v * tt.t) AS w FROM inv JOIN tt ON tt.b = inv.j GROUP BY inv.i), bb AS (SELECT sum(wt.w * tt.t) AS bb FROM wt JOIN tt ON tt.b = wt.i), "
    "aa AS (SELECT x.pix, sum(x.d * inv.v * y.d) AS a FROM ce x JOIN inv ON inv.i = x.b JOIN ce y ON y.pix = x.pix AND y.b = inv.j GROUP BY x.pix), ab AS (SELECT ce.pix, sum(ce.d * wt.w) AS ab FROM ce JOIN wt ON wt.i = ce.b GROUP BY ce.pix) "
    f"SELECT pix, {Q('CASE WHEN a * bb > 0 THEN least(1, greatest(0, ab * ab / (a * bb))) ELSE 0 END')} AS ace FROM aa JOIN ab USING (pix), bb"
)
def ace(spark, d) -> DataFrame:
    px = scenes.pixels(spark, d)
    signature = px.where("gt").select("scene_id", F.posexplode("spectrum").alias("b", "v")).groupBy("scene_id", "b").agg(F.avg("v").alias("v"))
    return detectors.ace(px, signature).select("pix", q(F.col("score")).alias("ace"))


@query(f"{_RX}, k AS (SELECT greatest(1, CAST(round_even(count(*) * 0.001, 0) AS BIGINT)) AS k FROM rx), best AS (SELECT pix FROM (SELECT pix, row_number() OVER (ORDER BY score DESC, pix DESC) AS i FROM rx), k WHERE i <= k) SELECT CAST(b AS INTEGER) AS b, {Q('avg(v)')} AS v FROM pb JOIN best USING (pix) GROUP BY b")
def target_signature(spark, d) -> DataFrame:
    px = scenes.pixels(spark, d)
    return scoring.target_signature(px, detectors.global_rx(px)).select(F.col("b").cast("int").alias("b"), q(F.col("v")).alias("v"))


@query(f"WITH {PX}, fit AS (SELECT avg(s[1]) AS m FROM px WHERE NOT gt), x AS (SELECT pix, s[1] AS v, gt FROM px) SELECT pix, gt, {Q('(v - m) * (v - m)')} AS score FROM x, fit")
def background_fit(spark, d) -> DataFrame:
    """Fitted on background rows only, scored on all."""
    px = scenes.pixels(spark, d).select("pix", "gt", F.get("spectrum", F.lit(0)).alias("v"))
    fit = px.where(~F.col("gt")).agg(F.avg("v").alias("m"))
    return px.join(F.broadcast(fit), F.lit(True)).select("pix", "gt", q((F.col("v") - F.col("m")) * (F.col("v") - F.col("m"))).alias("score"))  # one row


# --- scores -----------------------------------------------------------------


@query(f"WITH {GR}, p AS (SELECT quantile_cont(score, 0.01) AS lo, quantile_cont(score, 0.999) AS hi FROM gr) SELECT pix, {Q('least(1, greatest(0, (score - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END))')} AS norm FROM gr, p")
def percentile_norm(spark, d) -> DataFrame:
    return scoring.percentile_normalised(scenes.score_map(spark, d)).select("pix", q(F.col("norm")).alias("norm"))


_RANK = "(rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0 - 1) / (count(*) OVER () - 1)"


@query(f"WITH {GR} SELECT pix, {Q(_RANK.format(v='score'))} AS rank_norm FROM gr")
def rank_norm(spark, d) -> DataFrame:
    return scoring.rank_normalised(scenes.score_map(spark, d)).select("pix", q(F.col("rank_norm")).alias("rank_norm"))


@query(f"WITH {GR}, p AS (SELECT quantile_cont(score, 0.99) AS t FROM gr) SELECT r, c, CAST(score >= t AS INTEGER) AS m FROM gr, p")
def threshold_mask(spark, d) -> DataFrame:
    return scoring.thresholded(scenes.score_map(spark, d)).select("r", "c", "m")


def _components(spark, d):
    return _table(spark, d, "orders").select(F.lit("orders").alias("scene_id"), F.col("o_orderkey").alias("pix"), (F.col("o_totalprice") / 100000).alias("rx"), (F.col("o_custkey") % 977).cast("double").alias("ace"), F.when(F.col("o_orderkey") % 13 != 0, (F.col("o_orderkey") * 7919 % 1009).cast("double")).alias("spatial"))


_COMP = "co AS (SELECT o_orderkey AS pix, o_totalprice / 100000 AS rx, CAST(o_custkey % 977 AS DOUBLE) AS ace, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey * 7919 % 1009 AS DOUBLE) END AS spatial FROM orders)"
_JOINT = f"va AS (SELECT * FROM co WHERE spatial IS NOT NULL), ra AS (SELECT pix, {_RANK.format(v='rx')} AS a, {_RANK.format(v='ace')} AS b, {_RANK.format(v='spatial')} AS c FROM va)"


@query(f"WITH {_COMP}, {_JOINT} SELECT co.pix, {Q('b * (0.25 / 0.85) + a * (0.4 / 0.85) + c * (0.2 / 0.85)')} AS score FROM co LEFT JOIN ra USING (pix)")
def fuse_scores(spark, d) -> DataFrame:
    return scoring.fused(_components(spark, d), ["ace", "rx", "spatial"]).select("pix", q(F.col("score")).alias("score"))


@query(f"WITH {_COMP}, ra AS (SELECT pix, {_RANK.format(v='rx')} AS a, {_RANK.format(v='ace')} AS b FROM co) SELECT pix, {Q('b * (0.25 / 0.65) + a * (0.4 / 0.65)')} AS score FROM ra")
def fuse_missing_component(spark, d) -> DataFrame:
    return scoring.fused(_components(spark, d).drop("spatial"), ["ace", "rx"]).select("pix", q(F.col("score")).alias("score"))


@query("SELECT l_linestatus, " + Q("t / 100000") + " AS threshold, " + Q("fp") + " AS fp_rate FROM (SELECT l_linestatus, t, (SELECT count(*) FROM lineitem y WHERE y.l_linestatus = x.l_linestatus AND y.l_returnflag <> 'R' AND y.l_extendedprice >= t)::DOUBLE / nullif((SELECT count(*) FROM lineitem y WHERE y.l_linestatus = x.l_linestatus AND y.l_returnflag <> 'R'), 0) AS fp FROM (SELECT l_linestatus, min(l_extendedprice) AS t FROM (SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY l_extendedprice DESC) AS i, count(*) OVER (PARTITION BY l_linestatus) AS n FROM lineitem WHERE l_returnflag = 'R') WHERE i <= greatest(1, ceil(n * 980000 / 1e6)) GROUP BY 1) x)")
def recall_threshold(spark, d) -> DataFrame:
    x = _table(spark, d, "lineitem").withColumn("gt", F.col("l_returnflag") == "R")
    x = scoring.recall_threshold(x, by="l_linestatus", score="l_extendedprice")
    return x.select("l_linestatus", q(F.col("threshold") / 100000).alias("threshold"), q(F.col("fp_rate")).alias("fp_rate"))


@query(f"SELECT s_suppkey, CAST(CASE WHEN w > 0 THEN {Q('t / w')} ELSE 0 END AS DOUBLE) AS confidence, names FROM (SELECT s_suppkey, coalesce(a, 0) * 0.4 + coalesce(b, 0) * 0.2 + coalesce(c, 0) * 0.25 AS t, CASE WHEN a IS NULL THEN 0 ELSE 0.4 END + CASE WHEN b IS NULL THEN 0 ELSE 0.2 END + CASE WHEN c IS NULL THEN 0 ELSE 0.25 END AS w, concat_ws(',', CASE WHEN a IS NOT NULL THEN 'a' END, CASE WHEN b IS NOT NULL THEN 'b' END, CASE WHEN c IS NOT NULL THEN 'c' END) AS names FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN (s_suppkey % 10) / 10.0::DOUBLE END AS a, CASE WHEN s_suppkey % 2 <> 0 THEN (s_suppkey % 7) / 7.0::DOUBLE END AS b, CASE WHEN s_suppkey % 5 <> 0 THEN (s_suppkey % 9) / 9.0::DOUBLE END AS c FROM supplier))")
def confidence(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    x = _table(spark, d, "supplier").select("s_suppkey", F.when(k % 3 != 0, (k % 10) / 10.0).alias("a"), F.when(k % 2 != 0, (k % 7) / 7.0).alias("b"), F.when(k % 5 != 0, (k % 9) / 9.0).alias("c"))
    value, names = scoring.confidence({"a": 0.4, "b": 0.2, "c": 0.25})
    return x.select("s_suppkey", F.when(F.size(names) > 0, q(value)).otherwise(0.0).alias("confidence"), F.array_join(names, ",").alias("names"))


# --- spectra ----------------------------------------------------------------


@query(f"WITH {BANDS}, t(name, target) AS (VALUES ('blue', 480.0), ('green', 560.0), ('red', 660.0), ('nir', 860.0), ('swir1', 1650.0), ('swir2', 2200.0), ('none', 450.0)) SELECT name, min(b) FILTER (WHERE g = m) AS b, {Q('min(g)')} AS gap FROM (SELECT name, b, g, min(g) OVER (PARTITION BY name) AS m FROM (SELECT t.name, bands.b, abs(wl - target) AS g FROM t LEFT JOIN bands ON abs(wl - target) <= 15)) GROUP BY name")
def nearest_band(spark, d) -> DataFrame:
    targets = spark.createDataFrame([*spectral.TARGETS.items(), ("none", 450.0)], "name string, target double")
    return harmonize.nearest_bands(scenes.bands(spark), targets).select("name", "b", q(F.col("gap")).alias("gap"))


#: The bands nearest to the index targets on the test axis.
BAND_OF = {"blue": 2, "green": 5, "red": 8, "nir": 14, "swir1": 38, "swir2": 55}
_S = {k: f"(s[{v + 1}] + 0.5)" for k, v in BAND_OF.items()}


def _sql_ratio(a: str, b: str) -> str:
    return f"({a} - {b}) / nullif({a} + {b}, 0)"


_INDEX_SQL = {
    "ndbi": _sql_ratio(_S["swir1"], _S["nir"]),
    "iron_oxide_ratio": f"{_S['red']} / nullif({_S['blue']}, 0)",
    "clay_ratio": f"{_S['swir1']} / nullif({_S['swir2']}, 0)",
    "brightness": f"({_S['blue']} + {_S['green']} + {_S['red']} + {_S['nir']}) / 4",
    "ndvi": _sql_ratio(_S["nir"], _S["red"]),
    "ndwi": _sql_ratio(_S["green"], _S["nir"]),
    "nbr": _sql_ratio(_S["nir"], _S["swir2"]),
    "bsi": _sql_ratio(f"({_S['swir1']} + {_S['red']})", f"({_S['nir']} + {_S['blue']})"),
}


@query(f"WITH {PX} SELECT pix, {', '.join(f'{Q(v)} AS {k}' for k, v in _INDEX_SQL.items())} FROM px")
def spectral_indices(spark, d) -> DataFrame:
    px = scenes.reflectance(scenes.pixels(spark, d))
    return px.select("pix", *(q(spectral.index(n, F.col("spectrum"), BAND_OF)).alias(n) for n in spectral.INDICES))


@query(f"WITH {PX}, ix AS (SELECT pix, {_INDEX_SQL['ndvi']} AS a, {_INDEX_SQL['ndwi']} AS b, {_INDEX_SQL['bsi']} AS c FROM px) SELECT pix, {Q('(' + ' + '.join(_RANK.format(v=v) for v in 'abc') + ') / 3')} AS score FROM ix")
def spectral_index_score(spark, d) -> DataFrame:
    px = scenes.reflectance(scenes.pixels(spark, d))
    names = ["ndvi", "ndwi", "bsi"]
    x = px.select("scene_id", "pix", *(spectral.index(n, F.col("spectrum"), BAND_OF).alias(n) for n in names))
    for n in names:
        x = scoring.rank_normalised(x, score=n, out=f"{n}_rank")
    return x.select("pix", q((F.col("ndvi_rank") + F.col("ndwi_rank") + F.col("bsi_rank")) / 3).alias("score"))


@query(f"WITH {PX} SELECT pix, coalesce({_S['blue']} > 0.5 AND {_S['swir1']} < 0.6 AND {_INDEX_SQL['ndvi']} < 0.2, false) AS cloudy FROM px")
def cloud_mask_spectral(spark, d) -> DataFrame:
    """Limits moved to the range of the test spectra."""
    px = scenes.reflectance(scenes.pixels(spark, d))
    return px.select("pix", spectral.cloudy(F.col("spectrum"), BAND_OF, blue=0.5, swir1=0.6).alias("cloudy"))


@query("SELECT p_partkey AS pix, p_size % 12 AS scl, p_size % 12 IN (3, 8, 9, 10) AS cloudy FROM part")
def cloud_mask_scl(spark, d) -> DataFrame:
    x = _table(spark, d, "part").select(F.col("p_partkey").alias("pix"), (F.col("p_size") % 12).alias("scl"))
    return x.withColumn("cloudy", F.col("scl").isin(3, 8, 9, 10))


_TARGETS = "tg AS (SELECT CAST(i AS INTEGER) AS t, 390.0::DOUBLE + 100.5::DOUBLE * i AS wl FROM range(22) x(i))"


def _targets(spark):
    return spark.range(22).select(F.col("id").cast("int").alias("t"), (390.0 + 100.5 * F.col("id")).alias("wl"))


@query(f"WITH {BANDS}, {_TARGETS} SELECT count(*) AS n_bands, count(*) FILTER (WHERE NOT (wl BETWEEN 1350 AND 1450 OR wl BETWEEN 1800 AND 1950)) AS n_kept FROM bands")
def water_mask(spark, d) -> DataFrame:
    bands = scenes.bands(spark)
    return bands.agg(F.count(F.lit(1)).alias("n_bands")).join(harmonize.without_water(bands).agg(F.count(F.lit(1)).alias("n_kept")), F.lit(True))


_PLAN = f"{BANDS}, {_TARGETS}, pl AS (SELECT t, tg.wl, coalesce((SELECT max(b) FROM bands WHERE bands.wl <= tg.wl), 0) AS lo, coalesce((SELECT min(b) FROM bands WHERE bands.wl >= tg.wl), 63) AS hi FROM tg), pf AS (SELECT pl.*, CASE WHEN y.wl = x.wl THEN 0.0::DOUBLE ELSE (pl.wl - x.wl) / (y.wl - x.wl) END AS f FROM pl JOIN bands x ON x.b = lo JOIN bands y ON y.b = hi)"


@query(f"WITH {PX}, {_PLAN} SELECT pix, t, {Q('CASE WHEN f = 0 THEN s[lo + 1] WHEN f = 1 THEN s[hi + 1] ELSE s[lo + 1] * (1 - f) + s[hi + 1] * f END')} AS v FROM px, pf")
def harmonize_interp(spark, d) -> DataFrame:
    plan = harmonize.plan(scenes.bands(spark), _targets(spark))
    return harmonize.interpolated(scenes.pixels(spark, d), plan).select("pix", F.posexplode("spectrum").alias("t", "v")).select("pix", "t", q(F.col("v")).alias("v"))


@query(f"WITH {BANDS}, {_TARGETS}, st AS (SELECT quantile_cont(g, 0.5) AS step FROM (SELECT lead(wl) OVER (ORDER BY wl) - wl AS g FROM bands) WHERE g IS NOT NULL) SELECT {Q('step')} AS step, {Q('worst')} AS worst, worst <= step AS ok FROM (SELECT max(g) AS worst FROM (SELECT t, min(abs(bands.wl - tg.wl)) AS g FROM tg, bands GROUP BY t)), st")
def coverage_gate(spark, d) -> DataFrame:
    return harmonize.coverage(scenes.bands(spark), _targets(spark)).select(q(F.col("step")).alias("step"), q(F.col("worst")).alias("worst"), "ok")


@query(f"WITH {PX} SELECT pix, {Q('list_sum(s)')} AS total, len(s) AS n FROM (SELECT pix, [x FOR x, i IN s IF i % 9 <> 1] AS s FROM px)")
def drop_bad_bands(spark, d) -> DataFrame:
    x = scenes.pixels(spark, d).select("pix", F.filter("spectrum", lambda v, i: i % 9 != 0).alias("s"))
    return x.select("pix", q(F.aggregate("s", F.lit(0.0), lambda t, v: t + v)).alias("total"), F.size("s").cast("long").alias("n"))


@query(f"WITH {PB}, lh AS (SELECT b, min(v) AS lo, max(v) AS hi FROM pb WHERE b < 8 GROUP BY b) SELECT pix, CAST(b AS INTEGER) AS b, {Q('3.141592653589793 * least(1, greatest(0, (v - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END))')} AS angle FROM pb JOIN lh USING (b)")
def angle_encode(spark, d) -> DataFrame:
    x = scenes.pixels(spark, d).select("pix", F.posexplode(F.slice("spectrum", 1, 8)).alias("b", "v"))
    ends = x.groupBy("b").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return x.join(F.broadcast(ends), "b").select("pix", "b", q(spectral.angle_encoded(F.col("v"), F.col("lo"), F.col("hi"))).alias("angle"))  # eight rows


# --- change -----------------------------------------------------------------

_PAIR = f"{EP}, pr AS (SELECT x.pix, x.s AS a, y.s AS b FROM ep x JOIN ep y USING (pix) WHERE x.epoch = 1995 AND y.epoch = 1996)"


def _pairs(spark, d):
    e = scenes.epochs(spark, d)
    return change.paired(e.where("epoch = 1995"), e.where("epoch = 1996"))


@query(f"WITH {_PAIR} SELECT pix, {Q('acos(least(1, greatest(-1, ' + dot('a', 'b') + ' / nullif(sqrt(' + dot('a', 'a') + ') * sqrt(' + dot('b', 'b') + '), 0))))')} AS sam FROM pr")
def sam(spark, d) -> DataFrame:
    return change.angle(_pairs(spark, d)).select("pix", q(F.col("sam")).alias("sam"))


@query(f"WITH {_PAIR} SELECT pix, {Q('list_sum([abs(b[i] - x) FOR x, i IN a])')} AS score FROM pr")
def magnitude_l1(spark, d) -> DataFrame:
    return change.magnitude(_pairs(spark, d), 1).select("pix", q(F.col("score")).alias("score"))


@query(f"WITH {_PAIR} SELECT pix, {Q('sqrt(list_sum([(b[i] - x) * (b[i] - x) FOR x, i IN a]))')} AS score FROM pr")
def magnitude_l2(spark, d) -> DataFrame:
    return change.magnitude(_pairs(spark, d), 2).select("pix", q(F.col("score")).alias("score"))


_BASE = f"{EP}, rc AS (SELECT *, row_number() OVER (PARTITION BY pix ORDER BY epoch DESC) AS i FROM ep), lg AS (SELECT pix, unnest(s) AS v, generate_subscripts(s, 1) - 1 AS b FROM rc WHERE i <= 8), md AS (SELECT pix, b, quantile_cont(v, 0.5) AS median FROM lg GROUP BY 1, 2), bl AS (SELECT pix, b, any_value(median) AS median, quantile_cont(abs(v - median), 0.5) AS mad FROM lg JOIN md USING (pix, b) GROUP BY 1, 2)"


@query(f"WITH {_BASE} SELECT pix, CAST(b AS INTEGER) AS b, {Q('median')} AS median, {Q('mad')} AS mad FROM bl")
def temporal_median_mad(spark, d) -> DataFrame:
    return change.temporal_baseline(scenes.epochs(spark, d)).select("pix", "b", q(F.col("median")).alias("median"), q(F.col("mad")).alias("mad"))


@query(f"WITH {_BASE}, cu AS (SELECT pix, unnest(s) AS v, generate_subscripts(s, 1) - 1 AS b FROM ep WHERE epoch = 1997) SELECT pix, {Q('max(abs(v - median) / greatest(0.01, 1.4826 * mad)) / 10')} AS z FROM cu JOIN bl USING (pix, b) GROUP BY pix")
def temporal_zscore(spark, d) -> DataFrame:
    """With a floor of 0.01, since some pixels have a single epoch."""
    e = scenes.epochs(spark, d)
    return change.temporal_score(e.where("epoch = 1997"), change.temporal_baseline(e), floor=0.01).select("pix", q(F.col("score") / 10).alias("z"))


@query()
def patch_structure(spark, d) -> DataFrame:
    """Variance, entropy and coherence of the change around each part."""
    pairs = _pairs(spark, d)
    x = change.structure(pairs, patch=5).join(change.coherence(pairs, patch=5), ["scene_id", "r", "c"])
    return x.select("pix", q(F.col("variance")).alias("variance"), q(F.col("entropy")).alias("entropy"), q(F.col("coherence")).alias("coherence"))


# --- windows ----------------------------------------------------------------


@query(f"WITH {GR} SELECT x.r, x.c, {Q('sum(y.score) / 100')} AS integral FROM gr x JOIN (SELECT r, c, sum(score) OVER (PARTITION BY r ORDER BY c) AS score FROM gr) y ON y.c = x.c AND y.r <= x.r GROUP BY 1, 2")
def integral_image(spark, d) -> DataFrame:
    return windows2d.integral_image(scenes.score_map(spark, d), "score").select("r", "c", q(F.col("integral") / 100).alias("integral"))


@query(f"WITH {GR} SELECT x.r, x.c, {Q('sum(y.score)')} AS total, count(*) AS n FROM gr x, range(-3, 4) a(i), range(-3, 4) b(j), gr y WHERE y.r = x.r + i AND y.c = x.c + j GROUP BY 1, 2")
def box_sums(spark, d) -> DataFrame:
    x = windows2d.box_sums(scenes.score_map(spark, d), {"total": F.col("score"), "n": F.lit(1)}, 3)
    return x.select("r", "c", q(F.col("total")).alias("total"), F.col("n").cast("long").alias("n"))


_TWO = "g2 AS (SELECT r, c, o_totalprice / 100000 AS x, (o_custkey % 101) / 101.0::DOUBLE AS y FROM (SELECT *, o_orderkey // 100 AS r, o_orderkey % 100 AS c FROM orders))"


@query(
    f"WITH {_TWO}, ng AS (SELECT p.r, p.c, any_value(p.x) AS px, any_value(p.y) AS py, count(*) AS n, avg(o.x) AS mx, avg(o.y) AS my, var_pop(o.x) + 0.0001 AS sxx, var_pop(o.y) + 0.0001 AS syy, covar_pop(o.x, o.y) AS sxy FROM g2 p, range(-3, 4) a(i), range(-3, 4) b(j), g2 o WHERE o.r = p.r + i AND o.c = p.c + j AND NOT (abs(i) <= 1 AND abs(j) <= 1) GROUP BY 1, 2) "
    f"SELECT r, c, {Q('(syy * (px - mx) * (px - mx) - 2 * sxy * (px - mx) * (py - my) + sxx * (py - my) * (py - my)) / (sxx * syy - sxy * sxy) / 100')} AS local_rx FROM ng WHERE n >= 4"
)
def local_rx_2band(spark, d) -> DataFrame:
    x = _table(spark, d, "orders").select(F.lit("o").alias("scene_id"), F.expr("o_orderkey div 100").alias("r"), (F.col("o_orderkey") % 100).alias("c"), (F.col("o_totalprice") / 100000).alias("x"), ((F.col("o_custkey") % 101) / 101.0).alias("y"))
    return windows2d.ring_rx_2(x, "x", "y").where(F.col("local_rx").isNotNull()).select("r", "c", q(F.col("local_rx") / 100).alias("local_rx"))


_SHAPE = "sh AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM gr)"


@query(
    f"WITH {GR}, {_SHAPE}, wn AS (SELECT r, c, score, (r + i + 2 * h) % (2 * h) AS fr, (c + j + 2 * w) % (2 * w) AS fc, h, w FROM gr, sh, range(-3, 4) a(i), range(-3, 4) b(j)), fo AS (SELECT r, c, score, CASE WHEN fr < h THEN fr ELSE 2 * h - 1 - fr END AS yr, CASE WHEN fc < w THEN fc ELSE 2 * w - 1 - fc END AS yc FROM wn), nb AS (SELECT fo.r, fo.c, fo.score, y.score AS v FROM fo JOIN gr y ON y.r = fo.yr AND y.c = fo.yc) "
    f"SELECT r, c, {Q('greatest(0, any_value(score) - quantile_cont(v, 0.5))')} AS context FROM nb GROUP BY r, c"
)
def spatial_context(spark, d) -> DataFrame:
    return windows2d.spatial_context(scenes.score_map(spark, d)).select("r", "c", q(F.col("context")).alias("context"))


_MASK = f"{GR}, ms AS (SELECT r, c, CAST(score >= (SELECT quantile_cont(score, 0.7) FROM gr) AS INTEGER) AS m FROM gr)"


def _mask(spark, d, pct=70.0):
    return scoring.thresholded(scenes.score_map(spark, d), pct=pct).select("scene_id", "r", "c", "m")


def _sql_morph(src: str, radius: int, grow: bool) -> str:
    k = len(windows2d.offsets_diamond(radius))
    value = "max(y.m)" if grow else f"CASE WHEN count(*) = {k} THEN min(y.m) ELSE 0 END"
    return f"(SELECT x.r, x.c, {value} AS m FROM {src} x, range(-{radius}, {radius + 1}) a(i), range(-{radius}, {radius + 1}) b(j), {src} y WHERE abs(i) + abs(j) <= {radius} AND y.r = x.r + i AND y.c = x.c + j GROUP BY 1, 2)"


@query(f"WITH {_MASK}, e AS {_sql_morph('ms', 1, False)} SELECT r, c, m FROM e")
def erosion(spark, d) -> DataFrame:
    return windows2d.eroded(_mask(spark, d)).select("r", "c", "m")


@query(f"WITH {_MASK}, e AS {_sql_morph('ms', 1, False)}, o AS {_sql_morph('e', 1, True)} SELECT r, c, m FROM o")
def opening(spark, d) -> DataFrame:
    return windows2d.dilated(windows2d.eroded(_mask(spark, d))).select("r", "c", "m")


@query(f"WITH {_MASK}, e AS {_sql_morph('ms', 1, False)}, o AS {_sql_morph('e', 1, True)}, g AS {_sql_morph('o', 2, True)}, h AS {_sql_morph('g', 2, False)} SELECT r, c, m FROM h")
def morphological_cleanup(spark, d) -> DataFrame:
    return windows2d.cleaned_up(_mask(spark, d)).select("r", "c", "m")


# --- regions ----------------------------------------------------------------


def _sql_components(near: str) -> str:
    return f"{GR}, t AS (SELECT quantile_cont(score, 0.9) AS t FROM gr), px AS (SELECT r * 1048576 + c AS id, r, c, score FROM gr, t WHERE score >= t), ed AS (SELECT x.id AS a, y.id AS b FROM px x JOIN range(-1, 2) i(i) ON true JOIN range(-1, 2) j(j) ON {near} JOIN px y ON y.r = x.r + i AND y.c = x.c + j), cl(id, k) AS (SELECT id, id FROM px UNION SELECT ed.b, cl.k FROM cl JOIN ed ON ed.a = cl.id), fs AS (SELECT id, min(k) AS first FROM cl GROUP BY id), lb AS (SELECT r, c, score, dense_rank() OVER (ORDER BY first) AS label FROM px JOIN fs USING (id))"


_C8, _C4 = _sql_components("(i <> 0 OR j <> 0)"), _sql_components("abs(i) + abs(j) = 1")


@query(f"WITH RECURSIVE {_C4} SELECT r, c, label FROM lb")
def components_4(spark, d) -> DataFrame:
    return regions.connected_components(_mask(spark, d, 90.0), connectivity=4).select("r", "c", F.col("label").cast("long").alias("label"))


@query(f"WITH RECURSIVE {_C8} SELECT r, c, label FROM lb")
def components_8(spark, d) -> DataFrame:
    return regions.connected_components(_mask(spark, d, 90.0)).select("r", "c", F.col("label").cast("long").alias("label"))


_ROI = "ro AS (SELECT label, 'orders:anomaly:' || lpad(CAST(label - 1 AS VARCHAR), CAST(greatest(4, length(CAST(label - 1 AS VARCHAR))) AS INTEGER), '0') AS roi_id, min(r) AS r0, min(c) AS c0, max(r) + 1 AS r1, max(c) + 1 AS c1, count(*) AS n_px, avg(score) AS score FROM lb GROUP BY label)"


def _labelled(spark, d):
    return stored(regions.connected_components(_mask(spark, d, 90.0)), "labelled")


@query(f"WITH RECURSIVE {_C8}, {_ROI} SELECT roi_id, r0, c0, r1, c1, n_px, {Q('score')} AS score FROM ro")
def rois(spark, d) -> DataFrame:
    """The main query: score map to mask to components to regions with their mean score."""
    labelled = _labelled(spark, d)
    means = labelled.join(scenes.score_map(spark, d).select("scene_id", "r", "c", "score"), ["scene_id", "r", "c"]).groupBy("scene_id", "label").agg(F.avg("score").alias("score"))
    return regions.rois(labelled).join(means, ["scene_id", "label"]).select("roi_id", "r0", "c0", "r1", "c1", "n_px", q(F.col("score")).alias("score"))


@query(
    f"WITH RECURSIVE {_C8}, st AS (SELECT label, count(*) AS area, var_pop(r) AS vr, var_pop(c) AS vc, covar_pop(r, c) AS vrc FROM lb GROUP BY label), ax AS (SELECT *, 4 * sqrt((vr + vc) / 2 + sqrt(pow((vr - vc) / 2, 2) + vrc * vrc)) AS major, 4 * sqrt(greatest(0, (vr + vc) / 2 - sqrt(pow((vr - vc) / 2, 2) + vrc * vrc))) AS minor FROM st) "
    f"SELECT label, area, {Q('major')} AS major, CASE WHEN area < 3 THEN 'area_min' WHEN area > 12 THEN 'area_max' WHEN minor > 0.001 AND major / minor > 4 THEN 'elongation' ELSE 'kept' END AS verdict FROM ax"
)
def roi_filter(spark, d) -> DataFrame:
    props = regions.component_shapes(_mask(spark, d, 90.0)).withColumn("elongation", F.when(F.col("minor") > 0.001, F.col("major") / F.col("minor")).otherwise(0.0))  # lines pass here; profile_gate drops them
    return regions.judged(props, min_area=3, max_area=12, max_elongation=4.0).select(F.col("label").cast("long").alias("label"), "area", q(F.col("major")).alias("major"), "verdict")


@query(f"WITH RECURSIVE {_C4}, fl AS (SELECT label, max(CASE WHEN score >= (SELECT quantile_cont(score, 0.97) FROM gr) THEN 1 ELSE 0 END) AS hit, max(score) AS best FROM lb GROUP BY label) SELECT label, {Q('(SELECT quantile_cont(score, 0.97) FROM gr) - best')} AS margin FROM fl WHERE hit = 0")
def miss_audit(spark, d) -> DataFrame:
    """Truth components that no flagged pixel touches, and by how much they missed."""
    truth = regions.connected_components(_mask(spark, d, 90.0), connectivity=4)
    flagged = scoring.thresholded(scenes.score_map(spark, d), pct=97.0)
    x = truth.join(flagged, ["scene_id", "r", "c"]).groupBy("label").agg(F.max("m").alias("hit"), (F.max("threshold") - F.max("score")).alias("margin"))
    return x.where("hit = 0").select(F.col("label").cast("long").alias("label"), q(F.col("margin")).alias("margin"))


_RECT = "rt AS (SELECT 's' || (p_partkey // 500) AS scene_id, p_partkey AS id, 's' || (p_partkey // 500) || ':' || CASE WHEN p_size % 2 = 0 THEN 'anomaly' ELSE 'change' END || ':' || lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(4, length(CAST(p_partkey AS VARCHAR))) AS INTEGER), '0') AS roi_id, CASE WHEN p_partkey % 3 = 0 THEN 'object' ELSE 'landcover' END AS target_profile, (p_partkey * 7) % 47 AS r0, (p_partkey * 13) % 43 AS c0, p_size % 6 + 2 AS h, p_size % 5 + 2 AS w, p_retailprice / 1000 AS anomaly_score FROM part), mb AS (SELECT scene_id, roi_id, r0 + i AS r, c0 + j AS c FROM rt, range(8) a(i), range(8) b(j) WHERE i < h AND j < w)"


def _rects(spark, d):
    x = _table(spark, d, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    scene = F.concat(F.lit("s"), F.expr("p_partkey div 500").cast("string"))
    branch = F.when(size % 2 == 0, "anomaly").otherwise("change")
    return x.select(scene.alias("scene_id"), F.format_string("%s:%s:%04d", scene, branch, k).alias("roi_id"), branch.alias("source_branch"), F.when(k % 3 == 0, "object").otherwise("landcover").alias("target_profile"), (k * 7 % 47).alias("r0"), (k * 13 % 43).alias("c0"), (size % 6 + 2).alias("h"), (size % 5 + 2).alias("w"), (F.col("p_retailprice") / 1000).alias("anomaly_score"), F.lit(None).cast("double").alias("change_score"))


def _members(rects):
    x = rects.select("scene_id", "roi_id", "r0", "c0", "w", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("i"))
    x = x.select("scene_id", "roi_id", (F.col("r0") + F.col("i")).alias("r"), "c0", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("j"))
    return x.select("scene_id", "roi_id", "r", (F.col("c0") + F.col("j")).alias("c"))


_IOU = f"{_RECT}, sz AS (SELECT roi_id, count(*) AS n FROM mb GROUP BY 1), it AS (SELECT x.roi_id AS a, y.roi_id AS b, count(*) AS i FROM mb x JOIN mb y ON x.scene_id = y.scene_id AND x.r = y.r AND x.c = y.c AND x.roi_id < y.roi_id GROUP BY 1, 2), io AS (SELECT a, b, i::DOUBLE / (p.n + q.n - i) AS iou FROM it JOIN sz p ON p.roi_id = a JOIN sz q ON q.roi_id = b WHERE i::DOUBLE / (p.n + q.n - i) >= 0.3)"


@query(f"WITH {_IOU} SELECT a, b, {Q('iou')} AS iou FROM io")
def roi_iou(spark, d) -> DataFrame:
    return regions.overlaps(_members(_rects(spark, d))).select("a", "b", q(F.col("iou")).alias("iou"))


@query(f"WITH {_IOU} SELECT a, b FROM io JOIN rt x ON x.roi_id = a JOIN rt y ON y.roi_id = b WHERE x.target_profile <> y.target_profile")
def roi_links(spark, d) -> DataFrame:
    rects = _rects(spark, d)
    return regions.profiled(regions.overlaps(_members(rects)), rects).where("pa <> pb").select("a", "b")


@query(
    f"WITH RECURSIVE {_IOU}, sm AS (SELECT a, b FROM io JOIN rt x ON x.roi_id = a JOIN rt y ON y.roi_id = b WHERE x.target_profile = y.target_profile), e2 AS (SELECT a, b FROM sm UNION SELECT b, a FROM sm), cl(id, k) AS (SELECT roi_id, roi_id FROM rt UNION SELECT e2.b, cl.k FROM cl JOIN e2 ON e2.a = cl.id), gp AS (SELECT id AS roi_id, min(k) AS root FROM cl GROUP BY 1), "
    "ex AS (SELECT root, min(r) AS r0, min(c) AS c0, max(r) + 1 AS r1, max(c) + 1 AS c1, count(*) AS n_px FROM (SELECT DISTINCT root, r, c FROM mb JOIN gp USING (roi_id)) GROUP BY 1), hd AS (SELECT scene_id, root, target_profile, string_agg(roi_id, ',' ORDER BY roi_id) AS parents, max(anomaly_score) AS s FROM rt JOIN gp USING (roi_id) GROUP BY 1, 2, 3) "
    f"SELECT scene_id || ':fused:' || lpad(CAST(n AS VARCHAR), CAST(greatest(4, length(CAST(n AS VARCHAR))) AS INTEGER), '0') AS roi_id, parents, r0, c0, r1, c1, n_px, {Q('s')} AS anomaly_score FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY root) - 1 AS n FROM hd JOIN ex USING (root))"
)
def roi_fuse(spark, d) -> DataFrame:
    rects = _rects(spark, d)
    x = regions.fused(rects, _members(rects))
    return x.select("roi_id", F.array_join("parents", ",").alias("parents"), "r0", "c0", "r1", "c1", "n_px", q(F.col("anomaly_score")).alias("anomaly_score"))


@query(f"WITH {_RECT} SELECT count(*) AS n, count(*) FILTER (WHERE h <= 0 OR w <= 0) AS n_bad FROM rt")
def roi_contract(spark, d) -> DataFrame:
    rects = _rects(spark, d).withColumn("r1", F.col("r0") + F.col("h")).withColumn("c1", F.col("c0") + F.col("w"))
    return rects.agg(F.count(F.lit(1)).alias("n")).join(schema.roi_violations(rects).agg(F.count(F.lit(1)).alias("n_bad")), F.lit(True))


@query(f"WITH {_MASK} SELECT count(*) FILTER (WHERE m NOT IN (0, 1) OR m IS NULL) AS n FROM ms")
def mask_contract(spark, d) -> DataFrame:
    return schema.mask_violations(_mask(spark, d))


@query(f"WITH RECURSIVE {_C8} SELECT x.label, count(*) AS n_edges FROM lb x JOIN (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) o(i, j) ON true LEFT JOIN lb y ON y.r = x.r + o.i AND y.c = x.c + o.j AND y.label = x.label WHERE y.label IS NULL GROUP BY 1")
def boundary_length(spark, d) -> DataFrame:
    x = geo.boundary_edges(_labelled(spark, d)).groupBy("label").agg(F.count(F.lit(1)).alias("n_edges"))
    return x.select(F.col("label").cast("long").alias("label"), "n_edges")


@query(f"WITH {GR} SELECT pix, {Q('(10.0::DOUBLE * (c + 0.5::DOUBLE) + 400000) / 1000000')} AS x, {Q('(4000000 - 10.0::DOUBLE * (r + 0.5::DOUBLE)) / 10000000')} AS y FROM gr")
def pixel_centres(spark, d) -> DataFrame:
    x, y = geo.world({"a": 10.0, "b": 0.0, "c": 400000.0, "d": 0.0, "e": -10.0, "f": 4000000.0}, F.col("r"), F.col("c"))
    return scenes.score_map(spark, d).select("pix", q(x / 1000000).alias("x"), q(y / 10000000).alias("y"))


@query()
def pixel_places(spark, d) -> DataFrame:
    x, y = geo.world({"a": 10.0, "b": 0.0, "c": 400000.0, "d": 0.0, "e": -10.0, "f": 4000000.0}, F.col("r"), F.col("c"))
    lon, lat = geo.utm_to_wgs84(x, y, 16)
    return scenes.score_map(spark, d).select("pix", lon.alias("lon"), lat.alias("lat"))


# --- metrics ----------------------------------------------------------------

_SC = "sc AS (SELECT l_linestatus, l_extendedprice AS s, l_returnflag = 'R' AS gt FROM lineitem), vl AS (SELECT l_linestatus, s, count(*) FILTER (WHERE gt) AS p, count(*) FILTER (WHERE NOT gt) AS q FROM sc GROUP BY 1, 2)"


def _scored(spark, d):
    return _table(spark, d, "lineitem").select("l_linestatus", F.col("l_extendedprice").alias("score"), (F.col("l_returnflag") == "R").alias("gt"))


@query(f"WITH {_SC} SELECT l_linestatus, {Q('sum(p * (below + q / 2.0::DOUBLE)) / nullif(CAST(sum(p) * sum(q) AS DOUBLE), 0)')} AS roc_auc FROM (SELECT *, sum(q) OVER (PARTITION BY l_linestatus ORDER BY s) - q AS below FROM vl) GROUP BY 1")
def roc_auc(spark, d) -> DataFrame:
    return metrics.roc_auc(_scored(spark, d), by=["l_linestatus"]).select("l_linestatus", q(F.col("roc_auc")).alias("roc_auc"))


@query(f"WITH {_SC} SELECT l_linestatus, {Q('sum(p * tp / al) / nullif(CAST(sum(p) AS DOUBLE), 0)')} AS pr_auc FROM (SELECT l_linestatus, p::DOUBLE AS p, sum(p) OVER w AS tp, sum(p + q) OVER w AS al FROM vl WINDOW w AS (PARTITION BY l_linestatus ORDER BY s DESC)) GROUP BY 1")
def pr_auc(spark, d) -> DataFrame:
    return metrics.average_precision(_scored(spark, d), by=["l_linestatus"]).select("l_linestatus", q(F.col("pr_auc")).alias("pr_auc"))


@query(f"WITH {_SC} SELECT l_linestatus, tp, fp, fn, {Q('tp / nullif(tp + fp, 0)::DOUBLE')} AS precision, {Q('tp / nullif(tp + fn, 0)::DOUBLE')} AS recall FROM (SELECT l_linestatus, count(*) FILTER (WHERE s >= 50000 AND gt) AS tp, count(*) FILTER (WHERE s >= 50000 AND NOT gt) AS fp, count(*) FILTER (WHERE s < 50000 AND gt) AS fn FROM sc GROUP BY 1)")
def confusion(spark, d) -> DataFrame:
    x = metrics.confusion(_scored(spark, d), 50000.0, by=["l_linestatus"])
    return x.select("l_linestatus", "tp", "fp", "fn", q(F.col("precision")).alias("precision"), q(F.col("recall")).alias("recall"))


@query(f"SELECT o_orderstatus, o_orderpriority, {Q('avg(v) FILTER (WHERE ok)')} AS macro, {Q('sum(v * w) FILTER (WHERE ok) / nullif(sum(w) FILTER (WHERE ok), 0)')} AS micro, count(*) FILTER (WHERE ok) AS n_ok, count(*) FILTER (WHERE NOT ok) AS n_failed FROM (SELECT *, o_totalprice / 100000 AS v, CAST(o_custkey % 7 + 1 AS DOUBLE) AS w, o_orderkey % 11 <> 0 AS ok FROM orders) GROUP BY 1, 2")
def macro_micro_pool(spark, d) -> DataFrame:
    x = _table(spark, d, "orders").withColumns({"v": F.col("o_totalprice") / 100000, "w": (F.col("o_custkey") % 7 + 1).cast("double"), "status": F.when(F.col("o_orderkey") % 11 != 0, "ok").otherwise("failed")})
    x = metrics.pooled(x, by=["o_orderstatus", "o_orderpriority"], value="v", weight="w")
    return x.select("o_orderstatus", "o_orderpriority", q(F.col("macro")).alias("macro"), q(F.col("micro")).alias("micro"), "n_ok", "n_failed")


_WEIGHTS_SQL = f"WITH {PX}, w AS (SELECT a / 10.0::DOUBLE AS a, b / 10.0::DOUBLE AS b, c / 10.0::DOUBLE AS c FROM range(9) x(a), range(9) y(b), range(9) z(c) WHERE a + b + c > 0), sc AS (SELECT w.a, w.b, w.c, floor((w.a * s[1] + w.b * s[2] + w.c * s[3]) / (w.a + w.b + w.c) * 100000 + 0.3217) AS v, gt FROM px, w), vl AS (SELECT a, b, c, v, count(*) FILTER (WHERE gt) AS p, count(*) FILTER (WHERE NOT gt) AS q FROM sc GROUP BY 1, 2, 3, 4) SELECT a, b, c, {Q('sum(p * (below + q / 2.0::DOUBLE)) / CAST(sum(p) * sum(q) AS DOUBLE)')} AS auc FROM (SELECT *, sum(q) OVER (PARTITION BY a, b, c ORDER BY v) - q AS below FROM vl) GROUP BY 1, 2, 3"


@query(f"WITH {PX}, w AS (SELECT a / 2.0::DOUBLE AS a, b / 2.0::DOUBLE AS b, c / 2.0::DOUBLE AS c FROM range(3) x(a), range(3) y(b), range(3) z(c) WHERE a + b + c > 0), sc AS (SELECT w.a, w.b, w.c, floor((w.a * s[1] + w.b * s[2] + w.c * s[3]) / (w.a + w.b + w.c) * 100000 + 0.3217) AS v, gt FROM px, w), vl AS (SELECT a, b, c, v, count(*) FILTER (WHERE gt) AS p, count(*) FILTER (WHERE NOT gt) AS q FROM sc GROUP BY 1, 2, 3, 4) SELECT a, b, c, {Q('sum(p * (below + q / 2.0::DOUBLE)) / CAST(sum(p) * sum(q) AS DOUBLE)')} AS auc FROM (SELECT *, sum(q) OVER (PARTITION BY a, b, c ORDER BY v) - q AS below FROM vl) GROUP BY 1, 2, 3")
def weight_grid(spark, d) -> DataFrame:
    """AUC of every weighting of three components in steps of a half; the grid is an array of 26 constants."""
    return _weighted_auc(spark, d, [k / 2 for k in range(3)])


@query(_WEIGHTS_SQL)
def weight_search(spark, d) -> DataFrame:
    """AUC of each of the reference's 728 weightings of three components: nine levels each, 0 to 0.8."""
    return _weighted_auc(spark, d, [k / 10 for k in range(9)])


def _weighted_auc(spark, d, levels: list[float]) -> DataFrame:
    grid = [(a, b, c) for a in levels for b in levels for c in levels if a + b + c]
    weights = spark.createDataFrame(grid, "a double, b double, c double")
    x = scenes.pixels(spark, d).select("gt", "spectrum").crossJoin(F.broadcast(weights))  # at most 728 rows
    v = sum((F.col(n) * F.get("spectrum", F.lit(k)) for k, n in enumerate("abc")), F.lit(0.0)) / (F.col("a") + F.col("b") + F.col("c"))
    x = x.withColumn("score", F.floor(v * 100000 + 0.3217))
    return metrics.roc_auc(x, by=["a", "b", "c"]).select("a", "b", "c", q(F.col("roc_auc")).alias("auc"))


@query("SELECT c_nationkey, count(*) AS n, sum(CASE WHEN k <= (SELECT ceil(300.0 / count(DISTINCT c_nationkey)) FROM customer) THEN 1 ELSE 0 END)::BIGINT AS n_taken FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey) AS k FROM customer) GROUP BY 1")
def stratified_quota(spark, d) -> DataFrame:
    x = _table(spark, d, "customer")
    share = x.agg(F.ceil(F.lit(300.0) / F.countDistinct("c_nationkey")).alias("share"))
    k = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.md5(F.col("c_custkey").cast("string")), "c_custkey"))
    return x.withColumn("k", k).join(F.broadcast(share), F.lit(True)).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") <= F.col("share")).alias("n_taken"))  # one row


@query("SELECT CASE WHEN md5(CAST(vec_id % 7 AS VARCHAR)) < '4' THEN 'val' ELSE 'train' END AS split, count(DISTINCT vec_id % 7) AS n_scenes, count(*) AS n, CAST(0 AS BIGINT) AS n_leaked FROM embeddings GROUP BY 1")
def leak_check(spark, d) -> DataFrame:
    x = _table(spark, d, "embeddings").select((F.col("vec_id") % 7).alias("scene"))
    x = x.withColumn("split", F.when(F.md5(F.col("scene").cast("string")) < "4", "val").otherwise("train"))
    leaked = x.where("split = 'train'").join(x.where("split = 'val'").select("scene").distinct(), "scene", "left_semi").agg(F.count(F.lit(1)).alias("n_leaked"))
    return x.groupBy("split").agg(F.countDistinct("scene").alias("n_scenes"), F.count(F.lit(1)).alias("n")).join(F.broadcast(leaked), F.lit(True))  # one row


@query(f"WITH {GR}, {_SHAPE}, o(k, r0, c0) AS (SELECT 0, 0, 0 FROM sh UNION ALL SELECT 1, 0, w - 32 FROM sh UNION ALL SELECT 2, h - 32, 0 FROM sh UNION ALL SELECT 3, h - 32, w - 32 FROM sh) SELECT CAST(k AS INTEGER) AS crop, count(*) AS n, {Q('avg(score)')} AS mean FROM gr JOIN o ON r >= r0 AND r < r0 + 32 AND c >= c0 AND c < c0 + 32 GROUP BY 1")
def crops_four_corner(spark, d) -> DataFrame:
    x = scenes.score_map(spark, d)
    corner = F.explode(F.array(*(F.struct(F.lit(k).alias("crop"), r.alias("r0"), c.alias("c0")) for k, (r, c) in enumerate([(F.lit(0), F.lit(0)), (F.lit(0), F.col("_w") - 32), (F.col("_h") - 32, F.lit(0)), (F.col("_h") - 32, F.col("_w") - 32)]))))
    x = x.join(windows2d.shape(x), F.col("scene_id") == F.col("_scene")).select("r", "c", "score", corner.alias("o"))
    inside = F.col("r").between(F.col("o.r0"), F.col("o.r0") + 31) & F.col("c").between(F.col("o.c0"), F.col("o.c0") + 31)
    return x.where(inside).groupBy("o.crop").agg(F.count(F.lit(1)).alias("n"), q(F.avg("score")).alias("mean"))


@query(f"WITH {_RECT} SELECT DISTINCT scene_id, tr, tc FROM rt, range(20) a(tr), range(20) b(tc) WHERE tr BETWEEN r0 // 8 AND (r0 + h - 1) // 8 AND tc BETWEEN c0 // 8 AND (c0 + w - 1) // 8")
def tile_windows(spark, d) -> DataFrame:
    x = _rects(spark, d).select("scene_id", F.explode(F.sequence(F.expr("r0 div 8"), F.expr("(r0 + h - 1) div 8"))).alias("tr"), "c0", "w")
    return x.select("scene_id", "tr", F.explode(F.sequence(F.expr("c0 div 8"), F.expr("(c0 + w - 1) div 8"))).alias("tc")).distinct()


# --- catalogue --------------------------------------------------------------


@query("SELECT coalesce(x.o_orderkey, y.o_orderkey) AS id, coalesce(y.o_orderstatus, x.o_orderstatus) AS status, x.o_orderkey IS NULL AS added FROM (SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT') x FULL JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'F') y ON x.o_orderkey = y.o_orderkey")
def manifest_upsert(spark, d) -> DataFrame:
    """New rows win, old ones stay: two overlapping parts of the orders."""
    x = _table(spark, d, "orders")
    old = x.where("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("a"), F.col("o_orderstatus").alias("sa"))
    new = x.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("b"), F.col("o_orderstatus").alias("sb"))
    return old.join(new, F.col("a") == F.col("b"), "full").select(F.coalesce("a", "b").alias("id"), F.coalesce("sb", "sa").alias("status"), F.col("a").isNull().alias("added"))


@query("SELECT user_id, event_id, k FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) WHERE k <= 3")
def per_datatake_topk(spark, d) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    return _table(spark, d, "events").select("user_id", "event_id", k.cast("long").alias("k")).where("k <= 3")


@query("SELECT page_id, CASE WHEN starts_with(lower(trim(html)), '<!doctype') OR starts_with(lower(trim(html)), '<html') THEN 'html' ELSE 'other' END AS kind FROM pages")
def payload_sniff(spark, d) -> DataFrame:
    head = F.lower(F.trim("html"))
    return _table(spark, d, "pages").select("page_id", F.when(head.startswith("<!doctype") | head.startswith("<html"), "html").otherwise("other").alias("kind"))


@query(f"WITH x AS (SELECT o_orderdate AS dt, o_totalprice / 100000 AS v, CAST(o_custkey AS DOUBLE) AS u FROM orders), k AS (SELECT (rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0)::DOUBLE AS a, (rank() OVER (ORDER BY u) + (count(*) OVER (PARTITION BY u) - 1) / 2.0)::DOUBLE AS b FROM x) SELECT {Q('corr(a, b)')} AS rho FROM k")
def spearman(spark, d) -> DataFrame:
    x = _table(spark, d, "orders").select(F.lit("o").alias("scene_id"), (F.col("o_totalprice") / 100000).alias("v"), F.col("o_custkey").cast("double").alias("u"))
    x = scoring.rank_normalised(scoring.rank_normalised(x, score="v", out="a"), score="u", out="b")
    return x.agg(q(F.corr("a", "b")).alias("rho"))


@query(f"SELECT l_shipmode_year AS year, count(*) AS n, {Q('avg(v)')} AS mean, {Q('quantile_cont(v, 0.5)')} AS median, {Q('quantile_cont(v, 0.95)')} AS p95, {Q('min(v)')} AS lo, {Q('max(v)')} AS hi FROM (SELECT CAST(year(l_shipdate) AS INTEGER) AS l_shipmode_year, l_extendedprice / 100000 AS v FROM lineitem) GROUP BY 1")
def summary(spark, d) -> DataFrame:
    x = _table(spark, d, "lineitem").select(F.year("l_shipdate").cast("int").alias("year"), (F.col("l_extendedprice") / 100000).alias("v"))
    return x.groupBy("year").agg(F.count(F.lit(1)).alias("n"), q(F.avg("v")).alias("mean"), q(F.percentile("v", F.lit(0.5))).alias("median"), q(F.percentile("v", F.lit(0.95))).alias("p95"), q(F.min("v")).alias("lo"), q(F.max("v")).alias("hi"))


# --- streams ----------------------------------------------------------------


@query(f"SELECT event_type, CAST(epoch(time_bucket(INTERVAL '1 hour', ts)) AS BIGINT) AS start, count(*) AS n, {Q('sum(value) / 1000')} AS total FROM events GROUP BY 1, 2")
def stream_window(spark, d) -> DataFrame:
    x = streams.settled(streams.windowed(streams.events_stream(spark, d), "1 hour", "event_type"), "complete")
    return x.select("event_type", F.unix_timestamp("window.start").alias("start"), "n", q(F.col("total") / 1000).alias("total"))


@query("WITH x AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), y AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL '30 minutes' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM y GROUP BY user_id, k")
def stream_session(spark, d) -> DataFrame:
    x = streams.settled(streams.sessions(streams.events_stream(spark, d), "30 minutes", "user_id"), "complete")
    return x.select("user_id", F.unix_timestamp("session_window.start").alias("start"), "n")


@query(f"SELECT event_type, count(value) AS n, {Q('avg(value) / 100')} AS mean, {Q('var_samp(value) / 10000')} AS variance FROM events GROUP BY 1")
def stream_moments(spark, d) -> DataFrame:
    x = streams.events_stream(spark, d).select("event_type", "value")
    x = streams.settled(streams.running_moments(x, "event_type", ["value"]), "update", ("event_type",))
    return x.select("event_type", "n", q(F.get("mean", F.lit(0)) / 100).alias("mean"), q(F.get("m2", F.lit(0)) / (F.col("n") - 1) / 10000).alias("variance"))


# --- heavy detectors, held against brute force in the tests -------------------


@query()
def local_rx(spark, d) -> DataFrame:
    """The scene is 25 pixels wide: the reference's window and components for scenes of up to 64."""
    return detectors.local_rx(scenes.pixels(spark, d), inner=3, outer=15, components=12).select("pix", "score")


@query()
def crd(spark, d) -> DataFrame:
    return detectors.crd(scenes.pixels(spark, d)).select("pix", "score")


@query()
def kernel_rx(spark, d) -> DataFrame:
    return detectors.kernel_rx(scenes.pixels(spark, d)).select("pix", "score")


@query()
def fused_detector(spark, d) -> DataFrame:
    return detectors.fused(scenes.pixels(spark, d), local=detectors.ring_params(20, 25)).select("pix", "score")
