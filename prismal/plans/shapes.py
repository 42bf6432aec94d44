"""Queries on shapes of regions: the profile gate, outlines, features and contracts; and the run that yields them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismal import pipeline, schema, sinks
from prismal.operators import geo, regions, scoring
from prismal.plans.dialect import GR, Q, q
from prismal.plans.queries import _C8, _IOU, _labelled, _members, _rects
from prismal.plans.registry import query
from prismal.sources import scenes

GRID = {"a": 10.0, "b": 0.0, "c": 400000.0, "d": 0.0, "e": -10.0, "f": 4000000.0}
ZONE = 16

# --- the profile gate -------------------------------------------------------

_HULL = (
    "pt AS (SELECT DISTINCT label, 2 * c + dc AS x, 2 * r + dr AS y FROM lb, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) o(dr, dc)), "
    "hd AS (SELECT a.label, a.x AS ax, a.y AS ay, b.x AS ex, b.y AS ey FROM pt a JOIN pt b ON a.label = b.label AND (a.x <> b.x OR a.y <> b.y) JOIN pt k ON k.label = a.label GROUP BY ALL HAVING min((b.x - a.x) * (k.y - a.y) - (b.y - a.y) * (k.x - a.x)) >= 0), "
    "bx AS (SELECT label, unnest(range(r0, r1 + 1)) AS r, c0, c1 FROM (SELECT label, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM lb GROUP BY 1)), bp AS (SELECT label, r, unnest(range(c0, c1 + 1)) AS c FROM bx), "
    "hp AS (SELECT p.label, p.r, p.c FROM bp p JOIN hd ON hd.label = p.label GROUP BY ALL HAVING min((ex - ax) * (2 * r - ay) - (ey - ay) * (2 * c - ax)) >= 0), hl AS (SELECT label, count(*) AS hull FROM hp GROUP BY 1)"
)
_GATE = (
    f"{_C8}, {_HULL}, st AS (SELECT label, count(*)::DOUBLE AS area, var_pop(r) AS vr, var_pop(c) AS vc, covar_pop(r, c) AS vrc FROM lb GROUP BY 1), "
    "ax AS (SELECT label, area, area / hull AS solidity, 4 * sqrt((vr + vc) / 2 + sqrt(pow((vr - vc) / 2, 2) + vrc * vrc)) AS major, 4 * sqrt(greatest(0, (vr + vc) / 2 - sqrt(pow((vr - vc) / 2, 2) + vrc * vrc))) AS minor FROM st JOIN hl USING (label)), "
    "el AS (SELECT *, CASE WHEN minor > 0.001 THEN major / minor END AS elongation FROM ax), "
    "vd AS (SELECT *, CASE WHEN area < 2 THEN 'area_min' WHEN area > 9 THEN 'area_max' WHEN solidity < 0.7 THEN 'solidity' WHEN elongation IS NULL OR elongation > 3 THEN 'elongation' ELSE 'kept' END AS verdict FROM el)"
)
_TEST_PROFILE = {"min_area_px": 2, "max_area_px": 2000, "min_solidity": 0.7, "max_elongation": 3.0}


def _props(spark, d):
    """Axes of pixels in a line are 0 but for rounding."""
    x = regions.with_solidity(_labelled(spark, d)).withColumn("label", F.col("label").cast("long"))
    return x.withColumn("elongation", F.when(F.col("minor") > 0.001, F.col("major") / F.col("minor")))


@query(
    f"WITH RECURSIVE {_GATE} SELECT label, {Q('solidity')} AS solidity, verdict, CASE verdict WHEN 'area_min' THEN 2 - area WHEN 'area_max' THEN area - 9 WHEN 'solidity' THEN {Q('0.7 - solidity')} WHEN 'elongation' THEN CASE WHEN elongation IS NOT NULL THEN {Q('elongation - 3')} ELSE -1 END END AS margin, "
    f"CASE WHEN verdict <> 'kept' THEN 0 ELSE {Q('sqrt(greatest(least(1, solidity), 1e-6) * greatest(least(1, greatest(0, 1 - (elongation - 1) / 2)), 1e-6))')} END AS shape_plausibility FROM vd"
)
def profile_gate(spark, d) -> DataFrame:
    """The first criterion that a region fails, by how much, and the score of those that pass. Half of the 18-pixel scene bounds the area."""
    x = regions.gated(_props(spark, d), _TEST_PROFILE, 18)
    margin = F.when(F.col("verdict") == "elongation", F.when(F.col("elongation").isNull(), -1.0).otherwise(q(F.col("margin")))).when(F.col("verdict") == "solidity", q(F.col("margin"))).otherwise(F.col("margin"))
    return x.select("label", q(F.col("solidity")).alias("solidity"), "verdict", margin.alias("margin"), F.when(F.col("verdict") != "kept", 0.0).otherwise(q(F.col("shape_plausibility"))).alias("shape_plausibility"))


@query(f"WITH RECURSIVE {_GATE} SELECT verdict AS failing_criterion, count(*) AS n FROM vd WHERE verdict <> 'kept' GROUP BY 1")
def gate_audit(spark, d) -> DataFrame:
    """Records of the dropped regions, read back from their JSON."""
    props = regions.gated(_props(spark, d), _TEST_PROFILE, 18).withColumns({"roi_id": F.format_string("orders:anomaly:%04d", F.col("label") - 1), "source_branch": F.lit("anomaly"), "target_profile": F.lit("object")})
    _, dropped = regions.split(props)
    return regions.audit(dropped, _TEST_PROFILE).groupBy(F.get_json_object("record", "$.failing_criterion").alias("failing_criterion")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT name, max_area, scene_px, CASE WHEN max_area IS NULL THEN NULL ELSE least(max_area, 0.5::DOUBLE * scene_px) END AS resolved FROM (VALUES ('object', 2000.0::DOUBLE), ('landcover', NULL)) p(name, max_area), (SELECT CAST(unnest([1000, 4096, 90000]) AS BIGINT) AS scene_px)")
def resolved_profile(spark, d) -> DataFrame:
    sizes = spark.createDataFrame([(1000,), (4096,), (90000,)], "scene_px long")
    each = [sizes.select(F.lit(n).alias("name"), F.lit(regions.profile_of(n)["max_area_px"]).cast("double").alias("max_area"), "scene_px", regions.resolved_max(regions.profile_of(n), F.col("scene_px")).cast("double").alias("resolved")) for n in ("object", "landcover")]
    return each[0].unionByName(each[1])


@query(f"WITH RECURSIVE {_C8}, pz AS (SELECT label, r, c, (r * 7 + c * 13) % 3 AS piece FROM lb), sz AS (SELECT label, piece, count(*) AS n FROM pz GROUP BY 1, 2), bs AS (SELECT label, arg_max(piece, (n, -piece)) AS piece FROM sz GROUP BY 1) SELECT r, c FROM pz JOIN bs USING (label, piece)")
def largest_piece(spark, d) -> DataFrame:
    """Of each region the pixels of its largest piece."""
    x = _labelled(spark, d).withColumn("piece", (F.col("r") * 7 + F.col("c") * 13) % 3)
    return regions.largest_pieces(x).select("r", "c")


# --- outlines ---------------------------------------------------------------

#: By corner point: how many of its four pixels are of the region, and whether two touch there only.
_OUTLINE = (
    f"{_C8}, vx AS (SELECT label, r + i AS vr, c + j AS vc, count(*) AS n, count(DISTINCT r) = 2 AND count(DISTINCT c) = 2 AS slant FROM lb, range(2) a(i), range(2) b(j) GROUP BY 1, 2, 3), "
    "qd AS (SELECT label, count(*) FILTER (WHERE n = 1) AS q1, count(*) FILTER (WHERE n = 3) AS q3, count(*) FILTER (WHERE n = 2 AND slant) AS qd FROM vx GROUP BY 1), ou AS (SELECT label, 2 - (q1 - q3 - 2 * qd) // 4 AS n_rings, q1 + q3 + 2 * qd AS n_corners FROM qd)"
)


@query(f"WITH RECURSIVE {_OUTLINE}, sz AS (SELECT label, count(*)::DOUBLE AS area, {Q('(avg(c) + 0.5) / 100')} AS x, {Q('(avg(r) + 0.5) / 100')} AS y FROM lb GROUP BY 1) SELECT label, n_rings, n_corners, area, x, y FROM ou JOIN sz USING (label)")
def outlines(spark, d) -> DataFrame:
    """Rings (holes included) and corners of each region, and the area and centre of the polygon that they make."""
    x = geo.measured(regions.rings(geo.boundary_edges(_labelled(spark, d))))
    return x.select(F.col("label").cast("long").alias("label"), "n_rings", "n_corners", "area", q(F.col("x") / 100).alias("x"), q(F.col("y") / 100).alias("y"))


def _sql_utm(x: str, y: str, zone: int) -> tuple[str, str]:
    """SQL for longitude and latitude, by the same series with its terms written out."""
    n = geo.FLAT / (2 - geo.FLAT)
    radius = geo.K0 * geo.A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi, eta = f"(({y}) / {radius!r}::DOUBLE)", f"((({x}) - 500000) / {radius!r}::DOUBLE)"
    xi1 = xi + "".join(f" - {b!r}::DOUBLE * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, b in enumerate(beta, 1))
    eta1 = eta + "".join(f" - {b!r}::DOUBLE * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, b in enumerate(beta, 1))
    chi = f"asin(sin({xi1}) / cosh({eta1}))"
    lat = chi + "".join(f" + {v!r}::DOUBLE * sin({2 * j} * {chi})" for j, v in enumerate(delta, 1))
    return f"{zone * 6 - 183} + degrees(atan2(sinh({eta1}), cos({xi1})))", f"degrees({lat})"


_LON, _LAT = _sql_utm("400000 + 10.0::DOUBLE * (c + 0.5::DOUBLE)", "4000000 - 10.0::DOUBLE * (r + 0.5::DOUBLE)", ZONE)


@query(f"WITH {GR} SELECT pix, {Q(_LON)} AS lon, {Q(_LAT)} AS lat FROM gr")
def pixel_degrees(spark, d) -> DataFrame:
    x, y = geo.world(GRID, F.col("r"), F.col("c"))
    lon, lat = geo.utm_to_wgs84(x, y, ZONE)
    return scenes.score_map(spark, d).select("pix", q(lon).alias("lon"), q(lat).alias("lat"))


_E = math.sqrt(geo.E2)
_KA = math.cos(math.radians(30)) / math.sqrt(1 - geo.E2 * math.sin(math.radians(30)) ** 2)
_SIN = "sin(radians(lat))"
_EA = f"({geo.A!r}::DOUBLE * {1 - geo.E2!r}::DOUBLE / {2 * _KA!r}::DOUBLE * ({_SIN} / (1 - {geo.E2!r}::DOUBLE * {_SIN} * {_SIN}) - ln((1 - {_E!r}::DOUBLE * {_SIN}) / (1 + {_E!r}::DOUBLE * {_SIN})) / {2 * _E!r}::DOUBLE))"


@query(f"SELECT s_suppkey, {Q(f'{geo.A * _KA!r}::DOUBLE * radians(lon) / 1e6')} AS x, {Q(f'{_EA} / 1e6')} AS y FROM (SELECT s_suppkey, CAST(s_suppkey % 360 AS DOUBLE) - 180 AS lon, CAST(s_suppkey % 170 AS DOUBLE) - 85 AS lat FROM supplier)")
def equal_area_grid(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    x, y = geo.equal_area((k % 360).cast("double") - 180, (k % 170).cast("double") - 85)
    return scenes.table(spark, d, "supplier").select("s_suppkey", q(x / 1e6).alias("x"), q(y / 1e6).alias("y"))


# --- features and contracts -------------------------------------------------


def _featured(spark, d) -> DataFrame:
    scores = scenes.score_map(spark, d).withColumn("norm", F.col("score") / 5)
    labelled = _labelled(spark, d)
    means = labelled.join(scores.select("scene_id", "r", "c", "norm"), ["scene_id", "r", "c"]).groupBy("scene_id", "label").agg(F.avg("norm").alias("anomaly_score"))
    rois = regions.rois(labelled).join(means, ["scene_id", "label"]).withColumn("change_score", F.lit(None).cast("double")).withColumn("clear_fraction", F.when(F.col("n_px") > 1, 0.5))
    return pipeline.featured(rois, labelled, transform=GRID, zone=ZONE, timestamp=F.lit("2020-01-01T00:00:00Z"), georef="synthetic")


_FEATURED = f"{_OUTLINE}, ro AS (SELECT label, 'orders:anomaly:' || lpad(CAST(label - 1 AS VARCHAR), CAST(greatest(4, length(CAST(label - 1 AS VARCHAR))) AS INTEGER), '0') AS roi_id, count(*) AS n_px, avg(score / 5) AS s FROM lb GROUP BY 1)"


@query(
    f"WITH RECURSIVE {_FEATURED} SELECT roi_id, 'Polygon' AS geometry, n_rings, n_corners, 16 AS n_properties, {Q('s')} AS anomaly_score, CASE WHEN n_px > 1 THEN {Q('(0.4 * s + 0.1 * 0.5) / 0.5')} ELSE {Q('s')} END AS confidence, "
    "CASE WHEN n_px > 1 THEN '[\"c_anom\",\"c_clear\"]' ELSE '[\"c_anom\"]' END AS components, true AS change_is_null, abs(n_px * 100.0) > 0 AS has_area FROM ro JOIN ou USING (label)"
)
def geojson(spark, d) -> DataFrame:
    """The exported features, read back from their text."""
    # Each text is parsed once.
    kind = "type string, geometry struct<type string, coordinates array<array<array<double>>>>, properties map<string, string>"
    read = regions.features(_featured(spark, d)).select(F.from_json("feature", kind).alias("_f"))
    read = read.select(F.col("_f.geometry.type").alias("geometry"), F.col("_f.geometry.coordinates").alias("_rings"), F.col("_f.properties").alias("_p"))
    value, rings = lambda k: F.col("_p")[k], F.col("_rings")
    return read.select(
        value("roi_id").alias("roi_id"), "geometry", F.size(rings).cast("long").alias("n_rings"), (F.size(F.flatten(rings)) - F.size(rings)).cast("long").alias("n_corners"), F.size("_p").alias("n_properties"),
        q(value("anomaly_score").cast("double")).alias("anomaly_score"), q(value("confidence").cast("double")).alias("confidence"), value("confidence_components").alias("components"),
        value("change_score").isNull().alias("change_is_null"), (value("area").cast("double") > 0).alias("has_area"),
    )


@query(f"WITH RECURSIVE {_FEATURED} SELECT rule, count(*) AS n FROM (SELECT CASE label % 6 WHEN 0 THEN 'missing lat' WHEN 1 THEN 'unexpected note' WHEN 2 THEN 'type area' WHEN 3 THEN 'geometry' WHEN 4 THEN 'georef' END AS rule FROM ro) WHERE rule IS NOT NULL GROUP BY 1")
def feature_contract(spark, d) -> DataFrame:
    """Features spoilt in five ways, and what the contract says of them."""
    x = regions.features(_featured(spark, d)).withColumn("label", F.get(F.split("roi_id", ":"), F.lit(2)).cast("long") + 1)
    k, doc = F.col("label") % 6, F.col("feature")
    spoilt = F.when(k == 0, F.regexp_replace(doc, r'"lat":[^,]*,', "")).when(k == 1, F.regexp_replace(doc, r'"lat":', '"note":1,"lat":')).when(k == 2, F.regexp_replace(doc, r'"area":[^,]*,', '"area":"wide",')).when(k == 3, F.regexp_replace(doc, '"Polygon"', '"Point"')).when(k == 4, F.regexp_replace(doc, '"synthetic"', '"guessed"')).otherwise(doc)
    return schema.feature_violations(x.withColumn("feature", spoilt)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (VALUES ('a', 'range'), ('b', 'tag GEOREF'), ('b', 'tag NORM_P_LO')) t(scene_id, rule)")
def score_contract(spark, d) -> DataFrame:
    """A map with a value above 1, and one without two of its tags."""
    scores, tags = sinks.score_map(scenes.score_map(spark, d).withColumn("scene_id", F.when(F.col("pix") % 2 == 0, "a").otherwise("b")), method="global_rx")
    scores = scores.withColumn("norm", F.when((F.col("scene_id") == "a") & (F.col("norm") > 0.9), 2.0).otherwise(F.col("norm")))
    tags = tags.withColumn("tags", F.when(F.col("scene_id") == "b", F.map_filter("tags", lambda k, _: ~k.isin("GEOREF", "NORM_P_LO"))).otherwise(F.col("tags")))
    return schema.score_violations(scores, tags)


@query("SELECT * FROM (VALUES ('band_count', CAST((SELECT count(*) FROM embeddings WHERE vec_id % 50 = 7) AS BIGINT)), ('infinite', CAST((SELECT count(*) FROM embeddings WHERE vec_id % 50 = 9) AS BIGINT)), ('ascending', CAST(1 AS BIGINT)), ('source', CAST(1 AS BIGINT))) t(rule, n)")
def scene_contract(spark, d) -> DataFrame:
    """A scene with short spectra, infinite values, an axis that falls once, and an unknown source."""
    px = scenes.pixels(spark, d)
    k = F.col("pix") % 50
    spoilt = px.withColumn("spectrum", F.when(k == 7, F.slice("spectrum", 1, 60)).when(k == 9, F.transform("spectrum", lambda v, i: F.when(i == 3, float("inf")).otherwise(v))).otherwise(F.col("spectrum")))
    bands = scenes.bands(spark).withColumn("wl", F.when(F.col("b") == 10, 1.0).otherwise(F.col("wl")))
    meta = spark.createDataFrame([("scene0", "hydice_urban", "synthetic")], "scene_id string, source string, georef string")
    return schema.scene_violations(spoilt, bands).unionByName(schema.meta_violations(meta).groupBy("rule").agg(F.count(F.lit(1)).alias("n")))


@query(f"WITH {_IOU}, lk AS (SELECT a, b FROM io JOIN rt x ON x.roi_id = a JOIN rt y ON y.roi_id = b WHERE x.target_profile <> y.target_profile), bo AS (SELECT a, b FROM lk UNION ALL SELECT b, a FROM lk) SELECT rt.roi_id, coalesce(string_agg(bo.b, ',' ORDER BY bo.b), '') AS linked FROM rt LEFT JOIN bo ON bo.a = rt.roi_id GROUP BY 1")
def linked_rois(spark, d) -> DataFrame:
    rects = _rects(spark, d)
    return regions.links(rects, _members(rects)).select("roi_id", F.array_join("linked_roi_ids", ",").alias("linked"))


@query("SELECT s_suppkey, CASE WHEN w > 0 THEN " + Q("t / w") + " ELSE 0 END AS confidence FROM (SELECT s_suppkey, coalesce(a, 0) * 0.4 + coalesce(b, 0) * 0.2 + coalesce(c, 0) * 0.25 + coalesce(e, 0) * 0.1 + coalesce(f, 0) * 0.05 AS t, CASE WHEN a IS NULL THEN 0 ELSE 0.4 END + CASE WHEN b IS NULL THEN 0 ELSE 0.2 END + CASE WHEN c IS NULL THEN 0 ELSE 0.25 END + CASE WHEN e IS NULL THEN 0 ELSE 0.1 END + CASE WHEN f IS NULL THEN 0 ELSE 0.05 END AS w FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN (s_suppkey % 10) / 10.0::DOUBLE END AS a, CASE WHEN s_suppkey % 2 <> 0 THEN (s_suppkey % 7) / 7.0::DOUBLE END AS b, CASE WHEN s_suppkey % 5 <> 0 THEN (s_suppkey % 9) / 9.0::DOUBLE END AS c, CASE WHEN s_suppkey % 7 <> 0 THEN 0.5::DOUBLE END AS e, CASE WHEN s_suppkey % 11 <> 0 THEN 0.25::DOUBLE END AS f FROM supplier))")
def confidence_all(spark, d) -> DataFrame:
    """All five components of a region's confidence."""
    k = F.col("s_suppkey")
    parts = {"c_anom": F.when(k % 3 != 0, (k % 10) / 10.0), "c_change": F.when(k % 2 != 0, (k % 7) / 7.0), "c_seg": F.when(k % 5 != 0, (k % 9) / 9.0), "c_clear": F.when(k % 7 != 0, 0.5), "c_shape": F.when(k % 11 != 0, 0.25)}
    x = scenes.table(spark, d, "supplier").select("s_suppkey", *(v.alias(n) for n, v in parts.items()))
    value, names = scoring.confidence({n: w for n, w in scoring.CONFIDENCE.values()})
    return x.select("s_suppkey", F.when(F.size(names) > 0, q(value)).otherwise(0.0).alias("confidence"))


# --- whole runs -------------------------------------------------------------


@query()
def scene_run(spark, d) -> DataFrame:
    """Pixels to features by the default detector, as one call; held against its pieces in the tests."""
    out = pipeline.run(scenes.pixels(spark, d), detector="global_rx", pct=95.0, clean=False, transform=GRID, zone=ZONE, acquired="2020-05-01T10:00:00Z")
    return out["rois"].select("roi_id", "r0", "c0", "r1", "c1", "n_px", "anomaly_score", "confidence", "area", "perimeter", "lat", "lon", "timestamp")


@query()
def change_run(spark, d) -> DataFrame:
    """Two epochs to regions of change."""
    e = scenes.epochs(spark, d)
    _, _, _, rois = pipeline.change_run(e.where("epoch = 1995"), e.where("epoch = 1996"), pct=90.0, patch=5, clean=False)
    return rois.select("roi_id", "r0", "c0", "r1", "c1", "n_px", "change_score")


@query()
def benchmark_run(spark, d) -> DataFrame:
    """Detectors over a scene with its truth, one row each; one of them fails and says so."""
    px = scenes.pixels(spark, d)
    rows = pipeline.benchmark(px, px.select("scene_id", "pix", "gt"), ["global_rx", "crd", "local_rx"], {"local_rx": {"inner": 4}})
    return rows.select("detector", "status", "n_px", "n_anom", q(F.col("roc_auc")).alias("roc_auc"), q(F.col("f1")).alias("f1"))
