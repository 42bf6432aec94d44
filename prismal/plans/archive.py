"""Queries of the scene archive: names, catalogues, metadata, manifests, axes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismal.operators import archive, harmonize
from prismal.plans.dialect import GR, PX, Q, q
from prismal.plans.registry import query
from prismal.sources import scenes

T = scenes.table


@query("SELECT o_orderkey, 'ang' || strftime(o_orderdate, '%Y%m%d') || 't' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS line FROM orders")
def flightline(spark, d) -> DataFrame:
    scene = F.concat(F.lit("ang"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("t"), F.lpad(F.col("o_custkey").cast("string"), 6, "0"), F.lit("_"), (F.col("o_orderkey") % 100).cast("string"))
    return T(spark, d, "orders").select("o_orderkey", archive.flightline(scene).alias("line"))


_PATH = "CASE p_size % 4 WHEN 0 THEN 'data/ENMAP01-L2A_' || p_partkey || '.TIF' WHEN 1 THEN 's2/x_' || p_partkey || '_stack.tif' WHEN 2 THEN 'ang_' || p_partkey || '.hdr' ELSE 'abu/' || p_partkey || '.mat' END"


@query(f"SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'enmap' WHEN 1 THEN 'sentinel2' WHEN 2 THEN 'had100' END AS source, CASE p_size % 4 WHEN 0 THEN 'geotiff' WHEN 1 THEN 'geotiff' WHEN 2 THEN 'envi' ELSE 'matlab' END AS loader, {_PATH} AS path FROM part")
def guess_source(spark, d) -> DataFrame:
    x = T(spark, d, "part").select("p_partkey", F.expr(_PATH).alias("path"))
    return x.select("p_partkey", archive.guessed_source(F.col("path")).alias("source"), archive.loader_of(F.col("path")).alias("loader"), "path")


_FEATURES = "SELECT event_id AS seq, CASE WHEN event_id % 5 = 0 THEN 'TILE' || event_id ELSE 'ENMAP-DT' || user_id || '_' || event_id END AS id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR(40)) END AS cloud, CAST(event_id % 360 AS DOUBLE) - 180 AS lon, CAST(event_id % 180 AS DOUBLE) - 90 AS lat FROM events"


@query(
    f"WITH f AS ({_FEATURES}), g AS (SELECT *, TRY_CAST(coalesce(cloud, '101') AS DOUBLE) AS c, CASE WHEN regexp_matches(id, 'DT[0-9]+') THEN regexp_extract(id, 'DT[0-9]+') ELSE id END AS datatake FROM f), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY datatake ORDER BY seq) AS turn FROM g WHERE c <= 30 AND lon BETWEEN -90 AND 120 AND lat BETWEEN -45 AND 60) SELECT id, datatake FROM k WHERE turn <= 2 ORDER BY seq LIMIT 500"
)
def catalogue_search(spark, d) -> DataFrame:
    features = T(spark, d, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("TILE"), F.col("event_id"))).otherwise(F.concat(F.lit("ENMAP-DT"), F.col("user_id"), F.lit("_"), F.col("event_id"))).alias("id"), F.when(F.col("event_id") % 11 == 0, F.lit(None)).when(F.col("event_id") % 13 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("cloud"), ((F.col("event_id") % 360).cast("double") - 180).alias("lon"), ((F.col("event_id") % 180).cast("double") - 90).alias("lat"))
    return archive.searched(features, max_cloud=30.0, per_datatake=2, limit=500, box=(-90.0, -45.0, 120.0, 60.0)).select("id", "datatake")


@query("SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 3 <> 0 AND 57.5 BETWEEN 50 + s_suppkey % 40 AND 60 + s_suppkey % 40 AND 2.9 BETWEEN s_suppkey % 20 - 5 AND s_suppkey % 20 + 5 AND s_acctbal < 8000 ORDER BY s_nationkey, s_suppkey LIMIT 50")
def product_search(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    x = T(spark, d, "supplier").select(k.alias("id"), F.concat(F.lit("S2A_"), F.when(k % 3 == 0, "MSIL1C").otherwise("MSIL2A"), F.lit("_"), k).alias("name"), (50 + k % 40).alias("west"), (60 + k % 40).alias("east"), (k % 20 - 5).alias("south"), (k % 20 + 5).alias("north"), F.col("s_acctbal").alias("cloud"), F.concat(F.lit("2020-01-"), F.lpad((F.col("s_nationkey") + 1).cast("string"), 2, "0")).alias("date"))
    return archive.products(x, 57.5, 2.9, "2019-12-31", "2020-02-01", 8000.0).select("id")


_BANDS = ("B02", "B03", "B04", "B8A", "B11", "B12", "SCL")
_FILE = "'T43PGQ_' || strftime(o_orderdate, '%Y%m%d') || '_' || ['B02', 'B03', 'B04', 'B8A', 'B11', 'B12', 'SCL', 'AOT'][o_custkey % 8 + 1] || '_20m.jp2'"


@query(f"WITH f AS (SELECT o_orderkey % 2500 AS product, ['B02', 'B03', 'B04', 'B8A', 'B11', 'B12', 'SCL', 'AOT'][o_custkey % 8 + 1] AS band, {_FILE} AS file FROM orders), w AS (SELECT DISTINCT product, b AS band FROM f, (SELECT unnest(['B02', 'B03', 'B04', 'B8A', 'B11', 'B12', 'SCL']) AS b)) SELECT w.product, w.band, max(f.file) AS file FROM w LEFT JOIN f ON f.product = w.product AND f.band = w.band GROUP BY 1, 2")
def band_files(spark, d) -> DataFrame:
    return archive.band_files(_nodes(spark, d), list(_BANDS))


def _nodes(spark, d):
    names = F.array(*map(F.lit, (*_BANDS, "AOT")))
    file = F.concat(F.lit("T43PGQ_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), F.get(names, (F.col("o_custkey") % 8).cast("int")), F.lit("_20m.jp2"))
    return T(spark, d, "orders").select((F.col("o_orderkey") % 2500).alias("product"), file.alias("file"))


@query("WITH f AS (SELECT o_orderkey % 2500 AS product, ['B02', 'B03', 'B04', 'B8A', 'B11', 'B12', 'SCL', 'AOT'][o_custkey % 8 + 1] AS band FROM orders), w AS (SELECT DISTINCT product, b AS band FROM f, (SELECT unnest(['B02', 'B03', 'B04', 'B8A', 'B11', 'B12', 'SCL']) AS b)) SELECT product, string_agg(band, ',' ORDER BY band) AS missing FROM (SELECT * FROM w ANTI JOIN f USING (product, band)) GROUP BY 1")
def incomplete_products(spark, d) -> DataFrame:
    return archive.incomplete(archive.band_files(_nodes(spark, d), list(_BANDS))).select("product", F.array_join("missing", ",").alias("missing"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'B8A' ELSE 'B' || lpad(CAST(p_size AS VARCHAR), 2, '0') END AS code FROM part")
def band_codes(spark, d) -> DataFrame:
    raw = F.when(F.col("p_size") % 5 == 0, "B8A").otherwise(F.concat(F.lit("B"), F.col("p_size")))
    return T(spark, d, "part").select("p_partkey", archive.band_code(raw).alias("code"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'as given' WHEN 4 THEN '2020-01-01T00:00:00Z' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS t FROM orders")
def resolved_time(spark, d) -> DataFrame:
    k, day = F.col("o_orderkey") % 5, F.date_format("o_orderdate", "yyyy-MM-dd")
    acquired = F.when(k == 1, F.concat(day, F.lit("T00:00:00Z"))).when(k == 2, F.concat(day, F.lit("T05:30:00+05:30"))).when(k == 3, F.concat(day, F.lit(" 00:00:00")))
    now = F.to_timestamp(F.lit("2020-01-01T00:00:00Z"))
    return T(spark, d, "orders").select("o_orderkey", archive.resolved_time(F.when(k == 0, "as given"), acquired, now).alias("t"))


@query("SELECT p_partkey, p_type AS label, CASE WHEN p_size % 2 = 0 THEN 'pools/' || p_brand || '.npz' ELSE '/mnt/' || p_brand || '.npz' END AS path, sha256(p_name) AS digest FROM part")
def names_and_digests(spark, d) -> DataFrame:
    path = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("/srv/data/pools/"), "p_brand", F.lit(".npz"))).otherwise(F.concat(F.lit("/mnt/"), "p_brand", F.lit(".npz")))
    return T(spark, d, "part").select("p_partkey", archive.short_label(F.concat(F.lit("scene:anomaly:"), "p_type")).alias("label"), archive.relative_path(path, "/srv/data").alias("path"), archive.fingerprint(F.col("p_name")).alias("digest"))


_HEADS = ("49492A00AA", "49492B00AA", "504B0304AA", "894844460D0A1A0A", "4D41544C414220352E30", "FFD8FFE0", "00010203")
_KINDS = ("tiff", "tiff", "zip", "hdf5", "mat", "jpeg", "other")


@query(f"SELECT page_id, CASE WHEN page_id % 8 = 7 THEN 'html' ELSE {list(_KINDS)}[CAST(page_id % 8 AS INTEGER) + 1] END AS kind FROM pages")
def payload_kinds(spark, d) -> DataFrame:
    """Pages, and files of other kinds in their place."""
    k = F.col("page_id") % 8
    content = F.when(k == 7, F.encode("html", "UTF-8"))
    for i, head in enumerate(_HEADS):
        content = content.when(k == i, F.unhex(F.lit(head)))
    return T(spark, d, "pages").select("page_id", archive.payload_kind(content).alias("kind"))


@query("SELECT n_regionkey AS product, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS b, 400.0::DOUBLE + 3.5::DOUBLE * n_nationkey AS wl FROM nation")
def sidecar_axis(spark, d) -> DataFrame:
    """Band centres out of XML, whose bands stand in another order."""
    band = F.format_string('<bandID number="%d"><wavelengthCenterOfBand>%s</wavelengthCenterOfBand></bandID>', "n_nationkey", (400.0 + 3.5 * F.col("n_nationkey")).cast("string"))
    xml = T(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_name", band.alias("x"))), asc=False), lambda e: e["x"]), "").alias("x"))
    xml = xml.select("n_regionkey", F.concat(F.lit("<p><qa><bandID number='1'/></qa><bandCharacterisation>"), "x", F.lit("</bandCharacterisation></p>")).alias("x"))
    return xml.select(F.col("n_regionkey").alias("product"), F.posexplode(archive.band_axis(F.col("x"))).alias("b", "wl"))


@query(f"SELECT s_suppkey, CAST(i AS INTEGER) AS b, CASE WHEN s_suppkey % 2 = 0 THEN 490.0::DOUBLE + s_suppkey + 70 * i ELSE {Q('(0.49::DOUBLE + 0.07::DOUBLE * i) * 1000')} END AS wl FROM supplier, range(6) t(i)")
def tag_axis(spark, d) -> DataFrame:
    """Band centres out of a stack's tags, some of them in micrometres."""
    k, steps = F.col("s_suppkey"), F.array(*map(F.lit, range(6)))
    text = F.when(k % 2 == 0, F.array_join(F.transform(steps, lambda i: (490.0 + k + 70 * i).cast("string")), ",")).otherwise(F.array_join(F.transform(steps, lambda i: (0.49 + 0.07 * i).cast("string")), ", "))
    x = T(spark, d, "supplier").select(k, archive.nanometres(archive.tag_axis(F.create_map(F.lit("WAVELENGTHS_NM"), text), F.lit(6))).alias("a"))
    return x.select("s_suppkey", F.posexplode("a").alias("b", "wl")).withColumn("wl", F.when(k % 2 == 0, F.col("wl")).otherwise(q(F.col("wl"))))


@query("SELECT s_suppkey, 10000.0::DOUBLE AS quantification, s_suppkey % 4 <> 0 AS uniform, '05.' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS baseline, 442.7::DOUBLE + s_suppkey % 7 AS b02, 864.0::DOUBLE AS b8a FROM supplier")
def product_metadata(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    xml = F.concat(
        F.lit("<Level-2A><General_Info><PROCESSING_BASELINE>05."), F.lpad(F.col("s_nationkey").cast("string"), 2, "0"), F.lit("</PROCESSING_BASELINE><BOA_QUANTIFICATION_VALUE unit='none'>10000</BOA_QUANTIFICATION_VALUE><L><BOA_ADD_OFFSET band_id='0'>-1000</BOA_ADD_OFFSET><BOA_ADD_OFFSET band_id='1'>"),
        F.when(k % 4 == 0, "-900").otherwise("-1000"), F.lit("</BOA_ADD_OFFSET></L><S><Spectral_Information physicalBand='B2'><Wavelength><CENTRAL unit='nm'>"), (442.7 + k % 7).cast("string"), F.lit("</CENTRAL></Wavelength></Spectral_Information><Spectral_Information physicalBand='B8A'><Wavelength><CENTRAL unit='nm'>864.0</CENTRAL></Wavelength></Spectral_Information></S></General_Info></Level-2A>"),
    )
    x = T(spark, d, "supplier").select("s_suppkey", xml.alias("xml"))
    meta = archive.product_metadata(F.col("xml"))
    return x.select("s_suppkey", meta["quantification"].alias("quantification"), meta["uniform"].alias("uniform"), meta["baseline"].alias("baseline"), meta["centres"]["B02"].alias("b02"), meta["centres"]["B8A"].alias("b8a"))


@query(f"SELECT l_orderkey, l_linenumber, {Q('(l_quantity - 10 * (l_suppkey % 7)) / (100 + l_suppkey % 7)')} AS v FROM lineitem")
def boa_reflectance(spark, d) -> DataFrame:
    """Digital numbers rescaled by their product's offset and quantification; below zero stays."""
    facts = spark.range(7).select(F.col("id").alias("product"), F.array(-10.0 * F.col("id"), -10.0 * F.col("id")).alias("offsets"), (100.0 + F.col("id")).alias("quantification"))  # seven rows
    x = T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 7).alias("product"), "l_quantity")
    return archive.with_scale(x, facts).select("l_orderkey", "l_linenumber", q(archive.reflectance(F.col("l_quantity"), F.col("offset"), F.col("quantification"))).alias("v"))


@query(f"WITH {GR} SELECT r, c, CASE WHEN pix % 10 <> 0 THEN 3 ELSE 2 END AS grids, {Q('score + pix % 7 + CASE WHEN pix % 10 <> 0 THEN pix % 11 ELSE 0 END')} AS total FROM gr")
def aoi_stack(spark, d) -> DataFrame:
    """Three single-band grids as one cube; `grids` shows where one of them doesn't cover a pixel."""
    x = scenes.score_map(spark, d)
    bands = {"b02": x.withColumn("v", F.col("score")), "b03": x.withColumn("v", (F.col("pix") % 7).cast("double")), "scl": x.where("pix % 10 <> 0").withColumn("v", (F.col("pix") % 11).cast("double"))}
    cube = archive.stacked({k: v.select("scene_id", "r", "c", "v") for k, v in bands.items()})
    return cube.select("r", "c", F.col("grids").cast("int").alias("grids"), q(F.aggregate("spectrum", F.lit(0.0), lambda t, v: t + v)).alias("total"))


@query(
    "WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderpriority <> '1-URGENT'), n AS (SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderstatus <> 'F') "
    "SELECT coalesce(n.id, o.id) AS id, coalesce(n.status, o.status) AS status, CASE WHEN n.id IS NOT NULL THEN n.id % 17 ELSE o.id % 13 END AS image, CASE WHEN o.id IS NOT NULL THEN o.id % 7 END AS metadata, CASE WHEN n.id IS NOT NULL THEN n.id % 5 END AS mask FROM o FULL JOIN n ON o.id = n.id"
)
def manifest_merge(spark, d) -> DataFrame:
    """Rows by id, new ones first, their asset maps merged key by key."""
    merged = _manifest(spark, d)
    return merged.select("id", "status", *(F.try_element_at("assets", F.lit(a)).alias(a) for a in ("image", "metadata", "mask")))


def _manifest(spark, d):
    x = T(spark, d, "orders")
    k = F.col("o_orderkey")
    old = x.where("o_orderpriority <> '1-URGENT'").select(k.alias("id"), F.col("o_orderstatus").alias("status"), F.create_map(F.lit("image"), k % 13, F.lit("metadata"), k % 7).alias("assets"))
    new = x.where("o_orderstatus <> 'F'").select(k.alias("id"), F.col("o_orderstatus").alias("status"), F.create_map(F.lit("image"), k % 17, F.lit("mask"), k % 5).alias("assets"))
    return archive.upserted(old, new, id_col="id", maps=("assets",))


@query("WITH o AS (SELECT o_orderkey AS id FROM orders WHERE o_orderpriority <> '1-URGENT'), n AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F') SELECT count(*) AS n_products, CAST(sum(CASE WHEN n.id IS NOT NULL THEN n.id % 17 + n.id % 5 ELSE o.id % 13 END + CASE WHEN o.id IS NOT NULL THEN o.id % 7 ELSE 0 END) AS BIGINT) AS total_bytes FROM o FULL JOIN n ON o.id = n.id")
def manifest_totals(spark, d) -> DataFrame:
    return archive.manifest_totals(_manifest(spark, d), "assets")


@query("SELECT o_orderkey AS id, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END, o_orderkey) AS place FROM orders")
def manifest_order(spark, d) -> DataFrame:
    x = T(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 9 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"))
    return archive.in_date_order(x).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.coalesce("date", F.lit("")), "id")).cast("long")).select("id", "place")


@query("SELECT p_partkey, greatest(0, (h - least(64, h)) // 2) AS r0, greatest(0, (w - least(64, w)) // 2) AS c0, least(64, h) AS vh, least(64, w) AS vw, greatest(0, least(x, h - 1)) AS kr, greatest(0, least(y, w - 1)) AS kc, greatest(1, least(40, h - greatest(0, least(x, h - 1)))) AS kh, greatest(1, least(40, w - greatest(0, least(y, w - 1)))) AS kw, floor(h * w * 224 * 4 * 6.71 / 1e6 * 1000) AS kb FROM (SELECT p_partkey, p_partkey % 150 + 1 AS h, p_size * 3 AS w, p_partkey % 333 - 50 AS x, p_partkey % 77 - 20 AS y FROM part)")
def scene_windows(spark, d) -> DataFrame:
    """Centred and clamped windows of scenes of all sizes, and what a scene takes in memory."""
    x = T(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 150 + 1).alias("h"), (F.col("p_size") * 3).cast("long").alias("w"), (F.col("p_partkey") % 333 - 50).alias("x"), (F.col("p_partkey") % 77 - 20).alias("y"))
    h, w = F.col("h"), F.col("w")
    names = ("r0", "c0", "vh", "vw", "kr", "kc", "kh", "kw")
    values = (*archive.centred_window(h, w, 64, 64), *archive.clamped_window(F.col("x"), F.col("y"), F.lit(40), F.lit(40), h, w))
    return x.select("p_partkey", *(v.cast("long").alias(n) for n, v in zip(names, values)), F.floor(archive.size_mb(h, w, F.lit(224)) * 1000).cast("double").alias("kb"))


@query("SELECT * FROM (VALUES ('ang20170821t183707', 2, 2), ('ang20170821t195229', 1, 1), ('ang20170825t173426', 2, 2), ('ang20170908t225309', 8, 5), ('ang20171012t194435', 1, 1), ('ang20180227t082814', 4, 2), ('ang20191004t185054', 2, 2), ('ang20210614t141018', 4, 3)) t(line, n_crops, n_scenes)")
def crop_table(spark, d) -> DataFrame:
    x = archive.crops(spark).withColumn("line", archive.flightline(F.col("scene_id")))
    return x.groupBy("line").agg(F.count(F.lit(1)).cast("int").alias("n_crops"), F.countDistinct("scene_id").cast("int").alias("n_scenes"))


@query(f"WITH {GR} SELECT count(*) AS n, {Q('avg(score)')} AS mean, 400100.0::DOUBLE AS x0, 3999800.0::DOUBLE AS y0 FROM gr WHERE r BETWEEN 20 AND 51 AND c BETWEEN 10 AND 73")
def scene_window(spark, d) -> DataFrame:
    x = scenes.window(scenes.score_map(spark, d), 20, 10, 32, 64)
    moved = scenes.window_transform({"a": 10.0, "b": 0.0, "c": 400000.0, "d": 0.0, "e": -10.0, "f": 4000000.0}, 20, 10)
    return x.agg(F.count(F.lit(1)).alias("n"), q(F.avg("score")).alias("mean"), F.lit(moved["c"]).alias("x0"), F.lit(moved["f"]).alias("y0"))


@query(f"WITH {PX} SELECT pix, CAST(60 AS BIGINT) AS n, {Q('list_sum([x FOR x, i IN s IF (i - 1) % 17 <> 5])')} AS total FROM px")
def nodata_and_bad_bands(spark, d) -> DataFrame:
    """A sentinel becomes missing; bands without any value are flagged and go from spectra and axis."""
    px = scenes.pixels(spark, d).withColumn("spectrum", F.transform("spectrum", lambda v, i: F.when(i % 17 == 5, -9999.0).otherwise(v)))
    px = scenes.without_nodata(px, -9999.0)
    kept, bands = scenes.without_bad_bands(px, scenes.bands(spark), scenes.band_flags(px))
    n = bands.agg(F.count(F.lit(1)).alias("n"))
    return kept.select("pix", q(F.aggregate("spectrum", F.lit(0.0), lambda t, v: t + v)).alias("total")).join(F.broadcast(n), F.lit(True))  # one row


@query("SELECT p_partkey, CAST(p_size AS FLOAT) AS size, CAST(p_retailprice AS FLOAT) AS price FROM part")
def cast_values(spark, d) -> DataFrame:
    return scenes.as_floats(T(spark, d, "part").select("p_partkey", F.col("p_size").alias("size"), F.col("p_retailprice").alias("price")), "size", "price")


@query(f"WITH {PX} SELECT pix, CAST(u - 1 AS INTEGER) AS b, 400.0::DOUBLE + 66.0::DOUBLE * (u - 1) AS wl, {Q('(s[65 - 2 * u] + s[66 - 2 * u]) / 2')} AS v FROM px, range(1, 33) t(u)")
def sorted_axis(spark, d) -> DataFrame:
    """A falling axis with every wavelength twice: sorted, and twins averaged."""
    bands = spark.range(64).select(F.col("id").cast("int").alias("b"), (400.0 + 66.0 * (31 - F.expr("id div 2"))).alias("wl"))
    px, axis = harmonize.sorted_axis(scenes.pixels(spark, d), bands)
    return px.select("pix", F.posexplode("spectrum").alias("b", "v")).join(F.broadcast(axis), "b").select("pix", "b", "wl", q(F.col("v")).alias("v"))  # 32 rows


_DRY = "tg AS (SELECT CAST(i AS INTEGER) AS t, 410.0::DOUBLE + 55.0::DOUBLE * i AS wl FROM range(36) x(i)), dr AS (SELECT * FROM tg WHERE NOT (wl BETWEEN 1350 AND 1450 OR wl BETWEEN 1800 AND 1950)), pl AS (SELECT t, wl, CAST(floor((wl - 400) / 33) AS INTEGER) AS lo, CAST(ceil((wl - 400) / 33) AS INTEGER) AS hi FROM dr), pf AS (SELECT t, lo, hi, CASE WHEN lo = hi THEN 0 ELSE (wl - (400 + 33.0::DOUBLE * lo)) / 33 END AS f FROM pl)"


@query(f"WITH {PX}, {_DRY} SELECT pix, CAST(row_number() OVER (PARTITION BY pix ORDER BY t) - 1 AS INTEGER) AS k, {Q('CASE WHEN f = 0 THEN s[lo + 1] ELSE s[lo + 1] * (1 - f) + s[hi + 1] * f END')} AS v FROM px, pf")
def harmonized(spark, d) -> DataFrame:
    """The whole chain: axis sorted, water bands out, coverage checked, spectra interpolated."""
    targets = spark.range(36).select(F.col("id").cast("int").alias("t"), (410.0 + 55.0 * F.col("id")).alias("wl"))
    return harmonize.harmonized(scenes.pixels(spark, d), scenes.bands(spark), targets).select("pix", F.posexplode("spectrum").alias("k", "v")).select("pix", "k", q(F.col("v")).alias("v"))


@query("SELECT * FROM (VALUES ('blue', 2), ('green', 5), ('nir', 14), ('swir2', 55)) t(name, b)")
def selected_bands(spark, d) -> DataFrame:
    targets = spark.createDataFrame([("blue", 480.0), ("green", 560.0), ("nir", 860.0), ("swir2", 2200.0)], "name string, target double")
    return harmonize.selected_bands(scenes.bands(spark), targets, tolerance=17.0).select("name", "b")
