"""Scene archives: names, catalogues, product metadata, manifests. All of it is string, map and row work on tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- names ------------------------------------------------------------------

#: Fixed value: names of airborne scenes, a flight line and a patch number.
FLIGHTLINE = r"^(ang\d{8}t\d{6})_\d+$"


def flightline(scene_id: Column) -> Column:
    """The flight line of a patch; a name of another form raises, for a wrong line leaks scenes across a split."""
    found = F.regexp_extract(scene_id, FLIGHTLINE, 1)
    return F.when(found != "", found).otherwise(F.raise_error(F.concat(F.lit("not a patch of a flight line: "), scene_id)))


def guessed_source(path: Column) -> Column:
    """The kind of scene that a file's name tells; NULL if none."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.when(name.startswith("enmap01"), "enmap").when(name.endswith("_stack.tif"), "sentinel2").when(name.endswith(".hdr"), "had100")


def loader_of(path: Column) -> Column:
    """The reader that a file's extension asks for; an unknown one raises."""
    name = F.lower(path)
    return F.when(name.endswith(".mat"), "matlab").when(name.rlike(r"\.tiff?$"), "geotiff").when(name.endswith(".hdr"), "envi").otherwise(F.raise_error(F.concat(F.lit("no reader for "), path)))


def datatake(scene_id: Column) -> Column:
    """The overpass that a tile belongs to, else the tile itself."""
    found = F.regexp_extract(scene_id, r"DT\d+", 0)
    return F.when(found != "", found).otherwise(scene_id)


def number(value: Column, default: float | None = None) -> Column:
    """A catalogue's number, given as a number or as text; `default` where it is absent, NULL where it is no number."""
    return F.when(value.isNull(), F.lit(default).cast("double")).otherwise(value.try_cast("double"))


def band_code(code: Column) -> Column:
    """B2 as B02; codes with a letter stay."""
    digits = F.substring(code, 2, 10)
    return F.when(digits.rlike(r"^\d+$"), F.concat(F.lit("B"), F.lpad(digits.cast("int").cast("string"), 2, "0"))).otherwise(code)


def short_label(label: Column) -> Column:
    return F.regexp_replace(label, "^.*:", "")


def relative_path(path: Column, root: str) -> Column:
    """The path under root, or the whole path outside of it."""
    top = root.rstrip("/") + "/"
    return F.when(path.startswith(top), F.substring(path, len(top) + 1, 1 << 20)).otherwise(path)


def fingerprint(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def resolved_time(explicit: Column, acquired: Column, now: Column) -> Column:
    """What a feature says of its time: an explicit text as it is, else the scene's own time in UTC, else now. A time without a zone is UTC; a malformed one raises."""
    raw = F.trim(acquired)
    zoned = F.when(raw.rlike(r"(Z|[+-]\d\d:?\d\d)$"), raw).otherwise(F.concat(raw, F.lit("Z")))

    def in_utc(t: Column) -> Column:
        return F.date_format(F.to_utc_timestamp(t, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")

    parsed = F.try_to_timestamp(zoned)
    own = F.when(parsed.isNotNull(), in_utc(parsed)).otherwise(F.raise_error(F.concat(F.lit("not an ISO time: "), raw)))
    return F.when(explicit.isNotNull(), explicit).when(acquired.isNotNull(), own).otherwise(in_utc(now))


# --- payloads ---------------------------------------------------------------

#: The first bytes of payloads, in hex.
MAGIC = {
    "tiff": ("49492A00", "4D4D002A", "49492B00", "4D4D002B"),
    "zip": ("504B0304",),
    "hdf5": ("894844460D0A1A0A",),
    "mat": ("4D41544C4142",),
    "jpeg": ("FFD8FF",),
}
#: How markup begins.
MARKUP = ("<!doctype", "<html", '<?xml version="1.0" encoding="utf-8"?>\n<!doctype')


def payload_kind(content: Column) -> Column:
    """html, a kind of MAGIC, or other, by the first bytes of a payload."""
    head = F.lower(F.ltrim(F.substring(content.cast("string"), 1, 512), F.lit(" \t\r\n\x0b\x0c")))
    first = F.hex(F.substring(content.cast("binary"), 1, 8))
    is_markup = reduce(lambda a, b: a | b, (head.startswith(m) for m in MARKUP))
    kind = F.when(is_markup, "html")
    for name, heads in MAGIC.items():
        kind = kind.when(reduce(lambda a, b: a | b, (first.startswith(h) for h in heads)), name)
    return kind.otherwise("other")


# --- catalogues -------------------------------------------------------------


def searched(features: DataFrame, *, max_cloud: float, per_datatake: int, limit: int, box: tuple[float, float, float, float] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """features(seq, id, date, cloud, lon, lat, ...) in the catalogue's order: not too cloudy, few a datatake, `limit` in all.

    An absent cloud cover counts as 101 per cent.
    """
    x = features.withColumn("cloud", number(F.col("cloud"), 101.0)).where(F.col("cloud") <= max_cloud)
    if box:
        x = x.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))
    if start:
        x = x.where(F.col("date") >= start)
    if end:
        x = x.where(F.col("date") <= end)
    turn = F.row_number().over(Window.partitionBy("datatake").orderBy("seq"))
    x = x.withColumn("datatake", datatake(F.col("id"))).withColumn("_turn", turn).where(F.col("_turn") <= per_datatake)
    return x.orderBy("seq").limit(limit).drop("_turn")


def products(catalogue: DataFrame, lon: float, lat: float, start: str, end: str, max_cloud: float, *, level: str = "MSIL2A", limit: int = 50) -> DataFrame:
    """Products of a level whose box holds a point, within days, under a cloud cover, by date."""
    x = catalogue.where(F.col("name").contains(level) & F.lit(lon).between(F.col("west"), F.col("east")) & F.lit(lat).between(F.col("south"), F.col("north")))
    return x.where((F.col("cloud") < max_cloud) & (F.col("date") > start) & (F.col("date") < end)).orderBy("date", "id").limit(limit)


def band_files(nodes: DataFrame, bands: list[str], *, resolution: str = "20m") -> DataFrame:
    """product, band, file: the file of each wanted band; `file` is NULL where the product lacks it."""
    wanted = nodes.select("product").distinct().withColumn("band", F.explode(F.array(*map(F.lit, bands))))
    files = nodes.withColumn("band", F.regexp_extract("file", rf"_([^_]+)_{resolution}\.jp2$", 1)).groupBy("product", "band").agg(F.max("file").alias("file"))
    return wanted.join(files, ["product", "band"], "left")


def incomplete(files: DataFrame) -> DataFrame:
    """product, missing: products that lack band files."""
    return files.where(F.col("file").isNull()).groupBy("product").agg(F.array_sort(F.collect_list("band")).alias("missing"))


# --- metadata ---------------------------------------------------------------


def band_axis(xml: Column) -> Column:
    """Band centres of a hyperspectral product's XML, by band number; an axis that doesn't ascend raises."""
    numbers = F.xpath(xml, F.lit("//bandCharacterisation//bandID/@number"))
    centres = F.xpath(xml, F.lit("//bandCharacterisation//bandID/wavelengthCenterOfBand/text()"))
    pairs = F.array_sort(F.transform(F.arrays_zip(numbers.alias("k"), centres.alias("wl")), lambda p: F.struct(p["k"].cast("int").alias("k"), p["wl"].cast("double").alias("wl"))))
    return ascending(F.transform(pairs, lambda p: p["wl"]))


def ascending(axis: Column) -> Column:
    """The axis if it has values, none missing, each greater than the one before; anything else raises."""
    falls = F.exists(F.zip_with(F.slice(axis, 1, F.size(axis) - 1), F.slice(axis, 2, F.size(axis) - 1), lambda a, b: F.coalesce(b > a, F.lit(False))), lambda ok: ~ok)
    return F.when((F.size(axis) > 0) & ~F.exists(axis, lambda w: w.isNull()) & ((F.size(axis) == 1) | ~falls), axis).otherwise(F.raise_error(F.lit("the axis isn't strictly ascending")))


def tag_axis(tags: Column, n_bands: Column) -> Column:
    """Band centres of a stack's tag WAVELENGTHS_NM; the number of bands must agree."""
    axis = F.transform(F.split(tags["WAVELENGTHS_NM"], ","), lambda w: F.trim(w).cast("double"))
    return F.when(F.size(axis) == n_bands, ascending(axis)).otherwise(F.raise_error(F.lit("the tag has another number of bands")))


def nanometres(axis: Column) -> Column:
    """An axis in nm; one below 100 is in micrometres."""
    return F.when(F.array_max(axis) < 100, F.transform(axis, lambda w: w * 1000)).otherwise(axis)


def product_metadata(xml: Column) -> dict[str, Column]:
    """Scale, offsets, bands and times of a product's XML."""
    offsets = F.transform(F.xpath(xml, F.lit("//BOA_ADD_OFFSET/text()")), lambda v: v.cast("double"))
    codes = F.xpath(xml, F.lit("//Spectral_Information/@physicalBand"))
    centres = F.xpath(xml, F.lit("//Spectral_Information/Wavelength/CENTRAL/text()"))
    return {
        "quantification": F.xpath_double(xml, F.lit("//BOA_QUANTIFICATION_VALUE")),
        "offsets": offsets,
        "uniform": F.size(F.array_distinct(offsets)) == 1,
        "baseline": F.xpath_string(xml, F.lit("//PROCESSING_BASELINE")),
        "sensed": F.xpath_string(xml, F.lit("//DATATAKE_SENSING_START")),
        "centres": F.map_from_arrays(F.transform(codes, band_code), F.transform(centres, lambda v: v.cast("double"))),
    }


# --- reflectance ------------------------------------------------------------


def reflectance(dn: Column, offset: Column, quantification: Column) -> Column:
    """(digital number + offset) / quantification, not clipped: below zero over water is right."""
    return (dn + offset) / quantification


def with_scale(stacks: DataFrame, facts: DataFrame) -> DataFrame:
    """stacks with the offset and quantification of their product; a product without facts, or with several offsets, raises."""
    one = facts.select("product", F.when(F.size(F.array_distinct("offsets")) == 1, F.get("offsets", F.lit(0))).alias("offset"), "quantification")
    x = stacks.join(one, "product", "left")
    return x.withColumn("offset", F.when(F.col("offset").isNotNull(), F.col("offset")).otherwise(F.raise_error(F.concat(F.lit("no single offset for "), F.col("product")))))


def stacked(bands: dict[str, DataFrame]) -> DataFrame:
    """One table (scene_id, r, c, spectrum, grids) out of single-band grids(scene_id, r, c, v): joined on the pixel; `grids` says how many bands cover it."""
    every = reduce(DataFrame.unionByName, (df.select("scene_id", "r", "c", F.lit(k).alias("k"), "v") for k, df in enumerate(bands.values())))
    x = every.groupBy("scene_id", "r", "c").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("_s"), F.count(F.lit(1)).alias("grids"))
    return x.select("scene_id", "r", "c", F.transform("_s", lambda e: e["v"]).alias("spectrum"), "grids")


# --- manifests --------------------------------------------------------------


def upserted(old: DataFrame, new: DataFrame, *, id_col: str, maps: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both by id: new values win where they are given, and the named maps are merged key by key."""
    a = old.withColumnsRenamed({c: f"_o_{c}" for c in old.columns})
    b = new.withColumnsRenamed({c: f"_n_{c}" for c in new.columns})
    x = a.join(b, F.col(f"_o_{id_col}") == F.col(f"_n_{id_col}"), "full")

    def value(c: str) -> Column:
        if c not in new.columns:
            return F.col(f"_o_{c}")
        if c not in old.columns:
            return F.col(f"_n_{c}")
        if c not in maps:
            return F.coalesce(F.col(f"_n_{c}"), F.col(f"_o_{c}"))
        both = F.map_zip_with(F.col(f"_o_{c}"), F.col(f"_n_{c}"), lambda _, u, v: F.coalesce(v, u))
        return F.coalesce(both, F.col(f"_n_{c}"), F.col(f"_o_{c}"))

    columns = [*old.columns, *(c for c in new.columns if c not in old.columns)]
    return x.select(*(value(c).alias(c) for c in columns))


def manifest_totals(manifest: DataFrame, sizes: str = "bytes") -> DataFrame:
    """n_products and the bytes of all assets; `sizes` is a map asset -> bytes."""
    held = F.aggregate(F.map_values(sizes), F.lit(0).cast("long"), lambda t, v: t + F.coalesce(v, F.lit(0).cast("long")))
    return manifest.agg(F.count(F.lit(1)).alias("n_products"), F.coalesce(F.sum(held), F.lit(0)).alias("total_bytes"))


def in_date_order(manifest: DataFrame) -> DataFrame:
    """By date, undated products first."""
    return manifest.orderBy(F.coalesce("date", F.lit("")), "id")


# --- windows ----------------------------------------------------------------


def centred_window(h: Column, w: Column, want_h: int, want_w: int) -> tuple[Column, Column, Column, Column]:
    """(r0, c0, height, width) in the middle of a scene, no larger than it."""
    vh, vw = F.least(F.lit(want_h), h), F.least(F.lit(want_w), w)
    return F.greatest(F.lit(0), F.floor((h - vh) / 2)), F.greatest(F.lit(0), F.floor((w - vw) / 2)), vh, vw


def clamped_window(r0: Column, c0: Column, h: Column, w: Column, full_h: Column, full_w: Column) -> tuple[Column, Column, Column, Column]:
    """A window moved and cut into the scene; it keeps one pixel at least."""
    top, left = F.greatest(F.lit(0), F.least(r0, full_h - 1)), F.greatest(F.lit(0), F.least(c0, full_w - 1))
    return top, left, F.greatest(F.lit(1), F.least(h, full_h - top)), F.greatest(F.lit(1), F.least(w, full_w - left))


def size_mb(h: Column, w: Column, b: Column, *, copies: float = 6.71) -> Column:
    """Fixed value: the copies of a scene that a whole run holds at its peak."""
    return h * w * b * 4 * copies / 1e6


#: The crops of the held-out scenes, scene -> (row, column) of each 64 x 64 crop.
CROPS = {
    "ang20170821t183707_102": ((0, 15),),
    "ang20170821t183707_124": ((0, 0),),
    "ang20170821t195229_21": ((36, 36),),
    "ang20170825t173426_14": ((0, 0),),
    "ang20170825t173426_17": ((0, 36),),
    "ang20170908t225309_32": ((0, 0), (36, 17)),
    "ang20170908t225309_34": ((36, 0),),
    "ang20170908t225309_36": ((0, 0), (10, 36)),
    "ang20170908t225309_37": ((0, 0), (10, 36)),
    "ang20170908t225309_39": ((0, 16),),
    "ang20171012t194435_23": ((0, 0),),
    "ang20180227t082814_15": ((0, 0), (36, 36)),
    "ang20180227t082814_17": ((0, 36), (36, 5)),
    "ang20191004t185054_22": ((0, 0),),
    "ang20191004t185054_27": ((0, 3),),
    "ang20210614t141018_32": ((0, 17),),
    "ang20210614t141018_37": ((10, 0), (36, 36)),
    "ang20210614t141018_38": ((36, 0),),
}


def crops(spark) -> DataFrame:
    """scene_id, r0, c0: a row a crop."""
    return spark.createDataFrame([(s, r, c) for s, places in CROPS.items() for r, c in places], "scene_id string, r0 int, c0 int")
