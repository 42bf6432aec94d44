"""Regions: labelling, shapes, filters, fusion, export."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismal.operators.windows2d import neighbours
from prismal.schema import FEATURE_KEYS
from prismal.session import cut, ship, stored

EIGHT = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]
FOUR = [(-1, 0), (1, 0), (0, -1), (0, 1)]


def smallest_reachable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id that each of nodes(id) reaches over edges(a, b).

    Alternates large and small stars, which needs a number of rounds that is
    logarithmic in the longest path; each round is checkpointed.
    """
    x = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = x.unionByName(x.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        x = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return nodes.join(x.select(F.col("u").alias("id"), F.col("v").alias("_v")), "id", "left").select("id", F.coalesce("_v", "id").alias("label"))


#: Side of a tile in pixels; rows that a task takes at once, in whole tiles or regions; edges that one task joins at most.
TILE, CHUNK, IN_ONE_TASK = 256, 1 << 17, 1 << 18


def united(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest one that it reaches over the edges a[i] - b[i]."""
    root = np.arange(n)
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (further := root[root])).any():
            root = further
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return root


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = CHUNK) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of `least` rows or more with whole groups of rows, which come sorted by `keys`; and the number of each row's group."""
    held, rows, wanted = [], 0, least
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < wanted:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        group = _numbered(table, keys)
        end = int(np.searchsorted(group, group[-1]))
        if end:
            yield table.slice(0, end), group[:end]
        held = table.slice(end).to_batches()
        rows -= end
        wanted = max(least, 2 * rows)
    if rows:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _numbered(table, keys)


def _numbered(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    for k in keys:
        code = table[k].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.cumsum(new)


def _ints(table: pa.Table, *columns: str) -> list[np.ndarray]:
    return [table[c].to_numpy().astype(np.int64) for c in columns]


#: Columns that a scene may have: a pixel's id is its place in row order over scenes and rows of this width.
WIDTH = 1 << 20


def joined_pixels(mask: DataFrame, *, connectivity: int = 8, width: int = WIDTH) -> DataFrame:
    """scene_id, r, c, id, first for pixels with m = 1: a pixel's own id and that of its component's first pixel in row order.

    Pixels meet their neighbours inside of a tile in one task; only edges between tiles go on to the star rounds, or to
    one task if they are few.
    """
    if connectivity not in (4, 8):
        raise ValueError("connectivity is 4 or 8")
    ship(mask.sparkSession)
    outside = (F.col("r") < 0) | (F.col("r") >= width) | (F.col("c") < 0) | (F.col("c") >= width)
    checked = F.when(outside, F.raise_error(F.lit("a pixel lies outside of the width"))).otherwise(F.col("r"))
    on = stored(mask.where("m = 1").select("scene_id", checked.cast("long").alias("r"), F.col("c").cast("long").alias("c")), "on")
    scene = F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("scene_id")) - 1
    scenes = on.select("scene_id").distinct().withColumn("_k", scene.cast("long"))  # one row a scene
    # Edges point one way; either end of one is found by its other end.
    half = [o for o in (FOUR if connectivity == 4 else EIGHT) if o > (0, 0)]

    def inside(batches):
        for table, _ in whole_groups(batches, ["_k", "_tr", "_tc"]):
            k, r, c = _ints(table, "_k", "r", "c")
            ids, at = np.unique((k * width + r) * width + c, return_inverse=True)
            rr, cc = ids // width % width, ids % width
            a, b = [], []
            for i, j in half:
                near = np.flatnonzero((rr + i < width) & (cc + j >= 0) & (cc + j < width))
                found = np.searchsorted(ids, ids[near] + i * width + j)
                hit = ids[np.minimum(found, len(ids) - 1)] == ids[near] + i * width + j
                a.append(near[hit])
                b.append(found[hit])
            root = ids[united(len(ids), np.concatenate(a), np.concatenate(b))]
            yield pa.RecordBatch.from_pydict({"scene_id": table["scene_id"].combine_chunks(), "r": r, "c": c, "id": ids[at], "root": root[at]})

    tile = lambda x: F.floor(F.col(x) / TILE).cast("long")
    dealt = on.join(F.broadcast(scenes), "scene_id").select("scene_id", "_k", "r", "c", tile("r").alias("_tr"), tile("c").alias("_tc")).repartition("_k", "_tr", "_tc").sortWithinPartitions("_k", "_tr", "_tc")
    tiles = stored(dealt.mapInArrow(inside, "scene_id string, r long, c long, id long, root long"), "tiles")
    side = lambda x: (F.col(x) % TILE).isin(0, TILE - 1)
    rim = tiles.where(side("r") | side("c"))
    edges = stored(neighbours(rim, half, ["root"]).join(rim.select("scene_id", "r", "c", "root"), ["scene_id", "r", "c"]).where("root <> n_root").select(F.col("root").alias("a"), F.col("n_root").alias("b")).distinct(), "edges")

    def across(batches):
        if ends := [_ints(pa.Table.from_batches([x]), "a", "b") for x in batches]:
            ids, at = np.unique(np.concatenate([np.concatenate([a for a, _ in ends]), np.concatenate([b for _, b in ends])]), return_inverse=True)
            root = united(len(ids), at[: len(at) // 2], at[len(at) // 2 :])
            yield pa.RecordBatch.from_pydict({"id": ids, "label": ids[root]})

    if edges.count() <= IN_ONE_TASK:
        moved = edges.coalesce(1).mapInArrow(across, "id long, label long")
    else:
        ends = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
        moved = smallest_reachable(ends, edges)
    return tiles.join(moved.select(F.col("id").alias("root"), F.col("label").alias("_to")), "root", "left").select("scene_id", "r", "c", "id", F.coalesce("_to", "root").alias("first"))


def numbered(heads: DataFrame) -> DataFrame:
    """heads(scene_id, r, first), one row a component with its first pixel's row and id, and label: 1, 2, ... in row order.

    A component counts in the row of its first pixel: rows before, then those before it in the row.
    """
    rows = heads.groupBy("scene_id", "r").agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.select("scene_id", "r", (F.sum("_n").over(Window.partitionBy("scene_id").orderBy("r")) - F.col("_n")).alias("_before"))  # one row a row of the scene
    label = F.col("_before") + F.row_number().over(Window.partitionBy("scene_id", "r").orderBy("first"))
    return heads.join(rows, ["scene_id", "r"]).withColumn("label", label.cast("int")).drop("_before")


def connected_components(mask: DataFrame, *, connectivity: int = 8, width: int = WIDTH) -> DataFrame:
    """scene_id, r, c, label for pixels with m = 1; labels 1, 2, ... follow each component's first pixel in row order."""
    found = joined_pixels(mask, connectivity=connectivity, width=width)
    order = numbered(found.where("id = first").select("scene_id", "r", "first").distinct()).select("scene_id", "first", "label")
    return found.join(order, ["scene_id", "first"]).select("scene_id", "r", "c", "label")


def rois(labelled: DataFrame, *, branch: str = "anomaly", profile: str = "object") -> DataFrame:
    """One row a component: id by scan order, half-open box, pixel count."""
    x = labelled.groupBy("scene_id", "label").agg(F.min("r").alias("r0"), F.min("c").alias("c0"), (F.max("r") + 1).alias("r1"), (F.max("c") + 1).alias("c1"), F.count(F.lit(1)).alias("n_px"))
    return x.select(F.format_string("%s:%s:%04d", "scene_id", F.lit(branch), F.col("label") - 1).alias("roi_id"), "scene_id", "label", F.lit(branch).alias("source_branch"), F.lit(profile).alias("target_profile"), "r0", "c0", "r1", "c1", "n_px")


def _exact_sum(x: Column) -> Column:
    """The sum of longs as a decimal: their upper and lower halves are summed apart, so that nothing overflows or is rounded."""
    return F.sum(F.shiftright(x, 32)).cast("decimal(20,0)") * (1 << 32) + F.sum(x.bitwiseAND(F.lit((1 << 32) - 1))).cast("decimal(20,0)")


def shapes(labelled: DataFrame) -> DataFrame:
    """area, axes and elongation of each component, from its pixels' population covariance.

    Sums are exact: a shape has the same axes wherever it lies and however its pixels are ordered and dealt.
    """
    r, c = F.col("r").cast("long"), F.col("c").cast("long")
    sums = {"_r": _exact_sum(r), "_c": _exact_sum(c), "_rr": _exact_sum(r * r), "_cc": _exact_sum(c * c), "_rc": _exact_sum(r * c)}
    x = labelled.groupBy("scene_id", "label").agg(F.count(F.lit(1)).alias("area"), ((F.max("r") - F.min("r") + 1) * (F.max("c") - F.min("c") + 1)).alias("box_area"), *(v.alias(k) for k, v in sums.items()))
    square = F.col("area").cast("double") * F.col("area")
    spread = lambda a, b: (F.col("area") * F.col(f"_{a}{b}") - F.col(f"_{a}") * F.col(f"_{b}")).cast("double")
    x = x.withColumns({"vr": spread("r", "r"), "vc": spread("c", "c"), "vrc": spread("r", "c")}).drop(*sums)  # times area squared
    half, gap = (F.col("vr") + F.col("vc")) / 2, (F.col("vr") - F.col("vc")) / 2
    root = F.sqrt(gap * gap + F.col("vrc") * F.col("vrc"))
    x = x.withColumns({"major": 4 * F.sqrt((half + root) / square), "minor": 4 * F.sqrt(F.greatest(F.lit(0.0), half - root) / square)} | {k: F.col(k) / square for k in ("vr", "vc", "vrc")})
    return x.withColumn("elongation", F.when(F.col("minor") > 0, F.col("major") / F.col("minor")))


def component_shapes(mask: DataFrame, *, connectivity: int = 8, width: int = WIDTH) -> DataFrame:
    """shapes() of a mask's components. They are measured first and numbered then, one row a region: no pixel is looked up by its label."""
    pixels = joined_pixels(mask, connectivity=connectivity, width=width).withColumnRenamed("first", "label")
    measured = stored(shapes(pixels).withColumnRenamed("label", "first"), "shapes")
    return numbered(measured.withColumn("r", F.expr(f"first div {width}") % width)).drop("r", "first")


#: Thresholds of the shape gate and the indices of each profile.
PROFILES = {
    "object": {"min_area_px": 4, "max_area_px": 2000, "min_solidity": 0.15, "max_elongation": 8.0, "indices": ("ndbi", "iron_oxide_ratio", "clay_ratio", "brightness")},
    "landcover": {"min_area_px": 50, "max_area_px": None, "min_solidity": 0.05, "max_elongation": 20.0, "indices": ("ndvi", "ndwi", "nbr", "bsi")},
}


def profile_of(name: str, more: dict | None = None) -> dict:
    """The thresholds of a profile, of PROFILES or given; an unknown name raises."""
    known = PROFILES | (more or {})
    if name not in known:
        raise KeyError(f"{name} is none of {sorted(known)}")
    return dict(known[name])


def resolved_max(profile: dict, scene_px: Column | int) -> Column:
    """The largest area that a region may have in a scene: never more than half of it; an unbounded one stays unbounded."""
    if profile.get("max_area_px") is None:
        return F.lit(None).cast("double")
    return F.least(F.lit(float(profile["max_area_px"])), 0.5 * (F.lit(scene_px) if isinstance(scene_px, int) else scene_px))


def judged(props: DataFrame, *, min_area: int, max_area: int | None, max_elongation: float | None, min_solidity: float | None = None, scene_px: Column | None = None) -> DataFrame:
    """verdict = the first criterion that fails, else 'kept', and by how much it fails; an unbounded area stays unbounded."""
    top = F.lit(max_area).cast("double") if scene_px is None else resolved_max({"max_area_px": max_area}, scene_px)
    bent = F.lit(False) if max_elongation is None else F.coalesce(F.col("elongation"), F.lit(float("inf"))) > max_elongation
    thin = F.lit(False) if min_solidity is None else F.coalesce(F.col("solidity"), F.lit(float("-inf"))) < min_solidity
    verdict = F.when(F.col("area") < min_area, "area_min").when(top.isNotNull() & (F.col("area") > top), "area_max").when(thin, "solidity").when(bent, "elongation").otherwise("kept")
    margin = F.when(verdict == "area_min", F.lit(min_area) - F.col("area")).when(verdict == "area_max", F.col("area") - top)
    if min_solidity is not None:
        margin = margin.when(verdict == "solidity", min_solidity - F.col("solidity"))
    if max_elongation is not None:
        margin = margin.when(verdict == "elongation", F.coalesce(F.col("elongation"), F.lit(float("inf"))) - max_elongation)
    return props.withColumn("verdict", verdict).withColumn("margin", margin.cast("double"))


def gated(props: DataFrame, profile: dict, scene_px: Column | int) -> DataFrame:
    """judged() by a profile, and shape_plausibility: 0 if a criterion fails, else a mean of solidity and of how far the elongation is from its limit."""
    size = F.lit(scene_px) if isinstance(scene_px, int) else scene_px
    x = judged(props, min_area=profile.get("min_area_px") or 0, max_area=profile.get("max_area_px"), max_elongation=profile.get("max_elongation"), min_solidity=profile.get("min_solidity"), scene_px=size)
    clipped = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    most = profile.get("max_elongation")
    if most is not None and most > 1:
        round_ = F.when(F.col("elongation").isNotNull(), clipped(1 - (F.col("elongation") - 1) / (most - 1))).otherwise(0.0)
    else:
        round_ = F.when(F.col("elongation").isNotNull(), 1.0).otherwise(0.0)
    score = F.sqrt(F.greatest(clipped(F.col("solidity")), F.lit(1e-6)) * F.greatest(round_, F.lit(1e-6)))
    return x.withColumn("shape_plausibility", F.when(F.col("verdict") != "kept", 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(1e-6), score))))


def split(judged_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): nothing is lost."""
    return judged_.where("verdict = 'kept'"), judged_.where("verdict <> 'kept'")


def audit(dropped: DataFrame, profile: dict) -> DataFrame:
    """roi_id and a JSON record of why each dropped region fell."""
    record = F.struct(F.lit("profile gate").alias("stage"), *(F.col(c) for c in ("roi_id", "source_branch", "target_profile", "area", "solidity", "major", "minor", "elongation")), *(F.lit(profile.get(k)).alias(k) for k in ("min_area_px", "max_area_px", "min_solidity", "max_elongation")), F.col("verdict").alias("failing_criterion"), "margin")
    return dropped.select("roi_id", F.to_json(record).alias("record"))


def hull_pixels(rows: np.ndarray, cols: np.ndarray) -> int:
    """Pixels whose centre lies in the convex hull of all the pixels' edge midpoints."""
    points = sorted({(2 * int(c) + dc, 2 * int(r) + dr) for r, c in zip(rows, cols) for dr, dc in ((-1, 0), (1, 0), (0, -1), (0, 1))})

    def half(side):
        out: list[tuple[int, int]] = []
        for x, y in side:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (x - out[-2][0]):
                out.pop()
            out.append((x, y))
        return out[:-1]

    hull = half(points) + half(points[::-1])
    top = int(min(rows))
    first = np.full(int(max(rows)) - top + 1, np.iinfo(np.int64).min)
    last = np.full(len(first), np.iinfo(np.int64).max)
    # Each edge bounds the columns of the rows between its ends, rounded inwards.
    for (x0, y0), (x1, y1) in zip(hull, hull[1:] + hull[:1]):
        r = np.arange((min(y0, y1) + 1) // 2, max(y0, y1) // 2 + 1)
        if y0 != y1 and len(r):
            at, dy = (x1 - x0) * (2 * r - y0) + x0 * (y1 - y0), 2 * (y1 - y0)
            if dy > 0:
                last[r - top] = np.minimum(last[r - top], at // dy)
            else:
                first[r - top] = np.maximum(first[r - top], -(at // -dy))
    return int((last - first + 1).sum())


class Shapes(OrderedDict):
    """What shapes seen lately have come to, so that equal ones are worked out once; 100,000 bytes of keys a shape at most."""

    most = 20_000

    def of(self, key: bytes, make):
        if len(key) > 100_000:
            return make()
        if key not in self:
            self[key] = make()
            if len(self) > self.most:
                self.popitem(last=False)
        return self[key]


_hulls = Shapes()


def _hull(ends: np.ndarray) -> int:
    """hull_pixels() of rows (row, first column, last column)."""
    return _hulls.of(ends.tobytes(), lambda: hull_pixels(np.concatenate([ends[:, 0], ends[:, 0]]), np.concatenate([ends[:, 1], ends[:, 2]])))


def with_solidity(labelled: DataFrame) -> DataFrame:
    """shapes() with solidity, the share of its convex hull that a region fills. A region's hull is made in one task from its rows' ends alone."""
    ship(labelled.sparkSession)
    kind = dict(labelled.dtypes)["label"]

    def solid(batches):
        for table, group in whole_groups(batches, ["scene_id", "label"]):
            r, c = _ints(table, "r", "c")
            order = np.lexsort((c, r, group))
            g, r, c = group[order], r[order], c[order]
            start = np.flatnonzero(np.diff(g, prepend=-1))
            # The hull of a region is that of the first and last pixel of each of its rows.
            line = np.flatnonzero(np.diff(g, prepend=-1) | np.diff(r, prepend=r[0]))
            ends = np.stack([r[line], c[line], c[np.append(line[1:], len(r)) - 1]], 1)
            home = g[line]
            n = np.diff(np.append(start, len(r)))
            left = np.minimum.reduceat(ends[:, 1], first := np.searchsorted(home, np.arange(len(start))))
            ends -= np.stack([r[start], left, left], 1)[home]
            hulls = [_hull(ends[lo:hi]) for lo, hi in zip(first, np.append(first[1:], len(home)))]
            at = table.select(["scene_id", "label"]).take(start)
            yield pa.RecordBatch.from_pydict({"scene_id": at["scene_id"].combine_chunks(), "label": at["label"].combine_chunks(), "solidity": n / np.array(hulls, float)})

    # Both read one exchange of the pixels.
    together = labelled.select("scene_id", "label", "r", "c").repartition("scene_id", "label")
    solidity = together.sortWithinPartitions("scene_id", "label").mapInArrow(solid, f"scene_id string, label {kind}, solidity double")
    return shapes(together).join(solidity, ["scene_id", "label"])


def overlaps(members: DataFrame, *, least: float = 0.3) -> DataFrame:
    """(a, b, iou) of regions that share pixels enough; members(scene_id, roi_id, r, c). An equi-join on pixels: no pair without overlap arises.

    Members are often made by explode(), which Catalyst takes for a table no larger than its source, so the joins here
    and below say that nothing is to be broadcast.
    """
    sizes = members.groupBy("roi_id").agg(F.count(F.lit(1)).alias("n")).hint("merge")
    m = members.select("scene_id", "r", "c", "roi_id")
    pairs = m.withColumnRenamed("roi_id", "a").hint("merge").join(m.withColumnRenamed("roi_id", "b"), ["scene_id", "r", "c"]).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("i"))
    x = pairs.join(sizes.select(F.col("roi_id").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("roi_id").alias("b"), F.col("n").alias("nb")), "b")
    return x.withColumn("iou", F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))).where(F.col("iou") >= least).select("a", "b", "iou")


def profiled(edges: DataFrame, regions: DataFrame) -> DataFrame:
    """edges(a, b) with the profile of either end as pa and pb."""
    profile = regions.select("roi_id", "target_profile").hint("merge")
    return edges.join(profile.select(F.col("roi_id").alias("a"), F.col("target_profile").alias("pa")), "a").join(profile.select(F.col("roi_id").alias("b"), F.col("target_profile").alias("pb")), "b")


def fused(regions: DataFrame, members: DataFrame, *, least: float = 0.3, scores: list[str] = ("anomaly_score", "change_score")) -> DataFrame:
    """Regions of one profile that overlap, however indirectly, become one: united pixels, best scores, parents listed."""
    same = profiled(overlaps(members, least=least), regions).where("pa = pb")
    group = smallest_reachable(regions.select(F.col("roi_id").alias("id")), same).select(F.col("id").alias("roi_id"), F.col("label").alias("root")).hint("merge")
    heads = regions.join(group, "roi_id").groupBy("scene_id", "root", "target_profile").agg(F.array_sort(F.collect_list("roi_id")).alias("parents"), *(F.max(s).alias(s) for s in scores))
    extent = members.join(group, "roi_id").select("root", "r", "c").distinct().groupBy("root").agg(F.min("r").alias("r0"), F.min("c").alias("c0"), (F.max("r") + 1).alias("r1"), (F.max("c") + 1).alias("c1"), F.count(F.lit(1)).alias("n_px"))
    number = F.row_number().over(Window.partitionBy("scene_id").orderBy("root")) - 1
    return heads.join(extent.hint("merge"), "root").withColumn("roi_id", F.format_string("%s:fused:%04d", "scene_id", number))


def rings(edges: DataFrame) -> DataFrame:
    """scene_id, label, rings: a region's outline from its boundary edges, the outer ring first, then holes; corners as arrays [x, y] in pixels.

    Edges that meet in one corner are followed so that pixels that touch there stay together, as in eight-connected
    regions. One task has the boundary of one region, and joins the edges of many regions at once.
    """
    ship(edges.sparkSession)
    kind = dict(edges.dtypes)["label"]

    def traced(batches):
        for table, group in whole_groups(batches, ["scene_id", "label"]):
            at = table.select(["scene_id", "label"]).take(np.flatnonzero(np.diff(group, prepend=-1)))
            yield pa.RecordBatch.from_pydict({"scene_id": at["scene_id"].combine_chunks(), "label": at["label"].combine_chunks(), "rings": joined_edges(group, *_ints(table, "x0", "y0", "x1", "y1"))})

    together = edges.select("scene_id", "label", "x0", "y0", "x1", "y1").repartition("scene_id", "label").sortWithinPartitions("scene_id", "label")
    return together.mapInArrow(traced, f"scene_id string, label {kind}, rings array<array<array<double>>>")


def joined_edges(group: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> pa.ListArray:
    """For each group 0, 1, ..., in order, its unit edges with the region to their right, joined to closed rings without straight corners."""
    n = len(group)
    places = np.empty((2 * n, 3), np.int64)
    places[:, 0], places[:, 1], places[:, 2] = np.tile(group, 2), np.concatenate([y0, y1]), np.concatenate([x0, x1])
    order = np.lexsort((places[:, 2], places[:, 1], places[:, 0]))
    corner = np.empty(2 * n, np.int64)
    corner[order] = np.cumsum((places[order] != places[np.roll(order, 1)]).any(1)) - 1
    start, end = corner[:n], corner[n:]  # numbered by group, row and column
    out = np.argsort(start, kind="stable")
    lo, hi = np.searchsorted(start[out], end), np.searchsorted(start[out], end, "right")
    if (lo == hi).any():
        raise ValueError("an outline isn't closed")
    after, other = out[lo], out[hi - 1]
    dx, dy = x1 - x0, y1 - y0
    # Where two ways lead on, the one that turns left, to the pixel across the corner.
    left = dx * dy[other] - dy * dx[other] < dx * dy[after] - dy * dx[after]
    after = np.where(left, other, after)
    # A ring is known by its first corner in row order, which it meets once. Steps are doubled until all is known.
    ring, step = start.copy(), after
    while ((least := np.minimum(ring, ring[step])) != ring).any():
        ring, step = least, step[step]
    head = ring == start
    step, left_over = np.where(head, np.arange(n), after), np.where(head, 0, 1)
    while not head[step].all():
        left_over, step = left_over + left_over[step], step[step]
    before = np.empty(n, np.int64)
    before[after] = np.arange(n)
    kept = np.flatnonzero((dx != dx[before]) | (dy != dy[before]))
    heads = np.flatnonzero(head)
    by = np.argsort(ring[heads])
    heads = heads[by]
    place = np.searchsorted(ring[heads], ring)
    size = np.zeros(len(heads), np.int64)
    np.add.at(size, place, x0 * y1 - x1 * y0)
    # Of a group's rings the largest comes first; each begins and ends at its head.
    turn = np.lexsort((y0[heads], x0[heads], -np.abs(size), group[heads]))
    number = np.empty(len(heads), np.int64)
    number[turn] = np.arange(len(heads))
    points = np.concatenate([kept, heads])
    last = np.concatenate([np.zeros(len(kept), bool), np.ones(len(heads), bool)])
    along = np.where(last, 1, np.where(head[points], np.iinfo(np.int64).min, -left_over[points]))
    line = np.lexsort((along, number[place[points]]))
    points = points[line]
    flat = np.stack([x0[points], y0[points]], 1).astype(float).ravel()
    bound = lambda counts: pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    pairs = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 2), pa.int32()), flat)
    each = pa.ListArray.from_arrays(bound(np.bincount(number[place[points]], minlength=len(heads))), pairs)
    return pa.ListArray.from_arrays(bound(np.bincount(group[heads], minlength=int(group[-1]) + 1)), each)


def features(regions: DataFrame) -> DataFrame:
    """One GeoJSON feature a region: roi_id and its text.

    regions has the properties of schema.FEATURE_KEYS as columns and `polygon`, an array of rings of [lon, lat].
    """
    properties = F.struct(*(F.col(k) for k in FEATURE_KEYS))
    options = {"ignoreNullFields": "false"}
    geometry = F.struct(F.lit("Polygon").alias("type"), F.col("polygon").alias("coordinates"))
    return regions.select("roi_id", F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")), options).alias("feature"))


def collections(feature_rows: DataFrame, scenes: DataFrame) -> DataFrame:
    """scene_id, geojson: a valid collection for every scene, also one without a feature. A row holds the features of one scene."""
    held = feature_rows.groupBy("scene_id").agg(F.array_join(F.array_sort(F.collect_list("feature")), ",").alias("f"))
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.coalesce("f", F.lit("")), F.lit("]}"))
    return scenes.select("scene_id").join(held, "scene_id", "left").select("scene_id", text.alias("geojson"))


def links(regions: DataFrame, members: DataFrame, *, least: float = 0.3) -> DataFrame:
    """roi_id, linked_roi_ids: overlapping regions of another profile, both ways; regions without any have an empty list."""
    x = profiled(overlaps(members, least=least), regions).where("pa <> pb")
    both = x.select("a", "b").unionByName(x.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = both.groupBy(F.col("a").alias("roi_id")).agg(F.array_sort(F.collect_list("b")).alias("linked_roi_ids"))
    return regions.select("roi_id").join(found.hint("merge"), "roi_id", "left").withColumn("linked_roi_ids", F.coalesce("linked_roi_ids", F.array().cast("array<string>")))


def largest_pieces(labelled: DataFrame, pieces: str = "piece") -> DataFrame:
    """labelled(scene_id, label, piece, r, c): the pixels of each label's largest piece, the first of equally large ones."""
    sizes = labelled.groupBy("scene_id", "label", pieces).agg(F.count(F.lit(1)).alias("_n"))
    best = sizes.groupBy("scene_id", "label").agg(F.max(F.struct("_n", (-F.col(pieces)).alias("_k"))).alias("_b")).select("scene_id", "label", (-F.col("_b._k")).alias(pieces))
    return labelled.join(best, ["scene_id", "label", pieces], "left_semi")
