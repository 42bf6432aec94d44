"""Regions in large numbers: components across tiles, many outlines, hulls and windows a task, overlaps without broadcasts."""

import contextlib
import io
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismal import schema
from prismal.operators import geo, patches, regions, scoring
from prismal.plans import queries, shapes
from prismal.plans.dialect import q

PIXELS = "scene_id string, label long, r long, c long"
FIVE = [(0, 1), (0, 2), (1, 0), (2, 0), (2, 1)]


def _plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as said:
        df.explain()
    return said.getvalue()


def _plain(pixels, around):
    """label by pixel, numbered by first pixel in row order."""
    out, k = {}, 0
    for p in sorted(pixels):
        if p in out:
            continue
        k, left = k + 1, [p]
        while left:
            r, c = left.pop()
            if (r, c) in pixels and (r, c) not in out:
                out[r, c] = k
                left += [(r + i, c + j) for i, j in around]
    return out


@pytest.mark.parametrize("few", [True, False])
def test_components_join_across_tiles(spark, monkeypatch, few):
    """Tiles of four pixels, joined in one task and by star rounds; no step gathers edges of single pixels."""
    monkeypatch.setattr(regions, "TILE", 4)
    monkeypatch.setattr(regions, "IN_ONE_TASK", 1000 if few else 0)
    rng = np.random.default_rng(7)
    on = {s: {(int(r), int(c)) for r, c in np.argwhere(rng.random((19, 23)) < 0.45)} for s in "ab"}
    mask = spark.createDataFrame([(s, r, c, int((r, c) in on[s])) for s in on for r in range(19) for c in range(23)], "scene_id string, r long, c long, m int")
    for connectivity, around in ((8, regions.EIGHT), (4, regions.FOUR)):
        got = regions.connected_components(mask, connectivity=connectivity).collect()
        assert {(x.scene_id, x.r, x.c): x.label for x in got} == {(s, *p): k for s in on for p, k in _plain(on[s], around).items()}


def test_the_width_ends_a_row(spark):
    mask = spark.createDataFrame([("s", 0, 7, 1), ("s", 1, 0, 1), ("s", 7, 7, 1), ("t", 0, 0, 1)], "scene_id string, r long, c long, m int")
    assert sorted((x.scene_id, x.r, x.label) for x in regions.connected_components(mask, width=8).collect()) == [("s", 0, 1), ("s", 1, 2), ("s", 7, 3), ("t", 0, 1)]


def test_the_hull_of_a_wide_region():
    """Its pixels are counted by row: a box of 10^12 pixels is never made."""
    n = 1_000_000
    assert regions.hull_pixels(np.array([0, n]), np.array([0, n])) == n + 1
    assert regions.hull_pixels(np.array([0, 0, 2, 2]), np.array([0, 2, 0, 2])) == 9


def test_many_regions_are_measured_together(spark, monkeypatch):
    """No group of rows goes to Python by itself; groups that end inside of a chunk come out whole."""
    monkeypatch.setattr(regions, "CHUNK", 5)
    ring = [(r, c) for r in range(3) for c in range(3) if (r, c) != (1, 1)]
    labelled = spark.createDataFrame([(s, k, r + 5 * k, c) for s in "ab" for k in range(40) for r, c in (ring if k % 2 else ring[:2])], PIXELS)
    outlines, solid = regions.rings(geo.boundary_edges(labelled)), regions.with_solidity(labelled)
    assert not any("FlatMapGroupsInPandas" in _plan(x) for x in (outlines, solid))
    got = {(x.scene_id, x.label): x.rings for x in outlines.collect()}
    box = lambda y, h, w, x=0: [[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]
    for s in "ab":
        for k in range(40):
            want = [box(5.0 * k, 3, 3), [[1, 5 * k + 1], [1, 5 * k + 2], [2, 5 * k + 2], [2, 5 * k + 1], [1, 5 * k + 1]]] if k % 2 else [box(5.0 * k, 1, 2)]
            assert got[s, k] == want
    assert {(x.scene_id, x.label): x.solidity for x in solid.collect()} == {(s, k): 8 / 9 if k % 2 else 1.0 for s in "ab" for k in range(40)}


def test_outlines_are_placed_together(spark):
    """A square with a hole on a grid of degrees: area and centre take the hole into account; one step has all corners."""
    labelled = spark.createDataFrame([("s", 1, r, c) for r in range(4) for c in range(4) if (r, c) != (1, 1)] + [("s", 2, 9, 9)], PIXELS)
    x = geo.placed(regions.rings(geo.boundary_edges(labelled)), {"a": 0.001, "b": 0.0, "c": 10.0, "d": 0.0, "e": -0.001, "f": 0.0}, None)
    assert "ArrowEvalPython" not in _plan(x)
    a, b = sorted(x.collect(), key=lambda x: x.label)
    assert a.area == pytest.approx(15 * b.area, rel=1e-4) and a.perimeter == pytest.approx(4 * b.perimeter, rel=1e-4)
    assert a.lon == pytest.approx(10 + (16 * 2 - 1.5) / 15000) and a.lat == pytest.approx(-(16 * 2 - 1.5) / 15000)
    assert len(a.polygon) == 2 and b.polygon[0][0] == pytest.approx([10.009, -0.009])


def test_a_model_sees_many_windows_at_once(spark):
    px = spark.createDataFrame([("s", r, c, [float(r)] if (r, c) != (1, 1) else None) for r in range(16) for c in range(16)], "scene_id string, r long, c long, spectrum array<double>")
    windows = spark.createDataFrame([("s", k, 4 * (k // 4), 4 * (k % 4)) for k in range(16)], "scene_id string, turn long, r0 long, c0 long")
    got = patches.predicted(px.coalesce(1), windows, 4, lambda cube: np.nan_to_num(cube[..., 0]) + 1000 * len(cube)).collect()
    assert len(got) == 256 and {(x.r, x.c) for x in got if x.prob is None} == {(1, 1)}
    assert all(x.prob % 1000 == x.r for x in got if x.prob is not None) and max(x.prob for x in got if x.prob is not None) >= 2000


def test_exploded_members_are_not_broadcast(spark):
    """explode() makes many rows of few, which Catalyst's sizes don't show."""
    rects = spark.createDataFrame([("s", "s:anomaly:0001", "object", 0), ("s", "s:anomaly:0002", "object", 1), ("s", "s:change:0003", "landcover", 1)], "scene_id string, roi_id string, target_profile string, r0 long")
    members = rects.select("scene_id", "roi_id", F.explode(F.sequence(F.col("r0"), F.col("r0") + 3)).alias("r"), F.lit(0).alias("c"))
    found, links = regions.overlaps(members), regions.links(rects, members)
    assert "Broadcast" not in _plan(found) and "Broadcast" not in _plan(links)
    assert sorted((x.a, x.b, round(x.iou, 3)) for x in found.collect()) == [("s:anomaly:0001", "s:anomaly:0002", 0.6), ("s:anomaly:0001", "s:change:0003", 0.6), ("s:anomaly:0002", "s:change:0003", 1.0)]
    assert {x.roi_id[-4:]: [y[-4:] for y in x.linked_roi_ids] for x in links.collect()} == {"0001": ["0003"], "0002": ["0003"], "0003": ["0001", "0002"]}
    one = regions.fused(rects.withColumns({"anomaly_score": F.lit(0.5), "change_score": F.lit(None).cast("double")}), members)
    assert sorted((len(x.parents), x.n_px) for x in one.collect()) == [(1, 4), (2, 5)]


def test_each_feature_is_parsed_once(spark):
    """The plan reads a text's properties a few times, not once for every key."""
    x = spark.createDataFrame([("""{"type":"Feature","geometry":{"type":"Point"},"properties":{"roi_id":"a","lat":"wide"}}""",)], "feature string")
    out = schema.feature_violations(x)
    assert _plan(out).count("$.properties") <= 2
    got = {r.rule for r in out.collect()}
    assert {"geometry", "type lat", "missing lon"} <= got and "type roi_id" not in got and len(got) == 16


@pytest.mark.parametrize("miss", [False, True])
def test_a_threshold_is_exact_without_all_scores_in_a_buffer(spark, monkeypatch, miss):
    """Different scores, ties, one score, none; also if the sketch's bracket misses."""
    if miss:
        monkeypatch.setattr(scoring.F, "percentile_approx", lambda v, p, accuracy: F.array(F.min(v), F.min(v)))
    monkeypatch.setattr(scoring, "ACCURACY", 50)
    rng = np.random.default_rng(3)
    on = {"a": rng.normal(size=701), "b": np.round(rng.exponential(size=300), 1), "c": np.array([2.5]), "d": []}
    rows = [(s, i, float(v)) for s, values in on.items() for i, v in enumerate(values)] + [("a", 1000, None), ("d", 0, None)]
    scores = spark.createDataFrame(rows, "scene_id string, pix long, score double")
    for pct in (90.0, 0.0, 100.0) if not miss else (90.0,):
        out = scoring.thresholded(scores, pct=pct)
        assert "percentile" not in _plan(out)
        got = out.collect()
        assert len(got) == len(rows)
        for s, values in on.items():
            limit = np.percentile(values, pct) if len(values) else None
            mine = {x.pix: x for x in got if x.scene_id == s}
            assert all(x.threshold == (limit and pytest.approx(limit, rel=1e-12)) for x in mine.values())
            assert {k for k, x in mine.items() if x.m} == {i for i, v in enumerate(values) if v >= mine[0].threshold}


def test_outlines_across_tiles_need_no_join(spark, monkeypatch):
    """Sides of pixels are found inside of tiles, to which the pixels next to them come; regions may touch or share pixels."""
    rng = np.random.default_rng(5)
    on = {(s, k): {(int(r) - 5, int(c) - 9) for r, c in np.argwhere(rng.random((14, 17)) < 0.6)} for s in "ab" for k in (3, 4)}
    labelled = spark.createDataFrame([(s, k, r, c) for (s, k), pixels in on.items() for r, c in pixels], PIXELS)
    side = {(-1, 0): (0, 0, 1, 0), (0, 1): (1, 0, 1, 1), (1, 0): (1, 1, 0, 1), (0, -1): (0, 1, 0, 0)}
    want = sorted((s, k, c + e[0], r + e[1], c + e[2], r + e[3]) for (s, k), pixels in on.items() for r, c in pixels for (i, j), e in side.items() if (r + i, c + j) not in pixels)
    for tile in (4, 1, 256):
        monkeypatch.setattr(regions, "TILE", tile)
        edges = geo.boundary_edges(labelled)
        assert "Join" not in _plan(edges) and sorted(map(tuple, edges.collect())) == want


def test_polygons_are_measured_together(spark, sf_dir):
    """Rings, corners, areas and centres of a batch at once; no expression walks over the corners of one polygon."""
    assert "lambda" not in _plan(shapes.outlines(spark, sf_dir))
    square = lambda x, y, n: [[x, y], [x + n, y], [x + n, y + n], [x, y + n], [x, y]]
    rows = [(1, [square(0.0, 0.0, 4.0), square(1.0, 1.0, 1.0)[::-1], square(2.0, 2.0, 1.0)]), (2, None), (3, [square(7.0, -9.0, 2.0)[::-1]])]
    got = {x.k: x for x in geo.measured(spark.createDataFrame(rows, "k int, rings array<array<array<double>>>")).collect()}
    assert (got[1].n_rings, got[1].n_corners, got[1].area) == (3, 12, 14.0)
    assert got[1].x == got[1].y == pytest.approx((16 * 2 - 1.5 - 2.5) / 14)
    assert (got[3].area, got[3].x, got[3].y) == (4.0, 8.0, -8.0)
    assert (got[2].n_rings, got[2].n_corners, got[2].area, got[2].x) == (0, 0, None, None)


def test_exported_features_are_read_back_once(spark, sf_dir):
    """Each feature's text is parsed into all its parts at once."""
    plan = _plan(shapes.geojson(spark, sf_dir))
    assert plan.count("from_json(") == 1 and "get_json_object" not in plan and "json_object_keys" not in plan


def test_hulls_and_axes_read_one_exchange(spark):
    """The pixels are dealt out by region once; axes are not dealt out a second time."""
    labelled = spark.createDataFrame([("s", k % 7, k // 7, k % 7) for k in range(70)], PIXELS)
    out = regions.with_solidity(labelled)
    made = [x for x in _plan(out).splitlines() if "Exchange" in x and "REPARTITION_BY_COL" not in x]
    assert len(made) <= 1, made
    assert {(x.label, x.area, x.solidity) for x in out.collect()} == {(k, 10, 1.0) for k in range(7)}


def test_no_filter_of_regions_gathers_all_scores(spark, sf_dir, monkeypatch):
    """percentile() holds all the different scores of a scene in one buffer, which grows with the scene."""

    def refused(*_):
        raise AssertionError("percentile()")

    monkeypatch.setattr(scoring.F, "percentile", refused)
    assert {x.verdict for x in queries.roi_filter(spark, sf_dir).collect()} >= {"kept", "area_min"}


def test_regions_are_measured_before_they_are_numbered(spark, sf_dir, monkeypatch):
    """A filter of regions looks up no pixel by its label; regions over tiles and scenes come out as labelled pixels have them."""
    rng = np.random.default_rng(11)
    rows = [(s, r + 3, c, int(v)) for s in "ab" for (r, c), v in np.ndenumerate(rng.random((21, 13)) < 0.4)]
    mask = spark.createDataFrame(rows, "scene_id string, r long, c long, m int")
    monkeypatch.setattr(regions, "TILE", 4)
    for connectivity in (8, 4):
        want = {(x.scene_id, x.label): x for x in regions.shapes(regions.connected_components(mask, connectivity=connectivity)).collect()}
        got = {(x.scene_id, x.label): x for x in regions.component_shapes(mask, connectivity=connectivity, width=32).collect()}
        assert got.keys() == want.keys() and max(x.area for x in got.values()) > 4
        assert all((x.area, x.box_area, x.major, x.minor) == (want[k].area, want[k].box_area, pytest.approx(want[k].major), pytest.approx(want[k].minor, abs=1e-6)) for k, x in got.items())
    assert regions.component_shapes(mask.where("m = 0")).collect() == []

    def refused(*_, **__):
        raise AssertionError("pixels are labelled")

    monkeypatch.setattr(regions, "connected_components", refused)
    assert {x.verdict for x in queries.roi_filter(spark, sf_dir).collect()} >= {"kept", "area_min"}


@pytest.mark.parametrize("parts", [1, 8])
def test_axes_of_a_shape_are_the_same_everywhere(spark, parts):
    """The major axis of five pixels lies 5e-11 below the edge between two results; far rows, and rows whose squares overflow, don't lift it over."""
    turns = [[(r, c) for r, c in FIVE], [(2 - r, c) for r, c in FIVE], [(c, r) for r, c in FIVE], [(2 - c, r) for r, c in FIVE]]
    rows, tops = [], [0, 90_000, 600_000, 1_000_000, 1_048_570, 3_000_000_000]
    for top in tops:
        for turn in turns:
            for order in itertools.permutations(turn):
                rows += [("s", len(rows) // 5, top + r, 97 + c) for r, c in order]
    labelled = spark.createDataFrame(rows, PIXELS)
    x = regions.shapes(labelled.repartition(parts) if parts > 1 else labelled.coalesce(1))
    got = x.groupBy("area", "major", "minor", q(F.col("major")).alias("shown")).count().collect()
    assert [(y.area, y.shown, y["count"]) for y in got] == [(5, 4.190679, 120 * len(turns) * len(tops))]
    assert got[0].major == pytest.approx(4.190679678250624, abs=1e-14)


def test_lines_have_no_width_anywhere(spark):
    """Pixels in a line, also a slanted one, have a minor axis of 0 and no elongation."""
    lines = [[(k, 0) for k in range(7)], [(0, k) for k in range(7)], [(k, k) for k in range(7)], [(k, 9 - k) for k in range(7)]]
    labelled = spark.createDataFrame([("s", n, 1_000_000 + r, c) for n, line in enumerate(lines) for r, c in line], PIXELS)
    assert {(x.minor, x.elongation) for x in regions.shapes(labelled.repartition(8)).collect()} == {(0.0, None)}
