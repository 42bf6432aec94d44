"""Operators against numpy, the missing-data rules, and the queries against DuckDB."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismal import schema
from prismal.functions import spectral
from prismal.operators import change, detectors, geo, harmonize, metrics, regions, scoring, windows2d
from prismal.plans import registry as plans
from prismal.streaming import moments as streams

plans.load()
RNG = np.random.default_rng(5)
H, W, B = 12, 11, 4
CUBE = RNG.normal(size=(H, W, B))
CUBE[4, 5] += 9
MISSING = {(2, 3), (7, 7)}


@pytest.fixture(scope="module")
def px(spark):
    rows = [("s", int(r * W + c), int(r), int(c), None if (r, c) in MISSING else [float(x) for x in CUBE[r, c]]) for r in range(H) for c in range(W)]
    return spark.createDataFrame(rows, schema.PIXELS).cache()


def as_map(df, column="score"):
    out = np.full((H, W), np.nan)
    for row in df.collect():
        out[row.r, row.c] = np.nan if row[column] is None else row[column]
    return out


def valid():
    v = np.ones((H, W), bool)
    for p in MISSING:
        v[p] = False
    return v


def same(a, b, tol=1e-6):
    assert np.array_equal(np.isnan(a), np.isnan(b))
    assert np.allclose(np.nan_to_num(a), np.nan_to_num(b), rtol=tol, atol=tol)


def rx(x, sigma_ridge=1e-6):
    rows = CUBE[valid()]
    centred = rows - rows.mean(0)
    sigma = centred.T @ centred / len(rows)
    sigma += sigma_ridge * np.trace(sigma) / B * np.eye(B)
    gap = x - rows.mean(0)
    return np.einsum("...i,ij,...j", gap, np.linalg.inv(sigma), gap)


def test_global_rx(px):
    want = rx(CUBE)
    want[~valid()] = np.nan
    same(as_map(detectors.global_rx(px)), want)
    same(as_map(detectors.global_rx(px.orderBy(F.rand(1)).repartition(7))), want)


def test_missing_bands_count_as_missing_pixels(spark):
    rows = [("s", 0, 0, 0, [1.0, float("nan")]), ("s", 1, 0, 1, [1.0, None]), ("s", 2, 0, 2, [1.0, 2.0])]
    got = schema.cleaned(spark.createDataFrame(rows, schema.PIXELS)).orderBy("pix").collect()
    assert [r.spectrum for r in got] == [None, None, [1.0, 2.0]]


def ring(r, c, inner, outer):
    o, i = outer // 2, inner // 2
    v = valid()
    return [CUBE[y, x] for y in range(max(0, r - o), min(H, r + o + 1)) for x in range(max(0, c - o), min(W, c + o + 1)) if v[y, x] and not (abs(y - r) <= i and abs(x - c) <= i)]


@pytest.mark.parametrize("tile", [4, 64])
def test_crd(px, tile):
    want = np.full((H, W), np.nan)
    for r, c in np.argwhere(valid()):
        x, y = np.array(ring(r, c, 3, 7)), CUBE[r, c]
        gram = x @ x.T + np.diag(1e-2 * ((x - y) ** 2).sum(1)) + 1e-9 * np.eye(len(x))
        want[r, c] = np.linalg.norm(y - x.T @ np.linalg.solve(gram, x @ y))
    same(as_map(detectors.crd(px, inner=3, outer=7, tile=tile)), want, 1e-5)
    with pytest.raises(ValueError):
        detectors.crd(px, inner=4, outer=7)


def test_local_rx(px):
    want = np.full((H, W), np.nan)
    for r, c in np.argwhere(valid()):
        x = np.array(ring(r, c, 3, 7))
        gap, centred = CUBE[r, c] - x.mean(0), x - x.mean(0)
        if len(x) >= 2 * B:
            want[r, c] = gap @ np.linalg.solve(centred.T @ centred / len(x) + 1e-4 * np.eye(B), gap)
    same(as_map(detectors.local_rx(px, inner=3, outer=7, components=B, tile=5)), want, 1e-5)  # a full rotation changes nothing


def test_kernel_rx(px):
    got = as_map(detectors.kernel_rx(px, n_background=1000))
    assert np.array_equal(np.isnan(got), ~valid()) and np.nanargmax(got) == 4 * W + 5
    same(got, as_map(detectors.kernel_rx(px.repartition(5), n_background=1000)))


def test_heavy_queries_have_the_reference_settings(spark, sf_dir):
    from prismal.sources import scenes

    scene = scenes.pixels(spark, sf_dir)
    score = lambda df: {r.pix: r.score for r in df.collect()}
    x = {r.pix: np.array(r.spectrum) for r in scene.collect()}
    b = np.stack([x[i] for i in sorted(x)])
    assert 200 < len(b) <= 2000  # all pixels are background
    squared = ((b[:, None] - b[None]) ** 2).sum(2)
    k = np.exp(-squared / (2 * np.median(squared[np.triu_indices(len(b), 1)])))
    centred = k - k.mean(0) - k.mean(1)[:, None] + k.mean()
    # In feature space: x' (covariance + reg)^-1 x, with the covariance's eigenvectors from the centred kernel.
    values, vectors = np.linalg.eigh(centred)
    on = values > 1e-9
    inside = (centred @ vectors[:, on]) ** 2 / values[on]
    outside = np.diag(centred) - inside.sum(1)
    scores = (inside / (values[on] / len(b) + 1e-2)).sum(1) + outside / 1e-2
    want = dict(zip(sorted(x), scores))
    for name, want in {"kernel_rx": want, "crd": score(detectors.crd(scene, inner=5, outer=15)), "local_rx": score(detectors.local_rx(scene, inner=3, outer=15, components=12))}.items():
        got = score(plans.QUERIES[name](spark, sf_dir))
        assert got.keys() == want.keys() and got == pytest.approx(want, rel=1e-6), name


def test_kernel_rx_chunks(px, monkeypatch):
    whole = as_map(detectors.kernel_rx(px))
    monkeypatch.setattr(detectors, "CHUNK", 20)
    same(as_map(detectors.kernel_rx(px)), whole)


def test_kernel_rx_sample(spark):
    """The background is the pixels with the smallest hashes, also where only a part of the scene is sorted for it."""
    x = spark.range(2000).select(F.lit("s").alias("scene_id"), F.col("id").alias("pix"), F.expr("id div 50").alias("r"), (F.col("id") % 50).alias("c"), F.array(F.sin("id"), F.cos(F.col("id") * 1.7)).alias("spectrum"))
    low = x.orderBy(F.xxhash64("pix", F.lit(0)), "pix").limit(30)
    want = {r.pix: r.score for r in detectors.kernel_rx(low).collect()}
    got = {r.pix: r.score for r in detectors.kernel_rx(x, n_background=30).collect()}
    assert len(got) == 2000 and {i: got[i] for i in want} == pytest.approx(want, rel=1e-6)


def test_weight_search_has_the_reference_levels(spark, sf_dir):
    rows = plans.QUERIES["weight_search"](spark, sf_dir).collect()
    assert {(r.a, r.b, r.c) for r in rows} == {(a / 10, b / 10, c / 10) for a in range(9) for b in range(9) for c in range(9)} - {(0, 0, 0)} and len(rows) == 728


def test_fused_and_registry(px):
    got = as_map(detectors.detect("fused", px))
    assert np.nanargmax(got) == 4 * W + 5 and np.nanmax(got) <= 1
    with pytest.raises(KeyError):
        detectors.detect("none", px)


def test_weights():
    assert scoring.normalised_weights(scoring.WEIGHTS, ["rx", "ace"]) == pytest.approx({"rx": 0.4 / 0.65, "ace": 0.25 / 0.65})
    for bad in ([], ["other"]):
        with pytest.raises(ValueError):
            scoring.normalised_weights(scoring.WEIGHTS, bad)


def test_rank_ties_and_single_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 3.0), ("a", None), ("b", 5.0)], "scene_id string, score double")
    got = sorted((r.scene_id, -1 if r.score is None else r.score, r.rank_norm) for r in scoring.rank_normalised(df).collect())
    assert got == [("a", -1, None), ("a", 1.0, 0.25), ("a", 1.0, 0.25), ("a", 3.0, 1.0), ("b", 5.0, 0.5)]


def test_spectral_angle_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(spectral.spectral_angle(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(np.pi / 2) and got[1] == pytest.approx(0, abs=1e-7) and got[2:] == [None, None]


@pytest.mark.parametrize("mode", ["edge", "reflect", "symmetric"])
def test_borders(spark, mode):
    grid = spark.createDataFrame([("s", r, c, float(10 * r + c)) for r in range(4) for c in range(3)], "scene_id string, r long, c long, v double")
    got = {(x.r, x.c): x.t for x in windows2d.neighbours(grid, windows2d.offsets_box(3), ["v"], mode=mode).groupBy("r", "c").agg(F.sum("n_v").alias("t")).collect()}
    padded = np.pad(np.add.outer(10.0 * np.arange(4), np.arange(3)), 1, mode=mode)
    assert all(got[r, c] == padded[r : r + 3, c : c + 3].sum() for r in range(4) for c in range(3))


def test_structure(spark):
    a, b = RNG.normal(size=(2, 9, 8, 3))
    rows = [("s", int(r * 8 + c), int(r), int(c), a[r, c].tolist(), b[r, c].tolist()) for r in range(9) for c in range(8)]
    got = {(x.r, x.c): x for x in change.structure(spark.createDataFrame(rows, "scene_id string, pix long, r long, c long, s1 array<double>, s2 array<double>"), patch=5).collect()}
    d = b - a
    mean = d.mean(2)
    bins = np.minimum(15, np.floor((mean - mean.min()) / (mean.max() - mean.min()) * 16)).astype(int)
    dp, bp = np.pad(d, ((2, 2), (2, 2), (0, 0)), mode="reflect"), np.pad(bins, 2, mode="edge")
    for (r, c), x in got.items():
        assert x.variance == pytest.approx(dp[r : r + 5, c : c + 5].reshape(-1, 3).var(0).mean())
        p = np.bincount(bp[r : r + 5, c : c + 5].ravel()) / 25
        assert x.entropy == pytest.approx(-(p[p > 0] * np.log2(p[p > 0])).sum())


def test_coherence(spark):
    a, b = RNG.normal(size=(2, 8, 8, 3))
    rows = [("s", int(r * 8 + c), int(r), int(c), a[r, c].tolist(), b[r, c].tolist()) for r in range(8) for c in range(8)]
    d = np.pad(b - a, ((2, 2), (2, 2), (0, 0)), mode="reflect")
    for x in change.coherence(spark.createDataFrame(rows, "scene_id string, pix long, r long, c long, s1 array<double>, s2 array<double>"), patch=5).collect():
        corr = np.corrcoef(d[x.r : x.r + 5, x.c : x.c + 5].reshape(-1, 3).T)
        assert x.coherence == pytest.approx(np.abs(corr[np.triu_indices(3, 1)]).mean())


@pytest.mark.parametrize("north", [884000.0, 3874000.0])
def test_square_kilometre(spark, north):
    xs, ys = [500000.0, 501000.0, 501000.0, 500000.0, 500000.0], [north, north, north + 1000, north + 1000, north]
    df = spark.createDataFrame(list(zip(range(5), xs, ys)), "k int, x double, y double")
    lon, lat = geo.utm_to_wgs84(F.col("x"), F.col("y"), 43)
    df = df.select("k", lon.alias("lon"), lat.alias("lat")).select("k", "lon", "lat", *(v.alias(n) for v, n in zip(geo.equal_area(F.col("lon"), F.col("lat")), "ab")))
    ring = df.agg(F.sort_array(F.collect_list(F.struct("k", "lon", "lat", "a", "b"))).alias("p"))
    ring = ring.select(*(F.col(f"p.{c}").alias(c) for c in ("lon", "lat", "a", "b")))
    got = geo.perimeter(ring, "lon", "lat").select("perimeter_m", geo.ring_area(F.col("a"), F.col("b")).alias("area"), F.get("lon", F.lit(0)).alias("lon"), F.get("lat", F.lit(0)).alias("lat")).first()
    assert got.lon == pytest.approx(75.0) and got.lat == pytest.approx(8.0 if north < 1e6 else 35.0, abs=0.02)
    assert got.perimeter_m == pytest.approx(4000 / 0.9996, rel=1e-4) and got.area == pytest.approx(1e6 / 0.9996**2, rel=1e-4)


def test_components_follow_scan_order(spark):
    art = ["#.#", "...", "##.", "..#"]
    mask = spark.createDataFrame([("s", r, c, int(x == "#")) for r, line in enumerate(art) for c, x in enumerate(line)], "scene_id string, r long, c long, m int")
    eight = {(x.r, x.c): x.label for x in regions.connected_components(mask).collect()}
    four = {(x.r, x.c): x.label for x in regions.connected_components(mask, connectivity=4).collect()}
    assert eight == {(0, 0): 1, (0, 2): 2, (2, 0): 3, (2, 1): 3, (3, 2): 3}
    assert four == {(0, 0): 1, (0, 2): 2, (2, 0): 3, (2, 1): 3, (3, 2): 4}
    assert regions.connected_components(mask.where("m = 0")).count() == 0


def test_long_chains_are_one_component(spark):
    edges = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = regions.smallest_reachable(spark.range(402).toDF("id"), edges)
    assert {r.id: r.label for r in got.collect()} == {i: 0 if i <= 400 else 401 for i in range(402)}


def test_empty_collection(spark):
    scenes_ = spark.createDataFrame([("s",), ("empty",)], "scene_id string")
    some = spark.createDataFrame([("s", '{"type":"Feature"}')], "scene_id string, feature string")
    got = {r.scene_id: json.loads(r.geojson) for r in regions.collections(some, scenes_).collect()}
    assert got == {"s": {"type": "FeatureCollection", "features": [{"type": "Feature"}]}, "empty": {"type": "FeatureCollection", "features": []}}


def test_outlines_and_hulls(spark):
    """A ring with a hole, two pixels that touch in a corner, an L: corners, holes, sizes, solidity."""
    shapes_ = {
        1: [(r, c) for r in range(3) for c in range(3) if (r, c) != (1, 1)],
        2: [(6, 0), (7, 1)],
        3: [(10, 0), (11, 0), (12, 0), (12, 1), (12, 2)],
        4: [(20, c) for c in range(5)],
    }
    labelled = spark.createDataFrame([("s", k, r, c) for k, v in shapes_.items() for r, c in v], "scene_id string, label long, r long, c long")
    got = {r.label: r.rings for r in regions.rings(geo.boundary_edges(labelled)).collect()}
    assert [len(got[k]) for k in (1, 2, 3, 4)] == [2, 1, 1, 1]
    assert [len(got[k][0]) - 1 for k in (1, 2, 3, 4)] == [4, 8, 6, 4] and len(got[1][1]) == 5
    assert got[4][0] == [[0.0, 20.0], [5.0, 20.0], [5.0, 21.0], [0.0, 21.0], [0.0, 20.0]]
    area = {r.label: r.a for r in regions.rings(geo.boundary_edges(labelled)).select("label", geo.polygon_area(F.col("rings")).alias("a")).collect()}
    assert area == {k: len(v) for k, v in shapes_.items()}
    x, y = geo.centroid(F.col("rings"))
    middle = {r.label: (r.x, r.y) for r in regions.rings(geo.boundary_edges(labelled)).select("label", x.alias("x"), y.alias("y")).collect()}
    for k, v in shapes_.items():
        assert middle[k] == pytest.approx((np.mean([c for _, c in v]) + 0.5, np.mean([r for r, _ in v]) + 0.5))
    solid = {r.label: r.solidity for r in regions.with_solidity(labelled).collect()}
    assert solid == pytest.approx({1: 8 / 9, 2: 1.0, 3: 5 / 6, 4: 1.0})


def test_streamed_updates_keep_every_key(spark, tmp_path):
    """Two batches that change different keys: each key's last word counts."""
    schema_ = "k string, value double"
    for n, rows in enumerate([[("a", 1.0), ("b", 2.0)], [("b", 4.0)], [("c", 8.0)]]):
        spark.createDataFrame(rows, schema_).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{n}"))
    stream = spark.readStream.schema(schema_).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    got = streams.settled(streams.running_moments(stream, "k", ["value"]), "update", ("k",))
    assert {r.k: (r.n, r["mean"][0]) for r in got.collect()} == {"a": (1, 1.0), "b": (2, 3.0), "c": (1, 8.0)}


def test_interpolation_keeps_missing_bands_local(spark):
    bands = spark.createDataFrame([(0, 400.0), (1, 500.0), (2, 600.0)], "b int, wl double")
    targets = spark.createDataFrame([(0, 350.0), (1, 500.0), (2, 550.0), (3, 700.0)], "t int, wl double")
    px = spark.createDataFrame([([1.0, 3.0, None],)], "spectrum array<double>")
    assert harmonize.interpolated(px, harmonize.plan(bands, targets)).first().spectrum == [1.0, 3.0, None, None]


def test_metrics_without_both_classes(spark):
    df = spark.createDataFrame([("s", 1.0, True), ("s", 2.0, True)], "scene_id string, score double, gt boolean")
    assert metrics.roc_auc(df).first().roc_auc is None and metrics.average_precision(df).first().pr_auc == 1.0


def test_streamed_moments_equal_batch_moments():
    rows = RNG.normal(3, 2, size=(500, 5)) + 1e6
    rows[7, 2] = np.nan
    state = (0, np.zeros(5), np.zeros((5, 5)))
    for k in range(0, 500, 37):
        state = streams.merged(state, rows[k : k + 37])
    good = rows[~np.isnan(rows).any(1)]
    assert state[0] == 499 and np.allclose(state[1], good.mean(0), rtol=1e-12) and np.allclose(state[2] / 498, np.cov(good.T), rtol=1e-7)
    assert streams.rolling_epochs([1, 2, 3], 4, 3) == [2, 3, 4]


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in ("region", "nation", "part", "supplier", "customer", "orders", "lineitem", "events", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = plans.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    done = duck.execute(plans.SQL[name])
    names = [x[0] for x in done.description]
    order = [names.index(c) for c in cols]
    tidy = lambda row: repr(tuple(round(float(x), 6) if isinstance(x, float) else x for x in row))
    want = sorted(tidy([row[k] for k in order]) for row in done.fetchall())
    got = sorted(tidy(row) for row in df.select(*cols).collect())
    assert got and got == want
