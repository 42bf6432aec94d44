"""Estimators, made scenes, registration, strips and whole runs, against plain numpy and by what they promise."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismal import pipeline, schema
from prismal.operators import archive, detectors, evaluation, harmonize, models, registration, synthesis
from prismal.sources import scenes
from prismal.streaming import strips

RNG = np.random.default_rng(11)


def table(spark, cube, scene="s"):
    h, w = cube.shape[:2]
    rows = [(scene, int(r * w + c), int(r), int(c), None if np.isnan(cube[r, c]).any() else [float(v) for v in np.atleast_1d(cube[r, c])]) for r in range(h) for c in range(w)]
    return spark.createDataFrame(rows, schema.PIXELS)


def area(score, y):
    a, b = score[y == 1], score[y == 0]
    return ((a[:, None] > b).mean() + 0.5 * (a[:, None] == b).mean())


X = np.vstack([RNG.normal(size=(120, 4)), RNG.normal(size=(20, 4)) + 4])
Y = np.r_[np.zeros(120), np.ones(20)].astype(int)


@pytest.mark.parametrize("arm", [models.AutoencoderArm(), models.OneClassArm(), models.TwoClassArm(), models.StateKernelArm(angle_scale=0.1)])
def test_arms_tell_a_cluster_apart(arm):
    assert area(arm.fit(X, Y).score(X), Y) > 0.9
    with pytest.raises(ValueError):
        arm.fit(X[:5], np.ones(5) if arm.supervision == "background" else np.zeros(5))


def test_one_class_leaves_nu_outside():
    arm = models.OneClassArm(nu=0.2).fit(X, Y)
    outside = (arm.score(X[Y == 0]) > 1e-4).mean()
    assert outside <= 0.2 + 0.02 and (arm.a > 1e-9).mean() >= 0.2 - 0.02 and abs(arm.a.sum() - 1) < 1e-9


def test_states_against_matrices():
    """Two features: the same circuit as explicit 4 x 4 matrices."""
    h = np.array([[1, 1], [1, -1]]) / np.sqrt(2)
    for x in RNG.uniform(0, np.pi, size=(5, 2)):
        pair = (np.pi - x[0]) * (np.pi - x[1])
        phases = np.exp(2j * np.array([0, x[0] + pair, x[1] + pair, x[0] + x[1]]))  # the first feature is the lowest bit
        state = np.array([1, 0, 0, 0], complex)
        for _ in range(2):
            state = phases * (np.kron(h, h) @ state)
        assert np.allclose(models.phase_states(x)[0], state)
    gram = models.fidelity(X[:9, :3], X[:9, :3])
    assert np.allclose(gram, gram.T) and np.allclose(np.diag(gram), 1) and gram.min() >= 0


def test_kernel_axes_give_the_centred_kernel():
    found = models.KernelAxes(139).fit(X).transform(X)
    k = models.rbf(X, X, models.scale_gamma(X))
    assert np.allclose(found @ found.T, k - k.mean(0) - k.mean(1)[:, None] + k.mean(), atol=1e-6)


def test_axes_fitted_on_others(spark):
    cube = RNG.normal(size=(10, 8, 5)) @ RNG.normal(size=(5, 5))
    px = table(spark, cube)
    axes = models.fitted_axes(px.where("r < 5"), 2)
    rows = cube[:5].reshape(-1, 5)
    vectors = np.linalg.eigh(np.cov(rows.T, ddof=0))[1][:, ::-1][:, :2]
    vectors *= np.sign(vectors[np.abs(vectors).argmax(0), [0, 1]])
    want = (cube.reshape(-1, 5) - rows.mean(0)) @ vectors
    got = np.array([r.spectrum for r in models.reduced(px, axes, fitted_on="s").orderBy("pix").collect()])
    assert np.allclose(got, want)


def test_fit_is_bounded(spark):
    big = spark.range(models.MOST_ROWS + 1).select(F.array(F.col("id").cast("double")).alias("features"), F.lit(False).alias("gt"))
    with pytest.raises(ValueError):
        models.fitted(models.OneClassArm(), big)


def test_blobs_and_what_they_change(spark):
    placed = synthesis.blobs(spark, 16, 16, 5, sizes=(3, 20), seed=4, scene_id="s")
    rows = placed.collect()
    places = [(r.r, r.c) for r in rows]
    assert len(places) == len(set(places)) and all(0 <= r < 16 and 0 <= c < 16 for r, c in places)
    for target in {r.target for r in rows}:
        left = {(r.r, r.c) for r in rows if r.target == target}
        todo = [left.pop()]
        while todo:
            r, c = todo.pop()
            for p in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if p in left:
                    left.remove(p)
                    todo.append(p)
        assert not left, "a blob is connected"
    cube = RNG.normal(size=(16, 16, 6))
    px = table(spark, cube)
    for kind in (*synthesis.PERTURBATIONS, "mixed"):
        out = synthesis.perturbed(px, placed, kind=kind, seed=2).collect()
        assert {(r.r, r.c) for r in out if r.m} == set(places)
        changed = {(r.r, r.c) for r in out if not np.allclose(r.spectrum, cube[r.r, r.c])}
        assert changed <= set(places) and len(changed) >= len(places) - 1, kind
        again = {r.pix: r.spectrum for r in synthesis.perturbed(px.repartition(5), placed, kind=kind, seed=2).collect()}
        assert all(np.allclose(again[r.pix], r.spectrum) for r in out) and len(again) == len(out)
    with pytest.raises(Exception):
        synthesis.implanted(px, placed, spark.createDataFrame([(0, [1.0])], "spectrum_id int, target_spectrum array<double>")).collect()




def test_shift_below_a_pixel(spark):
    freq = np.meshgrid(np.fft.fftfreq(32), np.fft.fftfreq(40), indexing="ij")
    base = np.fft.ifft2(np.fft.fft2(RNG.normal(size=(32, 40))) * np.exp(-40 * (freq[0] ** 2 + freq[1] ** 2))).real
    shifted = np.fft.ifft2(np.fft.fft2(base) * np.exp(-2j * np.pi * (0.6 * freq[0] - 1.25 * freq[1]))).real
    assert registration.shift_of(base, shifted) == pytest.approx((-0.6, 1.25), abs=0.06)
    cube, report = registration.coregistered(table(spark, base[..., None]), table(spark, shifted[..., None]))
    found = report.first()
    assert (found.dr, found.dc) == pytest.approx((-0.6, 1.25), abs=0.06) and found.rmse < 0.5
    near = [abs(r.spectrum[0] - base[r.r, r.c]) for r in cube.collect() if r.spectrum is not None]
    assert len(near) > 32 * 40 * 0.8 and np.median(near) < 0.3 * base.std()


def test_strip_pipeline_equals_the_whole(spark):
    cube = RNG.normal(size=(40, 7, 3))

    def blurred(x):
        pad = np.pad(x, ((2, 2), (0, 0), (0, 0)), mode="edge")
        return sum(pad[k : k + len(x)] for k in range(5)) / 5

    px = table(spark, cube)
    run = lambda rows: {r.pix: r.spectrum for r in strips.StripPipeline().register("blur", blurred, lookahead=2).register("twice", lambda x: x * 2).run(px, rows=rows).collect()}
    whole = 2 * blurred(cube)
    for rows in (7, 16, 64):
        got = run(rows)
        assert all(np.allclose(got[r * 7 + c], whole[r, c]) for r in range(40) for c in range(7)), rows
    with pytest.raises(ValueError):
        strips.StripPipeline().register("x", lambda x: x, lookahead=-1)
    with pytest.raises(MemoryError):
        strips.StripPipeline(most_rows=10).run(px, rows=11)
    with pytest.raises(Exception, match="returned"):
        strips.StripPipeline().register("short", lambda x: x[:-1]).run(px).collect()


def test_streamed_rx_needs_two_pixels(spark):
    one = table(spark, np.ones((1, 1, 3)))
    with pytest.raises(Exception, match="fewer than two"):
        strips.streaming_rx(spark, strips.laid_out(one, 1)).collect()


def test_names_that_must_raise(spark):
    row = spark.range(1)
    for bad in (archive.flightline(F.lit("ang2017_1")), archive.loader_of(F.lit("x.png")), archive.resolved_time(F.lit(None).cast("string"), F.lit("May 1"), F.current_timestamp()), archive.ascending(F.array(F.lit(1.0), F.lit(1.0)))):
        with pytest.raises(Exception):
            row.select(bad).collect()
    with pytest.raises(ValueError):
        scenes.window(row, 0, 0, 5, 5, shape=(4, 9))
    with pytest.raises(TypeError):
        scenes.as_floats(spark.sql("SELECT 'a' AS v"), "v")
    with pytest.raises(Exception, match="no band near"):
        harmonize.selected_bands(scenes.bands(spark), spark.createDataFrame([("far", 9000.0)], "name string, target double")).collect()


def test_run_from_pixels_to_files(spark, tmp_path):
    cube = RNG.normal(size=(24, 24, 6))
    cube[5:8, 9:12] += 12
    said = []
    out = pipeline.run(table(spark, cube), pct=98.0, transform={"a": 10.0, "b": 0.0, "c": 400000.0, "d": 0.0, "e": -10.0, "f": 4000000.0}, zone=16, acquired="2020-05-01T10:00:00Z", out=str(tmp_path), progress=lambda k, name: said.append((k, name)))
    rois = out["rois"].collect()
    assert [(r.r0, r.c0, r.r1, r.c1) for r in rois] == [(5, 9, 8, 12)] and rois[0].timestamp == "2020-05-01T10:00:00Z"
    assert rois[0].area == pytest.approx(500, rel=0.01) and rois[0].perimeter == pytest.approx(120, rel=0.01)
    assert schema.feature_violations(out["features"]).count() == 0 and schema.score_violations(out["scores"], out["tags"]).count() == 0
    text = spark.read.text(f"{tmp_path}/features").first()[0]
    assert json.loads(text)["properties"]["class"] == "UNKNOWN" and [k for k, _ in said] == [1, 2, 3, 4]
    assert spark.read.json(f"{tmp_path}/manifest").first().n_rois == 1 and spark.read.parquet(f"{tmp_path}/mask").where("m = 1").count() == 5  # the opening takes the corners of the square
    with pytest.raises(KeyError):
        pipeline.run(table(spark, cube), normalizer="none")
    with pytest.raises(ValueError):
        pipeline.detect("streaming_rx", table(spark, cube))


def test_a_detector_that_fails_is_a_row(spark):
    cube = RNG.normal(size=(9, 9, 4))
    cube[4, 4] += 9
    px = table(spark, cube)
    rows = {r.detector: r for r in pipeline.benchmark(px, px.select("scene_id", "pix", (F.col("pix") == 40).alias("gt")), ["global_rx", "local_rx"], {"local_rx": {"inner": 4}}).collect()}
    assert rows["global_rx"].status == "ok" and rows["global_rx"].roc_auc == 1.0 and rows["local_rx"].status == "FAILED:ValueError"


def test_fused_takes_local_rx(spark):
    from prismal.operators import scoring, windows2d

    cube = RNG.normal(size=(12, 12, 4))
    px = table(spark, cube)
    local = {"inner": 3, "outer": 7, "components": 4}
    base = detectors.global_rx(px)
    parts = {
        "rx": {r.pix: r.score for r in detectors.local_rx(px, **local).collect()},
        "ace": {r.pix: r.score for r in detectors.ace(px, scoring.target_signature(px, base)).collect()},
        "spatial": {r.pix: r.context for r in windows2d.spatial_context(base).collect()},
    }
    want = np.zeros(144)
    for name, weight in (("rx", 0.4), ("ace", 0.25), ("spatial", 0.2)):
        v = np.array([parts[name][k] for k in range(144)])
        ranks = np.array([(v < x).sum() + ((v == x).sum() - 1) / 2 for x in v]) / 143
        want += ranks * weight / 0.85
    got = {r.pix: r.score for r in detectors.fused(px, local=local).collect()}
    assert [got[k] for k in range(144)] == pytest.approx(list(want), abs=1e-9)


def test_hulls_by_brute_force(spark):
    from prismal.operators.regions import hull_pixels

    for _ in range(10):
        pixels = np.unique(RNG.integers(0, 7, size=(6, 2)), axis=0)
        points = np.array([(2 * c + i, 2 * r + j) for r, c in pixels for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))])
        inside = 0
        for r in range(pixels[:, 0].min(), pixels[:, 0].max() + 1):
            for c in range(pixels[:, 1].min(), pixels[:, 1].max() + 1):
                gap = points - (2 * c, 2 * r)
                turn = np.sort(np.arctan2(gap[:, 1], gap[:, 0]))
                zero = (gap == 0).all(1).any()
                widest = max(np.diff(np.r_[turn, turn[0] + 2 * np.pi]))
                inside += bool(zero or widest <= np.pi + 1e-9)  # else a line parts it from all points
        assert hull_pixels(pixels[:, 0], pixels[:, 1]) == inside


def test_sample_weights_restore_the_prevalence(spark):
    px = spark.range(1000).select(F.lit("s").alias("scene_id"), F.col("id").alias("pix"), (F.col("id") % 50 == 0).alias("gt"))
    got = evaluation.natural_sample(px, 70).collect()
    assert sum(r.gt for r in got) == 20 and len(got) == 90 and sum(r.weight for r in got if not r.gt) == pytest.approx(980)


def test_patches_that_must_raise(spark):
    from prismal.operators import patches

    with pytest.raises(ValueError):
        patches.held_out("abu", "train", wavelengths=True)
    with pytest.raises(ValueError):
        patches.held_out("abu", "eval", wavelengths=False)
    patches.held_out("had100", "eval", wavelengths=True)
    with pytest.raises(Exception, match="different bands"):
        patches.pooled(table(spark, np.ones((2, 2, 3))), table(spark, np.ones((2, 2, 4)))).collect()
    assert patches.scan_windows(9, 8, 8) == [(0, 0, 0)] and patches.scan_windows(10, 8, 8) == [(0, 0, 0), (1, 8, 0)]


def test_a_chunk_at_a_time(spark, monkeypatch):
    from prismal.operators import moments

    px = table(spark, RNG.normal(size=(12, 12, 4)))
    whole = {r.pix: r.score for r in detectors.global_rx(px).collect()}
    monkeypatch.setattr(moments, "CHUNK", 20)
    assert {r.pix: r.score for r in detectors.global_rx(px).collect()} == pytest.approx(whole)
