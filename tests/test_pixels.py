import struct
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framesift import params as P
from framesift.functions import kernels, lens, pixels, resample, segment
from framesift.operators import masks, metrics, quality

RGB = "clip_id long, frame_index long, width int, height int, rgb binary"


def rgb_rows(spark, images):
    return spark.createDataFrame(
        [(0, i, a.shape[1], a.shape[0], a.astype(np.uint8).tobytes()) for i, a in enumerate(images)], RGB)


def landscape(w=64, h=64):
    """Bright blue over dark ground."""
    out = np.empty((h, w, 3), np.uint8)
    out[: h // 2] = (150, 180, 230)
    out[h // 2:] = (60, 70, 40)
    return out


def checkerboard(w, h):
    y, x = np.mgrid[:h, :w]
    v = np.where((x // 3 + y // 3) % 2 == 0, 230, 25).astype(np.uint8)
    return np.repeat(v[..., None], 3, 2)


# --- gray and metrics ---

def test_luma_weights():
    rgb = np.array([[[255, 255, 255], [1, 2, 3], [255, 0, 0]]], np.uint8)
    assert kernels.luma(rgb).tolist() == [[255, (77 + 300 + 87) >> 8, (77 * 255) >> 8]]


def slow_laplacian(g, valid):
    h, w = g.shape
    found = []
    for y in range(1, h - 1):
        for x in range(1, w - 1):
            around = [(y, x), (y, x - 1), (y, x + 1), (y - 1, x), (y + 1, x)]
            if valid is not None and not all(valid[p] for p in around):
                continue
            found.append(sum(int(g[p]) for p in around[1:]) - 4 * int(g[y, x]))
    if not found:
        return 0.0
    n = float(len(found))
    mean = sum(found) / n
    return sum(v * v for v in found) / n - mean * mean


@pytest.mark.parametrize("masked", [False, True])
def test_laplacian_against_the_plain_loop(masked):
    rng = np.random.default_rng(1)
    g = rng.integers(0, 256, (5, 7, 9), dtype=np.uint8)
    valid = (rng.random((5, 7, 9)) < 0.9).astype(np.uint8) * 255 if masked else None
    if masked:
        valid[4] = 0
    got = kernels.laplacian_variance(g, valid)
    want = [slow_laplacian(g[i], None if valid is None else valid[i]) for i in range(5)]
    assert got.tolist() == want
    assert kernels.laplacian_variance(g[:, :2], None).tolist() == [0.0] * 5


def test_mean_abs_diff_with_and_without_masks(spark):
    rows = [(bytes(16), bytes([255] * 16), None, None), (bytes(16), bytes([255] * 16), bytes(16), None),
            (bytes(16), bytes([255] * 8), None, None), (bytes(4), bytes([51] * 4), None, bytes([255, 0, 0, 0])),
            (b"", b"", None, None), (None, bytes(4), None, None)]
    df = spark.createDataFrame(rows, "a binary, b binary, p binary, q binary")
    got = [r[0] for r in df.coalesce(1).select(pixels.mean_abs_diff("a", "b", "p", "q")).collect()]
    assert got == [1.0, 0.0, 1.0, 0.2, 0.0, None]


def test_a_frame_of_the_wrong_length_is_an_error(spark):
    df = spark.createDataFrame([(bytes(15), 4, 4)], "gray binary, width int, height int")
    with pytest.raises(Exception, match="16 bytes expected"):
        df.select(pixels.laplacian_variance("gray", "width", "height")).collect()


def test_sharpness_depends_on_the_output_size(spark):
    src = rgb_rows(spark, [checkerboard(1920, 1440)])
    found = []
    for w, h in ((1280, 960), (960, 720)):
        out = src.withColumn("rgb", pixels.resize_rgb("rgb", "width", "height", F.lit(w), F.lit(h)))
        out = out.withColumn("width", F.lit(w)).withColumn("height", F.lit(h))
        row = metrics.judge_frames(out).first()
        assert (row.width, row.height, len(row.gray)) == (480, 360, 480 * 360)
        found.append((row.gray, row.sharpness))
    assert found[0][0] != found[1][0] and found[0][1] != found[1][1]


def test_metrics_are_sql_functions(spark):
    pixels.register(spark)
    spark.createDataFrame([(bytes(range(16)), 4, 4)], "g binary, w int, h int").createOrReplaceTempView("one")
    row = spark.sql("select laplacian_variance(g, w, h) s, hex(nn_scale(g, w, h, 2, 2)) n, "
                    "valid_fraction(g) v from one").first()
    assert (row.s, row.n, row.v) == (0.0, "0002080A", 15 / 16)


def test_previous_frame_is_the_one_numbered_one_less(spark):
    f = spark.createDataFrame([(0, i, bytes([i * 10])) for i in (0, 1, 3, 4, 5)],
                              "clip_id long, frame_index long, gray binary")
    def first_bytes(a, b):
        return pa.array([float(x.as_py()[0] * 100 + y.as_py()[0]) for x, y in zip(a, b)], pa.float64())
    got = {r.frame_index: r.both for r in metrics.frame_pairs(f, "gray", "both", first_bytes, 2).collect()}
    assert got == {1: 1000.0, 4: 4030.0, 5: 5040.0}
    gone = f.withColumn("gray", F.when(F.col("frame_index") != 3, F.col("gray")))
    got = {r.frame_index: r.both for r in metrics.frame_pairs(gone, "gray", "both", first_bytes, 100).collect()}
    assert got == {1: 1000.0, 5: 5040.0}


def test_pairs_of_large_frames_hold_one_frame(spark):
    """Frames of a megabyte: no window holds them, whatever their number in a segment."""
    f = spark.range(60).select(F.lit(1).alias("clip_id"), F.col("id").alias("frame_index"),
                               F.repeat(F.chr(F.col("id") % 7 + 65), 1 << 20).cast("binary").alias("gray"))
    pairs = metrics.consecutive_motion(f)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "MapInArrow" in plan
    assert [round(r.motion * 255, 6) for r in pairs.orderBy("frame_index").collect()] == [6.0 if i % 7 == 0 else 1.0 for i in range(1, 60)]
    psnr = [r.psnr_db for r in metrics.frame_pair_psnr(f).orderBy("frame_index").collect()]
    assert psnr[0] == pytest.approx(10 * np.log10(255.0 ** 2))


# --- resampling ---

@pytest.mark.parametrize("name", ["bilinear", "lanczos3"])
def test_resampling_keeps_constants_and_identity(name):
    flat = np.full((1, 9, 7, 3), 77, np.uint8)
    assert (resample.resize(flat, 4, 13, name) == 77).all()
    noise = np.random.default_rng(0).integers(0, 256, (2, 9, 7, 3), dtype=np.uint8)
    assert resample.resize(noise, 7, 9, name) is noise


def test_halving_averages_neighbours():
    ramp = np.arange(0, 160, 10, dtype=np.uint8).reshape(1, 1, 16, 1).repeat(2, 1).repeat(3, 3)
    got = resample.resize(ramp, 8, 1, "bilinear")[0, 0, :, 0]
    assert got.tolist()[1:-1] == [25, 45, 65, 85, 105, 125]


def test_lanczos_is_close_on_smooth_content():
    x = np.linspace(0, 2 * np.pi, 200)
    wave = (127 + 100 * np.sin(x)).astype(np.uint8)[None, None, :, None].repeat(4, 1).repeat(3, 3)
    small = resample.resize(wave, 100, 4, "lanczos3")[0, 0, :, 0].astype(int)
    want = 127 + 100 * np.sin((np.arange(100) + 0.5) * 2 * (2 * np.pi / 199) - np.pi / 199)
    assert np.abs(small - want)[4:-4].max() <= 2


def test_nearest_rounds_down_and_never_blends(spark):
    df = spark.createDataFrame([(bytes([1, 2, 3, 4]), 2, 2)], "m binary, w int, h int")
    row = df.select(pixels.nn_scale("m", "w", "h", F.lit(3), F.lit(4)).alias("o"),
                    pixels.nn_scale("m", "w", "h", F.lit(1), F.lit(1)).alias("s")).first()
    assert list(row.o) == [1, 1, 2, 1, 1, 2, 3, 3, 4, 3, 3, 4] and list(row.s) == [1]


# --- masks ---

def sky(spark, image, **kw):
    f = rgb_rows(spark, [image]).withColumn("gray", pixels.rgb_to_gray("rgb"))
    row = f.select(pixels.sky_mask("rgb", "gray", "width", "height", **kw).alias("m")).first()
    return np.frombuffer(row.m, np.uint8).reshape(image.shape[:2])


def test_sky_stops_at_the_horizon(spark):
    m = sky(spark, landscape(), dilate=0)
    assert m[0, 0] == 0 and m[63, 0] == 255 and 0.45 <= (m != 0).mean() <= 0.55
    assert (sky(spark, landscape(), dilate=2) != 0).mean() < (m != 0).mean()


def test_bright_ground_away_from_the_top_is_kept(spark):
    image = landscape(32, 32)
    image[24:28, 8:16] = (150, 180, 230)
    assert sky(spark, image, dilate=0)[26, 12] == 255


def slow_sky(rgb, gray, luma_min, blue_bias, step):
    h, w = gray.shape
    ok = (gray >= luma_min) & (rgb[..., 2].astype(int) - rgb[..., 0] >= blue_bias)
    seen = {(0, x) for x in range(w) if ok[0, x]}
    todo = list(seen)
    while todo:
        y, x = todo.pop()
        for p in ((y, x - 1), (y, x + 1), (y - 1, x), (y + 1, x)):
            if 0 <= p[0] < h and 0 <= p[1] < w and p not in seen and ok[p] \
                    and abs(int(gray[p]) - int(gray[y, x])) <= step:
                seen.add(p)
                todo.append(p)
    out = np.zeros((h, w), bool)
    for p in seen:
        out[p] = True
    return out


def test_sky_matches_a_plain_flood_fill():
    rng = np.random.default_rng(5)
    rgb = rng.integers(0, 256, (20, 17, 13, 3), dtype=np.uint8)
    gray = kernels.luma(rgb)
    for step in (10, 40, 120):
        got = kernels.sky_from_top(rgb, gray, 70, -120, step)
        for i in range(20):
            assert (got[i] == slow_sky(rgb[i], gray[i], 70, -120, step)).all()


def test_sky_of_other_size_is_all_valid(spark):
    df = spark.createDataFrame([(bytes(12), bytes(9), 3, 3)], "rgb binary, gray binary, w int, h int")
    assert df.select(pixels.sky_mask("rgb", "gray", "w", "h").alias("m")).first().m == b"\xff" * 9


def test_dilation_grows_squares_and_only_grows():
    rng = np.random.default_rng(2)
    m = np.where(rng.random((6, 9, 11)) < 0.05, 0, 255).astype(np.uint8)
    for r in (0, 1, 3, 20):
        got = kernels.grow_invalid(m, r)
        want = m.copy()
        for n, y, x in zip(*np.nonzero(m == 0)):
            want[n, max(0, y - r):y + r + 1, max(0, x - r):x + r + 1] = 0
        assert (got == want).all()


def test_fractions(spark):
    df = spark.createDataFrame([(b"",), (bytes([0, 1, 255, 0]),), (None,)], "m binary").coalesce(1)
    got = df.select(pixels.valid_fraction("m").alias("v"), pixels.masked_fraction("m").alias("o")).collect()
    assert [r.v for r in got] == [1.0, 0.5, None] and [r.o for r in got] == [0.0, 0.5, 0.0]


def label_rows(spark, maps):
    return spark.createDataFrame([(0, i, bytes(m)) for i, m in enumerate(maps)],
                                 "clip_id long, frame_index long, labels binary")


@pytest.mark.parametrize("maps,window,last", [
    ([[2, 2], [2, 9], [2, 2]], 3, [2, 2]), ([[2], [7], [7]], 3, [7]), ([[1, 2, 3]], 1, [1, 2, 3]),
    ([[5], [6]], 4, [5])])
def test_smoothing_vectors(spark, maps, window, last):
    rows = masks.label_smoothing(label_rows(spark, maps), window).orderBy("frame_index").collect()
    assert len(rows) == len(maps) and list(rows[-1].labels) == last
    assert masks.odd_window(4) == 5 and masks.odd_window(0) == 1


def slow_mode(maps, i, p, window):
    seen = [m[p] for m in maps[max(0, i - window + 1):i + 1]]
    return max(dict.fromkeys(seen), key=lambda v: (seen.count(v), -seen.index(v)))


@pytest.mark.parametrize("window,labels", [(3, 2), (31, 4), (31, 200), (5, 3)])
def test_smoothing_by_brute_force(window, labels):
    """Ties go to the label that was seen first in the window."""
    rng = np.random.default_rng(window * labels)
    maps = rng.integers(0, labels, (90, 9)).astype(np.int16)
    history = np.concatenate([np.full((window - 1, 9), -1, np.int16), maps])
    got = kernels.trailing_mode(history, window)
    assert got.tolist() == [[slow_mode(maps, i, p, window) for p in range(9)] for i in range(90)]


def test_smoothing_costs_the_same_for_any_window():
    rng = np.random.default_rng(0)
    maps = np.repeat(rng.integers(0, 5, (64, 20000)), 4, axis=0).astype(np.int16)

    def seconds(window):
        history = np.concatenate([np.full((window - 1, maps.shape[1]), -1, np.int16), maps])
        found = []
        for _ in range(3):
            began = time.process_time()
            kernels.trailing_mode(history, window)
            found.append(time.process_time() - began)
        return min(found)
    seconds(5)
    assert seconds(31) < 2.5 * seconds(5)


def test_clips_of_different_sizes_are_smoothed_together(spark):
    rng = np.random.default_rng(1)
    clips = {c: rng.integers(0, 3, (12, 4 if c % 2 else 9)).tolist() for c in range(5)}
    rows = [(c, i, bytes(m)) for c, maps in clips.items() for i, m in enumerate(maps)]
    f = spark.createDataFrame(rows, "clip_id long, frame_index long, labels binary").coalesce(1)
    got = {(r.clip_id, r.frame_index): list(r.labels) for r in masks.label_smoothing(f, 3).collect()}
    assert got == {(c, i): [slow_mode(maps, i, p, 3) for p in range(len(maps[0]))] for c, maps in clips.items() for i in range(12)}


def test_smoothing_across_segments_is_the_same(spark):
    rng = np.random.default_rng(9)
    maps = rng.integers(0, 3, (50, 6)).tolist()
    f = label_rows(spark, maps).repartition(3)
    whole = {r.frame_index: r.labels for r in masks.label_smoothing(f, 5).collect()}
    cut = {r.frame_index: r.labels for r in masks.label_smoothing(f, 5, 7).collect()}
    assert whole == cut and len(cut) == 50


def test_sky_alone_writes_no_training_set(spark):
    row = metrics.judge_frames(rgb_rows(spark, [landscape(16, 16)]), heuristic_sky={}).first()
    assert row.valid is not None and row.training is None
    plain = metrics.judge_frames(rgb_rows(spark, [landscape(16, 16)])).first()
    assert plain.valid is None and plain.sharpness > row.sharpness


def test_intersection_lies_within_each_layer(spark):
    f = label_rows(spark, [[2, 3, 0, 2]])
    sets = {r.sidecar: list(r.mask) for r in masks.mask_intersect(
        f, {"sky": pixels.label_to_mask("labels", 2), "people": pixels.label_to_mask("labels", 3)}).collect()}
    assert sets == {"sfm": [0, 0, 255, 0], "training": [255, 0, 255, 255]}
    only_sky = masks.mask_intersect(f, {"sky": pixels.label_to_mask("labels", 2)}).collect()
    assert [r.sidecar for r in only_sky] == ["sfm"]


def test_first_maximum_wins_and_nan_never():
    logits = np.array([[1.0, np.nan, np.nan], [1.0, -5.0, np.nan], [0.0, -5.0, np.nan]], np.float32)
    assert kernels.first_max(logits).tolist() == [0, 1, 0]


# --- lens ---

CAMERA = (1454.64, 1457.5, 3840, 2880, 1.0, 1.0)
COEFFS = (0.18767, -0.04236, 0.19785, -0.1432)


def test_the_centre_stays_and_rays_are_radial():
    u, v, ok = lens.source_positions(CAMERA, COEFFS, (3840, 2880), (1920, 1440))
    assert ok[720, 960]
    assert abs(u[719:721, 959:961].mean() - 1919.5) < 1e-6 and abs(v[719:721, 959:961].mean() - 1439.5) < 1e-6
    # Left and right, top and bottom mirror each other.
    assert np.allclose(u + u[:, ::-1], 3839) and np.allclose(v + v[::-1], 2879)


def test_a_narrow_lens_without_distortion_is_the_identity():
    camera = (1e6, 1e6, 64, 48, 1.0, 1.0)
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (48, 64, 3), dtype=np.uint8)
    for kernel in lens.KERNELS:
        out = lens.undistort(image, lens.sampling_map(camera, (0.0,) * 4, (64, 48), (64, 48), kernel))
        assert (out.reshape(48, 64, 3) == image).all(), kernel


def test_filters_agree_on_geometry_and_differ_in_sharpness():
    y, x = np.mgrid[:288, :384]
    image = (127 + 60 * np.sin(x / 9) + 60 * np.cos(y / 7)).clip(0, 255).astype(np.uint8)[..., None].repeat(3, 2)
    noise = np.random.default_rng(0).integers(0, 256, (288, 384, 3), dtype=np.uint8)
    out, rough = {}, {}
    for k in lens.KERNELS:
        m = lens.sampling_map((145.4, 145.7, 384, 288, 1.0, 1.0), COEFFS, (384, 288), (192, 144), k)
        out[k] = lens.undistort(image, m).reshape(144, 192, 3)[..., 0].astype(float)
        rough[k] = kernels.laplacian_variance(
            lens.undistort(noise, m).reshape(1, 144, 192, 3)[..., 0], None)[0]
    for k in ("bicubic", "lanczos4"):
        assert np.abs(out[k] - out["bilinear"]).mean() < 2
        # The centre of mass of the difference is not displaced along either gradient.
        here, there = out[k][40:104, 60:124], out["bilinear"][40:104, 60:124]
        for axis in (0, 1):
            slope = np.gradient(there, axis=axis)
            assert abs(((here - there) * slope).sum() / (slope * slope).sum()) < 0.15
        assert rough["bilinear"] < 0.9 * rough[k]


def test_undistortion_on_frames(spark):
    f = rgb_rows(spark, [np.full((48, 64, 3), 90, np.uint8)])
    args = [F.lit(v) for v in (32, 24, 24.2, 24.3, 64, 48, 1.0, 1.0)]
    coeffs = F.array(*[F.lit(c) for c in COEFFS])
    out = f.select(lens.undistort_frames("rgb", "width", "height", *args, coeffs).alias("o")).first().o
    values = set(out)
    assert len(out) == 32 * 24 * 3 and values <= {0, 90} and 90 in values
    with pytest.raises(ValueError, match="unknown interpolation"):
        lens.undistort_frames("rgb", "width", "height", *args, coeffs, "nearest")


# --- registration ---

def test_a_known_field_is_summed_up(spark):
    rows = [(1, 200, 100, float(x), float(y), 0.01 * (x - 100) + 0.3, 0.01 * (y - 50), s)
            for x in (20, 100, 180) for y in (10, 50, 90) for s in ("ok",)]
    rows += [(1, 200, 100, 0.0, 0.0, 9.0, 9.0, "spurious"), (2, 200, 100, 0.0, 0.0, 0.0, 0.0, "low texture")]
    df = spark.createDataFrame(rows, "pair_id long, width int, height int, cx double, cy double, dx double, dy double, status string")
    got = {r.pair_id: r for r in quality.registration_summary(df).collect()}
    sizes = sorted((r[5] ** 2 + r[6] ** 2) ** 0.5 for r in rows[:9])
    assert got[1].patches == 9 and got[1].spurious == 1
    assert abs(got[1].median - sizes[4]) < 1e-9 and abs(got[1].max - sizes[-1]) < 1e-9
    assert abs(got[1].corner_px - 0.01 * (100 ** 2 + 50 ** 2) ** 0.5) < 1e-9
    assert (got[2].patches, got[2].low_texture) == (0, 1) and got[2].median == float("inf")


# --- segmentation ---

def _varint(n):
    out = b""
    while True:
        out, n = out + bytes([(n & 127) | (128 if n > 127 else 0)]), n >> 7
        if not n:
            return out


def _field(number, value):
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _tensor(name, shape):
    dims = b"".join(_field(1, _field(1, d)) for d in shape)
    return _field(1, name) + _field(2, _field(1, _field(1, 1) + _field(2, dims)))


def onnx(op, out_shape, **ints):
    attrs = b"".join(_field(5, _field(1, k) + b"".join(_field(8, v) for v in vs) + _field(20, 7))
                     for k, vs in ints.items())
    node = _field(1, "x") + _field(2, "y") + _field(4, op) + attrs
    graph = (_field(1, node) + _field(2, "g") + _field(11, _tensor("x", (1, 3, 64, 64)))
             + _field(12, _tensor("y", out_shape)))
    return _field(1, 8) + _field(8, _field(1, "") + _field(2, 13)) + _field(7, graph)


@pytest.fixture
def saved(tmp_path):
    pytest.importorskip("onnxruntime")

    def save(op, out_shape, **ints):
        path = tmp_path / f"{op}.onnx"
        path.write_bytes(onnx(op, out_shape, **ints))
        return segment.OnnxModel(str(path))
    return save


def sky_over_green(n=64):
    out = np.zeros((n, n, 3), np.uint8)
    out[: n // 2, :, 2] = 255
    out[n // 2:, :, 1] = 255
    return out


@pytest.mark.parametrize("op,shape,ints", [
    ("Identity", (1, 3, 64, 64), {}),
    ("MaxPool", (1, 3, 32, 32), {"kernel_shape": [2, 2], "strides": [2, 2]})])
def test_channels_become_classes(spark, saved, op, shape, ints):
    model = saved(op, shape, **ints)
    info = segment.inspect_model(model, 640, 480, (2, 1))
    assert (info.size, info.classes, info.offset) == ((64, 64), 3, 0)
    f = rgb_rows(spark, [sky_over_green(), sky_over_green(128)])
    labels = f.withColumn("labels", segment.segment_frames("rgb", "width", "height", model, info))
    for r in labels.collect():
        assert len(r.labels) == 64 * 64 and r.labels[0] == 2 and r.labels[63 * 64] == 1
    m = labels.select(pixels.valid_fraction(pixels.label_to_mask("labels", 2)).alias("v")).first()
    assert abs(m.v - 0.5) < 0.02


def test_wrong_models_are_refused_before_the_job(saved):
    with pytest.raises(ValueError, match="3 classes"):
        segment.inspect_model(saved("Identity", (1, 3, 64, 64)), 64, 64, (99,))

    def emits(*shape):
        return lambda: lambda batch: np.zeros(shape, np.float32)
    with pytest.raises(ValueError, match="not 1 x classes"):
        segment.inspect_model(emits(1, 3), 64, 64)
    with pytest.raises(ValueError, match="at most 256"):
        segment.inspect_model(emits(1, 300, 2, 2), 64, 64)
    assert segment.inspect_model(emits(1, 151, 2, 2), 64, 64, (2, 12)).offset == 1
    with pytest.raises(ValueError, match="class 151 is outside"):
        segment.inspect_model(emits(1, 151, 2, 2), 64, 64, (150,))


def test_png_starts_like_one():
    from framesift.functions import png
    body = png.encode(np.zeros((2, 3, 3), np.uint8))
    assert body[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", body[16:24]) == (3, 2)
    assert P.SKY_DILATE == 3
