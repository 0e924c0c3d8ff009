import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesift.functions import geometry as G
from framesift.functions.text import extension, file_stem, image_name, plain_number, terms
from framesift.operators import audits, records, resume, selection
from framesift.sources import clips as clip_source
from framesift.sources import images
from framesift.sources import manifest as M
from framesift.sources import profiles as profile_source

FRAMES = "clip_id long, stem string, frame_index long, width int, height int, rgb binary"


@pytest.fixture
def frames(spark):
    rng = np.random.default_rng(0)
    rows = [(c, f"c.{c}", i, 5, 4, rng.integers(0, 256, 60, dtype=np.uint8).tobytes())
            for c in (1, 2) for i in (0, 7, 1234567)]
    return spark.createDataFrame(rows, FRAMES)


# --- images ---

def test_images_round_trip(spark, frames, tmp_path):
    images.write_images(frames, str(tmp_path / "out"))
    names = sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.endswith(".crc"))
    assert names == sorted(f"c.{c}_{i}.png" for c in (1, 2) for i in ("000000", "000007", "1234567"))
    back = {(r.stem, r.frame_index): (r.width, r.height, r.rgb)
            for r in images.read_image_frames(spark, str(tmp_path / "out")).collect()}
    assert back == {(r.stem, r.frame_index): (r.width, r.height, r.rgb) for r in frames.collect()}


def test_writing_twice_leaves_the_same_files(spark, frames, tmp_path):
    for _ in range(2):
        images.write_images(frames, str(tmp_path / "out"))
    assert images.read_image_frames(spark, str(tmp_path / "out")).count() == 6


def test_masks_round_trip_beside_their_images(spark, frames, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(r.stem, r.frame_index, s, 5, 4, (rng.random(20) < 0.5).astype(np.uint8).tobytes())
            for r in frames.collect() for s in ("sfm", "training")]
    m = spark.createDataFrame(
        rows, "stem string, frame_index long, sidecar string, width int, height int, mask binary")
    images.write_masks(m, str(tmp_path), "jpg")
    assert (tmp_path / "masks" / "c.1_000007.jpg.png").is_file()
    back = {(r.stem, r.frame_index): r.mask for r in images.read_masks(spark, str(tmp_path / "masks_train")).collect()}
    assert back == {(r[0], r[1]): r[5] for r in rows if r[2] == "training"}


def test_write_errors_surface(spark, frames, tmp_path):
    with pytest.raises(Exception, match="do not fill"):
        images.write_images(frames.withColumn("width", F.lit(6)), str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="unknown image format"):
        images.write_images(frames, str(tmp_path), "bmp")
    if images._pillow() is None:
        with pytest.raises(RuntimeError, match="Pillow"):
            images.write_images(frames, str(tmp_path), "jpg")


def test_a_clip_without_frames_is_an_error(spark, frames):
    clips = spark.createDataFrame([("c.1",), ("c.9",)], "stem string")
    with pytest.raises(ValueError, match="c.9: no frames"):
        images.require_frames(frames, clips)


KEPT_INDEXES = [0, 1, 7, 8, 511, 512, 32766, 32767, 32768, 65535, 65536, 100000]


def kept_case(spark):
    rows = [(s, i) for s in ("a", "b") for i in KEPT_INDEXES]
    f = spark.createDataFrame(rows, "stem string, frame_index long").repartition(3)
    want = sorted(r for n, r in enumerate(rows) if n % 3 == 0)
    return f, f.withColumn("keep", F.concat("stem", "frame_index").isin([f"{s}{i}" for s, i in want])), want


@pytest.mark.parametrize("limit", [1 << 28, 0])
def test_kept_frames_by_broadcast_and_by_store(spark, limit):
    f, d, want = kept_case(spark)
    assert sorted(tuple(r) for r in images.kept_only(f, d, "stem", limit).collect()) == want
    assert images.kept_only(f, d.withColumn("keep", F.lit(False)), "stem", limit).count() == 0


def test_stored_frames_are_never_exchanged(spark, tmp_path):
    f, d, want = kept_case(spark)
    f = f.withColumn("rgb", F.lit(b"x" * 99))
    images.FrameStore.write(f, str(tmp_path / "store"), "stem", 5)
    for store in (images.FrameStore.open(spark, str(tmp_path / "store")), images.FrameStore.open(spark.newSession(), str(tmp_path / "store"))):
        d = spark.createDataFrame([(*r, True) for r in want], "stem string, frame_index long, keep boolean")
        kept = store.kept(d) if store.spark is spark else store.kept(store.spark.createDataFrame(
            [(*r, True) for r in want], "stem string, frame_index long, keep boolean"))
        assert kept.columns == ["stem", "frame_index", "rgb"]
        assert sorted((r.stem, r.frame_index) for r in kept.collect()) == want
        plan = kept._jdf.queryExecution().sparkPlan().toString() + kept._jdf.queryExecution().executedPlan().toString()
        final = plan.split("== Initial Plan ==")[-1]
        # The only exchange is that of the bitmaps.
        assert "Bucketed: true" in final and final.count("Exchange hashpartitioning") == 1 and "SelectedBucketsCount: 5 out of 5" in final
        assert store.frames().count() == f.count()
        assert store.kept(d.sparkSession.createDataFrame([], d.schema) if store.spark is spark else kept.limit(0).withColumn("keep", F.lit(True))).count() == 0


def test_frames_table_is_clustered(spark, frames, tmp_path):
    path = str(tmp_path / "table")
    images.frames_to_table(frames, path)
    assert spark.read.parquet(path).filter("clip_id = 2 and frame_index = 7").count() == 1


# --- manifests ---

def older_manifest(clips):
    """A document without the fields that came later: completed, gpu, masking and kept lists."""
    listed = [dict(path=f"/footage/day{i}/GX{i:04d}.mp4", stem=f"GX{i:04d}", width=2704, height=2028, fps=59.94,
                   frames_probed=600 + i, frames_decoded=597 + i, frames_kept=40 + i, out_width=1352, out_height=1014,
                   pinhole_intrinsics=None) for i in range(clips)]
    chosen = dict(mode=dict(mode="every-nth", n=15), blur_floor=55.5)
    return dict(tool="framesift", tool_version="0.3.2", ffmpeg_version="6.1", created_unix=1700000000, profile=None,
                params=dict(output_size=dict(kind="scale", factor=0.5), format=dict(format="png"), selection=chosen,
                            hwaccel="none", interpolation="bicubic"),
                clips=listed,
                totals=dict(decoded=sum(c["frames_decoded"] for c in listed), kept=sum(c["frames_kept"] for c in listed),
                            written=1, wall_seconds=12.5, decoded_fps=96.0, written_fps=6.5))


def test_an_older_manifest_gets_its_defaults(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text(json.dumps(older_manifest(3), indent=2))
    m = M.read_manifests(spark, str(path)).first()
    assert m.completed and not m.params.gpu and m.params.masking is None
    assert m.params.interpolation == "bicubic" and m.params.selection.mode.n == 15
    assert [c.kept_frames for c in m.clips] == [[]] * 3 and m.clips[2].frames_probed == 602


def test_malformed_is_an_error_and_absent_is_none(spark, tmp_path):
    (tmp_path / "bad.json").write_text("{ not json")
    with pytest.raises(Exception):
        M.read_manifests(spark, str(tmp_path / "bad.json")).collect()
    assert M.read_manifest_or_none(spark, str(tmp_path / "none.json")) is None


def test_the_document_round_trips_with_chunked_lists(spark, tmp_path):
    decided = spark.range(100).select(
        (F.col("id") % 2 + 1).alias("clip_id"), F.col("id").alias("frame_index"), (F.col("id") % 6 == 1).alias("keep"))
    rec = records.clip_record(decided)
    clips = rec.select("clip_id", (F.col("clip_id") * 10).alias("position"),
                       F.concat(F.lit("c"), "clip_id").alias("stem"), "frames_decoded", "frames_kept")
    header = spark.range(1).select(F.lit("framesift").alias("tool"), F.lit(False).alias("completed"),
                                   F.struct(F.lit("lanczos4").alias("interpolation")).alias("params"))
    totals = records.run_totals(rec.withColumn("carried", F.lit(False)).withColumn("wall_seconds", F.lit(0.0)))
    totals = totals.select("decoded", "kept", "written", "wall_seconds", "decoded_fps", "written_fps")
    lines = M.manifest_lines(header, clips, selection.kept_chunks(decided, 7), totals)
    M.write_manifest(lines.coalesce(1), str(tmp_path / "doc"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "doc").glob("part-*")))
    doc = json.loads(text)
    assert [c["kept_frames"] for c in doc["clips"]] == [[], list(range(1, 100, 6))]
    assert doc["totals"]["kept"] == 17 and doc["completed"] is False
    m = M.read_manifests(spark, str(tmp_path / "doc")).first()
    assert [len(c.kept_frames) for c in m.clips] == [0, 17] and not m.completed


def test_recording_a_batch_again_replaces_it(spark, tmp_path):
    clips = spark.createDataFrame([(1, 5)], "clip_id long, frames_kept long")
    kept = spark.createDataFrame([(1, 0, [3])], "clip_id long, chunk long, kept_frames array<long>")
    for run, batch in (("a", 0), ("a", 0), ("a", 1), ("b", 0)):
        M.record_clips(clips, kept, str(tmp_path / "m"), run, batch)
    assert [r.batch for r in M.recorded_clips(spark, str(tmp_path / "m"), "a").collect()] == [1]
    assert M.recorded_kept(spark, str(tmp_path / "m"), "b").count() == 1
    assert M.next_batch(spark, str(tmp_path / "m"), "a") == 2 and M.next_batch(spark, str(tmp_path / "m"), "c") == 0
    assert M.recorded_clips(spark, str(tmp_path / "m"), "c") is None


def test_cameras_count_clips_without_intrinsics(spark, tmp_path):
    rows = [(10, "a", 1920, 1080, None, None), (11, "b", 1920, 1080, 1e7, 0.1), (12, "c", 64, 48, 1.5, 2.0)]
    clips = spark.createDataFrame(rows, "clip_id long, stem string, out_w int, out_h int, fx double, fy double")
    clips = clips.withColumn("cx", F.col("out_w") / 2).withColumn("cy", F.col("out_h") / 2)
    cams = M.camera_rows(clips, "clip_id")
    lines = [r.value for r in M.camera_lines(cams).collect()]
    assert lines[len(M.CAMERA_HEADER):] == [
        "# 2: images b_*", "2 PINHOLE 1920 1080 10000000 0.1 960 540",
        "# 3: images c_*", "3 PINHOLE 64 48 1.5 2 32 24"]
    assert M.write_cameras(cams, str(tmp_path / "cameras"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "cameras").glob("part-*")))
    assert text.splitlines() == lines
    assert not M.write_cameras(cams.filter("false"), str(tmp_path / "none"))


# --- resume ---

def intact(spark, files, kept=(0, 15), count=None, sidecars=("sfm",)):
    k = spark.createDataFrame([(1, "clip", i) for i in kept], "clip_id long, stem string, frame_index long")
    r = spark.createDataFrame([(1, len(kept) if count is None else count)], "clip_id long, frames_kept long")
    disk = spark.createDataFrame([(f,) for f in files], "path string")
    return resume.clip_intact(r, k, disk, "jpg", list(sidecars)).first().intact


def test_replayed_frames_keep_their_pixels(spark, frames):
    from framesift.operators import replay
    kept = spark.createDataFrame([("c.1", 7), ("c.2", 0), ("c.9", 7)], "stem string, frame_index long")
    got = replay.replayed(frames, kept)
    assert sorted((r.stem, r.frame_index, len(r.rgb)) for r in got.collect()) == [("c.1", 7, 60), ("c.2", 0, 60)]


def test_intact_needs_every_image_mask_and_the_count(spark):
    both = ["clip_000000.jpg", "clip_000015.jpg"]
    assert not intact(spark, [], sidecars=())
    assert not intact(spark, both[:1], sidecars=())
    assert intact(spark, both, sidecars=())
    assert not intact(spark, both)
    assert intact(spark, both + [f"masks/{f}.png" for f in both])
    assert not intact(spark, both, count=3, sidecars=())


def test_previous_clip_by_path_then_stem(spark):
    prev = spark.createDataFrame([(0, "/a/x.mp4", "x"), (1, "/b/x.mp4", "x"), (2, "/c/y.mp4", "y")],
                                 "position long, path string, stem string")
    new = spark.createDataFrame([("/b/x.mp4", "x"), ("/z/x.mp4", "x"), ("/z/q.mp4", "q")], "path string, stem string")
    got = {r.path: (r.previous_position, r.matched_by) for r in resume.find_previous_clip(new, prev).collect()}
    assert got == {"/b/x.mp4": (1, "path"), "/z/x.mp4": (0, "stem"), "/z/q.mp4": (None, None)}


RUN = ("run_id long, out_dir long, resume boolean, output_size string, format string, selection string, "
       "interpolation string, gpu boolean, masking string, profile_sha string")


@pytest.mark.parametrize("change,named", [
    ({}, None), ({"output_size": "scale 0.5"}, "output size"), ({"selection": "every-nth 5"}, "frame selection"),
    ({"gpu": True}, "gpu"), ({"profile_sha": "abc"}, "lens profile"), ({"masking": "sky"}, "masking")])
def test_parameter_changes_are_refused_by_name(spark, change, named):
    base = dict(run_id=1, out_dir=1, resume=True, output_size="same", format="jpeg 95", selection="motion",
                interpolation="lanczos4", gpu=False, masking=None, profile_sha=None)
    old = spark.createDataFrame([tuple(base.values())], RUN)
    new = spark.createDataFrame([tuple({**base, **change}.values())], RUN)
    row = resume.parameter_diff(new, old, "out_dir").first()
    if named is None:
        assert row.differences is None and row.verdict == "carry"
    else:
        assert named in row.differences and row.verdict == "resume refused"


# --- sources ---

def test_inputs_expand_in_order(spark):
    listing = spark.createDataFrame([(p,) for p in (
        "/v/b.MOV", "/v/a.mp4", "/v/notes.txt", "/v/sub/c.mp4", "/w/notes.bin", "/v/noext")], "path string")
    inputs = spark.createDataFrame([(0, "/w/notes.bin"), (1, "/v")], "input_pos int, input string")
    got = [tuple(r) for r in clip_source.require_inputs(listing, inputs).orderBy("input_pos", "path").collect()]
    assert got == [(0, "/w/notes.bin"), (1, "/v/a.mp4"), (1, "/v/b.MOV")]
    gone = spark.createDataFrame([(0, "/none")], inputs.schema)
    with pytest.raises(ValueError, match="no such input: /none"):
        clip_source.require_inputs(listing, gone)
    with pytest.raises(ValueError, match="hold no video files"):
        clip_source.require_inputs(listing, spark.createDataFrame([(0, "/w")], inputs.schema))


def test_listing_files_and_hashing_them(spark, tmp_path):
    (tmp_path / "w.onnx").write_bytes(b"weights")
    files = clip_source.list_files(spark, str(tmp_path))
    assert files.first().path.endswith("/w.onnx") and "content" not in files.columns
    content = spark.read.format("binaryFile").load(str(tmp_path)).select(
        F.lit("w.onnx").alias("file"), "content")
    import hashlib
    pinned = spark.createDataFrame([("w.onnx", hashlib.sha256(b"weights").hexdigest()), ("x.onnx", "00")],
                                   "file string, sha256 string")
    got = {r.file: r.reusable for r in audits.checksum_audit(content, pinned, "file").collect()}
    assert got == {"w.onnx": True, "x.onnx": False}


@pytest.mark.parametrize("fps,refused", [("60000/1001", False), ("999/1", False), ("2000/1", True)])
def test_frame_rates(spark, fps, refused):
    doc = json.dumps({"streams": [{"width": 2, "height": 2, "r_frame_rate": fps}], "format": {}})
    row = clip_source.probe_clips(spark.createDataFrame([("/a/.hidden", doc)], "path string, report string")).first()
    assert (row.error is not None) == refused and row.stem == ".hidden" and row.frames is None


def test_lens_profile_document(spark, tmp_path):
    doc = {"name": "n", "camera_brand": "Acme", "camera_model": "", "calib_dimension": {"w": 3840, "h": 2880},
           "fps": 59.94, "input_horizontal_stretch": 1.0, "input_vertical_stretch": 1.0,
           "fisheye_params": {"camera_matrix": [[1454.6, 0, 1922.4], [0, 1457.5, 1426.8], [0, 0, 1]],
                              "distortion_coeffs": [0.1, 0.2, 0.3, 0.4]}}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    (tmp_path / "b.json").write_text(json.dumps({**doc, "fisheye_params": {"distortion_coeffs": []}}))
    (tmp_path / "c.json").write_text("oops")
    (tmp_path / "d.txt").write_text("not listed")
    files = profile_source.read_profile_files(spark, str(tmp_path))
    good = profile_source.scan_lens_profiles(files).collect()
    assert [(r.camera, r.k00, r.k11, r.calib_w) for r in good] == [("Acme", 1454.6, 1457.5, 3840)]
    bad = {r.path[-6:]: r.error for r in profile_source.rejected_profiles(files).collect()}
    assert bad["b.json"] == "no distortion coefficients" and len(bad) == 2


def test_search_needs_every_term(spark):
    index = spark.createDataFrame([("Acme/Acme_X4 Pro_stock_wide_4k.json",), ("Zenith/Z11_wide.json",)], "path string")
    counts = [profile_source.search(index, q).count() for q in ("acme x4", "acme z11", "", " ACME\t")]
    assert counts == [1, 0, 2, 1] and terms(" A\tb ") == ["a", "b"]


# --- geometry and text ---

def test_output_sizes(spark):
    rows = [("same", None, None, None), ("scale", 0.5, None, None), ("exact", None, 1919, 1079),
            ("scale", 0.0001, None, None), ("scale", 9.0, None, None), ("scale", 0.0, None, None)]
    df = spark.createDataFrame(rows, "k string, f double, w int, h int").coalesce(1)
    a, b = G.output_size(*(F.col(c) for c in "kfwh"), F.lit(3840), F.lit(2880))
    got = [tuple(r) for r in df.select(a, b).collect()]
    assert got == [(3840, 2880), (1920, 1440), (1918, 1078), (2, 2), (None, None), (None, None)]


def test_names(spark):
    df = spark.createDataFrame([("a", 7), ("a", 12345678)], "s string, i long").coalesce(1)
    assert [r[0] for r in df.select(image_name(F.col("s"), F.col("i"), "png")).collect()] == \
        ["a_000007.png", "a_12345678.png"]
    p = spark.createDataFrame([("/x/a.b.MP4",), ("/x/.mp4",), ("noext",)], "p string").coalesce(1)
    got = [tuple(r) for r in p.select(file_stem(F.col("p")), extension(F.col("p"))).collect()]
    assert got == [("a.b", "mp4"), (".mp4", ""), ("noext", "")]
    n = spark.createDataFrame([(1e7,), (0.1,), (1920.0,), (1e-7,)], "v double").coalesce(1)
    assert [r[0] for r in n.select(plain_number("v")).collect()] == ["10000000", "0.1", "1920", "0.0000001"]


@pytest.mark.parametrize("profile,clip,word", [
    ((3840, 2880, 59.94), (3840, 2880, 59.94), None), ((3840, 2880, 59.94), (3840, 2160, 59.94), "1.78:1"),
    ((3840, 2880, 59.94), (1920, 1440, 29.97), "29.97 fps"), ((3840, 2880, 0.0), (1920, 1440, 29.97), None),
    ((0, 2880, 59.94), (1920, 1440, 29.97), None), ((3840, 2880, 30.0), (1920, 1440, 31.0), None)])
def test_profile_mismatch(spark, profile, clip, word):
    row = spark.range(1).select(audits.profile_mismatch(*[F.lit(v) for v in profile + clip]).alias("m")).first()
    assert (row.m is None) if word is None else (word in row.m)
