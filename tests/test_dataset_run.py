import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesift.dataset import DatasetConfig, build_dataset
from framesift.sources import images, manifest

FRAMES = "clip_id long, frame_index long, width int, height int, rgb binary"
CLIPS = "clip_id long, position long, path string, stem string, width int, height int, fps double"


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(0)
    rows = []
    for clip in (1, 2):
        for i in range(12):
            image = rng.integers(0, 40, (24, 32, 3))
            image[:12] += (150, 180, 210)
            image[12:] += (20 * (i // 3) + clip, 40, 30)
            rows.append((clip, i, 32, 24, image.clip(0, 255).astype(np.uint8).tobytes()))
    return spark.createDataFrame(rows, FRAMES)


@pytest.fixture(scope="module")
def clips(spark):
    return spark.createDataFrame(
        [(1, 0, "/v/a/x.mp4", "x", 32, 24, 30.0), (2, 1, "/v/b/x.mp4", "x", 32, 24, 30.0)], CLIPS)


def test_every_frame_at_half_size(spark, frames, clips, tmp_path):
    cfg = DatasetConfig(size="scale", factor=0.5, select="every-nth", nth=5)
    got = {r.clip_id: r for r in build_dataset(frames, clips, str(tmp_path), cfg).collect()}
    assert [(got[c].stem, got[c].frames_decoded, got[c].frames_kept) for c in (1, 2)] == [("x", 12, 3), ("x_1", 12, 3)]
    back = images.read_image_frames(spark, f"{tmp_path}/images")
    assert sorted((r.stem, r.frame_index, r.width, r.height) for r in back.collect()) == \
        [(s, i, 16, 12) for s in ("x", "x_1") for i in (0, 5, 10)]
    run = manifest.recorded_run(spark, f"{tmp_path}/manifest", "run").first()
    assert run.completed and run.totals.kept == 6 and run.params.output_size.kind == "scale" and run.params.output_size.factor == 0.5
    assert not (tmp_path / "cameras").exists()


def test_stored_frames_are_picked_in_their_buckets(spark, frames, clips, tmp_path):
    store = images.FrameStore.write(frames, str(tmp_path / "store"), buckets=3)
    cfg = DatasetConfig(select="every-nth", nth=5, mask_sky=True)
    for name, source in (("plain", frames), ("stored", store)):
        build_dataset(source, clips, str(tmp_path / name), cfg)
    for part in ("images", "images/masks"):
        found = [{p.name: p.read_bytes() for p in (tmp_path / name / part).glob("*.png")} for name in ("plain", "stored")]
        assert found[0] == found[1] and len(found[0]) == 6


def test_sky_masks_and_lens(spark, frames, clips, tmp_path):
    lens = {"k00": 12.0, "k11": 12.0, "calib_w": 32, "calib_h": 24, "stretch_x": 1.0, "stretch_y": 1.0}
    with_lens = clips
    for k, v in lens.items():
        with_lens = with_lens.withColumn(k, F.lit(v))
    with_lens = with_lens.withColumn("coeffs", F.array(*[F.lit(c) for c in (0.1, 0.0, 0.0, 0.0)]))
    cfg = DatasetConfig(mask_sky=True, motion_threshold=0.001, window=2)
    got = build_dataset(frames, with_lens, str(tmp_path), cfg).collect()
    kept = sum(r.frames_kept for r in got)
    sfm = images.read_masks(spark, f"{tmp_path}/images/masks").collect()
    assert len(sfm) == kept and not (tmp_path / "images" / "masks_train").exists()
    for r in sfm:
        mask = np.frombuffer(r.mask, np.uint8).reshape(24, 32)
        assert mask[5, 16] == 0 and mask[22, 16] == 255
    lines = "".join(p.read_text() for p in sorted((tmp_path / "cameras").glob("part-*")))
    assert "1 PINHOLE 32 24 12 12 16 12" in lines and "2 PINHOLE" in lines


def test_model_masks_people_in_both_sets(spark, frames, clips, tmp_path):
    from framesift.plans.datasets import ChannelModel
    cfg = DatasetConfig(mask_sky=True, mask_people=True, model=ChannelModel(), seg_width=32, sky_class=2,
                        people_class=0, sky_dilate=0, people_dilate=0, temporal_window=3, select="every-nth", nth=6)
    build_dataset(frames, clips, str(tmp_path), cfg)
    sfm = {(r.stem, r.frame_index): r.mask for r in images.read_masks(spark, f"{tmp_path}/images/masks").collect()}
    train = {(r.stem, r.frame_index): r.mask
             for r in images.read_masks(spark, f"{tmp_path}/images/masks_train").collect()}
    assert sorted(sfm) == sorted(train) and len(sfm) == 4
    for k in sfm:
        a, b = np.frombuffer(sfm[k], np.uint8), np.frombuffer(train[k], np.uint8)
        assert (a <= b).all() and (a < b).any()
    with pytest.raises(ValueError, match="segmentation model"):
        DatasetConfig(mask_people=True)


def test_resume_redoes_only_what_is_not_whole(spark, frames, clips, tmp_path):
    out = str(tmp_path / "out")
    cfg = DatasetConfig(select="every-nth", nth=4)
    build_dataset(frames, clips, out, cfg)
    with pytest.raises(ValueError, match="frame selection"):
        build_dataset(frames, clips, out, DatasetConfig(select="every-nth", nth=5))
    (tmp_path / "out" / "images" / "x_1_000004.png").unlink()
    again = DatasetConfig(select="every-nth", nth=4, resume=True)
    got = {r.clip_id: (r.batch, r.frames_kept) for r in build_dataset(frames, clips, out, again).collect()}
    assert got == {1: (0, 3), 2: (1, 3)}
    assert (tmp_path / "out" / "images" / "x_1_000004.png").is_file()
    assert manifest.recorded_run(spark, f"{out}/manifest", "run").first().totals.kept == 6


def test_replay_at_another_size_keeps_the_names(spark, frames, clips, tmp_path):
    first, second = str(tmp_path / "a"), str(tmp_path / "b")
    build_dataset(frames, clips, first, DatasetConfig(motion_threshold=0.01, window=3))
    names = sorted(p.name for p in (tmp_path / "a" / "images").glob("*.png"))
    chunks = manifest.recorded_kept(spark, f"{first}/manifest", "run")
    kept = chunks.select("clip_id", F.explode("kept_frames").alias("frame_index")).join(
        manifest.recorded_clips(spark, f"{first}/manifest", "run").select("clip_id", "stem"), "clip_id")
    cfg = DatasetConfig(size="exact", width=17, height=13, select="replay", blur_floor=1e9)
    build_dataset(frames, clips, second, cfg, kept.select("stem", "frame_index"))
    assert sorted(p.name for p in (tmp_path / "b" / "images").glob("*.png")) == names
    with pytest.raises(ValueError, match="no kept frames recorded for clip x_1"):
        build_dataset(frames, clips, str(tmp_path / "c"), cfg, kept.filter("stem = 'x'").select("stem", "frame_index"))
    with pytest.raises(ValueError, match="were not found"):
        more = kept.select("stem", "frame_index").union(spark.createDataFrame([("x", 99)], "stem string, frame_index long"))
        build_dataset(frames, clips, str(tmp_path / "d"), cfg, more)


def test_bad_input_is_refused(spark, frames, clips, tmp_path):
    cfg = DatasetConfig(select="every-nth")
    with pytest.raises(ValueError, match="missing from number 4"):
        build_dataset(frames.filter("not (clip_id = 2 and frame_index = 4)"), clips, str(tmp_path / "a"), cfg)
    odd = frames.withColumn("width", F.when(F.col("frame_index") == 3, 64).otherwise(F.col("width")))
    with pytest.raises(ValueError, match="frame is 64x24"):
        build_dataset(odd, clips, str(tmp_path / "b"), cfg)
    with pytest.raises(ValueError, match="2: no frames"):
        build_dataset(frames.filter("clip_id = 1"), clips, str(tmp_path / "c"), cfg)
    with pytest.raises(ValueError, match="no frame was kept"):
        build_dataset(frames, clips, str(tmp_path / "d"), DatasetConfig(blur_floor=1e12))


def images_of(path):
    return sorted(p.name for p in (path / "images").glob("*.png"))


@pytest.fixture
def cut_short(monkeypatch):
    """Makes a run stop after the images of its first group of clips, before they are recorded."""
    def stop(*args, **kwargs):
        raise KeyboardInterrupt

    def begin():
        monkeypatch.setattr(manifest, "record_clips", stop)
    yield begin
    monkeypatch.undo()


def test_a_killed_run_is_resumed_and_not_mixed(spark, frames, clips, tmp_path, cut_short, monkeypatch):
    out = str(tmp_path)
    cut_short()
    with pytest.raises(KeyboardInterrupt):
        build_dataset(frames, clips, out, DatasetConfig(select="every-nth", nth=4))
    monkeypatch.undo()
    assert not manifest.recorded_run(spark, f"{out}/manifest", "run").first().completed
    with pytest.raises(ValueError, match="frame selection"):
        build_dataset(frames, clips, out, DatasetConfig(select="every-nth", nth=5))
    got = build_dataset(frames, clips, out, DatasetConfig(select="every-nth", nth=4, resume=True)).collect()
    assert sum(r.frames_kept for r in got) == len(images_of(tmp_path)) == 6
    run = manifest.recorded_run(spark, f"{out}/manifest", "run").first()
    assert run.completed and run.totals.wall_seconds > 0 and run.totals.decoded_fps > 0


def test_groups_are_recorded_one_by_one(spark, frames, clips, tmp_path, monkeypatch):
    out, real, calls = str(tmp_path), manifest.record_clips, []

    def second_fails(*args, **kwargs):
        calls.append(1)
        if len(calls) == 2:
            raise KeyboardInterrupt
        real(*args, **kwargs)
    monkeypatch.setattr(manifest, "record_clips", second_fails)
    cfg = dict(select="every-nth", nth=4, group_frames=12)
    with pytest.raises(KeyboardInterrupt):
        build_dataset(frames, clips, out, DatasetConfig(**cfg))
    monkeypatch.undo()
    first = {r.clip_id: r.batch for r in manifest.recorded_clips(spark, f"{out}/manifest", "run").collect()}
    assert list(first) == [1]
    got = {r.clip_id: r.batch for r in build_dataset(frames, clips, out, DatasetConfig(**cfg, resume=True)).collect()}
    assert got[1] == first[1] and got[2] > first[1]


def test_resumed_again_and_again_nothing_is_redone(spark, frames, clips, tmp_path):
    out = str(tmp_path)
    build_dataset(frames, clips, out, DatasetConfig(select="every-nth", nth=4))
    (tmp_path / "images" / "x_1_000004.png").unlink()
    cfg = DatasetConfig(select="every-nth", nth=4, resume=True)
    batches = [{r.clip_id: r.batch for r in build_dataset(frames, clips, out, cfg).collect()} for _ in range(3)]
    assert batches[0][1] == 0 and batches[0][2] > 0 and batches[1] == batches[2] == batches[0]


def test_a_rerun_replaces_records_and_files(spark, frames, clips, tmp_path):
    out = str(tmp_path)
    cfg = dict(select="every-nth", nth=4)
    build_dataset(frames, clips, out, DatasetConfig(**cfg))
    (tmp_path / "images" / "x_1_000004.png").unlink()
    build_dataset(frames, clips, out, DatasetConfig(**cfg, resume=True))
    shorter = frames.filter("frame_index < 6")
    got = {r.clip_id: (r.frames_decoded, r.frames_kept) for r in build_dataset(shorter, clips, out, DatasetConfig(**cfg)).collect()}
    assert got == {1: (6, 2), 2: (6, 2)}
    assert images_of(tmp_path) == ["x_000000.png", "x_000004.png", "x_1_000000.png", "x_1_000004.png"]


def test_all_parameters_are_compared(spark, frames, clips, tmp_path):
    from framesift.plans.datasets import ChannelModel
    out = str(tmp_path)
    base = dict(mask_sky=True, model=ChannelModel(), seg_width=32, sky_class=2, sky_dilate=0, select="every-nth", nth=6)
    build_dataset(frames, clips, out, DatasetConfig(**base))
    for other in (dict(sky_class=1), dict(sky_dilate=9), dict(temporal_window=5), dict(seg_width=320), dict(model=None)):
        with pytest.raises(ValueError, match="masking"):
            build_dataset(frames, clips, out, DatasetConfig(**{**base, **other}))
    with pytest.raises(ValueError, match="lens profile"):
        build_dataset(frames, clips, out, DatasetConfig(**base, profile_sha="abc"))


def test_any_number_of_sizes_is_one_pass(spark, tmp_path):
    from framesift.plans.datasets import ChannelModel
    rng = np.random.default_rng(1)
    sizes = [(20 + 2 * i, 16 + 2 * (i % 3)) for i in range(100)]
    rows = [(i, 0, w, h, rng.integers(0, 256, w * h * 3, dtype=np.uint8).tobytes()) for i, (w, h) in enumerate(sizes)]
    many = spark.createDataFrame(rows, FRAMES)
    listed = spark.createDataFrame([(i, i, f"/v/{i}.mp4", f"c{i}", w, h, 30.0) for i, (w, h) in enumerate(sizes)], CLIPS)
    cfg = DatasetConfig(mask_sky=True, model=ChannelModel(), seg_width=32, sky_class=2, sky_dilate=0, select="every-nth", nth=1)
    assert build_dataset(many, listed, str(tmp_path), cfg).count() == 100
    found = {r.stem: (r.width, r.height) for r in images.read_masks(spark, f"{tmp_path}/images/masks").collect()}
    assert found == {f"c{i}": s for i, s in enumerate(sizes)}


def test_a_clip_without_profile_in_a_lens_run(spark, frames, clips, tmp_path):
    lens = {"k00": 12.0, "k11": 12.0, "calib_w": 32, "calib_h": 24, "stretch_x": 1.0, "stretch_y": 1.0}
    some = clips
    for k, v in lens.items():
        some = some.withColumn(k, F.when(F.col("clip_id") == 1, F.lit(v)))
    some = some.withColumn("coeffs", F.when(F.col("clip_id") == 1, F.array(*[F.lit(c) for c in (0.1, 0.0, 0.0, 0.0)])))
    build_dataset(frames, some, str(tmp_path), DatasetConfig(select="every-nth", nth=6))
    back = {(r.stem, r.frame_index): r.rgb for r in images.read_image_frames(spark, f"{tmp_path}/images").collect()}
    plain = {r.frame_index: r.rgb for r in frames.filter("clip_id = 2").collect()}
    assert len(back) == 4 and all(back["x_1", i] == plain[i] for i in (0, 6)) and back["x", 0] != frames.filter(
        "clip_id = 1 and frame_index = 0").first().rgb


def test_paths_are_written_where_spark_reads(spark, frames, clips, tmp_path, monkeypatch):
    from framesift.session import qualified
    assert images.target_uri(spark, str(tmp_path)) == f"file://{tmp_path}" == images.target_uri(spark, f"file://{tmp_path}")
    home = qualified(spark, "some/folder")
    assert home.startswith("file:///") and home.endswith("/some/folder")
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    with pytest.raises(ValueError, match="local to each machine"):
        images.target_uri(spark, str(tmp_path))


def test_the_shared_folder_may_be_written_on_a_cluster(spark, monkeypatch):
    from framesift.session import qualified, shared_dir
    shared = shared_dir(spark)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    assert images.target_uri(spark, f"{shared}/framesift/images") == qualified(spark, f"{shared}/framesift/images")
    for outside in (f"{shared}-other/images", f"{shared}/../images"):
        with pytest.raises(ValueError, match="local to each machine"):
            images.target_uri(spark, outside)


def test_a_run_leaves_no_scratch(spark, frames, clips, tmp_path):
    from pathlib import Path
    from framesift.session import shared_dir
    folder = Path(shared_dir(spark)) / "framesift"
    before = {p.name for p in folder.iterdir()}
    got = build_dataset(frames, clips, str(tmp_path), DatasetConfig(select="every-nth", nth=5))
    assert {p.name for p in folder.iterdir()} == before and got.count() == 2


def test_the_document_of_a_run(spark, frames, clips, tmp_path):
    build_dataset(frames, clips, str(tmp_path), DatasetConfig(select="every-nth", nth=5, blur_floor=1.0))
    text = "".join(p.read_text() for p in sorted((tmp_path / "manifest_document").glob("part-*")))
    doc = json.loads(text)
    assert doc["completed"] and doc["params"]["selection"] == {"mode": {"mode": "every-nth", "n": 5, "motion_threshold": None,
                                                                       "window": None, "source": None}, "blur_floor": 1.0}
    assert [(c["stem"], c["kept_frames"]) for c in doc["clips"]] == [("x", [0, 5, 10]), ("x_1", [0, 5, 10])]
    assert doc["totals"]["kept"] == 6
