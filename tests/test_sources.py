import hashlib
import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesift.functions import png
from framesift.operators import audits, replay, resume
from framesift.sources import file_sets, frame_source, images
from framesift.sources import profiles as profile_source


def frames_of(spark, stems=("a", "b_1"), n=25):
    rows = [(s, i, 3, 2, bytes((k * 50 + i + j) % 256 for j in range(18))) for k, s in enumerate(stems) for i in range(n)]
    return rows, spark.createDataFrame(rows, "stem string, frame_index long, width int, height int, rgb binary")


# --- the frame source ---

def test_frames_come_back_and_tasks_are_clip_ranges(spark, tmp_path):
    rows, frames = frames_of(spark)
    images.write_images(frames, str(tmp_path))
    (tmp_path / "notes.txt").write_text("x")
    (tmp_path / "c_000001.png").write_bytes(b"\x89PNG\r\n\x1a\nbroken")
    df = frame_source.frames_from(spark, str(tmp_path), task_frames=10)
    got = sorted(tuple(r) for r in df.collect())
    assert [(s, i, w, h, bytes(v)) for s, i, w, h, v in got if s != "c"] == sorted(rows)
    assert [r for r in got if r[0] == "c"] == [("c", 1, -1, -1, None)]
    assert df.rdd.getNumPartitions() == 7
    assert sorted(tuple(r) for r in images.read_image_frames(spark, str(tmp_path / "[ab]*.png")).collect()) == sorted(rows)


def test_filters_reach_the_source(spark, tmp_path):
    _, frames = frames_of(spark)
    images.write_images(frames, str(tmp_path))
    df = frame_source.frames_from(spark, str(tmp_path), task_frames=10)
    some = df.where("stem in ('b_1', 'zz') and frame_index >= 8 and frame_index < 13 and width > 1")
    plan = some._jdf.queryExecution().executedPlan().toString()
    # What the source took over is gone from the plan; what it does not know stays.
    assert "stem" not in plan.split("Filter")[1].split("\n")[0] and "width" in plan.split("Filter")[1].split("\n")[0]
    assert some.rdd.getNumPartitions() == 1
    assert sorted((r.stem, r.frame_index) for r in some.collect()) == [("b_1", i) for i in range(8, 13)]
    reader = frame_source.FrameReader(f"file://{tmp_path}", 10, 1 << 30)
    left = list(reader.pushFilters([frame_source.EqualTo(("stem",), "a"), frame_source.GreaterThan(("frame_index",), 4),
                                    frame_source.LessThanOrEqual(("frame_index",), 6), frame_source.EqualTo(("width",), 3)]))
    assert left == [frame_source.EqualTo(("width",), 3)]
    assert [(p.stem, p.first, p.last) for p in reader.partitions()] == [("a", 5, 6)]
    assert df.where("frame_index > 99").count() == 0


def test_a_missing_folder_has_no_frames(spark, tmp_path):
    assert frame_source.frames_from(spark, str(tmp_path / "none")).count() == 0


def test_frames_stream_in_by_offset(spark, tmp_path):
    rows, frames = frames_of(spark, ("a",), 6)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        query = (frame_source.frame_stream(spark, folder).select("stem", "frame_index", F.octet_length("rgb").alias("n")).writeStream.format("parquet")
                 .option("path", out).option("checkpointLocation", out + "-c").trigger(processingTime="100 milliseconds").start())
        query.processAllAvailable()
        query.stop()
        return sorted(tuple(r) for r in spark.read.parquet(out).collect())
    images.write_images(frames.where("frame_index < 4"), folder)
    assert run() == [("a", i, 18) for i in range(4)]
    images.write_images(frames.where("frame_index >= 4"), folder)
    assert run() == [("a", i, 18) for i in range(6)]


def filtered(rows, kinds, n):
    """PNG scan lines, each by the filter asked for, one byte at a time."""
    out, above = b"", bytes(len(rows[0]))
    for kind, row in zip(kinds, rows):
        out += bytes([kind])
        for i, v in enumerate(row):
            a, b, c = row[i - n] if i >= n else 0, above[i], above[i - n] if i >= n else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out += bytes([(v - (0, a, b, (a + b) // 2, paeth)[kind]) % 256])
        above = row
    return out


@pytest.mark.parametrize("colour,n", [(0, 1), (2, 3), (4, 2), (6, 4), (3, 1)])
def test_png_filters(colour, n):
    rng = np.random.default_rng(colour)
    pixels = rng.integers(0, 256, (10, 7, n), dtype=np.uint8)
    body = filtered([bytes(r.reshape(-1)) for r in pixels], [0, 1, 2, 3, 4, 4, 3, 2, 1, 0], n)
    palette = rng.integers(0, 256, (256, 3), dtype=np.uint8)
    data = (b"\x89PNG\r\n\x1a\n" + png._chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 10, 8, colour, 0, 0, 0))
            + (png._chunk(b"PLTE", palette.tobytes()) if colour == 3 else b"")
            + png._chunk(b"IDAT", zlib.compress(body)) + png._chunk(b"IEND", b""))
    want = palette[pixels[:, :, 0]] if colour == 3 else pixels[:, :, [0, 0, 0]] if n < 3 else pixels[:, :, :3]
    assert (png.decode(data) == want).all()
    assert (png.decode(png.encode(want)) == want).all()


# --- file sets ---

def test_listing_by_tasks_equals_paths(spark, tmp_path):
    rng = random.Random(2)
    names = {f"{f}{s}_{i:06d}.png{e}" for f, e in (("", ""), ("masks/", ".png"), ("masks_train/", ".png")) for s in ("a", "b_7")
             for i in rng.sample(range(1500), 60)} | {"a_1000000.png"}
    junk = {"a_7.png", "a_0000007.png", "x.txt", "masks/deep/q_000003.png"}
    for name in names | junk:
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_bytes(b"")
    order = ["folder", "stem", "ext", "stretch"]

    def rows(df):
        return sorted((*[r[c] for c in order], bytes(r.bits).rstrip(b"\0")) for r in df.collect())
    got = file_sets.listed(spark, str(tmp_path))
    paths = spark.createDataFrame([(n,) for n in names | junk], "path string")
    assert rows(got) == rows(file_sets.of_paths(paths))
    assert "FileScan" not in got._jdf.queryExecution().analyzed().toString().replace("parquet", "")
    kept = spark.createDataFrame([(1, "a", int(n[2:8])) for n in names if n.startswith("a_0")], "clip_id long, stem string, frame_index long")
    assert file_sets.missing(kept, got, [("", "png")]).count() == 0
    more = kept.unionByName(spark.createDataFrame([(1, "a", 1501), (2, "b_8", 0)], kept.schema))
    assert {r.clip_id: r.files_missing for r in file_sets.missing(more, got, [("", "png")]).collect()} == {1: 1, 2: 1}
    assert file_sets.listed(spark, str(tmp_path / "none")).count() == 0


def test_intact_by_set_equals_files_one_by_one(spark):
    rng = random.Random(4)
    kept = [(c, f"s{c % 3}", i) for c in range(6) for i in sorted(rng.sample(range(2000), 40))]
    every = {f"{f}{s}_{i:06d}.jpg{e}" for f, e in (("", ""), ("masks/", ".png")) for _, s, i in kept}
    disk = set(rng.sample(sorted(every), len(every) - 9))
    records = spark.createDataFrame([(c, 40) for c in range(6)], "clip_id long, frames_kept long")
    frame = spark.createDataFrame(kept, "clip_id long, stem string, frame_index long")
    got = resume.clip_intact(records, frame, spark.createDataFrame([(d,) for d in disk], "path string"), "jpg", ["sfm"]).collect()
    want = {c: sum(f"{f}{s}_{i:06d}.jpg{e}" not in disk for c2, s, i in kept if c2 == c for f, e in (("", ""), ("masks/", ".png")))
            for c in range(6)}
    assert {r.clip_id: r.files_missing for r in got} == want and all(r.intact == (want[r.clip_id] == 0) for r in got)


def test_files_are_listed_like_spark_lists_them(spark, tmp_path):
    for name in ("a.mp4", "b c.MOV", "in/d.mkv", "in/deep/e.txt", "_hidden.mp4", ".f.mp4"):
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * len(name))
    for recursive in (False, True):
        want = (spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(str(tmp_path))
                .select("path", "length", F.col("modificationTime").alias("modified")))
        got = file_sets.files_below(spark, str(tmp_path), recursive)
        assert got.dtypes == want.dtypes

        def rows(df):
            return sorted((r.path, r.length, int(r.modified.timestamp())) for r in df.collect())
        assert [(p.replace("%20", " "), n, t) for p, n, t in rows(got)] == [(p.replace("%20", " "), n, t) for p, n, t in rows(want)]
    assert [r.path for r in file_sets.files_below(spark, str(tmp_path / "a.mp4")).collect()] == [f"file:{tmp_path}/a.mp4"]


# --- many searches ---

def test_many_searches_equal_one_by_one(spark):
    rng = random.Random(1)
    paths = ["".join(rng.choice("abAB_/1é ") for _ in range(rng.randint(0, 12))) for _ in range(120)]
    queries = ["", "  ", "a", "AB", "ab_", "abab", "b a", "zz", "é", "a/ 1 B", "ababab abab", "_ _ _"] + \
        ["".join(rng.choice("abAB_1é ") for _ in range(rng.randint(1, 6))) for _ in range(30)]
    index = spark.createDataFrame([(p,) for p in paths], "path string")
    searches = spark.createDataFrame(list(enumerate(queries)), "search_id int, query string")
    got = profile_source.search_many(profile_source.search_index(index), searches)
    want = sorted((k, p) for k, q in enumerate(queries) for p in paths if all(t in p.lower() for t in q.lower().split()))
    assert sorted(tuple(r) for r in got.collect()) == want
    for k in (2, 9):
        assert sorted(r.path for r in profile_source.search(index, queries[k]).collect()) == sorted(p for s, p in want if s == k)


# --- counts of long lists, digests of long files ---

def test_preflight_counts_chunks_of_the_last_record(spark):
    clips = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "clip_id long, stem string")
    chunks = [("a", 1, [1, 2]), ("a", 2, [5]), ("a", 2, [6, 7]), ("b", 1, [1]), ("b", 9, []), ("d", 3, None)]
    rows = spark.createDataFrame(chunks, "stem string, position long, kept_frames array<long>")
    long = spark.range(10).select(F.lit("c").alias("stem"), F.lit(4).cast("long").alias("position"),
                                  F.sequence(F.col("id") * 100000, F.col("id") * 100000 + 99999).alias("kept_frames"))
    got = {r.clip_id: (r.recorded, r.problem) for r in replay.replay_preflight(clips, rows.unionByName(long)).collect()}
    assert got == {1: (3, None), 2: (0, "no kept frames recorded for clip b"), 3: (1000000, None),
                   4: (0, "no kept frames recorded for clip d")}
    plan = replay.replay_preflight(clips, rows)._jdf.queryExecution().executedPlan().toString()
    assert "max_by(kept_frames" not in plan


def test_parts_hash_like_the_whole(spark):
    rng = random.Random(3)
    files = {k: rng.randbytes(rng.randint(0, 5000)) for k in range(20)}
    parts = [(k, i, v[a:a + 700]) for k, v in files.items() for i, a in enumerate(range(0, max(len(v), 1), 700))]
    rng.shuffle(parts)
    df = spark.createDataFrame(parts, "name long, part long, content binary").repartition(5)
    recorded = spark.createDataFrame([(k, hashlib.sha256(v).hexdigest() if k % 2 else "0") for k, v in files.items()] + [(99, "1")],
                                     "name long, sha256 string")
    got = {r.name: (r.sha256, r.reusable) for r in audits.checksum_audit(df, recorded, "name").collect()}
    assert got == {k: (hashlib.sha256(v).hexdigest(), k % 2 == 1) for k, v in files.items()} | {99: (None, False)}


def test_a_file_beyond_two_gigabytes(spark, tmp_path):
    """A sparse one, which takes no room; no cell of a table could hold it."""
    size = (1 << 31) + 12345
    with open(tmp_path / "big", "wb") as out:
        out.truncate(size)
    want = hashlib.sha256()
    for _ in range(size >> 20):
        want.update(bytes(1 << 20))
    want.update(bytes(size % (1 << 20)))
    files = spark.createDataFrame([(f"file://{tmp_path}/big",), (f"file://{tmp_path}/none",)], "path string")
    recorded = files.limit(0).withColumn("sha256", F.lit(""))
    got = {r.path.rsplit("/", 1)[1]: r.sha256 for r in audits.checksum_audit(files, recorded, "path").collect()}
    assert got == {"big": want.hexdigest(), "none": None}
