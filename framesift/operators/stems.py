"""Distinct dataset names for clips that share a file stem.

In list order, a clip whose stem is taken gets `stem_1`, `stem_2`, ...: the first
number that nobody took before, be it an earlier duplicate or a clip that is
really called that.

Numbers depend on other clips only through real stems that end in a number.
Everywhere else a duplicate's number is its rank.  For the few stems with such
relatives ("complex" below) the numbers passed over are found by a fixed point:
assume nothing is passed over, see which names were taken in time, count them,
repeat until the counts stay.  Every round settles at least one more name per
stem, and results flow only from a stem to the longer one it may name, so stems
are done by how many numbers they end in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from framesift import params as P
from framesift.operators.ordering import dense_index, index_bucket, running_sum
from framesift.session import materialise

_NUMBERED = r"^(.*)_([1-9][0-9]*)$"


def _parent(stem: Column) -> Column:
    return F.when(stem.rlike(_NUMBERED), F.regexp_extract(stem, _NUMBERED, 1))


def _number(stem: Column) -> Column:
    return F.when(stem.rlike(_NUMBERED), F.regexp_extract(stem, _NUMBERED, 2)).try_cast("long")


def _depth(stem: Column) -> Column:
    tail = F.regexp_extract(stem, r"((?:_[1-9][0-9]*)*)$", 1)
    return F.length(tail) - F.length(F.replace(tail, F.lit("_"), F.lit("")))


def unique_stems(clips: DataFrame) -> DataFrame:
    """Add `name` to clips (position, stem); positions are unique integers."""
    clips = clips.select("position", "stem")
    stems = clips.groupBy("stem").agg(F.min("position").alias("first")).select(
        "stem", "first", _parent(F.col("stem")).alias("parent"),
        _number(F.col("stem")).alias("number"), _depth(F.col("stem")).alias("depth"))
    children = (stems.filter("number is not null")
                .join(stems.select(F.col("stem").alias("parent")), "parent", "left_semi"))
    complex_stems = children.select("stem").union(children.select(F.col("parent").alias("stem"))).distinct()
    complex_stems = materialise(
        stems.join(complex_stems, "stem", "left_semi").select("stem", "first", "depth"), "stems")
    children = materialise(children.select("parent", "stem", "number", "first"), "stem-children")
    levels = [r.depth for r in complex_stems.select("depth").distinct().collect()]

    plain = clips.join(complex_stems.select("stem"), "stem", "left_anti")
    named = _ranked(plain, 0).select(
        "position", "stem", _joined(F.col("stem"), F.col("rank")).alias("name"))
    generated = None
    for depth in sorted(levels):
        at_level = complex_stems.filter(F.col("depth") == depth).select("stem", "first")
        done, generated = _level(clips, at_level, children, generated)
        named = named.unionByName(done)
    return named


def _ranked(clips: DataFrame, start: int) -> DataFrame:
    return dense_index(clips, ["stem"], ["position"], index_bucket("position", P.SEGMENT_FRAMES),
                       "rank", start)


def _joined(stem: Column, number: Column) -> Column:
    return F.when(number == 0, stem).otherwise(F.concat_ws("_", stem, number.cast("string")))


def _level(clips: DataFrame, stems: DataFrame, children: DataFrame,
           generated: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Names of the clips of these stems, and when longer names were given away."""
    if generated is None:
        taken = stems.withColumn("given", F.lit(None).cast("long"))
    else:
        taken = stems.join(generated, "stem", "left")
    mine = clips.join(taken, "stem")
    keeps = (F.col("position") == F.col("first")) & F.col("given").isNull()
    duplicates = materialise(
        _ranked(mine.filter(~keeps).select("position", "stem"), 1), "stem-duplicates")
    rivals = (children.join(stems.select(F.col("stem").alias("parent")), "parent", "left_semi")
              .select(F.col("parent").alias("stem"), "number", F.col("first").alias("rival_first"),
                      F.col("stem").alias("rival")))
    state = materialise(rivals.withColumn("passed", F.lit(0).cast("long"))
                        .withColumn("skipped", F.lit(0).cast("long"))
                        .withColumn("at", F.lit(None).cast("long")), "stem-rivals")
    while True:
        tried = duplicates.select("stem", F.col("rank").alias("_rank"), F.col("position").alias("_at"))
        met = state.withColumn("_rank", F.col("number") - F.col("passed")).join(
            tried, ["stem", "_rank"], "left")
        judged = met.select(
            "stem", "number", "rival_first", "rival", F.col("passed").alias("_passed"),
            F.col("skipped").alias("_skipped"),
            F.coalesce(F.col("rival_first") < F.col("_at"), F.lit(False)).cast("long").alias("skipped"),
            F.col("_at").alias("at"))
        counted = running_sum(judged, ["stem"], "number", "skipped",
                              index_bucket("number", P.SEGMENT_FRAMES), "_upto")
        state = materialise(counted.withColumn("passed", F.col("_upto") - F.col("skipped")), "stem-rivals")
        moved = state.filter("passed <> _passed or skipped <> _skipped")
        if not moved.limit(1).count():
            break
        state = state.select("stem", "number", "rival_first", "rival", "passed", "skipped", "at")

    # A duplicate's number is its rank plus the names it and those before it passed over.
    shifts = (state.filter("skipped = 1")
              .select("stem", (F.col("number") - F.col("passed")).alias("rank"))
              .groupBy("stem", "rank").agg(F.count(F.lit(1)).alias("shift")))
    marks = duplicates.select("stem", "rank", "position").join(shifts, ["stem", "rank"], "left")
    marks = marks.withColumn("shift", F.coalesce("shift", F.lit(0)).cast("long"))
    shifted = running_sum(marks, ["stem"], "rank", "shift",
                          index_bucket("rank", P.SEGMENT_FRAMES), "total")
    names = shifted.select("position", "stem", _joined(
        F.col("stem"), F.col("rank") + F.col("total")).alias("name"))
    first = mine.filter(keeps).select("position", "stem", F.col("stem").alias("name"))
    given = state.filter("skipped = 0 and at is not null").select(
        F.col("rival").alias("stem"), F.col("at").alias("given"))
    return first.unionByName(names), given
