"""Lens profiles and the profile catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from framesift import params as P
from framesift.functions.text import ascii_lower, matches_terms, parsed_once, terms_of
from framesift.session import materialise

_SIZE = T.StructType([T.StructField("w", T.IntegerType()), T.StructField("h", T.IntegerType())])

PROFILE = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("camera_brand", T.StringType()),
    T.StructField("camera_model", T.StringType()),
    T.StructField("calib_dimension", _SIZE),
    T.StructField("fps", T.DoubleType()),
    T.StructField("input_horizontal_stretch", T.DoubleType()),
    T.StructField("input_vertical_stretch", T.DoubleType()),
    T.StructField("fisheye_params", T.StructType([
        T.StructField("camera_matrix", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("distortion_coeffs", T.ArrayType(T.DoubleType())),
    ])),
    T.StructField("distortion_model", T.StringType()),
])

TREE = T.StructType([T.StructField("tree", T.ArrayType(T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("type", T.StringType()),
])))])


def read_profile_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, document, sha256) of profile files, one row per file."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
        .select("path", F.col("content").cast("string").alias("document"),
                F.sha2("content", 256).alias("sha256"))
    )


def parse_profiles(documents: DataFrame, key: str = "path") -> DataFrame:
    """Profile documents as rows; `error` says why one is refused."""
    p = parsed_once(F.from_json("document", PROFILE))
    flat = documents.select(key, p.alias("p")).select(
        key, F.col("p").isNotNull().alias("_parsed"),
        F.col("p.name").alias("name"),
        F.trim(F.concat_ws(" ", F.coalesce("p.camera_brand", F.lit("")),
                           F.coalesce("p.camera_model", F.lit("")))).alias("camera"),
        F.coalesce("p.calib_dimension.w", F.lit(0)).alias("calib_w"),
        F.coalesce("p.calib_dimension.h", F.lit(0)).alias("calib_h"),
        F.coalesce("p.fps", F.lit(0.0)).alias("fps"),
        F.col("p.fisheye_params.camera_matrix").alias("camera_matrix"),
        F.coalesce("p.fisheye_params.distortion_coeffs",
                   F.array().cast("array<double>")).alias("coeffs"),
        F.coalesce("p.input_horizontal_stretch", F.lit(1.0)).alias("stretch_x"),
        F.coalesce("p.input_vertical_stretch", F.lit(1.0)).alias("stretch_y"))
    error = (F.when(~F.col("_parsed"), "profile does not parse")
             .when(F.size("coeffs") == 0, "no distortion coefficients")
             .when((F.col("calib_w") <= 0) | (F.col("calib_h") <= 0), "no calibration dimensions"))
    return flat.withColumn("error", error).drop("_parsed").select(
        "*", F.get(F.get("camera_matrix", F.lit(0)), F.lit(0)).alias("k00"),
        F.get(F.get("camera_matrix", F.lit(1)), F.lit(1)).alias("k11"))


def scan_lens_profiles(documents: DataFrame, key: str = "path") -> DataFrame:
    """The usable profiles."""
    return parse_profiles(documents, key).filter("error is null").drop("error")


def rejected_profiles(documents: DataFrame, key: str = "path") -> DataFrame:
    return parse_profiles(documents, key).filter("error is not null").select(key, "error")


def scan_profile_index(listings: DataFrame) -> DataFrame:
    """Catalogue paths from repository tree listings (document)."""
    node = F.explode(F.from_json("document", TREE)["tree"])
    return (
        listings.select(node.alias("n"))
        .filter((F.col("n.type") == "blob") & ascii_lower(F.col("n.path")).endswith(".json"))
        .select(F.col("n.path").alias("path"))
        .orderBy("path")
    )


def search(index: DataFrame, query: str) -> DataFrame:
    return index.filter(matches_terms(F.col("path"), query))


def search_top(index: DataFrame, query: str, limit: int = P.SEARCH_LIMIT) -> DataFrame:
    """The first hits in index order."""
    return search(index, query).orderBy("path").limit(limit)


#: Longest piece of a path that is looked up; a longer term is looked up by its pieces.
GRAM = 3


def _grams(text: Column, sizes: range) -> Column:
    """The distinct pieces of a text; the empty piece is in every text."""
    return F.array_distinct(F.concat(F.array(F.lit("")), *[_pieces(text, n) for n in sizes]))


def _pieces(text: Column, size: int) -> Column:
    places = F.sequence(F.lit(1), F.length(text) - (size - 1))
    return F.when(F.length(text) >= size, F.transform(places, lambda i: F.substring(text, i, F.lit(size)))).otherwise(
        F.array().cast("array<string>"))


def search_index(index: DataFrame) -> DataFrame:
    """Postings of a catalogue, stored: (gram, path, hay, n) with n, how many paths have the gram.

    The longest lists are those of the shortest pieces, which only terms of one or two characters look up.
    """
    paths = index.select("path", ascii_lower(F.col("path")).alias("hay"))
    postings = paths.select("path", "hay", F.explode(_grams(F.col("hay"), range(1, GRAM + 1))).alias("gram"))
    counted = materialise(postings, "postings")
    return counted.join(counted.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram")


def search_many(postings: DataFrame, searches: DataFrame) -> DataFrame:
    """(search_id, path) of every hit of many searches (search_id, query) at once.

    Each search goes to the shortest posting list that any piece of its terms has, and what is listed there is
    checked against all its terms.  A piece that no path has ends a search.  No search scans the catalogue.
    """
    terms = searches.select("search_id", terms_of(F.col("query")).alias("terms"))
    size = F.col("n")
    looked_up = terms.withColumn("gram", F.explode(F.array_union(F.array(F.lit("")), F.flatten(F.transform("terms", _looked_up)))))
    lengths = postings.select("gram", "n").distinct()
    shortest = looked_up.join(lengths, "gram", "left").groupBy("search_id").agg(
        F.any_value("terms").alias("terms"), F.min_by("gram", F.struct(F.coalesce(size, F.lit(0)), F.length("gram"), "gram")).alias("gram"))
    hits = shortest.join(postings.select("gram", "path", "hay"), "gram")
    return hits.where(F.forall("terms", lambda t: F.contains(F.col("hay"), t))).select("search_id", "path")


def _looked_up(term: Column) -> Column:
    """A short term itself, or the pieces of a long one."""
    return F.when(F.length(term) <= GRAM, F.array(term)).otherwise(_pieces(term, GRAM))
