"""File names, search terms and number formats."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql import types as T



def image_name(stem: Column, index: Column, ext: Column | str) -> Column:
    """`stem_000123.ext`; longer numbers are not cut."""
    ext = F.lit(ext) if isinstance(ext, str) else ext
    return F.format_string("%s_%06d.%s", stem, index, ext)


def image_ext(fmt: Column) -> Column:
    return F.when(fmt == "png", F.lit("png")).otherwise(F.lit("jpg"))


def file_stem(path: Column, default: str = "clip") -> Column:
    """File name without its last extension; a leading dot belongs to the name."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    stem = F.regexp_replace(name, r"(.)\.[^.]*$", "$1")
    return F.when(name == "", F.lit(default)).otherwise(stem)


def extension(path: Column) -> Column:
    """Lower-case extension, empty when there is none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def terms(query: str) -> list[str]:
    return [t.translate(_ASCII_LOWER) for t in query.split()]


_ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(query: Column) -> Column:
    """The search terms of a text column."""
    return F.filter(F.split(ascii_lower(query), r"(?U)\s+"), lambda t: t != "")


def matches_terms(path: Column, query: str) -> Column:
    """Every term is contained in the path; no terms match everything."""
    hay = ascii_lower(path)
    found = F.lit(True)
    for t in terms(query):
        found = found & hay.contains(t)
    return found


@F.arrow_udf(T.StringType())
def plain_number(values: pa.Array) -> pa.Array:
    """Shortest decimal that reads back the same, never with an exponent."""
    return pa.array([None if v is None else np.format_float_positional(v, trim="-")
                     for v in values.to_pylist()], pa.string())


def parsed_once(document: Column) -> Column:
    """A parsed document as a generated row, so that filters on its fields are not
    rewritten into filters that each parse it again."""
    return F.explode(F.array(document))


def mask_path(folder: str, name: Column) -> Column:
    return F.concat(F.lit(f"{folder}/"), name, F.lit(".png"))
