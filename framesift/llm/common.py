"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: One character class, as the contracts state it: a word is a run of anything else.
WHITE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over `value`, which is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free_name(taken: list[str], name: str) -> str:
    """A column name that clashes with none of `taken` (column names ignore case)."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = f"{name}_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
