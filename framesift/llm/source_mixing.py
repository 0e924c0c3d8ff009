r"""Mixing sources to target weights by Poisson replication.

A source with `size` of all text and weight share `w` is to be repeated `rate = w * total / size` times.
Each document gets a whole number of copies from the Poisson distribution with that mean: a hash of its
id and the seed is taken as a uniform number and the distribution is inverted at it.  Documents are
exploded by their counts and the copies are dealt over all partitions and ordered by another hash.

Rates are one small row per source, from a partial aggregate.  They are stored, measured, and sent to all tasks if they are
small, as any number of sources that a person could weigh is; so only the copies are moved, once.  Beyond that the join is
left to Catalyst, which splits a hot source.  The copies go to as many partitions as their text asks for.

Defined results: a null source is a source of its own; a null or empty text counts nothing, and a source
without any text has rate 0, so its documents go; a null id counts as the empty text for the hashes; rows
repeated in the input get equal counts; empty input gives empty output.  Column names that are needed
inside are chosen so that they clash with none of the input.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from framesift.llm.common import free_name, partitions
from framesift.session import broadcast_if_small, materialise

SEED = 20240
#: Without given weights a source weighs its size to this power: small sources are repeated, large ones thinned.
TEMPERATURE = 0.7
#: Code points of text in a partition of the result, about.
PARTITION_CHARS = 32 << 20
#: 52 bits of the hash are used, so the uniform number is at most 1 - 2**-52 and exact as a double.
BITS = 52


def uniform(key: Column, salt: str) -> Column:
    """A number in [0, 1) that depends on the key and the salt alone."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{salt}")))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("double") / F.lit(float(1 << BITS))


def copies(rate: Column, u: Column) -> Column:
    """The smallest k whose Poisson probability of at most k exceeds u.

    The terms are summed from k = 0, so the loop ends where the sum passes u; rates of hundreds are
    summed on a logarithmic scale and reach far enough for any u below 1 - 2**-52.
    """
    top = F.ceil(rate + F.sqrt(rate) * 12 + 40).cast("int")
    start = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), (F.exp(-rate) <= u).cast("int").alias("n"))

    def step(a: Column, k: Column) -> Column:
        log = a["log"] + F.log(rate) - F.log(k.cast("double"))
        total = a["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), (a["n"] + (total <= u).cast("int")).alias("n"))
    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), top), start, step, lambda a: a["n"])).otherwise(0)


def rates(docs: DataFrame, source: str, text: str, weights: dict[str, float] | None, temperature: float) -> DataFrame:
    """(source, size, rate) for every source."""
    sizes = (docs.groupBy(F.col(f"`{source}`").alias("source"))
             .agg(F.sum(F.coalesce(F.length(f"`{text}`"), F.lit(0))).cast("double").alias("size")))
    if weights is None:
        weight = F.when(F.col("size") > 0, F.pow("size", F.lit(temperature))).otherwise(0.0)
    else:
        if any(not math.isfinite(v) or v < 0 for v in weights.values()):
            raise ValueError("weights must be finite and not negative")
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source") == name, F.lit(float(value))).otherwise(weight)
        weight = F.when(F.col("size") > 0, weight).otherwise(0.0)
    sizes = sizes.withColumn("weight", weight)
    total = sizes.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    # One row, made by an aggregate without keys: the join with it is a broadcast of that row.
    return sizes.join(F.broadcast(total)).select(
        "source", "size", F.when((F.col("size") > 0) & (F.col("all_weight") > 0),
                         F.col("weight") / F.col("all_weight") * F.col("all_size") / F.col("size"))
        .otherwise(0.0).alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, seed: int = SEED,
        source: str = "source", text: str = "text", key: str = "doc_id", copy: str | None = None) -> DataFrame:
    """The documents in their new numbers, in a random order over all partitions.

    `copy` names a column to add with the number of the copy, from 0.
    """
    names = [f"`{c}`" for c in docs.columns]
    s, r, n, o = (free_name(docs.columns, x) for x in ("_source", "_rate", "_copy", "_order"))
    known = materialise(rates(docs, source, text, weights, temperature), "rates")
    chars = known.agg(F.sum(F.col("size") * F.col("rate"))).first()[0] or 0.0
    found = broadcast_if_small(known.select(F.col("source").alias(s), F.col("rate").alias(r)))
    joined = docs.join(found, F.col(f"`{source}`").eqNullSafe(F.col(s)), "left")
    count = copies(F.coalesce(F.col(r), F.lit(0.0)), uniform(F.col(f"`{key}`"), f"{seed}:count"))
    # Counts first, and rows without a copy go before anything is moved.
    c = free_name(docs.columns, "_count")
    counted = joined.select(*names, count.alias(c)).where(F.col(c) > 0)
    exploded = counted.select(*names, F.explode(F.sequence(F.lit(0), F.col(c) - 1)).alias(n))
    order = F.xxhash64(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.col(n), F.lit(seed))
    parts = max(partitions(docs.sparkSession), math.ceil(chars / PARTITION_CHARS))
    dealt = (exploded.withColumn(o, order).repartition(parts, o)
             .sortWithinPartitions(o))
    return dealt.select(*names, *([F.col(n).alias(copy)] if copy else []))
