r"""Near duplicates of embeddings: iterative quantisation, multi-index Hamming tables, exact reranking.

* A rotation is learnt from a bounded sample of the vectors by iterative quantisation (principal axes, then
  alternately the signs of the rotated vectors and the rotation that comes closest to them), so that bits are
  balanced and close to the vectors.  Several rotations from different starts give as many bits as needed.
  Vectors are not centred first: bits must follow the angle between vectors, also where all vectors lean to
  one side (bits are then less balanced, which costs comparisons and not links).
* The bits are cut into tables of `s` bits, about log2 of the number of vectors.  A vector enters each table
  under its own bits and under these with one zero bit set, so two vectors meet in a table when they differ
  there in at most one bit.  So many tables are used that a pair at the threshold itself meets in one of them
  with a probability of at least TARGET; closer pairs meet with more.
* Where vectors meet, their whole codes rule out most by Hamming distance.  What is left is compared in
  double precision with the original vectors, in blocks of a run's members: a pair counts in the first table
  in which it meets, so it is counted once, and what leaves a block is a count and a label for each vector.
  No pairs are written, and a run of any size is split into blocks of BLOCK vectors, without a cap: its members are
  handed on once, and Spark deals out the pairs of blocks.

Equal vectors are one node with a weight from the start (known by a 64-bit hash of all components).

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing
and are their own component; vectors of different length never link; each input row is a vector, so repeated
rows link with each other; a null id is a component of its own unless linked, and then takes the smallest id
there; empty input gives empty output; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from framesift.llm.components import components
from framesift.llm.packed import SCHEMA, Packer, bucket_count, runs, unpack
from framesift.llm.text import mix64
from framesift.session import materialise

THRESHOLD = 0.9
#: Chance that a pair exactly at the threshold is found.
TARGET = 0.96
SAMPLE_VALUES = 1_000_000
ROUNDS = 30
#: Bits of one rotation at most.
ROTATION_BITS = 512
BLOCK = 1024
#: A longer run is compared without looking at codes first.
PAIRED = 2048


@dataclass(frozen=True)
class Codes:
    rotations: np.ndarray   # (d, bits)
    width: int              # bits of a table
    tables: int
    radius: int             # whole codes of similar vectors differ in no more bits

    def of(self, unit: np.ndarray) -> np.ndarray:
        """(n, tables) table values of unit vectors."""
        bits = (unit @ self.rotations > 0)[:, :self.width * self.tables]
        weight = np.uint32(1) << np.arange(self.width, dtype=np.uint32)
        return (bits.reshape(len(unit), self.tables, self.width) * weight).sum(axis=2, dtype=np.uint32)


def unit_vectors(column: pa.Array) -> np.ndarray:
    """The vectors of a list column in double precision, of length one; all are finite and not zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros((0, 1))
    found = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    found = found / np.abs(found).max(axis=1, keepdims=True)
    return found / np.sqrt((found * found).sum(axis=1, keepdims=True))


def flip_chance(cosine: float) -> float:
    return math.acos(cosine) / math.pi


def tables_for(width: int, flip: float, target: float = TARGET) -> int:
    meet = (1 - flip) ** width + width * flip * (1 - flip) ** (width - 1)
    return max(1, math.ceil(math.log(1 - target) / math.log(1 - meet)))


def learn(sample: np.ndarray, vectors: int, threshold: float = THRESHOLD, seed: int = 5) -> Codes:
    """Rotations from a sample of unit vectors, for tables that suit the number of vectors."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    flip = flip_chance(threshold)
    width = min(30, max(8, math.ceil(math.log2(max(vectors, 2)))))
    tables = tables_for(width, flip)
    bits = width * tables
    _, axes = np.linalg.eigh(sample.T @ sample)
    axes = axes[:, ::-1]
    if d > ROTATION_BITS:
        # All axes have a part in every rotation, so that angles within one are those of whole vectors.
        axes = axes @ np.linalg.qr(rng.standard_normal((d, d)))[0]
    parts = []
    while sum(p.shape[1] for p in parts) < bits:
        some = axes if d <= ROTATION_BITS else axes[:, rng.permutation(d)[:ROTATION_BITS]]
        short = sample @ some
        turn, _ = np.linalg.qr(rng.standard_normal((some.shape[1],) * 2))
        for _ in range(ROUNDS):
            near = np.where(short @ turn > 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(near.T @ short)
            turn = (left @ right).T
        parts.append(some @ turn)
    spread = math.sqrt(bits * flip * (1 - flip))
    # Bits of one rotation depend on each other, so the bound is wide; unrelated vectors differ in half of them.
    return Codes(np.concatenate(parts, axis=1), width, tables, int(min(bits * 0.42, bits * flip + 6 * spread)))


def _kind(tables: int) -> np.dtype:
    return np.dtype([("key", "<u4"), ("node", "<i8"), ("table", "u1"), ("own", "u1"), ("code", "<u4", (tables,))])


def _enter(shared, buckets: int):
    """A vector's entries: its own value in each table, and each value with one zero bit set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = shared.value
        packer = Packer(_kind(codes.tables), buckets)
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                node = part.column(0).to_numpy()
                code = codes.of(unit_vectors(part.column(1)))
                for t in range(codes.tables):
                    salt = np.uint64((t + 1) << 40)
                    yield from packer.add(mix64(code[:, t].astype(np.uint64) + salt), node=node, table=t, own=1, code=code)
                    for b in range(codes.width):
                        zero = (code[:, t] >> np.uint32(b)) & np.uint32(1) == 0
                        value = (code[zero, t] | np.uint32(1 << b)).astype(np.uint64)
                        yield from packer.add(mix64(value + salt), node=node[zero], table=t, own=0, code=code[zero])
        yield from packer.flush()
    return run


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _first_meeting(a: np.ndarray, b: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether rows of codes differ by more than one bit in each table before `table`."""
    far = _apart(a, b) > 1
    far |= np.arange(a.shape[-1]) >= np.asarray(table)[..., None]
    return far.all(axis=-1)


def _groups(tables: int, radius: int):
    """The members of a bucket's runs that may have a link there, as blocks (run, i, j) to compare."""
    kind, paired, size = _kind(tables), PAIRED, BLOCK

    def run(found: pa.Table) -> pa.Table:
        rows = unpack(found.column("block"), kind)
        first, length = runs(rows["key"])
        group = np.repeat(np.arange(len(first)), length)
        wanted = length[group] > paired
        short = np.flatnonzero((rows["own"] == 1) & (length[group] > 1) & ~wanted)
        # Each own entry against all entries of its run, in portions of bounded size.
        reach = length[group[short]]
        cut = np.searchsorted(np.cumsum(reach), np.arange(0, int(reach.sum()) + 1, 1 << 19), "left")
        for lo, hi in zip(cut, np.append(cut[1:], len(short))):
            mine, n = short[lo:hi], reach[lo:hi]
            if not len(mine):
                continue
            x = np.repeat(mine, n)
            y = np.repeat(first[group[mine]], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            ok = x != y
            x, y = x[ok], y[ok]
            ok = _apart(rows["code"][x], rows["code"][y]).sum(axis=1) <= radius
            x, y = x[ok], y[ok]
            ok = _first_meeting(rows["code"][x], rows["code"][y], rows["table"][x])
            wanted[x[ok]] = True
            wanted[y[ok]] = True
        at = np.flatnonzero(wanted)
        own_run = group[at]
        start = np.searchsorted(own_run, own_run)
        block = (np.arange(len(at)) - start) // size
        blocks = (np.searchsorted(own_run, own_run, "right") - start - 1) // size + 1
        rows = rows[at]
        number = (int(found.column("bucket")[0].as_py()) << 32) + rows["key"].astype(np.int64)
        return pa.table({
            "run": pa.array(number, pa.int64()), "block": pa.array(block, pa.int32()), "blocks": pa.array(blocks, pa.int32()),
            "node": pa.array(rows["node"], pa.int64()), "table_no": pa.array(rows["table"].astype(np.int32)), "own": pa.array(rows["own"] == 1),
            "code": pa.array([c.tobytes() for c in np.ascontiguousarray(rows["code"])], pa.binary())})
    return run


GROUPS = "run long, block int, blocks int, node long, table_no int, own boolean, code binary"


def _joined(link: np.ndarray) -> np.ndarray:
    """Smallest member of each member's component, from a symmetric matrix of links."""
    label = np.arange(len(link))
    while True:
        low = np.where(link, label, len(link)).min(axis=1, initial=len(link))
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(threshold: float):
    """Counts of links and local components over the blocks of a slot, as (node, links, low)."""
    def run(found: pa.Table) -> pa.Table:
        found = found.sort_by([("run", "ascending"), ("i", "ascending"), ("j", "ascending"), ("node", "ascending")])
        number = np.rec.fromarrays([found.column(n).to_numpy() for n in ("run", "i", "j")])
        unit = unit_vectors(found.column("v"))
        node, weight = found.column("node").to_numpy(), found.column("weight").to_numpy()
        own = found.column("own").to_numpy()
        second = found.column("second").to_numpy()
        table = found.column("table_no").to_numpy()
        code = np.frombuffer(b"".join(found.column("code").to_pylist()), np.uint32).reshape(len(node), -1)
        edge = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        out = [], [], []
        for a, b in zip(edge, np.append(edge[1:], len(node))):
            if b - a < 2:
                continue
            same = number["f1"][a] == number["f2"][a]
            link = unit[a:b] @ unit[a:b].T >= threshold
            np.fill_diagonal(link, False)
            link &= own[a:b, None] | own[None, a:b]
            if not same:
                link &= second[a:b, None] != second[None, a:b]
            x, y = np.nonzero(np.triu(link))
            ok = _first_meeting(code[a + x], code[a + y], table[a + x])
            x, y = x[ok], y[ok]
            if not len(x):
                continue
            link[:] = False
            link[x, y] = link[y, x] = True
            label = _joined(link)
            count = link @ weight[a:b]
            have = np.flatnonzero(count)
            out[0].append(node[a + have])
            out[1].append(count[have])
            out[2].append(node[a + label[have]])
        columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        return pa.table([pa.array(c.astype(np.int64), pa.int64()) for c in columns], ["node", "links", "low"])
    return run


def _linked(nodes: DataFrame, threshold: float) -> DataFrame | None:
    """(node, links, low) over the blocks of all runs of nodes (node, weight, v) of one length."""
    spark = nodes.sparkSession
    count = nodes.count()
    if count < 2:
        return None
    length = nodes.select(F.size("v")).first()[0]
    share = min(1.0, max(SAMPLE_VALUES // length, 2 * ROTATION_BITS) / count)
    sample = nodes.where(F.pmod(F.xxhash64("node", F.lit("sample")), F.lit(1 << 30)) <= int(share * (1 << 30))).select("node", "v")
    found = sample.toArrow().sort_by("node")
    codes = learn(unit_vectors(found.column("v")) if len(found) else np.eye(1, length), count, threshold)
    shared = spark.sparkContext.broadcast(codes)
    buckets = bucket_count(spark, count * codes.tables * (1 + codes.width // 2))
    entries = nodes.select("node", "v").mapInArrow(_enter(shared, buckets), SCHEMA)
    groups = materialise(entries.groupBy("bucket").applyInArrow(_groups(codes.tables, codes.radius), GROUPS), "groups")
    # A member of a block is needed against every block of its run.
    met = groups.agg(F.sum("blocks")).first()[0] or 0
    slots = max(spark.sparkContext.defaultParallelism, -(-met // 4096))
    pairs = groups.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("run", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                         (F.col("block") >= F.col("other")).alias("second"), "node", "table_no", "own", "code")
    slot = F.pmod(F.xxhash64("run", "i", "j"), F.lit(slots)).cast("int").alias("slot")
    full = pairs.select(slot, "*").join(nodes, "node")
    return full.groupBy("slot").applyInArrow(_compare(threshold), "node long, links long, low long")


def near_duplicates(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id",
                    threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    v = F.col("v")
    fine = (v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
            & F.exists(v, lambda x: x != 0))
    rows = (vectors.select(F.col(f"`{key}`").alias("vec_id"), F.col(f"`{vector}`").alias("v"))
            .select("vec_id", F.when(fine, v).alias("v")).withColumn("node", F.when(v.isNotNull(), F.xxhash64("v"))))
    nodes = materialise(rows.where("node IS NOT NULL").groupBy("node").agg(
        F.min("vec_id").alias("low_id"), F.count("*").alias("weight"), F.first("v").alias("v")), "nodes")
    parts = []
    for (length,) in nodes.select(F.size("v")).distinct().collect():  # one but for mixed tables
        found = _linked(nodes.where(F.size("v") == length).select("node", "weight", "v"), threshold)
        if found is not None:
            parts.append(found)
    ids = rows.select("vec_id", "node")
    if not parts:
        stats = nodes.select("node", (F.col("weight") - 1).alias("n_links"), F.col("low_id").alias("component_id"))
    else:
        found = parts[0]
        for more in parts[1:]:
            found = found.union(more)
        found = materialise(found, "links")
        counts = found.groupBy("node").agg(F.sum("links").alias("links"))
        joined = components(found.select(F.col("node").alias("a"), F.col("low").alias("b")))
        whole = materialise(
            nodes.select("node", "weight", "low_id").join(counts, "node", "left").join(joined, "node", "left")
            .select("node", "low_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                    F.coalesce("component", "node").alias("component")), "counts")
        low = whole.groupBy("component").agg(F.min("low_id").alias("component_id"))
        stats = whole.join(low, "component").select("node", "n_links", "component_id")
    # Vectors without links get keys of their own, so that they do not meet in one task.
    ids = ids.withColumn("node", F.coalesce("node", F.xxhash64("vec_id", F.lit("none"))))
    alone = F.coalesce("component_id", "vec_id")
    return ids.join(stats, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), alone.alias("component_id"),
        F.col("vec_id").eqNullSafe(alone).alias("kept"))
