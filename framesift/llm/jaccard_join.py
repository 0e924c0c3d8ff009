r"""N-gram Jaccard join by universe-partition pigeonhole, exact.

Documents are sets of word shingles.  Two sets with Jaccard similarity of at least 3/4 differ in at most
(|a| + |b|) / 7 shingles.  For each band of sizes the shingles' hash range is cut into segments; so few
differences cannot touch all segments, and two similar sets agree on the subsets that fall into the others.

* Allocation.  A segment is matched exactly (touched by one difference) or up to one difference (touched by
  two): then a set indexes its subset there and each subset less one shingle, its one-deletion
  neighbourhood.  Which kinds a band uses is the cheapest for a sample of its sets, by rows and expected
  meetings of unrelated sets.
* A band has more segments than the differences can touch, so each set leaves out its most expensive exact
  segments.  All sets rank subsets by one order (how common the rarest shingle is in a sample, then a
  hash).  Of the subsets that two similar sets share, the lowest in that order is left out by neither: in
  both, at least as many others rank above it as are left out.  Sample and order affect the cost only.
* Sets that share a key meet in a bucket.  A key's sets are first compared with the smallest of them, their
  leader; verified links make components.  Where a leader's sets still lie in several components, pairs of
  different components are compared too, each pair with the first leader that it has in common, in blocks of
  bounded size that hand on only the pairs not yet ruled out.  So every pair that shares a key is compared
  or is connected, and a key with a thousand near copies costs a thousand exact comparisons and not a million.
* Comparisons are exact: sizes first, then counts of shingles by cell (which bound the difference from
  below), by few cells and then by many, then the sets, which so travel for hardly any pair that is not linked.

Equal sets are one node from the start.  A shingle is known by 64 bits and a set by the sum of 64 mixed bits:
among n sets about n^2 / 2^65 pairs would be taken for equal by chance.

Defined results: a null or empty text, or one without words, has 0 shingles and is alone; fewer than five
words are one shingle; rows with equal sets, repeated rows included, are in one component, and each row of
the input has a row in the output; ties do not matter; empty input gives empty output; other columns are
ignored by `links` and passed through by `keep_one`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from framesift.llm.common import free_name, partitions
from framesift.llm.components import components
from framesift.llm.packed import SCHEMA, Packer, bucket_count, runs, unpack
from framesift.llm.text import buffers, distinct, mix64, shingles, slices
from framesift.session import materialise

SHINGLE = 5
#: Similarity of at least PERCENT / 100.
PERCENT = 75
#: Each band ends at twice the size of the one before.
BAND = 2
#: Segments of a band as a share of its largest set; differences can touch 2/7 of it.
SEGMENTS = 0.36
#: Shingles of the sample that costs are estimated on (of whole sets), and common shingles that are sent out.
SAMPLE_SHINGLES = 1_500_000
COMMON = 200_000
#: Bands up to this size are tried with one-deletion neighbourhoods too.
SMALL = 64
#: What one meeting of two unrelated sets costs, in rows.
MEETING = 8.0
#: Cells a set is counted by, as a share of its shingles: few for all sets, many for those that come near.
COARSE, FINE = 1 / 6, 1 / 2
LEAST_CELLS = 64
#: Sets of a key that are compared with each other together.
BLOCK = 2048

_SEGMENT, _CONTENT, _SET, _CELL = (np.uint64(x) for x in (
    0x9AE16A3B2F90404F, 0xC949D7C7509E6557, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
#: The half of a key within its bucket, and the set it belongs to.
KIND = np.dtype([("key", "<u4"), ("node", "<i8")])


def differences(a: int, b: int) -> int:
    """How many shingles sets of these sizes may have on one side only and still be similar."""
    return (a + b) * (100 - PERCENT) // (100 + PERCENT)


@dataclass(frozen=True)
class Band:
    low: int        # the larger set of a pair is above this
    high: int       # and not above this
    exact: int      # segments matched exactly
    deleted: int    # segments matched up to one difference

    def takes(self, size: np.ndarray) -> np.ndarray:
        return (size * 100 >= (self.low + 1) * PERCENT) & (size <= self.high) & (size > 0)

    def kept(self, size: np.ndarray) -> np.ndarray:
        """Exact segments that a set of this size must index."""
        partner = np.minimum(self.high, size * 100 // PERCENT)
        touched = (size + partner) * (100 - PERCENT) // (100 + PERCENT)
        return np.clip(touched + 1 - 2 * self.deleted, 0, self.exact)


def bands(largest: int) -> list[Band]:
    out, low = [], 0
    while low < largest:
        high = max(low + 1, low * BAND)
        out.append(exact_band(low, high))
        low = high
    return out


def exact_band(low: int, high: int, deleted: int = 0) -> Band:
    need = differences(high, high) + 1
    spare = max(3, int(high * SEGMENTS) - need)
    return Band(low, high, max(0, need + spare - 2 * deleted), deleted)


def keys(band: Band, number: int, values: np.ndarray, offsets: np.ndarray, common: tuple[np.ndarray, np.ndarray]
         ) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the index rows of sets (sorted distinct shingles with offsets) that the band takes."""
    size = np.diff(offsets)
    own = np.flatnonzero(band.takes(size))
    if not len(own):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = size[own]
    row = np.repeat(np.arange(len(own)), n)
    at = np.arange(len(row)) + np.repeat(offsets[own] - np.append(0, np.cumsum(n)[:-1]), n)
    shingle = values[at]
    slots = band.exact + 2 * band.deleted
    salt = np.uint64(number * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    slot = ((mix64(shingle ^ _SEGMENT ^ salt) >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
    segment = np.where(slot < 2 * band.deleted, slot // 2, slot - band.deleted)
    total = band.deleted + band.exact
    content = mix64(shingle ^ _CONTENT)
    cost = np.zeros(len(shingle), np.int64)
    if len(common[0]):
        place = np.minimum(np.searchsorted(common[0], shingle), len(common[0]) - 1)
        cost = np.where(common[0][place] == shingle, common[1][place], 0)
    order = np.argsort(row * total + segment, kind="stable")
    group = (row * total + segment)[order]
    first = np.flatnonzero(np.diff(group, prepend=-1))
    subset = np.add.reduceat(content[order], first)
    cheapest = np.minimum.reduceat(cost[order], first)
    group = group[first]
    g_row, g_segment = group // total, group % total

    def named(segment: np.ndarray, subset: np.ndarray) -> np.ndarray:
        return mix64(subset + mix64(segment.astype(np.uint64) + salt))
    rows, found = [], []
    exact = g_segment >= band.deleted
    # Exact segments in the common order; empty ones come last and are indexed only by sets that need them.
    e_row, e_segment, e_subset, e_cost = g_row[exact], g_segment[exact], subset[exact], cheapest[exact]
    name = named(e_segment, e_subset)
    rank = np.lexsort((name, e_cost, e_row))
    e_row, name = e_row[rank], name[rank]
    have = np.bincount(e_row, minlength=len(own))
    place = np.arange(len(e_row)) - np.repeat(np.append(0, np.cumsum(have)[:-1]), have)
    keep = band.kept(n)
    chosen = place < keep[e_row]
    rows.append(e_row[chosen])
    found.append(name[chosen])
    for r in np.flatnonzero(have < keep):
        empty = np.setdiff1d(np.arange(band.deleted, total), e_segment[g_row[exact] == r])
        name = np.sort(named(empty, np.zeros(len(empty), np.uint64)))[:keep[r] - have[r]]
        rows.append(np.full(len(name), r))
        found.append(name)
    if band.deleted:
        for s in range(band.deleted):
            there = g_segment == s
            whole = np.zeros(len(own), np.uint64)
            whole[g_row[there]] = subset[there]
            rows.append(np.arange(len(own)))
            found.append(named(np.full(len(own), s), whole))
            one = segment == s
            rows.append(row[one])
            found.append(named(np.full(int(one.sum()), s), whole[row[one]] - content[one]))
    return own[np.concatenate(rows)], np.concatenate(found)


def _sets(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """(first row, sets, nodes) over slices of a column of texts; the node of an empty set is 0."""
    data, offsets = buffers(column)
    for lo, hi in slices(offsets):
        values, where = shingles(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], SHINGLE)
        sets = list(distinct(values, where))
        nodes = np.array([np.add.reduce(mix64(s ^ _SET)) if len(s) else 0 for s in sets], np.uint64)
        yield lo, sets, nodes.view(np.int64)


def _cells(found: np.ndarray, share: float) -> bytes:
    """Shingles by cell; the number of cells is a power of two, so counts of sets of other sizes can be folded."""
    bits = max(LEAST_CELLS.bit_length() - 1, math.ceil(math.log2(max(len(found) * share, 1))))
    cell = (mix64(found ^ _CELL) >> np.uint64(64 - bits)).astype(np.int64)
    return np.minimum(np.bincount(cell, minlength=1 << bits), 255).astype(np.uint8).tobytes()


def _folded(counts: bytes, cells: int) -> np.ndarray:
    """The counts over fewer cells: neighbours are added up."""
    found = np.frombuffer(counts, np.uint8).astype(np.int32)
    return found if len(found) == cells else found.reshape(cells, -1).sum(axis=1)


def _possible(cells_a, cells_b, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether cell counts leave it open that the sets are similar: they differ in no more shingles than sets
    may.  Counts saturate at 255, which only lowers the bound."""
    out = np.zeros(len(n_a), bool)
    for k, (x, y) in enumerate(zip(cells_a, cells_b)):
        cells = min(len(x), len(y))
        out[k] = np.abs(_folded(x, cells) - _folded(y, cells)).sum() * (100 + PERCENT) <= (n_a[k] + n_b[k]) * (100 - PERCENT)
    return out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, node, cells = [], [], []
        for _, sets, nodes in _sets(batch.column(2)):
            n += [len(s) for s in sets]
            node += nodes.tolist()
            cells += [_cells(s, COARSE) for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64()),
                                          pa.array(cells, pa.binary())], ["doc_id", "tag", "n_shingles", "node", "cells"])


def _pick(limit: int):
    """The sets whose node falls into the sample, once for each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets, nodes in _sets(batch.column(0)):
                own = [i for i in np.flatnonzero(mix64(nodes.view(np.uint64)) >> np.uint64(34) < limit) if len(sets[i])]
                yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array([sets[i].tobytes() for i in own], pa.binary())],
                                                 ["node", "shingles"])
    return run


def _index(plan: list[Band], common, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seen = Packer(KIND, buckets), set()
        for batch in batches:
            for _, sets, nodes in _sets(batch.column(0)):
                own = []
                for i, node in enumerate(nodes.tolist()):
                    if len(sets[i]) and node not in seen:  # copies in one task are indexed once
                        seen.add(node)
                        own.append(i)
                if not own:
                    continue
                where = np.concatenate(([0], np.cumsum([len(sets[i]) for i in own])))
                values, node = np.concatenate([sets[i] for i in own]), nodes[own]
                for number, band in enumerate(plan):
                    row, key = keys(band, number, values, where, common.value)
                    if len(row):
                        yield from packer.add(key, node=node[row])
        yield from packer.flush()
    return run


def _meet(table: pa.Table) -> pa.Table:
    """The sets of a bucket that share a key, as (leader, node): the leader is the smallest node with the key."""
    rows = unpack(table.column("block"), KIND)
    first, length = runs(rows["key"])
    many = length > 1
    first, others = first[many], length[many] - 1
    leader = np.repeat(rows["node"][first], others)
    at = np.repeat(first + 1, others) + np.arange(int(others.sum())) - np.repeat(np.cumsum(others) - others, others)
    out = np.unique(np.stack([leader, rows["node"][at]], axis=1), axis=0)
    return pa.table([pa.array(np.ascontiguousarray(c), pa.int64()) for c in out.T], ["leader", "node"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n_a, n_b) of the pairs (a, b, n_a, n_b, cells of a, cells of b) that their cells do not rule out."""
    for batch in batches:
        keep = _possible(batch.column(4).to_pylist(), batch.column(5).to_pylist(), batch.column(2).to_numpy(),
                         batch.column(3).to_numpy())
        yield pa.RecordBatch.from_arrays(batch.columns[:4], ["a", "b", "n_a", "n_b"]).filter(pa.array(keep))


def _of_sets(make):
    """(node, value) of the sets of texts, each set of a task once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for _, sets, nodes in _sets(batch.column(0)):
                own = []
                for i, node in enumerate(nodes.tolist()):
                    if node not in seen:
                        seen.add(node)
                        own.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array([make(sets[i]) for i in own], pa.binary())],
                                                 ["node", "value"])
    return run


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the pairs (a, b, shingles of a, shingles of b) that are similar."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(both * 100 >= PERCENT * (len(a) + len(b) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _across(found: pa.Table) -> pa.Table:
    """Pairs of different components in the blocks (leader, i, j) of a slot that sizes and cells do not rule out,
    each pair with the first leader that it has in common."""
    found = found.sort_by([("leader", "ascending"), ("i", "ascending"), ("j", "ascending"), ("node", "ascending")])
    column = {c: found.column(c).to_numpy() for c in ("leader", "i", "j", "node", "component", "n")}
    second = found.column("second").to_numpy()
    new = np.zeros(len(second), bool)
    for c in ("leader", "i", "j"):
        new[1:] |= column[c][1:] != column[c][:-1]
    new[:1] = True
    edge = np.append(np.flatnonzero(new), len(new))
    lists, cells_of = found.column("leaders").combine_chunks(), found.column("cells").to_pylist()
    bounds, leaders_of = lists.offsets.to_numpy(), lists.values.to_numpy()
    out = [], []
    for lo, hi in zip(edge[:-1], edge[1:]):
        n, component = column["n"][lo:hi], column["component"][lo:hi]
        ok = np.triu(component[:, None] != component[None, :], 1)
        if column["i"][lo] != column["j"][lo]:
            ok &= second[lo:hi, None] != second[None, lo:hi]
        ok &= np.minimum(n[:, None], n) * 100 >= np.maximum(n[:, None], n) * PERCENT
        if not ok.any():
            continue
        # Leaders before this one that two members share: their pair is compared there.
        each = [leaders_of[bounds[k]:bounds[k + 1]] for k in range(lo, hi)]
        row = np.repeat(np.arange(hi - lo), [len(r) for r in each])
        earlier = np.concatenate(each)
        row, earlier = row[earlier < column["leader"][lo]], earlier[earlier < column["leader"][lo]]
        _, place, often = np.unique(earlier, return_inverse=True, return_counts=True)
        row, place = row[often[place] > 1], place[often[place] > 1]
        if len(place):
            _, place = np.unique(place, return_inverse=True)
            for a in range(0, int(place.max()) + 1, 2048):
                here = (place >= a) & (place < a + 2048)
                there = np.zeros((hi - lo, 2048), np.float32)
                there[row[here], place[here] - a] = 1
                ok &= (there @ there.T) == 0
        x, y = np.nonzero(ok)
        lengths = np.array([len(c) for c in cells_of[lo:hi]])
        fewest = np.minimum(lengths[x], lengths[y])
        for cells in np.unique(fewest):
            here = np.flatnonzero(lengths >= cells)
            place = np.zeros(hi - lo, np.int64)
            place[here] = np.arange(len(here))
            counts = np.stack([_folded(cells_of[lo + k], int(cells)) for k in here]).astype(np.int16)
            of_these = fewest == cells
            step = max(1, (1 << 24) // int(cells))
            for a in range(0, int(of_these.sum()), step):
                p, q = x[of_these][a:a + step], y[of_these][a:a + step]
                apart = np.abs(counts[place[p]] - counts[place[q]]).sum(axis=1, dtype=np.int64)
                near = apart * (100 + PERCENT) <= (n[p] + n[q]) * (100 - PERCENT)
                out[0].append(column["node"][lo + p[near]])
                out[1].append(column["node"][lo + q[near]])
    columns = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out]
    return pa.table(columns, ["a", "b"])


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b"))


class _Join:
    """One join: the documents (doc_id, text), the nodes they make, and what is known about their links."""

    def __init__(self, docs: DataFrame):
        self.spark = docs.sparkSession
        self.docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("tag"), "text")
        kind = docs.schema["doc_id"].dataType.simpleString()
        self.rows = materialise(self.docs.select("doc_id", "tag", "text").mapInArrow(
            _describe, f"doc_id {kind}, tag long, n_shingles long, node long, cells binary"), "sets")
        self.nodes = materialise(self.rows.where("n_shingles > 0").groupBy("node").agg(
            F.min("tag").alias("tag"), F.first("n_shingles").alias("n"), F.first("cells").alias("cells")), "nodes")

    def _sample(self, total: int, nodes: int) -> tuple[list[np.ndarray], float]:
        share = min(1.0, SAMPLE_SHINGLES / max(total, 1))
        found = self.docs.select("text").mapInArrow(_pick(int(share * (1 << 30)) + 1), "node long, shingles binary")
        rows = found.dropDuplicates(["node"]).toArrow()  # about SAMPLE_SHINGLES shingles
        return [np.frombuffer(s.as_py(), np.uint64) for s in rows.column("shingles")], share

    def _plan(self) -> tuple[list[Band], tuple[np.ndarray, np.ndarray], int]:
        """(bands, common shingles of the sample, index rows to come)."""
        total, largest, count = self.nodes.agg(F.sum("n"), F.max("n"), F.count("*")).first()
        if not count:
            return [], (np.zeros(0, np.uint64), np.zeros(0, np.int64)), 0
        sample, share = self._sample(total, count)
        found, often = np.unique(np.concatenate(sample), return_counts=True) if sample else (np.zeros(0, np.uint64),) * 2
        top = np.sort(np.argsort(-often, kind="stable")[:min(COMMON, int((often > 1).sum()))])
        common = found[top], often[top].astype(np.int64)
        plan = []
        for number, band in enumerate(bands(largest)):
            own = [s for s in sample if band.takes(np.array([len(s)]))[0]]
            if band.high <= SMALL and len(own) > 1:
                values, where = np.concatenate(own), np.concatenate(([0], np.cumsum([len(s) for s in own])))
                best = None
                for deleted in (0, 1, 2):
                    other = exact_band(band.low, band.high, deleted)
                    _, key = keys(other, number, values, where, common)
                    _, often = np.unique(key, return_counts=True)
                    cost = len(key) / len(own) + MEETING * float((often * (often - 1)).sum()) / len(own) / share
                    if best is None or cost < best[0]:
                        best = cost, other
                band = best[1]
            plan.append(band)
        return plan, common, int(total * 0.5)

    def _made(self, asked: DataFrame, make, what: str) -> DataFrame:
        """(node, value) of the sets asked for (node), made from their texts again and stored."""
        tags = materialise(self.nodes.select("node", "tag").join(asked.distinct(), "node", "left_semi").select("tag"), "tags")
        texts = self.docs.join(narrow(tags), "tag", "left_semi").select("text")
        return materialise(texts.mapInArrow(_of_sets(make), "node long, value binary"), what)

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The similar ones of pairs (a, b) of nodes."""
        sizes, kind = ["a", "b", "n_a", "n_b"], "a long, b long, n_a long, n_b long"
        known = self.nodes.select("node", "n", "cells")
        sized = (pairs.join(known.toDF("a", "n_a", "cells_a"), "a").join(known.toDF("b", "n_b", "cells_b"), "b")
                 .where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * PERCENT)
                 .select(*sizes, "cells_a", "cells_b"))
        near = materialise(sized.mapInArrow(_near, kind), "pairs")
        # `a` may be in very many pairs, so what belongs to it is joined first, to short rows; `b` is dealt out evenly.
        fine = self._made(_both(near), partial(_cells, share=FINE), "fine")
        closer = near.join(fine.toDF("a", "f_a"), "a").join(fine.toDF("b", "f_b"), "b").select(*sizes, "f_a", "f_b")
        return self._exact(materialise(closer.mapInArrow(_near, kind), "pairs"))

    def _exact(self, near: DataFrame) -> DataFrame:
        """The similar ones of stored pairs (a, b), by their sets."""
        sets = self._made(_both(near), np.ndarray.tobytes, "shingles")
        both = near.join(sets.toDF("a", "s_a"), "a").join(sets.toDF("b", "s_b"), "b").select("a", "b", "s_a", "s_b")
        return materialise(both.mapInArrow(_similar, "a long, b long"), "similar")

    def components(self) -> DataFrame:
        """(node, component) of the nodes that are linked with others."""
        plan, common, rows = self._plan()
        sent = self.spark.sparkContext.broadcast(common)
        index = self.docs.select("text").mapInArrow(_index(plan, sent, bucket_count(self.spark, rows)), SCHEMA)
        met = materialise(index.groupBy("bucket").applyInArrow(_meet, "leader long, node long").distinct(), "met")
        links = self._verified(met.select(F.col("leader").alias("a"), F.col("node").alias("b")))
        found = components(links)
        # Two sets that share a key have the key's leader in common.  What is left are the leaders whose other
        # sets are not all connected by now; the leader itself has been compared with each of them.
        labelled = met.join(found, "node", "left").select(
            "leader", "node", F.coalesce("component", "node").alias("component"))
        split = labelled.groupBy("leader").agg(F.min("component").alias("x"), F.max("component").alias("y"),
                                               F.count("*").alias("sets")).where("x != y")
        left = materialise(labelled.join(split.select("leader", "sets"), "leader"), "left")
        if not left.limit(1).count():
            return found
        # A set's leaders: no more than the keys it indexes, and few for sets that share most of their keys.
        shared = left.groupBy("node").agg(F.sort_array(F.collect_list("leader")).alias("leaders"))
        fine = self._made(left.select("node"), partial(_cells, share=FINE), "fine").withColumnRenamed("value", "cells")
        about = materialise(shared.join(self.nodes.select("node", "n"), "node").join(fine, "node"), "about")
        parts = F.ceil(F.col("sets") / BLOCK).cast("int")
        own = F.pmod(F.xxhash64("node"), parts).cast("int")
        rows = left.select("leader", "node", "component", parts.alias("parts"), own.alias("own"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
            "leader", "node", "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
            (F.col("own") >= F.col("other")).alias("second"))
        slots = max(4 * partitions(self.spark), -(-left.count() // 4096))
        slot = F.pmod(F.xxhash64("leader", "i", "j"), F.lit(slots)).cast("int").alias("slot")
        pairs = rows.select(slot, "*").join(about, "node").groupBy("slot").applyInArrow(_across, "a long, b long")
        more = self._exact(materialise(pairs, "across"))
        return components(links.union(more))

    def labelled(self) -> DataFrame:
        """(doc_id, tag, n_shingles, component): documents with equal component belong together.

        A document without shingles has none, and so has one whose set no other document has or is near to.
        """
        return self.rows.select("doc_id", "tag", "n_shingles", "node").join(self.components(), "node", "left").select(
            "doc_id", "tag", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")).alias("component"))


#: Rows of one long that are sent to every task at most (some tens of megabytes); beyond that Catalyst shuffles.
NARROW_ROWS = 1_000_000


def narrow(ids: DataFrame) -> DataFrame:
    """A stored table of one long column, marked for broadcast if its counted size allows that."""
    return F.broadcast(ids) if ids.limit(NARROW_ROWS + 1).count() <= NARROW_ROWS else ids


def links(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; the component is its smallest id."""
    slim = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = materialise(_Join(slim).labelled(), "labelled")
    low = rows.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("low"))
    # Documents without shingles get keys of their own here, so that they do not meet in one task.
    own = F.coalesce("component", F.xxhash64("doc_id", "tag"))
    return (rows.withColumn("own", own).join(low.withColumnRenamed("component", "own"), "own", "left")
            .select("doc_id", "n_shingles", F.when(F.col("component").isNotNull(), F.col("low"))
                    .otherwise(F.col("doc_id")).alias("component_id")))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents less all but one of each component; columns as in `docs`.

    The one with the smallest id stays; documents without shingles all stay.
    """
    tag = free_name(docs.columns, "_tag")
    tagged = docs.withColumn(tag, F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")))
    slim = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = materialise(_Join(slim).labelled().where("component IS NOT NULL"), "labelled")
    first = rows.groupBy("component").agg(F.min(F.struct("doc_id", "tag")).alias("first"))
    judged = rows.join(first, "component").select("tag", (F.col("tag") == F.col("first.tag")).alias("stays"))
    gone = materialise(judged.where("NOT stays").select(F.col("tag").alias(tag)).distinct(), "gone")
    # A row that stays but is there several times, word for word and with its id, is taken out and put back once.
    again = materialise(judged.where("stays").groupBy("tag").count().where("count > 1").select(F.col("tag").alias(tag)), "again")
    names = [F.col(f"`{c}`") for c in docs.columns]
    kept = tagged.join(narrow(gone), tag, "left_anti")
    if not again.limit(1).count():
        return kept.select(*names)
    once = kept.join(narrow(again), tag, "left_semi").dropDuplicates([tag])
    return kept.join(narrow(again), tag, "left_anti").select(*names).union(once.select(*names))
