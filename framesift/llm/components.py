"""Connected components of a table of links, by joins and small aggregates only.

First every task joins up the links of its own part of the table and hands on one link for each node, to the
smallest node it found connected; that shortens paths to about the number of parts.  The links of a node are brought together
and joined up once more, so that a node of a large group has one link and not one for each part.  Then every node
carries the smallest node it knows to be connected with it.  A round takes the smallest label among the
neighbours of a node, then replaces a label by the label of that label, so paths shorten by half or more.
No node's neighbours are ever collected, so a node may have any number of them.  Each round is written to the
shared folder and read again; the loop ends when nothing changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from framesift.session import materialise

#: Links that a task joins up at a time.
PART_LINKS = 2_000_000


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node connected with it) by the links (a, b); smallest nodes themselves are left out."""
    nodes, places = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = places[:len(a)], places[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        # A label moves with all that carry it.
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    rows = 0

    def out() -> pa.RecordBatch:
        a, b = (np.concatenate([h.column(k).to_numpy() for h in held]) for k in (0, 1))
        node, root = local_roots(a, b)
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["a", "b"])
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= PART_LINKS:
            yield out()
            held, rows = [], 0
    if held:
        yield out()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b), both long; the component is its smallest node."""
    parts = links.select("a", "b").where("a != b").mapInArrow(_joined_up, "a long, b long")
    short = materialise(parts.repartition("a").mapInArrow(_joined_up, "a long, b long"), "links")
    both = short.union(short.select("b", "a"))
    now = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select(
        "node", F.least("node", "low").alias("component"))
    now = materialise(now, "labels")
    while True:
        seen = both.join(now.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("component").alias("low"))
        down = now.join(seen, "node").select("node", F.col("component").alias("old"),
                                             F.least("component", "low").alias("label"))
        # The label of a label: labels are nodes, so each has one.
        jump = now.select(F.col("node").alias("label"), F.col("component").alias("further"))
        new = materialise(down.join(jump, "label", "left").select(
            "node", "old", F.least("label", F.coalesce("further", "label")).alias("component")), "labels")
        moved = new.where("component != old").limit(1).count()
        now = new.select("node", "component")
        if not moved:
            return now
