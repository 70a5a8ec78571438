"""Connected components on DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import Scratch

#: Most edges that are contracted together in a worker.
CONTRACT = 1 << 18


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of some edges: (node, least node of its component), without the centres."""
    names, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = np.arange(len(names))
    x, y = ends[: len(a)], ends[len(a) :]
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        far = root[x] != root[y]
        x, y = x[far], y[far]
    leaf = root != np.arange(len(names))
    return names[leaf], names[root[leaf]]


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) of each node of ``edges`` (a, b: long), where comp is the least node of its component.

    The edges of each partition are first contracted to stars, in pieces of
    ``CONTRACT`` edges; then labels go to neighbours and are replaced by their own
    labels (pointer jumping), so rounds grow with the logarithm of the diameter
    that is left.  Each round is written to the shared folder; the driver sees counts only.
    """

    def stars(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= CONTRACT:
                yield star(held)
                held = []
        if held:
            yield star(held)

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        node, root = contracted(np.asarray(t.column("a")), np.asarray(t.column("b")))
        return pa.record_batch({"a": pa.array(node, pa.int64()), "b": pa.array(root, pa.int64())})

    # dealt without a number of partitions, so that a small table comes to one and is settled there
    few = edges.select("a", "b").where("a <> b").repartition("a").mapInArrow(stars, "a long, b long")
    both = scratch.keep(few.select(F.explode(F.expr("array(struct(a, b), struct(b AS a, a AS b))")).alias("e")).select("e.*").distinct())
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        closer = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        # a round that lowers no label is the last, and needs no jump
        closer = scratch.keep(closer)
        if closer.where("comp <> old").isEmpty():
            scratch.drop(both, closer)
            return labels
        jump = closer.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        new = scratch.keep(closer.join(jump, "comp").select("node", F.least("comp", "root").alias("comp")))
        scratch.drop(labels, closer)
        labels = new
