"""Connected components by alternating stars (Kiveris et al., 2014), as aggregates and joins.

Nothing is collected and no node's neighbours meet in one row: a star's centre is a minimum, which combines on the map side, and the join back
to the edges is one that adaptive execution splits where a centre is hot. Every round is written to the shared folder, and the one before it removed.
Where a caller says so, a graph that is small enough is solved by union-find in one task instead, since each round costs six shuffles however few its edges.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import forget, stored
from vellum.llm.groups import Union


def _large(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    """Edges have u > v."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes and roots of the graph whose edges (u, v) are all in batches."""
    pairs = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    ids, at = np.unique(np.concatenate([np.empty(0, np.int64), *(u for u, _ in pairs), *(v for _, v in pairs)]), return_inverse=True)
    known, n = Union(len(ids)), len(at) // 2
    for a, b in zip(at[:n].tolist(), at[n:].tolist(), strict=True):
        known.join(a, b)
    roots = ids[known.roots()]
    yield pa.RecordBatch.from_arrays([pa.array(x[ids != roots]) for x in (ids, roots)], names=["node", "root"])


def components(edges: DataFrame, at_once: int = 0) -> DataFrame:
    """(node, root) for the nodes of edges (a, b), both bigint; root is the smallest node that is reachable. Roots are not listed. One task takes graphs of
    at most at_once edges.
    """
    e = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    was = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == was or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        if now[0] <= at_once:
            out = stored(e.coalesce(1).mapInArrow(_joined, "node long, root long"), "joined")
            forget(e)
            return out
        before, e, was = e, stored(_small(_large(e)), "edges"), now
        forget(before)
