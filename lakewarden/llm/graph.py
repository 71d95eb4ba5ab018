"""Connected components of a table of links by repeated contraction. Nothing is collected.

Each level first turns every chunk of links into a spanning forest of its own, then hooks each node to the neighbour (or itself)
of least hash and renames the links by that. The hash differs by level, so whatever the shape of the graph a level is expected to
leave a fraction of the nodes, and the number of levels grows with the logarithm of the links, not with the length of chains.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, join_small, map_arrow

#: Links that a task holds at a time.
CHUNK_LINKS = 500_000
MAX_LEVELS = 200


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as stars: (node, centre) for each node but the centres."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(ids)))
    for x, y in zip(flat[: len(a)].tolist(), flat[len(a) :].tolist(), strict=True):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x < y:
            up[y] = x
        elif y < x:
            up[x] = y
    top = np.array(up, np.int64)
    while (top[top] != top).any():
        top = top[top]
    leaf = np.flatnonzero(top != np.arange(len(ids)))
    return ids[leaf], ids[top[leaf]]


def _stars(links: DataFrame, chunk: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            v, c = _forest(t.column(0).to_numpy(), t.column(1).to_numpy())
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])

        for x in batches:
            held.append(x)
            n += x.num_rows
            if n >= chunk:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return map_arrow(links.select("a", "b"), run, "a long, b long")


def connected_components(links: DataFrame, broadcast_rows: int = BROADCAST_ROWS, chunk: int = CHUNK_LINKS, into: Scratch | None = None) -> DataFrame:
    """links (a, b) of long ids, neither null -> (v, label): label is the least id of v's component. Ids without a link to
    another are absent. Repeated and reversed links are one; no links give no rows. Links that fit into one chunk are finished in
    one task; that gives the same rows. The result is a table of `into`, if that is given."""
    scratch = Scratch(links.sparkSession)
    join = lambda d, side, on, how: join_small(d, side, [on], how, F.xxhash64(*d.columns), rows=broadcast_rows)
    levels: list[DataFrame] = []
    e = links.where("a <> b")
    for level in range(MAX_LEVELS):
        e = scratch.table(_stars(e, chunk).distinct(), "links")
        if e.count() <= chunk:
            e = scratch.table(_stars(e.coalesce(1), chunk + 1), "links")
            root = e.select(F.col("a").alias("v"), F.col("b").alias("up")).unionByName(e.select(F.col("b").alias("v"), F.col("b").alias("up")).distinct())
            break
        ranked = lambda c: F.struct(F.xxhash64(F.lit(level), F.col(c)).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        near = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("v")).agg(F.min(ranked("b")).alias("m"))
        hook = scratch.table(near.select("v", F.least(ranked("v"), "m")["id"].alias("up")), "hooks")
        levels.append(hook)
        for c in ("a", "b"):
            e = join(e, hook.withColumnRenamed("v", c), c, "inner").drop(c).withColumnRenamed("up", c)
        e = e.where("a <> b")
    else:
        raise RuntimeError("components did not settle")
    while levels:  # a node's root is that of the node it was hooked to; one that no later level knows is a root
        root = scratch.table(join(levels.pop(), root.select(F.col("v").alias("up"), F.col("up").alias("root")), "up", "left").select("v", F.coalesce("root", "up").alias("up")), "roots")
    least = scratch.table(root.groupBy("up").agg(F.min("v").alias("label")), "roots")
    out = (into or scratch).table(join(root, least, "up", "inner").select("v", "label"), "labels")
    scratch.drop(out)
    return out
