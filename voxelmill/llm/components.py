"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Edges of a partition that are brought together before they are shuffled.
LOCAL_EDGES = 400_000


def star_edges(rows: DataFrame, node: str, key: str) -> DataFrame:
    """``a, b``: each node of a key with the smallest node of that key, so a key with n nodes gives n - 1 edges."""
    one = rows.where(F.col(key).isNotNull() & F.col(node).isNotNull()).select(F.col(node).alias("a"), F.col(key).alias("_key")).distinct()
    least = one.groupBy("_key").agg(F.min("a").alias("b"))
    return one.join(least, "_key").where("a != b").select("a", "b")


def least_of_each(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of the nodes 0..n-1 is joined with by the edges ``u, v``."""
    label = np.arange(n)
    while True:
        low, now = np.minimum(label[u], label[v]), label.copy()
        for side in (label[u], label[v]):
            np.minimum.at(now, side, low)
        while (now != now[now]).any():
            now = now[now]
        if (now == label).all():
            return label
        label = now


def combined(edges: DataFrame, most: int = LOCAL_EDGES) -> DataFrame:
    """Edges ``u, v`` with the same components: those of each run of ``most`` rows of a partition become stars around their smallest nodes.

    What a map-side combine is to a sum: it spares rounds and shuffled rows, and no task holds more than ``most`` edges.
    """
    def star(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        u, v = (pa.concat_arrays(table.column(i).chunks) for i in (0, 1))
        nodes = pc.unique(pa.concat_arrays([u, v]))
        nodes = nodes.take(pc.sort_indices(nodes))
        label = least_of_each(*(pc.index_in(c, nodes).to_numpy(zero_copy_only=False).astype(np.int64) for c in (u, v)), len(nodes))
        far = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([nodes.take(pa.array(far)), nodes.take(pa.array(label[far]))], ["u", "v"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                yield from star(held)
                held, n = [], 0
        if n:
            yield from star(held)

    kind = edges.schema["u"].dataType.simpleString()
    return edges.select("u", "v").mapInArrow(over, f"u {kind}, v {kind}")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """``node, root``: the smallest node that each node of an edge is joined with, directly or through others.

    Alternates large-star and small-star steps until the edges no longer change. Every step groups by node
    with a map-side minimum and joins it back, so a hub is never gathered; before each write the edges of a
    partition are :func:`combined`. Each round is cut by a written table, and only a count and a checksum reach the
    driver. Edges with a null end and self-loops are ignored; an empty table gives an empty result.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u != v")
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now = written(combined(now.distinct()).distinct(), "edges")
    seen = mark(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        under = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(under, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = combined(small.unionByName(under.select("u", F.col("m").alias("v"))))
        now = written(stars.distinct(), "edges")
        done, seen = (found := mark(now)) == seen, found
        if done:
            break
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
