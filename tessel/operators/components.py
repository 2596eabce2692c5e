"""Connected components by alternating large-star and small-star rounds.

Each round is two grouped minima and two joins over the edge table; the number
of rounds grows with the logarithm of the longest path, not with its length.
Minima combine map-side.  A graph of at most SMALL edges is one task's instead.
Nodes with more than a ten-thousandth of all edge
ends, of which there can be no more than 10,000, are joined by broadcast, so no
task gets more rows of one node than that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from tessel.storage import discard, written


#: Nodes joined by broadcast at most; the share of edge ends that makes a node one is 1 / HOT.
HOT = 10_000
#: Edge ends of a node that any task can take.
FEW = 200


#: Edges up to which one task finds all components (a few megabytes).
SMALL = 100_000


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges (hi, lo): smallest labels go over edges, and
    from label to label, until none changes."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    edges = pa.Table.from_batches(held).combine_chunks()
    hi, lo = (edges.column(c).combine_chunks() for c in ("hi", "lo"))
    nodes = pc.unique(pa.concat_arrays([hi, lo]))
    nodes = nodes.take(pc.sort_indices(nodes))
    i, j = (pc.index_in(x, nodes).to_numpy() for x in (hi, lo))
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        for ends in (i, j, label[i], label[j]):
            np.minimum.at(new, ends, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(label))], names=["node", "root"])


def _state(edges: DataFrame) -> tuple[bool, int, int]:
    """(whether each component is a star: every hi has one lo and no lo is a
    hi; the edge ends; the most of one node)."""
    ends = edges.select(F.col("hi").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("lo").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    per = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"), F.count("*").alias("n"))
    bad, size, most = per.agg(F.expr("count_if(up > 1 or (up = 1 and down = 1))"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    return bad == 0, size, most


def most_rows(size: int) -> int:
    """Rows of one key that a task takes, of ``size`` in all: no more than HOT
    keys have more."""
    return max(FEW, size // HOT)


def with_least(rows: DataFrame, key: str, value: str, most: int | None) -> DataFrame:
    """``rows`` with ``m``, the smallest ``value`` of their ``key``.  Keys on
    more than ``most`` rows, if that is given, are joined by broadcast: pass
    ``most_rows(rows.count())`` at least."""
    least = rows.groupBy(key).agg(F.min(value).alias("m"), F.count("*").alias("n"))
    if most is None:
        return rows.join(least.drop("n"), key)
    hot = F.broadcast(least.where(F.col("n") > most).drop("n"))  # at most HOT rows, see FEW and HOT
    cold = rows.join(hot.select(key), key, "left_anti").join(least.where(F.col("n") <= most).drop("n"), key)
    return cold.unionByName(rows.join(hot, key))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, root)`` for every node of an edge; root is the smallest node of
    its component.  Self-loops, repeated edges and either direction are fine;
    edges with a null end are ignored.  No edges give no rows."""
    a, b = F.col(src), F.col(dst)
    now = written(edges.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges")
    if now.count() <= SMALL:
        kind = now.schema["hi"].dataType
        return now.coalesce(1).mapInArrow(_in_one_task, StructType([StructField("node", kind), StructField("root", kind)]))
    while True:
        done, ends, top = _state(now)
        if done:
            break
        hot = most_rows(ends) if top > most_rows(ends) else None
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        large = with_least(both, "u", "v", hot).where("v > u").select(F.col("v").alias("hi"), F.least("u", "m").alias("lo"))  # an edge gives one row, so no more than before
        if hot:
            large = written(large.distinct(), "large")  # it is read four times
        near = with_least(large, "hi", "lo", hot)
        small = near.where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(near.select("hi", F.col("m").alias("lo"))).distinct()
        before, now = now, written(small, "edges")
        for spent in (before, large) if hot else (before,):
            discard(spent)
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root"))).distinct()
