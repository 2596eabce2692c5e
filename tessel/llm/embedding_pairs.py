"""Embedding near-duplicates: exact cosine threshold by cover trees.

Unit vectors with cosine >= c are those within sqrt(2 - 2c) of each other.  A
cover tree over a bounded sample (nested nets of halving radii) gives cells;
every vector of the table goes to its nearest cell, whose covering radius is
then exact.  A vector is sent to another cell only if neither that radius nor
the plane halfway between the two centres rules out a link, so what is copied
is decided vector by vector, before any row is copied.  Vectors within half the
distance of their cell's centre (its core) all link with each other and are
counted in bulk, so a hot cluster costs no pairs.  The blocks of at most about
LEAF vectors meet pair by pair; inside a pair two cover trees are traversed
together: node pairs are dropped or taken whole by their covering radii, leaves
are compared in double precision.

The sample shapes the cells only; any sample gives the same links.  Vectors
without clusters, far from each other in many dimensions, let no bound part
them: nearly all blocks meet then, as exact results need.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tessel.operators.components import connected_components
from tessel.storage import written

COSINE = 0.9
#: Vectors of the sample whose nets are the cells, and cells at most.
SAMPLE, CELLS = 2048, 512
#: Vectors in a block, and in a node of its tree that needs no children.
LEAF, TREE_LEAF = 8192, 256
#: Members of the net of half a node's radius; a node that needs more has no children.
FAN = 64
#: Rows whose dot products with a leaf are held at once.
ROWS = 1024
#: Slack of distance bounds; far above rounding, and pairs inside it are compared.
SLACK = 1e-6


def _distance(cosine: float) -> float:
    return math.sqrt(2 - 2 * cosine)


def nets(points: np.ndarray, most: int, near: float) -> np.ndarray:
    """Centres: nested nets of radius 2, 1, 1/2, ... over ``points`` (units),
    dense regions first, until there are ``most`` or all points are centres."""
    if not len(points):
        return points
    order = np.argsort(-((points @ points.T) >= 1 - near * near / 2).sum(axis=1), kind="stable")
    gap = np.full(len(points), np.inf)
    chosen: list[int] = []
    radius = 2.0
    while len(chosen) < min(most, len(points)) and radius > near / 4:
        for k in order:
            if gap[k] > radius and len(chosen) < most:
                chosen.append(int(k))
                gap = np.minimum(gap, np.sqrt(np.maximum(0, 2 - 2 * points @ points[k])))
        radius /= 2
    return points[chosen]


class Node:
    __slots__ = ("centre", "radius", "rows", "children")

    def __init__(self, points: np.ndarray, rows: np.ndarray, centre: np.ndarray) -> None:
        self.centre, self.rows = centre, rows
        gap = np.linalg.norm(points[rows] - centre, axis=1)
        self.radius = float(gap.max())
        self.children: list[Node] = []
        if len(rows) <= TREE_LEAF or self.radius < SLACK:
            return
        centres, left = [centre], gap > self.radius / 2
        while left.any():  # the net of half the radius, its parent's centre first
            if len(centres) == FAN:
                return
            new = points[rows[np.argmax(np.where(left, gap, -1))]]
            centres.append(new)
            left &= np.linalg.norm(points[rows] - new, axis=1) > self.radius / 2
        nearest = np.argmax(points[rows] @ np.stack(centres).T - 0.5 * np.sum(np.square(centres), axis=1), axis=1)
        parts = [rows[nearest == k] for k in range(len(centres))]
        if max(map(len, parts)) < len(rows):
            self.children = [Node(points, p, c) for p, c in zip(parts, centres) if len(p)]


def cover_tree(points: np.ndarray) -> Node:
    return Node(points, np.arange(len(points)), points[0])


def linked(x: np.ndarray, y: np.ndarray, cosine: float) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """Links between rows of x and of y (units): (rows of x, rows of y, whole).
    With ``whole`` every row links with every row, else they are pairs."""
    reach = _distance(cosine)
    found = []
    stack = [(cover_tree(x), cover_tree(y))]
    while stack:
        a, b = stack.pop()
        gap = float(np.linalg.norm(a.centre - b.centre))
        if gap - a.radius - b.radius > reach + SLACK:
            continue
        if gap + a.radius + b.radius < reach - SLACK:
            found.append((a.rows, b.rows, True))
        elif a.children and (a.radius >= b.radius or not b.children):
            stack += [(c, b) for c in a.children]
        elif b.children:
            stack += [(a, c) for c in b.children]
        else:
            for k in range(0, len(a.rows), ROWS):
                i, j = np.nonzero(x[a.rows[k : k + ROWS]] @ y[b.rows].T >= cosine)
                if len(i):
                    found.append((a.rows[k + i], b.rows[j], False))
    return found


def _roots(n: int, ends: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest row linked to each of n rows, by steps through all links."""
    label = np.arange(n)
    if not ends:
        return label
    i, j = (np.concatenate(x) for x in zip(*ends))
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _block_links(cosine: float):
    def run(df: pd.DataFrame) -> pd.DataFrame:
        same = df["pa"].iloc[0] == df["pb"].iloc[0]
        df = df.sort_values(["side", "node"], kind="stable")
        points = np.frombuffer(b"".join(df["unit"]), np.float64).reshape(len(df), -1)
        weight = df["weight"].to_numpy()
        side = df["side"].to_numpy()
        cut = len(df) if same else int((side == 0).sum())
        x, y, shift = (points, points, 0) if same else (points[:cut], points[cut:], cut)
        count = np.zeros(len(df), np.int64)
        ends = []
        for i, j, whole in linked(x, y, cosine) if len(x) and len(y) else []:
            j = j + shift
            if whole:
                count[i] += weight[j].sum()
                ends += [(i, np.full(len(i), j[0])), (j, np.full(len(j), i[0]))]
                if same:
                    own = np.intersect1d(i, j)
                    count[own] -= weight[own]
                else:
                    count[j] += weight[i].sum()
            else:
                real = i != j
                np.add.at(count, i[real], weight[j[real]])
                if not same:
                    np.add.at(count, j[real], weight[i[real]])
                ends.append((i[real], j[real]))
        root = _roots(len(df), ends)
        some = count > 0
        node = df["node"].to_numpy()
        return pd.DataFrame({"node": node[some], "links": count[some], "peer": node[root[some]]})

    return run


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        units: list[bytes | None] = [None] * len(size)
        for n in np.unique(size[size > 0]):  # the vectors of one length are one matrix
            rows = np.flatnonzero(size == n)
            flat = lists.take(pa.array(rows)).flatten()
            x = flat.to_numpy(zero_copy_only=False).reshape(-1, n)  # a null component is a NaN
            most = np.abs(x).max(axis=1)
            good = (most > 0) & np.isfinite(most)
            x = np.ascontiguousarray(x[good] / most[good, None])
            x = x / np.sqrt((x * x).sum(axis=1))[:, None] + 0.0
            for row, unit in zip(rows[good], x):
                units[row] = unit.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(units, pa.binary())], names=["vec_id", "unit"])


def _gaps(batch: pa.RecordBatch, centres: np.ndarray) -> np.ndarray:
    """Distance of every unit to every centre."""
    x = np.frombuffer(b"".join(batch.column("unit").to_pylist()), np.float64).reshape(-1, centres.shape[1])
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ centres.T)))


def _into_cells(centres: np.ndarray, core: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                gaps = _gaps(part, centres)
                cell = gaps.argmin(axis=1)
                gap = gaps[np.arange(len(cell)), cell]
                group = 2 * cell + (gap <= core)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(group.astype(np.int64)), pa.array(gap)], names=[*part.schema.names, "grp", "gap"])

    return run


def _meetings(centres: np.ndarray, groups: dict[int, tuple[int, float]], reach: float):
    """Rows (pa, pb, side, node, weight, unit): every vector once for each block
    it may have links in.  ``groups``: vectors and covering radius by group."""
    ids = np.array(sorted(groups))
    cells, cores = ids // 2, ids % 2 == 1
    blocks = np.array([math.ceil(groups[g][0] / LEAF) for g in ids])
    radius = np.array([groups[g][1] for g in ids])
    apart = np.sqrt(np.maximum(0, 2 - 2 * (centres @ centres.T)))
    place = {int(g): k for k, g in enumerate(ids)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                gaps = _gaps(part, centres)
                group = part.column("grp").to_numpy()
                cell = group // 2
                own = gaps[np.arange(len(cell)), cell]
                ball = gaps[:, cells] <= radius + reach + SLACK
                # Every vector of a cell is on its centre's side of the plane halfway to any other centre.
                plane = gaps[:, cells] ** 2 - own[:, None] ** 2 <= 2 * apart[cell][:, cells] * (reach + SLACK) + SLACK
                meets = ball & plane & ~((ids == group[:, None]) & cores)
                row, other = np.nonzero(meets)
                turns = blocks[other]
                row, other = np.repeat(row, turns), np.repeat(other, turns)
                theirs = (ids[other] << 32) + np.arange(len(row)) - np.repeat(np.cumsum(turns) - turns, turns)
                mine = ((group << 32) + part.column("hash").to_numpy() % blocks[[place[int(g)] for g in group]])[row]
                for a in range(0, len(row), 4 * ROWS):
                    cut = slice(a, a + 4 * ROWS)
                    m, t, take = mine[cut], theirs[cut], pa.array(row[cut])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.minimum(m, t)), pa.array(np.maximum(m, t)), pa.array((m > t).astype(np.int32)),
                            *(part.column(c).take(take) for c in ("node", "weight", "unit"))
                        ],
                        names=["pa", "pb", "side", "node", "weight", "unit"]
                    )

    return run


def _links(nodes: DataFrame, cosine: float) -> DataFrame:
    """(node, links, peer) of vectors of one length."""
    spark = nodes.sparkSession
    reach = _distance(cosine)
    sample = nodes.select("node", "unit").orderBy(F.xxhash64("node"), "node").limit(SAMPLE).collect()  # bounded
    points = np.stack([np.frombuffer(r["unit"], np.float64) for r in sample])
    count = nodes.count()
    centres = nets(points, max(1, min(CELLS, count // LEAF)), reach)
    core = reach / 2 - SLACK
    hashed = nodes.withColumn("hash", F.shiftrightunsigned(F.xxhash64("node"), 33))
    placed = written(hashed.mapInArrow(_into_cells(centres, core), "node long, id long, weight long, unit binary, hash long, grp long, gap double"), "cells")
    stats = {
        r["grp"]: r for r in placed.groupBy("grp").agg(
            F.count("*").alias("n"), F.sum("weight").alias("w"), F.max("gap").alias("radius"), F.min("node").alias("first")
        ).collect()
    }  # at most 2 x CELLS
    cores = [(g, r["w"], r["first"]) for g, r in stats.items() if g % 2]
    links = placed.join(F.broadcast(spark.createDataFrame(cores or [(-1, 0, 0)], "grp long, all long, first long")), "grp")  # at most CELLS rows
    links = links.where(F.col("all") > F.col("weight")).select("node", (F.col("all") - F.col("weight")).alias("links"), F.col("first").alias("peer"))
    groups = {g: (r["n"], r["radius"]) for g, r in stats.items()}
    rows = placed.mapInArrow(_meetings(centres, groups, reach), "pa long, pb long, side int, node long, weight long, unit binary")
    return links.unionByName(rows.groupBy("pa", "pb").applyInPandas(_block_links(cosine), "node long, links long, peer long"))


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per row: vec_id, n_links, component_id (smallest vec_id reachable by
    links, itself included), kept.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing; vectors of different lengths never link.  Repeated
    vectors link with each other like any others.  Rows that share a vec_id
    share its id; a component of null ids has a null id and keeps all rows.
    An empty table gives no rows; other columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    units = written(rows.mapInArrow(_units, "vec_id long, unit binary"), "units").withColumn("node", F.xxhash64("unit", F.length("unit")))
    nodes = written(
        units.where("unit is not null").groupBy("node", "unit").agg(
            F.min("vec_id").alias("id"), F.count("*").alias("weight")
        ).select("node", "id", "weight", "unit"),
        "nodes"
    )
    lengths = [r[0] for r in nodes.select(F.length("unit")).distinct().collect()]
    parts = [_links(nodes.where(F.length("unit") == n), cosine) for n in sorted(lengths)]
    spark = vectors.sparkSession
    links = spark.createDataFrame([], "node long, links long, peer long")
    for part in parts:
        links = links.unionByName(part)
    links = written(links, "links")
    components = connected_components(links, "node", "peer")
    total = links.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.join(components, "node", "left").select("node", "id", "weight", F.coalesce("root", "node").alias("root"))
    ids = named.groupBy("root").agg(F.min("id").alias("component_id"))
    label = named.join(ids, "root").join(total, "node", "left").select("node", "component_id", (F.coalesce("links", F.lit(0).cast("long")) + F.col("weight") - 1).alias("n_links"))
    out = units.select("vec_id", F.when(F.col("unit").isNotNull(), F.col("node")).alias("node")).join(label, "node", "left")
    out = out.select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
