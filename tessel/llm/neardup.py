"""MinHash near-duplicates by tensored banding.

A document's set is its distinct word shingles (64-bit hashes).  Two small
collections of T half keys, each of two minhashes, are paired into T * T table
keys of four minhashes, so 4T minhash values stand for 4T^2: a pair of
similarity s meets with probability (1 - (1 - s^2)^T)^2, over 0.994 at 0.75
and over 0.9994 at 0.8 for T = 8.

Equal sets are one node from the start.  In a bucket every node is compared,
on full sets, with the bucket's smallest node; linked nodes become components.
Only buckets that still hold several components go on: their nodes are
compared with a few of other components, which leaves little to do, and then
with all of other components.  A bucket's nodes are dealt to blocks of about
BLOCK, and each block meets the nodes compared with it, so a hot bucket is many
tasks' work.  Pairs that sizes rule out, or shingles no other set has, are never
made.  Every pair that shares a bucket is decided, whatever the bucket's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessel.llm import wordhash
from tessel.operators.components import connected_components, most_rows, with_least
from tessel.storage import written

SHINGLE = 5
PERCENT = 75
T = 8
#: Nodes of a bucket that one block holds, in expectation.
BLOCK = 256
#: Bins, by hash, in which a set's shingles are counted to bound intersections.
BIN_BITS = 6
BINS = 1 << BIN_BITS
#: Nodes of a bucket, in expectation, that the first round compares with the others.
FEW = 4

_rng = np.random.default_rng(20240502)
_ODD = _rng.integers(1, 2**63, 4 * T, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, hashes, bounds): the distinct shingle hashes, ascending, of
    document first + i are hashes[bounds[i]:bounds[i + 1]]."""
    for i, j, words, at in wordhash.documents(text, wordhash.BLANKS):
        n = np.diff(at)
        doc = np.repeat(np.arange(j - i), n)
        left = np.repeat(at[1:], n) - np.arange(len(words))  # words from here to the document's end
        total = np.zeros(len(words), np.uint64)
        for k in range(SHINGLE):
            shifted = np.zeros(len(words), np.uint64)
            shifted[: max(len(words) - k, 0)] = words[k:]
            shifted[left <= k] = 0  # short documents: the whole sequence is the shingle
            total += shifted * _PLACE[k]
        keep = (left >= SHINGLE) | (np.arange(len(words)) == np.repeat(at[:-1], n))
        h, doc = wordhash.mix(total[keep]), doc[keep]
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
        yield i, j, h, np.searchsorted(doc, np.arange(j - i + 1))


def _half_keys(h: np.ndarray, starts: np.ndarray, first: int, count: int) -> np.ndarray:
    """count half keys (two minhashes each) per set, from hash function ``first`` on."""
    out = np.empty((len(starts), count), np.uint64)
    for k in range(count):
        total = np.full(len(starts), 2 * k + first, np.uint64)
        for f in (first + 2 * k, first + 2 * k + 1):
            v = (h ^ _ODD[f]) * _ODD[f - 1]
            total = wordhash.mix(total + np.minimum.reduceat(v ^ (v >> np.uint64(32)), starts) * _ODD[f])
        out[:, k] = total
    return out


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.ravel().view(np.int64)))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, h, at in shingle_sets(batch.column("text")):
            n = np.diff(at)
            some = n > 0
            starts = at[:-1][some]
            node = np.zeros(j - i, np.uint64)
            sides = [np.zeros((j - i, T), np.uint64) for _ in "ab"]
            if len(starts):
                node[some] = wordhash.mix(np.add.reduceat(wordhash.mix(h ^ _ODD[0]), starts) + n[some].astype(np.uint64))
                for k, side in enumerate(sides):
                    side[some] = _half_keys(h, starts, 1 + 2 * T * k - k, T)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id")[i:j], batch.column("text_key")[i:j], pa.array(n), pa.array(node.view(np.int64), mask=~some),
                    *(_lists(s, np.arange(0, (j - i) * T + 1, T)) for s in sides)
                ],
                names=["doc_id", "text_key", "n", "node", "a", "b"]
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, h, at in shingle_sets(batch.column("text")):
            some = np.diff(at) > 0  # a null or repeated doc_id may stand on a blank text too: no set, no node
            n, starts = np.diff(at)[some], at[:-1][some]
            if not len(n):
                continue
            node = wordhash.mix(np.add.reduceat(wordhash.mix(h ^ _ODD[0]), starts) + n.astype(np.uint64))
            bins = np.bincount(np.repeat(np.arange(len(n)), n) * BINS + (h >> np.uint64(64 - BIN_BITS)).astype(np.int64), minlength=len(n) * BINS)
            bins = pa.ListArray.from_arrays(pa.array(np.arange(0, len(n) * BINS + 1, BINS), pa.int32()), pa.array(bins.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(n), _lists(h, np.append(starts, len(h))), bins], names=["node", "n", "set", "bins"])


def _common(sets: DataFrame) -> DataFrame:
    """node, n and common: how many of its shingles any other of the sets has.
    No intersection is larger than that."""
    one = sets.select("node", F.explode("set").alias("x")).groupBy("x").agg(F.count("*").alias("k"), F.min("node").alias("node")).where("k = 1")
    alone = one.groupBy("node").agg(F.count("*").alias("alone"))
    return sets.select("node", "n").join(alone, "node", "left").select("node", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("common"))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (src, dst) pairs of nodes that are similar enough on their full sets."""
    both = pairs.join(sets.select(F.col("node").alias("src"), F.col("set").alias("s")), "src").join(sets.select(F.col("node").alias("dst"), F.col("set").alias("d")), "dst")
    common = F.size(F.array_intersect("s", "d"))
    return both.where(100 * common >= PERCENT * (F.size("s") + F.size("d") - common)).select("src", "dst")


def _fit() -> Column:
    """Whether set sizes and shingles in common with any other set allow a link."""
    most = F.least("c_src", "c_dst")
    return 100 * most >= PERCENT * (F.col("n_src") + F.col("n_dst") - most)


def _bins_fit() -> Column:
    """Whether the shingles by bin allow a link: an intersection has no more in
    a bin than either set."""
    most = F.aggregate(F.zip_with("bins_l", "bins_r", lambda x, y: F.least(x, y)), F.lit(0), lambda acc, x: acc + x)
    return (100 + PERCENT) * most >= PERCENT * (F.col("n_src") + F.col("n_dst"))


def _mixed(level: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components, with the bucket's count."""
    parts = level.groupBy("key", "comp").agg(F.count("*").alias("k"))
    state = parts.groupBy("key").agg(F.sum("k").alias("count"), F.count("*").alias("comps")).where("comps > 1")
    return level.join(state.select("key", "count"), "key").select("key", "node", "n", "common", "table", "comp", "count")


def _labelled(df: DataFrame, components: DataFrame) -> DataFrame:
    return df.join(components.withColumnRenamed("root", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _labels(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, text_key, n_shingles, and, but for blank texts, comp and
    component_id."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key"))
    sig = written(rows.mapInArrow(_signatures, "doc_id long, text_key long, n long, node long, a array<long>, b array<long>"), "signatures")
    nodes = written(
        sig.where("node is not null").groupBy("node").agg(
            F.min("doc_id").alias("id"), F.min(F.struct("doc_id", "text_key")).alias("row"), F.min("a").alias("a"), F.min("b").alias("b")
        ),
        "nodes"
    )
    tables = F.transform("a", lambda x, i: F.transform("b", lambda y, j: F.struct(F.xxhash64(x, y).alias("key"), (T * i + j).alias("table"))))
    keys = nodes.select("node", F.explode(F.flatten(tables)).alias("k")).select("node", "k.key", "k.table")
    shared = keys.groupBy("key").agg(F.count("*").alias("count"), F.min("node").alias("pivot")).where("count > 1")
    members = written(keys.join(shared.drop("count"), "key"), "members")
    # Texts of the nodes that share any bucket, read again and shuffled once.
    wanted = members.select("node").distinct().join(nodes.select("node", "row"), "node").select(F.col("row.doc_id").alias("d"), F.col("row.text_key").alias("k")).distinct()
    again = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left_semi")
    found = again.mapInArrow(_sets, "node long, n long, set array<long>, bins array<int>")
    sets = written(found.groupBy("node").agg(F.first("n").alias("n"), F.first("set").alias("set"), F.first("bins").alias("bins")), "sets")
    sizes = written(_common(sets), "sizes")
    pairs = members.where("node != pivot").select(F.col("pivot").alias("src"), F.col("node").alias("dst")).distinct()
    pairs = pairs.join(sizes.toDF("src", "n_src", "c_src"), "src").join(sizes.toDF("dst", "n_dst", "c_dst"), "dst").where(_fit()).select("src", "dst")
    components = connected_components(written(_confirmed(pairs, sets), "links"))
    level = members.join(sizes.where(f"100 * common >= {PERCENT} * n"), "node").select("key", "node", "n", "common", "table")
    marks = sets.select("node", "bins").join(nodes.select("node", "a", "b"), "node")
    # First with a few nodes of each bucket, so that most of what belongs together is one component, then with all.
    for few in (True, False):
        level = written(_mixed(_labelled(level, components)), "mixed")
        if level.isEmpty():
            break
        here = level.join(marks, "node").withColumn("blocks", F.ceil(F.col("count") / BLOCK))
        left = here.withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
        left = left.select(
            "key", "block", "table", F.col("node").alias("src"), F.col("n").alias("n_src"), F.col("common").alias("c_src"), F.col("comp").alias("c"),
            F.col("a").alias("a_l"), F.col("b").alias("b_l"), F.col("bins").alias("bins_l")
        )
        right = here.where(F.pmod(F.xxhash64("node", F.lit("few")), F.ceil(F.col("count") / FEW)) == 0) if few else here
        right = right.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        right = right.select(
            "key", "block", F.col("node").alias("dst"), F.col("n").alias("n_dst"), F.col("common").alias("c_dst"), F.col("comp").alias("d"),
            F.col("a").alias("a_r"), F.col("b").alias("b_r"), F.col("bins").alias("bins_r")
        )
        # Two nodes share several tables: the first one makes the pair.
        before = lambda l, r, at: F.array_contains(F.zip_with(F.slice(l, 1, at), F.slice(r, 1, at), lambda x, y: x == y), True)
        first = ~before("a_l", "a_r", F.floor(F.col("table") / T).cast("int")) & ~before("b_l", "b_r", F.pmod("table", F.lit(T)).cast("int"))
        once = F.lit(True) if few else (F.col("src") < F.col("dst")) & first
        pairs = left.join(right, ["key", "block"]).where((F.col("c") != F.col("d")) & _fit() & once & _bins_fit())
        pairs = pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
        more = written(_confirmed(pairs, sets), "links")
        if not more.isEmpty():
            # What is known stands as one edge a node beside the new links.
            components = connected_components(components.select(F.col("node").alias("src"), F.col("root").alias("dst")).unionByName(more))
        level = level.select("key", "node", "n", "common", "table")
    named = written(_labelled(nodes.select("node", "id"), components), "named")
    label = with_least(named, "comp", "id", most_rows(named.count())).select("node", "comp", F.col("m").alias("component_id"))
    return sig.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "node").join(label, "node", "left").drop("node")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable by
    links, itself included), kept.

    Null, empty and blank texts have no shingles and link with nothing.  Rows
    with the same doc_id share its id; each row is judged by its own text.  A
    component whose ids are all null has a null id and keeps all its rows.  An
    empty table gives no rows; other columns are ignored.  Nodes are 64-bit
    hashes of whole sets.
    """
    out = _labels(docs).select("doc_id", "n_shingles", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each component one row, that with the
    smallest doc_id (null ids last), then text hash; all columns kept, whatever
    their names.  Rows are judged by their own text, so a doc_id that stands on
    several texts may stay with one and go with another; of rows equal in doc_id
    and text one stays.  Null, empty and blank texts all stay."""
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    texts = written(_labels(docs).where("comp is not null").groupBy("comp", "doc_id", "text_key").agg(F.count("*").alias("copies")).withColumn("rank", rank), "texts")
    judged = with_least(texts, "comp", "rank", most_rows(texts.count()))
    acts = written(
        judged.where("rank != m or copies > 1").select(
            F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"), (F.col("rank") == F.col("m")).alias("one")
        ),
        "acts"
    )
    d = docs.alias("d")
    at = F.col("d.doc_id").cast("long").eqNullSafe(F.col("g.gone_id")) & (F.xxhash64(F.col("d.text")) == F.col("g.gone_key"))
    rest = d.join(acts.alias("g"), at, "left_anti")
    repeated = acts.where("one")
    if repeated.isEmpty():
        return rest
    # Equal in doc_id and text: the first one is picked by an aggregation that combines before it shuffles.
    held = d.join(repeated.alias("g"), at, "left_semi").select(F.struct(*[F.col(f"d.`{c}`") for c in docs.columns]).alias("row"))
    picked = held.groupBy(F.col("row.doc_id"), F.xxhash64("row.text")).agg(F.first("row").alias("row"))
    return rest.unionByName(picked.select("row.*"))
