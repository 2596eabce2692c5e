"""Quality classifier: kernel ridge by random Fourier features, calibrated.

Document statistics (shares of byte classes, word and line shapes, repetition)
are scaled and mapped to random cosines whose inner products approximate a
Gaussian kernel.  Partitions sum their normal equations; the sums are solved
once.  Pool-adjacent-violators on a held-back part turns ridge scores into
probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessel.llm import wordhash
from tessel.storage import written

#: Random cosines, kernel width (in standard deviations), ridge, seed.
COSINES, WIDTH, RIDGE, SEED = 256, 4.0, 1e-3, 20240504
#: Labelled rows that are learned from at most (in expectation, by a hash of
#: the id), and partitions that sum their normal equations (0.5 MB each).
TRAIN_ROWS, PARTS = 60_000, 16

_CLASSES = np.zeros(256, np.int8)
for _k, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), (32, 9), (10,), b".,;:", b"!?", b"'\"()-", b"#$%&*+/<=>@[\\]^_`{|}~", range(128, 256)), 1):
    _CLASSES[list(_bytes)] = _k
N_CLASSES = 11
STATISTICS = N_CLASSES + 15
NEWLINE = wordhash.table_of(b"\n")


def _distinct(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and the count of the most frequent, per document."""
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(h)))
    distinct, most = np.bincount(doc[first], minlength=len(n)), np.zeros(len(n), np.int64)
    np.maximum.at(most, doc[first], size)
    return distinct, most


def statistics(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, end, values): STATISTICS numbers for each whole text."""
    lines = ((i, j, h, at) for i, j, h, at in wordhash.documents(text, NEWLINE))
    for (i, j, buf, starts, ends, at), (_, _, line, line_at) in zip(wordhash.bounded(text, wordhash.BLANKS), lines):
        off, data = wordhash.raw(text.slice(i, j - i))
        raw, cuts = data[off[0] : off[-1]], off - off[0]
        kinds = _CLASSES[raw]
        size, words, n_lines = np.diff(cuts), np.diff(at), np.diff(line_at)
        out = np.zeros((j - i, STATISTICS))
        for k in range(N_CLASSES):
            run = np.append(0, np.cumsum(kinds == k))
            out[:, k] = (run[cuts[1:]] - run[cuts[:-1]]) / np.maximum(size, 1)
        per = np.maximum(words, 1)
        sums = lambda x: np.diff(np.append(0, np.cumsum(x))[at])
        length = ends - starts
        hashes = wordhash._hashes(buf, starts, ends)
        distinct, most = _distinct(hashes, at)
        distinct_lines, most_lines = _distinct(line, line_at)
        pair = wordhash.mix(hashes[:-1] + np.uint64(3) * hashes[1:]) if len(hashes) else hashes
        pair = np.append(pair, hashes[-1:])
        pairs, _ = _distinct(pair, at)
        last = kinds[np.maximum(cuts[1:] - 1, 0)] if len(kinds) else np.zeros(j - i, np.int8)
        end_kind = _CLASSES[buf[ends - 1]] if len(ends) else np.zeros(0, np.int8)
        first_kind = kinds[starts] if len(starts) else np.zeros(0, np.int8)
        mean = sums(length) / per
        out[:, N_CLASSES:] = np.stack([
            np.log1p(size), np.log1p(words), np.log1p(n_lines), mean, np.sqrt(np.maximum(0, sums(length.astype(float) ** 2) / per - mean**2)),
            words / np.maximum(n_lines, 1) / 100, distinct / per, most / per, pairs / per, distinct_lines / np.maximum(n_lines, 1), most_lines / np.maximum(n_lines, 1),
            sums(np.isin(end_kind, (8, 9))) / per, sums(first_kind == 2) / per, sums(length >= 14) / per, np.isin(last, (6, 7)) & (size > 0),
        ], axis=1)
        yield i, j, out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    steps: np.ndarray  # ridge scores
    values: np.ndarray  # their probabilities

    def cosines(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        omega = rng.normal(0, 1 / WIDTH, (STATISTICS, COSINES))
        phase = rng.uniform(0, 2 * np.pi, COSINES)
        z = np.cos(np.clip((x - self.mean) / self.scale, -8, 8) @ omega + phase) * (2 / COSINES) ** 0.5
        return np.concatenate([z, np.ones((len(x), 1))], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.cosines(x) @ self.weight, self.steps, self.values), 0, 1)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: middle score and value of every pool."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []  # sum of y, size, sum of scores
    for s, v in zip(score[order], y[order]):
        pools.append([float(v), 1.0, float(s)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top)]
    x = np.array([p[2] / p[1] for p in pools])
    v = np.array([(p[0] + 0.5 * y.mean()) / (p[1] + 0.5) for p in pools])  # a pool of few rows is not quite sure
    return x, np.maximum.accumulate(v)


def _sums(model: Model | None):
    """Per partition: rows, sum and square sum of statistics, or the normal equations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float64).reshape(-1, STATISTICS)
            if model is None:
                own = np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])
            else:
                z = model.cosines(x)
                own = np.concatenate([(z.T @ z).ravel(), z.T @ batch.column("y").to_numpy()])
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return run


def _summed(rows: DataFrame, model: Model | None) -> np.ndarray | None:
    """At most PARTS rows come to the driver, added in a fixed order."""
    parts = sorted(r[0] for r in rows.mapInArrow(_sums(model), "sums binary").collect())
    return np.sum([np.frombuffer(p, np.float64) for p in parts], axis=0) if parts else None


def fit(rows: DataFrame) -> Model:
    """Learn from rows (doc_id, y 0/1, x): three quarters solve the ridge
    regression, the rest calibrate it.  Without both, every score is the mean."""
    n = rows.count()
    dice = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = written(
        rows.where(dice < F.lit(min(1.0, TRAIN_ROWS / max(1, n)))).withColumn(
            "part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(4))
        ).repartition(PARTS, "doc_id"),
        "sample"
    ).coalesce(PARTS)
    learn = sample.where("part > 0")
    sums = _summed(learn, None)
    if sums is None:
        return Model(np.zeros(STATISTICS), np.ones(STATISTICS), np.zeros(COSINES + 1), np.zeros(1), np.full(1, 0.5))
    count, mean, square = sums[0], sums[1 : STATISTICS + 1] / sums[0], sums[STATISTICS + 1 :] / sums[0]
    model = Model(mean, np.sqrt(np.maximum(square - mean**2, 1e-12)) + 1e-6, np.zeros(COSINES + 1), np.zeros(1), np.full(1, 0.5))
    sums = _summed(learn, model)
    side = COSINES + 1
    model.weight = np.linalg.solve(sums[: side * side].reshape(side, side) + RIDGE * np.eye(side) * max(1.0, count / 1000), sums[side * side :])
    rest = sample.where("part = 0").select("x", "y").toPandas()  # a quarter of the bounded sample
    if len(rest):
        x = np.frombuffer(b"".join(rest["x"]), np.float64).reshape(-1, STATISTICS)
        model.steps, model.values = isotonic(model.cosines(x) @ model.weight, rest["y"].to_numpy())
    return model


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x (the statistics as bytes) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, x in statistics(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, x binary")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.7) for every row.

    A null text counts as empty.  A null doc_id is scored but not learned from;
    repeated rows get equal scores; a doc_id labelled twice counts as good if
    any label says so.  Labels other than 0 and 1 are ignored; without labels
    every score is 0.5.  No rows give no rows; other columns are ignored."""
    stats = written(with_statistics(docs), "statistics")
    known = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    model = docs.sparkSession.sparkContext.broadcast(fit(stats.join(known, "doc_id")))  # some hundred KB

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float64).reshape(-1, STATISTICS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.value.scores(x))], names=["doc_id", "score"])

    out = stats.mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
