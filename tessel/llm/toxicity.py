"""Toxicity: a convolutional text classifier in numpy.

A word is the sum of hashed embeddings, its own and those of its first bytes.
Filters of several widths run over the whole text, the maximum of each over
all positions is pooled, and a logistic layer scores them.  It is trained by
AdaGrad on all labelled rows: replicas of the model pass over a part of the
rows each, on the executors, and are averaged after every pass.  Thresholds are
calibrated on all labelled rows too, by models that have not seen them, and by
language, as the text itself shows it (counts of its function words): a score
of 0.5 is the language's threshold.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessel.llm import wordhash

BUCKETS = 1 << 15
#: Lengths, in bytes, of the beginnings that have embeddings of their own.
PREFIXES = (5, 7, 8)
IDS = 1 + len(PREFIXES)
DIM = 8
#: Filters by width.
WIDTHS = ((1, 24), (2, 8), (3, 8))
#: Passes over the rows; few rows are passed over more often, up to STEPS texts.
EPOCHS, STEPS, MOST_EPOCHS = 8, 24_000, 30
RATE, SEED = 0.1, 20240503
#: Texts of a step.
BATCH = 32
#: Bytes of labelled texts in a block, which is shuffled and held as a whole,
#: and in a replica's part of the blocks, until there are MOST_REPLICAS.
BLOCK_BYTES, REPLICA_BYTES, MOST_REPLICAS = 1_600_000, 50_000_000, 32
#: The rows are cut into so many folds, below SMALL rows and from there on;
#: each fold is held back in turn.
FOLDS, SMALL = (5, 2), 3000
#: Labelled ids that are broadcast to the texts at most; more are shuffled with them.
BROADCAST = 1_000_000
#: Slices of the embeddings, averaged apart; bins to a logit, and the last of them.
SLICES, BINS, LAST_BIN = 16, 16, 1024
#: Rows of both classes a language needs for a threshold of its own.
ENOUGH = 12
#: Common function words, one list per language.
FUNCTION_WORDS = (
    ("the", "of", "and", "to", "in", "is", "that", "for", "with", "was", "this", "are"),
    ("der", "die", "und", "das", "ist", "nicht", "ein", "eine", "mit", "für", "den", "zu"),
    ("le", "la", "les", "des", "est", "et", "une", "dans", "pour", "du", "un", "que"),
    ("el", "la", "los", "las", "que", "de", "por", "con", "una", "para", "del", "y"),
)
_LANGUAGES = [np.array(sorted(map(wordhash.hash_of, words)), np.uint64) for words in FUNCTION_WORDS]


def encoded(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, end, ids, bounds, language): IDS bucket ids per word of whole
    texts, and each text's language (len(FUNCTION_WORDS) if none shows)."""
    for i, j, buf, starts, ends, at in wordhash.bounded(text, wordhash.NOT_ALNUM):
        words = wordhash._hashes(buf, starts, ends)
        hashes = [words, *(wordhash.prefix_hashes(buf, starts, ends, k) for k in PREFIXES)]
        ids = np.stack([h % np.uint64(BUCKETS) + np.uint64(k * BUCKETS) for k, h in enumerate(hashes)], axis=1).astype(np.int32)
        run = [np.append(0, np.cumsum(np.isin(words, known))) for known in _LANGUAGES]
        seen = np.stack([r[at[1:]] - r[at[:-1]] for r in run])
        language = np.where(seen.max(axis=0) > 0, seen.argmax(axis=0), len(_LANGUAGES))
        yield i, j, ids, at, language


def _embedded(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    e = words.take(ids[:, 0], axis=0)
    for k in range(1, IDS):
        e += words.take(ids[:, k], axis=0)
    return e


@dataclass
class Model:
    words: np.ndarray
    filters: list[np.ndarray]  # per width: (width, DIM, filters)
    weight: np.ndarray
    bias: float
    threshold: np.ndarray  # logits, by language

    def pooled(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Maxima of all filters per text; windows end with zeros, and a text
        without words is one zero."""
        n = len(at) - 1
        out = np.zeros((n, sum(f.shape[2] for f in self.filters)), np.float32)
        some = np.flatnonzero(np.diff(at))
        if not len(some):
            return out
        e = _embedded(self.words, ids)
        left = np.repeat(at[1:], np.diff(at)) - np.arange(len(e))
        column = 0
        for f in self.filters:
            c = e @ f[0]
            for k in range(1, len(f)):
                if len(e) > k:
                    c[:-k] += np.where(left[:-k, None] > k, e[k:] @ f[k], 0)
            out[some, column : column + f.shape[2]] = np.maximum.reduceat(c, at[:-1][some], axis=0)
            column += f.shape[2]
        return out

    def logits(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.pooled(ids, at) @ self.weight + self.bias

    def scores(self, logits: np.ndarray, language: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(logits.astype(np.float64) - self.threshold[language], -30, 30)))


#: Pooled columns of filters wider than 0, 1, 2 ...: WIDTHS ascend, so these are the last ones.
_REACH = [sum(k for w, k in WIDTHS if w > offset) for offset in range(WIDTHS[-1][0])]


@dataclass
class _Weights:
    """A model in training, with its sums of squared gradients: dense holds the
    filters by offset, the logistic layer and the bias."""

    words: np.ndarray
    seen_words: np.ndarray
    dense: np.ndarray
    seen_dense: np.ndarray

    def copy(self) -> _Weights:
        return _Weights(self.words.copy(), self.seen_words.copy(), self.dense.copy(), self.seen_dense.copy())

    def model(self) -> Model:
        flat, weight = self.dense[: DIM * sum(_REACH)].reshape(DIM, -1), self.dense[DIM * sum(_REACH) : -1]
        by_offset = np.split(flat, np.cumsum(_REACH)[:-1], axis=1)
        ends = np.cumsum([k for _, k in WIDTHS]) - _REACH[0]  # columns from the right
        cut = lambda f, end, k: f[:, f.shape[1] + end - k : f.shape[1] + end]
        filters = [np.stack([cut(by_offset[o], end, k) for o in range(w)]) for (w, k), end in zip(WIDTHS, ends)]
        return Model(self.words, filters, weight.copy(), float(self.dense[-1]), np.zeros(len(_LANGUAGES) + 1))


def _begun() -> _Weights:
    rng = np.random.default_rng(SEED)
    words = rng.normal(0, 0.05, (IDS * BUCKETS, DIM)).astype(np.float32)
    filters = [rng.normal(0, (w * DIM) ** -0.5, (w, DIM, k)).astype(np.float32) for w, k in WIDTHS]
    weight = np.abs(rng.normal(0.5, 0.1, _REACH[0])).astype(np.float32)
    weight[::3] *= -1
    flat = np.concatenate([f[o] for o in range(len(_REACH)) for f in filters if len(f) > o], axis=1)
    dense = np.concatenate([flat.ravel(), weight, [np.float32(-1)]])
    return _Weights(words, np.full(len(words), 1e-2, np.float32), dense, np.full(len(dense), 1e-2, np.float32))


@dataclass
class _Block:
    """Texts as places (``index``) in a list of distinct words (``ids``)."""

    number: int
    ids: np.ndarray
    index: np.ndarray
    at: np.ndarray
    toxic: np.ndarray
    fold: np.ndarray
    language: np.ndarray


_BLOCK = "replica int, block int, keys binary, index binary, lengths binary, toxic binary, fold binary, language binary"


def _packed(key: tuple, rows: pa.Table) -> pa.Table:
    """One row (_BLOCK) for all texts of a block, in the order of their ids."""
    rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
    keys, lengths, languages = [np.zeros(0, np.uint64)], [], []
    for batch in rows.select(["text"]).to_batches():
        for _, _, ids, at, language in encoded(batch.column(0)):
            keys.append((ids % BUCKETS).astype(np.uint16).view(np.uint64)[:, 0])  # IDS of two bytes
            lengths.append(np.diff(at))
            languages.append(language)
    known, index = np.unique(np.concatenate(keys), return_inverse=True)
    index = index.astype(np.uint16 if len(known) <= 1 << 16 else np.uint32)
    out = [known, index, np.concatenate(lengths).astype(np.int32), rows["toxic"].to_numpy().astype(np.int8), rows["fold"].to_numpy().astype(np.int8), np.concatenate(languages).astype(np.int8)]
    cells = [pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in out)]
    return pa.Table.from_arrays(cells, names=["replica", "block", "keys", "index", "lengths", "toxic", "fold", "language"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _Block]]:
    for batch in batches:
        for i in range(batch.num_rows):
            cell = lambda name, kind: np.frombuffer(batch.column(name)[i].as_buffer(), kind)  # noqa: E731, B023
            keys = cell("keys", np.uint64)
            ids = keys.view(np.uint16).reshape(-1, IDS).astype(np.int32) + np.arange(IDS, dtype=np.int32) * BUCKETS
            index = cell("index", np.uint16 if len(keys) <= 1 << 16 else np.uint32).astype(np.int64)
            at = np.append(0, np.cumsum(cell("lengths", np.int32), dtype=np.int64))
            yield batch.column("replica")[i].as_py(), _Block(
                batch.column("block")[i].as_py(), ids, index, at, cell("toxic", np.int8), cell("fold", np.int8), cell("language", np.int8)
            )


def _step(s: _Weights, block: _Block, texts: np.ndarray, lift: float) -> None:
    """One AdaGrad step on some texts of a block."""
    width, columns, every = sum(_REACH), _REACH[0], np.arange(_REACH[0])
    flat, weight = s.dense[: DIM * width].reshape(DIM, width), s.dense[DIM * width : -1]
    y = block.toxic[texts].astype(np.float32)
    pooled = np.zeros((len(texts), columns), np.float32)  # without words all zeros
    sizes = block.at[texts + 1] - block.at[texts]
    some = np.flatnonzero(sizes)
    ends = np.cumsum(sizes[some])
    if len(some):
        index = np.concatenate([block.index[block.at[t] : block.at[t + 1]] for t in texts[some]])
        there = np.zeros(len(block.ids), bool)
        there[index] = True
        known = np.flatnonzero(there)
        word = (np.cumsum(there) - 1).take(index)
        ids = block.ids.take(known, axis=0)
        e = _embedded(s.words, ids)
        table = e @ flat
        place = np.empty((len(some), columns), np.int64)
        for i, (t, end, size) in enumerate(zip(some, ends, sizes[some])):
            hit = table.take(word[end - size : end], axis=0)
            c, column = hit[:, :columns], columns
            for offset, reach in enumerate(_REACH[1:], 1):  # windows end with zeros
                if size > offset:
                    c[:-offset, columns - reach :] += hit[offset:, column : column + reach]
                column += reach
            place[i] = first = c.argmax(axis=0)
            pooled[t] = c[first, every]
        place += (ends - sizes[some])[:, None]
    p = 1 / (1 + np.exp(-np.clip(pooled @ weight + s.dense[-1], -30, 30)))
    d = ((p - y) * np.where(y > 0, np.float32(lift), np.float32(1)) / len(texts)).astype(np.float32)
    g_dense = np.zeros(len(s.dense), np.float32)
    g_flat = g_dense[: DIM * width].reshape(DIM, width)
    g_dense[DIM * width : -1] = d @ pooled
    if len(some):
        dz = d[some, None] * weight
        rows, grads, column = [], [], 0
        for offset, reach in enumerate(_REACH):
            at, mine = place[:, columns - reach :] + offset, dz[:, columns - reach :]
            ok = at < ends[:, None]
            w = word[np.where(ok, at, 0)]
            g_flat[:, column : column + reach] = np.einsum("ncd,nc->dc", e.take(w, axis=0), np.where(ok, mine, 0))
            rows.append(w[ok])
            grads.append((flat[:, column : column + reach].T[None] * mine[:, :, None])[ok])
            column += reach
        touched, inverse = np.unique(np.concatenate(rows), return_inverse=True)
        by_word = np.zeros((len(touched), DIM), np.float32)
        np.add.at(by_word, inverse, np.concatenate(grads))
        touched, inverse = np.unique(ids[touched], return_inverse=True)
        g = np.zeros((len(touched), DIM), np.float32)
        for side in range(IDS):
            np.add.at(g, inverse.reshape(-1, IDS)[:, side], by_word)
        s.seen_words[touched] += (g * g).mean(axis=1)
        s.words[touched] -= RATE * g / np.sqrt(s.seen_words[touched])[:, None]
    s.seen_dense[:-1] += g_dense[:-1] ** 2
    s.dense[:-1] -= RATE * g_dense[:-1] / np.sqrt(s.seen_dense[:-1])
    s.dense[-1] -= RATE * d.sum()


_MOVED = "model int, slice int, replica int, at binary, words binary, seen binary"


def _moves(model: int, replica: int, old: _Weights, new: _Weights) -> Iterator[pa.RecordBatch]:
    """What training has changed, by slices of the embeddings; slice -1 is dense."""
    size = len(old.words) // SLICES
    for k in range(-1, SLICES):
        if k < 0:
            at, words, seen = np.zeros(0, np.int32), new.dense - old.dense, new.seen_dense - old.seen_dense
        else:
            at = np.flatnonzero(new.seen_words[k * size : (k + 1) * size] != old.seen_words[k * size : (k + 1) * size]).astype(np.int32) + np.int32(k * size)
            words, seen = new.words[at] - old.words[at], new.seen_words[at] - old.seen_words[at]
        cells = [*(pa.array([x], pa.int32()) for x in (model, k, replica)), *(pa.array([x.tobytes()], pa.binary()) for x in (at, words, seen))]
        yield pa.RecordBatch.from_arrays(cells, names=["model", "slice", "replica", "at", "words", "seen"])


def _averaged(rows: pa.Table) -> pa.Table:
    """The mean of the replicas' moves in one slice; an embedding's over the
    replicas that have moved it."""
    rows = rows.sort_by("replica")
    read = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in rows[name]]
    at, words, seen = read("at", np.int32), read("words", np.float32), read("seen", np.float32)
    if rows["slice"][0].as_py() < 0:
        touched, out = np.zeros(0, np.int32), [np.mean(x, axis=0, dtype=np.float64) for x in (words, seen)]
    else:
        touched, inverse, n = np.unique(np.concatenate(at), return_inverse=True, return_counts=True)
        out = [np.zeros((len(touched), DIM)), np.zeros((len(touched), 1))]
        for total, parts in zip(out, (words, seen)):
            np.add.at(total, inverse, np.concatenate(parts).reshape(len(inverse), -1))
            total /= n[:, None]
    cells = [rows["model"][:1], rows["slice"][:1], rows["replica"][:1], *(pa.array([x.tobytes()], pa.binary()) for x in (touched, *(x.astype(np.float32) for x in out)))]
    return pa.Table.from_arrays(cells, names=["model", "slice", "replica", "at", "words", "seen"])


def _trained(blocks: DataFrame, replicas: int, lifts: list[float], passes: int) -> list[_Weights]:
    """Models 0, 1, ... of all rows but those of their fold; the last of all rows."""
    spark = blocks.sparkSession
    models = [_begun() for _ in lifts]
    at_once = passes if replicas == 1 else 1  # a single replica need not be averaged
    for first in range(0, passes, at_once):
        shared = spark.sparkContext.broadcast(models)

        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for replica, mine in itertools.groupby(_blocks(batches), key=lambda x: x[0]):
                mine = list(mine) if at_once > 1 else mine
                new = [m.copy() for m in shared.value]
                for n in range(first, first + at_once):
                    for _, block in mine:
                        order = np.random.default_rng((SEED, n, block.number)).permutation(len(block.toxic))
                        for m, s in enumerate(new):
                            texts = order[block.fold[order] != m]
                            for batch in np.array_split(texts, max(1, len(texts) // BATCH)) if len(texts) else ():
                                _step(s, block, batch, lifts[m])
                for m, (old, s) in enumerate(zip(shared.value, new)):
                    yield from _moves(m, replica, old, s)

        moved = blocks.mapInArrow(train, _MOVED)
        if replicas > 1:
            moved = moved.groupBy("model", "slice").applyInArrow(_averaged, _MOVED)
        for row in moved.toArrow().to_pylist():
            s = models[row["model"]]
            words, seen = np.frombuffer(row["words"], np.float32), np.frombuffer(row["seen"], np.float32)
            if row["slice"] < 0:
                s.dense += words
                s.seen_dense += seen
            else:
                at = np.frombuffer(row["at"], np.int32)
                s.words[at] += words.reshape(-1, DIM)
                s.seen_words[at] += seen
        shared.destroy()
    return models


def cuts(rows: DataFrame) -> dict[int, float]:
    """By ``part``, of rows (part, logit, toxic) with both classes: the middle of
    the gap that makes the fewest errors, the highest of equals.  Bins are
    counted first; only those that can hold such a gap are looked into."""
    fine = F.greatest(F.lit(-LAST_BIN), F.least(F.lit(LAST_BIN), F.floor(F.col("logit") * BINS))).cast("int")
    rows = rows.groupBy("part", "logit").agg(F.sum("toxic").alias("ones"), F.sum(1 - F.col("toxic")).alias("zeros")).withColumn("bin", fine)
    counted = rows.groupBy("part", "bin").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"), F.max("logit").alias("last")).collect()
    parts = {}
    for part, own in itertools.groupby(sorted(counted, key=lambda r: (r["part"], r["bin"])), key=lambda r: r["part"]):
        own = list(own)
        below, above = np.cumsum([0] + [r["ones"] for r in own]), np.cumsum([0] + [r["zeros"] for r in own])
        errors = below + above[-1] - above  # of a cut before each bin, and after all
        look = [i for i, r in enumerate(own) if errors[i] - r["zeros"] <= errors.min()]
        if below[-1] and above[-1]:
            parts[part] = (own, errors, {own[i]["bin"]: i for i in look})
    found = {part: [(int(errors[-1]), -np.inf, own[-1]["last"] + 1)] for part, (own, errors, _) in parts.items()}
    wanted = F.lit(False)
    for part, (_, _, look) in parts.items():
        wanted = wanted | ((F.col("part") == part) & F.col("bin").isin(list(look)))
    by_logit = Window.partitionBy("part", "bin").orderBy("logit")
    before = F.sum(F.col("ones") - F.col("zeros")).over(by_logit.rowsBetween(Window.unboundedPreceding, -1))
    inside = rows.where(wanted).select("part", "bin", F.coalesce(before, F.lit(0)).alias("more"), (-F.col("logit")).alias("minus"), F.lag("logit").over(by_logit).alias("last"))
    for r in inside.groupBy("part", "bin").agg(F.min(F.struct("more", "minus", "last")).alias("best")).collect():
        own, errors, look = parts[r["part"]]
        i, (more, minus, last) = look[r["bin"]], r["best"]
        last = own[i - 1]["last"] if last is None and i else last
        found[r["part"]].append((int(errors[i]) + more, minus, -minus - 1 if last is None else (last - minus) / 2))
    return {part: float(min(some)[2]) for part, some in found.items()}


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on all rows of ``docs`` (doc_id, text) with labels (doc_id, toxic) 0
    or 1.  Without labels of both classes every score is the prior."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    if known.count() <= BROADCAST:
        known = F.broadcast(known)
    parts = FOLDS[0] * FOLDS[1]
    part = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(parts)).cast("int")
    sizes = docs.select("doc_id", F.octet_length("text").alias("size")).join(known, "doc_id")
    sizes = sizes.groupBy(part.alias("part"), "toxic").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()
    n = [sum(r["n"] for r in sizes if r["toxic"] == k) for k in (0, 1)]
    if not min(n):
        return Model(
            np.zeros((IDS * BUCKETS, DIM), np.float32), [np.zeros((w, DIM, k), np.float32) for w, k in WIDTHS],
            np.zeros(_REACH[0], np.float32), 1.0 if n[1] else -1.0, np.zeros(len(_LANGUAGES) + 1)
        )
    folds = FOLDS[0 if sum(n) < SMALL else 1]
    size = sum(r["size"] or 0 for r in sizes)
    replicas = min(MOST_REPLICAS, 1 + size // REPLICA_BYTES)
    count = max(replicas, 1 + size // BLOCK_BYTES)
    block = F.pmod(F.xxhash64("doc_id", F.lit("block")), F.lit(count)).cast("int")
    rows = docs.select("doc_id", "text").join(known, "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic", (part % folds).alias("fold"), block.alias("block"))
    blocks = rows.withColumn("replica", F.col("block") % replicas).groupBy("replica", "block").applyInArrow(_packed, _BLOCK)
    # Every pass reads them, so the shuffled parts of the replicas stay where they are.
    blocks = blocks.repartitionById(replicas, F.col("replica")).sortWithinPartitions("replica", "block").persist(StorageLevel.DISK_ONLY)
    lifts = []
    for fold in range(folds + 1):
        zeros, ones = (sum(r["n"] for r in sizes if r["toxic"] == k and r["part"] % folds != fold) for k in (0, 1))
        lifts.append(min(8.0, max(1.0, zeros / max(1, ones))) ** 0.5)
    *others, final = _trained(blocks, replicas, lifts, max(EPOCHS, min(MOST_EPOCHS, STEPS // sum(n))))
    shared = docs.sparkSession.sparkContext.broadcast([s.model() for s in others])

    def held_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in _blocks(batches):
            logits = np.zeros(len(block.toxic))
            for fold, m in enumerate(shared.value):
                mine = np.flatnonzero(block.fold == fold)
                index = [block.index[block.at[t] : block.at[t + 1]] for t in mine]
                if len(mine):
                    logits[mine] = m.logits(block.ids[np.concatenate(index)], np.append(0, np.cumsum([len(x) for x in index])))
            cells = [block.language.astype(np.int32), logits, block.toxic.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cells], names=["language", "logit", "toxic"])

    held = blocks.mapInArrow(held_back, "language int, logit double, toxic int").persist(StorageLevel.DISK_ONLY)
    enough = [r["language"] for r in held.groupBy("language").agg(F.sum("toxic").alias("n"), F.sum(1 - F.col("toxic")).alias("m")).collect() if min(r["n"], r["m"]) >= ENOUGH]
    each = F.explode(F.array_distinct(F.array(F.lit(len(_LANGUAGES)), F.col("language"))))
    found = cuts(held.select(each.alias("part"), "logit", "toxic"))
    held.unpersist()
    blocks.unpersist()
    model = final.model()
    model.threshold[:] = found[len(_LANGUAGES)]
    for k in range(len(_LANGUAGES)):
        if k in enough:
            model.threshold[k] = found[k]
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """row (a struct of all columns of ``docs``) and score, from 0 to 1, of its
    whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # four megabytes, whatever the corpus
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, j, ids, at, language in encoded(pc.struct_field(batch.column("row"), "text")):
                out[i:j] = shared.value.scores(shared.value.logits(ids, at), language)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out)], names=["row", "score"])

    return rows.mapInArrow(score, StructType([rows.schema["row"], StructField("score", DoubleType())]))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_on_rest(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(docs, labels.where(~held_out(F.col("doc_id"))))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5) for every row.

    A null text counts as empty and is scored as such; a null doc_id is scored
    but never learned from.  Repeated rows get equal scores; a doc_id labelled
    twice counts as toxic if any label says so.  Labels other than 0 and 1 are
    ignored.  No rows give no rows; other columns are ignored."""
    out = scored(docs.select("doc_id", "text"), fit_on_rest(docs, labels))
    return out.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are not predicted toxic, columns as they were, whatever
    their names."""
    return scored(docs, fit_on_rest(docs, labels)).where("score < 0.5").select("row.*")
