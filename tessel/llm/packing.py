"""Sequence packing by bin completion.

Documents become token pieces of at most ``capacity``; what is packed is the
histogram of piece lengths, at most ``capacity`` counts whatever the corpus,
so the search runs on the driver over bounded data.  Whole packings come first:
best fit, least-waste fillings of one bin after the other (NODES steps each),
and the same with the longest pieces packed apart.  Unless the best of them
meets the lower bound, branch and bound goes over the undominated fillings of
the largest length left, for STEPS steps: to its end, and then the packing is
optimal, where the histogram is small.  Pieces find their places by their rank
in their length.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tessel.llm.naming import fresh
from tessel.storage import written

CAPACITY = 4096
END_ID = 1
#: Ranks are counted in so many parts of each length, so that no length is one task's.
SALTS = 128
#: Fillings looked at for each bin pattern before the incumbent is taken.
NODES = 2000
#: Lengths looked at by the branch and bound over all bins before the incumbent is taken.
STEPS = 2_000_000
#: Shares of the pieces that the first splits pack apart are multiples of 1 / SPLITS.
SPLITS = 16
#: Words whose ids a worker remembers before it starts anew.
CACHE_WORDS = 400_000

#: Fixed value: the word pattern of the tokenizers whose words are looked up one by one.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters that are cut into words at once; a longer text is cut at a blank.
CHUNK = 1 << 16
#: New words that go to the tokenizer as one text.
ASKED = 200

_LETTER, _NUMBER, _BLANK = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_BLANK}{_LETTER}{_NUMBER}]+")
_ODD = re.compile(r"[^\x00-\x1b\x20-\xff]|<\|(?:startoftext|endoftext)\|>")
_GAP = re.compile(r"[ \t-\r]+")


class WordIds(dict):
    """Ids, as little-endian bytes, by word.  What a chunk of texts has of new
    words goes to the tokenizer as one text, its normalizer and word pattern
    left out, for the words have been through both.  Runs outside Latin-1 go to
    the whole tokenizer, blank to blank, and so does every text where the file
    is of another kind than lower-case BPE with word ends."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_word = spec["model"].get("end_of_word_suffix") == "</w>" and [s.get("pattern") for s in steps] == [{"Regex": WORD_PATTERN}, None] and {"type": "Lowercase"} in (spec["normalizer"] or {}).get("normalizers", [])
        if self.by_word:
            spec |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, steps[1]]}}
            self.words = Tokenizer.from_str(json.dumps(spec))
            self.ends = np.zeros(self.words.get_vocab_size(), bool)
            self.ends[[i for token, i in self.words.get_vocab().items() if token.endswith("</w>")]] = True

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, plain: set[str], odd: set[str]) -> None:
        if len(self) > CACHE_WORDS:
            self.clear()
        for run in (r for r in odd if r not in self):
            self[run] = self._whole(run)
        new = [w for w in plain if w not in self]
        for k in range(0, len(new), ASKED):
            some = new[k : k + ASKED]
            ids = np.asarray(self.words.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            data, stops = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            self.update(zip(some, map(data.__getitem__, map(slice, [0, *stops], stops))))

    def _split(self, text: str) -> Iterator[tuple[list[str], set[str]]]:
        """(words, those of them that the whole tokenizer takes), chunk by chunk."""
        at = 0
        while at < len(text):
            gap = _GAP.search(text, at + CHUNK)
            part = text[at : gap.start() if gap else len(text)]
            at = gap.end() if gap else len(text)
            if not _ODD.search(part):
                yield _WORD.findall(part.lower()), set()
                continue
            words, odd = [], set()
            for run in _GAP.split(part):
                if _ODD.search(run):
                    words.append(run)
                    odd.add(run)
                else:
                    words += _WORD.findall(run.lower())
            yield words, odd

    def _ids(self, parts: list[tuple[list[str], set[str]]]) -> list[bytes]:
        odd = set().union(*(o for _, o in parts))
        self._learn(set().union(*(w for w, _ in parts)) - odd, odd)
        return [b"".join(map(self.__getitem__, words)) for words, _ in parts]

    def texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; short ones together are one chunk."""
        if not self.by_word:
            return [self._whole(t) for t in texts]
        if sum(map(len, texts)) <= CHUNK:
            return self._ids([next(self._split(t), ([], set())) for t in texts])
        return [b"".join(ids for part in self._split(t) for ids in self._ids([part])) for t in texts]


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


@functools.cache
def word_ids(path: str) -> WordIds:
    """One for all tasks of a worker."""
    return WordIds(path)


def _in_chunks(ids: WordIds, text: pa.Array) -> Iterator[bytes]:
    held, size = [], 0
    for value in text:
        value = value.as_py() or ""
        if held and size + len(value) > CHUNK:
            yield from ids.texts(held)
            held, size = [], 0
        held.append(value)
        size += len(value)
    yield from ids.texts(held)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 [, ids]: every document's ids and
    the end id, cut only where longer than ``capacity``.  A null or empty text
    is the end id alone."""
    schema = PIECES.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else PIECES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = word_ids(tokenizer_path), np.asarray([END_ID], "<u4").tobytes()
        for batch in batches:
            rows: list[list] = [[] for _ in schema]
            for doc, data in zip(batch.column(0).to_pylist(), _in_chunks(ids, batch.column(1))):
                data += end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    found = [doc, k, at // 4, len(part) // 4, zlib.crc32(part)]
                    for column, value in zip(rows, [*found, np.frombuffer(part, "<u4").astype(np.int32)] if with_ids else found):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kinds)


def fill(room: int, counts: np.ndarray, nodes: int = NODES) -> list[int]:
    """Lengths, descending, that fill ``room`` best: least waste, then largest
    lengths first.  counts[n]: pieces of length n that are left."""
    have = np.flatnonzero(counts[: room + 1])
    have = have[have > 0]
    if not len(have):
        return []
    largest = np.zeros(room + 1, np.int64)  # the largest length left of at most n
    largest[have] = have
    np.maximum.accumulate(largest, out=largest)
    smallest = int(have[0])
    best: list[int] = []
    left, most = room, room
    used: dict[int, int] = {}
    while left >= smallest:  # best fit, the first incumbent
        n = int(largest[min(left, most)])
        while n and used.get(n, 0) >= counts[n]:
            n = int(largest[n - 1])
        if not n:
            break
        best.append(n)
        used[n] = used.get(n, 0) + 1
        left, most = left - n, n
    waste, budget = left, nodes
    if waste == 0:
        return best
    chosen: list[int] = []
    used = {}

    def search(left: int, most: int) -> bool:
        nonlocal best, waste, budget
        n = int(largest[min(left, most)]) if left > 0 else 0
        if not n and left < waste:
            best, waste = chosen[:], left
            return waste == 0
        tried = False
        while n:
            budget -= 1
            if budget < 0:
                break
            if used.get(n, 0) < counts[n]:
                rest = left - n
                # What is left can be filled only by lengths of n or less: without any, all of it is waste.
                if rest < waste or rest >= smallest:
                    tried = True
                    chosen.append(n)
                    used[n] = used.get(n, 0) + 1
                    done = search(rest, n)
                    chosen.pop()
                    used[n] -= 1
                    if done:
                        return True
            n = int(largest[n - 1])
        if not tried and left < waste:
            best, waste = chosen[:], left
        return waste == 0

    search(room, room)
    return best


def greedy_bins(counts: np.ndarray, capacity: int, nodes: int = NODES) -> list[tuple[list[int], int]]:
    """Bins around the largest length left, each filled best (by best fit
    alone, if ``nodes`` is 0) and applied as often as the counts allow."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[list[int], int]] = []
    top = capacity
    while True:
        while top > 0 and left[top] == 0:
            top -= 1
        if top == 0:
            return out
        left[top] -= 1
        filling = [top, *fill(capacity - top, left, nodes)]
        left[top] += 1
        lengths, each = np.unique(filling, return_counts=True)
        times = int((left[lengths] // each).min())
        left[lengths] -= each * times
        out.append((filling, times))


def bins_needed(counts: np.ndarray, capacity: int) -> int:
    """A lower bound (Martello and Toth's L2, the area among its cases)."""
    number, area = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 1))
    k = np.arange(capacity // 2 + 1)
    half = number[capacity // 2]
    large = number[-1] - half  # no two of these in a bin
    room = (number[capacity - k] - half) * capacity - (area[capacity - k] - area[capacity // 2])
    small = area[capacity // 2] - np.where(k > 0, area[k - 1], 0)
    return int(large + np.maximum(0, -(-(small - room) // capacity)).max())


class _Spent(Exception):
    """The steps of the branch and bound are used up."""


def _branch(counts: np.ndarray, capacity: int, best: int, steps: int) -> list[list[int]] | None:
    """Bins of an optimal packing if it has less than ``best`` bins; the best
    one found, or None, once ``steps`` lengths were looked at."""
    left = counts.astype(np.int64).copy()
    least = bins_needed(left, capacity)
    found: list[list[int]] | None = None

    def fillings(room: int) -> list[list[int]]:
        """Undominated: no length left that could take the place of some of
        the filling's lengths, or of none, would fill the bin better."""
        nonlocal steps
        have = [int(n) for n in np.flatnonzero(left[: room + 1])[::-1] if n]
        out: list[tuple[int, list[int]]] = []
        stack: list[tuple[int, int, list[int]]] = [(0, room, [])]
        while stack:
            at, rest, chosen = stack.pop()
            steps -= 1
            if steps < 0:
                raise _Spent
            if at == len(have) or rest < have[-1]:
                steps -= len(have)
                sums = 1
                for n in chosen:
                    sums |= sums << n
                if not any(left[n] > chosen.count(n) and sums >> max(n - rest, 0) & (1 << min(n, rest)) - 1 for n in have):
                    out.append((rest, chosen))
                continue
            for k in range(min(int(left[have[at]]), rest // have[at]) + 1):
                stack.append((at + 1, rest - k * have[at], chosen + [have[at]] * k))
        return [chosen for _, chosen in sorted(out, key=lambda x: x[0])]

    def branches() -> list[list[int]]:
        top = int(np.flatnonzero(left)[-1])
        left[top] -= 1
        try:
            return [[top, *chosen] for chosen in fillings(capacity - top)]
        finally:
            left[top] += 1

    bins: list[list[int]] = []
    try:
        todo = [iter(branches())] if left.any() and least < best else []
        while todo:
            if len(bins) == len(todo):  # back from the branch below
                np.add.at(left, bins.pop(), 1)
            filling = next(todo[-1], None)
            if filling is None or best == least:
                todo.pop()
                continue
            bins.append(filling)
            np.subtract.at(left, filling, 1)
            if not left.any():
                if len(bins) < best:
                    best, found = len(bins), [*bins]
            elif len(bins) + bins_needed(left, capacity) < best:
                todo.append(iter(branches()))
    except _Spent:
        pass
    return found


def complete_bins(counts: np.ndarray, capacity: int = CAPACITY, steps: int = STEPS) -> list[tuple[list[int], int]]:
    """[(lengths of one bin, number of such bins)] for a histogram of lengths."""
    size = lambda bins: sum(times for _, times in bins)
    counts = counts.astype(np.int64)
    least = bins_needed(counts, capacity)
    best = greedy_bins(counts, capacity)
    if size(best) > least:
        best = min(best, greedy_bins(counts, capacity, 0), key=size)

    def apart(share: float) -> list[tuple[list[int], int]]:
        """Pieces beyond the smallest ``share`` share no bin with the others."""
        low = np.clip(int(share * counts.sum()) - (np.cumsum(counts) - counts), 0, counts)
        return greedy_bins(counts - low, capacity) + greedy_bins(low, capacity)

    step, middle = 1 / SPLITS, 0.5
    tried = [k / SPLITS for k in range(1, SPLITS)]
    while tried and size(best) > least:
        sizes = [(size(bins), share, bins) for share in tried for bins in [apart(share)]]
        said, middle, bins = min(sizes, key=lambda x: x[0])
        if said < size(best):
            best = bins
        step /= 2
        tried = [middle - step, middle + step] if step > 0.004 else []
    if size(best) > least and (found := _branch(counts, capacity, size(best), steps)):
        return [(filling, 1) for filling in found]
    return best


def _segments(bins: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length << 40 | first rank, first sequence, copies in a bin, offset)."""
    ranks: dict[int, int] = {}
    rows, sequence = [], 0
    for filling, times in bins:
        at = 0
        for n in sorted(set(filling), reverse=True):
            each = filling.count(n)
            rows.append((n << 40 | ranks.get(n, 0), sequence, each, at))
            ranks[n] = ranks.get(n, 0) + each * times
            at += n * each
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows that have doc_id, piece, length (1 to
    ``capacity``) and ids_crc32.  Rows equal in all of these may trade places.
    No rows give no rows.  Other columns, whatever their names, are passed on,
    but for an earlier sequence_id and offset, which are replaced.  ``pieces``
    is read three times: pass a table."""
    pieces = pieces.drop("sequence_id", "offset")
    salt_name, rank_name = fresh(pieces, "salt", "rank")
    salted = pieces.withColumn(salt_name, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int"))
    table = np.zeros((capacity + 1, SALTS), np.int64)  # bounded: capacity x SALTS counts
    for n, salt, count in salted.groupBy("length", salt_name).count().collect():
        table[n, salt] = count
    first = np.cumsum(table, axis=1) - table
    plan = _segments(complete_bins(table.sum(axis=1), capacity))
    shared = pieces.sparkSession.sparkContext.broadcast((first, plan))  # at most capacity x 90 rows and the counts
    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, plan = shared.value
        for batch in batches:
            n = np.asarray(batch.column("length").to_numpy(), np.int64)
            rank = first[n, batch.column(salt_name).to_numpy()] + batch.column(rank_name).to_numpy() - 1
            row = np.searchsorted(plan[:, 0], n << 40 | rank, "right") - 1
            key, sequence, each, at = plan[row].T
            turn = rank - (key & (1 << 40) - 1)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sequence + turn // each), pa.array(at + turn % each * n)],
                names=[*names, "sequence_id", "offset"]
            )

    ranked = salted.withColumn(rank_name, F.row_number().over(Window.partitionBy("length", salt_name).orderBy("doc_id", "piece", "ids_crc32")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    return pack(written(token_pieces(docs, tokenizer_path, capacity, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids of pieces packed with ``with_ids``; a sequence
    holds at most ``capacity`` ids, so a group is bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    by = packed.groupBy("sequence_id").agg(parts.alias("p"))
    return by.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.doc_id").alias("doc_ids"))
