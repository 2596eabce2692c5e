"""Secret scans: fixed patterns, and a battery of randomness tests on other runs.

A run of token characters is tested in its inferred encoding, the narrowest
alphabet that holds it.  Three tests ask how far it is from random characters of
that alphabet, in the direction of writing: a chi-squared test of uniformity, the
number of runs of character classes, and the lag-1 serial correlation of codes.  Fisher's rule combines them:
the smaller the sum, the more random the run looks.

A run is a discovery if ordinary writing would hardly look that random.  The
logarithm of the sum is close to normal for runs written from ordinary words in
the styles of identifiers, paths and numbers; its mean and deviation, by style
and length, come from simulated runs (the same ones always).  The least
favourable style of the encoding gives the p-value, so short runs have large
ones.  False discoveries are controlled length class by length class: over the
whole corpus a Benjamini-Hochberg cut-off is taken from a histogram of log p.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessel.storage import written

#: Order of kinds in a list of spans that start together.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the maximal runs, as [0-9a-f]+ matches them, of 16 and more
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

#: Shorter runs are not tested: no test tells twenty characters from writing.
RUN_LEAST = 20
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Accepted share of false discoveries among the runs reported in a length class.
FDR = 0.01
#: Upper ends of the length classes, the last one open.
LENGTHS = (24, 32, 48, 64, 128)
#: log10 p is kept in steps of 1 / STEPS down to -BOTTOM.
STEPS, BOTTOM = 20, 60

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings, narrowest first: name, alphabet, styles of ordinary writing that it can be taken for.
ENCODINGS = (
    ("digits", _DIGITS, ("numbers",)),
    ("hex", _DIGITS + "abcdef", ("numbers",)),
    ("hex upper", _DIGITS + "ABCDEF", ("numbers",)),
    ("upper", _UPPER, ("words",)),
    ("lower", _LOWER, ("words",)),
    ("base32", _UPPER + "234567", ("words numbered",)),
    ("upper and digits", _DIGITS + _UPPER, ("words numbered",)),
    ("lower and digits", _DIGITS + _LOWER, ("words numbered",)),
    ("letters", _UPPER + _LOWER, ("words", "camel")),
    ("letters and digits", _UPPER + _LOWER + _DIGITS, ("camel", "camel numbered")),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/", ("camel numbered", "mixed")),
    ("base64url", _UPPER + _LOWER + _DIGITS + "-_", ("camel numbered", "mixed")),
    ("any", _UPPER + _LOWER + _DIGITS + "+/_-", ("camel numbered", "mixed")),
)
#: Ordinary words of identifiers and paths.
ORDINARY = (
    "the of and to in is that for with was this are image user account profile settings index static media download upload file path name value table column query result report data model train "
    "test main config server client request response message page home about contact search product order customer invoice payment address street city country phone email number date time year "
    "month day week hour minute second version release build branch commit project module package class function method object string list array map set key"
).split()
#: How much wider the spread of other words' runs is taken to be.
WIDER = 1.2
#: Lengths and runs of each that the styles are simulated at.
_SIMULATED, _DRAWS = (20, 28, 40, 64, 100, 160), 400


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, code points, end exclusive."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


_KIND = np.full(128, 3)
for _k, _some in enumerate((_DIGITS, _UPPER, _LOWER)):
    _KIND[[ord(c) for c in _some]] = _k
_VOWEL = np.zeros(128, np.int64)
_VOWEL[[ord(c) for c in "aeiouyAEIOUY"]] = 1


def _prepared(alphabet: str) -> tuple[set[str], int, np.ndarray, float, np.ndarray]:
    """The alphabet's characters and size, classes of characters (kinds, or
    vowels where there is one kind of letters), the chance that neighbours are of
    different classes, and codes for the serial test."""
    codes = np.frombuffer(alphabet.encode(), np.uint8)
    letters = _KIND[codes] > 0
    classes = _VOWEL if letters.all() and len(set(_KIND[codes])) == 1 else _KIND
    share = np.bincount(classes[codes]) / len(codes)
    return set(alphabet), len(codes), classes, 1 - float((share * share).sum()), _VOWEL if letters.sum() > 10 else np.arange(128)


_PREPARED = [_prepared(alphabet) for _, alphabet, _ in ENCODINGS]


def encoding(run: str) -> int:
    """Index of the narrowest encoding that holds the run."""
    found = set(run)
    return next(k for k, p in enumerate(_PREPARED) if found <= p[0])


def _tail(z: float) -> float:
    return max(0.5 * math.erfc(z / math.sqrt(2)), 1e-300)


def distance(run: str) -> tuple[int, float]:
    """(encoding, Fisher's sum of the three tests against random characters):
    about 6 for random characters, more for writing, more the longer it is."""
    body = run.rstrip("=") or run
    kind = encoding(body.replace("=", "_"))
    _, size, classes, change, codes = _PREPARED[kind]
    data = np.frombuffer(body.encode(), np.uint8)
    n = len(data)
    counts = np.bincount(data, minlength=128).astype(float)
    squared = size / n * float((counts * counts).sum()) - n
    spread = 2 / (9 * (size - 1))
    even = ((max(squared, 1e-9) / (size - 1)) ** (1 / 3) - 1 + spread) / math.sqrt(spread)  # Wilson and Hilferty
    total = math.log(_tail(even))
    if change > 0:
        more = int((classes[data[1:]] != classes[data[:-1]]).sum()) - (n - 1) * change
        more /= math.sqrt((n - 1) * change * (1 - change))
        total += math.log(_tail(more if classes is _VOWEL else -more))  # writing changes kind seldom, vowels and consonants often
    x = codes[data] - codes[data].mean()
    square = float((x * x).sum())
    serial = float((x[1:] * x[:-1]).sum()) / square * math.sqrt(n) if square > 0 else 30.0  # all codes equal: not random
    return kind, -2 * (total + math.log(_tail(-serial) if codes is _VOWEL else min(1.0, 2 * _tail(abs(serial)))))


def written_as(style: str, n: int, rng: np.random.Generator) -> str:
    """A run of n characters of ordinary writing."""
    out = ""
    while len(out) < n:
        word, number, way = ORDINARY[rng.integers(len(ORDINARY))], str(rng.integers(2030)), rng.integers(5)
        if style == "numbers":
            out += (number, str(20240000 + rng.integers(1300)), str(1000 * rng.integers(10)))[way % 3]
        elif style == "words numbered":
            out += word + str(rng.integers(100))
        elif style == "camel numbered":
            out += (word, number, word.capitalize(), word.capitalize(), word.capitalize())[way]
        elif style == "mixed":
            out += (word + "/", word.capitalize(), word + "_", number, word + "-")[way]
        else:
            out += word.capitalize() if style == "camel" else word
    return out[:n]


@functools.cache
def ordinary() -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """By style: mean and deviation of the logarithm of ``distance`` at the
    lengths of _SIMULATED."""
    rng = np.random.default_rng(20240505)
    out = {}
    for style in dict.fromkeys(s for _, _, styles in ENCODINGS for s in styles):
        logs = np.array([[math.log(distance(written_as(style, n, rng))[1]) for _ in range(_DRAWS)] for n in _SIMULATED])
        out[style] = (logs.mean(axis=1), WIDER * logs.std(axis=1))
    return out


def battery(run: str, writing: dict[str, tuple[np.ndarray, np.ndarray]] | None = None) -> float:
    """log10 of the chance that ordinary writing looks as random as ``run``."""
    writing = writing or ordinary()
    kind, sum_ = distance(run)
    n = math.log(min(len(run), _SIMULATED[-1]))
    p = 0.0
    for style in ENCODINGS[kind][2]:
        mean, deviation = (np.interp(n, np.log(_SIMULATED), x) for x in writing[style])
        p = max(p, _tail((mean - math.log(max(sum_, 1e-9))) / deviation))
    return math.log10(p)


SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()), ("base", pa.list_(pa.string())), ("r_start", pa.list_(pa.int32())), ("r_end", pa.list_(pa.int32())),
        ("r_class", pa.list_(pa.int32())), ("r_bin", pa.list_(pa.int32()))
    ]
)


def _scan(writing: dict[str, tuple[np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in SCHEMA]
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py() or ""
                base = base_spans(text)
                starts, ends = [s for s, _, _ in base], list(itertools.accumulate((e for _, e, _ in base), max))
                runs = []
                for m in RUN.finditer(text):
                    a, b = m.span()
                    k = bisect.bisect_left(starts, b)  # of the base spans before the run's end, the last end
                    if not (k and ends[k - 1] > a):
                        runs.append((a, b, int(np.searchsorted(LENGTHS, b - a, "right")), min(int(-battery(m[0], writing) * STEPS), STEPS * BOTTOM)))
                for column, value in zip(rows, (doc, [f"{k}:{a}:{b}" for a, b, k in base], *([r[i] for r in runs] for i in range(4)))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, SCHEMA)], schema=SCHEMA)

    return run


def cut_offs(scanned: DataFrame) -> list[int]:
    """Per length class the least bin of -log10 p that is reported: the
    Benjamini-Hochberg rule over the class's runs in the whole corpus."""
    counts = np.zeros((len(LENGTHS) + 1, STEPS * BOTTOM + 1), np.int64)  # bounded histogram
    one = scanned.select(F.explode(F.arrays_zip("r_class", "r_bin")).alias("r")).groupBy("r.r_class", "r.r_bin").count()
    for k, b, n in one.collect():
        counts[k, b] = n
    above = counts[:, ::-1].cumsum(axis=1)[:, ::-1]
    p = 10.0 ** (-np.arange(counts.shape[1]) / STEPS)
    good = p * np.maximum(above[:, :1], 1) <= FDR * above
    return [int(np.argmax(g)) if g.any() else counts.shape[1] for g in good]


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans ``kind:start:end`` of the fixed patterns) and spans
    (those and the random runs), each by start, then kind.

    A null or empty text has no spans; rows are handled one by one, so repeated
    rows give repeated results.  No rows give no rows.  Other columns are
    ignored.  The corpus is scanned once, its spans are kept in a table.
    """
    scanned = written(
        docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
            _scan(ordinary()), "doc_id long, base array<string>, r_start array<int>, r_end array<int>, r_class array<int>, r_bin array<int>"
        ),
        "secrets"
    )
    least = F.array(*[F.lit(c) for c in cut_offs(scanned)])
    runs = F.filter(F.arrays_zip("r_start", "r_end", "r_class", "r_bin"), lambda r: r["r_bin"] >= least[r["r_class"]])
    random = F.transform(runs, lambda r: F.concat(F.lit("random:"), r["r_start"].cast("string"), F.lit(":"), r["r_end"].cast("string")))
    return scanned.select("doc_id", "base", in_order(F.concat("base", random)).alias("spans"))


def in_order(spans: Column) -> Column:
    rank = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.transform(spans, lambda s: F.struct(F.split(s, ":")[1].cast("int").alias("a"), F.array_position(rank, F.split(s, ":")[0]).alias("k"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])
