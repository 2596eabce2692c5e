"""Scalar normalizers as Column expressions (names, contacts, dates, codes)."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

#: Strings that stand for a missing value, compared trimmed and lower-case.
SENTINELS = ("", "null", "none", "n/a", "na", "-", "--", "00000000", "0000-00-00", "00.00.0000", "0/0/0", "1900-01-01")
FORMATS = ("yyyy-M-d", "yyyyMMdd", "d.M.yyyy", "M/d/yyyy", "M/d/yy", "yyyy/M/d")


def coerced(c: Column) -> Column:
    """Trimmed text; sentinels are null."""
    t = F.trim(c.cast("string"))
    return F.when(~F.lower(t).isin(*SENTINELS), t)


def _folds() -> tuple[str, str, dict[str, str]]:
    """By the rule "decompose for compatibility, drop combining marks, compose":
    characters and the one character each becomes, then the marks, which go;
    and the characters that become several."""
    one, several, marks = {}, {}, []
    for code in (*range(0x80, 0x2E80), *range(0xFB00, 0xFE00), *range(0xFF00, 0xFFE0)):
        c = chr(code)
        if unicodedata.combining(c):
            marks.append(c)
            continue
        plain = unicodedata.normalize("NFKC", "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)))
        if plain != c:
            (one if len(plain) == 1 else several)[c] = plain
    return "".join([*one, *marks]), "".join(one.values()), several


_MARKED, _PLAIN, _SEVERAL = _folds()
#: Of the characters that become several, those that names and addresses hold (Latin ligatures and digraphs, fractions).
_WIDE = {c: plain for c, plain in _SEVERAL.items() if c < "\u0250" or "\ufb00" <= c <= "\ufb06"}


def without_accents(c: Column) -> Column:
    """Letters without their marks, compatibility forms as plain characters."""

    def folded(x: Column) -> Column:
        wide = x
        for mark, plain in _WIDE.items():
            wide = F.replace(wide, F.lit(mark), F.lit(plain))
        x = F.when(x.rlike("[" + "".join(_WIDE) + "]"), wide).otherwise(x)
        return F.translate(x, _MARKED, _PLAIN)

    # Bound once, so that a long expression is not repeated; texts in ASCII stay as they are.
    return F.transform(F.array(c), lambda x: F.when(x.rlike(r"[^\x00-\x7F]"), folded(x)).otherwise(x))[0]


def nonempty(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def normalized_name(c: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(without_accents(c), "[.,]+", " "), r"\s+", " ")
    return nonempty(F.lower(F.trim(t)))


def normalized_full(first: Column, last: Column) -> Column:
    return normalized_name(F.concat_ws(" ", first, last))


def _capital(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1_000_000)))


def titled(c: Column) -> Column:
    """Per word: both sides of its first apostrophe, else each part between
    hyphens, else the word gets a capital and small letters."""
    def word(w: Column) -> Column:
        at = F.instr(w, "'")
        sides = F.concat(_capital(F.substring_index(w, "'", 1)), F.lit("'"), _capital(F.substr(w, at + 1)))
        return F.when(at > 0, sides).otherwise(F.array_join(F.transform(F.split(w, "-"), _capital), "-"))

    return F.array_join(F.transform(F.split(F.trim(c), r"\s+"), word), " ")


def title_letters(c: Column) -> Column:
    """A capital after every character that is no letter."""
    parts = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, _capital), "")


def split_name(c: Column, surnames: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """(first, last) of a full name: ``Last, First``; a known surname first in
    all capitals; else the last word is the surname."""
    t = coerced(c)
    comma = F.instr(t, ",") > 0
    head, rest = F.trim(F.substring_index(t, ",", 1)), F.trim(F.substr(t, F.instr(t, ",") + 1))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    n = F.size(words)
    known = F.array(*[F.lit(s) for s in surnames]).cast("array<string>")
    word = F.upper(words[0])
    front = (F.upper(t) == t) & t.rlike(r"\p{L}") & (F.array_contains(known, word) | F.array_contains(known, F.upper(without_accents(word))))
    first = F.when(comma, nonempty(rest)).when(n < 2, None).when(
        front, F.array_join(F.slice(words, 2, F.greatest(n - 1, F.lit(1))), " ")
    ).otherwise(F.array_join(F.slice(words, 1, F.greatest(n - 1, F.lit(1))), " "))
    last = F.when(comma, nonempty(head)).when(n == 1, words[0]).when(front, words[0]).otherwise(F.element_at(words, -1))
    return titled(first), titled(last)


def normalized_email(c: Column) -> Column:
    t = F.lower(coerced(c))
    local, domain = F.trim(F.substring_index(t, "@", 1)), F.trim(F.substr(t, F.instr(t, "@") + 1))
    local = F.trim(F.substring_index(local, "+", 1))
    google = domain.isin("gmail.com", "googlemail.com")
    local = F.when(google, F.replace(local, F.lit("."), F.lit(""))).otherwise(local)
    domain = F.when(google, F.lit("gmail.com")).otherwise(domain)
    return F.when((F.instr(t, "@") > 0) & (F.instr(domain, ".") > 0) & (local != "") & (domain != ""), F.concat(local, F.lit("@"), domain))


EXTENSION = r"(?i)\s*(?:ext|extension|x|#)\.?\s*(\d{1,6})\s*$"


def normalized_phone(c: Column, region: str | Column = "US") -> tuple[Column, Column]:
    """(E.164 number, extension).  US: ten digits by the numbering plan; DE:
    seven to twelve national digits; a leading + is kept.  Others are null."""
    t = coerced(c)
    ext = nonempty(F.regexp_extract(t, EXTENSION, 1))
    body = F.regexp_replace(t, EXTENSION, "")
    digits = F.regexp_replace(body, r"\D", "")
    region = F.lit(region) if isinstance(region, str) else region
    plus = F.trim(body).startswith("+") | F.trim(body).startswith("00")
    foreign = F.regexp_replace(digits, "^00", "")
    us = F.when(digits.rlike(r"^1?[2-9]\d{2}[2-9]\d{6}$"), F.concat(F.lit("+1"), F.substring(digits, -10, 10)))
    de = F.when(digits.rlike(r"^0?[1-9]\d{6,11}$"), F.concat(F.lit("+49"), F.regexp_replace(digits, "^0", "")))
    abroad = F.when(foreign.rlike(r"^1[2-9]\d{2}[2-9]\d{6}$") | foreign.rlike(r"^49[1-9]\d{6,11}$") | foreign.rlike(r"^(?!1|49)[2-9]\d{7,14}$"), F.concat(F.lit("+"), foreign))
    dated = body.rlike(r"^\s*\d{1,4}[/.]\d{1,2}[/.]\d{1,4}\s*$")
    number = F.when(dated | (F.length(digits) < 7), None).when(plus, abroad).when(region == "DE", de).otherwise(us)
    return number, F.when(number.isNotNull(), ext)


def parsed_date(c: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """Date of a text: an Excel serial of five or six digits, else the first
    format that fits; two-digit years are 1969 to 2068."""
    t = coerced(c)
    serial = F.when(t.rlike(r"^\d{5,6}$"), t.cast("int"))
    found = [F.when(serial.between(1, 90000), F.date_add(F.lit("1899-12-30").cast("date"), serial))]
    for f in formats:
        if f == "yyyyMMdd":
            found.append(F.when(t.rlike(r"^\d{8}$"), F.try_to_timestamp(t, F.lit(f)).cast("date")))
        elif f.endswith("yy") and not f.endswith("yyyy"):
            d = F.when(t.rlike(r"\D\d{2}$"), F.try_to_timestamp(t, F.lit(f)).cast("date"))
            found.append(F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d))
        else:
            found.append(F.when(t.rlike(r"^\d+\D\d+\D\d+$"), F.try_to_timestamp(t, F.lit(f)).cast("date")))
    found.append(F.try_to_timestamp(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}T"), F.substring(t, 1, 10)), F.lit("yyyy-M-d")).cast("date"))
    return F.coalesce(*found)


def birth_year(c: Column) -> Column:
    y = F.year(parsed_date(c))
    return F.when(y.between(1900, F.year(F.current_date())), y)


def padded_zip(c: Column) -> tuple[Column, Column]:
    """(zip, whether a lost leading zero was put back)."""
    t = F.trim(c)
    short = F.substring_index(t, "-", 1).rlike(r"^\d{4}$")
    return F.when(short, F.concat(F.lit("0"), t)).otherwise(t), F.coalesce(short, F.lit(False))


def german_decimal(c: Column) -> Column:
    t = coerced(c)
    return F.when(F.contains(t, F.lit(",")), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(t).try_cast("double")


def pii_hash(c: Column, pepper: str) -> Column:
    return F.sha2(F.concat(F.lit(pepper), c), 256)


def street_token(c: Column, pepper: str) -> Column:
    return F.substring(pii_hash(F.lower(nonempty(c)), pepper), 1, 16)


#: Fixed value: the URL namespace of name-based UUIDs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """Name-based UUID (version 5) in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "utf-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    parts = (F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return F.concat_ws("-", *parts)


def flags(named: dict[str, Column]) -> Column:
    """The names of the true conditions, sorted, joined by commas."""
    return F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in named.items()]))), ",")


def split_flags(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: x != "")


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def reason(features: dict[str, Column]) -> Column:
    parts = [F.format_string(f"{k}=%.2f", v) for k, v in features.items()]
    return F.coalesce(F.nullif(F.concat_ws(", ", *parts), F.lit("")), F.lit("boundary band"))


def address(*parts: Column) -> Column:
    return nonempty(F.concat_ws(", ", *[nonempty(p) for p in parts]))


def _lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit of an integer for each
    character of ``a`` (Hyyrö's recurrence)."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 1.0
    left, right = (" ".join(filter(None, (both, " ".join(sorted(s - (x & y)))))) for s in (x, y))
    ratio = 2.0 * _lcs_length(left, right) / (len(left) + len(right))
    # The shared words are the start of either side, so these ratios need no table.
    return max(ratio, *(2.0 * len(both) / (len(both) + len(s)) if both else 0.0 for s in (left, right)))


@F.arrow_udf(returnType=DoubleType())
def _token_sets(a: pa.Array, b: pa.Array) -> pa.Array:
    known: dict[tuple, float | None] = {}  # a batch's; names repeat
    out = []
    for pair in zip(a.to_pylist(), b.to_pylist()):
        if pair not in known:
            known[pair] = None if None in pair else _token_set(*pair)
        out.append(known[pair])
    return pa.array(out, pa.float64())


def token_set_ratio(a: Column, b: Column) -> Column:
    """0..1: the best Indel ratio among the shared words and the shared words
    with either side's other words; 1 if one side has no other words.  Null if
    either side is.  Arrow batches: arrays of words and subsequence tables as
    Column expressions copy more than they compute."""
    return _token_sets(a, b)
