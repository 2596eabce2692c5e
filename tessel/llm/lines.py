"""Line dedup by distinct-site spread.

A line's key is a 128-bit hash of its trimmed text with blanks collapsed.  Of
the keys that stand on several sites (sources) at all, one aggregation merges
HyperLogLog sketches of the sites that show them.  Lines whose estimate is near their threshold get an exact distinct
count.  Lines on at least MIN_SITES sites are boilerplate; a line of more than
LONG_WORDS words, a passage that sites do not repeat by chance, is from
LONG_SITES on, except in documents that consist of such lines by more than
half: these are copies of documents, not documents with a passage, and are left
to near-duplicate detection.  Of a boilerplate line only the first occurrence
(smallest doc_id, then line) stays, so nothing that was said is lost; blank
lines are never touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessel.operators.components import most_rows
from tessel.storage import written

MIN_SITES = 10
#: Words beyond which a line is a passage, and its own threshold.
LONG_WORDS, LONG_SITES = 50, 3
#: log2 of a sketch's registers: a standard error of about 6.5 %.
LG_K = 8
#: Relative distance from the threshold, four standard errors, that is counted exactly.
NEAR = 0.26
#: Boilerplate lines (about 50 bytes each) up to which they are broadcast.
BROADCAST_LINES = 200_000
#: Parts of a key's rows where the table is too large to broadcast.
SALTS = 32


def normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"\s+", " "))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, site, line_no, h, g, words (0 but for long lines);
    blank lines left out.  A null source is a site of its own; equal rows are
    one."""
    rows = docs.select(
        "doc_id", F.xxhash64("text").alias("text_key"), F.xxhash64("source", F.col("source").isNull()).alias("site"),
        F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )
    line = normal(F.col("line"))
    rows = rows.withColumn("line", line).where("line != ''")
    words = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    long = (F.length("line") > 2 * LONG_WORDS) & (words > LONG_WORDS)
    return rows.select(
        "doc_id", "text_key", "site", "line_no", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"),
        F.when(long, words).otherwise(0).alias("words")
    )


def _of(lines: DataFrame, keys: DataFrame, broadcast_lines: int) -> DataFrame:
    """The ``lines`` whose key is in ``keys`` (h, g, count: their lines).  Few
    keys are broadcast; of many, those on so many lines that there cannot be more
    than HOT of them."""
    size, total = keys.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    if size <= broadcast_lines:
        return lines.join(F.broadcast(keys.select("h", "g")), ["h", "g"], "left_semi")
    hot = F.col("count") > most_rows(total)
    cold = lines.join(keys.where(~hot).select("h", "g"), ["h", "g"], "left_semi")
    return cold.unionByName(lines.join(F.broadcast(keys.where(hot).select("h", "g")), ["h", "g"], "left_semi"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, long_sites: int = LONG_SITES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """h, g, first, wide: the keys of lines on at least ``min_sites`` sites
    (wide) or, if long, on ``long_sites``, and (doc_id, text_key, line_no) of
    their first occurrence."""
    limits = [F.lit(min_sites), F.when(F.col("words") > 0, F.lit(long_sites))]
    any_of = lambda test: F.coalesce(test(limits[0]), F.lit(False)) | F.coalesce(test(limits[1]), F.lit(False))
    # Most lines stand once or on one site; sketches are made for the others only.
    often = lines.groupBy("h", "g").agg(F.count("*").alias("count"), F.min("site").alias("low"), F.max("site").alias("high"), F.max("words").alias("words"))
    often = often.where(any_of(lambda n: F.col("count") >= n) & (F.lit(min(min_sites, long_sites) < 2) | (F.col("low") != F.col("high"))))
    often = written(often.select("h", "g", "count"), "often")
    first = F.min(F.struct("doc_id", "text_key", "line_no"))
    spread = _of(lines, often, broadcast_lines).groupBy("h", "g").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"), first.alias("first"), F.max("words").alias("words"),
        F.count("*").alias("count")
    )
    spread = written(spread.where(any_of(lambda n: F.col("sites") >= n * (1 - NEAR))), "spread")
    # Near is what may fall on either side of one of its thresholds.
    doubtful = any_of(lambda n: F.col("sites").between(n * (1 - NEAR), n * (1 + NEAR)))
    near = spread.where(doubtful)
    known = spread.where(~doubtful).select("h", "g", "first", "words", "sites")
    if not near.isEmpty():
        # The exact counts: distinct (line, site) pairs combine before they are dealt, so no line is one task's.
        pairs = _of(lines.select("h", "g", "site"), near, broadcast_lines).distinct()
        exact = pairs.groupBy("h", "g").agg(F.count("*").alias("sites"))
        known = known.unionByName(near.select("h", "g", "first", "words").join(exact, ["h", "g"]))
    wide = F.col("sites") >= min_sites
    return known.where(wide | ((F.col("words") > 0) & (F.col("sites") >= long_sites))).select("h", "g", "first", wide.alias("wide"))


def removed_lines(docs: DataFrame, min_sites: int = MIN_SITES, broadcast_lines: int = BROADCAST_LINES, long_sites: int = LONG_SITES) -> DataFrame:
    """doc_id, text_key, gone, passages: the sorted numbers of the lines to
    remove, and the others, with their words, that are repeated passages."""
    lines = written(_lines(docs), "lines")  # keys and places, no text; read three times
    found = written(boilerplate(lines, min_sites, long_sites, broadcast_lines), "boilerplate")
    lines = lines.drop("site")
    if found.count() <= broadcast_lines:
        marked = lines.join(F.broadcast(found), ["h", "g"])
    else:
        salted = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id", "line_no"), F.lit(SALTS)))
        marked = salted.join(found.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["h", "g", "salt"])
    marked = marked.where(~F.struct("doc_id", "text_key", "line_no").eqNullSafe(F.col("first")))
    passage = F.when(~F.col("wide"), F.struct("line_no", "words"))
    return marked.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.when(F.col("wide"), F.col("line_no")))).alias("gone"), F.collect_set(passage).alias("passages"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, long_sites: int = LONG_SITES) -> DataFrame:
    """row (a struct of all columns of ``docs``), text (its text without the
    removed lines), n_lines and n_removed (numbers of lines).

    Null texts stay null and have no lines; an empty text has one.  Documents
    equal in doc_id, text and source count as one and are treated alike, so of
    repeated rows every one keeps a first occurrence.  Null doc_ids come
    first.  An empty table gives no rows.
    """
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    gone = removed_lines(docs.select("doc_id", "text", "source"), min_sites, long_sites=long_sites).toDF("gone_id", "gone_key", "gone", "passages")
    both = d.join(gone, F.col("row.doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("row.text") == F.col("gone_key")), "left")
    text = F.col("row.text")
    words = F.size(F.array_remove(F.split(text, r"\s+"), ""))
    long = F.aggregate("passages", F.lit(0), lambda acc, p: acc + p["words"])
    leave = F.concat("gone", F.when(2 * long <= words, F.transform("passages", lambda p: p["line_no"])).otherwise(F.array().cast("array<int>")))
    both = both.withColumn("leave", F.when(F.size("passages") > 0, leave).otherwise(F.col("gone")))
    parts = F.split(text, "\n")
    kept = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains(F.col("leave"), i)), "\n")
    removed = F.when(F.col("leave").isNull(), 0).otherwise(F.size("leave")).cast("long")
    return both.select(
        "row", F.when(removed > 0, kept).otherwise(text).alias("text"),
        F.when(text.isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"), removed.alias("n_removed")
    )


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, long_sites: int = LONG_SITES) -> DataFrame:
    """The documents with their boilerplate lines removed, columns as they
    were, whatever their names; n_chars, where there is one, is counted anew.
    A document of which nothing but blanks is left, because all its lines stay
    elsewhere, goes."""
    out = dedup_lines(docs, min_sites, long_sites).where("n_removed = 0 or trim(text) != ''")
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
