"""Benchmark decontamination by winnowing, in DataFrame functions only.

Both sides keep, of every run of ``WINDOW`` consecutive k-grams, the one with
the smallest hash (the rightmost of equals).  A shared span of ``SPAN`` = K +
WINDOW - 1 words holds one whole run, and equal runs choose the same k-gram,
so every shared span meets in the join on fingerprints.  Each hit is then
extended word by word on both sides, so only real shared spans remain.

Items of fewer than ``SPAN`` words count as one window: their whole word
sequence is their one fingerprint, looked for at every position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessel.storage import written

K, WINDOW = 5, 9
SPAN = K + WINDOW - 1
REACH = SPAN - K
#: Fingerprint rows of the benchmark (each under 1 KB) and item ids in them up to which they are broadcast.
BROADCAST_ROWS = 60_000
POS_BITS = 30
POS_MASK = (1 << POS_BITS) - 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words; a null or empty text has none."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, SEPARATORS), "")


def _winnowed(df: DataFrame) -> DataFrame:
    """Adds ``fps``: array of (pos, fp, glen) chosen from ``words``."""
    df = df.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    h = F.col("h")
    grams = F.transform(F.sequence(F.lit(0), F.size("h") - K), lambda i: F.xxhash64(*[h[i + j] for j in range(K)]))
    df = df.withColumn("g", F.when(F.size("h") >= SPAN, grams).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("p", F.transform("g", lambda x, i: x.bitwiseAND(F.lit(~POS_MASK)).bitwiseOR((F.lit(POS_MASK) - i).cast("long"))))
    p, g = F.col("p"), F.col("g")
    least = F.transform(F.sequence(F.lit(1), F.size("p") - WINDOW + 1), lambda s: F.array_min(F.slice(p, s, WINDOW)))
    df = df.withColumn("m", F.when(F.size("p") > 0, F.array_distinct(least)).otherwise(F.array().cast("array<bigint>")))
    at = lambda x: (F.lit(POS_MASK) - x.bitwiseAND(F.lit(POS_MASK))).cast("int")
    return df.withColumn("fps", F.transform("m", lambda x: F.struct(at(x).alias("pos"), g[at(x)].alias("fp"), F.lit(K).alias("glen"))))


def _whole(n: int) -> Column:
    """(pos, fp, glen) of every run of n words, for items of n words."""
    h = F.col("h")
    runs = F.transform(F.sequence(F.lit(0), F.size("h") - n), lambda i: F.struct(i.alias("pos"), F.xxhash64(F.lit(n), F.slice(h, i + 1, n)).alias("fp"), F.lit(n).alias("glen")))
    return F.when(F.size("h") >= n, runs).otherwise(F.array().cast("array<struct<pos:int,fp:bigint,glen:int>>"))


def _around(pos: Column, glen: Column) -> tuple[Column, Column, Column]:
    """Words before (nearest first), of, and after the k-gram at ``pos``."""
    first = F.greatest(pos - REACH, F.lit(0))
    w = F.col("words")
    return F.reverse(F.slice(w, first + 1, pos - first)), F.slice(w, pos + 1, glen), F.slice(w, pos + glen + 1, F.lit(REACH))


def benchmark_fingerprints(items: DataFrame) -> tuple[DataFrame, list[int]]:
    """Fingerprints with the words around them and the items that have both, and the lengths
    (at most SPAN - 1 of them) of the items shorter than a window."""
    items = items.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    short = [r[0] for r in items.where(F.size("words") < SPAN).select(F.size("words").alias("n")).distinct().orderBy("n").collect()]
    df = _winnowed(items)
    n = F.size("words")
    one = F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(n, F.col("h")).alias("fp"), n.alias("glen")))
    df = df.select("item_id", "words", F.explode(F.when(n < SPAN, one).otherwise(F.col("fps"))).alias("f"))
    left, gram, right = _around(F.col("f.pos"), F.col("f.glen"))
    need = F.least(F.size("words"), F.lit(SPAN))
    rows = df.select(
        "item_id", F.col("f.fp").alias("fp"), F.col("f.glen").alias("i_glen"), need.alias("need"), left.alias("i_left"), gram.alias("i_gram"),
        right.alias("i_right")
    )
    # A passage that many items share is one row, whatever their number: it makes one hit, not one an item.
    ids = F.collect_set(F.col("item_id").cast("string")).alias("item_ids")
    return written(rows.groupBy("fp", "i_glen", "need", "i_left", "i_gram", "i_right").agg(ids), "benchmark"), short


def _same(a: Column, b: Column) -> Column:
    """Number of leading words that two arrays share."""
    bad = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(bad == 0, F.size(a).cast("long")).otherwise(bad - 1)


def contaminated_words(docs: DataFrame, items: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, text_key, n_words, n_hit and
    ``items`` (sorted ids, as strings, of the items with occurring windows).

    Null text: no words, no hits.  Equal rows are computed once and returned
    as often as they occur.  A null item_id marks words but is not listed.  An
    empty ``docs`` or ``items`` table gives no rows or no hits.  Other columns
    are ignored.
    """
    built, short = benchmark_fingerprints(items)
    df = _winnowed(docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").isNull().alias("no_text"), words(F.col("text")).alias("words")))
    alone = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("bigint").alias("fp"), F.lit(0).alias("glen")))
    fps = F.concat(alone, F.col("fps"), *[_whole(n) for n in short])
    key = ["doc_id", "text_key", "no_text"]
    size = built.agg(F.count("*") + F.coalesce(F.sum(F.size("item_ids")), F.lit(0))).first()[0]
    if size <= broadcast_rows:
        hits = df.select(*key, "words", F.explode(fps).alias("f")).select(*key, "words", "f.*").join(F.broadcast(built), "fp", "left")
    else:
        # A benchmark too large to broadcast: narrow rows meet on the fingerprint, then their documents' words.
        found = df.select(*key, F.explode(fps).alias("f")).select(*key, "f.pos", "f.fp").distinct().join(built, "fp")
        d, f = df.select(*key, "words").alias("d"), found.alias("f")
        same = (F.col("d.text_key") == F.col("f.text_key")) & F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.no_text") == F.col("f.no_text"))
        cols = [F.col(f"d.{c}") for c in [*key, "words"]]
        hits = d.join(f, same).select(*cols, "f.pos", *[f"f.{c}" for c in built.columns])
        hits = hits.unionByName(df.select(*key, "words", F.lit(-1).alias("pos")), allowMissingColumns=True)
    hits = hits.where((F.col("pos") == -1) | F.col("need").isNotNull())
    left, gram, right = _around(F.col("pos"), F.col("i_glen"))
    real = (F.col("pos") >= 0) & (gram == F.col("i_gram"))
    hits = hits.select(
        *key, F.size("words").alias("n"), "pos", "item_ids", "need", "i_glen", F.when(real, _same(left, F.col("i_left"))).alias("l"),
        F.when(real, _same(right, F.col("i_right"))).alias("r")
    )
    span = (F.col("pos") >= 0) & (F.col("l") + F.col("i_glen") + F.col("r") >= F.col("need"))
    whole = F.col("need") < SPAN
    at = F.when(
        span,
        F.struct(
            F.when(whole, F.col("pos")).otherwise(F.col("pos") - F.col("l")).cast("long").alias("s"),
            F.when(whole, F.col("pos") + F.col("i_glen")).otherwise(F.col("pos") + F.col("i_glen") + F.col("r")).cast("long").alias("e")
        )
    )
    by = hits.groupBy(*key).agg(
        F.max("n").cast("long").alias("n_words"), F.count_if(F.col("pos") == -1).alias("copies"), F.collect_set(at).alias("spans"),
        F.collect_set(F.when(span, F.col("item_ids"))).alias("ids")
    )
    zero = F.struct(F.lit(0).cast("long").alias("e"), F.lit(0).cast("long").alias("n"))
    grow = lambda acc, x: F.struct(
        F.greatest(acc["e"], x["e"]).alias("e"), (acc["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(x["s"], acc["e"]))).alias("n")
    )
    covered = F.aggregate(F.array_sort("spans"), zero, grow, lambda acc: acc["n"])
    out = by.select(*key, "n_words", covered.alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("ids"))).alias("items"), "copies")
    return out.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("col", "copies")


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns kept,
    whatever their names."""
    bad = contaminated_words(docs, items).where(contaminated(F.col("n_hit"), F.col("n_words"))).select("doc_id", "text_key").distinct()
    same = F.col("d.doc_id").eqNullSafe(F.col("bad.doc_id")) & (F.xxhash64(F.col("d.text")) == F.col("bad.text_key"))
    return docs.alias("d").join(bad.alias("bad"), same, "left_anti")
