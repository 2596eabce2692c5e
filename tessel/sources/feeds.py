"""Readers of the raw feeds: delimited, mixed-encoding, lossy and JSON files.

All files go through Spark's own readers and are parsed in the JVM.  A file
whose records may span lines is one task's, which streams it; the feed with an
encoding per line is cut at line ends like any text.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessel.contracts import LINEAGE, Contract

#: What UTF-8 text looks like when it was read as Windows-1252.
MOJIBAKE = ("Ã¼", "Ã¶", "Ã¤", "ÃŸ", "Ã©", "Ã¨", "Ã¡", "Ã³", "Ã±", "Ã„", "Ã–", "Ãœ", "â€")
#: The bytes 80 to 9F as Latin-1 characters, and what Windows-1252 has there
#: (U+FFFD where it has nothing).
_C1 = "".join(map(chr, range(0x80, 0xA0)))
_CP1252 = bytes(range(0x80, 0xA0)).decode("cp1252", "replace")
#: A character that no feed holds: lines are read whole as one field.
_NEVER = "\x1f"


def _bytes(latin: Column) -> Column:
    return F.encode(latin, "ISO-8859-1")


def repaired(lines: DataFrame, mode: str = "repair") -> DataFrame:
    """``lines``, whose column ``line`` holds a line's bytes as Latin-1
    characters, with ``text`` and ``_encoding_fixed`` (whether the encoding had
    to be mended) in its place.  A line that is no UTF-8 is Windows-1252; doubly
    encoded text is decoded once more; ``compat`` reads it as Windows-1252
    instead, which spoils it further."""
    marked = F.lit(False)
    for mark in MOJIBAKE:
        marked = marked | F.contains("utf8", F.lit(mark))
    known = [(a, b) for a, b in zip(_C1, _CP1252) if b != "�"]
    narrow = F.translate("utf8", "".join(b for _, b in known), "".join(a for a, _ in known))
    # Projections in steps: each value is computed once.
    df = lines.withColumn("utf8", _bytes(F.col("line")).cast("string")).withColumn("valid", F.is_valid_utf8("utf8")).withColumn("marked", marked)
    df = df.withColumn("narrow", F.when(F.col("marked") & ~F.col("utf8").rlike(r"[\u0080-\u009f]"), narrow))
    df = df.withColumn("twice", F.when(F.col("narrow").rlike(r"^[\u0000-ÿ]*$"), _bytes(F.col("narrow")).cast("string")))
    cp1252 = F.translate("line", _C1, _CP1252)
    mended = cp1252 if mode == "compat" else F.when(F.is_valid_utf8("twice"), F.col("twice")).otherwise(F.col("utf8"))
    text = F.when(~F.col("valid"), cp1252).when(F.col("marked"), mended).otherwise(F.col("utf8"))
    return df.withColumn("text", text).withColumn("_encoding_fixed", ~F.col("valid") | F.col("marked")).drop("line", "utf8", "valid", "marked", "narrow", "twice")


def _numbered(df: DataFrame, first: int) -> DataFrame:
    """``df`` of a file scan with ``_source_file`` and ``_source_row``: records
    counted from ``first``; several files of one path count on in the order of
    their names, so a number stands for one record of the feed.  Ids grow inside
    a scanned split, so a record's number is what earlier splits hold and its
    place in its own: one aggregation over splits, no sort of records."""
    rows = df.select("*", F.col("_metadata.file_path").alias("_source_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    splits = rows.groupBy("_source_file", "_block").agg(F.min("_id").alias("_low"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_source_file", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("_source_file", "_block", (before - F.col("_low") + first).alias("_shift"))
    return rows.join(splits, ["_source_file", "_block"]).withColumn("_source_row", F.col("_id") + F.col("_shift")).drop("_block", "_id", "_shift")


def _strings(names: list[str] | tuple[str, ...]) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def _delimited(spark: SparkSession, separator: str, path: str) -> tuple[DataFrame, list[str]]:
    reader = spark.read.options(header=True, sep=separator, quote='"', escape='"', multiLine=True, columnPruning=False)
    names = reader.option("inferSchema", False).csv(path).columns  # the header, whose order is the files' own
    df = reader.schema(_strings(names)).csv(path)
    return _numbered(df, 2).withColumn("_encoding_fixed", F.lit(False)), names


def _mixed(spark: SparkSession, separator: str, path: str, mode: str) -> tuple[DataFrame, list[str]]:
    lines = spark.read.schema(_strings(["line"])).options(header=False, sep=_NEVER, quote="", encoding="ISO-8859-1", columnPruning=False, mode="PERMISSIVE").csv(path)
    numbered = _numbered(lines, 1).select("_source_file", "_source_row", F.regexp_replace("line", "^ï»¿", "").alias("line"))
    rows = repaired(numbered, mode).where("trim(text) != ''")
    head = rows.groupBy("_source_file").agg(F.min_by("text", "_source_row").alias("text"), F.min("_source_row").alias("head"))
    first = head.orderBy("_source_file").select("text").first()
    names = [] if first is None else first[0].split(separator)
    # The files share one header: those of later files, and of files without records, are no lines of the feed.
    head = head.select("_source_file", "head", (F.row_number().over(Window.orderBy("_source_file")) - 1).alias("again"))
    rows = rows.join(head, "_source_file").where("_source_row > head").withColumn("_source_row", F.col("_source_row") - F.col("again")).drop("head", "again")
    parsed = F.from_csv("text", F.lit(_strings(names).toDDL()), {"sep": separator, "quote": '"', "escape": '"'})
    return rows.select(parsed.alias("fields"), "_source_file", "_source_row", "_encoding_fixed").select("fields.*", "_source_file", "_source_row", "_encoding_fixed"), names


def _array(spark: SparkSession, contract: Contract, path: str) -> tuple[DataFrame, list[str]]:
    inner = [c for c in contract.columns if c in ("line1", "city", "region", "postal_code", "country")]
    schema = _strings([c for c in contract.columns if c not in inner]).add("shipping_address", _strings(inner))
    df = _numbered(spark.read.schema(schema).option("multiLine", True).json(path), 1)
    return df.select("*", "shipping_address.*", F.lit(False).alias("_encoding_fixed")).drop("shipping_address"), list(contract.columns)


def read_feed(spark: SparkSession, contract: Contract, path: str, now: datetime | None = None, mode: str = "repair") -> tuple[DataFrame, DataFrame]:
    """(rows, header): contract columns and lineage of every record; short
    records get nulls, surplus fields are dropped; and the header's names, as
    the contract renames them.  Rows are numbered as records, the header being
    the first (mixed feeds: as lines, without the headers of later files; JSON:
    from 1).  An empty unquoted field is
    null.  Files of one path share one header."""
    if contract.kind == "json":
        read, names = _array(spark, contract, path)
    elif contract.kind == "mixed":
        read, names = _mixed(spark, contract.separator, path, mode)
    else:
        read, names = _delimited(spark, contract.separator, path)
    have = {contract.rename.get(n, n): n for n in names}
    values = [(F.col(f"`{have[c]}`") if c in have else F.lit(None).cast("string")).alias(c) for c in contract.columns]
    moment = F.lit(now or datetime.now(timezone.utc))
    payload = F.to_json(F.struct(*values), {"ignoreNullFields": "false"})
    lineage = dict(zip(LINEAGE, (F.lit(contract.name), F.col("_source_file"), F.col("_source_row"), moment, payload)))
    rows = read.select(*values, *[v.alias(k) for k, v in lineage.items()], "_encoding_fixed")
    return rows, spark.createDataFrame([(n,) for n in have], "column string")
