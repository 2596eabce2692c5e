"""Data-quality checks as one-row-per-check tables, and the gate they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessel.operators.conform import real_key

CHECKED = ("first_name", "last_name", "phone_e164", "email_normalized")


class QualityFailure(Exception):
    """A blocking check failed."""


def _check(df: DataFrame, name: str, severity: str, detail: Column, passed: Column) -> DataFrame:
    return df.select(F.lit(name).alias("name"), F.lit(severity).alias("severity"), passed.alias("passed"), detail.alias("detail"))


def schema_drift(header: DataFrame, expected: tuple[str, ...], source: str) -> DataFrame:
    """BLOCK: columns of the contract that the file's header lacks; surplus ones are told."""
    one = header.agg(F.collect_set("column").alias("have"))
    want = F.array(*[F.lit(c) for c in expected])
    missing, extra = F.array_sort(F.array_except(want, "have")), F.array_sort(F.array_except("have", want))
    return _check(one, f"schema_drift:{source}", "BLOCK", F.concat(F.lit("missing="), F.array_join(missing, ","), F.lit(" extra="), F.array_join(extra, ",")), F.size(missing) == 0)


def null_rates(customers: DataFrame, columns: tuple[str, ...] = CHECKED) -> DataFrame:
    return customers.groupBy("_source").agg(F.count("*").alias("total"), *[(F.count_if(F.col(c).isNull()) / F.count("*")).alias(c) for c in columns])


def null_explosion(customers: DataFrame, threshold: float = 0.95, columns: tuple[str, ...] = CHECKED) -> DataFrame:
    rates = null_rates(customers, columns)
    bad = rates.select("_source", F.array_compact(F.array(*[F.when(F.col(c) >= threshold, F.lit(c)) for c in columns])).alias("bad"))
    told = bad.agg(F.array_sort(F.collect_list(F.when(F.size("bad") > 0, F.concat("_source", F.lit(":"), F.array_join("bad", "+"))))).alias("told"))
    return _check(told, "null_explosion", "ALERT", F.array_join("told", ","), F.size("told") == 0)


def volume(counts: DataFrame, baseline: DataFrame | None, tolerance: float = 0.30) -> DataFrame:
    """``counts`` and ``baseline``: (source, n).  Without a baseline all is well."""
    if baseline is None:
        return _check(counts.agg(F.lit("no baseline").alias("d")), "volume", "ALERT", F.col("d"), F.lit(True))
    both = counts.join(baseline.withColumnRenamed("n", "was"), "source").withColumn("delta", (F.col("n") - F.col("was")) / F.col("was"))
    told = both.agg(F.array_sort(F.collect_list(F.when(F.abs("delta") > tolerance, F.format_string("%s:%.2f", "source", "delta")))).alias("told"))
    return _check(told, "volume", "ALERT", F.array_join("told", ","), F.size("told") == 0)


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Distinct real keys of ``child`` that ``parent`` lacks."""
    keys = child.where(real_key(F.col(key))).select(F.trim(key).alias("key")).distinct()
    return keys.join(parent.select(F.trim(parent_key).alias("key")).distinct(), "key", "left_anti")


def referential_integrity(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    n = orphans(child, key, parent, parent_key).agg(F.count("*").alias("n"))
    return _check(n, "referential_integrity", "ALERT", F.concat(F.col("n").cast("string"), F.lit(" orphans")), F.col("n") == 0)


def duplicate_keys(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def unique(df: DataFrame, key: tuple[str, ...], table: str) -> DataFrame:
    """BLOCK: no two rows have the same key."""
    n = duplicate_keys(df, *key).agg(F.count("*").alias("n"))
    return _check(n, f"primary_key:{table}", "BLOCK", F.concat(F.col("n").cast("string"), F.lit(" keys on several rows")), F.col("n") == 0)


def not_null(df: DataFrame, key: tuple[str, ...], table: str) -> DataFrame:
    """BLOCK: no row lacks a part of its key."""
    lacks = F.lit(False)
    for c in key:
        lacks = lacks | F.col(c).isNull()
    n = df.agg(F.count_if(lacks).alias("n"))
    return _check(n, f"not_null:{table}", "BLOCK", F.concat(F.col("n").cast("string"), F.lit(" rows without a key")), F.col("n") == 0)


def run_all(
    customers: DataFrame, drift: DataFrame | None = None, counts: DataFrame | None = None, baseline: DataFrame | None = None,
    loyalty: DataFrame | None = None, pos: DataFrame | None = None
) -> DataFrame:
    """All checks of the conformed records, one row each."""
    if counts is None:
        counts = customers.groupBy(F.col("_source").alias("source")).agg(F.count("*").alias("n"))
    found = null_explosion(customers).unionByName(volume(counts, baseline))
    if drift is not None:
        found = found.unionByName(drift)
    if loyalty is not None and pos is not None:
        found = found.unionByName(referential_integrity(loyalty, "pos_customer_id", pos, "CUST_ID"))
    return found


def gate(checks: DataFrame) -> None:
    failed = checks.where("severity = 'BLOCK' and not passed").collect()
    if failed:
        raise QualityFailure("; ".join(f"{r['name']}: {r['detail']}" for r in failed))
