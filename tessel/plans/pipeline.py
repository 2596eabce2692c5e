"""The batch pipeline: read, conform, check, gate, resolve, publish."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessel.contracts import CONTRACTS, Settings
from tessel.operators import checks, conform, resolve, serve
from tessel.plans import warehouse
from tessel.sources.feeds import read_feed


def _write(df: DataFrame, out: str, name: str, mode: str = "overwrite") -> DataFrame:
    df.write.mode(mode).parquet(warehouse.location(out, name))
    return df.sparkSession.read.parquet(warehouse.location(out, name))


def _told(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.orderBy("name").collect()]  # one row a check


def run(spark: SparkSession, paths: dict[str, str], out: str, settings: Settings | None = None, baseline: DataFrame | None = None, decisions: DataFrame | None = None) -> dict:
    """Overwrites the zones under ``out``, all but the audit trail; returns the
    run report and leaves it there.  Stewards' decisions of earlier runs act: they
    are read from the trail unless given.  A blocking check stops the run before
    anything curated is written; the keys of the curated tables themselves are
    checked once they stand."""
    settings = settings or Settings()
    report = {"started_at": datetime.now(timezone.utc).isoformat()}
    raw, drift = {}, None
    for name, path in paths.items():
        rows, header = read_feed(spark, CONTRACTS[name], path)
        raw[name] = _write(rows, out, f"raw.{name}")
        if CONTRACTS[name].kind != "json":
            one = checks.schema_drift(header, CONTRACTS[name].columns, name)
            drift = one if drift is None else drift.unionByName(one)
    kept, rejected = conform.conform_all(raw, settings)
    customers = _write(kept, out, "conformed.customer")
    rejects = _write(rejected.withColumn("rejected_at", F.current_timestamp()), out, "conformed._reject")
    counts = customers.groupBy(F.col("_source").alias("source")).agg(F.count("*").alias("n"))
    found = checks.run_all(customers, drift, counts, baseline, raw.get("loyalty"), raw.get("pos"))
    found = found.unionByName(warehouse.key_checks({"conformed.customer": customers}))
    result = _write(found.withColumn("checked_at", F.current_timestamp()), out, "curated.quality_status")
    report |= {
        "checks": _told(result.drop("checked_at")), "kept": {r[0]: r[1] for r in counts.collect()},
        "rejected": {r[0]: r[1] for r in rejects.groupBy("_source").count().collect()}
    }
    try:
        checks.gate(result)
        if decisions is None and (audit := warehouse.read(spark, out, "curated.match_audit")) is not None:
            decisions = serve.decisions(audit)
        records, reviews = resolve.resolve(customers, raw.get("loyalty"), settings, decisions)
        masters, xref = resolve.golden(records, settings)
        tables = {f"curated.customer_{k}": _write(df, out, f"curated.customer_{k}") for k, df in (("master", masters), ("xref", xref), ("review", reviews))}
        keys = _write(warehouse.key_checks(tables).withColumn("checked_at", F.current_timestamp()), out, "curated.quality_status", "append")
        report["checks"] = _told(keys.drop("checked_at"))
        checks.gate(keys)
        n = {k.rsplit("_", 1)[1]: df.count() for k, df in tables.items()}
        report |= {"status": "ok", **{f"{k}s": v for k, v in n.items()}, "auto_merges": n["xref"] - n["master"]}
    except checks.QualityFailure as failure:
        report |= {"status": "blocked", "reason": str(failure)}
    report["finished_at"] = datetime.now(timezone.utc).isoformat()
    write_report(spark, report, out)
    return report


def write_report(spark: SparkSession, report: dict, out: str) -> None:
    """The report as one line of JSON, on whatever store ``out`` is."""
    text = json.dumps(report, default=str, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/run_report")


def read_report(spark: SparkSession, out: str) -> dict | None:
    """The last run's report; None if there is none that can be read."""
    try:
        return json.loads(spark.read.text(f"{out}/run_report").first()[0])
    except Exception:  # a missing or broken report is no report
        return None


def quality_checks(spark: SparkSession, out: str) -> list[dict]:
    """The checks of the last run's report, else made now on the conformed rows."""
    read = lambda name: warehouse.read(spark, out, name)
    return serve.check_views(read_report(spark, out), lambda: checks.run_all(read("conformed.customer"), loyalty=read("raw.loyalty"), pos=read("raw.pos")))


def review_decision(spark: SparkSession, out: str, review_id: str, decision: str, note: str | None = None) -> dict:
    """Append a steward's decision to the audit trail: the review leaves the open
    queue at once, and the next run acts on it."""
    reviews = warehouse.read(spark, out, "curated.customer_review")
    if reviews is None:
        return {"status": 503, "detail": "no run yet"}
    if decision not in ("merge", "keep_separate"):
        return {"status": 400, "detail": "decision must be merge or keep_separate"}
    row = serve.decide(reviews, review_id, decision, note).first()
    if row is None:
        return {"status": 404, "detail": f"review {review_id} not found"}
    names = [f.split()[0] for f in warehouse.TABLES["curated.match_audit"].columns.split(", ")]
    one = spark.createDataFrame([tuple(row[n] for n in names)], warehouse.TABLES["curated.match_audit"].columns)
    one.write.mode("append").parquet(warehouse.location(out, "curated.match_audit"))
    return {"status": 200, "audit_id": row["audit_id"]}


def open_queue(spark: SparkSession, out: str, limit: int = 50) -> DataFrame:
    """The reviews no steward has decided, the likeliest first."""
    reviews = warehouse.read(spark, out, "curated.customer_review")
    audit = warehouse.read(spark, out, "curated.match_audit")
    reviews = reviews if audit is None else serve.open_reviews(reviews, audit)
    return serve.review_queue(reviews, warehouse.read(spark, out, "conformed.customer"), limit)


def tables(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The tables that runs have written, for the read side."""
    found = {name: warehouse.read(spark, out, name) for name in warehouse.TABLES}
    return {name: df for name, df in found.items() if df is not None}
