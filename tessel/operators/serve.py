"""Read side: search, detail, lineage, review queue and the tool calls, as
DataFrames; ``call`` wraps them in the tools' envelopes."""

from __future__ import annotations

import functools
import inspect
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tessel.contracts import CONTRACTS, LINEAGE
from tessel.functions import text as t

#: Words that no filter of a user may hold.
DENIED = re.compile(
    r";|--|/\*|\b(insert|update|delete|drop|alter|create|attach|detach|copy|pragma|truncate|grant|revoke|merge|call|export|import|install|load|set|select|reflect|try_reflect|java_method|with)\b",
    re.I
)
MAX_WHERE = 500


def like_any(q: str, *columns: str) -> Column:
    """Case-insensitive substring in any column; % and _ are wildcards."""
    found = F.lit(False)
    for c in columns:
        found = found | F.lower(F.coalesce(F.col(c), F.lit(""))).like(f"%{q.lower()}%")
    return found


def search_customers(masters: DataFrame, q: str | None = None, limit: int = 50, offset: int = 0, columns: tuple[str, ...] = ("full_name", "city")) -> DataFrame:
    """A page of the masters, the surest first; the browser view searches the region too."""
    rows = masters.where(like_any(q, *columns)) if q else masters
    rows = rows.orderBy(F.desc_nulls_last("record_confidence"), F.asc_nulls_last("full_name"), "customer_id").offset(offset).limit(min(max(limit, 1), 500))
    return rows.select("customer_id", "full_name", "city", "region", "n_sources", "record_confidence")


def provenance(masters: DataFrame, customer_id: str | None = None) -> DataFrame:
    rows = masters.where(F.col("customer_id") == customer_id) if customer_id else masters
    value = lambda f, v, s, c: F.struct(
        F.lit(f).alias("field"), F.col(v).cast("string").alias("value"), F.col(s).alias("source"), (F.col(c) if c else F.lit(0.0)).alias("confidence")
    )
    year = F.struct(
        F.lit("birth_year").alias("field"), F.year("birth_date").cast("string").alias("value"), F.col("birth_date_source").alias("source"),
        F.col("birth_date_confidence").alias("confidence")
    )
    fields = F.array(
        value("full_name", "full_name", "full_name_source", "full_name_confidence"), value("email", "email_hash", "email_source", "email_confidence"),
        value("phone", "phone_hash", "phone_source", "phone_confidence"), value("city", "city", "city_source", None),
        value("region", "region", "region_source", None), year
    )
    return rows.select("customer_id", F.explode(fields).alias("f")).select("customer_id", "f.*")


def contributions(xref: DataFrame, customers: DataFrame, raw: DataFrame, customer_id: str | None = None) -> DataFrame:
    """The conformed and raw record behind every crosswalk row; ``raw`` holds
    (_source, _source_row, _source_file, _ingested_at, _raw_payload) of all feeds."""
    rows = xref.where(F.col("customer_id") == customer_id) if customer_id else xref
    rows = rows.join(customers.select("_source", "_source_id", "_source_row", "field_quality_flags"), ["_source", "_source_id"], "left")
    rows = rows.join(raw.select("_source", "_source_row", "_source_file", "_ingested_at", "_raw_payload"), ["_source", "_source_row"], "left")
    return rows.withColumn(
        "fields", F.from_json("_raw_payload", "map<string,string>")
    ).withColumn("flags", t.split_flags(F.col("field_quality_flags"))).orderBy("_source", "_source_id")


def _lineage_ids() -> tuple[Column, Column, Column, Column]:
    own = F.concat_ws(":", "_source", "_source_id")
    return F.concat(F.lit("master:"), "customer_id"), F.concat(F.lit("xref:"), own), F.concat(F.lit("conformed:"), own), F.concat(F.lit("raw:"), own)


def lineage_nodes(masters: DataFrame, xref: DataFrame, customer_id: str | None = None) -> DataFrame:
    """customer_id, id, kind, label of a master and three nodes a crosswalk row."""
    only = (lambda df: df.where(F.col("customer_id") == customer_id)) if customer_id else (lambda df: df)
    master, link, conformed, raw = _lineage_ids()
    top = only(masters).select(
        "customer_id", master.alias("id"), F.lit("master").alias("kind"),
        F.concat(F.lit("customer_master / "), F.coalesce(t.nonempty(F.col("full_name")), "customer_id")).alias("label")
    )
    node = lambda key, kind, label: F.struct(key.alias("id"), F.lit(kind).alias("kind"), label.alias("label"))
    of = F.format_string("conformed.customer (%s %s)", "_source", "_source_id")
    nodes = F.array(
        node(link, "xref", F.concat(F.lit("xref · "), "_source")), node(conformed, "conformed", of),
        node(raw, "raw", F.format_string("raw.%s (%s)", "_source", "_source_id"))
    )
    return top.unionByName(only(xref).select("customer_id", F.explode(nodes).alias("n")).select("customer_id", "n.*"))


def lineage_edges(xref: DataFrame, customer_id: str | None = None) -> DataFrame:
    """customer_id, from_node, to_node: master to crosswalk, conformed and raw row."""
    rows = xref.where(F.col("customer_id") == customer_id) if customer_id else xref
    path = _lineage_ids()
    edges = F.array(*[F.struct(x.alias("from_node"), y.alias("to_node")) for x, y in zip(path, path[1:])])
    return rows.select("customer_id", F.explode(edges).alias("e")).select("customer_id", "e.*")


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.groupBy("from_node").agg(F.array_sort(F.collect_set("to_node")).alias("to_nodes"))


def lineage_tree(masters: DataFrame, xref: DataFrame, customers: DataFrame, raw: DataFrame, customer_id: str | None = None) -> DataFrame:
    """Per master: its row and, nested, the conformed and raw rows below it."""
    rows = contributions(xref, customers, raw, customer_id)
    conformed = F.struct(
        "_source", "_source_id", "match_method", "match_score", "_source_row", "field_quality_flags",
        F.struct("_source_file", "_ingested_at", "_raw_payload").alias("raw")
    )
    below = rows.groupBy("customer_id").agg(F.array_sort(F.collect_list(conformed)).alias("children"))
    top = masters.where(F.col("customer_id") == customer_id) if customer_id else masters
    return top.select(
        "customer_id", "record_confidence", "n_sources", F.struct(*[c for c in masters.columns if c != "customer_id"]).alias("row")
    ).join(below, "customer_id", "left")


def detail(masters: DataFrame, xref: DataFrame, customers: DataFrame, raw: DataFrame, customer_id: str) -> dict:
    """One master with the origin of its fields and every contribution; status
    404 where there is none."""
    one = masters.where(F.col("customer_id") == customer_id).select(
        "customer_id", "full_name", "city", "region", F.year("birth_date").alias("birth_year"), "n_sources", "record_confidence"
    ).first()
    if one is None:
        return {"status": 404, "detail": f"customer {customer_id} not found"}
    fields = provenance(masters, customer_id).where("value is not null or source is not null").drop("customer_id")
    parts = contributions(xref, customers, raw, customer_id).select(
        F.col("_source").alias("source"), F.col("_source_id").alias("source_id"), F.coalesce("_source_row", F.lit(0)).alias("source_row"),
        t.iso(F.col("_ingested_at")).alias("ingested_at"), "fields", F.col("flags").alias("field_quality_flags")
    )
    return {"status": 200, **one.asDict(), "fields": [r.asDict() for r in fields.collect()], "contributions": [r.asDict(recursive=True) for r in parts.collect()]}


#: Where the views' bands of confidence begin: high, middle.
BANDS = {"confidence": (0.9, 0.7), "source": (0.85, 0.7), "pair": (0.85, 0.75)}


def shown_band(score: Column, view: str) -> Column:
    high, middle = BANDS[view]
    return F.when(score >= high, "high").when(score >= middle, "middle").otherwise("low")


def source_label(c: Column) -> Column:
    return F.replace(c, F.lit("acq_"), F.lit(""))


def health(tables: dict | None) -> dict:
    return {"status": "ok", "warehouse": bool(tables)}


def check_views(report: dict | None, live: Callable[[], DataFrame]) -> list[dict]:
    """Checks as the view shows them: the run report's, else checked now."""
    view = lambda c, at: {
        "name": c["name"], "level": c["severity"].upper(), "status": "pass" if c["passed"] else "fail", "message": c.get("detail") or "", "ran_at": at
    }
    try:
        return [view(c, report.get("finished_at") or report.get("started_at") or "") for c in report["checks"]]
    except (KeyError, TypeError, AttributeError):
        return [view(c.asDict(), "now") for c in live().orderBy("name").collect()]


def review_queue(reviews: DataFrame, customers: DataFrame, limit: int = 50) -> DataFrame:
    side = lambda k: customers.select(
        F.concat_ws("::", "_source", "_source_id").alias(f"{k}_key"),
        F.struct(
            "_source", "_source_id", F.col("full_name_normalized").alias("name"), F.col("email_normalized").alias("email"),
            F.col("phone_e164").alias("phone"), t.address(F.col("street"), F.col("city"), F.col("region"), F.col("postal_code")).alias("address"),
            F.col("birth_date").cast("string").alias("dob")
        ).alias(k)
    )
    top = reviews.orderBy(F.desc("score"), "review_id").limit(limit)
    names = reviews.schema["features"].dataType.names
    return top.join(side("left"), "left_key", "left").join(side("right"), "right_key", "left").select(
        "review_id", "score", "left", "right", t.reason({n: F.col(f"features.{n}") for n in names}).alias("reason")
    )


def open_reviews(reviews: DataFrame, audit: DataFrame) -> DataFrame:
    """Reviews whose pair has no decision; deciding appends to the audit table only."""
    done = audit.where("event_type = 'review_decision'").select(F.col("customer_id").alias("left_key"), F.col("other_id").alias("right_key")).distinct()
    return reviews.join(done, ["left_key", "right_key"], "left_anti")


def decide(reviews: DataFrame, review_id: str, decision: str, note: str | None = None) -> DataFrame:
    """The audit row of a steward's decision on one review, to be appended."""
    if decision not in ("merge", "keep_separate"):
        raise ValueError("decision must be merge or keep_separate")
    one = reviews.where(F.col("review_id") == review_id)
    return one.select(
        F.uuid().alias("audit_id"), F.lit("review_decision").alias("event_type"), F.col("left_key").alias("customer_id"),
        F.col("right_key").alias("other_id"), F.lit(decision).alias("decision"), "score", F.lit(note).cast("string").alias("note"),
        F.current_timestamp().alias("created_at")
    )


def decisions(audit: DataFrame) -> DataFrame:
    """left_key, right_key, decision: the last one of every pair."""
    last = audit.where("event_type = 'review_decision'").groupBy(F.col("customer_id").alias("left_key"), F.col("other_id").alias("right_key"))
    return last.agg(F.max_by("decision", F.struct("created_at", "audit_id")).alias("decision"))


def source_info(customers: DataFrame, rejects: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """Per source: rows, rejects and a quality score from reject and null rates;
    with ``raw``, when it was last read."""
    c = customers.groupBy("_source").agg(F.count("*").alias("kept"), (F.count_if(F.col("email_normalized").isNull()) + F.count_if(F.col("phone_e164").isNull())).alias("nulls"))
    r = rejects.groupBy("_source").agg(F.count("*").alias("rejected"))
    both = c.join(r, "_source", "full").na.fill(0)
    rate = F.coalesce(
        F.try_divide(F.col("rejected").cast("double"), F.col("kept") + F.col("rejected")), F.lit(0.0)
    ) + F.coalesce(F.try_divide(F.col("nulls").cast("double"), 2 * F.col("kept")), F.lit(0.0))
    out = both.select(
        "_source", (F.col("kept") + F.col("rejected")).alias("row_count"), F.col("rejected").alias("anomaly_count"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - rate / 2.0)).alias("quality_score")
    )
    return out if raw is None else out.join(raw.groupBy("_source").agg(t.iso(F.max("_ingested_at")).alias("last_ingested_at")), "_source", "left")


def status_checks(n_masters: Column, n_rejects: Column, n_reviews: Column) -> Column:
    """The three checks that stand in where no run left its own."""
    check = lambda name, severity, status, n, where: F.struct(
        F.lit(name).alias("check_name"), F.lit(severity).alias("severity"), status.alias("status"),
        F.concat(n.cast("string"), F.lit(f" rows in {where}")).alias("detail")
    )
    return F.array(
        check("curated_master_populated", "BLOCK", F.when(n_masters > 0, "PASS").otherwise("FAIL"), n_masters, "curated.customer_master"),
        check("conform_reject_rate", "ALERT", F.when(n_rejects == 0, "PASS").otherwise("WARN"), n_rejects, "conformed._reject"),
        check("review_queue_depth", "INFO", F.lit("PASS"), n_reviews, "curated.customer_review"),
    )


def overall(checks: Column) -> Column:
    """BLOCKED where a blocking check did not pass, else ALERT where any did not."""
    bad = F.filter(checks, lambda c: c["status"] != "PASS")
    return F.when(F.exists(bad, lambda c: c["severity"] == "BLOCK"), "BLOCKED").when(F.size(bad) > 0, "ALERT").otherwise("GREEN")


#: The tables that the tools may show.
ALLOWED = (
    *(f"raw.{name}" for name in CONTRACTS), "conformed.customer", "conformed._reject", "curated.customer_master", "curated.customer_xref",
    "curated.match_audit", "curated.customer_review"
)
FOUND = ("_source", "_source_id", "_source_row", "first_name", "last_name", "full_name_normalized", "email_normalized", "phone_e164", "city", "region", "country", "birth_date")


def find_records(customers: DataFrame, query: str, source: str | None = None, limit: int = 20) -> DataFrame:
    rows = customers.where(like_any(query, "full_name_normalized", "first_name", "last_name", "email_normalized", "phone_e164"))
    rows = rows.where(F.col("_source") == source) if source else rows
    return rows.select(*FOUND).orderBy("_source", "_source_id", "_source_row").limit(limit)


def audit_trail(audit: DataFrame, xref: DataFrame, customer_id: str) -> DataFrame:
    """Decisions that named the customer or one of its records, oldest first."""
    keys = xref.where(F.col("customer_id") == customer_id).select(F.concat_ws("::", "_source", "_source_id").alias("key"))
    keys = keys.unionByName(keys.sparkSession.createDataFrame([(customer_id,)], "key string"))
    touched = audit.join(keys, (F.col("customer_id") == F.col("key")) | (F.col("other_id") == F.col("key")), "left_semi")  # one customer's few keys
    return touched.select("audit_id", "event_type", "decision", "score", "note", "created_at").orderBy("created_at", "audit_id")


def _ok(data: object) -> dict:
    return {"isError": False, "data": data}


def _error(code: str, message: str, **more: object) -> dict:
    return {"isError": True, "reason_code": code, "message": message, **more}


class Tools:
    """The six tool calls over the tables of ALLOWED, and curated.quality_status
    where a run left it; every error is an envelope."""

    def __init__(self, tables: dict[str, DataFrame] | None, path: str | None = None) -> None:
        self.tables, self.path = tables, path
        self.known: dict[str, Callable[..., dict]] = {
            "list_sources": self._sources, "preview_table": self._preview, "find_record": self._find, "trace_lineage": self._trace,
            "get_source_schema": self._schema, "quality_status": self._status
        }

    def call(self, name: str, arguments: dict | None = None) -> dict:
        arguments = arguments or {}
        if name not in self.known:
            return _error("UNKNOWN_TOOL", f"no tool {name}", known=sorted(self.known))
        try:
            inspect.signature(self.known[name]).bind(**arguments)
            self._validate(**arguments)
        except (TypeError, ValueError) as error:
            return _error("BAD_ARGUMENTS", f"bad arguments for {name}", errors=[str(error)])
        if name != "get_source_schema" and not self.tables:
            return _error("WAREHOUSE_MISSING", "run the pipeline first", expected_path=self.path)
        try:
            return self.known[name](**arguments)
        except Exception as error:  # the envelope is the contract
            return _error("INTERNAL_ERROR", str(error)[:300])

    @staticmethod
    def _validate(table: str = "", query: str = "  ", source: str | None = None, limit: int = 1, where: str | None = None, customer_id: str = "x") -> None:
        for value in (table, query, source or "", where or "", customer_id):
            if not isinstance(value, str):
                raise ValueError(f"{value!r} is no text")
        if len(query) < 2:
            raise ValueError("query needs two characters")
        if not isinstance(limit, int) or not 1 <= limit <= (100 if query != "  " else 200):
            raise ValueError("limit must be 1 to 200, of find_record 1 to 100")

    def _rows(self, df: DataFrame) -> list[dict]:
        return [r.asDict(recursive=True) for r in df.collect()]  # callers limit the rows

    def _raw(self) -> DataFrame:
        parts = [self.tables[f"raw.{n}"].select(*LINEAGE) for n in CONTRACTS if f"raw.{n}" in self.tables]
        return functools.reduce(DataFrame.unionByName, parts)

    def _sources(self) -> dict:
        counts = {r["_source"]: r for r in self._raw().groupBy("_source").agg(F.count("*").alias("n"), F.min("_source_file").alias("file")).collect()}  # one row a feed
        there = [(n, counts.get(n)) for n in CONTRACTS if f"raw.{n}" in self.tables]
        gone = [{"source": n, "row_count": None, "error": f"no table raw.{n}"} for n in CONTRACTS if f"raw.{n}" not in self.tables]
        return _ok([{"source": n, "row_count": r["n"] if r else 0, "source_file": r["file"] if r else None} for n, r in there] + gone)

    def _preview(self, table: str, limit: int = 10, where: str | None = None) -> dict:
        if table not in ALLOWED or table not in self.tables:
            return _error("TABLE_NOT_FOUND", table, allowed=sorted(ALLOWED))
        if where and (len(where) > MAX_WHERE or DENIED.search(where)):
            return _error("BAD_WHERE", "only a plain condition is allowed")
        df = self.tables[table]
        try:
            df = df.where(where) if where else df
            return _ok(self._rows(df.orderBy(*df.columns[:2]).limit(limit)))
        except Exception as error:
            return _error("QUERY_FAILED", str(error)[:300])

    def _find(self, query: str, source: str | None = None, limit: int = 20) -> dict:
        if source is not None and source not in CONTRACTS:
            return _error("UNKNOWN_SOURCE", source, known=list(CONTRACTS))
        rows = self._rows(find_records(self.tables["conformed.customer"], query, source, limit))
        if not rows:
            return _error("NO_MATCH", f"no conformed row matches {query!r}", hint="try a shorter part, no source, or preview_table on a raw table")
        return _ok(
            {
                "query": query, "source_filter": source, "row_count": len(rows), "rows": rows,
                "next_step": "find its customer_id in curated.customer_xref, then call trace_lineage"
            }
        )

    def _trace(self, customer_id: str) -> dict:
        customer_id = customer_id.strip()
        tree = self._rows(lineage_tree(self.tables["curated.customer_master"], self.tables["curated.customer_xref"], self.tables["conformed.customer"], self._raw(), customer_id))
        if not tree:
            return _error("NO_MATCH", f"no master {customer_id!r}", hint="find_record finds records by name or e-mail address")
        audit = self.tables.get("curated.match_audit")
        return _ok({"trace": tree[0], "match_audit": self._rows(audit_trail(audit, self.tables["curated.customer_xref"], customer_id)) if audit is not None else []})

    def _schema(self, source: str) -> dict:
        if source not in CONTRACTS:
            return _error("UNKNOWN_SOURCE", source, known=list(CONTRACTS))
        c = CONTRACTS[source]
        return _ok(
            {
                "source": c.name, "kind": c.kind, "delimiter": None if c.kind == "json" else c.separator, "encoding": c.encoding,
                "columns": list(c.columns), "known_issues": list(c.issues), "lineage_columns": list(LINEAGE), "warehouse_table": f"raw.{c.name}"
            }
        )

    def _status(self) -> dict:
        kept = self.tables.get("curated.quality_status")
        if kept is not None:
            status = F.when(F.col("passed"), "PASS").when(F.col("severity") == "BLOCK", "FAIL").otherwise("WARN")
            rows = kept.select(F.col("name").alias("check_name"), "severity", status.alias("status"), "detail", "checked_at")
            one = rows.agg(F.sort_array(F.collect_list(F.struct("checked_at", "check_name", "severity", "status", "detail")), asc=False).alias("checks"))  # a few checks a run
            found = one.select("checks", overall(F.col("checks")).alias("overall")).first().asDict(recursive=True)
            if found["checks"]:
                return _ok(found | {"source": "curated.quality_status"})
        counts = [self.tables[n].agg(F.count("*").alias(a)) for n, a in (("curated.customer_master", "m"), ("conformed._reject", "r"), ("curated.customer_review", "q"))]
        one = counts[0].join(counts[1]).join(counts[2]).select(status_checks(F.col("m"), F.col("r"), F.col("q")).alias("checks"))  # one row each
        return _ok(one.select("checks", overall(F.col("checks")).alias("overall")).first().asDict(recursive=True) | {"source": "derived"})
