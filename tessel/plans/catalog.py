"""Queries that exercise the customer-view operators on the driver's tables,
each with the DuckDB SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessel.contracts import Settings
from tessel.functions import text as t
from tessel.operators import checks, resolve, serve
from tessel.operators.components import connected_components
from tessel.storage import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def scan_project_filter(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F' and o_totalprice > 100000").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT p_partkey, p_name, p_retailprice FROM part WHERE lower(p_name) LIKE '%an%' OR lower(p_brand) LIKE '%an%' ORDER BY p_retailprice DESC, p_partkey LIMIT 50 OFFSET 10")
def substring_search_topk(spark, d):
    rows = table(spark, d, "part").where(serve.like_any("an", "p_name", "p_brand"))
    return rows.orderBy(F.desc("p_retailprice"), "p_partkey").offset(10).limit(50).select("p_partkey", "p_name", "p_retailprice")


@query(
    "SELECT source AS _source, count(*) AS total, CAST(avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS lang, CAST(avg(CASE WHEN text IS NULL THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS text FROM documents GROUP BY source"
)
def null_rate_by_source(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("_source"), F.nullif("lang", F.lit("en")).alias("lang"), "text")
    return checks.null_rates(rows, ("lang", "text"))


@query("SELECT DISTINCT o_custkey FROM orders")
def distinct_fk(spark, d):
    return table(spark, d, "orders").select("o_custkey").distinct()


@query("SELECT doc_id, nullif(trim(lower(regexp_replace(regexp_replace(strip_accents(text), '[.,]+', ' ', 'g'), '\\s+', ' ', 'g'))), '') AS name FROM documents")
def normalize_name(spark, d):
    return table(spark, d, "documents").select("doc_id", t.normalized_name(F.col("text")).alias("name"))


@query("""WITH w AS (SELECT p_partkey, string_split(upper(p_name), ' ') AS w FROM part)
SELECT p_partkey, upper(left(list_first, 1)) || lower(substr(list_first, 2)) AS last_name, rest AS first_name FROM (
SELECT p_partkey, w[len(w)] AS list_first, array_to_string(list_transform(w[1:len(w) - 1], lambda x: upper(left(x, 1)) || lower(substr(x, 2))), ' ') AS rest FROM w)""")
def split_full_name(spark, d):
    first, last = t.split_name(F.upper("p_name"))
    return table(spark, d, "part").select("p_partkey", F.coalesce(first, F.lit("")).alias("first_name"), last.alias("last_name"))


_MAIL = r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"


@query(f"""WITH m AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '{_MAIL}'))) AS e FROM documents),
s AS (SELECT doc_id, string_split(string_split(e, '@')[1], '+')[1] AS l, string_split(e, '@')[2] AS dom FROM m)
SELECT doc_id, CASE WHEN dom IN ('gmail.com', 'googlemail.com') THEN replace(l, '.', '') || '@gmail.com' WHEN l <> '' THEN l || '@' || dom END AS email FROM s""")
def email_normalize(spark, d):
    """Every address of every text."""
    e = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_MAIL), 0)).alias("e"))
    return e.select("doc_id", t.normalized_email(F.col("e")).alias("email"))


_PHONE = r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}"


@query(f"""WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_PHONE}')) AS p FROM documents),
n AS (SELECT doc_id, regexp_replace(p, '[^0-9]', '', 'g') AS n FROM p)
SELECT doc_id, CASE WHEN regexp_matches(n, '^1?[2-9][0-9]{{2}}[2-9][0-9]{{6}}$') THEN '+1' || right(n, 10) END AS phone FROM n""")
def phone_e164(spark, d):
    """Every number of every text."""
    p = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_PHONE), 0)).alias("p"))
    return p.select("doc_id", t.normalized_phone(F.col("p"))[0].alias("phone"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS parsed FROM orders")
def parse_dates_multi(spark, d):
    k = F.col("o_orderkey") % 5
    day = F.col("o_orderdate")
    text = F.when(
        k == 0, F.date_format(day, "yyyy-MM-dd")
    ).when(k == 1, F.date_format(day, "yyyyMMdd")).when(k == 2, F.date_format(day, "dd.MM.yyyy")).when(k == 3, F.date_format(day, "M/d/yyyy")).otherwise(F.date_format(day, "yyyy/M/d"))
    return table(spark, d, "orders").select("o_orderkey", t.parsed_date(text).alias("parsed"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def excel_serial(spark, d):
    serial = F.date_diff(F.to_date("o_orderdate"), F.lit("1899-12-30").cast("date")).cast("string")
    return table(spark, d, "orders").select("o_orderkey", t.parsed_date(serial).alias("day"))


@query(
    "SELECT c_custkey, CASE WHEN length(CAST(c_custkey AS VARCHAR)) = 4 THEN '0' || CAST(c_custkey AS VARCHAR) ELSE CAST(c_custkey AS VARCHAR) END AS zip, length(CAST(c_custkey AS VARCHAR)) = 4 AS padded FROM customer"
)
def zip_pad(spark, d):
    z, padded = t.padded_zip(F.col("c_custkey").cast("string"))
    return table(spark, d, "customer").select("c_custkey", z.alias("zip"), padded.alias("padded"))


@query("SELECT o_orderkey, CAST(round(o_totalprice, 2) AS DOUBLE) AS amount FROM orders")
def german_decimal(spark, d):
    shown = F.translate(F.format_number(F.round("o_totalprice", 2), 2), ",.", ".,")
    return table(spark, d, "orders").select("o_orderkey", t.german_decimal(shown).alias("amount"))


@query("SELECT c_custkey, sha256('pep' || c_name) AS hashed, left(sha256('pep' || lower(trim(c_name))), 16) AS token FROM customer")
def pii_hash(spark, d):
    return table(spark, d, "customer").select("c_custkey", t.pii_hash(F.col("c_name"), "pep").alias("hashed"), t.street_token(F.col("c_name"), "pep").alias("token"))


@query(f"""WITH h AS (SELECT c_custkey, sha1(unhex('{t.URL_NAMESPACE}') || encode('name:' || c_name)) AS h FROM customer)
SELECT c_custkey, left(h, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id
FROM h""")
def uuid5_id(spark, d):
    return table(spark, d, "customer").select("c_custkey", t.uuid5(F.concat(F.lit("name:"), "c_name")).alias("id"))


@query(
    """SELECT l_orderkey, l_linenumber, array_to_string(list_sort(list_filter([CASE WHEN l_discount > 0.05 THEN 'discounted' END,
CASE WHEN l_returnflag = 'R' THEN 'returned' END, CASE WHEN l_quantity > 40 THEN 'bulk' END], lambda x: x IS NOT NULL)), ',') AS flags FROM lineitem"""
)
def flags_join(spark, d):
    f = t.flags({"discounted": F.col("l_discount") > 0.05, "returned": F.col("l_returnflag") == "R", "bulk": F.col("l_quantity") > 40})
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", f.alias("flags"))


@query("SELECT min(doc_id) AS rep, count(*) AS n FROM documents GROUP BY lower(trim(text))")
def dedup_exact_clusters(spark, d):
    """Documents with equal texts as clusters: star edges on a key, components, members."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.lower(F.trim("text")), 256).alias("key"))
    found = resolve.labelled(docs, resolve.star_edges(docs, "doc_id", "key"), "doc_id")
    return found.groupBy(F.col("component").alias("rep")).agg(F.count("*").alias("n"))


def _part_edges(spark, d):
    part = table(spark, d, "part")
    return resolve.star_edges(part, "p_partkey", "p_brand", "p_size", "p_type").unionByName(resolve.star_edges(part, "p_partkey", "p_name", "p_brand", "p_size"))


_PART_COMPONENTS = """WITH RECURSIVE e AS (SELECT a.p_partkey AS a, b.p_partkey AS b
FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND (a.p_type = b.p_type OR a.p_name = b.p_name)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS p_partkey, min(b) AS component FROM r GROUP BY a)"""


@query(f"{_PART_COMPONENTS} SELECT p_partkey, component FROM c")
def components_two_keys(spark, d):
    found = connected_components(_part_edges(spark, d))
    return table(spark, d, "part").join(found, F.col("p_partkey") == F.col("node"), "left").select("p_partkey", F.coalesce("root", "p_partkey").alias("component"))


@query("SELECT count(*) - count(DISTINCT component) AS merged FROM (" + f"{_PART_COMPONENTS} SELECT component FROM c" + ")")
def auto_merge_count(spark, d):
    return components_two_keys(spark, d).agg((F.count("*") - F.count_distinct("component")).alias("merged"))


def _cluster_records(spark, d):
    """Documents as records: one cluster per text; source, language and length disagree."""
    doc = table(spark, d, "documents")
    return doc.select(
        F.md5("text").alias("component"), F.col("source").alias("_source"), F.col("doc_id"), "lang", F.substring("text", 1, 20).alias("head"),
        F.regexp_replace("source", r"\D", "").cast("int").alias("rank")
    )


@query("""WITH r AS (SELECT md5(text) AS component, source, doc_id, lang, CAST(regexp_replace(source, '[^0-9]', '', 'g') AS INT) AS rank FROM documents)
SELECT component, arg_max(source, rank * 10000000 - doc_id) AS source, arg_max(lang, rank * 10000000 - doc_id) AS lang, CAST(count(DISTINCT source) AS INTEGER) AS n_sources,
CAST(CASE WHEN count(DISTINCT lang) = 1 THEN 1.0 ELSE greatest(0.5, 1.0 - 0.1 * (count(DISTINCT lang) - 1)) END AS DOUBLE) AS lang_confidence FROM r GROUP BY component""")
def survivorship_by_rank(spark, d):
    best = resolve.survivors(_cluster_records(spark, d), "component", ("lang",), (), F.col("rank"), ["doc_id"])
    return best.select("component", F.col("lang.source").alias("source"), F.col("lang.value").alias("lang"), "n_sources", "lang_confidence")


@query("""WITH w AS (SELECT source, doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS no FROM documents),
r AS (SELECT source AS component, word, doc_id, no, row_number() OVER (PARTITION BY source ORDER BY length(word) DESC, doc_id, no) AS k FROM w WHERE word <> '')
SELECT component, any_value(word) FILTER (WHERE k = 1) AS word,
CAST(CASE WHEN count(DISTINCT word) = 1 THEN 1.0 ELSE greatest(0.5, 1.0 - 0.1 * (count(DISTINCT word) - 1)) END AS DOUBLE) AS word_confidence FROM r
GROUP BY component""")
def survivorship_longest(spark, d):
    """The longest of all words of a source's documents, the first of equals."""
    rows = table(spark, d, "documents").select(
        F.col("source").alias("component"), F.col("source").alias("_source"), "doc_id", F.posexplode(F.split("text", " ")).alias("no", "word")
    )
    return resolve.survivors(rows, "component", (), ("word",), F.lit(0), ["doc_id", "no"]).select("component", F.col("word.value").alias("word"), "word_confidence")


@query("""SELECT source AS difficulty, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS fp, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS fn, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS tn
FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (source)""")
def eval_confusion(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return resolve.confusion(
        rows.select(F.col("source").alias("difficulty"), (F.col("quality") == 1).alias("truth"), (F.col("toxic") == 0).alias("said"))
    ).select("difficulty", "tp", "fp", "fn", "tn")


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS ordinal FROM customer")
def record_ordinals(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).alias("ordinal"))


@query("SELECT r_name, n_name, c_name, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def dimension_lookup(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    rows = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("r_name", "n_name", "c_name", "c_acctbal")
