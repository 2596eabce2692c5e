"""Feed files made from the customer table, one per contract, each with its
feed's quirks, and the SQL of what they conform to.

Expressions are SQL that Spark and DuckDB share; ``raw`` makes the file's
columns, ``want`` the conformed columns that another engine expects of them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessel.contracts import CONTRACTS, Settings
from tessel.operators import conform
from tessel.sources.feeds import read_feed
from tessel.storage import shared_dir, table, written

K = "c_custkey"
TEXT = f"CAST({K} AS STRING)"
FIRST = f"CASE {K} % 4 WHEN 0 THEN 'Maria' WHEN 1 THEN 'Sean' WHEN 2 THEN 'Jürgen' ELSE 'Anna' END"
LAST = f"CASE {K} % 5 WHEN 0 THEN 'Smith' WHEN 1 THEN 'Garcia' WHEN 2 THEN 'Wagner' WHEN 3 THEN 'Müller' ELSE 'Brown' END"
PLAIN = f"replace(lower({FIRST} || ' ' || {LAST}), 'ü', 'u')"
FOUR = f"lpad(CAST({K} % 10000 AS STRING), 4, '0')"
SIX = f"lpad(CAST({K} % 1000000 AS STRING), 6, '0')"
YEAR = f"CAST(1930 + ({K} + CAST(floor({K} / 60.0) AS INT)) % 60 AS STRING)"
SHORT = f"({K} + CAST(floor({K} / 100.0) AS INT)) % 100"
DAY = f"lpad(CAST({K} % 28 + 1 AS STRING), 2, '0')"
TEST = f"{K} % 35 = 0"


@dataclass(frozen=True)
class Sample:
    raw: dict[str, str]
    want: dict[str, str]
    reject: str  # the reason a row is rejected for, or NULL
    flags: dict[str, str] = field(default_factory=dict)


def _named(shown: str, test: str = "'Mickey Mouse'") -> str:
    return f"CASE WHEN {TEST} THEN {test} ELSE {shown} END"


_TEST = f"WHEN {TEST} THEN 'test_record'"
SAMPLES = {
    "acq_northwind": Sample(
        dict(CUSTNO=f"'NW' || {TEXT}", CUSTNAME=_named(f"upper({LAST} || ' ' || {FIRST})", "'DONALD DUCK'"), ADDR1=f"{TEXT} || ' Main St'", CITY="'Boston'", ST="'ma'", ZIP=FOUR,
             PHONE=f"CASE WHEN {K} % 3 = 0 THEN '12' ELSE '6175' || {SIX} END", DTADDED=f"'199903' || {DAY}", DTBIRTH=f"CASE WHEN {K} % 2 = 0 THEN '00000000' ELSE {YEAR} || '01' || {DAY} END", STATUS="'A'"),
        dict(_source_id=f"'NW' || {TEXT}", phone_e164=f"CASE WHEN {K} % 3 <> 0 THEN '+16175' || {SIX} END", street=f"{TEXT} || ' Main St'", city="'Boston'", region="'MA'", postal_code=f"'0' || {FOUR}", country="'US'",
             birth_date=f"CASE WHEN {K} % 2 = 1 THEN {YEAR} || '-01-' || {DAY} END", created=f"'1999-03-' || {DAY}",
             ),
        f"CASE {_TEST} END", dict(dob_zero_date=f"{K} % 2 = 0", phone_invalid=f"{K} % 3 = 0", zip_padded="true")),
    "acq_rheinland": Sample(
        dict(Kundennr=f"'RH-' || {TEXT}", Name=_named(
            f"{LAST} || ', ' || {FIRST}", "'Mouse Mickey Mouse'"
        ), Strasse=f"'Hauptstraße ' || {TEXT}", PLZ="'10115'", Ort="'Köln'", Telefon=f"'030 5' || {SIX}",
             Email=f"upper('u' || {TEXT} || '@web.de')", Geburtsdatum=f"CASE WHEN {K} % 11 = 0 THEN '31.02.1970' ELSE {DAY} || '.09.' || {YEAR} END", Umsatz="'12.840,55'", Newsletter="'Ja'"),
        dict(_source_id=f"'RH-' || {TEXT}", email_normalized=f"'u' || {TEXT} || '@web.de'", phone_e164=f"'+49305' || {SIX}", street=f"'Hauptstraße ' || {TEXT}", city="'Köln'", region="'DE'", postal_code="'10115'", country="'DE'",
             birth_date=f"{YEAR} || '-09-' || {DAY}"),
        f"CASE {_TEST} WHEN {K} % 11 = 0 THEN 'invalid_date' END", dict(encoding_lossy=f"{K} % 3 = 0")),
    "acq_sunset": Sample(
        dict(acct=f"CASE WHEN {K} % 17 <> 0 THEN 'SC' || {TEXT} END", name=f"CASE WHEN {K} % 17 <> 0 THEN {_named(f'{FIRST} || chr(32) || {LAST}')} END", address=f"CASE WHEN {K} % 17 <> 0 THEN {TEXT} || ' Elm St' || chr(10) || 'Rear' END", city="CAST(NULL AS STRING)", st="CAST(NULL AS STRING)",
             zip="CAST(NULL AS STRING)", phone=f"CASE WHEN {K} % 17 <> 0 THEN '(617) 5' || {SIX} || ' ext. ' || CAST({K} % 9 + 1 AS STRING) END", signup_dt=f"CASE WHEN {K} % 17 <> 0 THEN CAST(44197 + {K} % 300 AS STRING) END", email="CAST(NULL AS STRING)", notes="'VIP, \"old\"'"),
        dict(
            _source_id=f"'SC' || {TEXT}", phone_e164=f"'+16175' || {SIX}", phone_ext=f"CAST({K} % 9 + 1 AS STRING)",
            street=f"{TEXT} || ' Elm St' || chr(10) || 'Rear'", country="'US'",
            created=f"strftime(DATE '2021-01-01' + CAST({K} % 300 AS INTEGER), '%Y-%m-%d')"
        ),
        f"CASE WHEN {K} % 17 = 0 THEN 'all_null' {_TEST} END"),
    "crm": Sample(
        dict(contact_id=f"'C' || {TEXT}", account_name="'NULL'", full_name=_named(
            f"{LAST} || ', ' || {FIRST}", "'Vandelay, Art'"
        ), email=f"'First.' || {TEXT} || '+tag@GoogleMail.com'", phone="'NULL'", mailing_street="'NULL'", mailing_city=f"'Troy'", mailing_state="'mi'",
             mailing_zip=f"{FOUR} || '-1234'", date_of_birth=f"CASE WHEN {K} % 13 = 0 THEN '6/31/22' ELSE '7/1/' || lpad(CAST({SHORT} AS STRING), 2, '0') END", lead_source="'Web'", created_date=f"'3/' || CAST({K} % 28 + 1 AS STRING) || '/2021'"),
        dict(_source_id=f"'C' || {TEXT}", email_normalized=f"'first' || {TEXT} || '@gmail.com'", city="'Troy'", region="'MI'", postal_code=f"'0' || {FOUR} || '-1234'", country="'US'",
             birth_date=f"CASE WHEN {SHORT} >= 69 THEN '19' ELSE '20' END || lpad(CAST({SHORT} AS STRING), 2, '0') || '-07-01'", created=f"'2021-03-' || {DAY}"),
        f"CASE {_TEST} WHEN {K} % 13 = 0 THEN 'invalid_date' END", dict(zip_padded="true")),
    "ecommerce": Sample(
        dict(customer_id=f"'ec_' || {TEXT}", first_name=_named(f"upper({FIRST})", "'mickey'"), last_name=_named(f"lower({LAST})", "'mouse'"), email=f"'a.b' || {TEXT} || '+x@yahoo.com'", phone=f"'6175' || {SIX}", created_at=f"CASE WHEN {K} % 19 = 0 THEN 'soon' ELSE '2024-01-' || {DAY} || 'T03:04:05Z' END",
             line1=f"CASE WHEN {K} % 2 = 0 THEN '1 Lake Dr' END", city=f"CASE WHEN {K} % 2 = 0 THEN 'Chicago' END", region=f"CASE WHEN {K} % 2 = 0 THEN 'il' END", postal_code=f"CASE WHEN {K} % 2 = 0 THEN '6060' END", country=f"CASE WHEN {K} % 2 = 0 THEN 'US' END", marketing_opt_in="'true'", total_orders="'3'"),
        dict(_source_id=f"'ec_' || {TEXT}", email_normalized=f"'a.b' || {TEXT} || '@yahoo.com'", phone_e164=f"'+16175' || {SIX}", street=f"CASE WHEN {K} % 2 = 0 THEN '1 Lake Dr' END", city=f"CASE WHEN {K} % 2 = 0 THEN 'Chicago' END", region=f"CASE WHEN {K} % 2 = 0 THEN 'IL' END",
             postal_code=f"CASE WHEN {K} % 2 = 0 THEN '6060' END", country=f"CASE WHEN {K} % 2 = 0 THEN 'US' END", created=f"'2024-01-' || {DAY}"),
        f"CASE {_TEST} WHEN {K} % 19 = 0 THEN 'invalid_date' END"),
    "loyalty": Sample(
        dict(member_id=f"'LY-' || {TEXT}", full_name=_named(f"{FIRST} || ' ' || {LAST}"), email=f"'u' || {TEXT} || '@web.de'", phone="''", tier="'gold'", points_balance="'1,200'", enrolled_at=f"'2020/2/' || CAST({K} % 28 + 1 AS STRING)",
             birth_date=f"CASE WHEN {K} % 3 = 0 THEN '0000-00-00' WHEN {K} % 23 = 0 THEN 'x1' ELSE '1979-03-' || {DAY} END", home_store="'S1'", pos_customer_id=f"CASE WHEN {K} % 2 = 0 THEN '999999' WHEN {K} % 10 = 3 THEN 'X' || {TEXT} ELSE {TEXT} END"),
        dict(
            _source_id=f"'LY-' || {TEXT}", email_normalized=f"'u' || {TEXT} || '@web.de'", country="'US'",
            birth_date=f"CASE WHEN {K} % 3 <> 0 THEN '1979-03-' || {DAY} END", created=f"'2020-02-' || {DAY}"
        ),
        f"CASE {_TEST} WHEN {K} % 3 <> 0 AND {K} % 23 = 0 THEN 'invalid_date' END", dict(dob_zero_date=f"{K} % 3 = 0", fk_sentinel=f"{K} % 2 = 0")),
    "pos": Sample(
        dict(CUST_ID=TEXT, NAME=_named(
            f"upper({LAST} || ' ' || {FIRST})", "'DONALD DUCK'"
        ), PHONE=f"'1-617-5' || {SIX}", EMAIL="''", ADDR=f"CASE WHEN {K} % 4 = 0 THEN '1 M�in' ELSE '1 Main' END", CITY="'Troy'", STATE="'ny'", ZIP="'12180'",
             DOB=f"CASE {K} % 29 WHEN 0 THEN '1850-01-01' WHEN 1 THEN 'bad' ELSE '2/1/' || {YEAR} END", LAST_TXN_DATE=f"'202201' || {DAY}", LIFETIME_SPEND=f"CASE WHEN {K} % 31 = 0 THEN '$2,000,000.00' ELSE '10.5' END"),
        dict(
            _source_id=TEXT, phone_e164=f"'+16175' || {SIX}", street=f"CASE WHEN {K} % 4 = 0 THEN '1 M�in' ELSE '1 Main' END", city="'Troy'",
            region="'NY'", postal_code="'12180'", country="'US'", birth_date=f"{YEAR} || '-02-01'", created=f"'2022-01-' || {DAY}"
        ),
        f"CASE {_TEST} WHEN {K} % 31 = 0 THEN 'spend_outlier' WHEN {K} % 29 = 1 THEN 'invalid_date' WHEN {K} % 29 = 0 THEN 'dob_out_of_range' END", dict(encoding_lossy=f"{K} % 4 = 0")),
}
CONFORMED = (
    "_source_id", "first_name", "last_name", "full_name_normalized", "email_normalized", "phone_e164", "phone_ext", "street", "city", "region",
    "postal_code", "country", "birth_date", "created", "flags"
)


def expected(name: str) -> str:
    """SQL over ``customer``: what the sample feed conforms to; a rejected row
    has its reason and nothing else."""
    s = SAMPLES[name]
    want = {"first_name": FIRST, "last_name": LAST, "full_name_normalized": PLAIN, **s.want}
    told = ", ".join(f"CASE WHEN {holds} THEN '{flag}' END" for flag, holds in sorted(s.flags.items())) or "NULL"
    want["flags"] = f"concat_ws(',', {told})"
    columns = ", ".join(f"CASE WHEN why IS NULL THEN {want.get(c, 'CAST(NULL AS STRING)')} END AS {c}" for c in CONFORMED)
    return f"SELECT {columns}, why AS reason FROM (SELECT *, {s.reject} AS why FROM customer)"


def write_feed(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Files of the sample feed in the shared folder; their path."""
    contract, path = CONTRACTS[name], f"{shared_dir(spark)}/feed-{name}-{uuid.uuid4().hex}"
    shown = {v: k for k, v in contract.rename.items()}
    rows = table(spark, sf_dir, "customer").select(K, *[F.expr(SAMPLES[name].raw[c]).cast("string").alias(shown.get(c, c)) for c in contract.columns])
    writer = lambda df: df.drop(K).write.mode("append").options(
        header=True, sep=contract.separator, escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    if contract.kind == "json":
        inner = ("line1", "city", "region", "postal_code", "country")
        nested = F.when(F.col("line1").isNotNull(), F.struct(*inner)).alias("shipping_address")
        one = rows.select(K, F.struct(*[c for c in contract.columns if c not in inner], nested).alias("r"))
        # Arrays of bounded length, each a file of its own.
        parts = one.groupBy(F.floor(F.col(K) / 1000).alias("part")).agg(F.to_json(F.collect_list("r"), {"ignoreNullFields": "false"}).alias("value"))
        parts.write.partitionBy("part").text(path)
    elif contract.kind == "mixed":
        writer(rows.where(f"{K} % 3 <> 0")).option("encoding", "UTF-8").csv(path)
        writer(rows.where(f"{K} % 3 = 0")).option("encoding", "ISO-8859-1").csv(path)
    else:
        writer(rows).csv(path)
    return path


def shown(customers: DataFrame, rejects: DataFrame) -> DataFrame:
    """Conformed and rejected rows as ``expected`` has them."""
    own = F.when(F.col("_source") == "pos", F.substring_index("_source_id", ":", 1)).otherwise(F.col("_source_id"))
    kept = customers.select(
        own.alias("_source_id"), *[F.col(c) for c in CONFORMED[1:12]], F.col("birth_date").cast("string").alias("birth_date"),
        F.date_format("created_at_utc", "yyyy-MM-dd").alias("created"), F.col("field_quality_flags").alias("flags"),
        F.lit(None).cast("string").alias("reason")
    )
    return kept.unionByName(rejects.select(F.col("reject_reason").alias("reason")), allowMissingColumns=True)


def conformed() -> str:
    """SQL of all feeds' conformed rows, as ``k``, _source and CONFORMED."""
    return " UNION ALL ".join(f"SELECT '{n}' AS _source, e.* EXCLUDE (reason) FROM ({expected(n)}) e WHERE reason IS NULL" for n in SAMPLES)


def rejected() -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS _source, reason FROM ({expected(n)}) e WHERE reason IS NOT NULL" for n in SAMPLES)


@dataclass(frozen=True)
class Zone:
    raw: dict[str, DataFrame]
    headers: dict[str, DataFrame]
    customers: DataFrame
    rejects: DataFrame


_built: dict[tuple[str, str], Zone] = {}


def zone(spark: SparkSession, sf_dir: str) -> Zone:
    """The sample feeds, read and conformed: written once a session."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _built:
        raw, headers = {}, {}
        for name in SAMPLES:
            rows, headers[name] = read_feed(spark, CONTRACTS[name], write_feed(spark, sf_dir, name))
            raw[name] = written(rows, f"raw-{name}")
        kept, rejects = conform.conform_all(raw, Settings())
        _built[at] = Zone(raw, headers, written(kept, "customer"), written(rejects, "reject"))
    return _built[at]
