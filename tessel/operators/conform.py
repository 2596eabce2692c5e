"""Conforming raw feeds to the canonical customer: one projection per feed, its
reject rules in order (the first that holds wins), its flags."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tessel import contracts
from tessel.contracts import Settings
from tessel.functions import text as t

#: What is left of characters that an encoding lost.
LOSSY = ("�", "?¿", "¿")


def lossy(c: Column) -> Column:
    found = F.lit(False)
    for mark in LOSSY:
        found = found | F.coalesce(F.contains(c, F.lit(mark)), F.lit(False))
    return found


def is_test(c: Column, patterns: tuple[str, ...]) -> Column:
    low = F.lower(t.without_accents(F.coalesce(c, F.lit(""))))
    found = F.lit(False)
    for p in patterns:
        found = found | F.contains(low, F.lit(p))
    return found


@dataclass
class Spec:
    source: str
    source_id: Column
    zone: str
    values: dict[str, Column]
    rejects: list[tuple[str, str, Column]] = field(default_factory=list)  # field, reason, condition
    flags: dict[str, Column] = field(default_factory=dict)
    lossy: Column | None = None


def _id(name: str, prefix: str) -> Column:
    return F.coalesce(t.nonempty(F.col(name)), F.concat(F.lit(f"{prefix}-row-"), F.col("_source_row").cast("string")))


def _given(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def _bad_date(c: Column, d: Column) -> Column:
    return t.coerced(c).isNotNull() & d.isNull()


def specs(settings: Settings) -> dict[str, Spec]:
    c, d = F.col, t.parsed_date
    test = lambda col: ("full_name", "test_record", is_test(F.col(col), settings.test_names))
    out = {}

    first, last = t.split_name(c("CUSTNAME"), settings.surnames)
    phone, ext = t.normalized_phone(c("PHONE"))
    code, padded = t.padded_zip(t.coerced(c("ZIP")))
    day = ("yyyyMMdd",)
    out["acq_northwind"] = Spec("acq_northwind", _id("CUSTNO", "NW"), "UNKNOWN", dict(
        first_name=first, last_name=last, phone_e164=phone, phone_ext=ext, street=t.coerced(c("ADDR1")), city=t.coerced(c("CITY")),
        region=t.nonempty(F.upper(c("ST"))), postal_code=code, country=F.lit("US"), birth_date=d(c("DTBIRTH"), day), created=d(c("DTADDED"), day)
    ), [test("CUSTNAME")],
        {"name_truncated": (F.length(F.rtrim(c("CUSTNAME"))) == 20) & F.contains(F.trim(c("CUSTNAME")), F.lit(" ")), "phone_invalid": _given(c("PHONE")) & phone.isNull(), "zip_padded": padded, "dob_zero_date": F.trim(c("DTBIRTH")) == "00000000"})

    first, last = t.split_name(c("Name"), settings.surnames)
    phone, ext = t.normalized_phone(c("Telefon"), "DE")
    born = d(c("Geburtsdatum"), ("d.M.yyyy", "yyyy-M-d"))
    broken = F.coalesce(c("_encoding_fixed"), F.lit(False)) | lossy(c("Name"))
    out["acq_rheinland"] = Spec("acq_rheinland", _id("Kundennr", "RH"), "Europe/Berlin", dict(
        first_name=first, last_name=last, email_normalized=t.normalized_email(c("Email")), phone_e164=phone, phone_ext=ext,
        street=t.coerced(c("Strasse")), city=t.coerced(c("Ort")), region=F.lit("DE"), postal_code=t.coerced(c("PLZ")), country=F.lit("DE"),
        birth_date=born
    ), [test("Name"), ("Geburtsdatum", "invalid_date", _bad_date(c("Geburtsdatum"), born))],
        {"phone_invalid": _given(c("Telefon")) & phone.isNull(), "encoding_lossy": broken}, broken)

    first, last = t.split_name(c("name"), settings.surnames)
    phone, ext = t.normalized_phone(c("phone"))
    code, padded = t.padded_zip(t.coerced(c("zip")))
    broken = lossy(c("name")) | F.coalesce(F.contains(c("address"), F.lit("�")), F.lit(False))
    nothing = F.coalesce(*[t.nonempty(c(x)) for x in ("name", "address", "city", "st", "zip", "phone", "signup_dt", "email")]).isNull()
    out["acq_sunset"] = Spec("acq_sunset", _id("acct", "SC"), "America/New_York", dict(
        first_name=first, last_name=last, email_normalized=t.normalized_email(c("email")), phone_e164=phone, phone_ext=ext,
        street=t.coerced(c("address")), city=t.coerced(c("city")), region=t.nonempty(F.upper(c("st"))), postal_code=code, country=F.lit("US"),
        created=d(c("signup_dt"))
    ), [test("name"), ("*", "all_null", nothing)],
        {"phone_invalid": _given(c("phone")) & phone.isNull(), "zip_padded": padded, "encoding_lossy": broken}, broken)

    clean = lambda x: F.nullif(t.nonempty(c(x)), F.lit("NULL"))
    first, last = t.split_name(clean("full_name"), settings.surnames)
    phone, ext = t.normalized_phone(clean("phone"))
    code, padded = t.padded_zip(clean("mailing_zip"))
    dates = ("M/d/yy", "M/d/yyyy", "yyyy-M-d")
    born = d(clean("date_of_birth"), dates)
    out["crm"] = Spec("crm", _id("contact_id", "CRM"), "America/New_York", dict(
        first_name=first, last_name=last, email_normalized=t.normalized_email(clean("email")), phone_e164=phone, phone_ext=ext,
        street=clean("mailing_street"), city=clean("mailing_city"), region=t.nonempty(F.upper(clean("mailing_state"))), postal_code=code,
        country=F.lit("US"), birth_date=born, created=d(clean("created_date"), dates)
    ), [test("full_name"), ("date_of_birth", "invalid_date", _bad_date(clean("date_of_birth"), born))],
        {"phone_invalid": clean("phone").isNotNull() & phone.isNull(), "zip_padded": padded})

    home = F.when(F.upper(F.coalesce(c("country"), F.lit(""))).isin("", "US", "USA"), "US").otherwise(F.upper(F.substring("country", 1, 2)))
    phone, ext = t.normalized_phone(c("phone"), home)
    made = d(c("created_at"))
    out["ecommerce"] = Spec("ecommerce", _id("customer_id", "EC"), "UTC", dict(
        first_name=t.title_letters(t.coerced(c("first_name"))), last_name=t.title_letters(t.coerced(c("last_name"))),
        email_normalized=t.normalized_email(c("email")), phone_e164=phone, phone_ext=ext, street=t.coerced(c("line1")), city=t.coerced(c("city")),
        region=t.nonempty(F.upper(c("region"))), postal_code=t.coerced(c("postal_code")), country=t.coerced(c("country")), created=made
    ),
        [("full_name", "test_record", is_test(F.concat_ws(" ", "first_name", "last_name"), settings.test_names)), ("created_at", "invalid_date", _bad_date(c("created_at"), made))], {"phone_invalid": _given(c("phone")) & phone.isNull()})

    first, last = t.split_name(c("full_name"), settings.surnames)
    phone, ext = t.normalized_phone(c("phone"))
    born = d(c("birth_date"))
    out["loyalty"] = Spec("loyalty", _id("member_id", "LY"), "America/New_York", dict(
        first_name=first, last_name=last, email_normalized=t.normalized_email(c("email")), phone_e164=phone, phone_ext=ext, country=F.lit("US"),
        birth_date=born, created=d(c("enrolled_at"))
    ), [test("full_name"), ("birth_date", "invalid_date", _bad_date(c("birth_date"), born))],
        {"phone_invalid": _given(c("phone")) & phone.isNull(), "dob_zero_date": F.trim(c("birth_date")) == "0000-00-00", "fk_sentinel": ~real_key(c("pos_customer_id"))})

    first, last = t.split_name(t.coerced(c("NAME")), settings.surnames)
    phone, ext = t.normalized_phone(c("PHONE"))
    code, padded = t.padded_zip(t.coerced(c("ZIP")))
    born = d(c("DOB"))
    broken = F.coalesce(F.contains(F.concat_ws("", "NAME", "ADDR"), F.lit("�")), F.lit(False))
    spend = F.coalesce(F.regexp_replace("LIFETIME_SPEND", "[$,]", "").try_cast("double"), F.lit(0.0))
    out["pos"] = Spec("pos", F.concat(F.coalesce(F.trim("CUST_ID"), F.lit("")), F.lit(":"), c("_source_row").cast("string")), "America/Chicago", dict(
        first_name=first, last_name=last, email_normalized=t.normalized_email(c("EMAIL")), phone_e164=phone, phone_ext=ext,
        street=t.coerced(c("ADDR")), city=t.coerced(c("CITY")), region=t.nonempty(F.upper(c("STATE"))), postal_code=code, country=F.lit("US"),
        birth_date=born, created=d(c("LAST_TXN_DATE"))
    ),
        [
            test("NAME"), ("LIFETIME_SPEND", "spend_outlier", spend > 1e6), ("DOB", "invalid_date", _bad_date(c("DOB"), born)),
            ("DOB", "dob_out_of_range", ~F.year(born).between(1900, 2030))
        ],
        {"phone_invalid": t.coerced(c("PHONE")).isNotNull() & phone.isNull(), "zip_padded": padded, "encoding_lossy": broken}, broken)
    return out


def real_key(c: Column) -> Column:
    """False for the values that stand for no foreign key."""
    return F.coalesce(~F.trim(c).isin("", "999999", "NULL"), F.lit(False))


def conform(raw: DataFrame, spec: Spec) -> tuple[DataFrame, DataFrame]:
    """(customers, rejects) of one feed; both come from one projection."""
    why = F.lit(None).cast("struct<reject_field:string,reject_reason:string>")
    for name, reason, holds in reversed(spec.rejects):
        why = F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(name).alias("reject_field"), F.lit(reason).alias("reject_reason"))).otherwise(why)
    values = {k: v for k, v in spec.values.items() if k != "created"}
    values["full_name_normalized"] = t.normalized_full(F.coalesce(values["first_name"], F.lit("")), F.coalesce(values["last_name"], F.lit("")))
    values["created_at_utc"] = spec.values.get("created", F.lit(None).cast("date")).cast("timestamp")
    values |= {
        "_source": F.lit(spec.source), "_source_id": spec.source_id, "_source_row": F.col("_source_row"), "_source_tz": F.lit(spec.zone),
        "_encoding_lossy": spec.lossy if spec.lossy is not None else F.lit(False),
        "field_quality_flags": t.flags({k: F.coalesce(v, F.lit(False)) for k, v in spec.flags.items()})
    }
    names = [f.split()[0] for f in contracts.CUSTOMER.split(", ")]
    kinds = dict(f.split() for f in contracts.CUSTOMER.split(", "))
    both = raw.select(*[values.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in names], why.alias("_why"), F.col("_raw_payload").alias("raw_payload"))
    rejects = both.where("_why is not null").select("_source", "_source_id", "_source_row", "_why.*", "raw_payload")
    return both.where("_why is null").select(*names), rejects


def conform_all(raw: dict[str, DataFrame], settings: Settings) -> tuple[DataFrame, DataFrame]:
    kept, rejected = None, None
    for name, spec in specs(settings).items():
        if name in raw:
            a, b = conform(raw[name], spec)
            kept, rejected = (a, b) if kept is None else (kept.unionByName(a), rejected.unionByName(b))
    return kept, rejected
