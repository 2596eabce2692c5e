"""Source contracts, settings and table schemas of the customer view."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import StringType, StructField, StructType


@dataclass(frozen=True)
class Contract:
    """What a feed's file must hold."""

    name: str
    columns: tuple[str, ...]
    kind: str = "csv"  # csv, mixed (per-line encoding) or json
    separator: str = ","
    rename: dict[str, str] = field(default_factory=dict)  # the file's names, where they differ
    encoding: str = "utf-8"
    issues: tuple[str, ...] = ()

    @property
    def schema(self) -> StructType:
        return StructType([StructField(c, StringType()) for c in self.columns])


#: The CRM export's headers and the columns they become.
CRM_HEADERS = {
    "Contact ID": "contact_id",
    "Account Name": "account_name",
    "Full Name": "full_name",
    "Email": "email",
    "Phone": "phone",
    "Mailing Street": "mailing_street",
    "Mailing City": "mailing_city",
    "Mailing State/Province": "mailing_state",
    "Mailing Zip/Postal Code": "mailing_zip",
    "Date of Birth": "date_of_birth",
    "Lead Source": "lead_source",
    "Created Date": "created_date",
}

#: The seven feeds and their columns.
CONTRACTS = {
    c.name: c
    for c in (
        Contract(
            "acq_northwind", ("CUSTNO", "CUSTNAME", "ADDR1", "CITY", "ST", "ZIP", "PHONE", "DTADDED", "DTBIRTH", "STATUS"), separator="|",
            issues=("names cut at 20 characters", "zip codes without leading zero", "00000000 for no date")
        ),
        Contract(
            "acq_rheinland", ("Kundennr", "Name", "Strasse", "PLZ", "Ort", "Telefon", "Email", "Geburtsdatum", "Umsatz", "Newsletter"), "mixed", ";",
            encoding="utf-8 and windows-1252 by line", issues=("doubly encoded lines", "day before month", "decimal commas")
        ),
        Contract(
            "acq_sunset", ("acct", "name", "address", "city", "st", "zip", "phone", "signup_dt", "email", "notes"), encoding="utf-8, lossy",
            issues=("line breaks in quotes", "columns moved by one", "serial dates")
        ),
        Contract("crm", tuple(CRM_HEADERS.values()), rename=CRM_HEADERS, encoding="utf-8 with a byte order mark", issues=("NULL as text", "years of two digits")),
        Contract(
            "ecommerce",
            (
                "customer_id", "first_name", "last_name", "email", "phone", "created_at", "line1", "city", "region", "postal_code", "country",
                "marketing_opt_in", "total_orders"
            ),
            "json", issues=("addresses nested or missing", "tags in e-mail addresses")
        ),
        Contract(
            "loyalty",
            ("member_id", "full_name", "email", "phone", "tier", "points_balance", "enrolled_at", "birth_date", "home_store", "pos_customer_id"),
            issues=("999999 for no POS customer", "0000-00-00 for no date")
        ),
        Contract(
            "pos", ("CUST_ID", "NAME", "PHONE", "EMAIL", "ADDR", "CITY", "STATE", "ZIP", "DOB", "LAST_TXN_DATE", "LIFETIME_SPEND"),
            encoding="utf-8, lossy", issues=("customer numbers used again", "test spends", "surname first")
        ),
    )
}
LINEAGE = ("_source", "_source_file", "_source_row", "_ingested_at", "_raw_payload")

#: Columns of the conformed customers, the rejects and the audit trail.
CUSTOMER = "_source string, _source_id string, _source_row long, _source_tz string, _encoding_lossy boolean, first_name string, last_name string, full_name_normalized string, email_normalized string, phone_e164 string, phone_ext string, street string, city string, region string, postal_code string, country string, birth_date date, created_at_utc timestamp, field_quality_flags string"
REJECT = "_source string, _source_id string, _source_row long, reject_field string, reject_reason string, raw_payload string"
AUDIT = "audit_id string, event_type string, customer_id string, other_id string, decision string, score double, note string, created_at timestamp"


@dataclass(frozen=True)
class Settings:
    """Everything that tunes matching and survivorship."""

    #: Trust in sources, weights and thresholds of pair scores.
    ranks: dict[str, int] = field(default_factory=lambda: {"ecommerce": 7, "loyalty": 6, "crm": 5, "pos": 4, "acq_sunset": 3, "acq_rheinland": 3, "acq_northwind": 2})
    weights: dict[str, float] = field(default_factory=lambda: {"name": 0.30, "address": 0.20, "phone": 0.25, "email": 0.20, "dob": 0.05})
    auto_merge: float = 0.90
    review: float = 0.70
    pepper: str = "set-a-pepper"
    #: Surnames that stand first in names in capitals.
    surnames: tuple[str, ...] = (
        "OBRIEN", "O'BRIEN", "HERNANDEZ", "GARCIA", "HERNANDEZ-GARCIA",
        "MUELLER", "MULLER", "MÜLLER", "SCHMIDT", "SCHONFELD", "SCHÖNFELD",
        "NGUYEN", "LEE", "SMITH", "WILLIAMS", "RODRIGUEZ", "MARTINEZ",
        "JOHNSON", "BROWN", "DAVIS", "WILSON", "ANDERSON", "TAYLOR",
        "WAGNER", "GRESS", "GREß", "DANGELO", "D'ANGELO", "MUNOZ", "MUÑOZ",
        "WIERZBICKI-KOWALCZYK", "HALPERT", "CARTER",
    )
    #: Parts of the names of test records, compared lower-case without accents.
    test_names: tuple[str, ...] = ("test test do not use", "mickey mouse", "vandelay art", "vandelay, art", "donald duck")
