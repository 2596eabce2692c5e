"""Normalizers, components, the pipeline over synthetic feeds, tool envelopes."""

import dataclasses
import datetime
import json
import random
import unicodedata
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessel.contracts import CONTRACTS, Settings
from tessel.functions import digests, text as t
from tessel.operators import components, conform, pairs, resolve, serve
from tessel.operators.components import connected_components
from tessel.plans import pipeline, warehouse
from tessel.sources.feeds import read_feed, repaired
from tessel.streaming import arrivals


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def nfkd(text):
    return unicodedata.normalize("NFKC", "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)))


def test_scalars(spark):
    lit = F.lit
    for value, want in (
        ("First.Last@gmail.com", "firstlast@gmail.com"), ("user+work@yahoo.com", "user@yahoo.com"), ("a.b@googlemail.com", "ab@gmail.com"),
        ("NULL", None), ("", None), ("not-an-email", None)
    ):
        assert one(spark, t.normalized_email(lit(value))) == want
    for value, region, want in (
        ("(973) 555-0142", "US", ("+19735550142", None)), ("(312) 555-0188 x4", "US", ("+13125550188", "4")),
        ("+49 30 1234567", "DE", ("+49301234567", None)), ("03/15/2021", "US", (None, None)), ("NULL", "US", (None, None))
    ):
        number, ext = t.normalized_phone(lit(value), region)
        assert (one(spark, number), one(spark, ext)) == want
    day = datetime.date
    for value, want in (
        ("44197", day(2021, 1, 1)), ("02.09.1975", day(1975, 9, 2)), ("7/22/85", day(1985, 7, 22)), ("1/1/68", day(2068, 1, 1)),
        ("1/1/69", day(1969, 1, 1)), ("00000000", None), ("6/31/22", None), ("19991231", day(1999, 12, 31))
    ):
        assert one(spark, t.parsed_date(lit(value))) == want
    assert one(spark, t.padded_zip(lit("7102-1234"))[0]) == "07102-1234"
    assert one(spark, t.german_decimal(lit("12.840,55"))) == 12840.55 and one(spark, t.german_decimal(lit("abc"))) is None
    assert one(spark, t.uuid5(lit("email:a@b.com"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "email:a@b.com"))
    for value, want in (
        ("Hernandez-Garcia, Maria Jose", ("Maria Jose", "Hernandez-Garcia")), ("OBRIEN SEAN PATRICK", ("Sean Patrick", "Obrien")),
        ("Madonna", (None, "Madonna")), ("HERNANDEZ MARIA", ("Maria", "Hernandez")), ("MÜLLER JÜRGEN", ("Jürgen", "Müller")),
        ("RODRIGUEZ ANA", ("Ana", "Rodriguez")), ("GREß GRETA", ("Greß", "Greta")), ("KIM LEE", ("Kim", "Lee"))
    ):
        first, last = t.split_name(lit(value), Settings().surnames)
        assert (one(spark, first), one(spark, last)) == want
    for value, want in (("Kovač Łukasz", "Kovac Łukasz"), ("ﬁne ¼ Ǆ", "fine 1⁄4 DZ"), ("e\u0301Ａñ", "eAn"), ("ß", "ß"), ("Ελλάδα й", "Ελλαδα и")):
        assert one(spark, t.without_accents(lit(value))) == want == nfkd(value)
    assert one(spark, t.titled(lit("o'brien anne-marie"))) == "O'Brien Anne-Marie"
    assert one(spark, t.token_set_ratio(lit("a b c"), lit("c b"))) == 1.0
    assert abs(one(spark, t.token_set_ratio(lit("kitten"), lit("sitting"))) - 2 * 4 / 13) < 1e-9


def test_encoding(spark):
    cases = [
        ("Jürgen", "utf-8", ("Jürgen", False), ("Jürgen", False)), ("JÃ¼rgen", "utf-8", ("Jürgen", True), ("JÃƒÂ¼rgen", True)),
        ("Jürgen €5", "cp1252", ("Jürgen €5", True), ("Jürgen €5", True)), ("“Muñoz’", "utf-8", ("“Muñoz’", False), ("“Muñoz’", False))
    ]
    cases += [
        ("“Muñoz—".encode().decode("cp1252", "replace"), "utf-8", None, None),
        ("Muñoz ‘x’ – y".encode().decode("cp1252", "ignore"), "utf-8", ("Muñoz ‘x’ – y", True), None), ("日本 Ã¼", "utf-8", ("日本 Ã¼", True), None)
    ]
    for text, code, *wants in cases:
        line = spark.createDataFrame([(text.encode(code).decode("latin-1"),)], "line string")
        for mode, want in zip(("repair", "compat"), wants):
            assert want is None or tuple(repaired(line, mode).first()) == want, (text, mode)


@pytest.mark.parametrize("name", ["acq_rheinland", "acq_northwind", "loyalty"])
def test_row_numbers_after_a_file_without_records(spark, tmp_path, name):
    contract = CONTRACTS[name]
    shown = {v: k for k, v in contract.rename.items()}
    line = lambda words: contract.separator.join(words) + "\n"
    head = line(shown.get(c, c) for c in contract.columns)
    record = lambda k: line(f"{k}{i}" for i in range(len(contract.columns)))
    for i, text in enumerate((head, head + record("a") + record("b"), head, head + record("c"))):
        (tmp_path / f"part-{i}.csv").write_text(text)
    rows, _ = read_feed(spark, contract, str(tmp_path))
    found = rows.select(contract.columns[0], "_source_row").orderBy("_source_row").collect()
    assert [tuple(r) for r in found] == [("a0", 2), ("b0", 3), ("c0", 4)]


@pytest.mark.parametrize("small", [components.SMALL, 0])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL", small)
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
    words = spark.createDataFrame([("b", "é"), ("é", "Z"), ("q", "r"), (None, "x")], "src string, dst string")
    assert {r["node"]: r["root"] for r in connected_components(words).collect()} == {"b": "Z", "é": "Z", "Z": "Z", "q": "q", "r": "q"}
    # Hubs beyond what one task takes, one behind the other.
    hubs = [(0, i) for i in range(1, 600)] + [(i, 10000 + i) for i in range(1, 600)] + [(20000, 10000 + i) for i in range(1, 500)] + [(30000, 30001)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(hubs, "src long, dst long")).collect()}
    assert got == {**{x: 0 for e in hubs for x in e}, 30000: 30000, 30001: 30000}


def test_score_boosts(spark):
    pair = "struct<full_name_normalized:string,street:string,postal_code:string,phone_e164:string,email_normalized:string,birth_date:date>"
    a = ("ann lee", "1 main st", "1", "+1", "a@b.c", None)
    df = spark.createDataFrame([(a, a), (a, ("ann lee", None, None, "+1", "x@y.z", None))], f"l {pair}, r {pair}")
    score = resolve.pair_score(resolve.features(), Settings())
    assert [round(r[0], 2) for r in df.select(score).collect()] == [0.98, 0.92]


def test_ratios_of_all_strings():
    pick = random.Random(5)
    word = lambda: "".join(pick.choice("abü") for _ in range(pick.choice((1, 2, 4, 80))))
    xs, ys = ([" ".join(word() for _ in range(pick.randrange(4))) for _ in range(40)] for _ in "xy")
    for left, right in ((xs, ys), (xs, xs)):
        assert pairs.ratios(left, right).tolist() == [[t._token_set(x, y) for y in right] for x in left]


def test_uuids_of_pairs():
    """Names of one block to five, of few lengths and of many, as the library of
    the language has them."""
    rng = np.random.default_rng(5)
    alike = [f"acq_northwind::NW{k}" for k in rng.integers(1, 999_999, 500)] + ["pos::1:2", "ä::é", ""]
    for keys in (alike, ["x" * n + str(n) for n in range(150)], [f"{k:0{n}}" for n in (40, 200) for k in range(99)]):
        i, j = rng.integers(0, len(keys), (2, 3000))
        there = rng.random(3000) < 0.7
        made = digests.PairUuids([f"review:{k}|".encode() for k in keys], [k.encode() for k in keys])
        found = digests.texts(made.of(i[there], j[there]), there).to_pylist()
        assert found == [str(uuid.uuid5(uuid.NAMESPACE_URL, f"review:{keys[a]}|{keys[b]}")) if t else None for a, b, t in zip(i, j, there)]


def test_reviews_take_one_pass(spark, three_of_each, monkeypatch):
    """Where no score can merge records without an equal phone or e-mail, pairs
    are not scored for merges; where one can, they are.  Ids are made with the pairs."""
    customers = three_of_each._resolved(spark, "")[0].drop("key", "component")
    customers = customers.withColumns({"_source": F.lit("crm"), "_source_id": F.monotonically_increasing_id().cast("string")})
    passes = []
    scored = pairs.scored
    monkeypatch.setattr(pairs, "scored", lambda *args: passes.append(args) or scored(*args))
    settings = three_of_each.SETTINGS
    found = resolve.resolve(customers, None, settings)[1]
    assert len(passes) == 1 and found.count() == 6
    assert resolve.resolve(customers, None, dataclasses.replace(settings, auto_merge=0.5))[0].select("component").distinct().count() == 2
    assert len(passes) == 3
    rows = [r for r in three_of_each.review_pairs(spark, "").collect()]
    want = {None if r["left_key"].startswith("pos") else str(uuid.uuid5(uuid.NAMESPACE_URL, f"review:{r['left_key']}|{r['right_key']}")) for r in rows}
    assert len(rows) == 6 and {r["review_id"] for r in rows} == want
    assert "sha" not in three_of_each.review_pairs(spark, "")._jdf.queryExecution().optimizedPlan().toString()


def test_decided_pairs_leave_the_tiles(spark, monkeypatch):
    """As the anti join has it: in one tile and in several, whatever else is decided."""
    rng = random.Random(7)
    keys = [f"crm::C{k}" for k in rng.sample(range(999), 60)]
    rows = [(k, k, "ann lee", "Lee", "1 Main", "NY", "1", None, None, datetime.date(1980 + i % 2, 1, 2)) for i, k in enumerate(keys)]
    columns = "key string, component string, full_name_normalized string, last_name string, street string, region string, postal_code string, phone_e164 string, email_normalized string, birth_date date"
    records = spark.createDataFrame(rows, columns)
    said = [tuple(rng.sample(keys, 2)) for _ in range(900)] + [("crm::no", keys[0]), (keys[0], "crm::zz")]  # either way round, across blocks, unknown
    audit = spark.createDataFrame([("review_decision", l, r) for l, r in said], "event_type string, customer_id string, other_id string")
    lists = spark.createDataFrame([(l, [r]) for l, r in said[:500]] + [(l, [r, "crm::y"]) for l, r in said[400:]], "left_key string, right_keys array<string>")
    settings = Settings(review=0.3)
    shown = lambda strip: pa.RecordBatch.from_pydict(dict(zip(("left_key", "right_key"), strip.keys())))
    every = resolve.reviews(records, settings, features=())
    want = sorted(tuple(r) for r in serve.open_reviews(every, audit).select("left_key", "right_key").collect())
    assert 0 < len(want) < every.count()
    for tile in (1024, 7):
        monkeypatch.setattr(pairs, "TILE", tile)
        found = pairs.scored(resolve.in_blocks(records), "key", resolve.BLOCKS, "component", settings, shown, "left_key string, right_key string", apart=lists).collect()
        assert sorted(tuple(r) for r in found) == want


def test_open_reviews_are_not_shuffled(spark, three_of_each):
    """The reviews meet the decisions where they are made."""
    plan = three_of_each.open_reviews_anti_audit(spark, "")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and plan.count("FlatMapGroupsInArrow") == 2


def test_tiles_hold_every_pair(spark, monkeypatch):
    """Small tiles against the join of the block with itself."""
    monkeypatch.setattr(pairs, "TILE", 8)
    pick = random.Random(6)
    some = lambda *values: pick.choice((None, *values))
    rows = [
        (
            f"k{i}", f"k{i - i % 3}", some("ann lee", "anna lee", "bo"), pick.choice(("Lee", "lee", "Bo")), some("1 Main", "2 main st", ""), some("1", "2", ""), some("+1", "+2", ""),
            some("a@x.y", "b@x.y", "c@z.y"), some("NY"), datetime.date(1980 + pick.randrange(2), 1, 1 + pick.randrange(2))
        ) for i in range(90)
    ]
    names = "key string, component string, full_name_normalized string, last_name string, street string, postal_code string, phone_e164 string, email_normalized string, region string, birth_date date"
    wide = resolve.in_blocks(spark.createDataFrame(rows, names))
    f = resolve.features()
    want = resolve.blocked_pairs(wide, "key", resolve.BLOCKS, "component").select("l.key", "r.key", *f.values(), resolve.pair_score(f, Settings()))

    def show(strip):
        return pa.RecordBatch.from_arrays([*strip.keys(), *[pa.array(strip.features[k]) for k in pairs.FEATURES], pa.array(strip.score)], names=list("lrabcdes"))

    found = pairs.scored(wide, "key", resolve.BLOCKS, "component", Settings(), show, "l string, r string, a double, b double, c double, d double, e double, s double")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) != []


def test_pipeline(spark, tmp_path):
    (tmp_path / "crm.csv").write_text(
        "﻿" + ",".join(
            f'"{c}"' for c in CONTRACTS["crm"].rename
        ) + '\n"c1","x","Ann Lee","ann@x.com","(973) 555-0142","1 Main","Troy","mi","7102","7/4/85","web","1/1/20"\n"c2","x","Mickey Mouse","m@x.com","","","","","","","",""\n"c3","x","Bob Roe","b@x.com","","","","","","6/31/22","",""\n'
    )
    (tmp_path / "loyalty.csv").write_text(",".join(CONTRACTS["loyalty"].columns) + "\nm1,Ann Lee,ANN@x.com,,gold,1,2020-01-01,,s,1\n")
    (tmp_path / "pos.csv").write_text(",".join(CONTRACTS["pos"].columns) + "\n1,LEE ANN,,N/A,,,,7102,N/A,,10\n1,LEE ANN,,,,,,,,,20\n9,ZED,,,,,,,,,9999999\n")
    (tmp_path / "ec.json").write_text(
        json.dumps(
            [
                {
                    "customer_id": "e1", "first_name": "zoe", "last_name": "kim", "email": "z@k.io", "phone": None,
                    "created_at": "2024-01-02T03:04:05Z", "shipping_address": None
                }
            ]
        )
    )
    out = str(tmp_path / "out")
    report = pipeline.run(spark, {"crm": f"{tmp_path}/crm.csv", "loyalty": f"{tmp_path}/loyalty.csv", "pos": f"{tmp_path}/pos.csv", "ecommerce": f"{tmp_path}/ec.json"}, out)
    assert report["status"] == "ok" and report["rejected"] == {"crm": 2, "pos": 1}
    assert report["kept"] == {"crm": 1, "loyalty": 1, "pos": 2, "ecommerce": 1}
    # One email joins crm and loyalty, the foreign key joins both POS rows to them.
    assert (report["masters"], report["xrefs"]) == (2, 5)
    assert {c["name"] for c in report["checks"] if not c["passed"]} <= {"null_explosion", "referential_integrity"} and pipeline.read_report(spark, out) == report
    found = pipeline.tables(spark, out)
    tools = serve.Tools(found)
    assert tools.call("preview_table", {"table": "conformed.customer", "where": "1=1; drop table x"})["reason_code"] == "BAD_WHERE"
    assert tools.call("preview_table", {"table": "conformed.customer", "where": "reflect('a','b') = 1"})["reason_code"] == "BAD_WHERE"
    assert tools.call("preview_table", {"table": "conformed.customer", "where": "no_such = 1"})["reason_code"] == "QUERY_FAILED"
    assert [r["_source_id"] for r in tools.call("preview_table", {"table": "conformed.customer", "where": "_source = 'pos'"})["data"]] == ["1:2", "1:3"]
    assert tools.call("preview_table", {"table": "raw.nothing"})["reason_code"] == "TABLE_NOT_FOUND"
    assert "errors" in tools.call("find_record", {"query": "a"}) and tools.call("find_record", {"q": "ann"})["reason_code"] == "BAD_ARGUMENTS"
    assert tools.call("find_record", {"query": "ann", "source": "x"})["reason_code"] == "UNKNOWN_SOURCE"
    assert tools.call("find_record", {"query": "zzz"})["reason_code"] == "NO_MATCH"
    assert [r["_source"] for r in tools.call("find_record", {"query": "ann@"})["data"]["rows"]] == ["crm", "loyalty"]
    assert tools.call("nope")["reason_code"] == "UNKNOWN_TOOL"
    for name, arguments in (
        ("list_sources", {}), ("preview_table", {"table": "raw.crm", "limit": 1}), ("find_record", {"query": "doe"}),
        ("trace_lineage", {"customer_id": "x"}), ("quality_status", {})
    ):
        missing = serve.Tools(None, "/no/where").call(name, arguments)
        assert missing["isError"] and missing["reason_code"] == "WAREHOUSE_MISSING" and missing["expected_path"] == "/no/where"
    schema = serve.Tools(None).call("get_source_schema", {"source": "crm"})["data"]
    assert schema["source"] == "crm" and schema["columns"] and schema["known_issues"] and schema["warehouse_table"] == "raw.crm"
    assert set(tools.call("get_source_schema", {"source": "x"})["known"]) == set(CONTRACTS)
    counts = {r["source"]: r["row_count"] for r in tools.call("list_sources")["data"]}
    assert counts == {"crm": 3, "loyalty": 1, "pos": 3, "ecommerce": 1, "acq_northwind": None, "acq_rheinland": None, "acq_sunset": None}
    lee = next(r[0] for r in found["curated.customer_master"].where("n_sources = 3").select("customer_id").collect())
    trace = tools.call("trace_lineage", {"customer_id": lee})["data"]["trace"]
    assert [c["_source_id"] for c in trace["children"]] == ["c1", "m1", "1:2", "1:3"] and trace["children"][0]["raw"]["_source_file"].endswith("crm.csv")
    status = tools.call("quality_status")["data"]
    assert status["source"] == "curated.quality_status" and status["overall"] == "ALERT"
    derived = serve.Tools({k: v for k, v in found.items() if k != "curated.quality_status"}).call("quality_status")["data"]
    assert derived["overall"] == "ALERT" and [c["status"] for c in derived["checks"]] == ["PASS", "WARN", "PASS"]
    shown = serve.detail(found["curated.customer_master"], found["curated.customer_xref"], found["conformed.customer"], tools._raw(), lee)
    assert shown["status"] == 200 and shown["n_sources"] == 3 and len(shown["contributions"]) == 4 and shown["contributions"][0]["fields"]["mailing_city"] == "Troy"
    assert serve.detail(found["curated.customer_master"], found["curated.customer_xref"], found["conformed.customer"], tools._raw(), "x")["status"] == 404
    assert {c["name"] for c in pipeline.quality_checks(spark, out)} == {c["name"] for c in report["checks"]}
    names = warehouse.create(spark, out, "t_")
    assert "`t_curated`.`customer_master`" in names and warehouse.exists(spark, "t_raw.crm") and not warehouse.exists(spark, "t_raw.zzz")
    assert spark.table("t_curated.customer_xref").count() == 5 and spark.table("t_raw.acq_sunset").count() == 0
    assert warehouse.columns(spark, "t_curated.customer_xref").count() == 5 == warehouse.describe(spark, "t_curated.customer_xref").count()


def test_stewards(spark, tmp_path):
    """A review goes to the queue, is decided, leaves it, and acts in the next run."""
    head = ",".join(CONTRACTS["pos"].columns)
    (tmp_path / "pos.csv").write_text(head + "\n1,LEE ANN,617-555-0101,,1 Main St,Troy,NY,12180,1/2/1980,,10\n2,LEE ANNE,617-555-0102,,1 Main St,Troy,NY,12180,1/2/1980,,20\n")
    out = str(tmp_path / "out")
    settings = Settings(review=0.5)
    paths = {"pos": f"{tmp_path}/pos.csv"}
    assert pipeline.run(spark, paths, out, settings)["reviews"] == 1
    queue = pipeline.open_queue(spark, out).collect()
    assert len(queue) == 1 and queue[0]["left"]["name"] == "ann lee"
    assert pipeline.review_decision(spark, out, "x", "merge")["status"] == 404 and pipeline.review_decision(spark, out, "x", "maybe")["status"] == 400
    assert pipeline.review_decision(spark, out, queue[0]["review_id"], "merge", "same")["status"] == 200
    assert pipeline.open_queue(spark, out).count() == 0
    assert pipeline.review_decision(spark, str(tmp_path / "none"), "x", "merge")["status"] == 503
    second = pipeline.run(spark, paths, out, settings)
    assert (second["masters"], second["reviews"]) == (1, 0)
    found = pipeline.tables(spark, out)
    audit = serve.Tools(found).call("trace_lineage", {"customer_id": found["curated.customer_master"].first()["customer_id"]})["data"]["match_audit"]
    assert [(a["decision"], a["note"]) for a in audit] == [("merge", "same")]


def test_drift_blocks(spark, tmp_path):
    (tmp_path / "loyalty.csv").write_text("member_id,full_name\nm1,Ann Lee\n")
    assert pipeline.run(spark, {"loyalty": f"{tmp_path}/loyalty.csv"}, str(tmp_path / "out"))["status"] == "blocked"


def test_parity(spark):
    import __spark_entry__ as entry
    from parity import compare
    from tessel.plans.catalog import QUERIES

    assert set(QUERIES) <= set(entry.queries())
    for name in QUERIES:
        said = compare(spark, "/root/testdata/sf0.001", name)
        assert not said.startswith("FAIL"), (name, said)


@pytest.fixture
def three_of_each(spark, monkeypatch):
    """Resolved records of which every two of a source wait for a steward."""
    from tessel.plans import catalog_feeds

    keys = ["pos::1:2", "pos::2:3", "pos::31:4", "acq_northwind::NW1", "acq_northwind::NW22", "acq_northwind::NW23"]
    rows = [(k, k, "ann lee", "Lee", "1 Main", k[:3], "12180", None, None, datetime.date(1980, 1, 2)) for k in keys]
    columns = "key string, component string, full_name_normalized string, last_name string, street string, region string, postal_code string, phone_e164 string, email_normalized string, birth_date date"
    records = spark.createDataFrame(rows, columns)
    monkeypatch.setattr(catalog_feeds, "_resolved", lambda spark, d: (records,))
    return catalog_feeds


def test_open_reviews_of_all_sources(spark, three_of_each):
    """Every review that has no decision is open, those of POS records too."""
    pos = {("pos::1", "pos::2"), ("pos::1", "pos::31"), ("pos::2", "pos::31")}
    found = three_of_each.open_reviews_anti_audit(spark, "").collect()
    assert sorted((r["left_key"], r["right_key"]) for r in found) == sorted(pos | {("acq_northwind::NW22", "acq_northwind::NW23")})


def test_stream(spark, tmp_path):
    """Files that arrive are conformed batch by batch; late copies are dropped."""
    columns = ", ".join(f"{c} string" for c in CONTRACTS["loyalty"].columns)
    schema = f"{columns}, _source string, _source_row long, _ingested_at timestamp, _raw_payload string"
    row = lambda i, name, at: (
        f"m{i}", name, "A@x.com", "", "gold", "1", "2020-01-01", "1979-03-14", "s", "1", "loyalty", i, datetime.datetime(2024, 1, 1, at), f"p{i}"
    )
    for rows in ([row(2, "Ann Lee", 1), row(3, "Mickey Mouse", 1)], [row(2, "Ann Lee", 1), row(4, "Bob Roe", 2)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/raw")
        arrivals.conformed_stream(spark, "loyalty", f"{tmp_path}/raw", schema, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination(120)
    assert sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/out/customer").select("_source_id").collect()) == ["m2", "m4"]
    assert [r[0] for r in spark.read.parquet(f"{tmp_path}/out/_reject").select("_source_id").collect()] == ["m3"]
