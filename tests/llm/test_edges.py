"""Every operator and stage on nulls in any column, empty and very long texts,
ties, repeated rows, empty tables and extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessel.llm import chat, decontaminate, embedding_pairs, licenses, lines, neardup, packing, quality, queries, secrets, toxicity

SF = "/root/testdata/sf0.001"
#: Names that operators use for working columns, or that they return.
CLASHING = ("_id _key _text _lines _removed _salt _rank _toxicity _ids gone gone_id gone_key row score words text_key salt rank node comp h g p m fp fps f d bad item_id toxic quality "
            "ids lines parts leave passages matches spans base x unit n n_hit n_words kept held_out predicted piece start length ids_crc32 hash grp one copies dice y key table count block").split()  # fmt: skip
LONG = " ".join(f"w{i % 977}" for i in range(60_000)) + "\n" + "z" * 300_000 + "\ntoken = " + "aB3" * 40_000
TEXT = " ".join(f"t{i}" for i in range(70))
ROWS = [
    (1, TEXT, "en", "s1", 5), (1, TEXT, "en", "s1", 5), (2, TEXT, None, None, None), (None, TEXT, None, "s2", None), (None, None, None, None, None), (None, None, None, None, None),
    (3, "", "en", "s1", 0), (3, "", "de", "s2", 0), (4, " \n\n ", "en", "s1", 4), (5, LONG, "en", "s3", 1), (6, None, "en", "s1", None), (7, "é ß 日本 🙂\x00 ", "en", "s1", 9), (8, "short", "en", "s1", 5),
    (8, TEXT.replace("t33 ", "u "), "en", "s1", 5),
]


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def wide(plain):
    taken = {c.lower() for c in plain.columns}
    return plain.select("*", *[F.lit(i).alias(c) for i, c in enumerate(dict.fromkeys(CLASHING)) if c not in taken])


def labels(spark):
    """Labels with nulls, unknown values and a doc_id labelled twice."""
    odd = spark.createDataFrame([(None, 1, 1), (1, None, None), (1, 1, 0), (1, 0, 1), (8, 7, -1)], "doc_id long, quality int, toxic int")
    return spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).unionByName(odd)


def items(spark):
    return spark.createDataFrame([(1, " ".join(f"T{i}" for i in range(20, 40))), (1, None), (None, "short"), (2, ""), (3, "short"), (3, "short")], "item_id long, text string")


OPERATORS = {
    "op1": lambda s, docs: decontaminate.contaminated_words(docs, items(s)).select("doc_id", "n_words", "n_hit", "items"),
    "op2": lambda s, docs: licenses.scan_licenses(docs),
    "op4": lambda s, docs: quality.quality(docs, labels(s)),
    "op5": lambda s, docs: lines.dedup_lines(docs, 2).select("row.doc_id", "text", "n_lines", "n_removed"),
    "op6": lambda s, docs: packing.pack_documents(docs, queries.tokenizer_path()).where("piece = 0").select("doc_id", "start", "length", "ids_crc32"),
    "op7": lambda s, docs: secrets.find_secrets(docs),
    "op8": lambda s, docs: toxicity.toxicity(docs, labels(s)),
    "op10": lambda s, docs: neardup.near_duplicates(docs),
}


def told(df):
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, plain, wide, name):
    got = told(OPERATORS[name](spark, wide))
    assert len(got) == len(ROWS)
    assert got == told(OPERATORS[name](spark, plain))
    assert OPERATORS[name](spark, wide.limit(0)).count() == 0
    assert got[0].keys() == told(OPERATORS[name](spark, plain.limit(1)))[0].keys()


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stage(spark, wide, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    out = run(spark, wide, SF)
    if stage != "packing":
        assert out.columns == wide.columns
        left = out.select("doc_id", "text", "source").collect()
        want = {"toxicity": 14, "line dedup": 14, "near-duplicates": 10, "decontamination": 14}[stage]
        assert len(left) == want
        assert run(spark, wide.limit(0), SF).columns == wide.columns
    assert run(spark, wide.limit(0), SF).count() == 0


def test_no_labels(spark, plain):
    """Without labels of both classes every score is the same."""
    none = labels(spark).limit(0)
    for out in (quality.quality(plain, none), toxicity.toxicity(plain, none)):
        assert len({r["score"] for r in out.collect()}) == 1


def test_pack_keeps_columns(spark, plain):
    pieces = packing.token_pieces(plain, queries.tokenizer_path()).select("*", F.lit(7).alias("salt"), F.lit(8).alias("rank"), F.lit(9).alias("_salt"), F.lit(1).alias("offset"))
    out = packing.pack(pieces)
    assert {c: out.where(f"`{c}` != {v}").count() for c, v in (("salt", 7), ("rank", 8), ("_salt", 9))} == {"salt": 0, "rank": 0, "_salt": 0}
    assert out.columns == [*pieces.drop("offset").columns, "sequence_id", "offset"]


def test_vectors(spark):
    v = [1.0, 0.5] * 8
    rows = [
        (1, v, 0), (1, v, 0), (None, v, 0), (None, None, 0), (None, [], 0), (2, [0.0] * 16, None), (3, [1e-300] * 16, 1), (4, [1e300] * 16, 1),
        (5, [float("inf")] * 16, 1), (6, [None] * 16, 1), (7, [1.0], 1), (8, [2.0], 1)
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    wide = df.select("*", *[F.lit(0).alias(c) for c in ("unit", "node", "weight", "id", "grp", "gap", "hash", "side", "pa", "pb", "root", "links", "peer")])
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_pairs.near_vectors(wide).collect()]
    same = [(1, 4, 1, True), (1, 4, 1, True), (None, 4, 1, False), (3, 4, 1, False), (4, 4, 1, False)]
    assert abs(sum(a * b for a, b in zip(v, [1.0] * 16)) / (sum(a * a for a in v) ** 0.5 * 4) - 0.9487) < 1e-3
    assert sorted(got, key=str) == sorted(
        [*same, (None, 0, None, True), (None, 0, None, True), (2, 0, 2, True), (5, 0, 5, True), (6, 0, 6, True), (7, 1, 7, True), (8, 1, 7, False)],
        key=str
    )
    assert embedding_pairs.near_vectors(wide.limit(0)).count() == 0


def test_chats(spark):
    long = "x\\" * 200_000 + "<|end|>" * 1000 + "<" * 1000
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, None, None, None), (2, 5, "assistant", ""), (2, 4, "assistant", long), (3, 0, "a\nb\\", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    wide = df.select("*", *[F.lit(0).alias(c) for c in ("formatted", "n_turns", "loss_start", "loss_end", "id")])
    got = {r["conv_id"]: (r["n_turns"], chat.read_back(r["formatted"])) for r in chat.format_chats(wide).collect()}
    assert got == {1: (3, [("", ""), ("user", "a"), ("user", "a")]), None: (1, [("", "")]), 2: (2, [("assistant", long), ("assistant", "")]), 3: (1, [("a\nb\\", "")])}
    assert chat.format_chats(wide.limit(0)).count() == 0
