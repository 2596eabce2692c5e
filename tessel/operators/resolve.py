"""Entity resolution: edges, blocked and scored pairs, components, survivors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessel.contracts import CONTRACTS, Settings
from tessel.functions import text as t
from tessel.operators import pairs
from tessel.operators.components import connected_components
from tessel.operators.conform import real_key
from tessel.storage import written


def record_key(source: str = "_source", source_id: str = "_source_id") -> Column:
    return F.concat_ws("::", source, source_id)


def star_edges(records: DataFrame, node: str, *key: str) -> DataFrame:
    """Edges from every record to the smallest one with the same key: as many
    as there are records, whatever the size of a group.  The minima combine
    before the shuffle; adaptive execution splits a hot key's join."""
    held = records.where(" and ".join(f"`{k}` is not null" for k in key))
    least = held.groupBy(*key).agg(F.min(node).alias("dst"))
    return held.join(least, list(key)).where(F.col(node) != F.col("dst")).select(F.col(node).alias("src"), "dst")


def foreign_edges(loyalty: DataFrame, customers: DataFrame) -> DataFrame:
    """Edges from loyalty members (rejected ones too) to the POS rows they name."""
    pos = customers.where("_source = 'pos'").select(record_key().alias("dst"), F.split("_source_id", ":", 2)[0].alias("fk"))
    members = loyalty.where(real_key(F.col("pos_customer_id"))).select(
        F.concat(
            F.lit("loyalty::"), F.coalesce(t.nonempty(F.col("member_id")), F.concat(F.lit("LY-row-"), F.col("_source_row").cast("string")))
        ).alias("src"),
        F.trim("pos_customer_id").alias("fk")
    )
    return members.join(pos, "fk").select("src", "dst")


#: Records of a block that one task pairs with the whole block, in expectation.
BLOCK = 1024


def blocked_pairs(records: DataFrame, node: str, block: list[str], component: str) -> DataFrame:
    """Pairs (l, r) of the same block and different components, l before r; an
    equi-join whose residual conditions drop connected pairs.  The records of a
    block are dealt to parts, each of which meets the whole block, so a hot
    block is many tasks' work."""
    sizes = records.groupBy(*block).agg(F.count("*").alias("n")).where("n > 1")
    rows = records.select(*block, F.struct(*records.columns).alias("x")).join(sizes, block).withColumn("parts", F.ceil(F.col("n") / BLOCK))
    left = rows.select(*block, F.pmod(F.xxhash64(f"x.{node}"), "parts").alias("part"), F.col("x").alias("l"))
    right = rows.select(*block, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("x").alias("r"))
    return left.join(right, [*block, "part"]).where((F.col(f"l.{node}") < F.col(f"r.{node}")) & (F.col(f"l.{component}") != F.col(f"r.{component}"))).select("l", "r")


def features(l: str = "l", r: str = "r") -> dict[str, Column]:
    a, b = (lambda c: F.col(f"{l}.{c}")), (lambda c: F.col(f"{r}.{c}"))
    same = lambda c: F.coalesce((a(c) == b(c)) & (a(c) != ""), F.lit(False))
    ratio = lambda x, y: F.coalesce(t.token_set_ratio(x, y), F.lit(0.0))
    street = ratio(F.lower(a("street")), F.lower(b("street")))
    domain = lambda c: F.substring_index(c, "@", -1)
    return {
        "name": ratio(a("full_name_normalized"), b("full_name_normalized")),
        "address": F.when(same("postal_code") & a("street").isNotNull() & b("street").isNotNull(), F.least(F.lit(1.0), street + 0.1)).otherwise(street),
        "phone": F.when(same("phone_e164"), 1.0).otherwise(0.0),
        "email": F.when(same("email_normalized"), 1.0).when(F.coalesce(domain(a("email_normalized")) == domain(b("email_normalized")), F.lit(False)), 0.1).otherwise(0.0),
        "dob": F.when(F.coalesce(a("birth_date") == b("birth_date"), F.lit(False)), 1.0).when(
            F.coalesce(F.year(a("birth_date")) == F.year(b("birth_date")), F.lit(False)), 0.5
        ).otherwise(0.0),
    }


def pair_score(f: dict[str, Column], settings: Settings) -> Column:
    """The weighted sum; an equal phone or email with a like name scores 0.92
    at least, both 0.98."""
    total = sum((F.lit(w) * f[k] for k, w in settings.weights.items()), F.lit(0.0))
    phone, email = f["phone"] == 1.0, f["email"] == 1.0
    total = F.when((phone | email) & (f["name"] >= 0.6), F.greatest(total, F.lit(0.92))).otherwise(total)
    return F.when(phone & email, F.greatest(total, F.lit(0.98))).otherwise(total)


def band(score: Column, settings: Settings) -> Column:
    return F.when(score >= settings.auto_merge, "auto").when(score >= settings.review, "review").otherwise("drop")


def labelled(records: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """Adds ``component``; records without edges are their own."""
    found = connected_components(edges).withColumnsRenamed({"node": node, "root": "component"})
    return records.join(found, node, "left").withColumn("component", F.coalesce("component", node))


def resolve(customers: DataFrame, loyalty: DataFrame | None, settings: Settings, decisions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records with ``key`` and ``component``, review pairs).  Steward
    decisions (left_key, right_key, decision) act: merge links, keep_separate
    keeps a fuzzy pair from linking and from the queue."""
    records = customers.withColumn("key", record_key())
    edges = star_edges(records, "key", "email_normalized").unionByName(star_edges(records, "key", "phone_e164"))
    if loyalty is not None:
        edges = edges.unionByName(foreign_edges(loyalty, customers))
    if decisions is not None:
        edges = edges.unionByName(decisions.where("decision = 'merge'").select(F.col("left_key").alias("src"), F.col("right_key").alias("dst")))
    first = labelled(records, edges, "key")
    final = first
    if pairs.most_apart(settings) >= settings.auto_merge:  # else no pair of unlinked records can merge by its score
        auto = pairs.scored(in_blocks(first), "key", BLOCKS, "component", settings, _shown(settings.auto_merge, np.inf, None), "left_key string, right_key string, score double", settings.auto_merge)
        auto = written(_undecided(auto, decisions).select(F.col("left_key").alias("src"), F.col("right_key").alias("dst")), "auto")
        final = first if auto.isEmpty() else labelled(records, edges.unionByName(auto), "key")
    found = reviews(final, settings, decisions)
    return final, found.select(review_id(), "left_key", "right_key", "score", "features")


def review_id() -> Column:
    return t.uuid5(F.concat(F.lit("review:"), "left_key", F.lit("|"), "right_key")).alias("review_id")


#: Columns of ``in_blocks`` whose records are compared.
BLOCKS = ["b_letter", "b_region", "b_year"]


def in_blocks(records: DataFrame) -> DataFrame:
    """The records that have a surname, a region and a date of birth, with BLOCKS."""
    wide = records.where("last_name is not null and region is not null and birth_date is not null")
    return wide.withColumn("b_letter", F.lower(F.substring("last_name", 1, 1))).withColumn("b_region", F.upper("region")).withColumn("b_year", F.year("birth_date"))


def _undecided(found: DataFrame, decisions: DataFrame | None) -> DataFrame:
    if decisions is None:
        return found
    return found.join(decisions.where("decision = 'keep_separate'").select("left_key", "right_key"), ["left_key", "right_key"], "left_anti")


def _shown(least: float, below: float, features: tuple[str, ...] | None, keep: pairs.Keep | None = None) -> Callable[[pairs.Strip], pa.RecordBatch]:
    def show(strip: pairs.Strip) -> pa.RecordBatch:
        chosen = (strip.score >= least) & (strip.score < below)
        if keep is not None:
            chosen &= keep(strip.nodes).to_numpy(zero_copy_only=False)[strip.left]
        strip = (strip if features else strip.bare()).where(chosen)
        columns = dict(zip(("left_key", "right_key"), strip.keys())) | {"score": pa.array(strip.score)}
        if features:
            columns["features"] = pa.StructArray.from_arrays([pa.array(strip.features[k]) for k in features], names=list(features))
        return pa.RecordBatch.from_pydict(columns)

    return show


def reviews(records: DataFrame, settings: Settings, decisions: DataFrame | None = None, features: tuple[str, ...] = pairs.FEATURES, keep: pairs.Keep | None = None) -> DataFrame:
    """left_key, right_key, score and, if any, features of the pairs of resolved
    records that wait for a steward: not of one customer already, which spares
    those that later merges brought together.  ``keep`` chooses left keys."""
    kind = f", features struct<{', '.join(f'{k}: double' for k in features)}>" if features else ""
    found = pairs.scored(in_blocks(records), "key", BLOCKS, "component", settings, _shown(settings.review, settings.auto_merge, features, keep), f"left_key string, right_key string, score double{kind}", settings.review)
    return _undecided(found, decisions)


def review_lists(records: DataFrame, settings: Settings, keep: pairs.Keep) -> DataFrame:
    """left_key, right_keys of the reviews whose left keys ``keep`` chooses, as
    ``pairs.scored`` takes them: a row a left key and strip, for what would be
    too many rows a pair."""

    def show(strip: pairs.Strip) -> pa.RecordBatch:
        chosen = strip.once("chosen", lambda nodes: keep(nodes).to_numpy(zero_copy_only=False))
        strip = strip.bare().where((strip.score >= settings.review) & (strip.score < settings.auto_merge) & chosen[strip.left])
        order = np.argsort(strip.left, kind="stable")
        left, begins = np.unique(strip.left[order], return_index=True)
        lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(order)).astype(np.int32)), strip.nodes.take(pa.array(strip.right[order])))
        return pa.RecordBatch.from_pydict({"left_key": strip.nodes.take(pa.array(left)), "right_keys": lists})

    return pairs.scored(in_blocks(records), "key", BLOCKS, "component", settings, show, "left_key string, right_keys array<string>", settings.review, keep)


RANKED = ("city", "region", "postal_code", "country", "birth_date", "created_at_utc", "email_normalized", "phone_e164", "full_name_normalized")
LONGEST = ("first_name", "last_name", "street")


def survivors(records: DataFrame, group: str, ranked: tuple[str, ...], longest: tuple[str, ...], rank: Column, order: list[str], untold: tuple[str, ...] = ()) -> DataFrame:
    """Per group and field: value, source and confidence of the survivor.
    ``ranked`` fields take the best rank, ``longest`` the longest value and then
    the best rank; ties go to the first in ``order``.  Fields in ``untold`` have
    no confidence, which spares their distinct counts.  One aggregation."""
    aggs = []
    for name in (*ranked, *longest):
        c = F.col(name)
        there = c.isNotNull() & (c.cast("string") != "")
        size = F.length(c.cast("string")) if name in longest else F.lit(0)
        best = F.struct(size.alias("n"), rank.alias("rank"), *[(-F.col(o)).alias(o) for o in order])
        pick = F.max_by(F.when(there, F.struct(c.alias("value"), F.col("_source").alias("source"))), F.when(there, best))
        aggs.append(pick.alias(name))
        if name in untold:
            continue
        distinct = F.count_distinct(F.when(there, c.cast("string")))
        aggs += [F.when(distinct == 0, 0.0).when(distinct == 1, 1.0).otherwise(F.greatest(F.lit(0.5), 1.0 - 0.1 * (distinct - 1))).alias(f"{name}_confidence")]
    return records.groupBy(group).agg(*aggs, F.count_distinct("_source").cast("int").alias("n_sources"), F.count("*").alias("n_records"))


def customer_id(email: Column, phone: Column, names: Column, dates: Column, keys: Column) -> Column:
    """Stable id from the best evidence there is; names and dates alone could
    collide, so the keys are part of that form."""
    namedob = F.when(
        (F.size(names) > 0) & (F.size(dates) > 0),
        F.concat(F.lit("namedob:"), F.array_join(names, "|"), F.lit("|"), F.array_join(dates, "|"), F.lit("|"), F.array_join(keys, "|"))
    )
    return t.uuid5(F.coalesce(F.concat(F.lit("email:"), email), F.concat(F.lit("phone:"), phone), namedob, F.concat(F.lit("keys:"), F.array_join(keys, "|"))))


def golden(records: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(masters, crosswalk) of records with ``key`` and ``component``."""
    ranks = F.create_map(*[F.lit(x) for pair in settings.ranks.items() for x in pair])
    loads = F.create_map(*[F.lit(x) for i, k in enumerate(CONTRACTS) for x in (k, i)])
    rows = records.withColumn("_load", F.coalesce(loads[F.col("_source")], F.lit(99)))
    best = survivors(
        rows, "component", RANKED, LONGEST, F.coalesce(ranks[F.col("_source")], F.lit(0)), ["_load", "_source_row"],
        ("city", "region", "postal_code", "country", "created_at_utc")
    )
    # Names, dates and keys matter only where no record has an address or a number, which no large cluster lacks.
    bare = lambda c: F.array_sort(F.collect_set(F.when(F.col("email_normalized").isNull() & F.col("phone_e164").isNull(), c)))
    ids = rows.groupBy("component").agg(
        F.min("email_normalized").alias("e"), F.min("phone_e164").alias("p"), bare(F.col("full_name_normalized")).alias("names"),
        bare(F.col("birth_date").cast("string")).alias("dates"), bare(F.col("key")).alias("keys")
    )
    ids = ids.select("component", customer_id(F.col("e"), F.col("p"), F.col("names"), F.col("dates"), F.col("keys")).alias("customer_id"))
    v = lambda c: F.col(f"{c}.value")
    told = [F.when(F.col(f"{c}_confidence") > 0, F.col(f"{c}_confidence")) for c in ("first_name", "last_name", "email_normalized", "phone_e164", "birth_date")]
    record = F.coalesce(F.array_min(F.array_compact(F.array(*told))), F.lit(0.5))
    full = F.coalesce(F.nullif(F.concat_ws(" ", v("first_name"), v("last_name")), F.lit("")), v("full_name_normalized"))
    out = best.join(ids, "component").select(
        "component", "customer_id", full.alias("full_name"), F.col("full_name_normalized.source").alias("full_name_source"), F.col("full_name_normalized_confidence").alias("full_name_confidence"),
        *[x for c in ("first_name", "last_name", "birth_date") for x in (v(c).alias(c), F.col(f"{c}.source").alias(f"{c}_source"), F.col(f"{c}_confidence"))],
        t.pii_hash(v("email_normalized"), settings.pepper).alias("email_hash"), F.col("email_normalized.source").alias("email_source"), F.col("email_normalized_confidence").alias("email_confidence"),
        t.pii_hash(v("phone_e164"), settings.pepper).alias("phone_hash"), F.col("phone_e164.source").alias("phone_source"), F.col("phone_e164_confidence").alias("phone_confidence"),
        t.street_token(v("street"), settings.pepper).alias("street_token"), F.col("street.source").alias("street_source"), F.col("street_confidence"),
        *[x for c in ("city", "region", "postal_code", "country") for x in (v(c).alias(c), F.col(f"{c}.source").alias(f"{c}_source"))],
        record.alias("record_confidence"), "n_sources", "n_records", v("created_at_utc").alias("created_at_utc"),
    )
    xref = rows.join(out.select("component", "customer_id", "n_records", "record_confidence"), "component")
    method = F.when(F.col("n_records") > 1, "deterministic").otherwise("singleton")
    return out.drop("component", "n_records"), xref.select("customer_id", "_source", "_source_id", method.alias("match_method"), F.col("record_confidence").alias("match_score"))


def evaluate(pairs: DataFrame, xref: DataFrame) -> DataFrame:
    """Confusion counts and rates by difficulty and over all (null) of labelled
    pairs (left_source, left_id, right_source, right_id, verdict, difficulty)."""
    side = lambda k: xref.select(F.col("_source").alias(f"{k}_source"), F.col("_source_id").alias(f"{k}_id"), F.col("customer_id").alias(f"{k}_customer"))
    known = pairs.where("verdict in ('match', 'no_match')").join(side("left"), ["left_source", "left_id"], "left").join(side("right"), ["right_source", "right_id"], "left")
    return confusion(
        known.select(
            "difficulty", (F.col("verdict") == "match").alias("truth"),
            F.coalesce(F.col("left_customer") == F.col("right_customer"), F.lit(False)).alias("said")
        )
    )


def confusion(df: DataFrame) -> DataFrame:
    counts = df.rollup("difficulty").agg(
        F.count_if(F.expr("truth and said")).alias("tp"), F.count_if(F.expr("not truth and said")).alias("fp"),
        F.count_if(F.expr("truth and not said")).alias("fn"), F.count_if(F.expr("not truth and not said")).alias("tn")
    )
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b))
    return counts.select("*", rate("tp", "fp").alias("precision"), rate("tp", "fn").alias("recall"), rate("fp", "tp").alias("false_confidence"))
