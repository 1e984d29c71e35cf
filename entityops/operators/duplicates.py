"""Duplicate search: names alike by an exact set-similarity join, united with equal tax numbers and addresses."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityops import constants as C
from entityops.functions import text as T
from entityops.functions.ordering import top_rows
from entityops.session import materialise

#: Fields that agree or do not, in the order of their bits.
PINNED = ("country", "postal", "street", "city")
WEIGHT_OF = {"country": "country", "postal": "postalCode", "street": "street", "city": "city", "tax": "tax", "name": "tradingName"}
PROFILES_PER_PART = 5_000
SCORES = ("name_score", "tax_score", "street_score", "city_score", "postal_score", "country_score")


def meet(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that sorts both sides. Sizes estimated from well packed files are far too small, and a table with a row
    for every record must not be broadcast."""
    return left.join(right.hint("merge"), on, how)


def token_pair_keys(names: DataFrame, min_jaccard: float) -> DataFrame:
    """(nid, size, key, i, j, smaller): hashes of two tokens that a name shares with every name alike.

    names: nid, tokens (distinct). Tokens are ordered by how rare they are. Two names that must share o >= 2 tokens share two of
    the first size - o + 2 in that order; ``i`` and ``j`` are their places. The larger name of a pair must share its part of
    ``min_jaccard``, the smaller one more, so that fewer of its keys (``smaller``) are enough.
    """
    tokens = names.select("nid", F.size("tokens").alias("size"), F.explode("tokens").alias("token")).where("size > 1")
    frequency = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("_freq"))
    ordered = meet(tokens, frequency, "token").groupBy("nid", "size").agg(F.array_sort(F.collect_list(F.struct("_freq", "token"))).alias("_rare"))
    least = F.greatest(F.lit(2), F.ceil(F.col("size") * min_jaccard - 1e-9))
    first = ordered.select("nid", "size", F.slice("_rare", F.lit(1), (F.col("size") - least + 2).cast("int")).alias("_rare"))
    at = F.sequence(F.lit(0), F.size("_rare") - 1)
    pairs = F.flatten(
        F.transform(
            at,
            lambda i: F.transform(
                F.filter(at, lambda j: j > i),
                lambda j: F.struct(F.xxhash64(F.get("_rare", i)["token"], F.get("_rare", j)["token"]).alias("key"), i.alias("i"), j.alias("j")),
            ),
        )
    )
    must = F.greatest(F.lit(2), F.ceil(F.col("size") * (2 * min_jaccard / (1 + min_jaccard)) - 1e-9))
    return first.select("nid", "size", F.explode(pairs).alias("_p")).select("nid", "size", "_p.*", (F.col("_p.j") < F.col("size") - must + 2).alias("smaller"))


def compared_names(names: DataFrame, min_jaccard: float) -> DataFrame:
    """(a, b), a < b: names that the filters leave to be compared; holds every pair with ``min_jaccard`` or more.

    A pair of names with a common key can be alike only if their sizes allow it and enough tokens can still be common before,
    between and after the two places. Names of so few tokens that one common token is enough meet on that token and both
    sizes, so that only pairs meet which are alike.
    """
    keys = token_pair_keys(names, min_jaccard)
    a = keys.where("smaller").select(F.col("nid").alias("a"), F.col("size").alias("s"), "key", F.col("i").alias("ai"), F.col("j").alias("aj"))
    b = keys.select(F.col("nid").alias("b"), F.col("size").alias("z"), "key", F.col("i").alias("bi"), F.col("j").alias("bj"))
    share = min_jaccard / (1 + min_jaccard)
    needed = F.ceil((F.col("s") + F.col("z")) * share - 1e-9)
    within = F.least("ai", "bi") + F.least(F.col("aj") - F.col("ai"), F.col("bj") - F.col("bi")) + F.least(F.col("s") - F.col("aj"), F.col("z") - F.col("bj"))
    larger = (F.col("s") < F.col("z")) | ((F.col("s") == F.col("z")) & (F.col("a") < F.col("b")))
    near = larger & (F.col("s") >= F.col("z") * min_jaccard - 1e-9) & (within >= needed)
    met = meet(a, b, "key").where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    most = math.floor(1 / share + 1e-9)  # sizes up to this sum need one common token
    short = names.select("nid", F.size("tokens").alias("size"), F.explode("tokens").alias("token")).where(F.col("size") < most)
    left = short.select(F.col("nid").alias("a"), "token", F.col("size").alias("s"), F.explode(F.sequence(F.col("size"), F.lit(most) - F.col("size"))).alias("z")).where(F.col("s") <= most / 2)
    right = short.select(F.col("nid").alias("b"), "token", F.col("size").alias("z"))
    few = meet(left, right, ["token", "z"]).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return met.union(few).distinct()


def similar_names(names: DataFrame, min_jaccard: float) -> DataFrame:
    """(a, b, name_score): each name with itself and, both ways round, with every name of ``min_jaccard`` or more common tokens."""
    sets = names.select("nid", "tokens")
    compared = meet(compared_names(names, min_jaccard), sets.select(F.col("nid").alias("a"), F.col("tokens").alias("_ta")), "a")
    pairs = (
        meet(compared, sets.select(F.col("nid").alias("b"), F.col("tokens").alias("_tb")), "b")
        .withColumn("_share", F.size(F.array_intersect("_ta", "_tb")) / F.size(F.array_union("_ta", "_tb")))
        .where(F.col("_share") >= min_jaccard)
        .select("a", "b", F.rint(F.col("_share") * 100).cast("int").alias("name_score"))
    )
    both = F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    turned = pairs.select(both.alias("_p"), "name_score").select("_p.*", "name_score")
    return turned.unionByName(names.select(F.col("nid").alias("a"), F.col("nid").alias("b"), F.lit(100).alias("name_score")))


def _profiles(request: DataFrame, taxes: DataFrame) -> DataFrame:
    """(record_id, name, country, postal, street, city, tax): comparable fields, empty where unknown; tax numbers sorted."""
    numbers = taxes.select("record_id", T.norm_id(F.col("number")).alias("_n")).where("_n <> ''").groupBy("record_id").agg(F.sort_array(F.collect_set("_n")).alias("tax"))
    words = {"name": "name", "street": "street", "city": "city"}
    ids = {"country": "country", "postal": "postal_code"}
    fields = [T.norm_words(F.col(c).cast("string")).alias(k) for k, c in words.items()] + [T.norm_id(F.col(c).cast("string")).alias(k) for k, c in ids.items()]
    return meet(request.select("record_id", *fields), numbers, "record_id", "left").withColumn("tax", F.coalesce("tax", F.array().cast("array<string>")))


def _group(channel: str, *values: str) -> Column:
    return F.xxhash64(F.lit(channel), *values)


def _earned(name_points: Column, agreed: Column, tax: Column) -> Column:
    """Score of a record that agrees with ``x`` in the fields of the mask ``agreed``, perhaps in a tax number, and has no more in common."""
    weight = F.when(F.col("name") != "", C.FIELD_WEIGHTS[WEIGHT_OF["name"]]).otherwise(0) + F.when(F.size("tax") > 0, C.FIELD_WEIGHTS[WEIGHT_OF["tax"]]).otherwise(0)
    total = name_points * C.FIELD_WEIGHTS[WEIGHT_OF["name"]] + F.when(tax, 100 * C.FIELD_WEIGHTS[WEIGHT_OF["tax"]]).otherwise(0)
    for k, c in enumerate(PINNED):
        weight = weight + F.when(F.col(c) != "", C.FIELD_WEIGHTS[WEIGHT_OF[c]]).otherwise(0)
        total = total + F.when(agreed.bitwiseAND(1 << k) != 0, 100 * C.FIELD_WEIGHTS[WEIGHT_OF[c]]).otherwise(0)
    return F.rint(total / weight).cast("int")


def _pins(rows: DataFrame, least: Column | None = None) -> DataFrame:
    """A row of a large group once for each set of fields that might agree, with the hash of their values in ``_pin``.

    The fields that make the group agree anyway: streets and cities in groups of one address, tax numbers in groups of one.
    ``_earned`` is the score of a member that agrees in these fields and in no others; sets that earn less than ``least`` are left out.
    """
    bits = {c: 1 << k for k, c in enumerate(PINNED)}
    address = bits["street"] | bits["city"]
    every = F.explode(F.sequence(F.lit(0), F.lit((1 << len(PINNED)) - 1))).alias("_mask")
    number = F.explode(F.when(F.col("channel") == "tax", F.array(F.lit(""))).otherwise(F.array_union(F.array(F.lit("")), F.col("tax")))).alias("_number")
    wide = rows.select("*", number).select("*", every)
    for c, bit in bits.items():
        wide = wide.where((F.col("_mask").bitwiseAND(bit) == 0) | (F.col(c) != ""))
    wide = wide.where((F.col("channel") != "address") | (F.col("_mask").bitwiseAND(address) == 0))
    agreed = F.when(F.col("channel") == "address", F.col("_mask").bitwiseOR(address)).otherwise(F.col("_mask"))
    wide = wide.withColumn("_earned", _earned(F.col("name_points"), agreed, (F.col("channel") == "tax") | (F.col("_number") != "")))
    if least is not None:
        wide = wide.where(F.col("_earned") >= least)
    pinned = [F.when(F.col("_mask").bitwiseAND(bit) != 0, F.col(c)).otherwise("") for c, bit in bits.items()]
    return wide.withColumn("_pin", F.xxhash64("group", "_mask", "_number", *pinned)).drop("_mask", "_number")


def search_duplicates(request: DataFrame, taxes: DataFrame, min_jaccard: float = 0.5, top: int = 5, small_group: int = 64) -> DataFrame:
    """The ``top`` best other records of each record, exact for groups of any size.

    request and taxes as ``blocking_request`` gives them. Candidates are records whose names are alike, that have a common tax
    number, or the same street and city. Every field that the searching record has counts with its weight: the name with its
    share of common tokens if names are alike, else 0; others with 100 if they agree (any common tax number), else 0. Equal
    scores are ordered by id.

    Equal records are one profile, of which ``top + 1`` ids are enough. A profile meets all members of small groups. Of large
    groups (a hot name, a tax number or an address that many share) it meets the first ids for each set of fields that agree
    with it: a member that is not among them has ``top + 1`` others before it which agree in those fields or more.
    Once ``top + 1`` members of its own groups are sure of a score, sets of fields and groups that earn less are not asked.
    """
    fields = ["name", *PINNED, "tax"]
    rows = _profiles(request, taxes)
    signs = rows.groupBy(*fields).agg(F.min("record_id").alias("pid"))
    name_ids = signs.groupBy("name").agg(F.min("pid").alias("nid")).where("name <> ''")
    profiles = materialise(meet(signs, name_ids, "name", "left"))
    parts = max(-(-profiles.count() // PROFILES_PER_PART), int(profiles.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    of = materialise(meet(rows, profiles.select("pid", *fields), fields).select("record_id", "pid"))
    alike = materialise(similar_names(name_ids.select("nid", F.array_distinct(F.split("name", " ")).alias("tokens")), min_jaccard))

    def member(rows: DataFrame, channel: str, group: Column, points: Column) -> DataFrame:
        return rows.select(*profiles.columns, F.lit(channel).alias("channel"), group.alias("group"), points.alias("name_points"))

    named = member(profiles.where("nid IS NOT NULL"), "name", _group("name", "nid"), F.lit(100))
    taxed = member(profiles.select("*", F.explode("tax").alias("_n")), "tax", _group("tax", "_n"), F.lit(0))
    placed = member(profiles.where("street <> '' AND city <> ''"), "address", _group("address", "street", "city"), F.lit(0))
    members = reduce(DataFrame.unionByName, [named, taxed, placed])
    seeking = member(meet(profiles, alike.select(F.col("a").alias("nid"), F.col("b").alias("_b"), "name_score"), "nid"), "name", _group("name", "_b"), F.col("name_score"))
    asking = reduce(DataFrame.unionByName, [seeking, taxed, placed])

    first_ids = top_rows(of, ["pid"], [F.col("record_id")], top + 1, "_n").select("pid", F.col("record_id").alias("candidate_id"))
    sizes = meet(members.select("pid", "group"), first_ids.groupBy("pid").agg(F.count(F.lit(1)).alias("_ids")), "pid").groupBy("group").agg(F.sum("_ids").alias("_members"))
    large = materialise(sizes.where(F.col("_members") > small_group).select("group"))
    own_pins = _pins(meet(members, large, "group", "left_semi")).select("pid", "_pin", "_earned")
    heads = materialise(top_rows(meet(own_pins, first_ids, "pid"), ["_pin"], [F.col("candidate_id")], top + 1, "_n").select("_pin", "candidate_id", "_n"))
    # a score of which top + 1 members of an own group are sure
    sure = meet(own_pins, heads.where(F.col("_n") == top + 1).select("_pin"), "_pin", "left_semi").groupBy("pid").agg(F.max("_earned").alias("_sure"))
    least = F.coalesce("_sure", F.lit(0))
    every = F.lit((1 << len(PINNED)) - 1)
    known = sum((F.when(F.col(c) != "", 1 << k).otherwise(0) for k, c in enumerate(PINNED)), F.lit(0)).bitwiseAND(every)
    asked = meet(asking, sure, "pid", "left").where(_earned(F.col("name_points"), known, F.size("tax") > 0) >= least)
    few = meet(members, large, "group", "left_anti").select("pid", "group")
    few = meet(few, first_ids, "pid").select("group", "candidate_id")
    direct = meet(asked.select(F.col("pid").alias("_asked"), "group").repartition(parts, "group"), few.repartition(parts, "group"), "group").select("_asked", "candidate_id")
    pins = _pins(meet(asked, large, "group", "left_semi"), least).select(F.col("pid").alias("_asked"), "_pin")
    pinned = meet(pins.repartition(parts, "_pin"), heads.select("_pin", "candidate_id").repartition(parts, "_pin"), "_pin").select("_asked", "candidate_id")
    met = direct.union(pinned).distinct()

    mine = profiles.select(F.col("pid").alias("_asked"), F.struct(*fields, "nid").alias("x"))
    theirs = meet(of, profiles, "pid").select(F.col("record_id").alias("candidate_id"), F.struct(*fields, "nid").alias("y"))
    pairs = meet(meet(met, mine, "_asked"), theirs, "candidate_id")
    pairs = meet(pairs, alike, (F.col("x.nid") == F.col("a")) & (F.col("y.nid") == F.col("b")), "left")
    known = {c: F.col(f"x.{c}") != "" for c in ("name", *PINNED)} | {"tax": F.size("x.tax") > 0}
    agrees = {c: (F.col(f"x.{c}") == F.col(f"y.{c}")) for c in PINNED} | {"tax": F.arrays_overlap("x.tax", "y.tax")}
    points = {c: F.when(known[c], F.when(agree, 100).otherwise(0)) for c, agree in agrees.items()}
    points["name"] = F.when(known["name"], F.coalesce("name_score", F.lit(0)))
    weights = {c: C.FIELD_WEIGHTS[k] for c, k in WEIGHT_OF.items()}
    total = sum((F.coalesce(p, F.lit(0)) * weights[c] for c, p in points.items()), F.lit(0))
    weight = sum((F.when(known[c], w).otherwise(0) for c, w in weights.items()), F.lit(0))
    evidence = (F.coalesce(points["name"], F.lit(0)) > 0) | agrees["tax"] | (known["street"] & known["city"] & agrees["street"] & agrees["city"])
    scored = pairs.where(evidence).select(
        "_asked", "candidate_id", F.rint(total / weight).cast("int").alias("score"), *[points[s.removesuffix("_score")].cast("int").alias(s) for s in SCORES]
    )
    nearest = top_rows(scored, ["_asked"], [-F.col("score"), F.col("candidate_id")], top + 1)
    lists = nearest.groupBy(F.col("_asked").alias("pid")).agg(F.array_sort(F.collect_list(F.struct("rank", "candidate_id", "score", *SCORES))).alias("_near"))
    others = F.slice(F.filter("_near", lambda x: x["candidate_id"] != F.col("record_id")), 1, top)
    found = meet(of, lists, "pid").select("record_id", F.posexplode(others).alias("_at", "_c"))
    return found.select("record_id", (F.col("_at") + 1).alias("rank"), F.col("_c.candidate_id").alias("candidate_id"), *[F.col(f"_c.{s}").alias(s) for s in SCORES], (F.col("_c.score") / 100).alias("score"))
