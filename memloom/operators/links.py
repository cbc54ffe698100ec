"""Joins between memories, their sources and the entries that hold them.

observations: session_id, id, pos, relevance, tokens, sources (ids of entries); reflections: session_id, id, pos, supports (ids of
observations); drops: session_id, id. Every join is an equality on session_id and an id, so one shuffle on them serves it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Ranks, weights and decay powers of tiers, and weights of a score's parts.
TIERS = ("low", "medium", "high", "critical")
DECAY = {"critical": 0.25, "high": 0.28, "medium": 0.31, "low": 0.34}
COVERAGE_WEIGHT, CONSENSUS_WEIGHT, LENGTH_WEIGHT = 0.3, 0.2, 0.08
COVERAGE_RANK = {"strong": 0, "partial": 1, "none": 2}


def rank(tier: Column, names: tuple[str, ...] = TIERS) -> Column:
    return F.array_position(F.array(*map(F.lit, names)), tier).cast("int")


def in_lineage(rows: DataFrame, branch: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose entry lies on the session's branch."""
    return rows.join(branch.select("session_id", key).distinct(), ["session_id", key], "left_semi")


def support_counts(reflections: DataFrame, distinct: bool = True) -> DataFrame:
    """Per observation: how many reflections cite it (distinct), or how often it is cited."""
    ids = F.array_distinct("supports") if distinct else F.col("supports")
    return reflections.select("session_id", F.explode(ids).alias("id")).groupBy("session_id", "id").agg(F.count("*").alias("support"))


def tier_of(support: Column) -> Column:
    return F.when(F.coalesce(support, F.lit(0)) == 0, "none").when(support == 1, "partial").otherwise("strong")


def with_coverage(observations: DataFrame, reflections: DataFrame) -> DataFrame:
    out = observations.join(support_counts(reflections), ["session_id", "id"], "left")
    return out.withColumn("support", F.coalesce("support", F.lit(0))).withColumn("coverage", tier_of(F.col("support")))


def transitions(observations: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Per relevance and change of coverage from one set of reflections to another: observations and tokens."""
    old = support_counts(before).withColumnRenamed("support", "old")
    both = observations.join(old, ["session_id", "id"], "left").join(support_counts(after), ["session_id", "id"], "left")
    change = both.withColumn("was", tier_of(F.col("old"))).withColumn("is", tier_of(F.col("support"))).filter("was <> is")
    return change.groupBy("relevance", F.concat("was", F.lit("->"), "is").alias("change")).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


def citing(observations: DataFrame, targets: DataFrame, drops: DataFrame) -> DataFrame:
    """Observations that cite any target entry (session_id, entry): the ids matched, in order, and whether they are dropped."""
    each = observations.select("session_id", "id", F.posexplode("sources").alias("n", "entry"))
    hit = each.join(targets.select("session_id", "entry").distinct(), ["session_id", "entry"], "left_semi")
    found = hit.groupBy("session_id", "id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "entry"))), lambda x: x["entry"].cast("string")), ", ").alias("matched"))
    gone = drops.select("session_id", "id").distinct().withColumn("gone", F.lit(True))
    return found.join(gone, ["session_id", "id"], "left").select("session_id", "id", "matched", F.when(F.col("gone"), "dropped").otherwise("active").alias("status"))


def supporting(reflections: DataFrame, found: DataFrame) -> DataFrame:
    """Reflections that rest on any of the found observations."""
    each = reflections.select("session_id", F.col("id").alias("reflection"), F.explode("supports").alias("id"))
    return each.join(found.select("session_id", "id").distinct(), ["session_id", "id"], "left_semi").select("session_id", "reflection").distinct()


def sources_of(reflections: DataFrame, observations: DataFrame, entries: DataFrame) -> DataFrame:
    """Per reflection: supports found and missing, and of their sources those found and missing (entries: session_id, entry)."""
    each = reflections.select("session_id", F.col("id").alias("reflection"), F.explode(F.array_distinct("supports")).alias("id"))
    known = observations.select("session_id", "id", F.lit(True).alias("known"), "sources")
    rows = each.join(known, ["session_id", "id"], "left")
    deep = rows.select("session_id", "reflection", "id", "known", F.explode_outer("sources").alias("entry")).join(entries.select("session_id", "entry").distinct().withColumn("there", F.lit(True)), ["session_id", "entry"], "left")
    one = lambda c: F.count_distinct(F.when(c, F.col("id")))
    src = lambda c: F.count_distinct(F.when(F.col("entry").isNotNull() & c, F.col("entry")))
    out = deep.groupBy("session_id", "reflection").agg(one(F.col("known").isNotNull()).alias("supports"), one(F.col("known").isNull()).alias("missing_supports"), src(F.col("there").isNotNull()).alias("sources"), src(F.col("there").isNull()).alias("missing_sources"))
    return out.withColumn("partial", (F.col("missing_supports") > 0) | (F.col("missing_sources") > 0))


def unambiguous(entries: DataFrame) -> DataFrame:
    """id and place of entries (session_id, id, idx) whose id occurs once."""
    return entries.filter("id IS NOT NULL").groupBy("session_id", "id").agg(F.min("idx").alias("idx"), F.count("*").alias("n")).filter("n = 1").drop("n")


def overlaid(hits: DataFrame, expanded: DataFrame, key: list[str]) -> DataFrame:
    """Expanded entries (key, body) in place of hits (key, body) and beside them."""
    a, b = hits.withColumnRenamed("body", "short"), expanded.withColumnRenamed("body", "long")
    return a.join(b, key, "full_outer").select(*key, F.coalesce("long", "short").alias("body"), F.col("long").isNotNull().alias("expanded"))


def inferred_tier(reflections: DataFrame, observations: DataFrame) -> DataFrame:
    """Per reflection the highest tier of the observations that it rests on, medium if none is known."""
    each = reflections.select("session_id", F.col("id").alias("reflection"), F.explode_outer("supports").alias("id"))
    best = each.join(observations.select("session_id", "id", "relevance"), ["session_id", "id"], "left").groupBy("session_id", "reflection").agg(F.max(rank(F.col("relevance"))).alias("r"))
    return best.select("session_id", "reflection", F.coalesce(F.get(F.array(*map(F.lit, TIERS)), F.col("r") - 1), F.lit("medium")).alias("tier"))


def inherited(observations: DataFrame, reflections: DataFrame) -> DataFrame:
    """Per observation the citing reflection of the highest tier (session_id, id, tier, pos), the first of them on ties."""
    each = reflections.select("session_id", F.col("id").alias("reflection"), "tier", F.col("pos").alias("at"), F.explode(F.array_distinct("supports")).alias("id"))
    joined = observations.select("session_id", "id").join(each, ["session_id", "id"])
    return joined.groupBy("session_id", "id").agg(F.max_by("reflection", F.struct(rank(F.col("tier")), -F.col("at"))).alias("reflection"))


def summed_coverage(clusters: DataFrame, cited: DataFrame) -> DataFrame:
    """Per cluster (key, ids): citations of its distinct members."""
    each = clusters.select("key", F.explode(F.array_distinct("ids")).alias("id"))
    return each.join(cited, "id", "left").groupBy("key").agg(F.coalesce(F.sum("support"), F.lit(0)).alias("coverage"))


def after_covered(observations: DataFrame, covered: DataFrame) -> DataFrame:
    """Observations after each session's covered entry (session_id, covered: a pos that may be unknown: then all)."""
    known = observations.select("session_id", F.col("pos").alias("covered"), F.lit(True).alias("there")).distinct()
    marks = covered.join(known, ["session_id", "covered"], "left").select("session_id", F.when(F.col("there"), F.col("covered")).alias("after"))
    return observations.join(marks, "session_id", "left").filter(F.col("after").isNull() | (F.col("pos") > F.col("after"))).drop("after")


def drop_order(observations: DataFrame, reflections: DataFrame, most: int) -> DataFrame:
    """Per session the first `most` to drop: best covered by tier, least relevant, oldest, first proposed (id)."""
    cover = F.create_map(*[F.lit(x) for p in COVERAGE_RANK.items() for x in p])[F.col("coverage")]
    order = W.partitionBy("session_id").orderBy(cover, rank(F.col("relevance")), "pos", "id")
    return with_coverage(observations, reflections).withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= most)


def merge_by_id(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Both, one row an id, existing ones first."""
    both = existing.withColumn("_late", F.lit(0)).unionByName(fresh.withColumn("_late", F.lit(1)))
    order = W.partitionBy("session_id", "id").orderBy("_late", "pos")
    return both.withColumn("_at", F.row_number().over(order)).filter("_at = 1").drop("_late", "_at")


def known_ids(wanted: Column, allowed: Column) -> Column:
    """Wanted ids that are allowed, once each, in the order of the allowed ones; null if none is left."""
    out = F.filter(F.array_distinct(allowed), lambda x: F.array_contains(wanted, x))
    return F.when(F.size(out) > 0, out)


def all_known_ids(wanted: Column, allowed: Column) -> Column:
    """As known_ids, but null as soon as one id is unknown."""
    return F.when(F.forall(wanted, lambda x: F.array_contains(allowed, x)), known_ids(wanted, allowed))


def burst_penalty(occurrences: Column, sessions: Column, weight: float = 0.15) -> Column:
    ratio = occurrences / F.greatest(sessions, F.lit(1))
    return F.when((sessions == 0) | (ratio <= 1.5), 1.0).otherwise(1 / (1 + weight * F.log2(ratio)))


def decay(days: Column, tier: Column) -> Column:
    power = F.create_map(*[F.lit(x) for p in DECAY.items() for x in p])[tier]
    return F.coalesce(1 / F.pow(1 + F.greatest(days, F.lit(0.0)), power), F.lit(0.5))


def cluster_score(tier: Column, days: Column, sessions: Column, coverage: Column, consensus: Column, occurrences: Column, density: Column) -> Column:
    return rank(tier) * decay(days, tier) * (1 + F.log2(1 + sessions)) * (1 + COVERAGE_WEIGHT * F.log2(1 + coverage)) * (1 + CONSENSUS_WEIGHT * consensus) * burst_penalty(occurrences, sessions) * density


def reflection_score(tier: Column, days: Column, sessions: Column, supports: Column, occurrences: Column, density: Column) -> Column:
    return rank(tier) * decay(days, tier) * (1 + F.log2(1 + sessions)) * (1 + F.log2(1 + supports)) * burst_penalty(occurrences, sessions) * density


def newest_fitting(rows: DataFrame, most: int) -> DataFrame:
    """From the newest, rows (session_id, pos, line) that still fit a budget of tokens with those kept, joined by line breaks."""
    # The fold carries a number and a mark a row, not the rows.
    rows = rows.select("session_id", "pos", F.length("line").alias("n"))
    folded = rows.groupBy("session_id").agg(F.reverse(F.sort_array(F.collect_list(F.struct("pos", "n")))).alias("rows"))
    marks = F.aggregate("rows", F.struct(F.lit(0).cast("long").alias("chars"), F.lit("").alias("bits")), lambda acc, x: _fit(acc, x, most))["bits"]
    each = folded.withColumn("bits", marks).select("session_id", "bits", F.posexplode("rows").alias("i", "x"))
    return each.filter(F.substring("bits", F.col("i") + 1, F.lit(1)) == "1").select("session_id", F.col("x.pos").alias("pos"))


def _fit(acc: Column, x: Column, most: int) -> Column:
    chars = acc["chars"] + F.when(acc["chars"] > 0, 1).otherwise(0) + x["n"]
    fits = F.ceil(chars / 4) <= most
    return F.struct(F.when(fits, chars).otherwise(acc["chars"]).cast("long").alias("chars"), F.concat(acc["bits"], F.when(fits, "1").otherwise("0")).alias("bits"))
