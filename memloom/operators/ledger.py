"""Event-sourced memory: folds, projections, coverage and budgets over ledger entries.

Entries have session_id, pos, kind, tokens and key; every operator works per session, so the one shuffle is on session_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window as W



def session() -> WindowSpec:
    return W.partitionBy("session_id")


def before() -> WindowSpec:
    return session().orderBy("pos").rowsBetween(W.unboundedPreceding, 0)


def fold(entries: DataFrame, upto: Column | None = None) -> DataFrame:
    """The first valid observation of each key up to a position, and whether it is dropped by then."""
    seen = entries if upto is None else entries.filter(F.col("pos") <= upto)
    first = seen.filter("kind = 'observation'").groupBy("session_id", "key").agg(F.min_by(F.struct("pos", "tokens"), "pos").alias("o"))
    drops = seen.filter("kind = 'drop'").select("session_id", "key").distinct().withColumn("dropped", F.lit(True))
    return first.join(drops, ["session_id", "key"], "left").select("session_id", "key", "o.pos", "o.tokens", F.coalesce("dropped", F.lit(False)).alias("dropped"))


def active(entries: DataFrame) -> DataFrame:
    """Observations without a tombstone; tombstones of unknown keys do no harm."""
    return fold(entries).filter("NOT dropped").drop("dropped")


def boundary(entries: DataFrame) -> DataFrame:
    """Per session the position of the last compaction."""
    return entries.groupBy("session_id").agg(F.max(F.when(F.col("kind") == "compaction", F.col("pos"))).alias("boundary"))


def visible(entries: DataFrame) -> DataFrame:
    """What is folded in at the last compaction: nothing where there was none."""
    cut = entries.join(boundary(entries), "session_id").filter(F.col("pos") <= F.col("boundary"))
    return active(cut.drop("boundary"))


def drift(entries: DataFrame) -> DataFrame:
    """Per session: active observations not yet visible, and visible ones dropped since."""
    full = active(entries).select("session_id", "key", F.lit(1).alias("f"))
    seen = visible(entries).select("session_id", "key", F.lit(1).alias("v"))
    both = full.join(seen, ["session_id", "key"], "full_outer")
    return both.groupBy("session_id").agg(F.count_if(F.col("v").isNull()).alias("added"), F.count_if(F.col("f").isNull()).alias("removed"))


def usage_as_of(entries: DataFrame) -> DataFrame:
    """Per entry: the last usage (tokens of a reflection) since the last compaction, plus tokens after it; null before."""
    mark = F.max(F.when(F.col("kind") == "compaction", F.col("pos"))).over(before())
    use = F.max(F.when(F.col("kind") == "reflection", F.col("pos"))).over(before())
    total = F.sum("tokens").over(before())
    rows = entries.withColumn("use", use).withColumn("mark", mark).withColumn("total", total)
    at_use = F.last(F.when(F.col("kind") == "reflection", F.struct("tokens", "total")), ignorenulls=True).over(before())
    valid = F.col("use") > F.coalesce("mark", F.lit(-1))
    return rows.withColumn("at", at_use).select("session_id", "pos", F.when(valid, F.col("at.tokens") + F.col("total") - F.col("at.total")).alias("context_tokens"))


def markers(entries: DataFrame) -> DataFrame:
    """Per session: last covered positions of observations and drops, and the earlier of the two (the other where one lacks)."""
    last = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("pos")))
    out = entries.groupBy("session_id").agg(last("observation").alias("observed"), last("drop").alias("dropped"))
    return out.withColumn("earlier", F.least("observed", "dropped"))


def tokens_since(entries: DataFrame, kind: str) -> DataFrame:
    """Per session: tokens after the last entry of a kind, all of them if there is none."""
    last = F.max(F.when(F.col("kind") == kind, F.col("pos"))).over(session())
    rows = entries.withColumn("last", F.coalesce(last, F.lit(-1)))
    return rows.groupBy("session_id").agg(F.sum(F.when(F.col("pos") > F.col("last"), F.col("tokens")).otherwise(0)).alias("tokens"))


def created_after(entries: DataFrame, kind: str, since: str) -> DataFrame:
    """First entries of each key of a kind after the last entry of another kind."""
    last = F.coalesce(F.max(F.when(F.col("kind") == since, F.col("pos"))).over(session()), F.lit(-1))
    late = entries.withColumn("last", last).filter((F.col("pos") > F.col("last")) & (F.col("kind") == kind))
    return late.groupBy("session_id", "key").agg(F.min("pos").alias("pos"))


def coverage(entries: DataFrame) -> DataFrame:
    """Active observations with the number of reflections of their key and the tier that gives."""
    support = entries.filter("kind = 'reflection'").groupBy("session_id", "key").agg(F.count("*").alias("support"))
    out = active(entries).join(support, ["session_id", "key"], "left").withColumn("support", F.coalesce("support", F.lit(0)))
    return out.withColumn("tier", F.when(F.col("support") == 0, "none").when(F.col("support") == 1, "partial").otherwise("strong"))


def observation_scores(observed: DataFrame, base: Column) -> DataFrame:
    """Tier base plus the place among the session's observations from 0 to 1."""
    n, at = F.count("*").over(session()), F.row_number().over(session().orderBy("pos"))
    return observed.withColumn("score", base + F.when(n > 1, (at - 1) / (n - 1)).otherwise(1.0))


def suffix_budget(entries: DataFrame, most: int) -> DataFrame:
    """The newest entries within a budget; the newest of all is always kept."""
    newest = session().orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, 0)
    return entries.withColumn("used", F.sum("tokens").over(newest)).withColumn("n", F.count("*").over(newest)).filter((F.col("used") <= most) | (F.col("n") == 1)).drop("n")


def prefix_budget(entries: DataFrame, most: int) -> DataFrame:
    """The oldest entries within a budget; the first is always kept."""
    return entries.withColumn("used", F.sum("tokens").over(before())).withColumn("n", F.count("*").over(before())).filter((F.col("used") <= most) | (F.col("n") == 1)).drop("n")


def skip_budget(rows: DataFrame, most: int) -> DataFrame:
    """By falling score, rows that still fit, in order of pos: (session_id, pos). The fold carries a number and a mark a row."""
    folded = rows.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "pos", "tokens"))).alias("rows"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["tokens"] <= most
        return F.struct((acc["used"] + F.when(fits, x["tokens"]).otherwise(0)).cast("long").alias("used"), F.concat(acc["bits"], F.when(fits, "1").otherwise("0")).alias("bits"))

    marks = F.aggregate("rows", F.struct(F.lit(0).cast("long").alias("used"), F.lit("").alias("bits")), step)["bits"]
    each = folded.withColumn("bits", marks).select("session_id", "bits", F.posexplode("rows").alias("i", "x"))
    return each.filter(F.substring("bits", F.col("i") + 1, F.lit(1)) == "1").select("session_id", F.col("x.pos").alias("pos"))


def latched_budget(outputs: DataFrame, most: int) -> DataFrame:
    """From the newest: once an output overflows, it and all older ones are left out."""
    newest = session().orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, 0)
    over = F.sum("tokens").over(newest) > most
    return outputs.withColumn("over", over).withColumn("omitted", F.max("over").over(newest)).drop("over")


def chain_status(segments: DataFrame) -> DataFrame:
    """segments: session_id, pos, seq (null: no append segment), start. Per session, walking back from the newest to the chain's
    start: ok, latest-not-append, invalid-chain-entry, invalid-sequence or missing-chain-start, and the segments up to there."""
    back = session().orderBy(F.desc("pos"))
    rows = segments.withColumn("i", F.row_number().over(back) - 1).withColumn("newest", F.first("seq").over(back))
    wrong = F.col("seq").isNull() | (F.col("seq") != F.col("newest") - F.col("i")) | (F.col("start") & (F.col("seq") != 1)) | (~F.col("start") & (F.col("seq") <= 1))
    ends = rows.withColumn("wrong", wrong).filter(F.col("wrong") | F.col("start"))
    # The walk ends at the first entry that is wrong or starts the chain.
    first = ends.groupBy("session_id").agg(F.min_by(F.struct("i", "seq", "wrong"), "i").alias("e"))
    all_ = rows.groupBy("session_id").agg(F.count("*").alias("n"))
    status = F.when(F.col("e").isNull(), "missing-chain-start").when(~F.col("e.wrong"), "ok").when(F.col("e.seq").isNull() & (F.col("e.i") == 0), "latest-not-append").when(F.col("e.seq").isNull(), "invalid-chain-entry").otherwise("invalid-sequence")
    return all_.join(first, "session_id", "left").select("session_id", status.alias("status"), F.when(status == "ok", F.col("e.i") + 1).otherwise(0).cast("long").alias("segments"))
