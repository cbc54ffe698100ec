"""Exact dedup with a heavy-hitter split.

Every text is reduced to the SHA-256 of its normalised form. The mergeable Misra-Gries summary behind Spark's
approx_top_k (a frequent-items sketch of bounded size) names the digests that may be frequent; exact counts verify
them, and the verified winners, at most `max_hot` rows, are broadcast, so rows of hot groups are decided on the map
side and never shuffled. The remaining digests, each of which holds a small share of the rows, take an ordinary
shuffle. The split only moves work: the result is the same for any `max_hot`. DataFrame functions only.

Defined cases: null texts count as empty; of equal texts the row with the most code points in its original text stays,
then the smallest doc_id (null ids last), then, of repeated rows, an arbitrary single one; an empty table gives an empty
table; extra columns of any name are ignored by `groups` and kept by `exact_dedup`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, spread

#: Bound on verified winners, and the summary's counters.
MAX_HOT, COUNTERS = 256, 4096


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", max_hot: int = MAX_HOT, counters: int = COUNTERS, row_id: Column | None = None) -> DataFrame:
    """One row per row of df: doc_id, row_id, keep_id, keep_row, group_size, kept, text_sha256.

    row_id tells repeated rows apart; by default it is drawn here, in a slim table that is written once.
    """
    slim = cut(
        spread(df).select(
            F.col(doc_id).alias("doc_id"),
            (F.monotonically_increasing_id() if row_id is None else row_id).alias("row_id"),
            F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n"),
            F.sha2(normalised(F.col(text)).cast("binary"), 256).alias("text_sha256"),
        )
    )
    best = F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("nil"), "doc_id", "row_id")
    suspects = slim.agg(F.expr(f"approx_top_k(text_sha256, {max_hot}, {counters})").alias("top")).select(F.explode("top.item").alias("text_sha256"))
    # At most max_hot rows by construction of the summary.
    winners = cut(
        slim.join(F.broadcast(suspects), "text_sha256")
        .groupBy("text_sha256")
        .agg(F.min(best).alias("best"), F.count("*").alias("group_size"))
        .filter("group_size > 1")
    )
    hot = slim.join(F.broadcast(winners), "text_sha256")
    by = W.partitionBy("text_sha256")
    rest = slim.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    rest = rest.withColumn("best", F.min(best).over(by)).withColumn("group_size", F.count("*").over(by))
    columns = ["doc_id", "row_id", "text_sha256", "best", "group_size"]
    return hot.select(columns).unionByName(rest.select(columns)).select(
        "doc_id",
        "row_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("best.row_id").alias("keep_row"),
        "group_size",
        (F.col("row_id") == F.col("best.row_id")).alias("kept"),
        "text_sha256",
    )


def exact_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df that stay, with all their columns."""
    columns = df.columns
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.monotonically_increasing_id().alias("row_id"))
    # The id is tied to the physical rows, so the numbered rows are written before both uses.
    rows = cut(rows)
    decided = groups(rows.select("row_id", F.col("row").getField(doc_id).alias("doc_id"), F.col("row").getField(text).alias("text")), row_id=F.col("row_id"))
    return rows.join(decided.filter("kept").select("row_id"), "row_id", "left_semi").select("row.*")
