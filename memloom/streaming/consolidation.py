"""Incremental consolidation: count-based windows of tokens per session, kept as streaming state.

A session fires when the tokens since its coverage reach the threshold; entries below it stay and add up, nothing is late.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FIRED = "session_id long, window long, last_pos long, tokens long"


def windows(entries: DataFrame, threshold: int) -> DataFrame:
    """session_id, window, last_pos, tokens of each full window; entries: session_id, pos, tokens, batch or stream."""
    if not entries.isStreaming:
        return _folded(entries, threshold)

    def step(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, held = state.get if state.exists else (0, 0)
        rows = []
        for r in pd.concat(list(parts)).sort_values("pos").itertuples():
            held += r.tokens
            if held >= threshold:
                rows.append((key[0], n, r.pos, held))
                n, held = n + 1, 0
        state.update((n, held))
        yield pd.DataFrame(rows, columns=["session_id", "window", "last_pos", "tokens"])

    return entries.select("session_id", "pos", "tokens").groupBy("session_id").applyInPandasWithState(step, FIRED, "n long, held long", "append", GroupStateTimeout.NoTimeout)


def _folded(entries: DataFrame, threshold: int) -> DataFrame:
    """The fold over a session carries a number and a mark a row; windows are the rows up to each mark."""
    rows = entries.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("pos", "tokens"))).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("held"), F.lit("").alias("bits"))

    def step(acc: Column, x: Column) -> Column:
        held = acc["held"] + x["tokens"]
        return F.struct(F.when(held >= threshold, 0).otherwise(held).cast("long").alias("held"), F.concat(acc["bits"], F.when(held >= threshold, "1").otherwise("0")).alias("bits"))

    each = rows.select("session_id", F.aggregate("rows", start, step)["bits"].alias("bits"), F.posexplode("rows").alias("i", "x"))
    fires = F.substring("bits", F.col("i") + 1, F.lit(1)) == "1"
    order = W.partitionBy("session_id").orderBy("i")
    each = each.select("session_id", "i", "x.*", fires.alias("fires"))
    each = each.withColumn("window", F.coalesce(F.sum(F.col("fires").cast("long")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return each.groupBy("session_id", "window").agg(F.max("pos").alias("last_pos"), F.sum("tokens").alias("tokens"), F.bool_or("fires").alias("full")).filter("full").drop("full")


def pending(entries: DataFrame, threshold: int) -> DataFrame:
    """Sessions that are due: tokens since the last observation reach the threshold."""
    last = F.max(F.when(F.col("kind") == "observation", F.col("pos")))
    marks = entries.groupBy("session_id").agg(last.alias("last"))
    rows = entries.join(marks, "session_id").filter(F.col("pos") > F.coalesce("last", F.lit(-1)))
    return rows.groupBy("session_id").agg(F.sum("tokens").alias("tokens")).filter(F.col("tokens") >= threshold)
