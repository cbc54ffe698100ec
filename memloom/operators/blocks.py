"""Message blocks without noise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tools whose calls and results say nothing, remarks that do not count, and wrappers that hosts put into texts.
NOISE_TOOLS = ["TodoWrite", "TodoRead", "ToolSearch", "WebSearch", "AskUser", "ExitSpecMode", "GenerateDroid"]
NOISE_REMARKS = ["Continue from where you left off.", "No response requested.", "IMPORTANT: TodoWrite was not called yet."]
WRAPPERS = ["system-reminder", "ide_opened_file", "command-message", "context-window-usage"]

#: White space at the ends, Unicode's included.
_BLANK = r"[\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
ENDS = f"^{_BLANK}|{_BLANK}$".replace("$", r"\z")
WRAPPED = rf"<({'|'.join(WRAPPERS)})[^>]*>[\s\S]*?</\1>"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, ENDS, "")


def clean_user_text(text: Column) -> Column:
    """The text without wrappers; null if it is empty then, or holds one of the remarks."""
    remark = reduce(lambda a, b: a | b, [F.contains(text, F.lit(s)) for s in NOISE_REMARKS])
    return F.when(~remark, F.nullif(strip(F.regexp_replace(strip(text), WRAPPED, "")), F.lit("")))


def filter_noise(blocks: DataFrame) -> DataFrame:
    """blocks (kind, name, text, ...) without thinking, noise tools and empty user texts; user texts are cleaned. A narrow map:
    no shuffle. A null kind is kept, a null user text goes."""
    kind, user = F.coalesce("kind", F.lit("")), F.col("kind").eqNullSafe("user")
    tool = kind.isin("tool_call", "tool_result") & F.coalesce(F.col("name").isin(NOISE_TOOLS), F.lit(False))
    cleaned = blocks.filter((kind != "thinking") & ~tool).withColumn("text", F.when(user, clean_user_text(F.col("text"))).otherwise(F.col("text")))
    return cleaned.filter(~user | F.col("text").isNotNull())
