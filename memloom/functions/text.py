"""Scalar functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import pairs

# Contractions and what they stand for.
CONTRACTIONS = {
    "don't": "do not", "can't": "cannot", "won't": "will not", "isn't": "is not", "aren't": "are not", "wasn't": "was not", "weren't": "were not",
    "hasn't": "has not", "haven't": "have not", "hadn't": "had not", "doesn't": "does not", "didn't": "did not", "couldn't": "could not",
    "shouldn't": "should not", "wouldn't": "would not", "mustn't": "must not", "needn't": "need not", "it's": "it is", "that's": "that is",
    "what's": "what is", "there's": "there is", "here's": "here is", "how's": "how is", "who's": "who is", "i'm": "i am", "you're": "you are",
    "we're": "we are", "they're": "they are",
}
# Error messages worth another try, and those that can't succeed again.
RETRYABLE = "overloaded|provider.?returned.?error|rate.?limit|too many requests|429|500|502|503|504|service.?unavailable|server.?error|internal.?error|network.?error|connection.?error|connection.?refused|connection.?lost|websocket.?closed|websocket.?error|other side closed|fetch failed|upstream.?connect|reset before headers|socket hang up|ended without|http2 request did not get a response|timed? out|timeout|terminated|retry delay"
DETERMINISTIC = r"MissingSessionID|missing.?session|invalid.?api.?key|unauthorized|HTTP\s+40[014]\b|HTTP\s+4(?:03|22)\b|status\s*:?\s*40[014]\b|status\s*:?\s*4(?:03|22)\b|error\s*:?\s*40[014]\b|error\s*:?\s*4(?:03|22)\b"
BARE_CODE = r"""(?:^|[\s:(\[{="'])(40[014]|403|422)\b"""
SIGNAL = "error|fail|missing|forbidden|denied|bad request|not found|unauthorized|invalid"
NORM_CAP = 600


def sanitize(text: Column) -> Column:
    """Line ends as \\n, without terminal colours and control characters."""
    plain = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\x1b\\[[0-9;]*[a-zA-Z]", "")
    return F.regexp_replace(plain, "[\x01-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def clip(text: Column, most: int = 200) -> Column:
    """The first `most` characters, cut back to the last space in or right after them if that leaves over 60 %."""
    return clip_to(text, F.lit(most))


def clip_to(text: Column, most: Column) -> Column:
    head = F.substring(text, F.lit(1), (most + 1).cast("int"))
    space = F.length(head) - F.instr(F.reverse(head), " ")
    kept = F.when((F.instr(head, " ") > 0) & (space > most * 0.6), F.substring(head, F.lit(1), space)).otherwise(F.substring(text, F.lit(1), most.cast("int")))
    return F.when(F.length(text) <= most, text).otherwise(kept)


def clip_sentence(text: Column, most: int = 200) -> Column:
    """Up to the last sentence end within `most` characters, if that is at half or later; else as clip."""
    head = F.substring(text, 1, most)
    end = F.length(F.regexp_extract(head, r"^([\s\S]*[.!?])(?:\s|$)", 1))
    return F.when(F.length(text) <= most, text).when(end >= most * 0.5, F.substring(head, F.lit(1), end)).otherwise(clip(text, most))


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def first_line(text: Column, most: int = 200) -> Column:
    return clip(F.element_at(F.split(text, "\n"), 1), most)


def snippet(text: Column, term: str, radius: int = 60) -> Column:
    at = F.instr(F.lower(text), term.lower())
    start, end = F.greatest(F.lit(1), at - radius), F.least(F.length(text), at + len(term) - 1 + radius)
    body = F.substring(text, start, end - start + 1)
    return F.when(at > 0, F.concat(F.when(start > 1, "...").otherwise(""), body, F.when(end < F.length(text), "...").otherwise("")))


def normalize(text: Column) -> Column:
    """Contractions spelt out, lower case, letters and digits only, single spaces, 600 characters at most."""
    low = F.lower(text)
    # One pass for each ending, and none over texts without an apostrophe.
    groups: dict[tuple[str, str], list[str]] = {}
    for short, full in CONTRACTIONS.items():
        stem, end = short.split("'")
        base = stem.removesuffix("n") if end == "t" else stem
        if full.startswith(base):
            groups.setdefault((short[len(base) :], full[len(base) :]), []).append(base)
        else:
            groups.setdefault((short, full), []).append("")
    spelt = low
    for (end, tail), stems in groups.items():
        spelt = F.regexp_replace(spelt, rf"\b({'|'.join(stems)}){end}\b", f"$1{tail}")
    full = F.when(F.contains(low, F.lit("'")), spelt).otherwise(low)
    plain = F.regexp_replace(full, r"[^a-z0-9\s]", " ")
    return F.substring(F.trim(F.regexp_replace(plain, r"\s+", " ")), 1, NORM_CAP)


def hash_id(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 12)


def tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def n_bigrams(text: Column) -> Column:
    """How many distinct pairs of neighbouring characters there are. In Python workers, as arrays of strings for each text cost
    ten times as much and more."""
    return F.arrow_udf(pairs.n_bigrams, "long")(text)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def dice(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("long")


def levenshtein_similarity(a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def error_class(message: Column) -> Column:
    sure = message.rlike(f"(?i){DETERMINISTIC}") | (message.rlike(BARE_CODE) & message.rlike(f"(?i){SIGNAL}"))
    return F.when(sure, "deterministic").when(message.rlike(f"(?i){RETRYABLE}"), "retryable").otherwise("other")


def short_path(path: Column, cwd: str = "/work") -> Column:
    """./ and the rest under the working directory, else .../ and the last three parts of more; slashes forward."""
    plain, here = F.replace(path, F.lit("\\"), F.lit("/")), cwd.replace("\\", "/")
    parts = F.split(plain, "/")
    return F.when(F.startswith(plain, F.lit(f"{here}/")), F.concat(F.lit("."), F.substring(plain, F.lit(len(here) + 1), F.length(plain)))).when(F.size(parts) > 3, F.concat(F.lit(".../"), F.array_join(F.slice(parts, -3, 3), "/"))).otherwise(plain)


def relative_time(age_minutes: Column) -> Column:
    m = F.greatest(age_minutes, F.lit(0))
    hours, days = F.floor(m / 60), F.floor(m / 1440)
    said = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return F.when(m < 1, "just now").when(m < 60, said(m, "m")).when(hours < 24, said(hours, "h")).when(days < 14, said(days, "d")).when(days < 60, said(F.floor(days / 7), "w")).when(F.floor(days / 30) < 24, said(F.floor(days / 30), "mo")).otherwise(said(F.floor(days / 365), "y"))


def recency(age_days: Column, power: float = 0.5) -> Column:
    return F.coalesce(1 / F.pow(1 + F.greatest(age_days, F.lit(0.0)), F.lit(power)), F.lit(0.5))


def preset_ratio(window: Column, anchors: list[tuple[int, float]]) -> Column:
    """Linear between anchors, level beyond them."""
    out = F.when(window <= anchors[0][0], F.lit(anchors[0][1]))
    for (w0, r0), (w1, r1) in zip(anchors, anchors[1:], strict=False):
        out = out.when(window <= w1, r0 + (window - w0) / (w1 - w0) * (r1 - r0))
    return out.otherwise(F.lit(anchors[-1][1]))


def compact_threshold(window: Column, tokens: Column, ratio: Column, reserve: Column, anchors: list[tuple[int, float]]) -> Column:
    """Fixed tokens, then a ratio of the window, then a reserve, then the preset curve: the first that is valid.

    The curve's product is rounded before it is cut, since an exact whole number may lie just below itself as a double.
    """
    at_least = lambda c: F.greatest(F.lit(1), c).cast("long")
    return F.when(tokens > 0, tokens).when((ratio > 0) & (ratio <= 1), at_least(F.floor(window * ratio))).when(reserve > 0, at_least(window - reserve)).otherwise(at_least(F.floor(F.round(window * preset_ratio(window, anchors), 6))))


def chain_decision(append_chain: Column, append_total: Column, saving: Column, window: Column, reserve: Column, manual: Column, overflow: Column) -> Column:
    """Why an append-only chain is rebased, or not."""
    useful = F.when(window.isNull(), 24000).otherwise(F.greatest(F.lit(1), F.least(F.lit(24000), F.floor(window * 24000.0 / 272000))))
    pressure = (append_chain > F.coalesce(F.floor(window / 8), F.lit(34000))) | F.coalesce(append_total > F.floor(window / 2), F.lit(False))
    full = overflow | F.coalesce(append_total > window - reserve, F.lit(False))
    return (
        F.when(manual, "manual-rebase")
        .when(full & (saving > 0), F.when(overflow, "overflow-smaller-rebase").otherwise("capacity-smaller-rebase"))
        .when(full, "ineffective-reduction")
        .when(pressure & (saving >= useful), "pressure-useful-saving")
        .when(saving <= 0, "ineffective-reduction")
        .when(pressure, "insufficient-saving")
        .otherwise("below-pressure")
    )
