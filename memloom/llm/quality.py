"""Quality rules: robust multivariate outliers per language and source.

Each text's statistics become a vector of four transformed figures (symbols, word length, repetition, repeated lines).
Per (language, source), per language, and for the table, the minimum covariance determinant estimate of centre and spread is
found from all rows that pass the base rules: two starts (median with MAD, and mean with covariance) are improved by
concentration steps, each of which keeps the `part` of the rows nearest by Mahalanobis distance, until no determinant falls;
the start whose determinant ends smaller wins. A step is one aggregation over a slim table: counts and moments by bins of log
distance (1/64 wide) give the nearest part's moments, so a group of any size is spread over all tasks.

Regularisation: most texts have no symbols or repeats at all, so that the covariance of any half of them is singular. As in
the regularised estimate (MRCD), the determinant that is minimised is that of the nearest part's covariance plus a diagonal
target. The target comes from the data: the squares of what one symbol, one word of mean length, one repeated window (six
words) and one repeated line more would add to the four figures of a text of the group's median length, which is how finely
they can be told at all.

Shrinkage: an estimate from n rows counts n / (n + `prior`), that of the wider group the rest: (language, source) towards
language, language towards the table. It is the same for groups of all sizes. Rows beyond the chi-square cut-off are
rejected; it lies far out (1e-12), as the figures of short texts have heavier tails than the normal distribution.

Defined cases: null and empty texts have no words and fail the base rules; null languages and sources are values of their
own; repeated rows count as often as they occur; an empty table gives an empty table; extra columns of any name are kept by
`quality_rules`, but one that has the name of a result column gives way to it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, spread

SYMBOLS = re.compile(r"[#*$%&|<>]")
DIMS = 4
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
RESULTS = frozenset((*STATS, "base_failed", "distance", "kept"))


def statistics(text: str | None) -> tuple[int, ...]:
    """STATS of one text."""
    raw = (text or "").encode()
    words = raw.split()  # bytes split at exactly the six ASCII characters
    n = len(words)
    chars = len(text or "") - (len(raw) - sum(map(len, words)))
    lines: set[bytes] = set()
    dup = n_lines = 0
    for line in raw.split(b"\n"):
        if line.strip():
            n_lines += 1
            dup += line in lines
            lines.add(line)
    repeat = 0
    if n >= 3:
        index: dict[bytes, int] = {}
        ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
        pair = np.unique(ids[:-1] * len(index) + ids[1:], return_inverse=True)[1]
        _, at, times = np.unique(pair[:-1] * len(index) + ids[2:], return_inverse=True, return_counts=True)
        twice = times[at] > 1
        if twice.any():
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= twice
            repeat = int(covered.sum())
    return n, chars, len(SYMBOLS.findall(text or "")), dup, repeat, n_lines


def with_statistics(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (by default all) and STATS."""
    names = [c for c in (df.columns if keep is None else keep) if c.lower() not in RESULTS]
    rows = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias("_text_measured"))
    schema = rows.drop("_text_measured").schema
    for s in STATS:
        schema = schema.add(s, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [statistics(t) for t in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array([f[i] for f in found], pa.int64()) for i in range(len(STATS))]], [*names, *STATS])

    return spread(rows).mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> list[Column]:
    """Symbols a hundred words, mean word length drawn to 5 in short texts, and shares of repeats: stretched where most
    documents lie."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log1p(100.0 * F.col("n_symbols") / n),
        F.log((F.col("word_chars") + 200.0) / (F.col("n_words") + 40.0)),
        F.sqrt(F.col("n_repeat_words") / n),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
    ]


def _chi2(y: float, even: int) -> float:
    """Distribution function of chi-square with an even number of degrees."""
    half, term, total = y / 2, 1.0, 0.0
    for k in range(even // 2):
        total += term
        term *= half / (k + 1)
    return 1 - math.exp(-half) * total


def _quantile(p: float, even: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2(mid, even) < p else (low, mid)
    return high


def _target() -> Column:
    """By group: what the regularisation adds to the variances."""
    n, lines, chars = (F.greatest(F.percentile_approx(c, 0.5, 1000), F.lit(1)).cast("double") for c in ("n_words", "n_lines", "word_chars"))
    return F.array(F.pow(F.log1p(100 / n), 2), F.pow(chars / n / (chars + 200), 2), 6 / n, 1 / lines)


def _inverse(params: DataFrame, scale: float) -> DataFrame:
    """From g, start, n, target and moments: centre, spread, its inverse (row by row) and log determinant."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            spreads = [np.array(s, float).reshape(DIMS, DIMS) * scale + np.diag(np.array(t, float)) for s, t in zip(pdf["cross"], pdf["target"], strict=True)]
            out = pdf[["g", "start", "n"]].assign(centre=pdf["mean"], spread=[s.ravel().tolist() for s in spreads])
            yield out.assign(inverse=[np.linalg.inv(s).ravel().tolist() for s in spreads], logdet=[float(np.linalg.slogdet(s)[1]) for s in spreads])

    return cut(params.mapInPandas(run, "g string, start int, n long, centre array<double>, spread array<double>, inverse array<double>, logdet double"))


def _distance() -> Column:
    d = [F.col(f"x{i}") - F.col("centre")[i] for i in range(DIMS)]
    return sum((d[i] * d[j] * F.col("inverse")[i * DIMS + j] for i in range(DIMS) for j in range(DIMS)), F.lit(0.0))


def _moments(rows: DataFrame, by: list[str]) -> DataFrame:
    """n, and sums of the figures and their products."""
    xs = [F.col(f"x{i}") for i in range(DIMS)]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(xs)], *[F.sum(xs[i] * xs[j]).alias(f"p{i}{j}") for i in range(DIMS) for j in range(i, DIMS)])


def _of_sums(sums: DataFrame) -> DataFrame:
    mean = [F.col(f"s{i}") / F.col("n") for i in range(DIMS)]
    cross = [F.col(f"p{min(i, j)}{max(i, j)}") / F.col("n") - mean[i] * mean[j] for i in range(DIMS) for j in range(DIMS)]
    return sums.select("g", "start", "n", F.array(*mean).alias("mean"), F.array(*cross).alias("cross"))


def estimate(fit: DataFrame, part: float = 0.75) -> DataFrame:
    """MCD per g over rows (g, x0..x3, n_words, n_lines, word_chars): g, n, centre, spread."""
    mid = cut(fit.groupBy("g").agg(F.count("*").alias("n"), F.array(*[F.percentile_approx(f"x{i}", 0.5, 1000) for i in range(DIMS)]).alias("mid"), _target().alias("target")))
    off = fit.join(mid, "g").groupBy("g").agg(F.first("n").alias("n"), F.first("mid").alias("mean"), *[F.percentile_approx(F.abs(F.col(f"x{i}") - F.col("mid")[i]), 0.5, 1000).alias(f"o{i}") for i in range(DIMS)])
    diagonal = [F.pow(1.4826 * F.col(f"o{i}"), 2) if i == j else F.lit(0.0) for i in range(DIMS) for j in range(DIMS)]
    robust = off.select("g", F.lit(0).alias("start"), "n", "mean", F.array(*diagonal).alias("cross"))
    plain = _of_sums(_moments(fit, ["g"]).withColumn("start", F.lit(1)))
    target = mid.select("g", "target", F.col("n").alias("rows"))
    params = _inverse(robust.unionByName(plain).join(target, "g"), 1.0)
    inside = part / _chi2(_quantile(part, DIMS), DIMS + 2) if part < 1 else 1.0
    best = None
    # Bins up to the one that holds the last row of the nearest part.
    ladder = W.partitionBy("g", "start").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    sums = [*[f"s{i}" for i in range(DIMS)], *[f"p{i}{j}" for i in range(DIMS) for j in range(i, DIMS)]]
    while True:
        bins = _moments(fit.join(params.select("g", "start", "centre", "inverse"), "g").withColumn("bin", F.floor(64 * F.log(_distance() + 1e-9))), ["g", "start", "bin"])
        near = bins.withColumn("before", F.coalesce(F.sum("n").over(ladder), F.lit(0))).join(target, "g").filter(F.col("before") < part * F.col("rows"))
        after = _inverse(_of_sums(near.groupBy("g", "start").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums])).join(target, "g"), inside)
        if best is None:
            best = params = after
            continue
        both = after.alias("a").join(best.alias("b"), ["g", "start"])
        falls = F.col("a.logdet") < F.col("b.logdet") - 1e-6
        if both.filter(falls).isEmpty():
            break
        best = cut(both.select("g", "start", *[F.when(falls, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in after.columns[2:]]))
        params = after
    return best.groupBy("g").agg(F.min_by(F.struct("centre", "spread"), F.struct("logdet", "start")).alias("best")).join(target, "g").select("g", F.col("rows").alias("n"), "best.*")


def _shrunk(own: DataFrame, wide: DataFrame, prior: float) -> DataFrame:
    """own (g, wider, n, centre, spread) drawn to wide (g, centre, spread)."""
    share = F.col("n") / (F.col("n") + prior)
    mix = lambda c: F.zip_with(F.col(c), F.col(f"w.{c}"), lambda a, b: share * a + (1 - share) * b).alias(c)
    return own.join(wide.select(F.col("g").alias("wider"), F.struct("centre", "spread").alias("w")), "wider").select("g", "n", mix("centre"), mix("spread"))


def judge(stats: DataFrame, lang: str = "lang", source: str = "source", part: float = 0.75, level: float = 1 - 1e-12, prior: float = 50.0) -> DataFrame:
    """Adds base_failed, distance (squared, null where the base failed) and kept to rows that have STATS."""
    names = stats.columns
    both, alone = F.to_json(F.struct(F.col(lang).alias("l"), F.col(source).alias("s"))), F.to_json(F.struct(F.col(lang).alias("l")))
    rows = stats.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(base_failed(), F.lit(True)).alias("base_failed"), F.concat(F.lit("s"), both).alias("both"), F.concat(F.lit("l"), alone).alias("alone"), *[x.alias(f"x{i}") for i, x in enumerate(vector())])
    measures = [F.col(f"row.{c}").alias(c) for c in ("n_words", "n_lines", "word_chars")]
    good = rows.filter(~F.col("base_failed")).select("both", "alone", *[f"x{i}" for i in range(DIMS)], *measures)
    found = estimate(cut(good.select(F.explode(F.array("both", "alone", F.lit("all"))).alias("g"), *good.columns[2:])), part)
    found = cut(found)
    langs = cut(_shrunk(found.filter("g LIKE 'l%'").withColumn("wider", F.lit("all")), found.filter("g = 'all'"), prior))
    pairs = good.select(F.col("both").alias("g"), F.col("alone").alias("wider")).distinct()
    last = _shrunk(found.join(pairs, "g"), langs, prior).withColumns({"start": F.lit(0), "mean": F.col("centre"), "cross": F.col("spread"), "target": F.array(*[F.lit(0.0)] * DIMS)})
    judged = rows.join(_inverse(last, 1.0).select(F.col("g").alias("both"), "centre", "inverse"), "both", "left").withColumn("d", F.when(~F.col("base_failed"), _distance()))
    return judged.select("row.*", "base_failed", F.col("d").alias("distance"), (~F.col("base_failed") & F.coalesce(F.col("d") <= _quantile(level, DIMS), F.lit(True))).alias("kept"))


def quality_rules(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: list[str] | None = None, **options) -> DataFrame:
    """df's columns (or those in keep, which must include lang and source), STATS, base_failed, distance, kept."""
    return judge(cut(with_statistics(df, text, keep)), lang, source, **options)
