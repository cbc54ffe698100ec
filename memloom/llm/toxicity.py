"""Toxicity by nearest labelled examples.

Terms are words, lower case and without outer punctuation, and the beginnings of `START` characters of longer ones, so that
inflected forms meet. All terms of all examples count; none is chosen or thrown away by its labels. Documents become TF-IDF
vectors, (1 + log tf) * idf * relevance, where a term's relevance is sqrt(1 + G) for the log-likelihood ratio G by which
labelled examples tie it to toxicity, and 1 for any other term (supervised term weighting; with `relevance` off it is
plain TF-IDF). The `k` nearest labelled examples by exact cosine vote, weighted by 1 / (1.05 - cosine); an isotonic fit of
leave-one-out votes makes scores calibrated, and the neighbours are the evidence. Neighbours are found in a block-max
inverted index: postings are cut into blocks of `block` examples with the largest weight of each term in each; the blocks of
largest upper bound give a cosine that the k-th best can't fall under, and all blocks that can reach it are added up,
which loses nothing. Examples with like vocabulary lie side by side, so that bounds differ between blocks. The `COMMON` terms
that most examples have lie in a matrix instead of lists; what they add is known for many texts at once, and so their part of a
block's bound is the exact one.

What is fitted on a bounded sample: examples are at most about `max_labelled` labelled rows, chosen by hash, with all their
terms. Every document is scored on its whole text; the index that is broadcast is bounded by these rows' distinct terms.

Defined cases: texts without any term of an example, null and empty ones among them, get the smoothed share of toxic
examples among examples without terms and no evidence; documents with conflicting labels count as toxic, null labels as
none; equal cosines go to the smaller example id; without labelled rows every score is 0; repeated rows are scored
alike; extra columns of any name are kept, but one that has the name of a result column gives way to it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, spread

EDGES = ".,;:!?#$%&*|<>()[]{}\"'`~^_=+-/\\@"
START = 5
MAX_LABELLED = 3_200
COMMON = 512
#: Words that a worker keeps at most.
KNOWN_WORDS = 200_000


def terms_of(word: str) -> tuple[str, ...]:
    """The word and, if it is longer, its beginning with an asterisk."""
    w = word.strip(EDGES)
    return (w, f"{w[:START]}*") if len(w) > START else (w,) if w else ()


def count_terms(text: str | None) -> Counter[str]:
    out: Counter[str] = Counter()
    for w, n in Counter((text or "").lower().split()).items():
        for t in terms_of(w):
            out[t] += n
    return out


def spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1 ... n[0] numbers, then those of first[1] ..."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - n), n)


class Met(dict):
    """Words met, numbered as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Words:
    """Texts to term numbers and counts; of the words met, at most about KNOWN_WORDS are kept."""

    def __init__(self, terms: dict[str, int]) -> None:
        self.terms, self.known = terms, Met()
        self.pairs = np.zeros((0, 2), np.int32)

    def count(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        if len(self.known) >= KNOWN_WORDS:
            self.known, self.pairs = Met(), self.pairs[:0]
        split = [(t or "").lower().split() for t in texts]
        before, number = len(self.known), self.known.__getitem__
        ids = [np.fromiter(map(number, ws), np.int32, len(ws)) for ws in split]
        # As terms_of has it.
        get, bare = self.terms.get, [w.strip(EDGES) for w in islice(reversed(self.known), len(self.known) - before)]
        found = np.array([[get(w, -1) for w in bare], [get(w[:START] + "*", -1) if len(w) > START else -1 for w in bare]], np.int32)
        self.pairs = np.concatenate([self.pairs, found.T[::-1]])
        out = []
        for own in ids:
            terms = self.pairs[own].ravel()
            terms, n = np.unique(terms[terms >= 0], return_counts=True)
            out.append((terms, n.astype(float)))
        return out


@dataclass
class Index:
    """Block-max inverted index over the examples' unit vectors. An entry is a term in a block: its largest weight there, and
    where its postings (places and weights of examples) lie."""

    terms: dict[str, int]
    weights: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    block: int
    entries: np.ndarray  # term t has entries[t] up to entries[t + 1]
    blocks: np.ndarray
    tops: np.ndarray
    postings: np.ndarray  # entry e has postings[e] up to postings[e + 1]
    places: np.ndarray
    values: np.ndarray
    rank: np.ndarray  # of places in the order of ids
    row: np.ndarray  # of a term in the matrix of common terms' weights by place, or -1
    matrix: np.ndarray
    prior: float = 0.0
    empty: float = 0.0
    steps: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.array([0.0, 1.0]), np.array([0.0, 1.0])))
    _shared: Broadcast | None = None

    def shared(self, spark: SparkSession) -> Broadcast:
        """The index as a broadcast, made once, with numbers of four bytes; `steps` are not in it."""
        if self._shared is None:
            self._shared = spark.sparkContext.broadcast(self)
        return self._shared

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_shared": None, "steps": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state | {n: state[n].astype(np.float64) for n in ("weights", "tops", "values", "matrix")})

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.weights[terms]
        return w / (np.linalg.norm(w) or 1.0)

    def common(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What common terms add to the cosines of vectors (terms, weights): one line of places for each."""
        dense = np.zeros((len(vectors), len(self.matrix)))
        for i, (terms, w) in enumerate(vectors):
            row = self.row[terms]
            dense[i, row[row >= 0]] = w[row >= 0]
        return dense @ self.matrix

    def nearest(self, terms: np.ndarray, w: np.ndarray, k: int, leave: int = -1, first: int = 4, base: np.ndarray | None = None) -> list[tuple[int, float]]:
        """The k examples of largest cosine above 0, ties by id. base: of common()."""
        if base is None:
            base = self.common([(terms, w)])[0]
        n = self.entries[terms + 1] - self.entries[terms]
        entry, x = spans(self.entries[terms], n), np.repeat(w, n)
        block = self.blocks[entry]
        tops = np.maximum.reduceat(base, np.arange(0, len(base), self.block))
        bounds = tops + np.bincount(block, self.tops[entry] * x, minlength=len(tops))
        order = np.argsort(-bounds, kind="stable")
        best = self._best(entry, x, block, order[:first], base, k, leave)
        least = best[-1][1] if len(best) == k else 0.0
        rest = order[first:]
        rest = rest[(bounds[rest] > 0) & (bounds[rest] >= least - 1e-9)]
        if len(rest):
            best = sorted(best + self._best(entry, x, block, rest, base, k, leave), key=lambda b: (-b[1], self.rank[b[0]]))[:k]
        return best

    def _best(self, entry: np.ndarray, x: np.ndarray, block: np.ndarray, chosen: np.ndarray, base: np.ndarray, k: int, leave: int) -> list[tuple[int, float]]:
        inside = np.zeros(-(-len(base) // self.block), bool)
        inside[chosen] = True
        held = np.flatnonzero(inside[block])
        entry, x = entry[held], x[held]
        first = self.postings[entry]
        n = self.postings[entry + 1] - first
        at = spans(first, n)
        sums = base + np.bincount(self.places[at], self.values[at] * np.repeat(x, n), minlength=len(base))
        sums *= np.repeat(inside, self.block)[: len(base)]
        if leave >= 0:
            sums[leave] = 0.0
        hit = np.flatnonzero(sums > 0)
        if len(hit) > k:
            least = np.partition(sums[hit], len(hit) - k)[len(hit) - k]
            hit = hit[sums[hit] >= least - 1e-11]
        cosine = np.round(sums[hit], 12)
        return sorted(zip(hit.tolist(), cosine.tolist(), strict=True), key=lambda b: (-b[1], self.rank[b[0]]))[:k]

    def vote(self, near: list[tuple[int, float]]) -> float:
        w = np.array([1 / (1.05 - c) for _, c in near])
        return float((w @ self.toxic[[p for p, _ in near]] + self.prior) / (w.sum() + 1))

    def calibrated(self, vote: float, steps: tuple[np.ndarray, np.ndarray] | None = None) -> float:
        return min(1.0, max(0.0, float(np.interp(vote, *(steps or self.steps)))))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing steps by pooling neighbours that go down; each pool's mean is drawn a little to the middle."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum of y, n, sum of x
    for a, b in zip(x[order], y[order], strict=True):
        pools.append([float(b), 1.0, float(a)])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[1] for p in pools]), np.array([(p[0] + 0.5) / (p[1] + 1) for p in pools])


def _labelled(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str, text: str, label: str, max_labelled: int) -> DataFrame:
    rows = labels.filter(F.col(label).isNotNull() & learn).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("_toxic"))
    rows = cut(rows.filter(F.col("_id").isNotNull()))
    share = min(1.0, max_labelled / max(1, rows.count()))
    some = rows.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < F.lit(math.ceil(share * (1 << 20))))
    # About max_labelled pairs of numbers: a bounded side.
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text"))
    return texts.join(F.broadcast(some), "_id").dropDuplicates(["_id"])


def relevances(n: np.ndarray, bad: np.ndarray, total: int, total_bad: int) -> np.ndarray:
    """sqrt(1 + G) of terms that occur in `bad` toxic examples of `n`, more than the labels' share would give; else 1."""
    share = total_bad / max(1, total)
    good, log = n - bad, lambda a, b: np.where(a > 0, a * np.log(np.maximum(a, 1) / np.maximum(b, 1e-300)), 0.0)
    gain = 2 * (log(bad, n * share) + log(good, n * (1 - share)))
    return np.sqrt(1 + np.where(bad > n * share, np.maximum(gain, 0), 0.0))


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", k: int = 16, block: int = 64, max_labelled: int = MAX_LABELLED, relevance: bool = True) -> Index:
    """The index. learn: a condition on the labels' rows; the others are never looked at."""
    rows = _labelled(docs, labels, F.lit(True) if learn is None else learn, doc_id, text, label, max_labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [count_terms(t) for t in b.column("_text").to_pylist()]
            columns = [b.column("_id").cast(pa.string()), b.column("_toxic"), pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "toxic", "terms", "counts"])

    spread_out = rows.select("_id", "_text", "_toxic").repartition(docs.sparkSession.sparkContext.defaultParallelism)  # bounded rows
    made = cut(spread_out.mapInArrow(run, "id string, toxic int, terms array<string>, counts array<bigint>"))
    index = build(made.toArrow(), block, relevance)  # about max_labelled rows
    if len(index.ids) >= 20:
        index.steps = isotonic(*_votes(made, index, k))
    return index


def _votes(made: DataFrame, index: Index, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each example's vote by the others, and its label."""
    held = index.shared(made.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = held.value
        place = {own: i for i, own in enumerate(x.ids.tolist())}
        for b in batches:
            votes, toxic = [], []
            for own, label, terms, counts in zip(*[b.column(c).to_pylist() for c in ("id", "toxic", "terms", "counts")], strict=True):
                if terms:
                    at, n = np.array([x.terms[t] for t in terms], np.int64), np.array(counts, np.float64)
                    sort = np.argsort(at)
                    near = x.nearest(at[sort], x.vector(at[sort], n[sort]), k, leave=place[own])
                    votes.append(x.vote(near) if near else x.prior)
                    toxic.append(float(label > 0))
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), pa.array(toxic, pa.float64())], ["vote", "toxic"])

    out = made.repartition(made.sparkSession.sparkContext.defaultParallelism, "id").mapInArrow(run, "vote double, toxic double").toArrow()
    votes, toxic = out.column("vote").to_numpy(), out.column("toxic").to_numpy()
    order = np.lexsort((toxic, votes))
    return votes[order], toxic[order]


def build(examples: pa.Table, block: int = 64, relevance: bool = True) -> Index:
    """The index of examples: id, toxic, terms, counts."""
    lists = examples.column("terms").combine_chunks()
    coded = lists.flatten().dictionary_encode()
    vocabulary, term = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    count = examples.column("counts").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    ids, toxic = np.array(examples.column("id").to_pylist(), object), (examples.column("toxic").to_numpy() > 0).astype(float)
    total, row = len(ids), np.repeat(np.arange(len(ids)), size)
    n = np.bincount(term, minlength=len(vocabulary)).astype(float)
    weights = np.log((total + 1) / (n + 1)) + 1
    if relevance:
        weights = weights * relevances(n, np.bincount(term, toxic[row], minlength=len(vocabulary)), total, int(toxic.sum()))
    # Examples with terms, by label and then by which of the most common terms they have.
    common = np.argsort(-n, kind="stable")[:48]
    marks = np.zeros((total, len(common)), bool)
    for j, t in enumerate(common):
        marks[row[term == t], j] = True
    order = sorted(np.flatnonzero(size > 0).tolist(), key=lambda i: (-toxic[i], marks[i].tobytes(), ids[i]))
    place = np.full(total, -1)
    place[order] = np.arange(len(order))
    w = (1 + np.log(np.maximum(count, 1))) * weights[term]
    w = w / np.maximum(np.sqrt(np.bincount(row, w * w, minlength=total)), 1e-300)[row]
    line = np.full(len(vocabulary), -1)
    line[np.argsort(-n, kind="stable")[:COMMON]] = np.arange(min(COMMON, len(vocabulary)))
    often = line[term] >= 0
    matrix = np.zeros((min(COMMON, len(vocabulary)), len(order)))
    matrix[line[term[often]], place[row[often]]] = w[often]
    term, row, w = term[~often], row[~often], w[~often]
    sort = np.lexsort((place[row], term))
    term, at, w = term[sort], place[row][sort], w[sort]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (at[1:] // block != at[:-1] // block)
    starts = np.flatnonzero(new)
    tops = np.maximum.reduceat(w, starts) if len(starts) else w
    entries = np.searchsorted(term[starts], np.arange(len(vocabulary) + 1))
    own = ids[order]
    rank = np.empty(len(order), np.int64)
    rank[sorted(range(len(order)), key=lambda i: own[i])] = np.arange(len(order))
    index = Index(
        terms=dict(zip(vocabulary, range(len(vocabulary)), strict=True)), weights=weights, ids=own, toxic=toxic[order], block=block,
        entries=entries.astype(np.int32), blocks=(at[starts] // block).astype(np.int32), tops=np.nextafter(tops.astype(np.float32), np.float32(2)),
        postings=np.append(starts, len(term)).astype(np.int32), places=at.astype(np.int32), values=w.astype(np.float32), rank=rank, row=line.astype(np.int32), matrix=matrix.astype(np.float32),
    )
    if total:
        index.prior = float((toxic.sum() + 0.5) / (total + 1))
        index.empty = float((toxic[size == 0].sum() + 0.5) / ((size == 0).sum() + 1))
    return index


def score(df: DataFrame, index: Index, k: int = 16, text: str = "text", names: tuple[str, str] = ("score", "evidence"), keep: list[str] | None = None) -> DataFrame:
    """df's columns (or those in keep), score, and the neighbours as array<struct<id, cosine, toxic>>."""
    held, steps = index.shared(df.sparkSession), index.steps
    taken = {n.lower() for n in names}
    rows = df.select(*[F.col(f"`{c}`") for c in (df.columns if keep is None else keep) if c.lower() not in taken], F.col(f"`{text}`").cast("string").alias("_text_to_score"))
    kept = rows.schema.fields[:-1]
    neighbour = T.StructType().add("id", "string").add("cosine", "double").add("toxic", "integer")
    schema = T.StructType([*kept]).add(names[0], "double").add(names[1], T.ArrayType(neighbour))
    shape = pa.list_(pa.struct([("id", pa.string()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = held.value
        words = Words(x.terms)
        for b in batches:
            scores, evidence = [], []
            for start in range(0, b.num_rows, 64):
                vectors = []
                for terms, own in words.count(b.column(len(kept)).slice(start, 64).to_pylist()):
                    vectors.append((terms, x.vector(terms, own)))
                base = x.common(vectors) if len(x.ids) else None
                for i, (terms, w) in enumerate(vectors):
                    near = x.nearest(terms, w, k, base=base[i]) if len(terms) else []
                    scores.append(x.calibrated(x.vote(near), steps) if near else x.empty)
                    evidence.append([{"id": x.ids[p], "cosine": c, "toxic": int(x.toxic[p])} for p, c in near])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64()), pa.array(evidence, shape)], [*[f.name for f in kept], *names])

    return spread(rows).mapInArrow(run, schema)
