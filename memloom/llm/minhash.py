"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

Each text's set of word shingles is hashed to places on a circle of `circle` positions, which a first permutation shuffles;
a second permutation, shifted by 1, 2, 3 ... places, gives all signature coordinates. Bands of `rows` coordinates name
buckets. With 40 bands of 6 rows, a pair at the threshold of 0.8 shares no bucket with probability 5e-6, and less above it.

Texts with one and the same shingle set form a class, and only its smallest id takes part in the search, so exact copies
cost one row each. Links are found in two rounds. First every member of a bucket is compared with the bucket's least
member and, in larger buckets, with the least of a few members drawn by hash; linked ones are joined to components. Then, in buckets that still hold several components, all pairs of members
from different components are compared, in blocks of bounded size and in the first bucket that they share: those whose
signatures agree in too few coordinates to reach the threshold (by six standard deviations) are passed over; what is left
of a block gets its full sets, which are compared inside the task, and only links that join two components become rows. So
every pair that shares a bucket is either compared or already connected, and no pairs are written out.

Defined cases: null and empty texts have no shingles and are linked with nothing; texts shorter than a shingle have one,
the whole sequence; rows with one doc_id and different texts are searched separately but share a component; rows without
doc_id stay alone; an empty table gives an empty table; extra columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spread
from .components import components

BANDS, ROWS, CIRCLE, SEED = 40, 6, 1 << 20, 20_240
BLOCK = 512
#: Members of a draw in a larger bucket; ids that are broadcast at most, beyond them texts are looked up by a shuffle.
DRAW, BROADCAST_IDS = 8, 4_000_000
#: Sets compared at once with another.
SOME = 64
RUN = ("bucket", "answer", "ask")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_tables: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | bytes | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of the text with A-Z in lower case."""
    raw = text.encode() if isinstance(text, str) else text or b""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(n, len(words))
    out = np.full(len(words) - size + 1, np.uint64(size))
    for k in range(size):
        out = _mixed(out * _FACTOR + h[k : len(words) - size + 1 + k])
    return np.unique(out)


def signature(marks: np.ndarray, width: int, circle: int = CIRCLE, seed: int = SEED) -> np.ndarray:
    """Circulant MinHash: coordinate k is the least second-permutation value, shifted by k, over the set's places."""
    key = (width, circle, seed)
    if key not in _tables:
        draw = np.random.default_rng(seed)
        first, second = draw.permutation(circle).astype(np.int64), draw.permutation(circle).astype(np.uint32)
        _tables[key] = first, np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[:width]]), width)
    first, shifted = _tables[key]
    places = first[(marks % np.uint64(circle)).astype(np.int64)]
    out = shifted[places[:2048]].min(axis=0)
    for i in range(2048, len(places), 2048):
        np.minimum(out, shifted[places[i : i + 2048]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.arange(bands, dtype=np.uint64)
    grid = sig.reshape(bands, rows).astype(np.uint64)
    for k in range(rows):
        out = _mixed(out * _FACTOR + grid[:, k])
    return out.view(np.int64)


def _sketch(df: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, class_key (null without shingles), keys of the bands, signature (a byte a coordinate)."""
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                size, cls, keys, sigs = [], [], [], []
                for t in b.column(1).cast(pa.binary()).to_pylist():
                    marks = shingles(t, n)
                    size.append(len(marks))
                    cls.append(xxhash.xxh3_128_digest(marks.tobytes()) if len(marks) else None)
                    sig = signature(marks, bands * rows) if len(marks) else None
                    keys.append(band_keys(sig, bands, rows) if sig is not None else np.zeros(0, np.int64))
                    sigs.append(sig.astype(np.uint8).tobytes() if sig is not None else None)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(cls, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "class_key", "keys", "sig"])

    return spread(df).mapInArrow(run, f"doc_id {kind}, n_shingles long, class_key binary, keys array<long>, sig binary")


def _sets(df: DataFrame, n: int) -> DataFrame:
    """doc_id and the set as array<long>."""
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                own = [shingles(t, n).view(np.int64) for t in b.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.list_(pa.int64()))], ["doc_id", "marks"])

    return df.mapInArrow(run, f"doc_id {kind}, marks array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    left, right = (sets.select(F.col("doc_id").alias(c), F.col("marks").alias(f"{c}_marks")) for c in "ab")
    sized = pairs.join(left, "a").join(right, "b")
    both = F.size(F.array_intersect("a_marks", "b_marks"))
    return sized.select("a", "b", both.alias("i"), (F.size("a_marks") + F.size("b_marks") - both).alias("u")).filter(F.col("i") * 100 >= F.col("u") * percent).select("a", "b")


def _need(width: int, percent: int) -> int:
    """Coordinates that agree at least, if the similarity reaches the threshold."""
    p = percent / 100
    return int(max(0.0, p - 6 * (p * (1 - p) / width) ** 0.5) * width)


def _alike(pairs: DataFrame, signatures: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree in enough coordinates."""
    kind, need = pairs.schema["a"].dataType.simpleString(), _need(width, percent)
    left, right = (signatures.select(F.col("node").alias(c), F.col("sig").alias(f"{c}_sig")) for c in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (_grid(b.column(i), width) for i in (2, 3))
            near = pa.array((x == y).sum(axis=1) >= need)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(near), b.column(1).filter(near)], ["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "a_sig", "b_sig").mapInArrow(run, f"a {kind}, b {kind}")


def _grid(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each run of equal RUN columns; the last run of a batch may go on in the next."""
    held: pa.Table | None = None
    for b in batches:
        now = pa.Table.from_batches([b])
        if held is not None:
            now = pa.concat_tables([held, now]).combine_chunks()
        key = np.stack([now.column(c).to_numpy() for c in RUN], axis=1)
        starts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist()]
        for i, j in zip(starts, starts[1:], strict=False):
            yield now.slice(i, j - i)
        held = now.slice(starts[-1])
    if held is not None and held.num_rows:
        yield held


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of lists, and the lists' lengths."""
    one = column.combine_chunks()
    one = one if isinstance(one, pa.Array) else pa.concat_arrays(one.chunks)
    return one.flatten().to_numpy(), pc.list_value_length(one).to_numpy().astype(np.int64)


def _candidates(run: pa.Table, width: int, need: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each asking row of a run, and the answering rows of other roots whose signatures nearly agree with its own and
    whose first common bucket is this one."""
    asks, root = run.column("asks").to_numpy(), run.column("root").to_numpy()
    sig, keys = _grid(run.column("sig"), width), _lists(run.column("keys"))[0].reshape(run.num_rows, -1)
    bucket, to = run.column("bucket")[0].as_py(), np.flatnonzero(~asks)
    for i in np.flatnonzero(asks).tolist():
        others = to[root[to] != root[i]]
        found = others[(sig[others] == sig[i]).sum(axis=1) >= need]
        if len(found):
            first = (keys[found] == keys[i]).argmax(axis=1)
            found = found[keys[i][first] == bucket]
        if len(found):
            yield i, found


def _dealt(rows: DataFrame, block: int) -> DataFrame:
    """bucket, answer, ask, asks, node, root, sig, keys: members outside the bucket's largest component ask, all members
    answer; both are dealt into blocks, so that a run of equal (bucket, answer, ask) holds two blocks at most."""
    counts = rows.groupBy("bucket", "root").agg(F.count("*").alias("k"))
    leads = counts.groupBy("bucket").agg(F.max_by("root", F.struct("k", "root")).alias("lead"), F.sum("k").alias("n"), F.max("k").alias("most"))
    all_rows = rows.join(leads, "bucket").withColumn("answers", F.ceil(F.col("n") / block).cast("int")).withColumn("asks", F.ceil((F.col("n") - F.col("most")) / block).cast("int"))
    deal = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asking = all_rows.filter("root != lead").select("bucket", every(F.col("answers")).alias("answer"), deal(F.col("asks")).alias("ask"), F.lit(True).alias("asks"), "node", "root", "sig", "keys")
    answering = all_rows.select("bucket", deal(F.col("answers")).alias("answer"), every(F.col("asks")).alias("ask"), F.lit(False).alias("asks"), "node", "root", "sig", "keys")
    return asking.unionByName(answering)


def _in_runs(rows: DataFrame) -> DataFrame:
    return rows.repartition(*RUN).sortWithinPartitions(*RUN)


def _close(rows: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """The dealt rows that have a candidate in their run, asking or answering. rows: bucket, node, root, sig, keys."""
    dealt, need = _dealt(rows, block), _need(width, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _runs(batches):
            used = np.zeros(own.num_rows, bool)
            for i, found in _candidates(own, width, need):
                used[i] = True
                used[found] = True
            if used.any():
                yield from own.filter(pa.array(used)).combine_chunks().to_batches()

    return _in_runs(dealt).mapInArrow(run, dealt.schema)


def _links(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between roots, from the rows of _close with their sets (marks). Inside a run a candidate is passed over
    once its root is joined to the asking row's, so a run gives fewer links than it has roots."""
    kind, need = rows.schema["node"].dataType.simpleString(), _need(width, percent)

    def inside(own: pa.Table) -> Iterator[tuple]:
        node, (_, group) = own.column("node").to_pylist(), np.unique(own.column("root").to_numpy(), return_inverse=True)
        marks, size = _lists(own.column("marks"))
        marks, at = marks.view(np.uint64), np.concatenate([[0], np.cumsum(size)])
        for i, found in _candidates(own, width, need):
            mine = marks[at[i] : at[i + 1]]
            found = found[100 * np.minimum(size[found], size[i]) >= percent * np.maximum(size[found], size[i])]
            for step in range(0, len(found), SOME):
                some = found[step : step + SOME]
                some = some[group[some] != group[i]]
                if not len(some):
                    continue
                theirs = np.concatenate([marks[at[j] : at[j + 1]] for j in some.tolist()])
                place = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
                both = np.add.reduceat((mine[place] == theirs).astype(np.int64), np.concatenate([[0], np.cumsum(size[some])[:-1]]))
                for j in some[100 * both >= percent * (size[some] + size[i] - both)].tolist():
                    if group[j] != group[i]:
                        group[group == group[j]] = group[i]
                        yield max(node[i], node[j]), min(node[i], node[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _runs(batches):
            if links := list(inside(own)):
                yield pa.RecordBatch.from_arrays([pa.array(x, own.schema.field("node").type) for x in zip(*links, strict=True)], ["a", "b"])

    return _in_runs(rows).mapInArrow(run, f"a {kind}, b {kind}").distinct()


def near_duplicates(df: DataFrame, n: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: doc_id, n_shingles, component_id (the smallest doc_id reachable), kept (doc_id is it)."""
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    sketch = cut(_sketch(docs, n, bands, rows))
    known = sketch.filter(F.col("doc_id").isNotNull() & F.col("class_key").isNotNull())
    first = F.min_by(F.struct("keys", "sig"), "doc_id")
    classes = cut(known.groupBy("class_key").agg(F.min("doc_id").alias("rep"), first.alias("own"), F.count("*").alias("size")).select("class_key", "rep", "own.*", "size"))
    signatures = classes.select(F.col("rep").alias("node"), "sig")
    exploded = classes.select(F.col("rep").alias("node"), F.explode("keys").alias("bucket"))
    crowded = exploded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("least")).filter("n > 1")
    members = cut(exploded.join(crowded, "bucket"))
    drawn = members.filter(F.col("n") > DRAW).withColumn("draw", F.pmod(F.xxhash64("node", "bucket"), F.ceil(F.col("n") / DRAW)))
    centres = drawn.groupBy("bucket", "draw").agg(F.min("node").alias("centre"))
    stars = members.select("node", "least").unionByName(drawn.join(centres, ["bucket", "draw"]).select("node", F.col("centre").alias("least")))
    stars = cut(stars.filter("node > least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct())
    repeated = not known.groupBy("doc_id").count().filter("count > 1").isEmpty()

    def sets_of(ids: DataFrame) -> DataFrame:
        """The sets of the ids' texts, read again whole."""
        wanted = cut(ids.toDF("doc_id").distinct())
        texts = docs.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "doc_id", "left_semi")
        if repeated:  # else there is nothing to drop
            texts = texts.dropDuplicates(["doc_id", "text"])
        return cut(_sets(texts, n))

    near = cut(_alike(stars, signatures, bands * rows, percent))
    linked = cut(_verified(near, sets_of(near.select("a").unionByName(near.select(F.col("b").alias("a")))), percent))
    roots = components(linked)
    # Second round: buckets that hold members of several components.
    named = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = named.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("bucket")
    rest = named.join(split, "bucket", "left_semi").select("bucket", "node", "root").join(classes.select(F.col("rep").alias("node"), "sig", "keys"), "node")
    close = cut(_close(rest, bands * rows, percent, block))
    marks = sets_of(close.select("node")).select(F.col("doc_id").alias("node"), "marks")
    more = _links(close.join(marks, "node"), bands * rows, percent)
    # An id that occurs with several texts is one node.
    several = known.groupBy("doc_id").agg(F.min("class_key").alias("low"), F.max("class_key").alias("high")).filter("low < high").select("doc_id")
    twice = known.join(several, "doc_id", "left_semi").join(classes.select("class_key", "rep"), "class_key").filter("doc_id > rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    roots = components(linked.unionByName(more).unionByName(twice))
    final = classes.select("class_key", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("class_key", F.coalesce("root", "rep").alias("root"))
    out = sketch.join(final, "class_key", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
