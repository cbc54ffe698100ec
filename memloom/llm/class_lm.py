"""Language-model scores from Brown class-based n-grams.

Tokens are ASCII-lower-cased words and one end a text. The exchange algorithm assigns every word of the training texts to a
class so that the likelihood of the class bigram model rises. The `frequent` most common words are exchanged one by one, over
and over, on the matrix of their bigrams, until none moves. Then all other words are exchanged at once out of the class that
holds them together: with the classes of the common words fixed, what a word adds to the likelihood in each class follows from
how often it stands before and after each class, and it goes where it adds most. These counts are gathered by word over all
texts, so every word of a vocabulary of any size is placed by its own neighbours. The number of classes grows with the fourth
root of the vocabulary. Then

    P(text) = product of P(class | class before) * P(word | class)

with P(c | b) = (n(b, c) + k P(c)) / (n(b) + k) and P(w | c) = (n(w) + 0.1) / (n(c) + 0.1 V(c)). The end has a class of its own,
and so have unknown words, which count as one word; n(b, c) of the latter are those of the words that occur once (Good-Turing).
Both sum to 1.

What is bounded is what a worker holds: the `frequent` words and their matrix, classes by classes, and the `local` most common
words' counts and classes. All counts run over all training texts; counts and classes of the other words reach the texts by a
join on the word's 64-bit hash, which is even, as common words are never in it. A text's classes are held as bytes from
there on.

Defined cases: null and empty texts are a single end; repeated rows count and are scored as often as they occur; a null
doc_id counts as the empty text; without training texts all words are unknown; an empty table gives an empty
table; extra columns of any name are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut, drop_cut, spread

END = b"\n"  # no word has a line break
SMOOTH = 0.1
#: Partial counts that a task holds at most; of neighbours not yet counted, ten times as many.
HELD = 400_000
#: Class numbers: of unknown words (while classes are sought, of words that have none yet), and of the end. The others follow.
OPEN, LAST, FIXED = 0, 1, 2
MOST_CLASSES = 120
#: Added to a class number in a text where the word occurs once in the training texts.
ONCE = 128


def exchange(pairs: np.ndarray, n_classes: int, passes: int | None = None, fixed: int = FIXED) -> np.ndarray:
    """Classes of items 0.. from their bigram counts: the first `fixed` items stay alone in classes of their own. Passes go on
    until no item moves, or for as many as are given."""
    n = len(pairs)
    sizes = pairs.sum(axis=1) + pairs.sum(axis=0)
    free = [i for i in np.argsort(-sizes, kind="stable").tolist() if i >= fixed and sizes[i] > 0]
    k = fixed + n_classes
    cls = np.full(n, fixed, np.int64)
    cls[:fixed] = range(fixed)
    for place, i in enumerate(free):
        cls[i] = fixed + place % n_classes
    pairs = pairs.astype(float)
    one = np.zeros((n, k))
    one[np.arange(n), cls] = 1
    after, before = pairs @ one, pairs.T @ one  # by item: followed by, preceded by a class
    grid = one.T @ after
    out, into = pairs.sum(axis=1), pairs.sum(axis=0)
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    # Less than this may be rounding; as every move raises the likelihood by more, no classes come twice and it ends.
    least = max(1e-9, 1e-13 * float(f(pairs.sum())))
    while passes is None or passes > 0:
        passes, moved = passes and passes - 1, 0
        for i in free:
            a = cls[i]
            r, c, own = after[i].copy(), before[i].copy(), pairs[i, i]
            r[a] -= own
            c[a] -= own
            # Without item i.
            grid[a] -= r
            grid[:, a] -= c
            grid[a, a] -= own
            # How often classes stand before and after any word, item i among them.
            rows, cols = grid.sum(axis=1) + c, grid.sum(axis=0) + r
            # What joining class b adds to the likelihood.
            now = f(grid)
            gain = (f(grid + r) - now).sum(axis=1) + (f(grid + c[:, None]) - now).sum(axis=0)
            d = np.diagonal(grid)
            gain += f(d + r + c + own) - f(d + r) - f(d + c) + f(d)
            gain -= f(rows + out[i]) - f(rows) + f(cols + into[i]) - f(cols)
            gain[:fixed] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + least:
                b = int(a)
            grid[b] += r
            grid[:, b] += c
            grid[b, b] += own
            if b != a:
                moved += 1
                cls[i] = b
                after[:, a] -= pairs[:, i]
                after[:, b] += pairs[:, i]
                before[:, a] -= pairs[i]
                before[:, b] += pairs[i]
        if not moved:
            break
    return cls


def likelihood(pairs: np.ndarray, classes: np.ndarray) -> float:
    """Log-likelihood of the class bigram model, but for what doesn't hang on the classes."""
    one = np.zeros((len(pairs), int(classes.max()) + 1))
    one[np.arange(len(pairs)), classes] = 1
    grid = one.T @ pairs @ one
    f = lambda x: float((x * np.log(np.maximum(x, 1e-300))).sum())
    return f(grid) - f(grid.sum(axis=0)) - f(grid.sum(axis=1))


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def word_key(word: bytes) -> int:
    """What xxhash64 gives for the word in a DataFrame."""
    n = xxhash.xxh64_intdigest(word, 42)
    return n - (1 << 64) if n >= 1 << 63 else n


def count_words(texts: DataFrame) -> DataFrame:
    """word (binary), n over the column text; END's n is the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return b

        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                held.update(_words(t))
                held[END] += 1
                if len(held) > HELD:
                    yield out()
        yield out()

    return spread(texts).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _pairs(texts: DataFrame, items: dict[bytes, int]) -> np.ndarray:
    """Bigram counts of items; 0 stands for all other words, 1 for the end."""
    size = len(items) + FIXED
    held = texts.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, own = held.value.get, np.zeros(size * size, np.int64)
        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                at = np.array([LAST, *[get(w, OPEN) for w in _words(t)], LAST], np.int64)
                code, n = np.unique(at[:-1] * size + at[1:], return_counts=True)
                own[code] += n
        code = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(own[code], pa.int64())], ["code", "n"])

    grid = np.zeros((size, size))
    # At most size * size numbers.
    for b in spread(texts).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow().to_batches():
        grid.ravel()[b.column(0).to_numpy()] = b.column(1).to_numpy()
    return grid


def common_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most common words of counts and how often they occur: whole levels of counts from the top, `most` words at most.

    A histogram of at most 4,096 levels (64 an octave, so small counts have one each) gives the lowest level first; so what
    reaches the driver is bounded by `most`, however many partitions counts has.
    """
    level = F.floor(F.log2(F.col("n").cast("double")) * 64)
    total, lowest = 0, None
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        total += r["count"]
        if total > most:
            break
        lowest = r["level"]
    if lowest is None:
        return []
    return [(bytes(r["word"]), r["n"]) for r in counts.filter(level >= lowest).select("word", "n").collect()]


class Numbers(dict):
    """Numbers of words: those given, and 1, 2 ... for others as they come."""

    def __init__(self, given: dict[bytes, int]) -> None:
        super().__init__(given)
        self.given, self.new = given, []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = n = len(self.new)
        return n

    def forget(self) -> None:
        self.clear()
        self.__init__(self.given)


def neighbours(texts: DataFrame, items: dict[bytes, int], classes: np.ndarray) -> DataFrame:
    """Of every word that isn't an item, how often it has a class before and after it: key, left, right, n. A row counts both
    sides, or one with the other at -1, whichever makes fewer rows."""
    k = int(classes.max()) + 1
    held = texts.sparkSession.sparkContext.broadcast((items, classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        its, cls = held.value
        number = Numbers({w: -i for w, i in its.items()})
        parts: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            new = number.new
            if not new:
                return
            keys = np.fromiter(map(word_key, new), np.int64, len(new))
            both, n_both = np.unique(np.concatenate(parts), return_counts=True)
            word, left, right = both // (k * k), both // k % k, both % k
            sides, at = np.unique(np.concatenate([word * 2 * k + left, word * 2 * k + k + right]), return_inverse=True)
            n_sides = np.bincount(at, np.concatenate([n_both, n_both])).astype(np.int64)
            single = np.bincount(word, minlength=len(new)) > np.bincount(sides // (2 * k), minlength=len(new))
            p, q = ~single[word], single[sides // (2 * k)]
            side = sides[q] % (2 * k)
            columns = [
                np.concatenate([keys[word[p]], keys[sides[q] // (2 * k)]]),
                np.concatenate([left[p], np.where(side < k, side, -1)]).astype(np.int16),
                np.concatenate([right[p], np.where(side < k, -1, side - k)]).astype(np.int16),
                np.concatenate([n_both[p], n_sides[q]]),
            ]
            number.forget()
            parts.clear()
            for i in range(0, len(columns[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in columns], ["key", "left", "right", "n"])

        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                ids = [-LAST]
                for t in whole.column(0).slice(start, 500).cast(pa.binary()).to_pylist():
                    ids.extend(map(number.__getitem__, _words(t)))
                    ids.append(-LAST)
                # Items are numbers below 0, other words from 1.
                at = np.array(ids, np.int64)
                known = np.where(at < 0, cls[np.maximum(-at, 0)], OPEN)
                place = np.flatnonzero(at > 0)
                parts.append(((at[place] - 1) * k + known[place - 1]) * k + known[place + 1])
                if len(number.new) > HELD or sum(map(len, parts)) > 10 * HELD:
                    yield from out()
        yield from out()

    return spread(texts).mapInArrow(run, "key long, left short, right short, n long")


class Gains:
    """What words add to the likelihood in each class, from how often they stand before and after classes."""

    def __init__(self, grid: np.ndarray) -> None:
        self.k = len(grid)
        #: Row c: class c before the word's class; row k + c: after it.
        self.sides = np.concatenate([grid, grid.T])
        self.out, self.into = grid.sum(axis=1), grid.sum(axis=0)
        self.once = self.added(self.sides, 1.0)

    @staticmethod
    def added(x: np.ndarray, n: np.ndarray | float) -> np.ndarray:
        f = lambda v: v * np.log(np.maximum(v, 1e-300))
        return f(x + n) - f(x)

    def best(self, word: np.ndarray, side: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and count of words 0, 1 ... from (word, side, n), sorted by word."""
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        gain = self.once[side]
        more = np.flatnonzero(n > 1)
        gain[more] = self.added(self.sides[side[more]], n[more, None])
        total = np.add.reduceat(n, starts) / 2
        gain = np.add.reduceat(gain, starts, axis=0) - self.added(self.out, total[:, None]) - self.added(self.into, total[:, None])
        gain[:, :FIXED] = -np.inf
        return gain.argmax(axis=1), total.astype(np.int64)


def place_words(seen: DataFrame, grid: np.ndarray) -> DataFrame:
    """key, class, n of every word in seen (of neighbours)."""
    held = seen.sparkSession.sparkContext.broadcast(Gains(grid))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = held.value
        rest = np.zeros((3, 0), np.int64)  # key, side, n of the last word so far

        def placed(own: np.ndarray) -> pa.RecordBatch:
            keys, word = np.unique(own[0], return_inverse=True)
            cls, total = g.best(word, own[1], own[2])
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(cls, pa.int32()), pa.array(total)], ["key", "class", "n"])

        for whole in batches:
            for start in range(0, whole.num_rows, 20_000):
                key, left, right, n = (whole.column(i).slice(start, 20_000).to_numpy().astype(np.int64) for i in range(4))
                l, r = left >= 0, right >= 0
                rows = np.concatenate([rest, [key[l], left[l], n[l]], [key[r], right[r] + g.k, n[r]]], axis=1)
                order = np.lexsort((rows[1], rows[0]))
                rows = rows[:, order]
                new = np.flatnonzero(np.r_[True, (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])])
                rows = np.stack([rows[0, new], rows[1, new], np.add.reduceat(rows[2], new)])
                done = rows[0] != key[-1]
                rest = rows[:, ~done]
                if done.any():
                    yield placed(rows[:, done])
        if rest.shape[1]:
            yield placed(rest)

    return seen.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, class int, n long")


@dataclass
class Model:
    """Words that workers hold (number, counts, classes), and the lexicon of all others: key, class, n."""

    held: dict[bytes, int]
    counts: np.ndarray
    classes: np.ndarray
    n_classes: int
    ends: int
    tokens: int
    vocabulary: int
    below: np.ndarray  # log10 of the denominators of P(word | class)
    lexicon: DataFrame


def fit(df: DataFrame, counts: DataFrame, text: str = "text", frequent: int = 1000, n_classes: int | None = None, local: int = 200_000) -> Model:
    """df: the training texts; counts: of count_words over them."""
    texts = df.select(F.col(text).cast("string").alias("text"))
    whole = counts.agg(F.sum("n"), F.count("*")).first()
    words = counts.filter(F.col("word") != F.lit(END))
    head = [(bytes(r["word"]), r["n"]) for r in words.orderBy(F.desc("n"), "word").limit(frequent).collect()]
    items = {w: i + FIXED for i, (w, _) in enumerate(head)}
    pairs = _pairs(texts, items)
    wanted = n_classes or round(1.5 * max(1, whole[1]) ** 0.25)
    classes = exchange(pairs, max(4, min(MOST_CLASSES - FIXED, wanted)))
    k = int(classes.max()) + 1
    one = np.zeros((len(classes), k))
    one[np.arange(len(classes)), classes] = 1
    lexicon = cut(place_words(neighbours(texts, items, classes), one.T @ pairs @ one))
    sums = np.zeros((2, k))
    np.add.at(sums[0], classes[FIXED:], [n for _, n in head])
    np.add.at(sums[1], classes[FIXED:], 1)
    for r in lexicon.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # at most k rows
        sums[0, r["class"]] += r["n"]
        sums[1, r["class"]] += r["v"]
    ends = counts.filter(F.col("word") == F.lit(END)).agg(F.sum("n")).first()[0] or 0
    sums[:, OPEN], sums[:, LAST] = (0, 1), (ends, 1)
    near = common_words(words, local)
    known = {w: classes[items[w]] for w, _ in head}
    # At most `local` keys, and their classes.
    keys = df.sparkSession.createDataFrame(pa.table({"key": pa.array([word_key(w) for w, _ in near if w not in items], pa.int64())})) if near else None
    placed = {}
    if keys is not None:
        for b in lexicon.join(F.broadcast(keys), "key").select("key", "class").toArrow().to_batches():
            placed.update(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    near = list({**dict(near), **dict(head)}.items())
    cls = np.array([known[w] if w in known else placed[word_key(w)] for w, _ in near], np.int64)
    below = np.log10(np.maximum(sums[0] + SMOOTH * sums[1], SMOOTH))
    return Model({w: i for i, (w, _) in enumerate(near)}, np.array([n for _, n in near], np.int64), cls, k, ends, whole[0] or 0, whole[1] or 0, below, lexicon)


def classed(rows: DataFrame, model: Model) -> DataFrame:
    """rows: row_id, doc_id, train, text. Adds n_tokens, n_known, logs (sum of log10(count + 0.1)), and seq, a byte a token: its
    class, and ONCE if it occurs once."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    held = rows.sparkSession.sparkContext.broadcast((model.held, model.counts, model.classes, model.ends))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, counts, classes, ends = held.value
        get = number.get
        logs = np.log10(counts + SMOOTH)
        code = np.where(counts == 1, classes + ONCE, classes).astype(np.int64)
        end_log, base = float(np.log10(ends + SMOOTH)), 256
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                b = whole.slice(start, 1000)
                n, known, sums, seqs, keys, times = [], [], [], [], [], []
                for t in b.column(3).cast(pa.binary()).to_pylist():
                    rare: dict[bytes, int] = {}
                    ids = np.array([i if (i := get(w)) is not None else -1 - rare.setdefault(w, len(rare)) for w in _words(t)], np.int64)
                    near = ids >= 0
                    at = ids[near]
                    seq = np.empty(len(ids), np.int64)
                    seq[near] = code[at]
                    seq[~near] = base - 1 - ids[~near]
                    n.append(len(ids) + 1)
                    known.append(len(at) + (ends > 0))
                    sums.append(float(logs[at].sum()) + end_log)
                    seqs.append(seq.astype("<u2" if len(rare) < 65_000 else "<u4").tobytes())
                    keys.append([word_key(w) for w in rare])
                    times.append(np.bincount(-1 - ids[~near], minlength=len(rare)) if rare else np.zeros(0, np.int64))
                ints = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(sums, pa.float64()), pa.array(seqs, pa.binary()), pa.array(keys, ints), pa.array(times, ints)], ["row_id", "doc_id", "train", "n", "known", "logs", "seq", "keys", "times"])

    near = cut(spread(rows).mapInArrow(run, f"row_id long, doc_id {kind}, train boolean, n long, known long, logs double, seq binary, keys array<long>, times array<long>"))
    rare = near.select("row_id", F.posexplode("keys").alias("i", "key")).join(model.lexicon, "key")
    found = rare.groupBy("row_id").agg(F.collect_list(F.struct("i", "class", "n")).alias("found"))  # a text's words
    both = near.drop("keys").join(found.select(F.col("row_id"), F.col("found.i").alias("i"), F.col("found.class").alias("class"), F.col("found.n").alias("c")), "row_id", "left")

    def numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All numbers of a column of lists, and where each row's begin (a null has none)."""
        size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(size)])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                b = whole.slice(start, 1000)
                times, first = numbers(b.column("times"))
                (i, own), (cls, _), (c, _) = (numbers(b.column(x)) for x in ("i", "class", "c"))
                row = np.repeat(np.arange(b.num_rows), np.diff(own))
                count, code = np.zeros(len(times), np.int64), np.full(len(times), OPEN, np.int64)
                count[first[row] + i] = c
                code[first[row] + i] = np.where(c == 1, cls + ONCE, cls)
                rows = np.repeat(np.arange(b.num_rows), np.diff(first))
                known = b.column("known").to_numpy() + np.bincount(rows, times * (count > 0), minlength=b.num_rows).astype(np.int64)
                sums = b.column("logs").to_numpy() + np.bincount(rows, times * np.log10(count + SMOOTH), minlength=b.num_rows)
                seqs = []
                for j, (n, raw) in enumerate(zip(b.column("n").to_pylist(), b.column("seq").to_pylist(), strict=True)):
                    seq = np.frombuffer(raw, "<u2" if len(raw) == 2 * (n - 1) else "<u4").astype(np.int64)
                    seqs.append(np.concatenate([np.arange(256), code[first[j] : first[j + 1]]])[seq].astype(np.uint8).tobytes() + bytes([LAST]))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("train"), b.column("n"), pa.array(known, pa.int64()), pa.array(sums, pa.float64()), pa.array(seqs, pa.binary())], ["doc_id", "train", "n_tokens", "n_known", "logs", "seq"])

    out = cut(both.mapInArrow(finish, f"doc_id {kind}, train boolean, n_tokens long, n_known long, logs double, seq binary"))
    drop_cut(near)
    return out


def moves(texts: DataFrame, n_classes: int, pull: float = 20.0) -> np.ndarray:
    """log10 P(class | class before) from the training texts of classed; words that occur once count for unknown ones too."""
    k = n_classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = np.zeros(k * k, np.int64)
        for b in batches:
            for raw in b.column(0).to_pylist():
                seq = np.frombuffer(raw, np.uint8).astype(np.int64)
                at, once = seq % ONCE, seq >= ONCE
                before = np.r_[LAST, at[:-1]]
                grid += np.bincount(before * k + at, minlength=k * k)
                grid += np.bincount(before[once] * k + OPEN, minlength=k * k)
                after = np.flatnonzero(once[:-1])
                grid += np.bincount(OPEN * k + at[after + 1], minlength=k * k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(grid)], ["code", "n"])

    grid = np.zeros(k * k)
    for r in texts.filter("train").select("seq").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():  # k * k rows
        grid[r["code"]] = r["n"]
    grid = grid.reshape(k, k)
    share = (grid.sum(axis=0) + 1) / (grid.sum() + k)
    return np.log10((grid + pull * share) / (grid.sum(axis=1, keepdims=True) + pull))


def score(texts: DataFrame, model: Model, steps: np.ndarray) -> DataFrame:
    """texts: of classed. doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    held = texts.sparkSession.sparkContext.broadcast((steps, model.below, model.tokens, float(np.log10(model.tokens + SMOOTH * (model.vocabulary + 1)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, below, tokens, level = held.value
        for b in batches:
            n, logs = b.column("n_tokens").to_numpy(), b.column("logs").to_numpy()
            parts = []
            for raw in b.column("seq").to_pylist():
                at = np.frombuffer(raw, np.uint8).astype(np.int64) % ONCE
                parts.append(float((table[np.r_[LAST, at[:-1]], at] - below[at]).sum()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_tokens"), b.column("n_known"), pa.array(np.full(b.num_rows, tokens, np.int64)), pa.array(logs - n * level), pa.array(logs + np.array(parts, float).reshape(-1))], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return texts.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def class_lm(df: DataFrame, doc_id: str = "doc_id", text: str = "text", fold: int = 10, pull: float = 20.0, **sizes) -> DataFrame:
    """Scores of all rows from a model of those whose crc32(doc_id) mod fold is not 0."""
    train = crc_mod(F.col(doc_id), fold) != 0
    texts = df.filter(train)
    counts = cut(count_words(texts.select(F.col(text).cast("string").alias("text"))))
    model = fit(texts, counts, text, **sizes)
    rows = df.select(F.monotonically_increasing_id().alias("row_id"), F.col(doc_id).alias("doc_id"), train.alias("train"), F.col(text).cast("string").alias("text"))
    own = classed(rows, model)
    return score(own, model, moves(own, model.n_classes, pull)).withColumn("held_out", crc_mod(F.col("doc_id"), fold) == 0)
