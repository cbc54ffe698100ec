"""Best-fit packing of tokenised documents into sequences under several capacities at once.

A document's tokens, then one end token, are cut into pieces of at most `max_tokens` only if they are longer. Pieces are
placed in decreasing order of length into the open sequence that fits best: among those with enough residual tokens,
document places and attention cost (the sum of squared piece lengths), the one with the least weighted norm of what
remains ("norm") or the largest weighted dot product of need and residual ("dot"), each capacity as a share of its limit. By
default a sequence holds 128 documents at most, and the three residuals weigh the same; the attention cost of one full piece is
the least limit that lets full pieces in, so that it binds for these.

Pieces are dealt by hash into shards of about `shard_pieces`, each packed by one task, so memory is bounded. Sequences with
more than a 64th of their tokens free are opened again and their pieces dealt anew, round by round, until one shard holds what
is left, or half of the pieces or more stay in such sequences; so the number of sequences doesn't hang on the shards.

Tokens are found word by word where the tokenizer drops white space and never looks across it, so that a word's ids don't hang
on its neighbours; each worker keeps a bounded table of the words it has met. `Cuts` finds out by trying whether a tokenizer does
that, and which letters may be cut from a comma or stop after them; with any other tokenizer whole texts are encoded.

Defined cases: null and empty texts are one end token; repeated rows are packed separately; a null doc_id is kept; an empty
table gives an empty table; extra columns of any name are ignored.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spread

#: Words that a worker keeps at most.
KNOWN_WORDS = 1_000_000
_cuts: dict[str, Cuts] = {}


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence, and the weights of their residuals."""

    max_tokens: int = 4096
    max_docs: int = 128
    max_cost: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    rule: str = "norm"


class Cuts:
    """A tokenizer, and where words may be cut for it."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        some = ["a", "Zoo", "x1", "it's", "\u00e9t\u00e9", "end.", "<|a|>", "\u4e2d\u6587"]
        one = [self.encode([w])[0] for w in some]
        self.by_word = all(self.encode([space.join((a, b))])[0] == x + y for space in (" ", "\n", "  ", "\t") for a, x in zip(some, one, strict=True) for b, y in zip(some, one, strict=True))
        # Letters that, last in a word, don't hinder a cut before a comma or stop, and are the same in lower case if ASCII.
        self.stems: set[str] = set()
        if self.by_word:
            ends = dict(zip(",.", self.encode([",", "."]), strict=True))
            for c in map(chr, range(0x250)):
                if c.isalpha():
                    forms = [f"{before}{c}" for before in ("", "AL", "b")]
                    low = self.encode([f.encode().lower().decode() for f in forms])
                    if low == self.encode(forms) and all(self.encode([f + e for f in forms]) == [x + ends[e] for x in low] for e in ",."):
                        self.stems.add(c)
        self.last = self._last()

    def _last(self) -> np.ndarray | None:
        """Of each id, whether it ends a word, where the tokenizer marks that and no letter of `stems` hinders it."""
        mark = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if not mark or any(self.stems.issuperset(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()):
            return None
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        last = np.zeros(max(vocabulary.values()) + 1, bool)
        last[[i for t, i in vocabulary.items() if t.endswith(mark)]] = True
        each = [last[np.frombuffer(ids, "<u4")] for ids in self.encode(sorted(self.stems))]
        return last if all(x.sum() == 1 and x[-1] for x in each) else None

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids. Words of letters of `stems` are encoded many at once and told apart by the ids that end a word."""
        texts = [w.decode() for w in words]
        out: dict[str, bytes] = {}
        if self.last is not None:
            plain = [t for t in texts if t and self.stems.issuperset(t)]
            groups = [plain[i : i + 500] for i in range(0, len(plain), 500)]
            for group, ids in zip(groups, self.encode([" ".join(g) for g in groups]), strict=True):
                ends = 4 * (np.flatnonzero(self.last[np.frombuffer(ids, "<u4")]) + 1)
                # Each word has one such id at least, so as many as words are one each.
                if len(ends) == len(group) and ends[-1] == len(ids):
                    ends = ends.tolist()
                    out.update(zip(group, [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
        rest = [t for t in texts if t not in out]
        out.update(zip(rest, self.encode(rest), strict=True))
        return [out[t] for t in texts]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        found = [array("I", e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if sys.byteorder == "big":
            for ids in found:
                ids.byteswap()
        return [ids.tobytes() for ids in found]

    def parts(self, word: bytes) -> tuple[bytes, ...]:
        """The word cut where the tokenizer cuts it in any case: letters, then a final comma or full stop."""
        last = word[-1:]
        if last in (b",", b".") and (stem := word[:-1].decode()) and self.stems.issuperset(stem):
            return (word[:-1].lower(), last)
        return (word.lower(),) if word.isalpha() and self.stems.issuperset(word.decode()) else (word,)

    def ids(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_word:
            return self.encode([t.decode() for t in texts])
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        split = [t.split() for t in texts]
        new = set().union(*split).difference(known) if split else set()
        # A word shares its ids in all its forms.
        whole = {w: self.parts(w) for w in new}
        stems = list({p for parts in whole.values() for p in parts}.difference(known))
        for i in range(0, len(stems), 20_000):
            some = stems[i : i + 20_000]
            known.update(zip(some, self.encode_words(some), strict=True))
        for w, parts in whole.items():
            if len(parts) > 1:
                known[w] = b"".join([known[p] for p in parts])
            elif parts[0] is not w:
                known[w] = known[parts[0]]
        get = known.__getitem__
        return [b"".join(map(get, ws)) for ws in split]


def _ids(texts: list[bytes], path: str) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit numbers."""
    if path not in _cuts:
        _cuts[path] = Cuts(path)
    return _cuts[path].ids(texts)


def pieces(df: DataFrame, tokenizer: str, end_id: int = 1, max_tokens: int = 4096, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    kind = df.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    end, step = np.array([end_id], "<u4").tobytes(), 4 * max_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                keys, texts = batch.column(0), [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
                rows, piece, start, length, crc, own = [], [], [], [], [], []
                for i, ids in enumerate(_ids(texts, tokenizer)):
                    ids += end
                    for j, s in enumerate(range(0, len(ids), step)):
                        part = ids[s : s + step]
                        rows.append(i)
                        piece.append(j)
                        start.append(s // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            own.append(np.frombuffer(part, "<u4").astype("i8"))
                columns = [keys.take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(own, pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return spread(df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    room = np.zeros((3, n + 1))  # residual tokens, places, cost of the open bins
    name, filled, count, opened = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64), 0, 0
    scale = np.array([limits.max_tokens, limits.max_docs, limits.max_cost], float)
    w = np.array(limits.weights, float)
    for i in np.argsort(-lengths, kind="stable"):
        need = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        rest = room[:, :count] - need[:, None]
        fits = np.flatnonzero(rest.min(axis=0) >= 0) if count else ()
        if len(fits):
            if limits.rule == "dot":
                score = -((w / scale**2 * need) @ room[:, fits])
            else:
                score = (w / scale**2) @ (rest[:, fits] ** 2)
            b = fits[int(np.argmin(score))]
        else:
            b, room[:, count], name[count], filled[count] = count, scale, opened, 0
            count, opened = count + 1, opened + 1
        bins[i], offsets[i] = name[b], filled[b]
        room[:, b] -= need
        filled[b] += lengths[i]
        if room[0, b] < 1 or room[1, b] < 1 or room[2, b] < 1:  # full: the last open bin takes its column
            count -= 1
            room[:, b], name[b], filled[b] = room[:, count], name[count], filled[count]
    return bins, offsets


def _round(rows: DataFrame, limits: Limits, shards: int, turn: int) -> DataFrame:
    """Adds sequence_id, offset and poor: whether the sequence has more than a 64th of its tokens free."""
    names = [f.name for f in rows.schema.fields]

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=False, kind="stable", ignore_index=True)
        bins, offsets = best_fit(pdf["length"].to_numpy(), limits)
        free = limits.max_tokens - np.bincount(bins, pdf["length"])
        first = ((turn << 34) + int(pdf["shard"].iloc[0])) << 24
        return pdf.assign(sequence_id=first + bins, offset=offsets, poor=free[bins] > limits.max_tokens // 64)[[*names, "sequence_id", "offset", "poor"]]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", sequence_id long, offset long, poor boolean"
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(turn), "doc_id", "piece", "ids_crc32"), F.lit(shards)))
    return cut(dealt.repartition(min(shards, 4096), "shard").groupBy("shard").applyInPandas(place, schema))


def pack(rows: DataFrame, limits: Limits = Limits(), shard_pieces: int = 8192) -> DataFrame:
    """Adds sequence_id and offset to rows that have doc_id, piece and length (each at most max_tokens)."""
    left = cut(rows)
    n, turn, done = left.count(), 0, []
    while True:
        shards = max(1, -(-n // shard_pieces))
        packed = _round(left, limits, shards, turn)
        poor = packed.filter("poor").count() if shards > 1 else 0
        if not poor or 2 * poor >= n:
            done.append(packed)
            break
        done.append(packed.filter("NOT poor"))
        left, n, turn = packed.filter("poor").drop("sequence_id", "offset", "poor"), poor, turn + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("poor")


def best_fit_packing(df: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = 1, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    return pack(pieces(df, tokenizer, end_id, limits.max_tokens, doc_id, text, with_ids), limits)
