"""WARC archives: records of captures with revisits, and an external merge of their index.

`write` makes one record per capture. Of captures with equal payloads of at least `revisit_from` bytes, the one with the
largest id holds the payload, the others are revisit records that refer to it; smaller payloads are always stored. Spark's
text writer puts the records down, the end of a record being its line separator, so files are plain WARC/1.1 in any
file system that Spark writes to, by default gzipped as wholes (offsets count uncompressed bytes). `read` parses archives record by record by Content-Length.

`histories` builds the index: each archive file gives a run of entries sorted by URL key and timestamp; runs are cut at
common split points, and each slice is merged from all its runs by a loser tree, so tasks hold one slice only and the
result is in global order of (url_key, timestamp, id): `part` numbers the slices in order, `place` the entries in one.

Defined cases: null payloads are empty; null urls give an empty target and URL key; rows with the same id and payload are
separate records, and if that id is the largest, all are responses; a null id is written as an empty record id, sorts
before all others and reads back as null; an empty table gives no archive and no rows; extra columns of any name are
ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir

CRLF = "\r\n"
EPOCH = "2024-01-01T00:00:00Z"
#: Payload bytes for one archive file.
FILE_BYTES = 32 << 20
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
READ = "id string, url string, date string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary, file string, offset long"


def url_key(url: str | None) -> str:
    """Sort-friendly key: host parts turned round, without scheme, port, www, user and fragment."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return (url or "").lower()
    query = "?" + "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}){(parts.path or '/').lower()}{query.lower()}" if host else (url or "").lower()


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 160 bits are 32 digits of 5, read from 8 groups of 20 bits."""
    hexa = F.sha1(payload)
    digits = []
    for g in range(8):
        n = F.conv(F.substring(hexa, 5 * g + 1, 5), 16, 10).cast("int")
        digits += [F.substring(F.lit(_BASE32), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*digits)


def records(df: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", date: Column | None = None, revisit_from: int = 0) -> DataFrame:
    """One row per capture: id, url, date, bytes, digest, refers_to (null: a response), payload."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    stamp = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.to_timestamp(F.lit(EPOCH))) + F.coalesce(F.col(page_id).cast("long"), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'") if date is None else date
    rows = df.select(F.col(page_id).alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"), stamp.alias("date"), F.octet_length(body).cast("long").alias("bytes"), F.sha1(body.cast("binary")).alias("sha1"), body.alias("payload"))
    same = rows.filter(F.col("bytes") >= revisit_from).groupBy("sha1").agg(F.max("id").alias("holder"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # Few digests recur; a hot one is split by the skew join.
    out = rows.join(same, "sha1", "left")
    return out.withColumn("refers_to", F.when(F.coalesce(F.col("id") != F.col("holder"), F.col("id").isNull() & F.col("holder").isNotNull()), F.col("holder")))


def write(rows: DataFrame, path: str, file_bytes: int = FILE_BYTES, compression: str = "gzip") -> str:
    """rows: of `records`. One WARC record each, in files of about file_bytes before compression."""
    head = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    revisit = F.col("refers_to").isNotNull()
    text_id = F.coalesce(F.col("id").cast("string"), F.lit(""))
    digest = base32_sha1(F.col("payload").cast("binary"))
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        head("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        head("WARC-Record-ID", F.concat(F.lit("<urn:capture:"), text_id, F.lit(">"))),
        head("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")),
        head("WARC-Date", F.col("date")),
        head("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        head("WARC-Payload-Length", F.col("bytes").cast("string")),
        F.when(revisit, F.concat(head("WARC-Refers-To", F.concat(F.lit("<urn:capture:"), F.col("refers_to").cast("string"), F.lit(">"))), head("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        head("Content-Type", F.lit("text/html; charset=utf-8")),
        head("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit(CRLF),
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    )
    total = rows.agg(F.sum("bytes"), F.count("*")).first()
    each = max(1, file_bytes * max(1, total[1]) // max(1, (total[0] or 0) + 600 * total[1]))
    # The join on the digest has dealt the rows evenly; a second shuffle of all payloads would gain nothing.
    rows.select(record.alias("value")).write.option("lineSep", CRLF * 2).option("compression", compression).option("maxRecordsPerFile", each).text(path)
    return path


def parse(raw: bytes, file: str) -> Iterator[dict]:
    """Records of one archive."""
    at = 0
    while (end := raw.find(b"\r\n\r\n", at)) >= 0:
        lines = raw[at:end].decode().split(CRLF)
        fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
        length = int(fields["Content-Length"])
        body = raw[end + 4 : end + 4 + length]
        name = re.compile(r"<urn:capture:(.*)>")
        own, other = name.fullmatch(fields["WARC-Record-ID"])[1], fields.get("WARC-Refers-To")
        stored = fields["WARC-Type"] == "response"
        yield {
            "id": own or None, "url": fields.get("WARC-Target-URI", ""), "date": fields["WARC-Date"], "record_type": fields["WARC-Type"], "refers_to": name.fullmatch(other)[1] if other else None,
            "payload_bytes": len(body) if stored else int(fields["WARC-Payload-Length"]),
            "payload_digest": base64.b32encode(hashlib.sha1(body).digest()).decode() if stored else fields["WARC-Payload-Digest"].removeprefix("sha1:"),
            "payload": body if stored else None, "file": file, "offset": at,
        }
        at = end + 4 + length + 4


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all archives under path, as READ says; digests and sizes of responses are taken from the payload read."""
    schema = READ if payloads else READ.replace("payload binary, ", "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, column in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                some: list[dict] = []
                raw = column.as_py()
                for r in parse(gzip.decompress(raw) if file.endswith(".gz") else raw, file.rsplit("/", 1)[-1]):
                    if not payloads:
                        del r["payload"]
                    some.append(r)
                    if len(some) >= 500:
                        yield pa.RecordBatch.from_pylist(some, shape)
                        some = []
                yield pa.RecordBatch.from_pylist(some, shape)

    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    shape = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, schema)


class LoserTree:
    """Merges sorted lists of keys: next() gives the list whose head is the least, ties by list number."""

    def __init__(self, runs: list[list]) -> None:
        self.runs, self.at, k = runs, [0] * len(runs), len(runs)
        self.losers = [-1] * max(1, k)
        for r in range(k):
            self._play(r)

    def _less(self, a: int, b: int) -> bool:
        if a < 0:  # a free place beats all while the tree fills
            return True
        if b < 0:
            return False
        x, y = self.at[a], self.at[b]
        if x >= len(self.runs[a]) or y >= len(self.runs[b]):
            return x < len(self.runs[a]) or (y >= len(self.runs[b]) and a < b)
        p, q = self.runs[a][x], self.runs[b][y]
        return p < q or (p == q and a < b)

    def _play(self, r: int) -> None:
        node = (r + len(self.runs)) // 2
        while node > 0:
            if self._less(self.losers[node], r):
                r, self.losers[node] = self.losers[node], r
            if r < 0:
                return
            node //= 2
        self.losers[0] = r

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(list, place in it), in order."""
        while self.runs:
            r = self.losers[0]
            if self.at[r] >= len(self.runs[r]):
                return
            yield r, self.at[r]
            self.at[r] += 1
            self._play(r)


def histories(entries: DataFrame, slice_rows: int = 50_000) -> DataFrame:
    """Adds url_key, part and place to entries (id, url, date, file, offset and any more): globally ordered captures."""
    keyed = entries.withColumn("url_key", _keys()("url"))
    runs = cut(keyed)
    slices = max(1, -(-runs.count() // slice_rows))
    order = ["url_key", "date", "id", "file", "offset"]
    dealt = runs.repartitionByRange(slices, *order).withColumn("part", F.spark_partition_id()).sortWithinPartitions("file", *order)
    names = dealt.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema.fields) + ", place long"

    def merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(parts)  # one slice: about slice_rows entries
        if not frames:
            return
        whole = pd.concat(frames, ignore_index=True)
        keys = list(zip(whole["url_key"], whole["date"], whole["id"].map(lambda x: x or ""), whole["file"], whole["offset"], strict=True))
        rows = [g.tolist() for _, g in pd.Series(range(len(whole))).groupby(whole["file"].to_numpy())]
        merged = [rows[r][i] for r, i in LoserTree([[keys[j] for j in run] for run in rows])]
        yield whole.iloc[merged].assign(place=range(len(merged)))[[*names, "place"]]

    return dealt.mapInPandas(merge, schema)


def _keys():
    @F.pandas_udf("string")
    def keys(urls: pd.Series) -> pd.Series:
        return urls.map(url_key)

    return keys


def round_trip(df: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", revisit_from: int = 0) -> DataFrame:
    """Write df's captures to archives in the shared folder, read them back and order them: the columns of READ but the
    payload, url_key, part and place."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}-warc"
    write(records(df, page_id, url, payload, revisit_from=revisit_from), path)
    return histories(read(spark, path, payloads=False))
