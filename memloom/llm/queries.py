"""The queries over the given tables, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format as chat
from . import class_lm, exact_dedup, html_text, minhash, mixing, packing, quality, toxicity, warc
from .common import crc_mod, read

#: The tokenizer's file is a parameter; by default that of the installed public vocabulary.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.chat_format(rows)
    states = chat.validate(out)
    digests = out.select(
        "conv_id",
        F.struct(
            F.col("chunk").isNull().alias("last"),
            "chunk",
            F.array_join(F.transform(chat.parse(F.col("text")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
            F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat.unescape(s["text"])), "").alias("loss"),
        ).alias("piece"),
        F.size(chat.parse(F.col("text"))).cast("long").alias("n"),
        F.length("text").cast("long").alias("chars"),
    )
    whole = digests.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("piece")).alias("pieces"))
    loss = F.array_join("pieces.loss", "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join("pieces.turns", "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    ).join(states.select(F.col("conv_id").alias("_conv"), F.col("valid")), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    index = toxicity.fit(docs, read(spark, sf_dir, "labels"), learn=crc_mod(F.col("doc_id"), 4) != 2)
    out = toxicity.score(docs, index, keep=["doc_id"])
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(read(spark, sf_dir, "documents"), keep=["doc_id", "lang", "source"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(read(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = class_lm.class_lm(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(read(spark, sf_dir, "pages"))
    return out.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"), "url_key", F.col("date").alias("capture_date"), "part", "place")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), n=4)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.best_fit_packing(read(spark, sf_dir, "documents"), tokenizer_path())
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_chat_format, op2_toxicity, op3_quality_rules, op4_source_mixing, op5_html_extraction, op6_class_lm, op7_exact_dedup, op8_warc, op9_minhash, op10_best_fit_packing, pipeline)
}

_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"

SQL = {
    "op1_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), told AS (
  SELECT *, lag(role, 1, 'start') OVER w AS before,
    length(regexp_replace(replace(text, '\', '\\'), '(<(<SYS>>|</SYS>>|s>|/s>|<ROLE>>|</ROLE>>|</TURN>>)|\[(INST\]|/INST\]))', '\1_', 'g')) AS chars,
    CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 26 + length(role) END AS marks
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars + marks)::BIGINT AS formatted_chars,
  bool_and((before, role) IN (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')))
    AND arg_max(role, (turn, role, text)) = 'assistant' AS valid
FROM told GROUP BY conv_id""",
    "op4_source_mixing": rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size FROM documents
), keyed AS (
  SELECT *, ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || size), 1, 4))::INT AS bucket FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source
), steps AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
    sum(2.0::DOUBLE * source_size) OVER o AS held, sum(w) OVER o AS used
  FROM s WINDOW o AS (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), levels AS (
  SELECT max(level) AS level FROM (
    SELECT (total - coalesce(held - cap, 0)) / (all_w - (used - w)) AS level, cap / w AS own FROM steps) WHERE level < own
), t AS (
  SELECT source, source_size, CASE WHEN cap <= coalesce(level, 'inf'::DOUBLE) * w THEN cap ELSE level * w END AS target FROM steps, levels
), goals AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t
), sums AS (
  SELECT source, bucket, sum(size) AS size, sum(sum(size)) OVER (PARTITION BY source ORDER BY bucket) AS upto FROM keyed GROUP BY source, bucket
), last AS (
  SELECT g.source, max(bucket) FILTER (upto - size / 2.0::DOUBLE <= target - whole * source_size) AS last
  FROM goals g JOIN sums s ON g.source IS NOT DISTINCT FROM s.source GROUP BY g.source
)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN bucket <= coalesce(last, -1) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM keyed k JOIN goals g ON k.source IS NOT DISTINCT FROM g.source JOIN last l ON k.source IS NOT DISTINCT FROM l.source""",
    "op7_exact_dedup": rf"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g')) AS text_sha256,
    row_number() OVER () AS row_id FROM documents
), best AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    first_value(doc_id) OVER w AS keep_id, row_number() OVER w = 1 AS kept
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST, row_id)
)
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM best""",
}
