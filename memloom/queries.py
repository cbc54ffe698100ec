"""Queries over the given tables for the session-memory operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .functions import text as T
from .operators import blocks, corpus, graph, ledger, search, tokens
from .sources import sessions as S
from .streaming import consolidation

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

WORDS = "thing the anonre"
_LEDGER = """ledger AS (
  SELECT user_id AS session_id, event_id, CASE event_type WHEN 'view' THEN 'message' WHEN 'click' THEN 'observation' WHEN 'signup' THEN 'reflection'
    WHEN 'purchase' THEN 'compaction' WHEN 'error' THEN 'drop' END AS kind, ceil(value)::BIGINT AS tokens, (props::JSON->>'k')::BIGINT AS key,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)"""
_FIRST = """first AS (SELECT session_id, key, min(pos) AS pos, arg_min(tokens, pos) AS tokens FROM ledger WHERE kind = 'observation' GROUP BY 1, 2),
drops AS (SELECT DISTINCT session_id, key FROM ledger WHERE kind = 'drop'),
active AS (SELECT f.* FROM first f ANTI JOIN drops USING (session_id, key))"""
_VISIBLE = """marks AS (SELECT session_id, max(pos) FILTER (kind = 'compaction') AS boundary FROM ledger GROUP BY 1),
seen AS (SELECT l.* FROM ledger l JOIN marks USING (session_id) WHERE pos <= boundary),
visible AS (SELECT session_id, key, min(pos) AS pos, arg_min(tokens, pos) AS tokens FROM seen s WHERE kind = 'observation'
  AND NOT EXISTS (FROM seen d WHERE d.kind = 'drop' AND d.session_id = s.session_id AND d.key = s.key) GROUP BY 1, 2)"""
_DOCS = "docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return S.spread(S.table(spark, sf, "documents")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _scalar(name: str, make: Callable[[], dict], sql: dict[str, str]) -> None:
    """A query that applies functions to every document's text."""
    QUERIES[name] = lambda spark, sf: _docs(spark, sf).select("doc_id", *[c.alias(n) for n, c in make().items()])
    SQL[name] = f"WITH {_DOCS} SELECT doc_id, " + ", ".join(f"{e} AS {n}" for n, e in sql.items()) + " FROM docs"


# --- recall ---------------------------------------------------------------------------------------------------------

_BM25 = r"""WITH m AS (SELECT conv_id AS session_id, turn AS pos, coalesce(text, '') AS text, len(regexp_split_to_array(coalesce(text, ''), '\s+')) AS dl,
  len(regexp_extract_all(coalesce(text, ''), '(?i)thing')) AS t0, len(regexp_extract_all(coalesce(text, ''), '(?i)anonre')) AS t1 FROM conversations),
c AS (SELECT count(*) AS n, avg(dl) AS av, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1 FROM m),
s AS (SELECT session_id, pos, (t0 > 0)::INT + (t1 > 0)::INT AS matched,
  CASE WHEN t0 > 0 THEN ln((n - d0 + 0.5) / (d0 + 0.5) + 1) * (t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * dl / greatest(av, 1))) + 0.5) ELSE 0 END
  + CASE WHEN t1 > 0 THEN ln((n - d1 + 0.5) / (d1 + 0.5) + 1) * (t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * dl / greatest(av, 1))) + 0.5) ELSE 0 END AS score
  FROM m, c WHERE t0 + t1 > 0),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, session_id, pos) AS rank FROM s WHERE score >= 0.2 * (SELECT max(score) FROM s))"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("session_id", "pos", "matched", F.round("score", 6).alias("score"), "rank")


@query("e17_bm25_search", _BM25 + " SELECT session_id, pos, matched, round(score, 6) AS score, rank FROM r WHERE rank <= 50")
def e17(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(search.recall(S.messages(spark, sf), WORDS, ["session_id", "pos"]))


@query("e19_recall_page", _BM25 + " SELECT session_id, pos, matched, round(score, 6) AS score, rank FROM r WHERE rank BETWEEN 6 AND 10")
def e19(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(search.recall(S.messages(spark, sf), WORDS, ["session_id", "pos"], number=2))


@query("d07_bm25_context", _BM25 + " SELECT n, round(av, 6) AS avg_length, d0 AS df0, d1 AS df1 FROM c")
def d07(spark: SparkSession, sf: str) -> DataFrame:
    return search.bm25_context(S.messages(spark, sf), search.query_terms(WORDS)).withColumn("avg_length", F.round("avg_length", 6))


@query("a02_global_index", "SELECT conv_id AS session_id, turn AS pos, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx FROM conversations QUALIFY role <> 'system'")
def a02(spark: SparkSession, sf: str) -> DataFrame:
    return S.messages(spark, sf).filter("role <> 'system'").select("session_id", "pos", "idx")


@query("b16_serialize_conversation", "SELECT conv_id AS session_id, string_agg('[' || role || ']: ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS said FROM conversations GROUP BY 1")
def b16(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.messages(spark, sf).withColumn("line", F.concat(F.lit("["), "role", F.lit("]: "), "text"))
    return rows.groupBy("session_id").agg(F.expr("listagg(line, '\n\n') WITHIN GROUP (ORDER BY pos)").alias("said"))


@query("e13_role_islands", """WITH g AS (SELECT conv_id AS session_id, turn AS pos, role, sum(CASE WHEN role IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island
  FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations))
SELECT session_id, island::BIGINT AS island, any_value(role) AS role, min(pos) AS first_pos, count(*) AS n FROM g GROUP BY 1, 2""")
def e13(spark: SparkSession, sf: str) -> DataFrame:
    by = W.partitionBy("session_id").orderBy("pos")
    rows = S.messages(spark, sf).withColumn("new", (~F.col("role").eqNullSafe(F.lag("role").over(by))).cast("long"))
    rows = rows.withColumn("island", F.sum("new").over(by))
    return rows.groupBy("session_id", "island").agg(F.first("role").alias("role"), F.min("pos").alias("first_pos"), F.count("*").alias("n"))


# --- scalar functions over documents --------------------------------------------------------------------------------

_scalar("b02_sanitize", lambda: {"clean": T.sanitize(F.col("text"))}, {"clean": r"regexp_replace(regexp_replace(regexp_replace(text, '\r\n', chr(10), 'g'), '\x1b\[[0-9;]*[a-zA-Z]', '', 'g'), '[\x01-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')"})


def clip_sql(e: str, most: int) -> str:
    head = f"left({e}, {most + 1})"
    return f"CASE WHEN length({e}) <= {most} THEN {e} WHEN instr({head}, ' ') > 0 AND length({head}) - instr(reverse({head}), ' ') > {most * 0.6} THEN left({e}, length({head}) - instr(reverse({head}), ' ')) ELSE left({e}, {most}) END"


_CLIP = clip_sql("text", 200)
_ENDS = "'" + blocks.ENDS + "'"


@query(
    "b03_filter_noise",
    rf"""WITH b AS (SELECT conv_id AS session_id, turn AS pos, role AS kind, text, regexp_replace(text, {_ENDS}, '', 'g') AS t FROM conversations),
u AS (SELECT *, regexp_replace({"".join("regexp_replace(" for _ in blocks.WRAPPERS)}t{"".join(rf", '<{w}[^>]*>[\s\S]*?</{w}>', '', 'g')" for w in blocks.WRAPPERS)}, {_ENDS}, '', 'g') AS c FROM b)
SELECT session_id, pos, kind, CASE WHEN kind = 'user' THEN c ELSE text END AS text FROM u WHERE kind IS DISTINCT FROM 'user'
OR (c <> '' AND NOT ({" OR ".join(f"contains(text, '{s}')" for s in blocks.NOISE_REMARKS)}))""",
)
def b03_filter_noise(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("pos"), F.col("role").alias("kind"), F.lit(None).cast("string").alias("name"), "text")
    return blocks.filter_noise(rows).drop("name")


_scalar("h01_clip", lambda: {"clipped": T.clip(F.col("text"))}, {"clipped": _CLIP})
_END = r"length(regexp_extract(left(text, 200), '^([\s\S]*[.!?])(?:\s|$)', 1))"
_scalar("h02_clip_sentence", lambda: {"clipped": T.clip_sentence(F.col("text"))}, {"clipped": f"CASE WHEN length(text) <= 200 THEN text WHEN {_END} >= 100 THEN left(text, {_END}) ELSE {_CLIP} END"})
_scalar("h03_lines", lambda: {"n_lines": F.size(T.lines(F.col("text"))).cast("long"), "first_line": T.first_line(F.col("text"))}, {"n_lines": r"len(list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> ''))", "first_line": clip_sql("string_split(text, chr(10))[1]", 200)})
_scalar("h04_snippet", lambda: {"snippet": T.snippet(F.col("text"), "thing")}, {"snippet": r"(SELECT CASE WHEN p > 0 THEN CASE WHEN p > 61 THEN '...' ELSE '' END || substr(text, greatest(1, p - 60), least(length(text), p + 64) - greatest(1, p - 60) + 1) || CASE WHEN p + 64 < length(text) THEN '...' ELSE '' END END FROM (SELECT instr(lower(text), 'thing') AS p))"})
_scalar("h07_term_counts", lambda: {f"t{i}": c for i, c in enumerate(search.term_counts(F.col("text"), ["thing", "er.n", "the|and"]))}, {"t0": "len(regexp_extract_all(text, '(?i)thing'))", "t1": r"len(regexp_extract_all(text, '(?i)er\.n'))", "t2": "len(regexp_extract_all(text, '(?i)the|and'))"})
_SPELT = "lower(text)"
for _short, _full in T.CONTRACTIONS.items():
    _SPELT = rf"regexp_replace({_SPELT}, '\b{_short.replace(chr(39), chr(39) * 2)}\b', '{_full}', 'g')"
_NORM = rf"left(trim(regexp_replace(regexp_replace(CASE WHEN contains(text, chr(39)) THEN {_SPELT} ELSE lower(text) END, '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), 600)"
_scalar("h08_normalize", lambda: {"key": T.normalize(F.col("text"))}, {"key": _NORM})
_scalar("h34_hash_id", lambda: {"id": T.hash_id(F.col("text")), "short": F.substring("text", 1, 10_000)}, {"id": "left(sha256(text), 12)", "short": "left(text, 10000)"})
_scalar("h39_token_estimate", lambda: {"tokens": T.tokens(F.col("text"))}, {"tokens": "ceil(length(text) / 4)::BIGINT"})
_ERR = r"""CASE WHEN regexp_matches(text, '(?i)unauthorized|HTTP\s+40[014]\b|status\s*:?\s*40[014]\b|error\s*:?\s*40[014]\b') OR (regexp_matches(text, '(?:^|[\s:([{=''"])(40[014]|403|422)\b') AND regexp_matches(text, '(?i)error|fail|missing|forbidden|denied|bad request|not found|unauthorized|invalid'))
 THEN 'deterministic' WHEN regexp_matches(text, '(?i)""" + T.RETRYABLE + "') THEN 'retryable' ELSE 'other' END"
_scalar("h30_error_class", lambda: {"class": T.error_class(F.col("text"))}, {"class": _ERR})
_BIG = "list_distinct(list_transform(range(1, greatest(length(text), 1)), lambda i: substr(text, i, 2)))"
_scalar("h14_bigrams", lambda: {"n_bigrams": T.n_bigrams(F.col("text"))}, {"n_bigrams": f"len({_BIG})"})


@query("h13_levenshtein", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(CASE WHEN a.n_name = b.n_name THEN 1 ELSE 1 - levenshtein(a.n_name, b.n_name) / greatest(length(a.n_name), length(b.n_name)) END, 6) AS similarity FROM nation a JOIN nation b USING (n_regionkey) WHERE a.n_nationkey < b.n_nationkey")
def h13(spark: SparkSession, sf: str) -> DataFrame:
    n = S.table(spark, sf, "nation")
    pairs = n.alias("a").join(n.alias("b"), "n_regionkey").filter("a.n_nationkey < b.n_nationkey")
    return pairs.select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"), F.round(T.levenshtein_similarity(F.col("a.n_name"), F.col("b.n_name")), 6).alias("similarity"))


def _similar_keys(spark: SparkSession, sf: str, edits: bool = False) -> DataFrame:
    keys = _docs(spark, sf).select("doc_id", T.normalize(F.col("text")).alias("key"))
    return corpus.similar_keys(keys.groupBy("key").agg(F.min("doc_id").alias("id")), edits)


@query("h14_key_jaccard")
def h14_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose whole normalised keys have similar bigrams."""
    return _similar_keys(spark, sf).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query("h13_key_levenshtein")
def h13_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Those of h14_key_jaccard whose keys are also near by edits."""
    return _similar_keys(spark, sf, edits=True).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("h12_hamming", "SELECT event_id, bit_count(xor(event_id, user_id))::BIGINT AS distance FROM events")
def h12(spark: SparkSession, sf: str) -> DataFrame:
    return S.table(spark, sf, "events").select("event_id", T.hamming(F.col("event_id"), F.col("user_id")).alias("distance"))


@query("a05_scope_dir", r"SELECT page_id, '--' || regexp_replace(regexp_replace(url, '^[/\\]', ''), '[/\\:]', '-', 'g') || '--' AS scope FROM pages")
def a05(spark: SparkSession, sf: str) -> DataFrame:
    return S.table(spark, sf, "pages").select("page_id", S.scope_dir(F.col("url")).alias("scope"))


@query("h26_short_path", """WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/work/' || page_id || '/a/b.ts' WHEN 1 THEN url ELSE 'C:\\src\\' || page_id || '\\x\\y.ts' END AS path FROM pages), q AS (SELECT page_id, replace(path, '\\', '/') AS p FROM p)
SELECT page_id, CASE WHEN starts_with(p, '/work/') THEN '.' || substr(p, 6) WHEN len(string_split(p, '/')) > 3 THEN '.../' || array_to_string(string_split(p, '/')[-3:], '/') ELSE p END AS short FROM q""")
def h26(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("page_id").cast("string")
    path = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/work/"), n, F.lit("/a/b.ts"))).when(F.col("page_id") % 3 == 1, F.col("url")).otherwise(F.concat(F.lit("C:\\src\\"), n, F.lit("\\x\\y.ts")))
    return S.table(spark, sf, "pages").select("page_id", T.short_path(path).alias("short"))


_NOW = "2024-06-01 00:00:00"
_AGE = f"floor(epoch(TIMESTAMP '{_NOW}') / 60 - floor(epoch(ts)) / 60)"


@query("h35_relative_time", f"""SELECT event_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN m // 60 < 24 THEN m // 60 || 'h ago' WHEN m // 1440 < 14 THEN m // 1440 || 'd ago'
  WHEN m // 1440 < 60 THEN m // 1440 // 7 || 'w ago' WHEN m // 1440 // 30 < 24 THEN m // 1440 // 30 || 'mo ago' ELSE m // 1440 // 365 || 'y ago' END AS age FROM (SELECT event_id, greatest(0, {_AGE})::BIGINT AS m FROM events)""")
def h35(spark: SparkSession, sf: str) -> DataFrame:
    minutes = F.floor(F.lit(_NOW).cast("timestamp").cast("long") / 60 - F.col("ts").cast("timestamp").cast("long") / 60)
    return S.table(spark, sf, "events").select("event_id", T.relative_time(minutes).alias("age"))


@query("h37_recency", f"SELECT event_id, round(1 / pow(1 + greatest(0, (epoch(TIMESTAMP '{_NOW}') - floor(epoch(ts))) / 86400), 0.5), 6) AS decay FROM events")
def h37(spark: SparkSession, sf: str) -> DataFrame:
    days = (F.lit(_NOW).cast("timestamp").cast("long") - F.col("ts").cast("timestamp").cast("long")) / 86400
    return S.table(spark, sf, "events").select("event_id", F.round(T.recency(days), 6).alias("decay"))


_ANCHORS = [(100_000, 0.8), (200_000, 0.65), (1_000_000, 0.3)]
_RATIO = "CASE WHEN w <= 100000 THEN 0.8::DOUBLE WHEN w <= 200000 THEN 0.8::DOUBLE + (w - 100000) / 100000 * -0.15::DOUBLE WHEN w <= 1000000 THEN 0.65::DOUBLE + (w - 200000) / 800000 * -0.35::DOUBLE ELSE 0.3::DOUBLE END"


@query("h41_preset_ratio", f"SELECT o_orderkey, round({_RATIO}, 6) AS ratio FROM (SELECT o_orderkey, o_totalprice * 3 AS w FROM orders)")
def h41(spark: SparkSession, sf: str) -> DataFrame:
    return S.table(spark, sf, "orders").select("o_orderkey", F.round(T.preset_ratio(F.col("o_totalprice") * 3, _ANCHORS), 6).alias("ratio"))


_PRICE = "(SELECT o_orderkey, floor(o_totalprice)::BIGINT AS w, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey ELSE 0 END AS t, CASE WHEN o_orderkey % 5 = 1 THEN 0.5::DOUBLE ELSE 0 END AS r, CASE WHEN o_orderkey % 5 = 2 THEN 16000 ELSE 0 END AS s FROM orders)"


@query("h42_threshold", f"SELECT o_orderkey, CASE WHEN t > 0 THEN t WHEN r > 0 THEN greatest(1, floor(w * r))::BIGINT WHEN s > 0 THEN greatest(1, w - s)::BIGINT ELSE greatest(1, floor(round(w * {_RATIO}, 6)))::BIGINT END AS threshold FROM {_PRICE}")
def h42(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("o_orderkey") % 5
    rows = S.table(spark, sf, "orders").select("o_orderkey", F.floor("o_totalprice").alias("w"), F.when(m == 0, F.col("o_orderkey")).otherwise(0).alias("t"), F.when(m == 1, 0.5).otherwise(0.0).alias("r"), F.when(m == 2, 16000).otherwise(0).alias("s"))
    return rows.select("o_orderkey", T.compact_threshold(F.col("w"), F.col("t"), F.col("r"), F.col("s"), _ANCHORS).cast("long").alias("threshold"))


@query("h44_chain_decision", """WITH x AS (SELECT o_orderkey, floor(o_totalprice / 4)::BIGINT AS c, floor(o_totalprice)::BIGINT AS t, (floor(o_totalprice / 9) - 5000)::BIGINT AS s, o_orderkey % 11 = 0 AS m, o_orderkey % 7 = 0 AS f FROM orders),
y AS (SELECT *, c > 25000 OR t > 100000 AS p, f OR t > 180000 AS tight, greatest(1, least(24000, floor(200000 * 24000.0::DOUBLE / 272000))) AS useful FROM x)
SELECT o_orderkey, CASE WHEN m THEN 'manual-rebase' WHEN tight AND s > 0 THEN CASE WHEN f THEN 'overflow-smaller-rebase' ELSE 'capacity-smaller-rebase' END WHEN tight THEN 'ineffective-reduction'
 WHEN p AND s >= useful THEN 'pressure-useful-saving' WHEN s <= 0 THEN 'ineffective-reduction' WHEN p THEN 'insufficient-saving' ELSE 'below-pressure' END AS reason FROM y""")
def h44(spark: SparkSession, sf: str) -> DataFrame:
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    reason = T.chain_decision(F.floor(price / 4), F.floor(price), F.floor(price / 9) - 5000, F.lit(200_000), F.lit(20_000), key % 11 == 0, key % 7 == 0)
    return S.table(spark, sf, "orders").select("o_orderkey", reason.alias("reason"))


# --- ledger ---------------------------------------------------------------------------------------------------------


@query("e01_fold", f"WITH {_LEDGER}, {_FIRST} SELECT f.*, d.key IS NOT NULL AS dropped FROM first f LEFT JOIN drops d USING (session_id, key)")
def e01(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.fold(S.ledger(spark, sf))


@query("e01_fold_upto", f"WITH {_LEDGER}, l AS (FROM ledger WHERE pos <= 20) SELECT session_id, key, min(pos) AS pos, arg_min(tokens, pos) AS tokens, EXISTS (FROM l d WHERE d.kind = 'drop' AND d.session_id = o.session_id AND d.key = o.key) AS dropped FROM l o WHERE kind = 'observation' GROUP BY 1, 2")
def e01_upto(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.fold(S.ledger(spark, sf), F.lit(20))


@query("c01_active", f"WITH {_LEDGER}, {_FIRST} SELECT * FROM active")
def c01(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.active(S.ledger(spark, sf))


@query("c10_visible_projection", f"WITH {_LEDGER}, {_VISIBLE} SELECT * FROM visible")
def c10(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.visible(S.ledger(spark, sf))


@query("e03_boundary", f"WITH {_LEDGER} SELECT session_id, max(pos) FILTER (kind = 'compaction') AS boundary FROM ledger GROUP BY 1")
def e03(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.boundary(S.ledger(spark, sf))


@query("c23_projection_drift", f"WITH {_LEDGER}, {_FIRST}, {_VISIBLE} SELECT session_id, count(*) FILTER (v.key IS NULL) AS added, count(*) FILTER (a.key IS NULL) AS removed FROM active a FULL JOIN visible v USING (session_id, key) GROUP BY 1")
def c23(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.drift(S.ledger(spark, sf))


@query("c11_usage_as_of", f"""WITH {_LEDGER}, x AS (SELECT session_id, pos, max(pos) FILTER (kind = 'compaction') OVER w AS mark, max(pos) FILTER (kind = 'reflection') OVER w AS use, sum(tokens) OVER w AS total FROM ledger WINDOW w AS (PARTITION BY session_id ORDER BY pos))
SELECT x.session_id, x.pos, CASE WHEN x.use > coalesce(x.mark, -1) THEN (l.tokens + x.total - y.total)::BIGINT END AS context_tokens FROM x LEFT JOIN x y ON y.session_id = x.session_id AND y.pos = x.use LEFT JOIN ledger l ON l.session_id = x.session_id AND l.pos = x.use""")
def c11(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.usage_as_of(S.ledger(spark, sf))


@query("c22_markers", f"WITH {_LEDGER}, m AS (SELECT session_id, max(pos) FILTER (kind = 'observation') AS observed, max(pos) FILTER (kind = 'drop') AS dropped FROM ledger GROUP BY 1) SELECT *, least(observed, dropped) AS earlier FROM m")
def c22(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.markers(S.ledger(spark, sf))


@query("d14_tokens_since", f"WITH {_LEDGER}, m AS (SELECT *, coalesce(max(pos) FILTER (kind = 'compaction') OVER (PARTITION BY session_id), -1) AS last FROM ledger) SELECT session_id, sum(CASE WHEN pos > last THEN tokens ELSE 0 END)::BIGINT AS tokens FROM m GROUP BY 1")
def d14(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.tokens_since(S.ledger(spark, sf), "compaction")


@query("e25_created_after", f"WITH {_LEDGER}, m AS (SELECT *, coalesce(max(pos) FILTER (kind = 'compaction') OVER (PARTITION BY session_id), -1) AS last FROM ledger) SELECT session_id, key, min(pos) AS pos FROM m WHERE pos > last AND kind = 'observation' GROUP BY 1, 2")
def e25(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.created_after(S.ledger(spark, sf), "observation", "compaction")


_COVER = f"{_LEDGER}, {_FIRST}, cover AS (SELECT a.*, coalesce(n, 0) AS support, CASE coalesce(n, 0) WHEN 0 THEN 'none' WHEN 1 THEN 'partial' ELSE 'strong' END AS tier FROM active a LEFT JOIN (SELECT session_id, key, count(*) AS n FROM ledger WHERE kind = 'reflection' GROUP BY 1, 2) USING (session_id, key))"


@query("c09_coverage", f"WITH {_COVER} SELECT * FROM cover")
def c09(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.coverage(S.ledger(spark, sf))


@query("d10_coverage_crosstab", f"WITH {_COVER} SELECT tokens % 4 AS relevance, count(*) FILTER (tier = 'none') AS none_n, coalesce(sum(tokens) FILTER (tier = 'none'), 0)::BIGINT AS none_tokens, count(*) FILTER (tier = 'partial') AS partial_n, coalesce(sum(tokens) FILTER (tier = 'partial'), 0)::BIGINT AS partial_tokens, count(*) FILTER (tier = 'strong') AS strong_n, coalesce(sum(tokens) FILTER (tier = 'strong'), 0)::BIGINT AS strong_tokens FROM cover GROUP BY 1")
def d10(spark: SparkSession, sf: str) -> DataFrame:
    rows = ledger.coverage(S.ledger(spark, sf)).withColumn("relevance", F.col("tokens") % 4)
    return rows.groupBy("relevance").pivot("tier", ["none", "partial", "strong"]).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens")).fillna(0)


@query("d12_support_stats", f"WITH {_LEDGER}, s AS (SELECT session_id, key, count(*) AS n FROM ledger WHERE kind = 'reflection' GROUP BY 1, 2) SELECT session_id, count(*) AS reflections, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM s GROUP BY 1")
def d12(spark: SparkSession, sf: str) -> DataFrame:
    support = S.ledger(spark, sf).filter("kind = 'reflection'").groupBy("session_id", "key").agg(F.count("*").alias("n"))
    return support.groupBy("session_id").agg(F.count("*").alias("reflections"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))


@query("e04_observation_score", f"WITH {_LEDGER}, {_FIRST} SELECT *, round(tokens % 10 + CASE WHEN count(*) OVER p > 1 THEN (row_number() OVER (PARTITION BY session_id ORDER BY pos) - 1) / (count(*) OVER p - 1) ELSE 1 END, 6) AS score FROM active WINDOW p AS (PARTITION BY session_id)")
def e04(spark: SparkSession, sf: str) -> DataFrame:
    out = ledger.observation_scores(ledger.active(S.ledger(spark, sf)), F.col("tokens") % 10)
    return out.withColumn("score", F.round("score", 6))


_MADE = _LEDGER.replace("ledger AS (", "ledger AS MATERIALIZED (")


@query("e05_skip_budget", f"""WITH RECURSIVE {_MADE}, {_FIRST}, sc AS (SELECT *, tokens % 10 + CASE WHEN count(*) OVER p > 1 THEN (row_number() OVER (PARTITION BY session_id ORDER BY pos) - 1) / (count(*) OVER p - 1) ELSE 1 END AS score FROM active WINDOW p AS (PARTITION BY session_id)),
k AS MATERIALIZED (SELECT session_id, pos, tokens, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, pos) AS k FROM sc),
f AS (SELECT session_id, k, pos, tokens <= 200 AS fits, CASE WHEN tokens <= 200 THEN tokens ELSE 0 END AS used FROM k WHERE k = 1 UNION ALL SELECT k.session_id, k.k, k.pos, f.used + k.tokens <= 200, f.used + CASE WHEN f.used + k.tokens <= 200 THEN k.tokens ELSE 0 END FROM f JOIN k ON k.session_id = f.session_id AND k.k = f.k + 1) SELECT session_id, pos FROM f WHERE fits""")
def e05(spark: SparkSession, sf: str) -> DataFrame:
    scored = ledger.observation_scores(ledger.active(S.ledger(spark, sf)), F.col("tokens") % 10)
    return ledger.skip_budget(scored, 200)


_ENTRY = "session_id, event_id, kind, tokens, key, pos"


@query("e07_suffix_budget", f"WITH {_LEDGER}, x AS (SELECT {_ENTRY}, (sum(tokens) OVER w)::BIGINT AS used, count(*) OVER w AS n FROM ledger WINDOW w AS (PARTITION BY session_id ORDER BY pos DESC)) SELECT * EXCLUDE (n) FROM x WHERE used <= 300 OR n = 1")
def e07(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.suffix_budget(S.ledger(spark, sf), 300)


@query("e08_prefix_budget", f"WITH {_LEDGER}, x AS (SELECT {_ENTRY}, (sum(tokens) OVER w)::BIGINT AS used, count(*) OVER w AS n FROM ledger WINDOW w AS (PARTITION BY session_id ORDER BY pos)) SELECT * EXCLUDE (n) FROM x WHERE used <= 300 OR n = 1")
def e08(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.prefix_budget(S.ledger(spark, sf), 300)


@query("e10_latched_budget", f"WITH {_LEDGER} SELECT session_id, pos, sum(tokens) OVER (PARTITION BY session_id ORDER BY pos DESC) > 400 AS omitted FROM ledger WHERE kind = 'message'")
def e10(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.latched_budget(S.ledger(spark, sf).filter("kind = 'message'"), 400).select("session_id", "pos", "omitted")


@query("e22_chain_status", f"""WITH {_LEDGER}, c AS (SELECT session_id, pos, CASE WHEN tokens % 11 = 0 THEN NULL ELSE greatest(1, 3 - row_number() OVER (PARTITION BY session_id ORDER BY pos DESC)) + (tokens % 7 = 0)::INT END AS seq, tokens % 3 = 0 AS start FROM ledger WHERE kind = 'compaction'),
r AS (SELECT *, row_number() OVER w - 1 AS i, first_value(seq) OVER w AS newest FROM c WINDOW w AS (PARTITION BY session_id ORDER BY pos DESC)),
v AS (SELECT *, CASE WHEN seq IS NULL THEN CASE WHEN i = 0 THEN 'latest-not-append' ELSE 'invalid-chain-entry' END WHEN seq <> newest - i THEN 'invalid-sequence' WHEN start THEN CASE WHEN seq = 1 THEN 'ok' ELSE 'invalid-sequence' END WHEN seq <= 1 THEN 'invalid-sequence' END AS verdict FROM r)
SELECT session_id, coalesce(arg_min(verdict, i) FILTER (verdict IS NOT NULL), 'missing-chain-start') AS status, CASE WHEN coalesce(arg_min(verdict, i) FILTER (verdict IS NOT NULL), '') = 'ok' THEN min(i) FILTER (verdict IS NOT NULL) + 1 ELSE 0 END::BIGINT AS segments FROM v GROUP BY 1""")
def e22(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.ledger(spark, sf).filter("kind = 'compaction'")
    back = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("pos")))
    seq = F.when(F.col("tokens") % 11 != 0, F.greatest(F.lit(1), 3 - back) + (F.col("tokens") % 7 == 0).cast("int"))
    return ledger.chain_status(rows.select("session_id", "pos", seq.alias("seq"), (F.col("tokens") % 3 == 0).alias("start")))


@query("i01_whole_branch")
def i01_whole(spark: SparkSession, sf: str) -> DataFrame:
    """The branch of whole sessions; a recursive walk in SQL is too slow on the whole table, a test walks on a small one."""
    return _branch(S.ledger(spark, sf))


def _branch(rows: DataFrame) -> DataFrame:
    return graph.active_branch(rows.select("session_id", "pos", F.when(F.col("pos") > F.col("key") % 3, F.col("pos") - 1 - F.col("key") % 3).alias("parent")))


# --- streaming ------------------------------------------------------------------------------------------------------


@query("j03_due_sessions", f"WITH {_LEDGER}, m AS (SELECT *, coalesce(max(pos) FILTER (kind = 'observation') OVER (PARTITION BY session_id), -1) AS last FROM ledger) SELECT session_id, sum(tokens)::BIGINT AS tokens FROM m WHERE pos > last GROUP BY 1 HAVING sum(tokens) >= 100")
def j03(spark: SparkSession, sf: str) -> DataFrame:
    return consolidation.pending(S.ledger(spark, sf), 100)


@query("j06_token_windows", f"""WITH RECURSIVE {_MADE}, f AS (SELECT session_id, pos, tokens AS held, tokens >= 500 AS fire, 0::BIGINT AS w FROM ledger WHERE pos = 0
UNION ALL SELECT l.session_id, l.pos, CASE WHEN f.fire THEN 0 ELSE f.held END + l.tokens, CASE WHEN f.fire THEN 0 ELSE f.held END + l.tokens >= 500, f.w + f.fire::BIGINT FROM f JOIN ledger l ON l.session_id = f.session_id AND l.pos = f.pos + 1) SELECT session_id, w AS "window", pos AS last_pos, held AS tokens FROM f WHERE fire""")
def j06(spark: SparkSession, sf: str) -> DataFrame:
    return consolidation.windows(S.ledger(spark, sf), 500)


# --- corpus and token analytics -------------------------------------------------------------------------------------

_TIER = "CASE WHEN quality = 1 AND toxic = 0 THEN 'high' WHEN quality = 1 AND toxic = 1 THEN 'critical' WHEN quality = 0 THEN 'low' ELSE 'medium' END"
_OBS = f"""obs AS (SELECT doc_id AS ord, left(sha256(coalesce(text, '')), 12) AS id, coalesce(text, '') AS content, source AS session_id, {_TIER} AS relevance, {_NORM.replace('text', "coalesce(text, '')")} AS key
  FROM documents LEFT JOIN labels USING (doc_id))"""
_CLUSTERS = f"""{_OBS}, k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE relevance WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, ord) AS place FROM obs),
clusters AS (SELECT key, min(ord) AS first_ord, count(*) AS occurrences, count(DISTINCT session_id) AS distinct_sessions, count(DISTINCT sha256(content)) AS n_variants, max(id) FILTER (place = 1) AS rep_id, max(relevance) FILTER (place = 1) AS relevance FROM k GROUP BY key)"""


@query("d02_clusters", f"WITH {_CLUSTERS} SELECT * FROM clusters")
def d02(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.clusters(S.observations(spark, sf))


@query("b14_viable_clusters", f"WITH {_CLUSTERS} SELECT rep_id, first_ord, relevance, round(CASE WHEN occurrences / distinct_sessions <= 1.5 THEN 1 ELSE 1 / (1 + 0.15 * log2(occurrences / distinct_sessions)) END, 6) AS penalty FROM clusters WHERE distinct_sessions >= 2 OR relevance IN ('high', 'critical') OR relevance = 'medium' AND length(key) >= 50")
def b14(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus.clusters(S.observations(spark, sf))
    kept = rows.filter(corpus.viable(F.col("distinct_sessions"), F.lit(0), F.col("relevance"), F.col("key")))
    return kept.select("rep_id", "first_ord", "relevance", F.round(corpus.burst_penalty(F.col("occurrences"), F.col("distinct_sessions")), 6).alias("penalty"))


@query("c15_exact_suppression", f"WITH {_CLUSTERS}, b AS (SELECT {_NORM.replace('text', 'b.text')} AS key FROM benchmark b) SELECT key, first_ord, rep_id FROM clusters WHERE key NOT IN (SELECT key FROM b)")
def c15(spark: SparkSession, sf: str) -> DataFrame:
    reflected = S.table(spark, sf, "benchmark").select(F.col("text").alias("content"))
    return corpus.suppressed_exactly(corpus.clusters(S.observations(spark, sf)), reflected).select("key", "first_ord", "rep_id")


@query("i02_session_components")
def c16(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions joined by compactions with one key."""
    rows = S.ledger(spark, sf).filter("kind = 'compaction'").select("session_id", "key").distinct()
    least = rows.groupBy("key").agg(F.min("session_id").alias("b"))
    return graph.components(rows.join(least, "key").select(F.col("session_id").alias("a"), "b"))


@query("d20_percentiles", f"WITH {_LEDGER} SELECT kind, quantile_disc(tokens, 0.5) AS p50, quantile_disc(tokens, 0.9) AS p90, quantile_disc(tokens, 0.95) AS p95, max(tokens) AS most, count(*) AS n FROM ledger GROUP BY 1")
def d20(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.percentiles(S.ledger(spark, sf), "tokens", ["kind"])


@query("d21_kth_largest", f"WITH {_LEDGER}, t AS (SELECT kind, tokens AS threshold FROM ledger QUALIFY row_number() OVER (PARTITION BY kind ORDER BY tokens DESC) = 20) SELECT kind, threshold, (SELECT count(*) FROM ledger l WHERE l.kind = t.kind AND l.tokens >= threshold) AS fires FROM t")
def d21(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.kth_largest(S.ledger(spark, sf), "tokens", ["kind"], 20)


@query("d22_context_tiers", "SELECT CASE WHEN o_totalprice <= 100000 THEN 'low' WHEN o_totalprice <= 200000 THEN 'medium' ELSE 'high' END AS tier, count(*) AS n, quantile_disc(o_totalprice, 0.9) AS p90, round(0.65 * quantile_disc(o_totalprice, 0.9), 4) AS suggested FROM orders GROUP BY 1")
def d22(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.table(spark, sf, "orders").withColumn("tier", tokens.context_tier(F.col("o_totalprice")))
    return rows.groupBy("tier").agg(F.count("*").alias("n"), tokens.nearest_rank("o_totalprice", 0.9).alias("p90")).withColumn("suggested", F.round(0.65 * F.col("p90"), 4))


@query("d19_calibration", """WITH x AS (SELECT o_orderpriority AS stage, (o_orderkey % 1000 + 500)::BIGINT AS est, floor(o_totalprice / 100)::BIGINT + 1 AS use FROM orders),
g AS (SELECT stage, list_sort(list(est / use)) AS r, count(*) FILTER (est >= 1200) AS est_fires, count(*) FILTER (use >= 1200) AS usage_fires, count(*) FILTER (use >= 1200 AND est < 1200) AS late, count(*) FILTER (est >= 1200 AND use < 1200) AS early FROM x GROUP BY 1)
SELECT stage, round(r[len(r) // 2 + 1], 6) AS median_ratio, est_fires, usage_fires, late, early, round(usage_fires / est_fires, 6) AS churn FROM g""")
def d19(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("stage"), (F.col("o_orderkey") % 1000 + 500).cast("long").alias("est"), (F.floor(F.col("o_totalprice") / 100) + 1).alias("use"))
    out = tokens.calibration(rows, "est", "use", 1200, ["stage"])
    return out.withColumn("median_ratio", F.round("median_ratio", 6)).withColumn("churn", F.round("churn", 6))


from . import more_queries as _more  # noqa: E402, F401  (it registers queries of its own)
