"""Queries for transcripts, links between memories, recall and small rules, each with its SQL.

Conversations stand for sessions: phrases before the texts make rows that hit every rule, assistants call a tool a turn, system
rows are results of commands. Events stand for the ledger: clicks are observations, signups reflections, errors drops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import rules as R
from .functions import text as T
from .operators import links as L
from .operators import transcript as X
from .queries import _LEDGER, _docs, _DOCS, clip_sql, query
from .sources import sessions as S

PHRASES = [
    "", "Actually, let's do this: ", "fix the parser of ", "I always use tabs in ", "ok\n", "The build failed again with ", "- Please avoid ", "Why does it crash?\n", "Never commit ", "Style: x\nIt cannot open the door of ",
    "For each issue: read\n", "[main 1234abc] done, see 0a1b2c3d4e\nStill broken in ",
]
TOOLS = ["Read", "Edit", "bash", "Write", "Grep"]


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for v in values) + "]"


def q(pattern: str) -> str:
    return pattern.replace("'", "''")


_SAN = r"regexp_replace(regexp_replace(regexp_replace(t, '\r\n', chr(10), 'g'), '\x1b\[[0-9;]*[a-zA-Z]', '', 'g'), '[\x01-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')"
_C = f"""c AS (SELECT conv_id AS session_id, turn AS pos, CASE role WHEN 'system' THEN 'toolResult' ELSE role END AS role, {_list(PHRASES)}[(conv_id + turn) % 12 + 1] || coalesce(text, '') AS t,
  {_list(TOOLS)}[turn % 5 + 1] AS tool, '/work/s' || (conv_id % 3) || '/f' || (turn % 4) || '.ts' AS path, 'cd /work && git commit -m "Fix part ' || turn || '" | tail -3' AS cmd FROM conversations)"""
_B = f"""{_C}, s AS (SELECT *, {_SAN} AS x FROM c), b AS (
SELECT session_id, pos, 0 AS n, 'user' AS kind, NULL AS name, x AS text, NULL::BOOLEAN AS is_error FROM s WHERE role = 'user' AND (x <> '' OR pos % 5 <> 0)
UNION ALL SELECT session_id, pos, (x <> '')::INT, 'user', NULL, '[image: image/png]', NULL FROM s WHERE role = 'user' AND pos % 5 = 0
UNION ALL SELECT session_id, pos, 0, 'tool_result', 'bash', x, pos % 2 = 0 FROM s WHERE role = 'toolResult'
UNION ALL SELECT session_id, pos, 0, 'assistant', NULL, x, NULL FROM s WHERE role = 'assistant'
UNION ALL SELECT session_id, pos, 1, 'thinking', NULL, 'hm', NULL FROM s WHERE role = 'assistant' AND pos % 4 = 1
UNION ALL SELECT session_id, pos, 1 + (pos % 4 = 1)::INT, 'tool_call', tool, NULL, NULL FROM s WHERE role = 'assistant')"""


def messages(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.table(spark, sf, "conversations")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    rows = rows.select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("pos"), F.when(F.col("role") == "system", "toolResult").otherwise(F.col("role")).alias("role"),
        F.concat(pick(PHRASES, (F.col("conv_id") + F.col("turn")) % 12), F.coalesce("text", F.lit(""))).alias("t"), pick(TOOLS, F.col("turn") % 5).alias("tool"),
        F.concat(F.lit("/work/s"), (F.col("conv_id") % 3).cast("string"), F.lit("/f"), (F.col("turn") % 4).cast("string"), F.lit(".ts")).alias("path"),
        F.concat(F.lit('cd /work && git commit -m "Fix part '), F.col("turn").cast("string"), F.lit('" | tail -3')).alias("cmd"),
    )
    none = F.lit(None).cast("string")
    tool = lambda *names: F.col("tool").isin(*names)
    edits = F.array(F.struct(F.lit("a").alias("oldText"), F.lit("b\nc").alias("newText")))
    keys = F.when(tool("bash"), F.array(F.lit("command"))).when(tool("Grep"), F.array(F.lit("pattern"), F.lit("glob"))).otherwise(F.array(F.lit("path")))
    args = F.struct(
        F.when(tool("Read", "Edit", "Write"), F.col("path")).alias("path"), none.alias("file_path"), none.alias("filePath"), none.alias("file"), F.when(tool("bash"), F.col("cmd")).alias("command"), none.alias("query"),
        F.when(tool("Write"), F.col("t")).alias("content"), none.alias("oldText"), none.alias("newText"), F.when(tool("Edit"), edits).alias("edits"), keys.alias("keys"),
    )
    part = lambda kind, text=none, thinking=none, name=none, a=F.lit(None).cast(X.ARGS), mime=none: F.struct(F.lit(kind).alias("type"), text.alias("text"), thinking.alias("thinking"), F.lit(False).alias("redacted"), name.alias("name"), a.cast(X.ARGS).alias("args"), mime.alias("mimeType")).cast(X.PART)
    text, empty = F.array(part("text", F.col("t"))), F.array().cast(f"array<{X.PART}>")
    user = F.concat(text, F.when(F.col("pos") % 5 == 0, F.array(part("image", mime=F.lit("image/png")))).otherwise(empty))
    assistant = F.concat(text, F.when(F.col("pos") % 4 == 1, F.array(part("thinking", thinking=F.lit("hm")))).otherwise(empty), F.array(part("toolCall", name=F.col("tool"), a=args)))
    content = F.when(F.col("role") == "user", user).when(F.col("role") == "assistant", assistant).otherwise(text)
    return rows.select("session_id", "pos", "role", content.alias("content"), F.when(F.col("role") == "toolResult", "bash").alias("tool_name"), F.when(F.col("role") == "toolResult", F.col("pos") % 2 == 0).alias("is_error"), none.alias("command"), none.alias("output"))


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    return X.blocks(messages(spark, sf))


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    return messages(spark, sf).filter("role = 'assistant'").select("session_id", "pos", F.element_at("content", -1).alias("p"))


# --- transcripts ------------------------------------------------------------------------------------------------------


@query("b01_blocks", f"WITH {_B} SELECT session_id, pos, n, kind, name, text FROM b")
def b01(spark: SparkSession, sf: str) -> DataFrame:
    return blocks(spark, sf).select("session_id", "pos", "n", "kind", "name", "text")


@query("b04_text_of", f"WITH {_C} SELECT session_id, pos, t AS text FROM c")
def b04(spark: SparkSession, sf: str) -> DataFrame:
    return messages(spark, sf).select("session_id", "pos", X.text_of(F.col("content")).alias("text"))


_SUMMED = "CASE WHEN tool IN ('Read', 'Edit', 'Write') THEN 'path=' || path WHEN tool = 'bash' THEN 'command=' || cmd ELSE 'pattern, glob' END"


@query("b05_render", f"WITH {_C} SELECT session_id, pos, CASE role WHEN 'toolResult' THEN 'tool_result' ELSE role END AS role, CASE role WHEN 'user' THEN {clip_sql('t', 300)} WHEN 'toolResult' THEN CASE WHEN pos % 2 = 0 THEN 'ERROR ' ELSE '' END || '[bash] ' || {clip_sql('t', 200)} ELSE tool || '(' || {_SUMMED} || ')' || chr(10) || {clip_sql('t', 300)} END AS summary FROM c")
def b05(spark: SparkSession, sf: str) -> DataFrame:
    return X.rendered(messages(spark, sf))


@query("b09_arg_summary", f"WITH {_C} SELECT session_id, pos, {_SUMMED} AS said FROM c WHERE role = 'assistant'")
def b09(spark: SparkSession, sf: str) -> DataFrame:
    return _calls(spark, sf).select("session_id", "pos", R.summarize_args(F.col("p.args")).alias("said"))


_WRITES = "CASE tool WHEN 'Write' THEN t <> '' WHEN 'Edit' THEN true ELSE false END"


@query("b06_content_bearing", f"WITH {_C} SELECT session_id, pos, {_WRITES} AS bearing FROM c WHERE role = 'assistant'")
def b06(spark: SparkSession, sf: str) -> DataFrame:
    return _calls(spark, sf).select("session_id", "pos", R.content_bearing(F.col("p.args")).alias("bearing"))


@query("b07_payload", f"WITH {_C} SELECT session_id, pos, CASE WHEN NOT ({_WRITES}) THEN '' WHEN tool = 'Write' THEN left(left(t, 10240) || chr(10), 10240) ELSE 'a' || chr(10) || 'b' || chr(10) || 'c' || chr(10) END AS payload FROM c WHERE role = 'assistant'")
def b07(spark: SparkSession, sf: str) -> DataFrame:
    return _calls(spark, sf).select("session_id", "pos", R.payload(F.col("p.args")).alias("payload"))


@query("d05_touched_files", f"WITH {_C} SELECT session_id, path, string_agg('#' || pos || ' (' || tool || ')', ', ' ORDER BY pos) AS entries FROM c WHERE role = 'assistant' AND {_WRITES} GROUP BY 1, 2")
def d05(spark: SparkSession, sf: str) -> DataFrame:
    return X.touched_files(messages(spark, sf))


_TRIM = lambda e: rf"regexp_replace({e}, '^\s+|\s+$', '', 'g')"


@query("d06_file_indicators", f"WITH {_C} SELECT session_id, pos, path, tool, CASE tool WHEN 'Edit' THEN 3 ELSE len(list_filter(string_split(t, chr(10)), lambda x: {_TRIM('x')} <> '')) END::BIGINT AS lines FROM c WHERE role = 'assistant' AND {_WRITES}")
def d06(spark: SparkSession, sf: str) -> DataFrame:
    return X.file_matches(messages(spark, sf))


@query("d17_file_activity", f"""WITH {_C}, f AS (SELECT session_id, list_sort(list(DISTINCT path) FILTER (tool = 'Read')) AS r, list_sort(list(DISTINCT path) FILTER (tool IN ('Edit', 'Write'))) AS m FROM c WHERE role = 'assistant' AND tool IN ('Read', 'Edit', 'Write') GROUP BY 1),
g AS (SELECT session_id, coalesce(r, []) AS r, coalesce(m, []) AS m, CASE WHEN len(coalesce(r, [])) + len(coalesce(m, [])) >= 2 THEN '/work/s' || session_id % 3 || '/' ELSE '' END AS p FROM f)
SELECT session_id, list_transform(r, lambda x: substr(x, length(p) + 1)) AS read, list_transform(m, lambda x: substr(x, length(p) + 1)) AS modified FROM g""")
def d17(spark: SparkSession, sf: str) -> DataFrame:
    return X.file_activity(blocks(spark, sf))


_EVERY = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {_TRIM('x')}), lambda x: x <> '')"
_UPTO = f"CASE WHEN list_position(list_transform({_EVERY}, lambda x: regexp_matches(x, '{q(R.TEMPLATE)}')), true) > 0 THEN ({_EVERY})[1:list_position(list_transform({_EVERY}, lambda x: regexp_matches(x, '{q(R.TEMPLATE)}')), true) - 1] ELSE {_EVERY} END"
_LINES = rf"list_filter(list_transform(list_filter({_UPTO}, lambda x: length(x) > 5 AND length(x) <= 200 AND NOT regexp_matches(x, '{q(R.NOISE_SHORT)}') AND NOT regexp_matches(x, '{q(R.NO_GOAL)}')), lambda x: {_TRIM(chr(114) + 'egexp_replace(x, ' + chr(39) + '^\\s*(?:[-*+]|\\d+\\.)\\s+' + chr(39) + ', ' + chr(39) * 2 + ')')}), lambda x: length(x) > 5)"
_GOALS = f"""u AS (SELECT session_id, pos, n, text, {_LINES} AS lines FROM b WHERE kind = 'user'),
v AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos, n) AS k, regexp_matches(left(text, 200), '{q(R.SCOPE_CHANGE)}') AS scope, regexp_matches(left(text, 200), '{q(R.TASK)}') AND length(lines[1]) > 15 AS task FROM u WHERE len(lines) > 0),
w AS (SELECT *, list_transform(lines[1:CASE WHEN k = 1 THEN 6 WHEN scope THEN 3 ELSE 2 END], lambda x: CASE WHEN k = 1 THEN {clip_sql('x', 80)} ELSE {clip_sql('x', 200)} END || ' (#' || pos || ')') AS own FROM v),
goals AS (SELECT session_id, list_concat(max(own) FILTER (k = 1), CASE WHEN count(*) FILTER (k > 1 AND (scope OR task)) > 0 THEN list_concat(['[Scope change]'], arg_max(own, k) FILTER (k > 1 AND (scope OR task))) ELSE [] END)[1:8] AS goals FROM w GROUP BY 1)"""


@query("h21_goals", f"WITH {_B}, {_GOALS} SELECT * FROM goals")
def h21(spark: SparkSession, sf: str) -> DataFrame:
    return X.goals(blocks(spark, sf))


_STATED = " OR ".join(f"regexp_matches(x, '{q(p)}')" for p in R.PREFERENCES)


@query("h22_preference_lines", f"WITH {_B} SELECT session_id, pos, n, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_TRIM('x')}), lambda x: length(x) BETWEEN 5 AND 200 AND NOT x LIKE '%?' AND NOT contains(x, '?...') AND ({_STATED})) AS stated FROM b WHERE kind = 'user'")
def h22(spark: SparkSession, sf: str) -> DataFrame:
    return blocks(spark, sf).filter("kind = 'user'").select("session_id", "pos", "n", R.preference_line(F.col("text")).alias("stated"))


@query("h22_preferences")
def h22_all(spark: SparkSession, sf: str) -> DataFrame:
    """The fold over blocks in order is beyond plain SQL; a test folds in Python."""
    return X.preferences(blocks(spark, sf))


_BLOCK = rf"list_filter(list_transform(string_split(text, chr(10)), lambda x: {_TRIM('x')}), lambda x: regexp_matches(x, '{q(R.BLOCKER)}') AND length(x) >= 15 AND NOT regexp_matches(x, '^\s*[-*+>]\s') AND NOT regexp_matches(x, '^\s*\(') AND regexp_matches(x, '^\s*[\"''`*_]?[A-Z`]'))[1]"


@query("h23_blocker_lines", f"WITH {_B} SELECT session_id, pos, n, {_BLOCK} AS line FROM b WHERE kind IN ('user', 'assistant')")
def h23(spark: SparkSession, sf: str) -> DataFrame:
    return blocks(spark, sf).filter("kind IN ('user', 'assistant')").select("session_id", "pos", "n", R.blocker_line(F.col("text")).alias("line"))


@query("h23_outstanding")
def h23_all(spark: SparkSession, sf: str) -> DataFrame:
    return X.outstanding(blocks(spark, sf))


_HASH = rf"coalesce(nullif(regexp_extract(text, '{R.HASH_BRACKET}', 1), ''), nullif(regexp_extract(text, '{R.HASH_RANGE}', 1), ''), nullif(regexp_extract(text, '{R.HASH_PLAIN}', 1), ''))"
_COMMITS = f"h AS (SELECT *, CASE WHEN kind = 'tool_result' THEN {_HASH} END AS found FROM b), l AS (SELECT *, coalesce(lead(found, 1) OVER w, lead(found, 2) OVER w) AS hash FROM h WINDOW w AS (PARTITION BY session_id ORDER BY pos, n)), commits AS (SELECT session_id, min(pos) AS pos, hash, 'Fix part ' || pos AS message FROM l WHERE kind = 'tool_call' AND name = 'bash' GROUP BY session_id, hash, 'Fix part ' || pos)"


@query("c12_commit_hashes", f"WITH {_B}, {_COMMITS} SELECT * FROM commits")
def c12(spark: SparkSession, sf: str) -> DataFrame:
    return X.commits(blocks(spark, sf)).drop("n")


@query("h24_commit_lines", f"WITH {_B}, {_COMMITS}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos DESC) AS back FROM commits) SELECT session_id, list(coalesce(hash || ': ', '') || message ORDER BY pos) AS commits FROM r WHERE back <= 8 GROUP BY 1")
def h24(spark: SparkSession, sf: str) -> DataFrame:
    return X.commit_lines(X.commits(blocks(spark, sf)))


_ONE = "CASE WHEN tool IN ('Read', 'Edit', 'Write') THEN '* ' || tool || ' \"' || path || '\"' WHEN tool = 'bash' THEN '* bash \"git commit -m \"Fix part ' || pos || '\"\"' ELSE '* Grep' END"


@query("h17_one_liner", f"WITH {_C} SELECT session_id, pos, {_ONE} AS line FROM c WHERE role = 'assistant'")
def h17(spark: SparkSession, sf: str) -> DataFrame:
    return _calls(spark, sf).select("session_id", "pos", R.one_liner(F.col("p.name"), F.col("p.args")).alias("line"))


_SHELL = r"regexp_replace(array_to_string(list_filter(list_transform(string_split(cmd, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), '; '), '^cd\s+\S+\s*&&\s*', '')"
for _ in range(10):
    _SHELL = rf"regexp_replace({_SHELL}, '{R.PIPE_TAIL}', '')"


@query("h16_compress_shell", f"""WITH d AS (SELECT doc_id, 'cd /x && echo ' || replace(left(coalesce(text, ''), 20 + doc_id % 200), '|', '/') || [' | sort | uniq -c | head -5', ' | awk 1', '', ' | wc -l'][doc_id % 4 + 1] AS cmd FROM documents), o AS (SELECT doc_id, {_SHELL} AS c FROM d)
SELECT doc_id, CASE WHEN length(c) > 120 THEN regexp_replace(left(c, CASE WHEN instr(left(c, 119), ' ') > 0 AND 119 - instr(reverse(left(c, 119)), ' ') > 72 THEN 119 - instr(reverse(left(c, 119)), ' ') ELSE 117 END), '\\s+$', '') || '...' ELSE c END AS cmd FROM o""")
def h16(spark: SparkSession, sf: str) -> DataFrame:
    tails = F.element_at(F.array(*map(F.lit, [" | sort | uniq -c | head -5", " | awk 1", "", " | wc -l"])), (F.col("doc_id") % 4 + 1).cast("int"))
    cmd = F.concat(F.lit("cd /x && echo "), F.replace(F.substring("text", F.lit(1), (20 + F.col("doc_id") % 200).cast("int")), F.lit("|"), F.lit("/")), tails)
    return _docs(spark, sf).select("doc_id", R.compress_shell(cmd).alias("cmd"))


_TURNS = f"""t AS (SELECT *, coalesce(sum((kind = 'user')::INT) OVER (PARTITION BY session_id ORDER BY pos, n), 0)::BIGINT AS turn FROM b),
y AS (SELECT t.session_id, t.turn, t.pos, t.n, CASE WHEN t.kind = 'tool_call' THEN {_ONE.replace('pos', 't.pos')} END AS line FROM t LEFT JOIN c ON c.session_id = t.session_id AND c.pos = t.pos WHERE t.kind IN ('tool_call', 'assistant')),
z AS (SELECT *, coalesce(lag(line) OVER (PARTITION BY session_id, turn ORDER BY pos, n) = line, false) AS same FROM y),
i AS (SELECT *, sum((NOT same)::INT) OVER (PARTITION BY session_id, turn ORDER BY pos, n)::BIGINT AS island FROM z),
tool_lines AS (SELECT session_id, turn, island, min(pos) AS pos, any_value(line) AS line, string_agg('#' || pos, ', ' ORDER BY pos) AS refs, count(*) AS times FROM i WHERE line IS NOT NULL GROUP BY 1, 2, 3)"""


@query("e14_tool_lines", f"WITH {_B}, {_TURNS} SELECT * FROM tool_lines")
def e14(spark: SparkSession, sf: str) -> DataFrame:
    return X.tool_lines(blocks(spark, sf)).select("session_id", "turn", "island", F.col("first.pos").alias("pos"), "line", "refs", "times")


@query("e15_kept_tool_lines", f"WITH {_B}, {_TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id, turn ORDER BY island DESC) AS back, count(*) OVER (PARTITION BY session_id, turn) AS k FROM tool_lines) SELECT session_id, turn, pos, line || ' (' || refs || ')' || CASE WHEN times > 1 THEN ' x' || times ELSE '' END AS line, CASE WHEN back = 1 AND k > 1 THEN '* (' || (k - 1) || ' earlier tool-call entries omitted)' END AS omitted FROM r WHERE back <= 1")
def e15(spark: SparkSession, sf: str) -> DataFrame:
    return X.kept_tool_lines(X.tool_lines(blocks(spark, sf)), 1)


@query("l01_sections")
def l01(spark: SparkSession, sf: str) -> DataFrame:
    return X.sections(blocks(spark, sf))


@query("m07_summary")
def m07(spark: SparkSession, sf: str) -> DataFrame:
    return X.summary(X.sections(blocks(spark, sf)))


_ITEMS = ("list_transform(range(0, o_orderkey % 12), lambda i: '- ' || (o_orderkey + i) % 17)", "list_transform(range(0, o_orderkey % 9), lambda i: '- ' || (o_orderkey * 3 + i) % 17)")


def _two_lists(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    items = lambda n, base: F.transform(F.filter(F.sequence(F.lit(0), F.greatest(key % n, F.lit(1)) - 1), lambda i: i < key % n), lambda i: F.concat(F.lit("- "), ((base + i) % 17).cast("string")))
    return S.table(spark, sf, "orders").select("o_orderkey", items(12, key).alias("a"), items(9, key * 3).alias("b"))


_BOTH = "(SELECT o_orderkey, list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x))) AS ab, a, b FROM (SELECT o_orderkey, " + _ITEMS[0] + " AS a, " + _ITEMS[1] + " AS b FROM orders))"


@query("g02_merge_lines", f"SELECT o_orderkey, ab[1:8] AS goals, ab[-8:] AS commits, ab[-15:] AS preferences, b AS outstanding FROM {_BOTH}")
def g02(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _two_lists(spark, sf).select("o_orderkey", X.merged(a, b, "Session Goal").alias("goals"), X.merged(a, b, "Commits").alias("commits"), X.merged(a, b, "User Preferences").alias("preferences"), X.merged(a, b, "Outstanding Context").alias("outstanding"))


@query("g03_merge_files", f"SELECT o_orderkey, ab AS modified, list_filter(list_concat(b, list_filter(a, lambda x: NOT list_contains(b, x))), lambda x: NOT list_contains(ab, x)) AS read FROM {_BOTH}")
def g03(spark: SparkSession, sf: str) -> DataFrame:
    old, new = F.struct(F.col("a").alias("modified"), F.col("b").alias("read")), F.struct(F.col("b").alias("modified"), F.col("a").alias("read"))
    return _two_lists(spark, sf).select("o_orderkey", X.merged_files(old, new).alias("m")).select("o_orderkey", "m.modified", "m.read")


@query("g04_preferences_except_goals", f"SELECT o_orderkey, list_filter(a, lambda x: NOT list_contains(b, x)) AS kept FROM {_BOTH}")
def g04(spark: SparkSession, sf: str) -> DataFrame:
    return _two_lists(spark, sf).select("o_orderkey", X.without_goals(F.col("a"), F.col("b")).alias("kept"))


@query("g05_unique", f"SELECT o_orderkey, ab AS ids FROM {_BOTH}")
def g05(spark: SparkSession, sf: str) -> DataFrame:
    return _two_lists(spark, sf).select("o_orderkey", F.array_distinct(F.concat("a", "b")).alias("ids"))


@query("g06_validate_ids", f"SELECT o_orderkey, CASE WHEN len(k) > 0 THEN k END AS lenient, CASE WHEN len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AND len(k) > 0 THEN k END AS strict FROM (SELECT *, list_filter(a, lambda x: list_contains(b, x)) AS k FROM {_BOTH})")
def g06(spark: SparkSession, sf: str) -> DataFrame:
    return _two_lists(spark, sf).select("o_orderkey", L.known_ids(F.col("b"), F.col("a")).alias("lenient"), L.all_known_ids(F.col("b"), F.col("a")).alias("strict"))


@query("g07_dice", f"SELECT o_orderkey, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE 2 * len(list_intersect(a, b)) / (len(a) + len(b)) END, 6) AS dice FROM {_BOTH}")
def g07(spark: SparkSession, sf: str) -> DataFrame:
    return _two_lists(spark, sf).select("o_orderkey", F.round(T.dice(F.col("a"), F.col("b")), 6).alias("dice"))


@query("m01_invalid_expand", f"SELECT o_orderkey, list_filter(a, lambda x: NOT list_contains(b, x)) AS invalid FROM {_BOTH}")
def m01(spark: SparkSession, sf: str) -> DataFrame:
    return _two_lists(spark, sf).select("o_orderkey", F.filter("a", lambda x: ~F.array_contains(F.col("b"), x)).alias("invalid"))


# --- links ------------------------------------------------------------------------------------------------------------

_O = """o AS (SELECT session_id, key AS id, min(pos) AS pos, ['low', 'medium', 'high', 'critical'][arg_min(tokens, pos) % 4 + 1] AS relevance, arg_min(tokens, pos) AS tokens, [min(pos) - 1, min(pos) - 2] AS sources FROM ledger WHERE kind = 'observation' GROUP BY 1, 2),
r AS (SELECT session_id, pos AS id, pos, [key, (key + 1) % 100, key] AS supports FROM ledger WHERE kind = 'reflection'), dr AS (SELECT DISTINCT session_id, key AS id FROM ledger WHERE kind = 'drop')"""
_SUP = "sup AS (SELECT session_id, id, count(*) AS support FROM (SELECT session_id, unnest(list_distinct(supports)) AS id FROM r) GROUP BY 1, 2)"
_TIERS = "CASE coalesce(support, 0) WHEN 0 THEN 'none' WHEN 1 THEN 'partial' ELSE 'strong' END"
_RANK = lambda c: f"list_position(['low', 'medium', 'high', 'critical'], {c})"


def observed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = S.ledger(spark, sf)
    first = rows.filter("kind = 'observation'").groupBy("session_id", F.col("key").alias("id")).agg(F.min_by(F.struct("pos", "tokens"), "pos").alias("o"))
    tier = F.element_at(F.array(*map(F.lit, L.TIERS)), (F.col("o.tokens") % 4 + 1).cast("int"))
    obs = first.select("session_id", "id", "o.pos", tier.alias("relevance"), "o.tokens", F.array(F.col("o.pos") - 1, F.col("o.pos") - 2).alias("sources"))
    refl = rows.filter("kind = 'reflection'").select("session_id", F.col("pos").alias("id"), "pos", F.array(F.col("key"), (F.col("key") + 1) % 100, F.col("key")).alias("supports"))
    return obs, refl, rows.filter("kind = 'drop'").select("session_id", F.col("key").alias("id")).distinct()


@query("c02_lineage", f"WITH {_LEDGER} SELECT session_id, pos, kind FROM ledger l WHERE pos IN (SELECT pos FROM ledger m WHERE m.session_id = l.session_id AND m.key % 3 <> 0)")
def c02(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.ledger(spark, sf).select("session_id", "pos", "kind", "key")
    return L.in_lineage(rows, rows.filter("key % 3 <> 0"), "pos").drop("key")


@query("c03_sources", f"WITH {_LEDGER}, {_O}, e AS (SELECT session_id, pos AS entry FROM ledger WHERE kind = 'message'), s AS (SELECT session_id, id AS reflection, unnest(list_distinct(supports)) AS id FROM r), j AS (SELECT s.session_id, reflection, s.id, o.id IS NOT NULL AS known, unnest(coalesce(o.sources, [NULL])) AS entry FROM s LEFT JOIN o USING (session_id, id)), k AS (SELECT j.*, e.entry IS NOT NULL AS there FROM j LEFT JOIN e USING (session_id, entry)) SELECT session_id, reflection, count(DISTINCT id) FILTER (known) AS supports, count(DISTINCT id) FILTER (NOT known) AS missing_supports, count(DISTINCT entry) FILTER (there) AS sources, count(DISTINCT entry) FILTER (NOT there) AS missing_sources, count(*) FILTER (NOT known OR NOT there) > 0 AS partial FROM k GROUP BY 1, 2")
def c03(spark: SparkSession, sf: str) -> DataFrame:
    obs, refl, _ = observed(spark, sf)
    return L.sources_of(refl, obs, S.ledger(spark, sf).filter("kind = 'message'").select("session_id", F.col("pos").alias("entry")))


_CITING = "tg AS (SELECT session_id, pos AS entry FROM ledger WHERE kind = 'message' AND key < 20), ci AS (SELECT session_id, id, string_agg(entry::VARCHAR, ', ' ORDER BY entry DESC) AS matched FROM (SELECT session_id, id, unnest(sources) AS entry FROM o) SEMI JOIN tg USING (session_id, entry) GROUP BY 1, 2)"


def _found(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    obs, refl, drops = observed(spark, sf)
    targets = S.ledger(spark, sf).filter("kind = 'message' AND key < 20").select("session_id", F.col("pos").alias("entry"))
    return L.citing(obs, targets, drops), refl


@query("c04_citing_observations", f"WITH {_LEDGER}, {_O}, {_CITING} SELECT ci.*, CASE WHEN dr.id IS NULL THEN 'active' ELSE 'dropped' END AS status FROM ci LEFT JOIN dr USING (session_id, id)")
def c04(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf)[0]


@query("c05_supporting_reflections", f"WITH {_LEDGER}, {_O}, {_CITING} SELECT DISTINCT session_id, reflection FROM (SELECT session_id, id AS reflection, unnest(supports) AS id FROM r) SEMI JOIN ci USING (session_id, id)")
def c05(spark: SparkSession, sf: str) -> DataFrame:
    found, refl = _found(spark, sf)
    return L.supporting(refl, found)


@query("c06_overlay", f"WITH {_LEDGER} SELECT session_id, pos, coalesce(b.body, a.body) AS body, b.body IS NOT NULL AS expanded FROM (SELECT session_id, pos, 'short ' || key AS body FROM ledger WHERE key % 3 = 0) a FULL JOIN (SELECT session_id, pos, 'long ' || key AS body FROM ledger WHERE key % 4 = 0) b USING (session_id, pos)")
def c06(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.ledger(spark, sf)
    body = lambda word, n: rows.filter(F.col("key") % n == 0).select("session_id", "pos", F.concat(F.lit(f"{word} "), F.col("key").cast("string")).alias("body"))
    return L.overlaid(body("short", 3), body("long", 4), ["session_id", "pos"])


@query("c17_inherited", f"WITH {_LEDGER}, {_O}, t AS (SELECT session_id, id, pos, ['low', 'medium', 'high', 'critical'][id % 4 + 1] AS tier, unnest(list_distinct(supports)) AS ob FROM r) SELECT o.session_id, o.id, arg_max(t.id, {_RANK('tier')} * 1000000 - t.pos) AS reflection FROM o JOIN t ON t.session_id = o.session_id AND t.ob = o.id GROUP BY 1, 2")
def c17(spark: SparkSession, sf: str) -> DataFrame:
    obs, refl, _ = observed(spark, sf)
    return L.inherited(obs, refl.withColumn("tier", F.element_at(F.array(*map(F.lit, L.TIERS)), (F.col("id") % 4 + 1).cast("int"))))


@query("c18_inferred_tier", f"WITH {_LEDGER}, {_O}, t AS (SELECT session_id, id AS reflection, unnest(supports) AS id FROM r) SELECT t.session_id, reflection, coalesce(['low', 'medium', 'high', 'critical'][max({_RANK('relevance')})], 'medium') AS tier FROM t LEFT JOIN o USING (session_id, id) GROUP BY 1, 2")
def c18(spark: SparkSession, sf: str) -> DataFrame:
    obs, refl, _ = observed(spark, sf)
    return L.inferred_tier(refl, obs)


@query("c19_cluster_coverage", f"WITH {_LEDGER}, {_O}, cov AS (SELECT id, count(*) AS support FROM (SELECT unnest(supports) AS id FROM r) GROUP BY 1), cl AS (SELECT relevance AS key, unnest(list(DISTINCT id)) AS id FROM o GROUP BY relevance) SELECT key, coalesce(sum(support), 0)::BIGINT AS coverage FROM cl LEFT JOIN cov USING (id) GROUP BY 1")
def c19(spark: SparkSession, sf: str) -> DataFrame:
    obs, refl, _ = observed(spark, sf)
    # 100 ids at most a group.
    cited = refl.select(F.explode("supports").alias("id")).groupBy("id").agg(F.count("*").alias("support"))
    return L.summed_coverage(obs.groupBy(F.col("relevance").alias("key")).agg(F.collect_set("id").alias("ids")), cited)


@query("c20_unambiguous", f"WITH {_LEDGER} SELECT session_id, key AS id, min(pos) AS idx FROM ledger WHERE kind = 'message' GROUP BY 1, 2 HAVING count(*) = 1")
def c20(spark: SparkSession, sf: str) -> DataFrame:
    return L.unambiguous(S.ledger(spark, sf).filter("kind = 'message'").select("session_id", F.col("key").alias("id"), F.col("pos").alias("idx")))


@query("c25_after_covered", f"WITH {_LEDGER}, {_O} SELECT session_id, id, pos FROM o WHERE pos > CASE WHEN EXISTS (FROM o p WHERE p.session_id = o.session_id AND p.pos = 12) THEN 12 ELSE -1 END")
def c25(spark: SparkSession, sf: str) -> DataFrame:
    obs, _, _ = observed(spark, sf)
    return L.after_covered(obs, obs.select("session_id").distinct().withColumn("covered", F.lit(12).cast("long"))).select("session_id", "id", "pos")


@query("d08_support_counts", f"WITH {_LEDGER}, {_O}, {_SUP} SELECT * FROM sup")
def d08(spark: SparkSession, sf: str) -> DataFrame:
    return L.support_counts(observed(spark, sf)[1])


@query("d09_coverage_index", f"WITH {_LEDGER}, {_O} SELECT session_id, id, count(*) AS support FROM (SELECT session_id, unnest(supports) AS id FROM r) GROUP BY 1, 2")
def d09(spark: SparkSession, sf: str) -> DataFrame:
    return L.support_counts(observed(spark, sf)[1], distinct=False)


@query("d11_transitions", f"WITH {_LEDGER}, {_O}, f AS (SELECT session_id, id, count(*) FILTER (rid % 2 = 0) AS old, count(*) AS new FROM (SELECT session_id, id AS rid, unnest(list_distinct(supports)) AS id FROM r) GROUP BY 1, 2), t AS (SELECT relevance, tokens, CASE coalesce(old, 0) WHEN 0 THEN 'none' WHEN 1 THEN 'partial' ELSE 'strong' END AS was, CASE coalesce(new, 0) WHEN 0 THEN 'none' WHEN 1 THEN 'partial' ELSE 'strong' END AS now FROM o LEFT JOIN f USING (session_id, id)) SELECT relevance, was || '->' || now AS change, count(*) AS n, sum(tokens)::BIGINT AS tokens FROM t WHERE was <> now GROUP BY 1, 2")
def d11(spark: SparkSession, sf: str) -> DataFrame:
    obs, refl, _ = observed(spark, sf)
    return L.transitions(obs, refl.filter("id % 2 = 0"), refl)


@query("d13_relevance_counts", f"WITH {_LEDGER}, {_O} SELECT session_id, count(*) FILTER (relevance = 'low') AS low, count(*) FILTER (relevance = 'medium') AS medium, count(*) FILTER (relevance = 'high') AS high, count(*) FILTER (relevance = 'critical') AS critical FROM o GROUP BY 1")
def d13(spark: SparkSession, sf: str) -> DataFrame:
    return observed(spark, sf)[0].groupBy("session_id").agg(*[F.count_if(F.col("relevance") == t).alias(t) for t in L.TIERS])


@query("e12_drop_order", f"WITH {_LEDGER}, {_O}, {_SUP}, w AS (SELECT o.*, coalesce(support, 0) AS support, {_TIERS} AS coverage FROM o LEFT JOIN sup USING (session_id, id)) SELECT session_id, id, support, coverage, relevance, row_number() OVER (PARTITION BY session_id ORDER BY list_position(['strong', 'partial', 'none'], coverage), {_RANK('relevance')}, pos, id) AS place FROM w QUALIFY place <= 5")
def e12(spark: SparkSession, sf: str) -> DataFrame:
    obs, refl, _ = observed(spark, sf)
    return L.drop_order(obs, refl, 5).select("session_id", "id", "support", "coverage", "relevance", "place")


@query("e04_relevance_score", f"WITH {_LEDGER}, {_O} SELECT session_id, id, round(CASE relevance WHEN 'low' THEN 1 WHEN 'medium' THEN 5 ELSE 10 END + CASE WHEN count(*) OVER p > 1 THEN (row_number() OVER (PARTITION BY session_id ORDER BY pos) - 1) / (count(*) OVER p - 1) ELSE 1 END, 6) AS score FROM o WINDOW p AS (PARTITION BY session_id)")
def e04(spark: SparkSession, sf: str) -> DataFrame:
    from .operators import ledger

    base = F.when(F.col("relevance") == "low", 1).when(F.col("relevance") == "medium", 5).otherwise(10)
    return ledger.observation_scores(observed(spark, sf)[0], base).select("session_id", "id", F.round("score", 6).alias("score"))


_LONGER = "f.used + CASE WHEN f.used > 0 THEN 1 ELSE 0 END + k.tokens"


@query("e06_newest_fitting", f"""WITH RECURSIVE {_LEDGER}, k AS MATERIALIZED (SELECT session_id, pos, tokens, row_number() OVER (PARTITION BY session_id ORDER BY pos DESC) AS k FROM ledger WHERE kind = 'reflection'),
f AS (SELECT session_id, k, pos, ceil(tokens / 4) <= 150 AS fits, CASE WHEN ceil(tokens / 4) <= 150 THEN tokens ELSE 0 END AS used FROM k WHERE k = 1 UNION ALL SELECT k.session_id, k.k, k.pos, ceil(({_LONGER}) / 4) <= 150, CASE WHEN ceil(({_LONGER}) / 4) <= 150 THEN {_LONGER} ELSE f.used END FROM f JOIN k ON k.session_id = f.session_id AND k.k = f.k + 1) SELECT session_id, pos FROM f WHERE fits""")
def e06(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.ledger(spark, sf).filter("kind = 'reflection'").select("session_id", "pos", F.repeat(F.lit("x"), F.col("tokens").cast("int")).alias("line"))
    return L.newest_fitting(rows, 150)


@query("g01_merge_by_id", f"WITH {_LEDGER} SELECT session_id, key AS id, arg_min(pos, (kind = 'message')::INT * 1000000 + pos) AS pos FROM ledger WHERE kind IN ('observation', 'message') GROUP BY 1, 2")
def g01(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.ledger(spark, sf).select("session_id", F.col("key").alias("id"), "pos", "kind")
    some = lambda kind: rows.filter(F.col("kind") == kind).drop("kind")
    return L.merge_by_id(some("observation"), some("message"))


_AGE = "greatest(0, (epoch(TIMESTAMP '2024-06-01') - floor(epoch(ts))) / 86400)"
_POWER = "CASE e % 4 WHEN 0 THEN 0.34 WHEN 1 THEN 0.31 WHEN 2 THEN 0.28 ELSE 0.25 END::DOUBLE"
_BURST = "CASE WHEN s = 0 OR o / greatest(s, 1) <= 1.5 THEN 1 ELSE 1 / (1 + 0.15::DOUBLE * log2(o / greatest(s, 1))) END"


def _scored(spark: SparkSession, sf: str) -> tuple[DataFrame, Column, Column]:
    days = (F.lit("2024-06-01 00:00:00").cast("timestamp").cast("long") - F.col("ts").cast("timestamp").cast("long")) / 86400
    return S.table(spark, sf, "events"), days, F.element_at(F.array(*map(F.lit, L.TIERS)), (F.col("event_id") % 4 + 1).cast("int"))


@query("e20_cluster_score", f"SELECT e AS event_id, round((e % 4 + 1) / pow(1 + d, {_POWER}) * (1 + log2(1 + s)) * (1 + 0.3::DOUBLE * log2(1 + e % 6)) * (1 + 0.2::DOUBLE * (e % 10) / 10) * {_BURST} * 1.1::DOUBLE, 6) AS score FROM (SELECT event_id AS e, {_AGE} AS d, event_id % 5 AS s, event_id % 13 AS o FROM events)")
def e20(spark: SparkSession, sf: str) -> DataFrame:
    rows, days, tier = _scored(spark, sf)
    e = F.col("event_id")
    return rows.select("event_id", F.round(L.cluster_score(tier, days, e % 5, e % 6, (e % 10) / 10, e % 13, F.lit(1.1)), 6).alias("score"))


@query("e21_reflection_score", f"SELECT e AS event_id, round((e % 4 + 1) / pow(1 + d, {_POWER}) * (1 + log2(1 + s)) * (1 + log2(1 + e % 6)) * {_BURST} * 1.1::DOUBLE, 6) AS score FROM (SELECT event_id AS e, {_AGE} AS d, event_id % 5 AS s, event_id % 13 AS o FROM events)")
def e21(spark: SparkSession, sf: str) -> DataFrame:
    rows, days, tier = _scored(spark, sf)
    e = F.col("event_id")
    return rows.select("event_id", F.round(L.reflection_score(tier, days, e % 5, e % 6, e % 13, F.lit(1.1)), 6).alias("score"))


# --- recall and small rules -------------------------------------------------------------------------------------------


@query("h27_drill_down", r"""WITH d AS (SELECT doc_id, [ '#' || doc_id || ':src/a.ts', '#' || doc_id || ':a.ts:full', '#7:a.ts:30', '#7:b.ts:30:20', 'no drill', '#7:a:b:c'][doc_id % 6 + 1] AS q FROM documents), p AS (SELECT *, '^#(\d+):(.+?)(?::(full|\d+(?::\d+)?))?$' AS pat FROM d), x AS (SELECT doc_id, regexp_matches(q, pat) AS hit, regexp_extract(q, '^#(\d+):(.+?)(?::(full|\d+(?::\d+)?))?$', 1) AS i, regexp_extract(q, '^#(\d+):(.+?)(?::(full|\d+(?::\d+)?))?$', 2) AS f, regexp_extract(q, '^#(\d+):(.+?)(?::(full|\d+(?::\d+)?))?$', 3) AS s FROM p)
SELECT doc_id, CASE WHEN hit THEN i::BIGINT END AS index, CASE WHEN hit THEN f END AS path, CASE WHEN hit THEN s = 'full' END AS "full", CASE WHEN hit AND s NOT IN ('full', '') THEN string_split(s, ':')[1]::BIGINT END AS "offset", CASE WHEN hit AND s LIKE '%:%' THEN string_split(s, ':')[2]::BIGINT END AS "limit" FROM x""")
def h27(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    said = F.array(F.concat(F.lit("#"), n, F.lit(":src/a.ts")), F.concat(F.lit("#"), n, F.lit(":a.ts:full")), *map(F.lit, ("#7:a.ts:30", "#7:b.ts:30:20", "no drill", "#7:a:b:c")))
    return _docs(spark, sf).select("doc_id", R.drill_down(F.element_at(said, (F.col("doc_id") % 6 + 1).cast("int"))).alias("d")).select("doc_id", "d.*")


@query("h29_recall_scope", rf"WITH {_DOCS}, d AS (SELECT doc_id, ['scope:ALL find', 'a mode:touched b', 'x scope:lineage mode:File y', 'plain', 'scope:other'][doc_id % 5 + 1] || ' ' || left(text, 20) AS q FROM docs) SELECT doc_id, CASE WHEN lower(regexp_extract(q, '(?i)\bscope:(lineage|all)\b', 1)) = 'all' THEN 'all' ELSE 'lineage' END AS scope, coalesce(nullif(lower(regexp_extract(q, '(?i)\bmode:(hybrid|file|touched)\b', 1)), ''), 'hybrid') AS mode, regexp_replace(regexp_replace(regexp_replace(regexp_replace(q, '(?i)\bscope:(lineage|all)\b', ''), '(?i)\bmode:(hybrid|file|touched)\b', ''), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM d")
def h29(spark: SparkSession, sf: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, ("scope:ALL find", "a mode:touched b", "x scope:lineage mode:File y", "plain", "scope:other"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return _docs(spark, sf).select("doc_id", R.recall_scope(F.concat(said, F.lit(" "), F.substring("text", 1, 20))).alias("r")).select("doc_id", "r.*")


_TECH = " + ".join(f"len(regexp_extract_all(x, '{q(p)}')) * {w}::DOUBLE" for p, w in R.TECHNICAL)
_TECHTEXT = "['src/a.ts and go.mod ', 'callThis() of Foo::bar ', 'GET /api/v1 404 Not Found ', 'NODE_ENV --flag npm install ', 'IOError 0a1b2c3d v1.2.3 ', ''][doc_id % 6 + 1] || text"


@query("h33_technical_density", f"WITH {_DOCS} SELECT doc_id, round(1 + 0.12::DOUBLE * log2(1 + {_TECH}), 6) AS density FROM (SELECT doc_id, {_TECHTEXT} AS x FROM docs)")
def h33(spark: SparkSession, sf: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, ("src/a.ts and go.mod ", "callThis() of Foo::bar ", "GET /api/v1 404 Not Found ", "NODE_ENV --flag npm install ", "IOError 0a1b2c3d v1.2.3 ", ""))), (F.col("doc_id") % 6 + 1).cast("int"))
    return _docs(spark, sf).select("doc_id", F.round(R.technical_density(F.concat(said, F.col("text"))), 6).alias("density"))


_SNIP = "(?i)the"


@query("e16_line_snippet", rf"""WITH {_DOCS}, l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM docs), m AS (SELECT doc_id, ls, list_position(list_transform(ls, lambda x: regexp_matches(x, '{_SNIP}')), true) AS hit FROM l), w AS (SELECT *, greatest(hit - 2, 1) AS f, least(hit + 2, len(ls)) AS e FROM m WHERE hit > 0)
SELECT doc_id, array_to_string(list_concat(list_concat(CASE WHEN f > 1 THEN ['...(' || (f - 1) || ' lines above)'] ELSE [] END, list_transform(ls[f:e], lambda x: CASE WHEN length(x) <= 1000 THEN x ELSE left(x, 1000) || ' … [truncated]' END)), CASE WHEN len(ls) > e THEN ['...(' || (len(ls) - e) || ' lines below)'] ELSE [] END), chr(10)) AS snippet FROM w""")
def e16(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", R.line_snippet(F.col("text"), _SNIP).alias("snippet")).filter("snippet IS NOT NULL")


_ALLOC = "CASE WHEN c <= 0 OR b <= 0 THEN 0 WHEN c * 2000 <= greatest(0, b - c * 200) THEN greatest(floor(greatest(0, b - c * 200) / greatest(c, 1)), 2000) ELSE floor(greatest(0, b - c * 200) / greatest(c, 1)) END::BIGINT"


@query("e09_expand_allocation", f"SELECT o_orderkey, {_ALLOC} AS allocation FROM (SELECT o_orderkey, o_orderkey % 30 AS c, floor(o_totalprice / 10)::BIGINT AS b FROM orders)")
def e09(spark: SparkSession, sf: str) -> DataFrame:
    return S.table(spark, sf, "orders").select("o_orderkey", R.expand_allocation(F.col("o_orderkey") % 30, F.floor(F.col("o_totalprice") / 10)).alias("allocation"))


@query("m02_expanded", f"WITH {_DOCS} SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE {clip_sql('text', 200)} || chr(10) || '… [entry #' || doc_id || ' truncated — use recall #' || doc_id || ':text:full for the full body, #' || doc_id || ':path:full for tool file content]' END AS body FROM docs")
def m02(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", R.expanded(F.col("text"), F.lit(200), F.col("doc_id")).alias("body"))


@query("h48_sizes_and_ages", "SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) ELSE printf('%.1f MB', n / 1048576) END AS size, CASE WHEN n < 60 THEN n || 's ago' WHEN n < 3600 THEN n // 60 || 'm ago' WHEN n < 86400 THEN n // 3600 || 'h ago' WHEN n < 31536000 THEN n // 86400 || 'd ago' ELSE n // 86400 // 365 || 'y ago' END AS age FROM (SELECT o_orderkey, (floor(o_totalprice) * (o_orderkey % 900))::BIGINT AS n FROM orders)")
def h48(spark: SparkSession, sf: str) -> DataFrame:
    n = F.floor("o_totalprice") * (F.col("o_orderkey") % 900)
    return S.table(spark, sf, "orders").select("o_orderkey", R.file_size(n).alias("size"), R.file_age(n).alias("age"))


@query("h43_drop_limits", "SELECT o_orderkey, round(f, 6) AS fullness, CASE WHEN f < 0.3 THEN 'low' WHEN f < 0.6 THEN 'medium' ELSE 'high' END AS urgency, CASE WHEN d = 0 OR f < 0.1 THEN 0 ELSE greatest(1, floor(d * (0.1::DOUBLE + (least(1, greatest(0.1::DOUBLE, f)) - 0.1::DOUBLE) / 0.9::DOUBLE * 0.4::DOUBLE))) END::BIGINT AS drops FROM (SELECT o_orderkey, o_orderkey % 40 AS d, floor(o_totalprice)::BIGINT / 250000 AS f FROM orders)")
def h43(spark: SparkSession, sf: str) -> DataFrame:
    fullness = R.pool_fullness(F.floor("o_totalprice"), F.lit(250_000))
    return S.table(spark, sf, "orders").select("o_orderkey", F.round(fullness, 6).alias("fullness"), R.drop_urgency(fullness).alias("urgency"), R.max_drops(F.col("o_orderkey") % 40, fullness).alias("drops"))


@query("h40_entry_tokens", f"WITH {_DOCS} SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN ceil(length(text) / 4) ELSE 0 END::BIGINT AS tokens, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 AND doc_id % 7 > 0 THEN doc_id % 7 END AS usage FROM docs")
def h40(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ("message", "custom_message", "branch_summary", "custom"))), (i % 4 + 1).cast("int"))
    role, stop = F.when(i % 2 == 0, "assistant").otherwise("toolResult"), F.when(i % 3 == 1, "error").when(i % 3 == 2, "aborted")
    return _docs(spark, sf).select("doc_id", R.entry_tokens(kind, F.col("text")).alias("tokens"), R.usage_tokens(role, stop, i % 7).alias("usage"))


@query("h36_local_time", "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '????-??-?? ??:??' ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS said FROM events")
def h36(spark: SparkSession, sf: str) -> DataFrame:
    return S.table(spark, sf, "events").select("event_id", R.local_time(F.when(F.col("event_id") % 9 != 0, F.col("ts"))).alias("said"))


@query("h38_latest_source", "SELECT event_id, list_max(list_filter([strftime(ts, '%Y-%m-%d %H:%M'), '????', '2024-01-1' || event_id % 10], lambda x: NOT starts_with(x, '?'))) AS at FROM events")
def h38(spark: SparkSession, sf: str) -> DataFrame:
    return S.table(spark, sf, "events").select("event_id", R.latest_of(F.array(R.local_time(F.col("ts")), F.lit("????"), F.concat(F.lit("2024-01-1"), (F.col("event_id") % 10).cast("string")))).alias("at"))


@query("m22_empty_reason", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'tool_not_called' WHEN event_id % 3 > 0 AND event_id % 7 = 0 THEN 'all_rejected' WHEN event_id % 2 > 0 AND event_id % 7 = 0 THEN 'all_duplicates' WHEN event_id % 11 = 0 THEN 'empty_array' ELSE 'no_new_content' END AS reason FROM events")
def m22(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return S.table(spark, sf, "events").select("event_id", R.empty_reason(e % 5 != 0, e % 11, e % 3, e % 2, e % 7).alias("reason"))


@query("b15_provider_skip", "SELECT event_id, event_id % 4 = 0 OR (event_id % 4 = 1 AND event_id % 3 = 0) OR (event_id % 4 = 2 AND event_id % 3 = 1) AS skipped FROM events")
def b15(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    provider = F.element_at(F.array(*map(F.lit, ("openai", "local", "other", "none"))), (e % 4 + 1).cast("int"))
    api = F.when(e % 3 == 1, "chat").when(e % 3 == 2, "responses")
    return S.table(spark, sf, "events").select("event_id", R.skips_provider(F.array(*map(F.lit, (" openai ", "", "local:", "other:chat"))), provider, api).alias("skipped"))


@query("b13_relevance_default", "SELECT event_id, CASE WHEN event_type IN ('click') THEN 'high' ELSE 'low' END AS relevance FROM events")
def b13(spark: SparkSession, sf: str) -> DataFrame:
    said = F.when(F.col("event_type") == "click", "high").when(F.col("event_type") == "view", "HIGH")
    return S.table(spark, sf, "events").select("event_id", F.when(said.isin(*L.TIERS), said).otherwise("low").alias("relevance"))


_VALID = "event_id % 2 = 0 AND event_id % 5 > 0 AND event_id % 7 > 0 AND event_id % 3 < 2"


@query("b11_valid_records", f"SELECT event_id, {_VALID} AND event_id % 11 > 0 AS valid FROM events")
def b11(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    one = F.struct(
        F.when(e % 2 == 0, "0A1b2c3d4e5f").otherwise("0a1b2c").alias("id"), F.when(e % 5 > 0, "c").otherwise("").alias("content"), F.lit("2024-01-01 00:00").alias("timestamp"), F.lit("low").alias("relevance"),
        F.when(e % 7 > 0, F.array(F.lit("e1"))).otherwise(F.array().cast("array<string>")).alias("sourceEntryIds"), F.when(e % 3 < 2, (e % 3).cast("long")).alias("tokenCount"),
    )
    good = F.struct(F.lit("ffffffffffff").alias("id"), F.lit("c").alias("content"), F.lit("t").alias("timestamp"), F.lit("high").alias("relevance"), F.array(F.lit("e")).alias("sourceEntryIds"), F.lit(1).cast("long").alias("tokenCount"))
    return S.table(spark, sf, "events").select("event_id", R.valid_record(F.array(good, one), F.when(e % 11 > 0, "x").otherwise("")).alias("valid"))


@query("m21_coverage_lines", f"WITH {_LEDGER}, {_O}, {_SUP} SELECT session_id, '[' || id || '] t' || pos || ' [' || relevance || '] [coverage: ' || {_TIERS} || '] c' AS line FROM o LEFT JOIN sup USING (session_id, id)")
def m21(spark: SparkSession, sf: str) -> DataFrame:
    obs, refl, _ = observed(spark, sf)
    rows = L.with_coverage(obs, refl)
    return rows.select("session_id", R.memory_line(F.col("id").cast("string"), F.concat(F.lit("t"), F.col("pos").cast("string")), F.col("relevance"), F.lit("c"), F.col("coverage")).alias("line"))


@query("m20_when", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id * 1000 WHEN 1 THEN epoch_ms(date_trunc('second', ts::TIMESTAMP)) ELSE event_id END::DOUBLE AS at FROM events")
def m20(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    said = F.when(e % 3 == 0, (e * 1000).cast("string")).when(e % 3 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("no time")
    return S.table(spark, sf, "events").select("event_id", R.when_of(said, e).alias("at"))


@query("m04_index_annotation", f"WITH {_LEDGER}, {_O}, ix AS (SELECT session_id, pos AS entry, row_number() OVER (PARTITION BY session_id ORDER BY pos) - 1 AS idx FROM ledger WHERE kind = 'message') SELECT session_id, id, '(at index #' || string_agg(idx::VARCHAR, ', #' ORDER BY idx) || ')' AS said FROM (SELECT session_id, id, unnest(sources) AS entry FROM o) JOIN ix USING (session_id, entry) GROUP BY 1, 2")
def m04(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    obs, _, _ = observed(spark, sf)
    idx = F.row_number().over(W.partitionBy("session_id").orderBy("pos")) - 1
    index = S.ledger(spark, sf).filter("kind = 'message'").select("session_id", F.col("pos").alias("entry"), idx.alias("idx"))
    found = obs.select("session_id", "id", F.explode("sources").alias("entry")).join(index, ["session_id", "entry"])
    return found.groupBy("session_id", "id").agg(F.concat(F.lit("(at index #"), F.array_join(F.array_sort(F.collect_list("idx")), ", #"), F.lit(")")).alias("said"))


@query("m08_token_counts", "SELECT o_orderkey, CASE WHEN n >= 1000 THEN printf('%.1fk', n / 1000) ELSE n::VARCHAR END AS said FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT // (1 + o_orderkey % 300) // 100 * 100 + 7 AS n FROM orders)")
def m08(spark: SparkSession, sf: str) -> DataFrame:
    n = F.floor(F.floor(F.floor("o_totalprice") / (1 + F.col("o_orderkey") % 300)) / 100) * 100 + 7
    return S.table(spark, sf, "orders").select("o_orderkey", R.token_count(n).alias("said"))


@query("h19_skill_text", r"""WITH d AS (SELECT doc_id, '<skill name="n' || doc_id % 3 || '" x>body' || chr(10) || '</skill> ' || left(coalesce(text, ''), 50) || ' <skill name="z">open' AS t FROM documents) SELECT doc_id, regexp_replace(t, '<skill\s+name="([^"]+)"[^>]*>[\s\S]*?(?:</skill>|$)', '[skill: \1]', 'g') AS said FROM d""")
def h19(spark: SparkSession, sf: str) -> DataFrame:
    said = F.concat(F.lit('<skill name="n'), (F.col("doc_id") % 3).cast("string"), F.lit('" x>body\n</skill> '), F.substring("text", 1, 50), F.lit(' <skill name="z">open'))
    return _docs(spark, sf).select("doc_id", R.collapse_skill_text(said).alias("said"))


@query("h32_strip_markdown", r"WITH d AS (SELECT doc_id, doc_id::VARCHAR AS n FROM documents) SELECT doc_id, 'see text' || n || ' and code' || n || ' bold' || n || ' under' || n || ' it' || n || ' a_b_c gone' AS said FROM d")
def h32(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    said = F.concat(F.lit("see [text"), n, F.lit("](http://x) and `code"), n, F.lit("` **bold"), n, F.lit("** __under"), n, F.lit("__ *it"), n, F.lit("* a_b_c ~~gone~~"))
    return _docs(spark, sf).select("doc_id", R.strip_markdown(said).alias("said"))


@query("b10_counted", f"WITH {_C} SELECT session_id, count(*) FILTER (role <> 'toolResult') AS counted, count(*) AS n FROM c GROUP BY 1")
def b10(spark: SparkSession, sf: str) -> DataFrame:
    return messages(spark, sf).groupBy("session_id").agg(F.count_if(F.col("role") != "toolResult").alias("counted"), F.count("*").alias("n"))
