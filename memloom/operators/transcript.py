"""From messages to the sections of a session's summary: blocks, goals, preferences, commits, files, open problems, tool lines.

Messages have session_id, pos, role, content (array<struct<type, text, thinking, redacted, name, args, mimeType>>), tool_name,
is_error, command and output; blocks have session_id, pos, n (place in the message), kind, name, text, is_error and args. All
operators work per session on one partitioning by session_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import rules as R
from ..functions import text as T

ARGS = "struct<path:string,file_path:string,filePath:string,file:string,command:string,query:string,content:string,oldText:string,newText:string,edits:array<struct<oldText:string,newText:string>>,keys:array<string>>"
PART = f"struct<type:string,text:string,thinking:string,redacted:boolean,name:string,args:{ARGS},mimeType:string>"
BLOCK = f"struct<kind:string,name:string,text:string,is_error:boolean,args:{ARGS}>"
# Tools that read and write files, and the caps of sections.
READ_TOOLS, WRITE_TOOLS = ("Read", "read_file", "View"), ("Edit", "Write", "edit", "write", "edit_file", "write_file", "MultiEdit")
GOALS, PREFERENCES, OUTSTANDING, COMMITS, FILES, TOOL_LINES = 8, 10, 5, 8, 10, 8


def text_of(content: Column) -> Column:
    """Text parts, one a line."""
    return F.array_join(F.transform(F.filter(content, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")


def _block(kind: str | Column, text: Column, name: Column | None = None, is_error: Column | None = None, args: Column | None = None) -> Column:
    null = lambda c, t: F.lit(None).cast(t) if c is None else c
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), null(name, "string").alias("name"), text.alias("text"), null(is_error, "boolean").alias("is_error"), null(args, ARGS).alias("args")).cast(BLOCK)


def blocks(messages: DataFrame) -> DataFrame:
    """A user message is its text and a block for each image, empty only if it has neither; an assistant's parts are a block
    each; results and commands are one."""
    content = F.coalesce("content", F.array().cast(f"array<{PART}>"))
    said = T.sanitize(text_of(content))
    none = F.array().cast(f"array<{BLOCK}>")
    images = F.transform(F.filter(content, lambda p: p["type"] == "image"), lambda p: _block("user", F.concat(F.lit("[image: "), p["mimeType"], F.lit("]"))))
    user = F.concat(F.when(said != "", F.array(_block("user", said))).otherwise(none), images)
    user = F.when(F.size(user) > 0, user).otherwise(F.array(_block("user", F.lit(""))))
    kept = F.filter(content, lambda p: p["type"].isin("text", "thinking", "toolCall"))
    kind = lambda p: F.when(p["type"] == "text", "assistant").when(p["type"] == "thinking", "thinking").otherwise("tool_call")
    parts = F.transform(kept, lambda p: _block(kind(p), F.when(p["type"] == "text", T.sanitize(p["text"])).when(p["type"] == "thinking", T.sanitize(p["thinking"])), F.when(p["type"] == "toolCall", p["name"]), None, F.when(p["type"] == "toolCall", p["args"])))
    own = F.when(F.col("role") == "user", user).when(F.col("role") == "assistant", parts).when(F.col("role") == "toolResult", F.array(_block("tool_result", said, F.col("tool_name"), F.col("is_error")))).when(F.col("role") == "bashExecution", F.array(_block("bash", F.concat_ws("\n", F.concat(F.lit("$ "), F.coalesce("command", F.lit(""))), F.coalesce("output", F.lit("")))))).otherwise(none)
    return messages.select("session_id", "pos", F.posexplode(own).alias("n", "b")).select("session_id", "pos", "n", "b.*")


def rendered(messages: DataFrame) -> DataFrame:
    """role and summary of each message: text cut to 300 characters (results to 200), tool calls before it."""
    content = F.coalesce("content", F.array().cast(f"array<{PART}>"))
    said = text_of(content)
    calls = F.array_join(F.transform(F.filter(content, lambda p: p["type"] == "toolCall"), lambda p: F.concat(p["name"], F.lit("("), R.summarize_args(p["args"]), F.lit(")"))), ", ")
    result = F.concat(F.when(F.col("is_error"), "ERROR ").otherwise(""), F.lit("["), "tool_name", F.lit("] "), T.clip(said, 200))
    summary = F.when(F.col("role") == "user", T.clip(said, 300)).when(F.col("role") == "toolResult", result).otherwise(F.concat(F.when(calls != "", F.concat(calls, F.lit("\n"))).otherwise(""), T.clip(said, 300)))
    return messages.select("session_id", "pos", F.when(F.col("role") == "toolResult", "tool_result").otherwise(F.col("role")).alias("role"), summary.alias("summary"))


def touched_files(messages: DataFrame) -> DataFrame:
    """Per session and path: the calls that wrote it, in order."""
    calls = messages.select("session_id", "pos", F.posexplode("content").alias("n", "p")).filter((F.col("p.type") == "toolCall") & R.content_bearing(F.col("p.args")))
    rows = calls.select("session_id", R.path_of(F.col("p.args")).alias("path"), F.struct("pos", "n", F.col("p.name").alias("tool")).alias("e"))
    entries = F.transform(F.sort_array(F.collect_list("e")), lambda e: F.concat(F.lit("#"), e["pos"].cast("string"), F.lit(" ("), e["tool"], F.lit(")")))
    return rows.groupBy("session_id", "path").agg(F.array_join(entries, ", ").alias("entries"))


def file_matches(messages: DataFrame) -> DataFrame:
    """Per writing call: path, tool and how many lines with text it carries."""
    calls = messages.select("session_id", "pos", F.posexplode("content").alias("n", "p")).filter((F.col("p.type") == "toolCall") & R.content_bearing(F.col("p.args")))
    lines = F.filter(F.split(R.payload(F.col("p.args"), 1 << 30), "\n"), lambda x: R.trim(x) != "")
    return calls.select("session_id", "pos", R.path_of(F.col("p.args")).alias("path"), F.col("p.name").alias("tool"), F.size(lines).cast("long").alias("lines"))


def file_activity(rows: DataFrame) -> DataFrame:
    """Per session the files that blocks read and modified, sorted, less the folders that all absolute paths share (two deep at
    least)."""
    calls = rows.filter("kind = 'tool_call'").withColumn("path", R.path_of(F.col("args"))).filter("path <> ''")
    named = lambda names: F.array_sort(F.collect_set(F.when(F.col("name").isin(*names), F.col("path"))))
    sets = calls.groupBy("session_id").agg(named(READ_TOOLS).alias("read"), named(WRITE_TOOLS).alias("modified"))
    dirs = F.transform(F.filter(F.concat("read", "modified"), lambda p: F.startswith(p, F.lit("/"))), lambda p: F.slice(F.split(p, "/"), F.lit(1), F.size(F.split(p, "/")) - 1))

    def common(a: Column, b: Column) -> Column:
        same = F.transform(F.arrays_zip(a.alias("a"), F.slice(b, F.lit(1), F.size(a)).alias("b")), lambda x: F.coalesce(x["a"] == x["b"], F.lit(False)))
        n = F.coalesce(F.nullif(F.array_position(same, False).cast("int"), F.lit(0)) - 1, F.size(a))
        return F.slice(a, F.lit(1), F.least(n, F.size(b)))

    shared = F.when(F.size("dirs") >= 2, F.aggregate("dirs", F.element_at("dirs", 1), common)).otherwise(F.array().cast("array<string>"))
    prefix = F.when(F.size("shared") >= 2, F.concat(F.array_join("shared", "/"), F.lit("/"))).otherwise("")
    cut = lambda c: F.transform(c, lambda p: F.when((F.col("prefix") != "") & F.startswith(p, F.col("prefix")), F.substring(p, F.length("prefix") + 1, F.length(p))).otherwise(p)).alias(c)
    return sets.withColumn("dirs", dirs).withColumn("shared", shared).withColumn("prefix", prefix).select("session_id", cut("read"), cut("modified"))


def goals(rows: DataFrame) -> DataFrame:
    """Per session: the first user block's goals, and those of the latest that changes the scope or sets a task; 8 at most."""
    users = rows.filter("kind = 'user'").select("session_id", "pos", "n", "text", R.goal_lines(F.col("text")).alias("lines")).filter(F.size("lines") > 0)
    at = F.struct("pos", "n")
    users = users.withColumn("first", F.min(at).over(W.partitionBy("session_id")))
    ref = F.concat(F.lit(" (#"), F.col("pos").cast("string"), F.lit(")"))
    leading = F.substring("text", 1, 200)
    scope, task = leading.rlike(R.java(R.SCOPE_CHANGE)), leading.rlike(R.java(R.TASK)) & (F.length(F.element_at("lines", 1)) > 15)
    some = lambda n, most: F.transform(F.slice("lines", 1, n), lambda x: F.concat(T.clip(x, most), ref))
    first = at == F.col("first")
    users = users.withColumn("own", F.when(first, some(6, 80)).when(scope, some(3, 200)).when(task, some(2, 200)))
    ends = users.groupBy("session_id").agg(F.max(F.when(first, F.col("own"))).alias("a"), F.max_by("own", F.when(~first & F.col("own").isNotNull(), at)).alias("b"), F.count_if(~first & F.col("own").isNotNull()).alias("later"))
    marked = F.when(F.col("later") > 0, F.concat(F.array(F.lit("[Scope change]")), "b")).otherwise(F.array().cast("array<string>"))
    return ends.select("session_id", F.slice(F.concat("a", marked), 1, GOALS).alias("goals"))


def preferences(rows: DataFrame) -> DataFrame:
    """Per session: preferences of user blocks, at most one new one from each block, the first of each wording, 10 at most."""
    # A block gives its first line that no earlier block has given, so blocks are folded in order.
    users = rows.filter("kind = 'user'").select("session_id", F.struct("pos", "n", F.transform(R.preference_line(F.col("text")), lambda x: T.clip(x, 200)).alias("lines")).alias("b")).filter(F.size("b.lines") > 0)
    empty = F.array().cast("array<string>")

    def step(acc: Column, b: Column) -> Column:
        new = F.filter(b["lines"], lambda x: ~F.array_contains(acc["seen"], F.lower(x)))
        some = F.slice(new, 1, 1)
        return F.struct(F.concat(acc["seen"], F.transform(some, lambda x: F.lower(x))).alias("seen"), F.concat(acc["out"], some).alias("out"))

    # The last block can't add to a full list, so the fold holds 10 lines of a session and what they look like in lower case.
    full = lambda acc, b: F.when(F.size(acc["out"]) >= PREFERENCES, acc).otherwise(step(acc, b))
    state = F.struct(empty.alias("seen"), empty.alias("out"))
    return users.groupBy("session_id").agg(F.aggregate(F.sort_array(F.collect_list("b")), state, full)["out"].alias("preferences"))


def outstanding(rows: DataFrame) -> DataFrame:
    """Per session: failed results and lines that tell of failures in the last 20 blocks, 5 at most."""
    newest = W.partitionBy("session_id").orderBy(F.desc("pos"), F.desc("n"))
    tail = rows.withColumn("back", F.row_number().over(newest)).filter("back <= 20")
    line = R.blocker_line(F.col("text"))
    failed = (F.col("kind") == "tool_result") & F.coalesce("is_error", F.lit(False))
    item = F.when(failed, F.concat(F.lit("["), F.col("name"), F.lit("] "), T.clip(F.element_at(F.split("text", "\n"), 1), 150))).when(F.col("kind") == "user", F.concat(F.lit("[user] "), T.clip_sentence(line, 150))).when(F.col("kind") == "assistant", T.clip_sentence(line, 150))
    items = tail.select("session_id", "back", item.alias("item"), failed.alias("failed")).filter("item IS NOT NULL")
    # Failed results may repeat, other lines count once.
    seen = F.row_number().over(W.partitionBy("session_id", "item").orderBy(F.desc("back")))
    kept = items.withColumn("seen", seen).filter("failed OR seen = 1")
    listed = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("back"), "item"))), lambda x: x["item"])
    return kept.groupBy("session_id").agg(F.slice(listed, 1, OUTSTANDING).alias("outstanding"))


def commits(rows: DataFrame) -> DataFrame:
    """Per session and commit: its place, hash (from the next two blocks, if they are results) and message, the first of each."""
    order = W.partitionBy("session_id").orderBy("pos", "n")
    found = F.when(F.col("kind") == "tool_result", R.commit_hash(F.col("text")))
    made = rows.withColumn("found", found).withColumn("hash", F.coalesce(F.lead("found", 1).over(order), F.lead("found", 2).over(order)))
    message = F.when((F.col("kind") == "tool_call") & (F.col("name") == "bash"), R.commit_message(F.col("args.command")))
    made = made.withColumn("message", message).filter("message IS NOT NULL")
    return made.groupBy("session_id", "hash", "message").agg(F.min(F.struct("pos", "n")).alias("at")).select("session_id", F.col("at.pos").alias("pos"), F.col("at.n").alias("n"), "hash", "message")


def commit_lines(found: DataFrame) -> DataFrame:
    """Per session: the last 8 commits as lines."""
    line = F.concat(F.coalesce(F.concat("hash", F.lit(": ")), F.lit("")), "message")
    newest = W.partitionBy("session_id").orderBy(F.desc("pos"), F.desc("n"))
    last = found.withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= COMMITS)
    return last.groupBy("session_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "n", line.alias("line")))), lambda x: x["line"]).alias("commits"))


def tool_lines(rows: DataFrame) -> DataFrame:
    """Tool calls as lines, consecutive equal ones of a turn as one: session_id, turn, first, line, refs and times. A turn is what
    lies between two user blocks."""
    order = W.partitionBy("session_id").orderBy("pos", "n")
    rows = rows.withColumn("turn", F.coalesce(F.sum((F.col("kind") == "user").cast("long")).over(order), F.lit(0)))
    said = rows.filter("kind IN ('tool_call', 'assistant')").withColumn("line", F.when(F.col("kind") == "tool_call", R.one_liner(F.col("name"), F.col("args"))))
    new = ~F.coalesce(F.lag("line").over(W.partitionBy("session_id", "turn").orderBy("pos", "n")) == F.col("line"), F.lit(False))
    said = said.withColumn("island", F.sum(new.cast("long")).over(W.partitionBy("session_id", "turn").orderBy("pos", "n"))).filter("line IS NOT NULL")
    refs = F.array_join(F.transform(F.array_sort(F.collect_list("pos")), lambda p: F.concat(F.lit("#"), p.cast("string"))), ", ")
    return said.groupBy("session_id", "turn", "island").agg(F.min(F.struct("pos", "n")).alias("first"), F.first("line").alias("line"), refs.alias("refs"), F.count("*").alias("times"))


def kept_tool_lines(lines: DataFrame, most: int = TOOL_LINES) -> DataFrame:
    """Each turn's last `most` tool lines, and on the first of them how many earlier ones are left out."""
    newest = W.partitionBy("session_id", "turn").orderBy(F.desc("island"))
    ranked = lines.withColumn("back", F.row_number().over(newest)).withColumn("n", F.count("*").over(W.partitionBy("session_id", "turn")))
    text = F.concat("line", F.lit(" ("), "refs", F.lit(")"), F.when(F.col("times") > 1, F.concat(F.lit(" x"), F.col("times").cast("string"))).otherwise(""))
    return ranked.filter(F.col("back") <= most).select("session_id", "turn", F.col("first.pos").alias("pos"), text.alias("line"), F.when((F.col("back") == most) & (F.col("n") > most), F.concat(F.lit("* ("), (F.col("n") - most).cast("string"), F.lit(" earlier tool-call entries omitted)"))).alias("omitted"))


def section(title: str, items: Column) -> Column:
    """A section with its heading, null if it has no items."""
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.concat(F.lit(f"[{title}]\n"), F.array_join(F.transform(items, lambda i: F.concat(F.lit("- "), i)), "\n")))


def file_lines(activity: DataFrame) -> DataFrame:
    capped = lambda c: F.concat(F.array_join(F.slice(c, 1, FILES), ", "), F.when(F.size(c) > FILES, F.concat(F.lit(" (+"), (F.size(c) - FILES).cast("string"), F.lit(" more)"))).otherwise(""))
    line = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{name}: "), capped(c)))
    return activity.select("session_id", F.array_compact(F.array(line("Modified", F.col("modified")), line("Read", F.col("read")))).alias("files"))


def without_goals(wanted: Column, reached: Column) -> Column:
    """Preferences that no goal says in the same words."""
    low = F.transform(F.coalesce(reached, F.array().cast("array<string>")), lambda x: F.lower(R.trim(x)))
    return F.filter(wanted, lambda x: ~F.array_contains(low, F.lower(R.trim(x))))


def sections(rows: DataFrame) -> DataFrame:
    """Per session: goals, files, commits, outstanding and preferences as lists."""
    out = rows.select("session_id").distinct()
    for part in (goals(rows), file_lines(file_activity(rows)), commit_lines(commits(rows)), outstanding(rows), preferences(rows)):
        out = out.join(part, "session_id", "left")
    return out.withColumn("preferences", without_goals(F.col("preferences"), F.col("goals")))


def summary(parts: DataFrame) -> DataFrame:
    """Per session: the five headed sections as one text, empty ones left out."""
    heads = [section(t, F.col(c)) for t, c in (("Session Goal", "goals"), ("Files And Changes", "files"), ("Commits", "commits"), ("Outstanding Context", "outstanding"), ("User Preferences", "preferences"))]
    return parts.select("session_id", F.concat_ws("\n\n", *heads).alias("summary"))


def merged(before: Column, fresh: Column, header: str) -> Column:
    """Items of a section of an earlier summary and the fresh one: goals keep their first 8, commits their last 8, others their
    last 15; outstanding ones are fresh only."""
    if header == "Outstanding Context":
        return fresh
    none = F.array().cast("array<string>")
    both = F.array_distinct(F.concat(F.coalesce(before, none), F.coalesce(fresh, none)))
    most = 8 if header in ("Session Goal", "Commits") else 15
    return F.slice(both, 1, most) if header == "Session Goal" else F.slice(both, F.greatest(F.size(both) - most + 1, F.lit(1)), F.lit(most))


def merged_files(before: Column, fresh: Column) -> Column:
    """struct<modified, read> of two: unions, what is modified not read."""
    modified = F.array_union(before["modified"], fresh["modified"])
    return F.struct(modified.alias("modified"), F.array_except(F.array_union(before["read"], fresh["read"]), modified).alias("read"))
