"""Small rules of the memory engine as Column expressions: arguments of tool calls, lines, patterns, formats, scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Argument names that hold a path, in order of preference, and the limit of a call's payload.
PATH_KEYS = ("path", "file_path", "filePath", "file")
PAYLOAD_CHARS = 10_240
# Patterns that tell scope changes, tasks, remarks that are no goals, templates, preferences and blockers.
SCOPE_CHANGE = r"(?i)\b(instead|actually|change of plan|forget that|new task|switch to|now I want|pivot|let'?s do|stop .* and)\b"
TASK = r"(?i)\b(fix|implement|add|create|build|refactor|debug|investigate|update|remove|delete|migrate|deploy|test|write|set up)\b"
NOISE_SHORT = r"(?i)^(ok|yes|no|sure|yeah|yep|go|hi|hey|thx|thanks|ok\b.*|y|n|k)\s*[.!?]*$"
NO_GOAL = r"^\s*[\[│├└─╭╰]|```|^\s*(=[A-Z]+\(|function |const |let |var |import |export |class )|^(https?:|file:|\/[A-Za-z])|\\n|^\s*For each\b|\bin full\b[^\n]*\b(comments|issue|issues|PRs?|linked)\b"
TEMPLATE = r"(?i)^\s*(For each\b|Do NOT implement\b|Analyze and propose\b|If Task\/context\b|Output:\s*$)"
PREFERENCES = (
    r"(?i)\bprefer(?:s|red|ring)?\s+\w",
    r"(?i)\bdon'?t want\b",
    r"(?i)\balways (?:use|do|run|prefer|keep|make|format|write|add|set|put|prefix|start|include|append)\b",
    r"(?i)\bnever (?:use|do|run|push|commit|write|ignore|add|set|put|remove|delete|include|deploy)\b",
    r"(?i)\bplease (?:use|avoid|keep|make|don'?t|do not|format|write)\b",
    r"(?i)\b(?:style|format|language|naming)\s*[:=]\s*\S",
)
BLOCKER = r"(?i)\b(fail(ed|s|ure|ing)?|broken|cannot|can't|won't work|does not work|doesn't work|still (broken|failing|wrong)|blocked|blocker|not (fixed|resolved|working)|crash(es|ed|ing)?)\b"
# What a commit command and its output look like.
COMMIT = r"\bgit\s+commit\b"
COMMIT_MESSAGE = r"""git\s+commit[^\n]*?-m\s+(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|\$?'((?:[^'\\]|\\.)*)')"""
HASH_BRACKET, HASH_RANGE, HASH_PLAIN = r"\[\S+\s+([0-9a-f]{7,12})\]", r"\b[0-9a-f]{7,12}\.\.([0-9a-f]{7,12})\b", r"\b([0-9a-f]{8,12})\b"
# Five families of technical words, and what one of each counts.
_FILES = "ts|tsx|js|jsx|mjs|cjs|vue|svelte|astro|html|css|scss|sass|less|wasm|rs|go|c|cpp|cc|cxx|h|hpp|zig|nim|java|kt|kts|scala|cs|fs|swift|py|rb|php|lua|pl|sh|bash|zsh|fish|json|json5|jsonc|yaml|yml|toml|xml|ini|env|sql|prisma|graphql|gql|proto|tf|hcl"
TECHNICAL = (
    (rf"(?i)\b[\w.-]+[\\/][\w.-]+(?:\.(?:{_FILES}))?\b|\b[\w.-]+\.(?:{_FILES})\b|\b(?:Dockerfile|Containerfile|Makefile|Vagrantfile|Procfile|package\.json|Cargo\.toml|go\.mod|requirements\.txt|pyproject\.toml|pom\.xml|build\.gradle|\.gitignore|\.dockerignore|\.env(?:\.[\w-]+)?)\b", 1.5),
    (r"\b[a-zA-Z_]\w*\(\)|\b[a-zA-Z_]\w*(?:::|->|\.)[a-zA-Z_]\w*|\b[a-z]+[A-Z]\w*\b|\b[A-Z][a-z]+[A-Z]\w*\b|\b(?:Array|Option|Result|Map|Set|Promise|Vec|List|HashMap)<[\w\s,<>]+>|@\w+(?:\([^)]*\))?|#\[\w+(?:\([^)]*\))?\]", 1.0),
    (r"(?i)\b(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+\/[/\w:.-]*|\b[1-5]\d{2}\s+(?:OK|Created|Accepted|No Content|Bad Request|Unauthorized|Forbidden|Not Found|Conflict|Too Many Requests|Internal Server Error|Bad Gateway|Service Unavailable)\b|\/(?:api|v[0-9]+|auth|users|healthz|metrics|ws|graphql)[/\w:.-]*", 1.5),
    (r"\b(?:REACT_APP_|NEXT_PUBLIC_|VITE_|DATABASE_|NODE_|AWS_|DOCKER_|KUBE_|PI_|PI_BLACKHOLE_)[A-Z0-9_]+\b|\b[A-Z][A-Z0-9_]{3,}\b|\b(?:--[a-z0-9_-]+(?:=[^\s]+)?|-[a-zA-Z]{1,3})\b|\b(?:npm|pnpm|yarn|bun|cargo|go|rustc|docker|kubectl|git|make|pytest|pip|uv)\s+[a-z0-9_-]+", 1.5),
    (r"(?i)\b[A-Z]\w*(?:Exception|Error|Fault|Failure|Panic|SIGSEGV|SIGTERM|ECONNREFUSED|ETIMEDOUT|ENOTFOUND)\b|\b[a-f0-9]{7,40}\b|\bv?\d+\.\d+\.\d+(?:-[a-zA-Z0-9_.-]+)?\b", 1.0),
)
# The same families for Java: a boundary is looked at from one side where the other is known and once for alternatives that share
# it, and runs that can't end earlier are not given back. Alternatives that another one of the same family covers are left out.
_EDGE = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
TECHNICAL_JAVA = (
    rf"(?i){_EDGE}(?:[\w.-]++[\\/][\w.-]+(?:\.(?:{_FILES}))?{_EDGE}|(?=\w*+[.-])[\w.-]+\.(?:{_FILES})(?!\w)|(?:(?:Docker|Container|Make|Vagrant|Proc)file|(?=\w*+\.)(?:package\.json|Cargo\.toml|go\.mod|requirements\.txt|pyproject\.toml|pom\.xml|build\.gradle|\.gitignore|\.dockerignore|\.env(?:\.[\w-]+)?)){_EDGE})",
    r"(?<!\w)(?:[a-zA-Z_]\w*+(?:\(\)|(?:::|->|\.)[a-zA-Z_]\w*+)|[a-z]++[A-Z]\w*+|[A-Z][a-z]++[A-Z]\w*+|(?:Array|Option|Result|Map|Set|Promise|Vec|List|HashMap)<[\w\s,<>]+>)|@\w++(?:\([^)]*\))?|#\[\w++(?:\([^)]*\))?\]",
    r"(?i)(?<!\w)(?:(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s++\/[/\w:.-]*+|[1-5]\d{2}\s++(?:OK|Created|Accepted|No Content|Bad Request|Unauthorized|Forbidden|Not Found|Conflict|Too Many Requests|Internal Server Error|Bad Gateway|Service Unavailable)(?!\w))|\/(?:api|v[0-9]+|auth|users|healthz|metrics|ws|graphql)[/\w:.-]*+",
    rf"(?<!\w)(?:[A-Z][A-Z0-9_]{{3,}}+(?!\w)|(?:npm|pnpm|yarn|bun|cargo|go|rustc|docker|kubectl|git|make|pytest|pip|uv)\s++[a-z0-9_-]++)|-(?<=\w-)(?:-[a-z0-9_-]+(?:=[^\s]+)?|[a-zA-Z]{{1,3}}){_EDGE}",
    rf"(?i)(?<!\w)(?:[A-Z]\w*+(?<=on|or|lt|re|ic|gv|rm|ed|ut|nd)(?<=\w(?:Exception|Error|Fault|Failure|Panic|SIGSEGV|SIGTERM|ECONNREFUSED|ETIMEDOUT|ENOTFOUND))|[a-f0-9]{{7,40}}+(?!\w)|v?\d++\.\d++\.\d+(?:-[a-zA-Z0-9_.-]+)?{_EDGE})",
)
# Drop limits of an observation pool, and the budget rules of recall answers.
DROP_SKIP, DROP_LOW, DROP_MEDIUM, DROP_MIN_RATIO, DROP_MAX_RATIO = 0.1, 0.3, 0.6, 0.1, 0.5
EXPAND_FLOOR, EXPAND_OVERHEAD = 2_000, 200


def java(pattern: str) -> str:
    """The pattern with word boundaries between ASCII letters and others, as its \\w has them."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def trim(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strings(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


# --- arguments of tool calls: struct<path, file_path, command, query, content, oldText, newText, keys> -------------------


def path_of(args: Column) -> Column:
    return F.coalesce(*[args.getField(k) for k in PATH_KEYS])


def summarize_args(args: Column) -> Column:
    """path=, command= or query=, else the names of all arguments."""
    path = path_of(args)
    return F.when(path != "", F.concat(F.lit("path="), path)).when(args["command"].isNotNull(), F.concat(F.lit("command="), args["command"])).when(args["query"].isNotNull(), F.concat(F.lit("query="), args["query"])).otherwise(F.array_join(args["keys"], ", "))


def content_bearing(args: Column) -> Column:
    """A path, and content, edits, or an old or new text without edits."""
    filled = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    edits = F.coalesce(F.size(args["edits"]) > 0, F.lit(False))
    return path_of(args).isNotNull() & (filled(args["content"]) | edits | (args["edits"].isNull() & (filled(args["oldText"]) | filled(args["newText"]))))


def payload(args: Column, most: int = PAYLOAD_CHARS) -> Column:
    """What a call writes: its content, then edits by halves, or its old and new text; `most` characters at most."""
    part = lambda c, n: F.coalesce(F.concat(F.substring(c, 1, n), F.lit("\n")), F.lit(""))

    def edit(acc: Column, e: Column) -> Column:
        old = F.when(F.length(acc) >= most, acc).otherwise(F.concat(acc, part(e["oldText"], most // 2)))
        return F.when(F.length(old) >= most, old).otherwise(F.concat(old, part(e["newText"], most // 2)))

    first = part(args["content"], most)
    edited = F.when(args["edits"].isNull(), F.concat(first, part(args["oldText"], most), part(args["newText"], most))).otherwise(F.aggregate(F.coalesce(args["edits"], F.array().cast("array<struct<oldText:string,newText:string>>")), first, edit))
    return F.when(content_bearing(args), F.substring(edited, 1, most)).otherwise("")


# --- lines ------------------------------------------------------------------------------------------------------------


def goal_lines(text: Column) -> Column:
    """Lines that may be goals: up to a template's first line, of 6 to 200 characters, no remark, code or path, unbulleted."""
    every = F.filter(F.transform(F.split(text, "\n"), trim), lambda x: x != "")
    hit = F.array_position(F.transform(every, lambda x: x.rlike(java(TEMPLATE))), True)
    upto = F.when(hit > 0, F.slice(every, F.lit(1), F.greatest(hit.cast("int") - 1, F.lit(0)))).otherwise(every)
    good = F.filter(upto, lambda x: (F.length(x) > 5) & (F.length(x) <= 200) & ~x.rlike(java(NOISE_SHORT)) & ~x.rlike(java(NO_GOAL)))
    return F.filter(F.transform(collapse_skill_lines(good), lambda x: trim(F.regexp_replace(x, r"^\s*(?:[-*+]|\d+\.)\s+", ""))), lambda x: F.length(x) > 5)


def collapse_skill_lines(lines: Column) -> Column:
    """Skill blocks as one line a name, the rest of them dropped."""
    state = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("out"))
    opening = r'^-?\s*<skill\s+name="([^"]+)"'

    def step(acc: Column, x: Column) -> Column:
        name = F.regexp_extract(x, opening, 1)
        opens, known = x.rlike(opening), F.array_contains(acc["seen"], name)
        keep = F.when(opens, F.when(known, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("[skill: "), name, F.lit("]"))))).when(acc["inside"], F.array().cast("array<string>")).otherwise(F.array(x))
        inside = F.when(opens, F.lit(True)).when(acc["inside"], ~x.rlike(r"^-?\s*</skill>")).otherwise(F.lit(False))
        return F.struct(inside.alias("inside"), F.when(opens & ~known, F.concat(acc["seen"], F.array(name))).otherwise(acc["seen"]).alias("seen"), F.concat(acc["out"], keep).alias("out"))

    # Without an opening tag there is nothing to fold.
    return F.when(F.exists(lines, lambda x: x.rlike(opening)), F.aggregate(lines, state, step)["out"]).otherwise(lines)


def collapse_skill_text(text: Column) -> Column:
    return F.regexp_replace(text, r'<skill\s+name="([^"]+)"[^>]*>[\s\S]*?(?:</skill>|$)', "[skill: $1]")


def preference_line(text: Column) -> Column:
    """Lines that state a preference: of 5 to 200 characters, no questions."""
    stated = lambda x: reduce(lambda a, b: a | b, [x.rlike(java(p)) for p in PREFERENCES])
    every = F.transform(F.split(text, "\n"), trim)
    return F.filter(every, lambda x: F.length(x).between(5, 200) & ~F.endswith(x, F.lit("?")) & ~F.contains(x, F.lit("?...")) & stated(x))


def blocker_line(text: Column) -> Column:
    """The first line that tells of a failure and begins like a sentence."""
    every = F.transform(F.split(text, "\n"), trim)
    return F.try_element_at(F.filter(every, lambda x: x.rlike(java(BLOCKER)) & (F.length(x) >= 15) & ~x.rlike(r"^\s*[-*+>]\s") & ~x.rlike(r"^\s*\(") & x.rlike(r"^\s*[\"'`*_]?[A-Z`]")), F.lit(1))


def commit_message(command: Column) -> Column:
    """First line of a commit command's message, null without one."""
    groups = [F.regexp_extract(command, java(COMMIT_MESSAGE), i) for i in (1, 2, 3)]
    said = F.coalesce(*[F.when(g != "", g) for g in groups])
    clean = F.replace(F.replace(said, F.lit('\\"'), F.lit('"')), F.lit("\\'"), F.lit("'"))
    first = trim(F.element_at(F.split(clean, r"\\n|\n"), 1))
    return F.when(command.rlike(java(COMMIT)) & (first != ""), first)


def commit_hash(output: Column) -> Column:
    found = [F.regexp_extract(output, java(p), 1) for p in (HASH_BRACKET, HASH_RANGE, HASH_PLAIN)]
    return F.coalesce(*[F.when(h != "", h) for h in found])


def one_liner(name: Column, args: Column) -> Column:
    """A tool call as one line: its file or pattern, its command, its query, or its name alone."""
    quoted = lambda x: F.concat(F.lit("* "), name, F.lit(' "'), x, F.lit('"'))
    path = path_of(args)
    return F.when(path != "", quoted(path)).when(name.isin("bash", "Bash"), quoted(compress_shell(F.coalesce(args["command"], F.lit(""))))).when(args["query"].isNotNull(), quoted(T.clip(args["query"], 60))).otherwise(F.concat(F.lit("* "), name))


# Commands at the end of a pipe that only shape the output, and the cap of a line.
PIPE_TAIL = r"\s*\|\s*(?:head|tail|sort|wc|column|tr|cut|uniq)(?:\s[^|]*)?$"
SHELL_CAP = 120


def compress_shell(command: Column) -> Column:
    """Lines joined, a leading cd and up to ten shaping ends of the pipe cut, 120 characters at most."""
    joined = F.array_join(F.filter(F.transform(F.split(command, "\n"), trim), lambda x: x != ""), "; ")
    out = F.regexp_replace(joined, r"^cd\s+\S+\s*&&\s*", "")
    for _ in range(10):
        out = F.regexp_replace(out, PIPE_TAIL, "")
    head = F.substring(out, 1, SHELL_CAP - 1)
    at = F.length(head) - F.instr(F.reverse(head), " ")
    end = F.when((F.instr(head, " ") > 0) & (at > SHELL_CAP * 0.6), at).otherwise(SHELL_CAP - 3)
    return F.when(F.length(out) > SHELL_CAP, F.concat(F.regexp_replace(F.substring(out, F.lit(1), end), r"\s+$", ""), F.lit("..."))).otherwise(out)


# --- recall -----------------------------------------------------------------------------------------------------------


def drill_down(query: Column) -> Column:
    """#N:path[:full|:offset[:limit]] as a struct, null if the query is none."""
    pattern = r"^#(\d+):(.+?)(?::(full|\d+(?::\d+)?))?$"
    suffix = F.regexp_extract(query, pattern, 3)
    number = lambda c: F.when(c != "", c.cast("long"))
    numeric = F.when(suffix != "full", suffix)
    parts = F.struct(
        F.regexp_extract(query, pattern, 1).cast("long").alias("index"),
        F.regexp_extract(query, pattern, 2).alias("path"),
        (suffix == "full").alias("full"),
        number(F.regexp_extract(numeric, r"^(\d+)", 1)).alias("offset"),
        number(F.regexp_extract(numeric, r":(\d+)$", 1)).alias("limit"),
    )
    return F.when(query.rlike(pattern), parts)


def recall_scope(query: Column) -> Column:
    """scope: and mode: words of a query, and what is left of it."""
    scope, mode = r"(?i)\bscope:(lineage|all)\b", r"(?i)\bmode:(hybrid|file|touched)\b"
    found = F.lower(F.regexp_extract(query, mode, 1))
    rest = F.regexp_replace(F.regexp_replace(query, f"^([\\s\\S]*?){scope}", "$1"), f"^([\\s\\S]*?){mode}", "$1")
    return F.struct(F.when(F.lower(F.regexp_extract(query, scope, 1)) == "all", "all").otherwise("lineage").alias("scope"), F.when(found != "", found).otherwise("hybrid").alias("mode"), trim(F.regexp_replace(rest, r"\s+", " ")).alias("text"))


def expand_allocation(count: Column, budget: Column) -> Column:
    """Characters for each of `count` expanded entries in a budget."""
    usable = F.greatest(F.lit(0), budget - count * EXPAND_OVERHEAD)
    share = F.floor(usable / F.greatest(count, F.lit(1)))
    return F.when((count <= 0) | (budget <= 0), 0).when(count * EXPAND_FLOOR <= usable, F.greatest(share, F.lit(EXPAND_FLOOR))).otherwise(share).cast("long")


def expanded(text: Column, allocation: Column, index: Column) -> Column:
    """An entry cut to its allocation, with a mark of how to read on."""
    mark = F.concat(F.lit("\n… [entry #"), index.cast("string"), F.lit(" truncated — use recall #"), index.cast("string"), F.lit(":text:full for the full body, #"), index.cast("string"), F.lit(":path:full for tool file content]"))
    return F.when((allocation <= 0) | (F.length(text) <= allocation), text).otherwise(F.concat(T.clip_to(text, allocation), mark))


def line_snippet(text: Column, pattern: str, around: int = 2, most: int = 1000) -> Column:
    """The first matching line with those around it, long lines cut, and how many lines lie above and below; null if none matches."""
    every = F.split(text, "\n")
    at = F.array_position(F.transform(every, lambda x: x.rlike(pattern)), True).cast("int")
    first, last = F.greatest(at - around, F.lit(1)), F.least(at + around, F.size(every))
    cut = lambda x: F.when(F.length(x) <= most, x).otherwise(F.concat(F.substring(x, 1, most), F.lit(" … [truncated]")))
    more = lambda n, side: F.when(n > 0, F.array(F.concat(F.lit("...("), n.cast("string"), F.lit(f" lines {side})")))).otherwise(F.array().cast("array<string>"))
    some = F.transform(F.slice(every, F.greatest(first, F.lit(1)), F.greatest(last - first + 1, F.lit(0))), cut)
    return F.when(at > 0, F.array_join(F.concat(more(first - 1, "above"), some, more(F.size(every) - last, "below")), "\n"))


# --- formats and scores -----------------------------------------------------------------------------------------------


def technical_density(text: Column) -> Column:
    found = reduce(lambda a, b: a + b, [F.regexp_count(text, F.lit(p)) * F.lit(w) for p, (_, w) in zip(TECHNICAL_JAVA, TECHNICAL, strict=True)])
    return 1 + 0.12 * F.log2(1 + found)


def file_size(n: Column) -> Column:
    """To one digit, halves to the even one as printf has it; format_string alone rounds them up."""
    said = lambda size, unit: F.format_string(f"%.1f {unit}", F.bround(size, 1))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, said(n / 1024.0, "KB")).otherwise(said(n / (1024.0 * 1024.0), "MB"))


def file_age(seconds: Column) -> Column:
    said = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(f"{unit} ago"))
    return F.when(seconds < 60, said(seconds, "s")).when(seconds < 3600, said(seconds / 60, "m")).when(seconds < 86400, said(seconds / 3600, "h")).when(seconds < 365 * 86400, said(seconds / 86400, "d")).otherwise(said(F.floor(seconds / 86400) / 365, "y"))


def token_count(n: Column) -> Column:
    """1234 as 1.2k."""
    return F.when(n >= 1000, F.format_string("%.1fk", n / 1000.0)).otherwise(n.cast("string"))


def pool_fullness(tokens: Column, budget: Column) -> Column:
    return F.when((tokens <= 0) | (budget <= 0), 0.0).otherwise(tokens / budget)


def drop_urgency(fullness: Column) -> Column:
    return F.when(fullness < DROP_LOW, "low").when(fullness < DROP_MEDIUM, "medium").otherwise("high")


def max_drops(droppable: Column, fullness: Column) -> Column:
    """How many observations may go: a tenth of a pool that is a tenth full up to half of a full one, at least one."""
    capped = F.least(F.lit(1.0), F.greatest(F.lit(DROP_SKIP), fullness))
    ratio = DROP_MIN_RATIO + (capped - DROP_SKIP) / (1 - DROP_SKIP) * (DROP_MAX_RATIO - DROP_MIN_RATIO)
    return F.when((droppable == 0) | (fullness < DROP_SKIP), 0).otherwise(F.greatest(F.lit(1), F.floor(droppable * ratio))).cast("long")


def usage_tokens(role: Column, stop: Column, usage: Column) -> Column:
    """Usage that can be trusted: of an assistant's turn that neither failed nor was stopped, above 0."""
    return F.when((role == "assistant") & F.coalesce(~stop.isin("error", "aborted"), F.lit(True)) & (usage > 0), usage)


def entry_tokens(kind: Column, text: Column) -> Column:
    """Estimate by type: messages, custom messages and branch summaries count, others don't."""
    return F.when(kind.isin("message", "custom_message", "branch_summary"), T.tokens(F.coalesce(text, F.lit("")))).otherwise(0).cast("long")


def local_time(ts: Column, missing: str = "????-??-?? ??:??") -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit(missing))


def latest_of(stamps: Column) -> Column:
    """The last of timestamps as text, those that begin with a question mark left out."""
    return F.array_max(F.filter(stamps, lambda x: ~F.startswith(x, F.lit("?"))))


def when_of(value: Column, place: Column) -> Column:
    """A number, an ISO text, or else the place: milliseconds."""
    return F.coalesce(value.try_cast("double"), F.unix_millis(F.try_to_timestamp(value)).cast("double"), place.cast("double"))


def empty_reason(called: Column, proposed: Column, rejected: Column, duplicates: Column, added: Column) -> Column:
    """Why an observer recorded nothing."""
    return F.when(~called, "tool_not_called").when((rejected > 0) & (added == 0), "all_rejected").when((duplicates > 0) & (added == 0), "all_duplicates").when(proposed == 0, "empty_array").otherwise("no_new_content")


def skips_provider(entries: Column, provider: Column, api: Column) -> Column:
    """Whether a list of providers, or provider:api pairs, names a model's; `provider:` means none with an api."""

    def hit(entry: Column) -> Column:
        parts = F.split(trim(entry), ":")
        own = F.try_element_at(parts, F.lit(2))
        return (F.element_at(parts, 1) == provider) & (trim(entry) != "") & (own.isNull() | F.when(own == "", api.isNull()).otherwise(F.coalesce(own == api, F.lit(False))))

    return F.exists(entries, hit)


def memory_line(id_: Column, ts: Column, relevance: Column, content: Column, coverage: Column | None = None) -> Column:
    tag = F.lit("] ") if coverage is None else F.concat(F.lit("] [coverage: "), coverage, F.lit("] "))
    return F.concat(F.lit("["), id_, F.lit("] "), ts, F.lit(" ["), relevance, tag, content)


def valid_observation(o: Column) -> Column:
    filled = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    ids = F.coalesce((F.size(o["sourceEntryIds"]) > 0) & F.forall(o["sourceEntryIds"], lambda x: F.coalesce(F.length(x) > 0, F.lit(False))), F.lit(False))
    return F.coalesce(o["id"].rlike("^(?i)[a-f0-9]{12}$"), F.lit(False)) & filled(o["content"]) & filled(o["timestamp"]) & F.coalesce(o["relevance"].isin("low", "medium", "high", "critical"), F.lit(False)) & ids & F.coalesce(o["tokenCount"] >= 0, F.lit(False))


def valid_record(records: Column, covers: Column) -> Column:
    """A record counts as a whole: one bad observation and none is taken."""
    return F.coalesce(F.size(records) > 0, F.lit(False)) & F.forall(records, valid_observation) & F.coalesce(F.length(covers) > 0, F.lit(False))


def strip_markdown(text: Column) -> Column:
    """Links, code, bold, italic and struck text without their marks."""
    rules = [(r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"`([^`]+)`", "$1"), (r"\*\*\*([^*]+)\*\*\*", "$1"), (r"\*\*([^*]+)\*\*", "$1"), (r"__([^_]+)__", "$1"), (r"(?<!\*)\*([^*\n]+)\*(?!\*)", "$1"), (r"(?<!\w)_([^_\n]+)_(?!\w)", "$1"), (r"~~([^~]+)~~", "$1")]
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, text)
