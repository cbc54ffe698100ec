"""Transcript, link and rule operators on small inputs, folds against Python."""

import random

from pyspark.sql import functions as F

from memloom.functions import rules as R
from memloom.functions import text as T
from memloom.operators import ledger, links, transcript

BLOCK = f"session_id long, pos long, n int, kind string, name string, text string, is_error boolean, args {transcript.ARGS}"


def rows(spark, blocks):
    """blocks: (session, kind, text) or (session, kind, text, name, is_error), in order."""
    full = [(b[0], i, 0, b[1], b[3] if len(b) > 3 else None, b[2], b[4] if len(b) > 4 else None, None) for i, b in enumerate(blocks)]
    return spark.createDataFrame(full, BLOCK)


def call(name, **args):
    keys = transcript.ARGS.removeprefix("struct<").split(",")
    names = ["path", "file_path", "filePath", "file", "command", "query", "content", "oldText", "newText", "edits", "keys"]
    assert len(keys) >= len(names)
    return (name, tuple(args.get(k) for k in names))


def test_goals_keep_the_first_and_the_latest_change(spark):
    said = [(1, "user", "ok"), (1, "user", "- Build the parser\n2. Then test it well\nyes"), (1, "user", "fix the printer of the lexer"), (1, "user", "Actually, write the docs instead"), (1, "user", "thanks a lot for it"), (2, "user", "hi")]
    out = {r.session_id: r.goals for r in transcript.goals(rows(spark, said)).collect()}
    assert out == {1: ["Build the parser (#1)", "Then test it well (#1)", "[Scope change]", "Actually, write the docs instead (#3)"]}


def test_templates_end_the_goals(spark):
    said = [(1, "user", "Look at the issues\nFor each issue:\nread it all"), (1, "assistant", "fix the thing now please")]
    assert transcript.goals(rows(spark, said)).first().goals == ["Look at the issues (#0)"]


def test_preferences_fold_like_a_loop(spark):
    rng = random.Random(1)
    lines = ["I always use tabs", "i ALWAYS use tabs", "Please avoid globals", "never commit keys", "style: black", "Why do you prefer x?", "plain words", "don't want that", "prefers y over z", "no", "always run tests", "never push late", "please keep it short", "language = en", "format: wide", "naming : snake"]
    said = [(s, "user", "\n".join(rng.choices(lines, k=rng.randrange(1, 6)))) for s in (1, 2) for _ in range(40)]
    out = {r.session_id: r.preferences for r in transcript.preferences(rows(spark, said)).collect()}
    stated = {x for x in lines if x not in ("plain words", "no", "Why do you prefer x?")}
    for s in (1, 2):
        seen, want = set(), []
        for b in said:
            if b[0] == s:
                for line in b[2].split("\n"):
                    if line in stated and line.lower() not in seen:
                        seen.add(line.lower())
                        want.append(line)
                        break
        assert out[s] == want[:10]


def test_outstanding_looks_at_the_last_blocks(spark):
    said = [(1, "user", "The old build failed badly")] + [(1, "assistant", f"all is well {i}") for i in range(16)] + [(1, "tool_result", "exit 1\nmore", "bash", True), (1, "tool_result", "exit 1\nmore", "bash", True), (1, "assistant", "It cannot be opened. So what"), (1, "assistant", "It cannot be opened. So what"), (1, "user", "- it failed as a bullet\n(cannot) start\nThe door is broken again")]
    out = transcript.outstanding(rows(spark, said)).first().outstanding
    assert out == ["[bash] exit 1", "[bash] exit 1", "It cannot be opened. So what", "[user] The door is broken again"]


def test_commits_find_their_hash_in_the_next_two_blocks(spark):
    data = [
        (1, 0, 0, "tool_call", "bash", None, None, call("bash", command="cd x && git commit -m \"Fix it\"")[1]),
        (1, 1, 0, "tool_result", "bash", "[main 1234abc] Fix it", False, None),
        (1, 2, 0, "tool_call", "bash", None, None, call("bash", command="git commit -am 'no flag apart'")[1]),
        (1, 3, 0, "tool_call", "bash", None, None, call("bash", command="git commit -m 'Late\nbody'")[1]),
        (1, 4, 0, "assistant", None, "well", None, None),
        (1, 5, 0, "tool_result", "bash", "1234567..89abcde", False, None),
    ]
    out = sorted((r.pos, r.hash, r.message) for r in transcript.commits(spark.createDataFrame(data, BLOCK)).collect())
    assert out == [(0, "1234abc", "Fix it"), (3, "89abcde", "Late")]
    assert transcript.commit_lines(transcript.commits(spark.createDataFrame(data, BLOCK))).first().commits == ["1234abc: Fix it", "89abcde: Late"]


def test_files_lose_their_common_folders(spark):
    data = [(1, i, 0, "tool_call", n, None, None, call(n, path=p)[1]) for i, (n, p) in enumerate([("Read", "/a/b/x.ts"), ("Edit", "/a/b/c/y.ts"), ("Write", "rel.ts"), ("Read", "/a/b/x.ts")])]
    data += [(2, 0, 0, "tool_call", "Read", None, None, call("Read", file="/only/one.ts")[1]), (3, 0, 0, "tool_call", "Read", None, None, call("Read", path="/a/x")[1]), (3, 1, 0, "tool_call", "Read", None, None, call("Read", path="/b/x")[1])]
    out = {r.session_id: (r.read, r.modified) for r in transcript.file_activity(spark.createDataFrame(data, BLOCK)).collect()}
    assert out == {1: (["x.ts"], ["c/y.ts", "rel.ts"]), 2: (["/only/one.ts"], []), 3: (["/a/x", "/b/x"], [])}


def test_equal_tool_lines_of_a_turn_become_one(spark):
    data = [(1, 0, 0, "user", None, "q", None, None)] + [(1, i, 0, "tool_call", "Read", None, None, call("Read", path=p)[1]) for i, p in ((1, "a"), (2, "a"), (3, "b"), (4, "a"))]
    lines = transcript.tool_lines(spark.createDataFrame(data, BLOCK))
    assert [(r.line, r.refs, r.times) for r in lines.orderBy("first").collect()] == [('* Read "a"', "#1, #2", 2), ('* Read "b"', "#3", 1), ('* Read "a"', "#4", 1)]
    kept = transcript.kept_tool_lines(lines, 2).orderBy("pos").collect()
    assert [(r.line, r.omitted) for r in kept] == [('* Read "b" (#3)', "* (1 earlier tool-call entries omitted)"), ('* Read "a" (#4)', None)]


def test_summary_leaves_out_empty_sections(spark):
    said = [(1, "user", "Build the parser well"), (1, "user", "I always use tabs"), (2, "assistant", "x")]
    out = {r.session_id: r.summary for r in transcript.summary(transcript.sections(rows(spark, said))).collect()}
    assert out[1] == "[Session Goal]\n- Build the parser well (#0)\n\n[User Preferences]\n- I always use tabs"
    assert out[2] == ""


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_rules(spark):
    text = F.lit("aaa bbb")
    assert one(spark, T.clip(text, 3)) == "aaa" and one(spark, T.clip(F.lit("abcdef"), 3)) == "abc"
    assert one(spark, T.short_path(F.lit("/work/a/b"))) == "./a/b" and one(spark, T.short_path(F.lit("/x/y/z/w"))) == ".../y/z/w"
    assert one(spark, T.snippet(F.lit("a  b"), "b")) == "a  b"
    assert one(spark, T.normalize(F.lit("They're  sure it CAN'T, won't: dont!"))) == "they are sure it cannot will not dont"
    assert one(spark, R.collapse_skill_lines(F.array(*map(F.lit, ['<skill name="a" x>', "in", "</skill>", "out", '<skill name="a">', "lost"])))) == ["[skill: a]", "out"]
    assert one(spark, R.compress_shell(F.lit("cd /x && ls \n| wc -l"))) == "ls;"
    assert one(spark, R.strip_markdown(F.lit("**a** _b_ x_y_z [t](u) `c`"))) == "a b x_y_z t c"


def test_newest_fitting_folds_like_a_loop(spark):
    rng = random.Random(2)
    data = [(s, i, "x" * rng.randrange(1, 60)) for s in (1, 2) for i in range(60)]
    out = {(r.session_id, r.pos) for r in links.newest_fitting(spark.createDataFrame(data, "session_id long, pos long, line string"), 40).collect()}
    want = set()
    for s in (1, 2):
        held = ""
        for t, i, line in reversed(data):
            if t == s:
                longer = held + ("\n" if held else "") + line
                if -(-len(longer) // 4) <= 40:
                    held = longer
                    want.add((s, i))
    assert out == want


def test_chains_walk_back_to_their_start(spark):
    data = [(1, 0, 1, True), (1, 1, 2, False), (1, 2, 3, False), (2, 0, None, False), (3, 0, 1, True), (3, 1, 3, False), (4, 0, None, False), (4, 1, 5, False), (5, 0, 2, False), (6, 0, 2, True), (7, 0, 3, False), (7, 1, 1, True), (7, 2, 2, False)]
    out = {r.session_id: (r.status, r.segments) for r in ledger.chain_status(spark.createDataFrame(data, "session_id long, pos long, seq int, start boolean")).collect()}
    assert out == {1: ("ok", 3), 2: ("latest-not-append", 0), 3: ("invalid-sequence", 0), 4: ("invalid-chain-entry", 0), 5: ("missing-chain-start", 0), 6: ("invalid-sequence", 0), 7: ("ok", 2)}


def test_markers_take_the_other_where_one_lacks(spark):
    data = [(1, 0, "observation", 1, 1), (2, 3, "drop", 1, 1), (3, 1, "observation", 1, 1), (3, 2, "drop", 1, 1)]
    out = {r.session_id: r.earlier for r in ledger.markers(spark.createDataFrame(data, "session_id long, pos long, kind string, tokens long, key long")).collect()}
    assert out == {1: 0, 2: 3, 3: 1}
