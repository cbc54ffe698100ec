"""Behaviour restated on our own small inputs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from memloom import queries
from memloom.functions import rules as R
from memloom.functions import text as T
from memloom.operators import blocks, corpus, graph, ledger, search
from memloom.sources import sessions
from memloom.streaming import consolidation

LEDGER = "session_id long, pos long, kind string, tokens long, key long"


def test_first_observation_wins_and_unknown_drop_is_harmless(spark):
    rows = [(1, 0, "observation", 5, 7), (1, 1, "observation", 9, 7), (1, 2, "drop", 1, 99), (2, 0, "observation", 1, 7), (2, 1, "drop", 1, 7)]
    out = {(r.session_id, r.key): (r.tokens, r.dropped) for r in ledger.fold(spark.createDataFrame(rows, LEDGER)).collect()}
    assert out == {(1, 7): (5, False), (2, 7): (1, True)}


def test_dot_in_a_term_is_literal():
    assert search.term_pattern("observer.ts").endswith(r"observer\.ts")
    assert search.term_pattern("a|b") == "(?iu)a|b"
    assert search.term_pattern("(") == r"(?iu)\("
    assert search.query_terms("the of") == ["the", "of"]


def test_floor_needs_two_terms(spark):
    docs = spark.createDataFrame([(1, "cat " * 9 + "dog"), (2, "dog"), (3, "bird")], "i long, text string")
    assert search.recall(docs, "cat dog", ["i"]).count() == 2
    assert search.recall(docs, "zebra", ["i"]).count() == 0


def test_budgets(spark):
    rows = spark.createDataFrame([(1, i, "message", 10, 0) for i in range(5)], LEDGER)
    assert [r.pos for r in ledger.suffix_budget(rows, 25).orderBy("pos").collect()] == [3, 4]
    assert [r.pos for r in ledger.prefix_budget(rows, 5).collect()] == [0]
    scored = rows.withColumn("score", F.lit(5) - F.col("pos")).withColumn("tokens", F.when(F.col("pos") == 1, 100).otherwise(F.col("tokens")))
    assert sorted(r.pos for r in ledger.skip_budget(scored, 30).collect()) == [0, 2, 3]


def test_normalize_and_similarities(spark):
    row = spark.range(1).select(T.normalize(F.lit("Don't  stop: it's 5%!")).alias("n"), T.levenshtein_similarity(F.lit("abcd"), F.lit("abcx")).alias("l"), T.dice(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))).alias("d")).first()
    assert row.n == "do not stop it is 5" and row.l == 0.75 and abs(row.d - 2 / 3) < 1e-9


def test_branch_and_components(spark):
    tree = spark.createDataFrame([(1, 0, None), (1, 1, 0), (1, 2, 0), (1, 3, 1)], "session_id long, pos long, parent long")
    assert [r.pos for r in graph.active_branch(tree).orderBy("depth").collect()] == [3, 1, 0]


def test_components(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (8, 9)], "a long, b long")
    assert {r.node: r.root for r in graph.components(links).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}


def test_jsonl_scan_counts_bad_lines(spark, tmp_path):
    lines = [json.dumps({"type": "session", "id": "s", "cwd": "/a/b"}), "", "{broken", json.dumps({"type": "custom", "id": "e", "customType": "om.observations.recorded", "data": {"coversUpToId": "x", "observations": [{"id": "a1", "content": "c"}]}})]
    (tmp_path / "s.jsonl").write_text("\n".join(lines))
    entries = sessions.scan_jsonl(spark, str(tmp_path / "s.jsonl"))
    report = sessions.scan_report(entries).first()
    assert (report.entries, report.parse_errors) == (2, 1)
    assert sessions.observations_of(entries).first().id == "a1"


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    rows = spark.createDataFrame([(i % 2, i, "message", 10 + i, 0) for i in range(20)], LEDGER)
    for i in range(2):
        rows.filter(F.col("pos").between(10 * i, 10 * i + 9)).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = consolidation.windows(stream, 40).writeStream.format("memory").queryName("fired").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda r: tuple(r)
    assert sorted(map(key, spark.table("fired").collect())) == sorted(map(key, consolidation.windows(rows, 40).collect()))


def test_noise_goes_and_wrappers_are_cut(spark):
    rows = [
        (0, "thinking", None, "hm"),
        (1, "tool_call", "TodoRead", "x"),
        (2, "tool_result", "WebSearch", "x"),
        (3, "tool_call", "Read", " kept as is "),
        (4, "user", None, " <system-reminder a='1'>one\ntwo</system-reminder> ask\u00a0"),
        (5, "user", None, "<command-message>only</command-message>"),
        (6, "user", None, "well. No response requested. Yes"),
        (7, "user", None, None),
        (8, None, None, None),
        (9, "user", None, "<system-reminder>a</command-message> b"),
        (10, "assistant", None, ""),
    ]
    out = {r.pos: r.text for r in blocks.filter_noise(spark.createDataFrame(rows, "pos long, kind string, name string, text string")).collect()}
    assert out == {3: " kept as is ", 4: "ask", 8: None, 9: "<system-reminder>a</command-message> b", 10: ""}


def write_events(spark, folder, rows):
    """rows: user, type, key, in order of time."""
    data = [(i, i, u, t, 1.0, json.dumps({"k": k})) for i, (u, t, k) in enumerate(rows)]
    df = spark.createDataFrame(data, "event_id long, at long, user_id long, event_type string, value double, props string")
    df.select("event_id", F.timestamp_seconds("at").alias("ts"), "user_id", "event_type", "value", "props").coalesce(1).write.parquet(f"{folder}/events.parquet")


def test_branch_of_whole_sessions_matches_a_walk(spark, tmp_path):
    rng = random.Random(1)
    keys = {u: [rng.randrange(100) for _ in range(n)] for u, n in ((1, 12_000), (2, 61), (3, 60), (4, 1))}
    write_events(spark, tmp_path, [(u, "view", k) for u, own in keys.items() for k in own])
    want = set()
    for u, own in keys.items():
        pos, depth = len(own) - 1, 0
        while pos >= 0:
            want.add((u, pos, depth))
            pos, depth = pos - 1 - own[pos] % 3, depth + 1
    got = queries.QUERIES["i01_whole_branch"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r.session_id, r.pos, r.depth) for r in got} == want


def test_branch_ends_at_a_missing_parent_and_passes_any_depth(spark):
    rows = [(1, i, i - 1 if i else None) for i in range(10_050)] + [(2, 5, 4), (2, 6, 5)]
    out = graph.active_branch(spark.createDataFrame(rows, "session_id long, pos long, parent long")).collect()
    assert sorted((r.session_id, r.pos, r.depth) for r in out) == [(1, i, 10_049 - i) for i in range(10_050)] + [(2, 5, 1), (2, 6, 0)]


def union_find(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for x, y in pairs:
        a, b = find(x), find(y)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def test_session_components_take_every_compaction(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(60), rng.choice(["view", "purchase", "purchase", "error"]), rng.randrange(90)) for _ in range(110)]
    rows += [(u, "view", 1) for u in range(100, 220)] + [(u, "purchase", 1000 + (7 * u + d) % 121) for u in range(100, 220) for d in (0, 7)]
    write_events(spark, tmp_path, rows)
    bought = {(u, k) for u, t, k in rows if t == "purchase"}
    want = union_find([(u, v) for u, k in bought for v, j in bought if k == j])
    assert len(set(want.values())) > 3
    assert {r.node: r.root for r in queries.QUERIES["i02_session_components"](spark, str(tmp_path)).collect()} == want


def test_components_of_random_links_match_union_find(spark):
    rng = random.Random(3)
    names = rng.sample(range(10**6), 900)
    links = list(zip(names[:150], names[1:150], strict=False)) + [(rng.choice(names[500:]), rng.choice(names[500:])) for _ in range(150)]
    assert {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()} == union_find(links)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_similar_keys_match_all_pairs(spark, tmp_path):
    rng = random.Random(4)
    texts = ["", "a", "b", "ab", "ac", "one two three four five six", "four five six one two three"]
    for _ in range(12):
        base = [rng.choice("abcdefgh ") for _ in range(rng.choice([20, 90, 150]))]
        for _ in range(5):
            own = list(base)
            for _ in range(rng.randrange(1, 2 + len(own) // 9)):  # beyond the first 80 letters too
                own[rng.randrange(len(own))] = rng.choice("xyz")
            texts.append("".join(own))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    keys = {}
    for i, t in enumerate(texts):
        keys.setdefault(" ".join(t.split()), i)
    near, close = {}, {}
    for k, i in keys.items():
        for m, j in keys.items():
            if i < j and abs(len(k) - len(m)) <= (1 - 0.88) * max(len(k), len(m)):
                x, y = ({s[p : p + 2] for p in range(len(s) - 1)} for s in (k, m))
                if x | y and len(x & y) / len(x | y) >= 0.73:
                    near[i, j] = round(len(x & y) / len(x | y), 6)
                    if (similarity := 1 - edits(k, m) / max(len(k), len(m))) >= 0.88:
                        close[i, j] = round(similarity, 6)
    assert 5 < len(close) < len(near)
    assert {(r.a, r.b): r.jaccard for r in queries.QUERIES["h14_key_jaccard"](spark, str(tmp_path)).collect()} == near
    assert {(r.a, r.b): r.similarity for r in queries.QUERIES["h13_key_levenshtein"](spark, str(tmp_path)).collect()} == close


def test_similar_keys_of_many_blocks_write_no_candidates(spark, monkeypatch):
    rng = random.Random(5)
    keys = ["ab", "a" * 600, "a" * 599]
    for _ in range(60):
        base = [rng.choice("abcdefghijklmnop ") for _ in range(rng.choice([30, 120, 300]))]
        for _ in range(5):
            own = list(base)
            for _ in range(rng.randrange(1, 2 + len(own) // 9)):
                own[rng.randrange(len(own))] = rng.choice("xyz")
            keys.append(" ".join("".join(own).split()))
    keys = dict(enumerate(dict.fromkeys(keys)))
    near, close = {}, {}
    for i, k in keys.items():
        for j, m in keys.items():
            if i < j and abs(len(k) - len(m)) <= (1 - 0.88) * max(len(k), len(m)):
                x, y = ({s[p : p + 2] for p in range(len(s) - 1)} for s in (k, m))
                if len(x & y) / len(x | y) >= 0.73:
                    near[i, j] = len(x & y) / len(x | y)
                    if (similarity := 1 - edits(k, m) / max(len(k), len(m))) >= 0.88:
                        close[i, j] = similarity
    assert 5 < len(close) < len(near)
    rows = []

    def written(df):
        out = kept(df)
        rows.append(out.count())
        return out

    kept = graph._written
    monkeypatch.setattr(graph, "_written", written)
    table = spark.createDataFrame(list(keys.items()), "id long, key string")
    for block in (11, 100, 10_000):
        monkeypatch.setattr(corpus, "BLOCK", block, raising=False)
        assert {(r.a, r.b): r.jaccard for r in corpus.similar_keys(table).collect()} == near
    assert max(rows) <= len(keys)
    assert {(r.a, r.b): r.similarity for r in corpus.similar_keys(table, edits=True).collect()} == pytest.approx(close)


def test_thresholds_on_the_curve_are_whole_where_the_product_is(spark):
    none, anchors = F.lit(0), [(100_000, 0.8), (200_000, 0.65), (1_000_000, 0.3)]
    windows = spark.createDataFrame([(452_000,), (452_001,), (100_000,), (1,), (2_000_000,)], "w long")
    got = windows.select("w", T.compact_threshold(F.col("w"), none, none, none, anchors).alias("t")).collect()
    # 452,000 by 0.53975 is 243,967; as doubles the product lies below.
    assert {r.w: r.t for r in got} == {452_000: 243_967, 452_001: 243_967, 100_000: 80_000, 1: 1, 2_000_000: 600_000}


def test_halves_of_sizes_go_to_the_even_digit(spark):
    sizes = {1023: "1023 B", 1280: "1.2 KB", 1281: "1.3 KB", 1792: "1.8 KB", 1024 * 1024 - 1: "1024.0 KB", 51 * 2**20 + 2**18: "51.2 MB", 51 * 2**20 + 2**18 + 1: "51.3 MB", 51 * 2**20 + 3 * 2**18: "51.8 MB"}
    rows = spark.createDataFrame([(n,) for n in sizes], "n long")
    assert {r.n: r.size for r in rows.select("n", R.file_size(F.col("n")).alias("size")).collect()} == sizes


def test_bigrams_of_many_alphabets_are_counted_in_arrays(spark):
    rng = random.Random(6)
    texts = ["", "a", "aa", "aaa", "ab\nab", "日本語日本", "😀😀a😀😀", "éé", "abc" * 30_000, "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(9_000)), "".join(rng.choice("ab ") for _ in range(50))]
    rows = spark.createDataFrame([*enumerate(texts), (99, None)], "i long, text string").select("i", T.n_bigrams(F.col("text")).alias("n"))
    assert "zip_with" not in rows._jdf.queryExecution().toString()
    assert {r.i: r.n for r in rows.collect()} == {**{i: len({t[k : k + 2] for k in range(len(t) - 1)}) for i, t in enumerate(texts)}, 99: 0}


def test_technical_patterns_for_java_find_the_same_and_share_boundaries(spark):
    rng = random.Random(7)
    parts = ["src", "/", ".", "-", "--", "ts", "go.mod", ".env", "Dockerfile", "foo", "fooBar", "FOO_BAR", "PI_A", "()", "(x)", "::", "->", "Map<", "a, b", ">", "@dec", "#[", "]", "GET", " ", "\n", "/api", "404", "Not Found", "npm", "go", "=", "IOError", "Error", "default", "0a1b2c3d", "v1.2.3", "1.2", "é", "日", "x", "1", "_", "toml", ":"]
    texts = spark.createDataFrame([("".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))),) for _ in range(5_000)], "text string")
    both = [F.struct(F.regexp_count("text", F.lit(R.java(p))).alias("a"), F.regexp_count("text", F.lit(j)).alias("b")).alias(f"p{i}") for i, ((p, _), j) in enumerate(zip(R.TECHNICAL, R.TECHNICAL_JAVA, strict=True))]
    rows = texts.select(*both).collect()
    assert all(r[i].a == r[i].b for r in rows for i in range(len(both)))
    assert all(sum(r[i].a for r in rows) > 500 for i in range(len(both)))
