"""The llm operators on small and awkward tables, against brute force, round trips and SQL."""

import base64
import collections
import hashlib
import os
import random
import re
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memloom.llm import chat_format, class_lm, components, exact_dedup, html_text, minhash, mixing, packing, quality, queries, toxicity, warc

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOC = "doc_id long, text string, lang string, source string, n_chars long, row string, size string, kept string, score string, bucket string, a string"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
TEXTS = [None, "", " \n\t", "a b c", "a b c", "one two three four five six seven", "one two three four five six eight", LONG, "É x\x1cy", "<|endoftext|> x's 12,5"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 2}", None, "r", "1", "k", "s", "b", "a") for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[5], (None, "a b c", "en", "s1", 1, *"abcdef")]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def labels(spark):
    return spark.createDataFrame([(3, 1), (3, 0), (4, None), (None, 1)], "doc_id long, toxic int")


OPERATORS = {
    "exact": lambda s, d: exact_dedup.groups(d),
    "exact_rows": lambda s, d: exact_dedup.exact_dedup(d),
    "mix_plan": lambda s, d: mixing.mix_plan(d),
    "mix": lambda s, d: mixing.mix(d),
    "pack": lambda s, d: packing.best_fit_packing(d, queries.tokenizer_path(), with_ids=True),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.fit(d, labels(s))),
    "quality": lambda s, d: quality.quality_rules(d, keep=["doc_id", "lang", "source"]),
    "near": lambda s, d: minhash.near_duplicates(d),
    "lm": lambda s, d: class_lm.class_lm(d),
    "html": lambda s, d: html_text.extract(d, page="text", into="main"),
    "warc": lambda s, d: warc.round_trip(d, "doc_id", "source", "text"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_and_empty_tables(spark, odd, none, name):
    out = OPERATORS[name](spark, odd).collect()
    assert OPERATORS[name](spark, none).count() == 0
    if name == "exact_rows":
        assert len(out) == 7
    elif name in ("mix",):
        assert len(out) > 0
    elif name == "pack":
        assert sum(r.piece == 0 for r in out) == odd.count() and any(r.piece > 5 for r in out)
    else:
        assert len(out) == odd.count()


def brute_components(texts, n, percent=80):
    sets = {}
    for i, t in texts.items():
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(n, len(ws))
        sets[i] = {tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)} if ws else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both) and find(x) != find(y):
                    root[max(find(x), find(y))] = min(find(x), find(y))
    return {i: find(i) for i in ids}


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    texts, i = {}, 0
    for family in range(12):
        base = [f"f{family}w{rng.randrange(400)}" for _ in range(rng.choice([6, 40, 150]))]
        for _ in range(15):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(own) // 18)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            base = own if rng.random() < 0.3 else base
            texts[i], i = " ".join(own), i + 1
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, n=4, block=4).collect()}
    assert got == brute_components(texts, 4)


def test_components(spark):
    links = [(i + 1, i) for i in range(30)] + [(100, 90), (95, 90)]
    out = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(1, 31)}, 100: 90, 95: 90}


PART = st.sampled_from(["\\", "<", "[", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</TURN>>", "s>", "INST]", "\n", "é", "a", " "])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", None]), st.one_of(st.none(), st.lists(PART, max_size=8).map("".join))), min_size=1, max_size=5), min_size=1, max_size=8))
def test_chat_round_trip(talks):
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.getOrCreate()
    rows = [(c, i, r, t) for c, talk in enumerate(talks) for i, (r, t) in enumerate(talk)]
    out = chat_format.chat_format(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in out.select("conv_id", chat_format.parse(F.col("text")).alias("turns")).collect()}
    assert got == {c: [(r or "", t or "") for r, t in talk] for c, talk in enumerate(talks)}


def test_chat_states_over_chunks(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", "x") for i in range(10)] + [(2, 0, "user", "x"), (2, 1, "user", "x"), (2, 2, "assistant", "x"), (3, 0, "system", "s"), (3, 1, "user", "q")]
    out = {r.conv_id: (r.valid, r.accepted_turns) for r in chat_format.validate(chat_format.chat_format(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), chunk_turns=3)).collect()}
    assert out == {1: (True, 10), 2: (False, 1), 3: (False, 2)}


def test_water_filling_clamps_and_reshares(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 50)], "source string, source_size long")
    out = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert out["a"] == 20 and abs(sum(out.values()) - 1.5 * 1160) < 1e-6 and all(out[k] <= 2 * s + 1e-9 for k, s in (("a", 10), ("b", 100), ("c", 1000), (None, 50)))


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_keeps_every_limit(rule):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 100, 500)
    limits = packing.Limits(100, 4, 6000, (1.0, 0.5, 0.5), rule)
    bins, offsets = packing.best_fit(np.minimum(lengths, 70), limits)
    own = collections.defaultdict(list)
    for n, b, o in zip(np.minimum(lengths, 70), bins, offsets, strict=True):
        own[b].append((o, n))
    for rows in own.values():
        at = 0
        for o, n in sorted(rows):
            assert o == at
            at += n
        assert at <= 100 and len(rows) <= 4 and sum(int(n) ** 2 for _, n in rows) <= 6000


def test_tokens_by_word_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(queries.tokenizer_path())
    texts = [t or "" for t in TEXTS] + ["Don't stop, it's OK. naïve, ÀÉ. İx, ﬁn. áb, 'll X,, é."]
    got = packing._ids([t.encode() for t in texts], queries.tokenizer_path())
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [tk.encode(t, add_special_tokens=False).ids for t in texts]


def test_toxicity_learns_from_held_in_labels(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(50)]
    docs = [(i, " ".join(rng.choices(words, k=30) + (["Zonk!", "zonking"] if i % 7 == 0 else []))) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(0, 600)], "doc_id long, toxic int")
    out = toxicity.score(df, toxicity.fit(df, marks, learn=F.col("doc_id") % 2 == 0)).collect()
    assert all((r.score >= 0.3) == (r.doc_id % 7 == 0) for r in out)


def test_quality_rejects_planted_outliers(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "of", "gamma", "the", "delta9"]) + str(rng.randrange(900)) for _ in range(80)), "en", "s") for i in range(300)]
    rows += [(1000 + i, " ".join(f"{w}###" for w in rows[i][1].split()), "en", "s") for i in range(10)]
    out = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert all(r.kept == (r.doc_id < 1000) for r in out)


@pytest.mark.parametrize("text", [t for t in TEXTS if t] + ["a b c a b c", "x x x x", "l 1\nl 1\n\nl 1\nz"])
def test_statistics_match_brute_force(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    three = collections.Counter(zip(ws, ws[1:], ws[2:], strict=False))
    hit = {i + k for i in range(len(ws) - 2) if three[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    assert quality.statistics(text) == (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(lines))


PAGES = [
    ("<html><head><title>t</title></head><body><nav>menu</nav><div class='ad'>buy</div><article><h1>A &amp; B</h1><p><b>one.<br>two<p>three, &#233;\n  four</p></article><footer>f</footer>", "A & B\none. two\nthree, é four"),
    ("<body><div id=sidebar>side</div><div class='content'><p>First, long enough text.</p><ul><li>x<li>y</ul><form><p>no</p></form></div><div class='comments'><p>hi, there.</p></div></body>", "First, long enough text.\nx\ny"),
    ("plain &lt;text", "plain <text"),
    ("<main><p>ok</p><script>var t='</p>';</script><!-- no --><aside>z</aside></main>", "ok"),
    ("", ""),
    ("<nav>only</nav>", ""),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_loser_tree_merges():
    rng = random.Random(1)
    for k in (1, 2, 3, 7):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(0, 20))) for _ in range(k)]
        assert [runs[r][i] for r, i in warc.LoserTree(runs)] == sorted(x for r in runs for x in r)


def test_archives_round_trip(spark):
    pages = [(1, "http://b.org/x", "dup\r\n\r\nWARC/1.1\r\n"), (2, "http://www.a.org/y?b=1&a=2", "dup\r\n\r\nWARC/1.1\r\n"), (3, "http://a.org/", None), (4, None, "é")]
    out = {int(r.id): r for r in warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i, _, h in pages:
        b = (h or "").encode()
        assert (out[i].payload_bytes, out[i].payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
    assert (out[1].record_type, out[1].refers_to, out[2].record_type) == ("revisit", "2", "response")
    order = sorted(out.values(), key=lambda r: (r.part, r.place))
    assert [r.url_key for r in order] == sorted(r.url_key for r in order) and out[2].url_key == "org,a)/y?a=2&b=1"


def test_class_model_sums_to_one_and_exchange_helps():
    rng = np.random.default_rng(0)
    pairs = np.zeros((12, 12))
    for _ in range(4000):
        side = rng.integers(2)
        pairs[2 + side * 5 + rng.integers(5), 2 + (1 - side) * 5 + rng.integers(5)] += 1
    cls = class_lm.exchange(pairs, 2)
    assert len(set(cls[2:7])) == 1 and len(set(cls[7:])) == 1 and cls[2] != cls[7]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    duck = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got = queries.QUERIES[name](spark, SF)
    cursor = duck.execute(queries.SQL[name])
    at = [[d[0] for d in cursor.description].index(c) for c in got.columns]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted((tuple(map(plain, r)) for r in got.collect()), key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)


def test_common_words_are_whole_levels_from_the_top(spark):
    rows = [(bytes([97 + i]), n) for i, n in enumerate([9, 9, 5, 5, 5, 2])]
    counts = spark.createDataFrame(rows, "word binary, n long").repartition(3)
    for most, ns in [(0, []), (1, []), (2, [9, 9]), (4, [9, 9]), (5, [9, 9, 5, 5, 5]), (99, [9, 9, 5, 5, 5, 2])]:
        assert sorted((n for _, n in class_lm.common_words(counts, most)), reverse=True) == ns
    assert class_lm.common_words(counts.limit(0), 5) == []


def test_crowded_bucket_links_members_that_are_no_centres(spark):
    """Pairs lack the same places of one template, so every bucket of a pair is shared by texts that are linked to neither."""
    rng = random.Random(8)
    texts = {}
    for i, x in enumerate([0, *rng.sample(range(1, 10_000), 320)]):
        own = [f"w{k}" for k in range(200)]
        for p in random.Random((i + 1) // 2).sample(range(5, 195, 5), 5):
            own[p] = f"m{x}p{p}"
        texts[x] = " ".join(own)
    want = brute_components(texts, 4)
    assert list(want.values()).count(0) == 1  # the least text of all is linked to none
    assert len(set(want.values())) == 161
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, n=4, block=64).collect()} == want


def test_words_are_cut_only_where_the_tokenizer_cuts():
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(queries.tokenizer_path())
    letters = [chr(i) for i in range(0x250) if chr(i).isalpha()]
    words = ["AL\u0130,", "\u0130.", "\u0130stanbul,", *[f"{a}{x}{end}" for x in letters for a in ("", "AL", "b") for end in ",."]]
    got = packing._ids([w.encode() for w in words], queries.tokenizer_path())
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids for e in tk.encode_batch(words, add_special_tokens=False)]
