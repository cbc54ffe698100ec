"""Each operator's result against brute force by the method that it is built on."""

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.llm import class_lm, html_text, minhash, mixing, packing, quality, queries, toxicity, warc
from memloom.llm.common import cut, read

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- tag-path ratios --------------------------------------------------------------------------------------------------


def sentence(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n)) + rng.choice([", and so on.", ". It is: so!", "; well, yes."])


def bare_page(rng):
    """No article, main or telling class: short menus around a column of prose with a heading and a short line."""
    column = [f"<h2>Heading {rng.randrange(99)}</h2>"] + [f"<p>{sentence(rng, rng.randrange(20, 60))}</p>" for _ in range(rng.randrange(3, 7))] + ["<p>Short one</p>"]
    links = "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(8))
    text = [re.sub("<[^>]+>", "", c) for c in column]
    return f"<html><body><div class=x1><ul>{links}</ul></div><div class=x2><div class=x3>{''.join(column)}</div></div><div class=x4><ul>{links}</ul><div>About Contact</div></div></body></html>", "\n".join(text)


def test_ratios_choose_where_nothing_else_tells():
    rng = random.Random(1)
    for _ in range(40):
        page, text = bare_page(rng)
        assert html_text.main_text(page) == text
        assert html_text.main_text(page, share=-math.inf) != text


def test_path_scores_match_brute_force():
    rng = random.Random(2)
    found = [(rng.randrange(5), rng.randrange(1, 300), rng.randrange(9)) for _ in range(60)]
    scores, spread = html_text.path_scores(found)
    mean = lambda p, i: sum(f[i] for f in found if f[0] == p) / sum(f[0] == p for f in found)
    line = [(mean(p, 1), 1 + mean(p, 2)) for p, _, _ in found]
    e = math.exp(-0.5)
    fused = []
    for i in range(len(line)):
        a, b, c = line[max(i - 1, 0)], line[i], line[min(i + 1, len(line) - 1)]
        fused.append(math.prod((e * a[j] + b[j] + e * c[j]) / (1 + 2 * e) for j in (0, 1)))
    centre = sum(fused) / len(fused)
    assert spread == pytest.approx(math.sqrt(sum((f - centre) ** 2 for f in fused) / len(fused)))
    for p in scores:
        own = [f for f, x in zip(fused, found, strict=True) if x[0] == p]
        assert scores[p] == pytest.approx(sum(own) / len(own))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p data-x=it's>Hello, it's me again.</p>", "Hello, it's me again."),
        ("<p title=don't>text</p>", "text"),
        ("<p title='a > b' data-y=\"c > d\">text</p>", "text"),
        ("<article><p>One long line, with text.</p><p class=share-note>note</p><section id=related-work><p>Work, related.</p></section></article>", "One long line, with text.\nnote\nWork, related."),
        ("<body><article class='post no-sidebar'><p>One, two; three, four; five.</p></article><div class='cookie-notice'>We use cookies.</div></body>", "One, two; three, four; five."),
        ("<body class=with-comments><div class='content with-comments'><p>One, two; three.</p><p>Four, five.</p></div><div id=comments-list><p>I, too, read it!</p></div></body>", "One, two; three.\nFour, five."),
        ("<article><p>One, two.</p></article><div>x</div><article><p>Three, four.</p></article>", "One, two.\nThree, four."),
        ("<div>" * 1500 + "deep, text." + "</div>" * 1500, "deep, text."),
    ],
)
def test_pages_of_awkward_markup(page, text):
    assert html_text.main_text(page) == text


# --- nearest labelled examples ----------------------------------------------------------------------------------------


def toxic_table(spark, n=260, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["commonest"] * 20
    rows = []
    for i in range(n):
        bad = i % 6 == 0
        rows.append((i, " ".join(rng.choices(words, k=rng.randrange(5, 40)) + rng.choices(["zonk!", "zonking", "Grumbler", "zonk"], k=2 * bad)), int(bad)))
    rows += [(n, "", 0), (n + 1, None, 0), (n + 2, "never-seen-word", 0)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, toxic int")


@pytest.mark.parametrize("relevance", [True, False])
def test_votes_match_brute_force_cosines(spark, relevance):
    rows, df = toxic_table(spark)
    learn = F.col("doc_id") % 2 == 0
    index = toxicity.fit(df, df, learn=learn, k=5, block=8, relevance=relevance)
    out = {r.doc_id: r for r in toxicity.score(df, index, k=5).collect()}
    counts = {i: toxicity.count_terms(t) for i, t, _ in rows}
    label = {str(i): y for i, _, y in rows}
    examples = {str(i): counts[i] for i, _, _ in rows if i % 2 == 0}
    total, bad = len(examples), sum(label[i] for i in examples)
    df_of = Counter(t for c in examples.values() for t in c)
    bad_of = Counter(t for i, c in examples.items() if label[i] for t in c)

    def weight(t):
        n, b, p = df_of[t], bad_of[t], bad / total
        x = lambda a, e: a * math.log(a / e) if a else 0.0
        gain = 2 * (x(b, n * p) + x(n - b, n * (1 - p))) if b > n * p else 0.0
        return (math.log((total + 1) / (n + 1)) + 1) * (math.sqrt(1 + max(gain, 0)) if relevance else 1)

    def unit(c):
        v = {t: (1 + math.log(n)) * weight(t) for t, n in c.items() if t in df_of}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    vectors = {i: unit(c) for i, c in examples.items() if c}

    def near(c, leave=None):
        own = unit(c)
        cosines = [(-round(sum(x * v.get(t, 0.0) for t, x in own.items()), 9), i) for i, v in vectors.items() if i != leave]
        return sorted((c, i) for c, i in cosines if c < 0)[:5]

    prior = (bad + 0.5) / (total + 1)

    def vote(found):
        w = [1 / (1.05 + c) for c, _ in found]
        return (sum(x * label[i] for x, (_, i) in zip(w, found, strict=True)) + prior) / (sum(w) + 1)

    left = [(vote(near(examples[i], i)), label[i]) for i in vectors]
    steps = toxicity.isotonic(*map(np.array, zip(*sorted(left), strict=True)))
    for i, c in counts.items():
        got, want = out[i], near(c) if c else []
        if not want:
            assert got.evidence == [] and got.score == index.empty
            continue
        # Weights lie in the index with four bytes, so cosines that nearly tie may change places.
        cut_off = want[-1][0] - 1e-6
        assert {x for d, x in want if d < cut_off} <= {e.id for e in got.evidence}
        assert [e.cosine for e in got.evidence] == pytest.approx([-d for d, _ in want], abs=1e-6)
        assert got.score == pytest.approx(float(np.interp(vote([(-e.cosine, e.id) for e in got.evidence]), *steps)), abs=1e-4)
    every = [r for r in out.values() if counts[r.doc_id] and any(t in df_of for t in counts[r.doc_id])]
    assert all(r.evidence for r in every)


def test_words_met_in_bulk_are_counted_as_one_by_one(monkeypatch):
    monkeypatch.setattr(toxicity, "KNOWN_WORDS", 30)
    rng = random.Random(4)
    texts = ["", None, "!!", *(" ".join(rng.choices([f"{a}word{i}{b}" for i in range(25) for a in ("", "(") for b in ("", "ing!", ".")], k=30)) for _ in range(40))]
    terms = {t: i for i, t in enumerate(sorted({t for x in texts[3:20] for t in toxicity.count_terms(x)}))}
    words = toxicity.Words(terms)
    for start in range(0, len(texts), 4):
        for text, (own, n) in zip(texts[start : start + 4], words.count(texts[start : start + 4]), strict=True):
            want = {terms[t]: c for t, c in toxicity.count_terms(text).items() if t in terms}
            assert dict(zip(own.tolist(), n.tolist(), strict=True)) == want and own.tolist() == sorted(own.tolist())


def test_toxicity_never_sees_what_it_may_not_learn_from(spark):
    _, df = toxic_table(spark)
    learn = F.col("doc_id") % 2 == 0
    turned = df.withColumn("toxic", F.when(learn, F.col("toxic")).otherwise(1 - F.col("toxic")))
    one, two = (toxicity.score(df, toxicity.fit(df, x, learn=learn), keep=["doc_id"]).orderBy("doc_id").collect() for x in (df, turned))
    assert one == two


# --- minimum covariance determinant -----------------------------------------------------------------------------------


def test_estimate_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    n, part = 240, 0.75
    x = rng.normal(size=(n, 4)) @ np.diag([1, 0.1, 0.5, 2]) + [1, 2, 3, 4]
    x[:30] += 9
    x[30:120, 0] = 0  # a figure that is nearly constant
    measures = np.stack([rng.integers(50, 400, n), rng.integers(1, 9, n), rng.integers(300, 2000, n)], axis=1)
    rows = [("g", *map(float, v), *map(int, m)) for v, m in zip(x, measures, strict=True)]
    df = spark.createDataFrame(rows, "g string, x0 double, x1 double, x2 double, x3 double, n_words long, n_lines long, word_chars long")
    got = quality.estimate(cut(df), part).first()
    middle = lambda v: np.sort(v)[math.ceil(len(v) / 2) - 1]
    words, lines, chars = (float(middle(measures[:, i])) for i in range(3))
    target = np.diag([math.log1p(100 / words) ** 2, (chars / words / (chars + 200)) ** 2, 6 / words, 1 / lines])
    mid = np.array([middle(x[:, i]) for i in range(4)])
    off = np.array([middle(np.abs(x[:, i] - mid[i])) for i in range(4)])
    inside = part / quality._chi2(quality._quantile(part, 4), 6)
    now = [(0.0, mid, np.diag((1.4826 * off) ** 2) + target), (0.0, x.mean(axis=0), np.cov(x.T, bias=True) + target)]
    best = None
    while True:
        after = []
        for _, centre, spread in now:
            d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(spread), x - centre)
            bins = np.floor(64 * np.log(d + 1e-9))
            near = x[bins <= np.sort(bins)[math.ceil(part * n) - 1]]
            spread = np.cov(near.T, bias=True) * inside + target
            after.append((np.linalg.slogdet(spread)[1], near.mean(axis=0), spread))
        if best is not None and all(a[0] >= b[0] - 1e-6 for a, b in zip(after, best, strict=True)):
            break
        best = after if best is None else [min(a, b, key=lambda v: v[0]) for a, b in zip(after, best, strict=True)]
        now = after
    best = min(best, key=lambda v: v[0])
    assert np.allclose(got.centre, best[1]) and np.allclose(np.array(got.spread).reshape(4, 4), best[2])
    assert abs(best[1] - x[30:].mean(axis=0)).max() < 1 < abs(x.mean(axis=0) - x[30:].mean(axis=0)).max()


def test_small_groups_are_drawn_to_their_language(spark):
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice(["alpha", "beta", "of", "gamma", "the", "delta"]) + str(rng.randrange(900)) for _ in range(n))
    rows = [(i, prose(80), "en", "big") for i in range(200)] + [(500 + i, prose(90), "en", "tiny") for i in range(3)]
    rows += [(600, " ".join(f"{w}##" for w in prose(80).split()), "en", "tiny"), (700, None, None, None), (701, "", "en", "tiny")]
    out = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(out[i].kept for i in (*range(200), 500, 501, 502))
    assert not out[600].kept and not out[600].base_failed and out[700].base_failed and out[701].base_failed and not out[701].kept


# --- class bigrams ----------------------------------------------------------------------------------------------------


def brute_base(rows):
    words = {i: [w.encode().lower() for w in WORD.findall(t or "")] + [b"\n"] for i, t in rows}
    train = [w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 10 for w in ws]
    c, n = Counter(train), len(train)
    level = math.log10(n + 0.1 * (len(c) + 1))
    return {i: (len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10(c[w] + 0.1) - level for w in ws)) for i, ws in words.items()}


@pytest.mark.parametrize("sizes", [{}, {"frequent": 7, "local": 9, "n_classes": 4}])
def test_base_scores_match_brute_force(spark, sizes):
    rows = [(r.doc_id, r.text) for r in read(spark, SF, "documents").select("doc_id", "text").collect()] + [(10**9, None), (10**9 + 1, "  "), (10**9 + 2, "Never-seen never-SEEN")]
    want = brute_base(rows)
    out = class_lm.class_lm(spark.createDataFrame(rows, "doc_id long, text string"), **sizes).collect()
    assert len(out) == len(rows)
    for r in out:
        n, known, tokens, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, tokens)
        assert r.base_score == pytest.approx(base, abs=1e-6) and r.score <= 0
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def small_model(spark, **sizes):
    rng = random.Random(6)
    sides = [[f"{s}{i}" for i in range(12)] for s in "ab"]
    rows = [(i, " ".join(rng.choice(sides[(j + i) % 2]) for j in range(rng.randrange(6, 20)))) for i in range(120)] + [(500, "a0 once")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts = cut(class_lm.count_words(df.select("text")))
    model = class_lm.fit(df, counts, **sizes)
    own = class_lm.classed(df.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.lit(True).alias("train"), "text"), model)
    return rows, model, own, class_lm.moves(own, model.n_classes)


def test_probabilities_sum_to_one_and_scores_follow_from_them(spark):
    rows, model, own, moves = small_model(spark, frequent=6, local=5, n_classes=4)
    assert np.allclose((10.0**moves).sum(axis=1), 1)
    number = Counter(w for _, t in rows for w in [*t.encode().split(), b"\n"])
    classes = {}
    for r in own.collect():
        classes.update(zip([*dict(rows)[r.doc_id].encode().split(), b"\n"], [b % class_lm.ONCE for b in r.seq], strict=True))
    assert set(classes) == set(number)
    for c in range(class_lm.FIXED, model.n_classes):
        share = [(number[w] + 0.1) / 10 ** model.below[c] for w, k in classes.items() if k == c]
        assert not share or sum(share) == pytest.approx(1)
    assert 0.1 / 10 ** model.below[class_lm.OPEN] == pytest.approx(1) and (number[b"\n"] + 0.1) / 10 ** model.below[class_lm.LAST] == pytest.approx(1)
    pairs = Counter()
    for _, t in rows:
        ws = [b"\n", *t.encode().split(), b"\n"]
        for x, y in zip(ws, ws[1:], strict=False):
            pairs[classes[x], classes[y]] += 1
            pairs[classes[x], class_lm.OPEN] += number[y] == 1
            pairs[class_lm.OPEN, classes[y]] += number[x] == 1
    k = model.n_classes
    grid = np.array([[pairs[a, b] for b in range(k)] for a in range(k)], float)
    share = (grid.sum(axis=0) + 1) / (grid.sum() + k)
    want = np.log10((grid + 20 * share) / (grid.sum(axis=1, keepdims=True) + 20))
    assert np.allclose(moves, want)
    got = {r.doc_id: r.score for r in class_lm.score(own, model, moves).collect()}
    for i, t in rows:
        ws = [b"\n", *t.encode().split(), b"\n"]
        assert got[i] == pytest.approx(sum(want[classes[x], classes[y]] + math.log10(number[y] + 0.1) - model.below[classes[y]] for x, y in zip(ws, ws[1:], strict=False)))


def test_exchange_raises_the_likelihood_pass_by_pass():
    rng = np.random.default_rng(7)
    pairs = rng.poisson(0.6, (40, 40)) + 8.0 * (np.add.outer(np.arange(40), np.arange(40)) % 3 == 0)
    found = [class_lm.likelihood(pairs, class_lm.exchange(pairs, 5, passes=p)) for p in (0, 1, 2, 3, None)]
    assert found == sorted(found) and found[0] < found[1]


def test_neighbours_of_words_counted_in_parts(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "HELD", 3)
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["the", "of", *(f"w{i}" for i in range(20))], k=6)) for _ in range(3000)]
    items, classes = {b"the": 2, b"of": 3}, np.array([0, 1, 2, 3])
    want = Counter()
    for t in texts:
        ws = t.encode().split()
        at = [1, *(int(classes[items[w]]) if w in items else 0 for w in ws), 1]
        for i, w in enumerate(ws):
            if w not in items:
                want[class_lm.word_key(w), "left", at[i]] += 1
                want[class_lm.word_key(w), "right", at[i + 2]] += 1
    got = Counter()
    for r in class_lm.neighbours(spark.createDataFrame([(t,) for t in texts], "text string"), items, classes).collect():
        for side in ("left", "right"):
            if r[side] >= 0:
                got[r["key"], side, r[side]] += r["n"]
    assert got == want


def test_exchange_ends_where_no_move_raises_the_likelihood():
    for seed in range(4):
        rng = np.random.default_rng(seed)
        pairs = rng.poisson(rng.dirichlet(np.full(30, 0.3), size=30) * rng.pareto(1, (30, 1)) * 60).astype(float)
        cls = class_lm.exchange(pairs, 5)
        least = class_lm.likelihood(pairs, cls)
        for i in range(class_lm.FIXED, 30):
            for b in range(class_lm.FIXED, class_lm.FIXED + 5):
                moved = cls.copy()
                moved[i] = b
                assert class_lm.likelihood(pairs, moved) <= least + 1e-6


def test_a_word_goes_where_it_adds_most():
    rng = np.random.default_rng(8)
    grid = rng.poisson(30, (6, 6)).astype(float)
    gains = class_lm.Gains(grid)
    word, side, n = np.array([0, 0, 0, 1, 1]), np.array([2, 6 + 3, 6 + 4, 3, 6 + 0]), np.array([2, 1, 1, 1, 1])
    f = lambda v: float((v * np.log(v)).sum())
    whole = lambda g: f(g) - f(g.sum(axis=0)) - f(g.sum(axis=1))
    best, total = gains.best(word, side, n)
    assert total.tolist() == [2, 1]
    for w in (0, 1):
        likely = []
        for b in range(class_lm.FIXED, 6):
            # What the class's cells, its row and its column become.
            a = 0.0
            for s, x in zip(side[word == w], n[word == w], strict=True):
                cell = grid[s, b] if s < 6 else grid[b, s - 6]
                a += (cell + x) * math.log(cell + x) - cell * math.log(cell)
            for edge in (grid.sum(axis=1)[b], grid.sum(axis=0)[b]):
                a -= (edge + total[w]) * math.log(edge + total[w]) - edge * math.log(edge)
            likely.append(a)
        assert best[w] == class_lm.FIXED + int(np.argmax(likely))
    assert whole(grid) < 0


# --- packing, mixing, archives ----------------------------------------------------------------------------------------


def test_letter_words_are_encoded_many_at_once(monkeypatch):
    cuts, given = packing.Cuts(queries.tokenizer_path()), []
    one, whole = cuts.tokenizer, cuts.encode
    monkeypatch.setattr(cuts, "encode", lambda texts: given.extend(texts) or whole(texts))
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgho\u00e9\u00fc\u00f1", k=rng.randrange(1, 14))) for _ in range(3000)]
    odd = ["it's", "x1", "<|endoftext|>", "e\u0301t", "\u4e2d", "a,b", "end.", "LAST,", "\u0130", "\u00df"]
    for texts in ([" ".join(words)], [" ".join(rng.sample(odd + words[:50], 40)) for _ in range(20)], ["", "a"]):
        got = cuts.ids([t.encode() for t in texts])
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [one.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(given) < 100


def brute_best_fit(lengths, limits):
    bins = []
    scale, w = (limits.max_tokens, limits.max_docs, limits.max_cost), limits.weights
    place = {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = (lengths[i], 1, lengths[i] ** 2)
        fit = [(b, r) for b, r in enumerate(bins) if all(x >= y for x, y in zip(r, need, strict=True))]
        if limits.rule == "norm":
            key = lambda x: sum(k * ((a - n) / s) ** 2 for k, a, n, s in zip(w, x[1], need, scale, strict=True))
        else:
            key = lambda x: -sum(k * a * n / s**2 for k, a, n, s in zip(w, x[1], need, scale, strict=True))
        if not fit:
            bins.append(scale)
        b = min(fit, key=key)[0] if fit else len(bins) - 1
        place[i] = (need, b, bins[b])
        bins[b] = tuple(x - y for x, y in zip(bins[b], need, strict=True))
    return bins, place


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [(100, 4, 6000), (100, 99, 10_000), (100, 2, 10_000)])
def test_best_fit_is_the_best_fit(rule, limits):
    rng = np.random.default_rng(9)
    lengths = rng.integers(1, 70, 200)
    limits = packing.Limits(*limits, (1.0, 0.7, 0.9), rule)
    bins, _ = packing.best_fit(lengths, limits)
    want, _ = brute_best_fit(lengths.tolist(), limits)
    rest = sorted((limits.max_tokens - int(lengths[bins == b].sum()), limits.max_docs - int((bins == b).sum()), limits.max_cost - int((lengths[bins == b] ** 2).sum())) for b in range(bins.max() + 1))
    assert rest == sorted(want)


def test_pieces_are_gapless_and_carry_their_ids(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(queries.tokenizer_path())
    rows = [(r.doc_id, r.text) for r in read(spark, SF, "documents").select("doc_id", "text").collect()] + [(10**9, None), (10**9 + 1, "ALİ, İ.")]
    out = packing.best_fit_packing(spark.createDataFrame(rows, "doc_id long, text string"), queries.tokenizer_path()).collect()
    for i, t in rows:
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted((r for r in out if r.doc_id == i), key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in own] == [(j, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for j, s in enumerate(range(0, len(ids), 4096))]
    held = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == held.get(r.sequence_id, 0)
        held[r.sequence_id] = r.offset + r.length
    assert max(held.values()) <= 4096


def test_the_number_of_sequences_does_not_hang_on_shards(spark):
    rng = np.random.default_rng(10)
    lengths = rng.integers(1, 3000, 3000).tolist()
    rows = spark.createDataFrame([(i, 0, n, 0) for i, n in enumerate(lengths)], "doc_id long, piece int, length long, ids_crc32 long")
    least = -(-sum(lengths) // 4096)
    for shard in (10_000, 300, 60):
        out = packing.pack(rows, shard_pieces=shard).collect()
        assert sorted(r.doc_id for r in out) == list(range(3000))
        ends = Counter()
        for r in out:
            ends[r.sequence_id] += r.length
        assert max(ends.values()) <= 4096 and len(ends) <= 1.02 * least + 1
    same = spark.createDataFrame([(i, 0, 3000, 0) for i in range(500)], "doc_id long, piece int, length long, ids_crc32 long")
    assert packing.pack(same, shard_pieces=60).select("sequence_id").distinct().count() == 500


def test_mix_takes_nothing_too_often(spark):
    rows = [(i, f"s{i % 3}", "" if i % 2 else "a b " * (i % 7)) for i in range(300)] + [(1000, "only-empty", ""), (1001, "only-empty", None), (None, None, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    times = Counter(r.doc_id for r in mixing.mix(df).collect())
    assert max(times.values()) <= 2 and max(r.copies for r in mixing.mix_plan(df).collect()) <= 2


def test_histories_over_many_slices(spark):
    rng = random.Random(11)
    rows = [(f"{i}", f"http://h{rng.randrange(9)}.org/{rng.randrange(5)}", f"2024-01-0{rng.randrange(1, 6)}T00:00:00Z", f"f{rng.randrange(6)}", i) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, url string, date string, file string, offset long")
    out = sorted(warc.histories(df, slice_rows=40).collect(), key=lambda r: (r.part, r.place))
    assert len({r.part for r in out}) > 5
    assert [r.id for r in out] == [r[0] for r in sorted(rows, key=lambda r: (warc.url_key(r[1]), r[2], r[0], r[3], r[4]))]


# --- names that clash, nulls and ties ---------------------------------------------------------------------------------


def test_result_columns_take_the_place_of_extra_ones(spark):
    rows = [(i, "some plain words " * 20, "en", "s", "old", "old", "old", "old") for i in range(5)] + [(None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string, score string, evidence string, N_WORDS string")
    marks = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    for out, names in (
        (toxicity.score(df, toxicity.fit(df, marks)), ("score", "evidence")),
        (quality.quality_rules(df), ("kept", "n_words")),
        (html_text.extract(df, page="text", into="text"), ("text",)),
    ):
        lower = [c.lower() for c in out.columns]
        assert len(set(lower)) == len(lower) and all(n in lower for n in names)
        assert out.select(*names).count() == 6 and "old" not in {str(v) for r in out.select(*names).collect() for v in r}


def test_near_duplicates_of_awkward_rows(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (4, "A B c d e f"), (9, None), (8, " "), (None, "a b c d e f"), (7, "x"), (6, "x")]
    out = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=4).collect()), key=repr)
    assert out == sorted([(5, 3, 4, False), (5, 3, 4, False), (4, 3, 4, True), (9, 0, 9, True), (8, 0, 8, True), (None, 3, None, True), (7, 1, 6, False), (6, 1, 6, True)], key=repr)
