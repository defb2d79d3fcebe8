"""The dealt operators against brute force, round trips and held-out accuracy, with odd rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodegraph.llm import bpe, exact_dedup, filter_audit, gated_lm, html_extract, mixing, page_samples, quality, quality_rules
from lodegraph.llm import queries as llm
from lodegraph.llm import resampling, secrets, simhash, toxicity, va_search

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, row string"


def frame(spark, texts, ids=None, sources=None):
    ids, sources = ids or range(len(texts)), sources or ["a"] * len(texts)
    rows = [(i, t, "en", s, len(t or ""), "x", "y") for i, t, s in zip(ids, texts, sources)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, repeated, very long and hostile texts, columns with clashing names."""
    texts = [None, "", " \t", "Word", "word", "word", "x" * 200_000, "é ñ   ü", "a b c d e f g " * 3000, None, "pass" * 9]
    return frame(spark, texts, [0, 1, 2, 3, 4, 4, 5, 6, 7, None, 8], ["a", "b", None, "b", "a", "a", "c", "a", "c", "a", None])


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def lowered(text):
    return text.translate({i: i + 32 for i in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text))


# ---------------------------------------------------------------- exact dedup


def dedup_by_hand(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lowered(t or ""), []).append(i)
    return {t: (max(x for x in g if x is not None) if any(x is not None for x in g) else None, len(g)) for t, g in groups.items()}


def test_exact_dedup(spark, odd, empty, documents):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = dedup_by_hand(rows)
    got = exact_dedup.classes(odd).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == len(want)
    sizes = Counter((r["keep_id"], r["group_size"]) for r in got)
    assert sizes == Counter(v for _, t in rows for v in [want[lowered(t or "")]])
    assert exact_dedup.classes(empty).collect() == []
    found = {r["doc_id"]: r for r in llm.op8_exact_dedup(spark, SMALL).collect()}
    hand = dedup_by_hand(documents.items())
    for i, t in documents.items():
        keep, size = hand[lowered(t)]
        digest = hashlib.sha256(lowered(t).encode()).hexdigest()
        r = found[i]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (keep, size, keep == i, digest)


def test_short_fingerprints_need_the_byte_check(spark):
    rows = frame(spark, [f"text {i % 40}" for i in range(200)])
    got = exact_dedup.classes(rows, fingerprint_bits=3).collect()
    assert {r["group_size"] for r in got} == {5} and sum(r["kept"] for r in got) == 40


def test_golomb_round_trip():
    rng = np.random.default_rng(1)
    for top in (1, 5, 1000, 1 << 40):
        gaps = rng.integers(0, top, 500).astype(np.uint64)
        rice, unary, low = exact_dedup.rice_encode(gaps)
        assert (exact_dedup.rice_decode(500, rice, unary, low) == gaps).all()


def test_deduplicate_keeps_columns(odd):
    kept = exact_dedup.deduplicate(odd)
    assert kept.columns == odd.columns
    assert len({lowered(r["text"] or "") for r in kept.collect()}) == kept.count()


# ---------------------------------------------------------------- simhash


def components_by_hand(prints):
    ids = list(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(spark, odd, empty, documents):
    import xxhash

    def fingerprint(text):
        w = words(text)
        n = min(3, len(w)) or 1
        shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if w else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0

    prints = {i: fingerprint(t) for i, t in documents.items()}
    want = components_by_hand(prints)
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in llm.op9_simhash(spark, SMALL).collect()}
    assert got == {i: (prints[i], want[i]) for i in documents}
    assert simhash.near_duplicates(odd, 3).count() == odd.count()
    assert simhash.near_duplicates(empty, 3).count() == 0
    assert simhash.keep_one(odd, 3).columns == ["doc_id", *[c for c in odd.columns if c != "doc_id"]]


def test_simhash_finds_all_planted_links(spark, monkeypatch):
    """Every distance up to 3 is found, also where runs are cut again."""
    monkeypatch.setattr(simhash, "RUN_ROWS", 8)
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(1 << 62, size=6)]
    prints = {p for b in base for p in [b] + [b ^ sum(1 << int(i) for i in rng.choice(62, int(rng.integers(1, 4)), False)) for _ in range(30)]}
    low = int(base[0]) & ~0xFFFFFFFF
    prints |= {low | int(x) for x in rng.integers(1 << 31, size=40)}
    table = spark.createDataFrame([(p,) for p in prints], "print long")
    from lodegraph.llm.grouping import components

    got = {r["node"]: r["root"] for r in components(simhash.links(table)).collect()}
    want = components_by_hand({p: p for p in prints})
    assert {p: got.get(p, p) for p in prints} == want


# ---------------------------------------------------------------- search


def test_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(300 + i, rows[50][1]) for i in range(20)] + [(400, None), (401, [float("nan")] * 8), (450, [1.0, None]), (500, [1.0] * 3)]
    table = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, score int")
    got = {}
    for r in va_search.search(table, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    v = {i: np.floor(256 * np.array(e, np.float32).astype(float)).astype(int) for i, e in rows if e and None not in e and np.isfinite(e).all()}
    for q in [i for i in v if i % 50 == 0]:
        best = sorted(((-int(v[q] @ v[i]), i) for i in v if i != q and len(v[i]) == len(v[q])))[:5]
        assert sorted(got.get(q, [])) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert va_search.search(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_with_repeated_ids(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(120)]
    rows += [(7, rows[7][1])] + [(8, rows[8][1])] * 2 + [(9, rows[60][1]), (50, rows[70][1])]
    rows += [(100, rows[100][1])] * 7 + [(200 + i, rows[100][1]) for i in range(3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in va_search.search(table, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    v = [(i, np.floor(256 * np.array(e, np.float32).astype(float)).astype(int)) for i, e in rows]
    for q in (0, 50, 100, 200):
        # Equal rows of a query ask once; of different ones a candidate row has its best score.
        best = sorted((-max(int(a @ b) for i, a in v if i == q), j) for j, b in v if j != q)[:5]
        assert sorted(got[q]) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]


def test_top_k_with_outliers_and_many_blocks(spark, monkeypatch):
    """One huge component, huge and short vectors, null ids, and many blocks of queries and cells."""
    monkeypatch.setattr(va_search, "BLOCK_BYTES", 512)
    monkeypatch.setattr(va_search, "GROUP_BLOCKS", 2)
    monkeypatch.setattr(va_search, "HELD_CANDIDATES", 16)
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(400)]
    rows += [(401, [2_000_000.0, *[0.0] * 5]), (402, [1e9] * 6), (403, [3e38] * 6), (500, []), (501, [])]
    rows += [(None, [1.0] * 6), (404, [1.5] * 2500), (405, [0.5] * 2500), (450, [0.25] * 2500)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, row string")
    got = {}
    for r in va_search.search(table, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = lambda x: max(-(1 << 62), min(1 << 62, int(np.floor(256 * float(np.float32(x))))))
    v = [(i, [whole(x) for x in e]) for i, e in rows if i is not None]
    for q, a in [(i, e) for i, e in v if i % 50 == 0]:
        score = lambda e: max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, e))))  # noqa: B023, E731
        best = sorted((-score(e), i) for i, e in v if i != q and len(e) == len(a))[:5]
        assert sorted(got.get(q, [])) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]


# ---------------------------------------------------------------- pages


def test_html(spark):
    held_out = page_samples.labelled_pages(spark)
    model = html_extract.fit(held_out.limit(150))
    rows = held_out.collect()[150:250]
    right = sum(html_extract.main_text(r["html"], model) == r["text"] for r in rows)
    assert right >= 0.8 * len(rows)
    odd_pages = [(1, "u", None), (2, "u", ""), (3, None, "<p>"), (4, "u", "plain words"), (5, "u", "<div>" * 2000), (5, "u", "&amp;&#")]
    got = html_extract.extract(spark.createDataFrame(odd_pages, "page_id long, url string, html string"), held_out.limit(20))
    assert got.count() == len(odd_pages)
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect())
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string"), held_out.limit(20)).count() == 0


def test_viterbi_and_gradient_by_hand():
    import itertools

    rng = np.random.default_rng(12)
    model = html_extract.Crf(rng.normal(size=html_extract.Crf.SIZE))
    found = [rng.choice(html_extract.DIMS, 6, replace=False) for _ in range(7)]
    same = [0, 1, 1, 0, 1, 0, 1]

    def value(m, labels):
        total = m.first[labels[0]] + sum(m.emit[f, y].sum() for f, y in zip(found, labels))
        return total + sum(m.move[same[i], labels[i - 1], labels[i]] for i in range(1, len(labels)))

    every = list(itertools.product((0, 1), repeat=7))
    assert tuple(model.decode(found, same)) == max(every, key=lambda y: value(model, y))
    gold = [0, 1, 1, 0, 0, 1, 1]
    likelihood = lambda m: value(m, gold) - np.logaddexp.reduce([value(m, y) for y in every])
    start = model.vector.copy()
    moved = html_extract.Crf(start.copy())
    moved.step(found, same, gold, 1e-3)
    step = moved.vector / (1 - html_extract.SHRINK) - start
    for at in [found[0][0] * 2, found[3][2] * 2 + 1, html_extract.DIMS * 2 + 1, html_extract.DIMS * 2 + 6, html_extract.DIMS * 2 + 9]:
        up, down = start.copy(), start.copy()
        up[at] += 1e-5
        down[at] -= 1e-5
        slope = (likelihood(html_extract.Crf(up)) - likelihood(html_extract.Crf(down))) / 2e-5
        scale = 1e-3 / 6**0.5 if at < html_extract.DIMS * 2 else 1e-3 / 7
        assert step[at] == pytest.approx(scale * slope, rel=1e-3, abs=1e-9)


P1 = "The council met on Tuesday to discuss the new bridge, and most of its members spoke for it."
P2 = "Work is to begin in spring; the old crossing stays open until the new one is finished."
HAND_WRITTEN = [
    f"<body><div id='top'><a href=/>Home</a> | <a href=/n>News</a></div><article><h1>Bridge</h1><p>{P1}<p>{P2}</article><footer>Imprint</footer>",
    f"<main><h1>Bridge</h1><p>{P1}</p><svg width='1'/><p>{P2}</p></main><aside><h3>Related</h3><a href=/x>Other news of the day</a></aside>",
    f"<div class='cookie-consent'><p>We use cookies.</p><button>OK</button></div><div class=entry-content><h1>Bridge</h1><p>{P1}</p><canvas><p>{P2}</p></div>",
    f"<header><nav><ul><li><a href=/>Start</a><li><a href=/b>Blog</a></ul></nav></header><section class=content><h1>Bridge</h1><p>{P1}</p><svg><p>{P2}</p></section><form><label>Mail</label><input><button>Go</button></form>",
    f"<article><h1>Bridge</h1><p>{P1}</p><div class='advertisement'><p>Buy two, pay one!</p></div><p>{P2}</p></article><section id=comments><h3>2 comments</h3><div class=comment><p>Nice work, I like it.</p></div></section>",
]


def test_hand_written_pages(spark):
    model = html_extract.fit(page_samples.labelled_pages(spark))
    right = []
    for page in HAND_WRITTEN:
        found = html_extract.leaf_blocks(page)
        labels = model.decode(html_extract.features(found), html_extract.within(found))
        right += [(b.text in ("Bridge", P1, P2)) == bool(y) for b, y in zip(found, labels)]
    assert sum(right) >= 0.9 * len(right)
    blocks = lambda page: [b.text for b in html_extract.leaf_blocks(page)]
    for tag in ("svg width='1'/", "math/", "svg", "canvas", "iframe", "title", "object", "noscript"):
        assert blocks(f"<p>A</p><{tag}><p>B</p>") == ["A", "B"]
    assert blocks("<p>A</p><svg><text>icon</text></svg><p>B</p><script>x<p>C") == ["A", "B"]
    deep = "<div>" * 20_000 + "<p>in</p>" + "<a href=/>x</a>" * 2000
    assert blocks(deep) == ["in", "x" * 2000]
    rows = [(1, "u", "<article><p>" + "long text here. " * 100_000, "t", 5)]
    page = html_extract.extract(
        spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int"), page_samples.labelled_pages(spark, 40)
    ).first()
    assert page["n_chars"] == 1_599_999


# ---------------------------------------------------------------- language model


def test_language_model_counts(spark, documents):
    got = {r["doc_id"]: r for r in llm.op3_gated_lm(spark, SMALL).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in documents.items() if not held(i) for w in [*words(t), None])
    total, distinct = sum(counts.values()), len(counts)
    for i, t in documents.items():
        tokens = [*words(t), None]
        base = sum(np.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held(i), len(tokens), total)
        assert r["n_known"] == sum(counts[w] > 0 for w in tokens)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_language_model_is_a_distribution():
    weight = np.array([50.0, 40.0, 9.0, 5.0, 5.0, 3.0, 1.0] * 30)
    net = gated_lm.Network(np.sort(weight)[::-1])
    h = np.random.default_rng(0).normal(size=(3, gated_lm.HIDDEN)).astype(np.float32)
    all_ids = np.arange(len(weight))
    for row in h:
        logs = net.log_probabilities(np.repeat(row[None], len(weight), 0), all_ids)
        assert np.exp(logs.astype(float)).sum() == pytest.approx(1, abs=1e-3)


def test_language_model_state_is_carried(monkeypatch):
    net = gated_lm.Network(np.arange(300.0, 0, -1))
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 300, n).astype(np.int32) for n in (1, 7, 300, 40)]
    whole = gated_lm.log_likelihoods(net, texts)
    monkeypatch.setattr(gated_lm, "SCORE_WINDOW", 5)
    assert gated_lm.log_likelihoods(net, texts) == pytest.approx(whole, rel=1e-5)


def test_language_model_against_a_plain_forward_pass():
    net = gated_lm.Network(np.arange(150.0, 0, -1))
    rng = np.random.default_rng(3)
    net.vector[: len(net.vector) // 2] += rng.normal(0, 0.2, len(net.vector) // 2).astype(np.float32)
    texts = [rng.integers(0, 150, n).astype(np.int32) for n in (1, 30, 9)]
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    width = gated_lm.HIDDEN
    for text, got in zip(texts, gated_lm.log_likelihoods(net, texts)):
        h, before, total = np.zeros(width), net.start, 0.0
        for target in text:
            x, back = net.embed[before] @ net.into + net.shift, h @ net.back
            z, r = sigmoid(x[:width] + back[:width]), sigmoid(x[width : 2 * width] + back[width : 2 * width])
            h = z * h + (1 - z) * np.tanh(x[2 * width :] + r * back[2 * width :])
            c = net.class_of[target]
            classes = np.exp(h @ net.class_out + net.class_bias)
            mine = np.flatnonzero(net.class_of == c)
            inner = np.exp(net.word_out[mine] @ h + net.word_bias[mine])
            total += np.log10(classes[c] / classes.sum()) + np.log10(inner[target - mine[0]] / inner.sum())
            before = target
        assert got == pytest.approx(total, rel=1e-3)


def test_language_model_gradient():
    net = gated_lm.Network(np.arange(200.0, 0, -1))
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 5, 200).astype(np.int32) for _ in range(4)]
    before = gated_lm.log_likelihoods(net, texts).sum()
    for _ in range(20):
        given, target, fresh, _, _ = gated_lm.woven(texts, 4, net.start)
        net.learn(given, fresh, target, np.zeros((given.shape[1], gated_lm.HIDDEN), np.float32))
    net._table = None
    assert gated_lm.log_likelihoods(net, texts).sum() > before + 100


def test_language_model_trains_on_all_rows(spark, monkeypatch):
    text = "concat_ws(' ', transform(sequence(1, 1000), x -> concat('w', pmod(hash(id, x), 300))))"
    docs = spark.range(0, 1500, 1, 4).selectExpr("id as doc_id", f"{text} as text")
    reached, averaged = [], gated_lm.averaged

    def seen(parts, trainers):
        reached.append(parts.filter("block = 0").agg(F.sum("tokens")).first()[0])
        return averaged(parts, trainers)

    monkeypatch.setattr(gated_lm, "averaged", seen)
    monkeypatch.setattr(gated_lm, "ROUNDS", 1)
    tokens = gated_lm.score(docs).first()["train_tokens"]
    assert tokens > 1_200_000
    assert reached == [tokens]


def test_language_model_odd_rows(odd, empty):
    assert gated_lm.score(odd).count() == odd.count()
    assert all(np.isfinite(r["score"]) for r in gated_lm.score(odd).collect())
    assert gated_lm.score(empty).count() == 0


# ---------------------------------------------------------------- secrets


def spans_by_hand(text):
    out = []
    for kind, pattern, least in (
        ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6),
        ("access", r"AKIA[A-Z0-9]+", 20),
        ("hex", r"[0-9a-f]+", 24),
    ):
        for m in re.finditer(pattern, text):
            value = m[2] if kind == "assign" else m[0]
            if len(value) >= least:
                out.append((m.start(), ("assign", "access", "hex").index(kind), m.end(), kind))
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


def test_secrets(spark, odd, empty, documents):
    keys = ["AKIA" + "Q7" * 8, "token = 'abcdef123456'", "é token:x.y-z/1", "f" * 23, "0a1b2c3d4e5f60718293a4b5", "PASSWD=ab", "secret=\U0001f600 api_key=aaaaaa"]
    texts = [*documents.values(), *keys, " ".join(keys)]
    got = secrets.scan(frame(spark, texts)).collect()
    for r in got:
        want = spans_by_hand(texts[r["doc_id"]])
        assert r["base"] == ",".join(want)
        assert set(want) <= set(r["spans"].split(",")) | {""}
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))
    assert secrets.scan(odd).count() == odd.count() and secrets.scan(empty).count() == 0


def test_random_strings_stand_out_from_words(spark):
    """With long ordinary words of like length to compare with, random strings are found."""
    rng = np.random.default_rng(9)
    alphabet = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    parts = "the an er in on re ti es or st en at ed nd to it is ou ea hi".split()
    texts = [f"note {''.join(rng.choice(alphabet, 64))} end" for _ in range(40)]
    texts += [" ".join("".join(rng.choice(parts, 31))[:64] for _ in range(5)) for _ in range(80)]
    got = {r["doc_id"]: r["n_random"] for r in secrets.scan(frame(spark, texts)).collect()}
    assert sum(got[i] for i in range(40)) >= 36 and sum(got[i] for i in range(40, 120)) == 0


def test_random_strings_are_found(spark):
    rng = np.random.default_rng(8)
    alphabet = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    texts = [f"note {''.join(rng.choice(alphabet, 64))} end" for _ in range(40)] + ["thethethethethethethethe words", "a" * 64] * 20
    got = {r["doc_id"]: r["n_random"] for r in secrets.scan(frame(spark, texts)).collect()}
    assert sum(got[i] for i in range(40)) >= 36 and sum(got[i] for i in range(40, 80)) == 0


def test_randomness_p_values(spark):
    """The p-values of even strings are spread evenly; those of text are small only by chance."""
    rng = np.random.default_rng(10)
    alphabet = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    shares = np.array([8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2, 6.1, 7, 0.2, 0.8, 4, 2.4, 6.7, 7.5, 1.9, 0.1, 6, 6.3, 9.1, 2.8, 1, 2.4, 0.2, 2, 0.1])
    letters = list("abcdefghijklmnopqrstuvwxyz")
    rows = [("even", "".join(rng.choice(alphabet, 48))) for _ in range(300)]
    rows += [("text", "".join(rng.choice(letters, 48, p=shares / shares.sum()))) for _ in range(300)]
    tests = secrets.tested(spark.createDataFrame(rows, "kind string, value string")).collect()
    even = [r for r in tests if r["kind"] == "even"]
    for p in ("p_even", "p_runs", "p_serial"):
        assert 0.35 < np.mean([r[p] for r in even]) < 0.65
    assert np.mean([r["p_text"] < 0.001 for r in even]) > 0.95
    assert np.mean([r["p_text"] < 0.01 for r in tests if r["kind"] == "text"]) <= 0.03
    for r in even[:20]:
        v = r["value"]
        squares = sum(v.count(c) ** 2 for c in set(v))
        assert r["chi_squared"] == pytest.approx(62 * squares / 48 - 48)


# ---------------------------------------------------------------- classifiers


def accuracy(rows, labels, column):
    known = {r["doc_id"]: r[column] for r in labels.collect() if r[column] is not None}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in known]
    return sum(r["predicted"] == known[r["doc_id"]] for r in held) / len(held)


@pytest.mark.parametrize("operator, column, least", [(quality, "quality", 0.85), (toxicity, "toxic", 0.9)])
def test_classifiers(spark, odd, empty, operator, column, least):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    rows = operator.score(docs, labels).collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert accuracy(rows, labels, column) >= least
    assert operator.score(odd, labels).count() == odd.count()
    assert operator.score(odd, labels.limit(0)).count() == odd.count()
    assert operator.score(empty, labels).count() == 0


def test_segments_are_the_maximal_ones():
    rng = np.random.default_rng(6)
    for _ in range(50):
        score = [float(x) for x in rng.choice([1.0, 2.0, -1.5, -0.7], 12)]
        at = [i for i, s in enumerate(score) if s > 0]
        flat = [s if s > 0 else -1.0 for s in score]
        got = {(a, b) for a, b, _ in toxicity.segments(at, [score[i] for i in at], 1.0)}

        def best(low, high):
            sums = [(sum(flat[a : b + 1]), -(b - a), -a, a, b) for a in range(low, high) for b in range(a, high)]
            top = max(sums, default=(0, 0, 0, 0, 0))
            return set() if top[0] <= 0 else {(top[3], top[4])} | best(low, top[3]) | best(top[4] + 1, high)

        assert got == best(0, len(flat))


# ---------------------------------------------------------------- bpe


def test_bpe_agrees_with_the_library(spark, odd, empty, documents):
    from tokenizers import Tokenizer

    path = llm.vocabulary_path()
    library = Tokenizer.from_file(path)
    texts = [*list(documents.values())[:120], "<|endoftext|> a<|endoftext|>", "don't  stop\n\n\t 123abc é\U0001f600", "", "a" * 5000, " " * 300]
    encoded = bpe.encode(frame(spark, texts), path)
    got = {r["doc_id"]: r for r in bpe.decode(encoded, path).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t, add_special_tokens=False).ids
        assert list(np.frombuffer(got[i]["ids"], "<u4")) == ids
        assert got[i]["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(odd, path).count() == odd.count() and bpe.encode(empty, path).count() == 0
    whole = {r["doc_id"]: tuple(r) for r in bpe.round_trip(frame(spark, texts), path).collect()}
    assert whole == {i: tuple(r) for i, r in got.items()} and bpe.round_trip(empty, path).count() == 0


# ---------------------------------------------------------------- mixing


def test_mixing_meets_its_targets(spark, odd, empty):
    docs = frame(spark, [f"w{i} " * (i % 90) for i in range(400)], None, [["a", "b", None, "c"][i % 4] for i in range(400)])
    rows = mixing.taken(docs, block_words=16).collect()
    again = mixing.taken(docs, block_words=16).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    sizes = {r["doc_id"]: len((docs_text or "").split()) for r, docs_text in ((r, f"w{r['doc_id']} " * (r["doc_id"] % 90)) for r in rows)}
    assert all(r["size"] == sizes[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"] for r in rows)
    by_source = {}
    for r in rows:
        by_source.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    for (_, target), got in by_source.items():
        assert sum(got) == pytest.approx(target, abs=1)
    assert mixing.taken(odd).count() == odd.count() and mixing.taken(empty).count() == 0


def test_mixed_rows_keep_their_own_columns(spark, tmp_path):
    """Rows with one doc_id and one text but different sources, from files and made in place."""
    rows = [(1, "a b c d", "en", "x", 7, "p", "q"), (1, "a b c d", "de", "y", 7, "r", "s"), (2, "e f g", "en", "x", 5, "p", "q"), (3, "h i j", "en", "x", 5, "p", "q"), (None, None, None, None, None, None, None)]
    made = spark.createDataFrame(rows, DOCS)
    made.repartition(3).write.parquet(str(tmp_path / "docs"))
    for docs in (made, spark.read.parquet(str(tmp_path / "docs")).filter("n_chars is null or n_chars > 0")):
        want = {(r["source_size"], r["size"], r["doc_id"]): r["taken"] for r in mixing.taken(docs).collect()}
        got = {}
        for r in mixing.mixed_documents(docs).collect():
            key = (10 if r["source"] == "x" else 4, 4 if r["doc_id"] == 1 else 3, r["doc_id"])
            assert r["lang"] == ("de" if r["source"] == "y" else "en") and r["digest"] == ("r" if r["source"] == "y" else "p")
            got[key] = got.get(key, 0) + len(r["text"].split())
        assert got == {k: n for k, n in want.items() if n}


def test_permutations():
    for n in (1, 2, 5, 1000):
        at = np.arange(n)
        image = mixing.permute(at, np.full(n, n), np.full(n, 77))
        assert sorted(image) == list(range(n))
        assert (mixing.permute(image, np.full(n, n), np.full(n, 77), back=True) == at).all()


# ---------------------------------------------------------------- rules, resampling, audit


def rules_by_hand(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    symbols, chars = sum(c in "#*$%&|<>" for c in text), sum(map(len, w))
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    rejected = (
        100 * symbols > 10 * len(w)
        or not 2 * len(w) <= chars <= 14 * len(w)
        or 100 * (len(lines) - len(set(lines))) > 30 * len(lines)
        or 100 * sum("A" <= c <= "Z" for c in text) > 40 * chars
        or 100 * sum(c in "!?" for c in text) > 30 * len(w)
        or 100 * sum(a == b for a, b in zip(w, w[1:])) > 20 * len(w)
        or 100 * sum(any(c.isalpha() for c in x) for x in w) < 70 * len(w)
        or 100 * sum(bool(re.search(r"(\.\.\.|…)[\x20\x09-\x0D]*$", x)) for x in lines) > 30 * len(lines)
        or 100 * sum(bool(re.search(r"^[\x20\x09-\x0D]*[-*•]", x)) for x in lines) > 90 * len(lines)
    )
    return len(w), chars, symbols, len(lines) - len(set(lines)), len(covered), failed, not failed and not rejected


def test_quality_rules(spark, odd, empty, documents):
    base = " ".join(f"word{i}x" for i in range(60))
    made = ["a a a a a " * 20, base, base + "\n- one\n" * 9, base.upper(), base + " # $ % & " * 9, (base + "...\n") * 2, base + "! ? " * 40,
            " ".join(str(i) for i in range(80)), "-" + base, "x" * 5000 + " " + base, "é ñ " * 30 + base, base + "\x0b\x0c\r" + base, base + " same" * 40]
    texts = [*documents.values(), *made, None, ""]
    rows = frame(spark, texts)
    for r in quality_rules.judge(rows).collect():
        got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))
        assert got == rules_by_hand(texts[r["doc_id"]] or ""), texts[r["doc_id"]]
    want = Counter((r["doc_id"], *rules_by_hand(r["text"] or "")) for r in odd.collect())
    assert Counter(tuple(r) for r in quality_rules.judge(odd).collect()) == want
    assert quality_rules.judge(empty).collect() == []
    assert quality_rules.judge(rows).filter("kept and n_words > 50").count() > 0  # a filter on the result is no trap


def test_rules_go_by_rejection_per_cost():
    found = {"slow": (0.5, 10.0), "fast": (0.2, 1.0), "idle": (0.0, 0.1), "dear": (0.0, 5.0)}
    assert quality_rules.ordered(found) == ["fast", "slow", "idle", "dear"]


def resampled_by_hand(rows, targets, percent=5):
    def runs(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    found = [(i, *runs(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in targets for b in runs(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: int(np.floor(1000 * np.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))))
    out = []
    for i, n, f in found:
        weight = sum(gain(b) for b in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + int(np.floor(-1000 * np.log(-np.log((h + 0.5) / 4294967296))))))
    fit = sorted((-r[4], r[0] is None, r[0] or 0) for r in out if r[1] >= 20)
    return out, fit[: percent * len(fit) // 100]


def test_resampling(spark, odd, empty, documents):
    texts = list(documents.values()) + [None, "", "a b", "w " * 40_000]
    rows = frame(spark, texts + texts[:60], [*range(len(texts)), *range(60)])
    bench = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    target = spark.createDataFrame([(t,) for t in bench + [None]], "text string")
    want, drawn = resampled_by_hand([(r["doc_id"], r["text"]) for r in rows.collect()], bench)
    got = resampling.resample(rows, target).collect()
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == Counter((i, f, w, s) for i, _, f, w, s in want)
    ranked = sorted((r["rank"], -r["score"], r["doc_id"]) for r in got if r["rank"])
    assert [r[1:] for r in ranked] == [(s, i) for s, _, i in drawn] and [r[0] for r in ranked] == list(range(1, len(drawn) + 1))
    assert resampling.resample(odd, target).count() == odd.count()
    assert resampling.resample(rows, target.limit(0)).count() == rows.count() and resampling.resample(empty, target).collect() == []


def test_buckets_do_not_depend_on_blocks(monkeypatch):
    text = b"Ab cd-ef gh \xc3\xa9\xc3\xb1 9z " * 50
    whole = sorted(np.concatenate([f for f, _ in resampling.buckets(text)]))
    monkeypatch.setattr(resampling, "BLOCK_WORDS", 7)
    assert sorted(np.concatenate([f for f, _ in resampling.buckets(text)])) == whole
    assert sum(n for _, n in resampling.buckets(text)) == 300


@pytest.mark.parametrize("bits", [2, 12])
def test_radix_selection_finds_every_key(spark, monkeypatch, bits):
    monkeypatch.setattr(resampling, "DIGIT_BITS", bits)
    rng = np.random.default_rng(13)
    keys = [(int(a), int(b), i) for i, (a, b) in enumerate(zip(rng.integers(-3, 4, 60), rng.integers(0, 5, 60)))]
    keys += [(-(1 << 62), 1 << 62, 60), ((1 << 62), -(1 << 63), 61), ((1 << 62), (1 << 63) - 1, 62), ((1 << 62) - 1, 0, 63)]
    table = spark.createDataFrame(keys, "a long, b long, r long")
    for k in (1, 2, 17, 40, 62, 63, 64):
        cut = resampling.cut_key(table, ["a", "b", "r"], k)
        assert tuple(cut) == sorted(keys)[k - 1]
        assert table.filter(resampling.up_to(["a", "b", "r"], cut)).count() == k


def audit_by_hand(rows, labels):
    import itertools

    least, fails = {}, []
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, p in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        fails.append((p or "", {x for x in f if f[x]}, any(q == 1 for j, q, _ in labels if j == i and i is not None), any(x == 1 for j, _, x in labels if j == i and i is not None)))
    out = {}
    for part in {f[0] for f in fails}:
        mine, shapley = [f for f in fails if f[0] == part], Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for n, x in enumerate(order):
                gone = [r for r in mine if r[1] & set(order[:n])]
                here = [r for r in mine if x in r[1] and not r[1] & set(order[:n])]
                shapley[x] += len(here)
                out[part, order, n + 1] = [len(mine) - len(gone) - len(here), len(here), sum(x in r[1] for r in gone), sum(r[1] == {x} for r in mine), sum(r[2] for r in here), sum(r[3] for r in here)]
        for (p, order, n), row in out.items():
            if p == part:
                row.append(shapley[order[n - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD_PARTS", 2)
    rng = np.random.default_rng(14)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 400, int(n))) + s for n, s in zip(rng.integers(1, 250, 60), ["", "#", "", "!"] * 15)]
    texts += [t.upper() for t in texts[:9]] + texts[:20] + [None, "", "é" * 200]
    ids = [*range(len(texts) - 4), None, 3, 3, None]
    docs = [(i, t, ["en", "de", None, "fr", ""][n % 5], "x", 1, "d", "r") for n, (i, t) in enumerate(zip(ids, texts))]
    labels = [(i, int(i % 2), int(i % 3 == 0)) for i in range(0, 70)] + [(4, 1, None), (5, None, 1), (None, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    for frame_ in (spark.createDataFrame(docs, DOCS), odd):
        want = audit_by_hand([(r["doc_id"], r["text"], r["lang"]) for r in frame_.collect()], labels)
        got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in columns) for r in filter_audit.audit(frame_, table).collect()}
        assert got == want
    assert filter_audit.audit(empty, table).collect() == []


def test_ridge_and_isotonic_by_brute_force():
    import itertools

    rng = np.random.default_rng(15)
    count, positive = rng.integers(1, 9, 6).astype(float), None
    positive = np.array([rng.integers(0, int(n) + 1) for n in count], float)
    got = quality.isotonic(count, positive)
    best = min(
        (sum(n * (p / n - sum(positive[a:b]) / sum(count[a:b])) ** 2 for a, b in zip(c, c[1:]) for n, p in zip(count[a:b], positive[a:b])), c)
        for r in range(6) for mid in itertools.combinations(range(1, 6), r) for c in [(0, *mid, 6)]
        if all(np.diff([sum(positive[a:b]) / sum(count[a:b]) for a, b in zip(c, c[1:])]) >= 0)
    )
    assert sum(n * (p / n - g) ** 2 for n, p, g in zip(count, positive, got)) == pytest.approx(best[0]) and (np.diff(got) >= 0).all()


def test_ridge_weights_against_least_squares(spark):
    rng = np.random.default_rng(16)
    x = rng.normal(size=(200, quality.N_STATISTICS))
    y = (x[:, 0] + 0.1 * rng.normal(size=200) > 0).astype(float)
    stats = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "doc_id long, stats array<float>")
    model = quality.fit(stats, spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "doc_id long, y double"))
    z = model.features(x.astype(np.float32).astype(float))
    size = quality.FEATURES + 1
    stacked = np.vstack([z, np.sqrt(quality.RIDGE * 200 / size) * np.eye(size)])
    want = np.linalg.lstsq(stacked, np.r_[y, np.zeros(size)], rcond=None)[0]
    assert model.weight == pytest.approx(want, abs=1e-6)
