"""The operators on small data against brute force, with nulls, ties, repeats, empty tables,
long texts and clashing column names."""

from __future__ import annotations

import base64
import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlake.llm import bpe, html_main, licenses, mih, nbsvm, ngram_join, packing, queries, rp_forest, suffix_lm, toxicity
from wardlake.llm import common
from wardlake.llm.common import ascii_lower_words, components, ship, word_count, word_hashes

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, h int, score double, component_id int"


@pytest.fixture(scope="module", autouse=True)
def _ship(spark):
    ship(spark)


def docs_of(spark, rows):
    """(id, text[, source]) rows with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(r[0], r[1], None, r[2] if len(r) > 2 else "s", None, "x", 1, 0.5, 7) for r in rows], DOCS)


ODD = [(1, None), (2, ""), (3, " \t\n"), (None, "some text here now"), (4, "some text here now"), (4, "some text here now"),
       (5, "word " * 30_000), (6, "é" * 5000), (7, "\x00\x1f odd")]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, k) for k in range(200, 260)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- 10: byte-level BPE ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers as P
    return bpe.Bpe(bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)


def test_bpe_like_tiktoken(tokenizer):
    import public_tokenizers as P
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng, find = random.Random(2), bpe.Pretokens(P.PATTERN)
    odd = [chr(c) for c in [*range(0x250), 0x1680, 0x180E, 0x2000, 0x2028, 0x3000, 0x4E2D, 0x1F600, 0x301, 0x200D, 0x660]]
    texts = ["".join(rng.choice(odd if rng.random() < 0.5 else "abcdefgh  \n\n\tthe1'") for _ in range(rng.randrange(60)))
             for _ in range(1500)] + ["ab" * 20_000, "", "<|endoftext|>", "it's I'LL we're  x"]
    for t in texts:
        ids = [i for p in find(t) for i in tokenizer.piece(p.encode())]
        assert ids == enc.encode_ordinary(t), t
        assert b"".join(tokenizer.vocabulary[i] for i in ids) == t.encode()


def test_minimal_perfect_hash(tokenizer):
    index = tokenizer.index
    assert index.n == len(set(index.keys)) == len(tokenizer.ranks)
    assert all(index.get(t) == i for t, i in tokenizer.ranks.items())
    assert index.get(b"no such token at all") is None


def test_bpe_rows(spark, tokenizer):
    out = bpe.decode(bpe.encode(docs_of(spark, ODD), tokenizer), tokenizer).collect()
    assert len(out) == len(ODD)
    assert Counter((r.id, bytes(r.decoded)) for r in out) == Counter((i, (t or "").encode()) for i, t in ODD)
    assert all(r.n_tokens * 4 == len(r.ids) for r in out)
    assert bpe.encode(docs_of(spark, []), tokenizer).count() == 0


# --- 5: license scan ---------------------------------------------------------------------------


def test_license_base_by_brute_force(spark):
    rng = random.Random(3)
    parts = ["mit", "MIT", "license", "License,", "apache", "general", "public", "x", "é", "--", "\n", "42", "gnu"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(60)))) for i in range(200)] + ODD
    got = {(r.id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(docs_of(spark, rows)).collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = set()
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
        at = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(w))
              if w[k:k + phrase.count(" ") + 1] == phrase.split()]
        ks = [k for k, _ in at]
        want.add((i, len(w), len(at), min(ks, default=None), max(ks, default=None), ",".join(sorted({x for _, x in at}))))
    assert got == want


def test_license_expressions():
    def of(text):
        return licenses.scan_text(licenses.automaton(), text)

    r = of("x\n# SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0\nend")
    assert r[5] == "apache,gpl,mit" and 0.9 < r[6] <= 1 and r[7] == ["MIT Apache-2.0 or GPL-2.0-only Classpath-exception-2.0 with and"]
    assert licenses.evaluate(licenses.parse("MIT OR GPL-3.0 AND Apache-2.0")) == ({"mit", "gpl", "apache"}, set(), 1)
    assert licenses.evaluate(licenses.parse("MIT AND (GPL-3.0 OR MIT)")) == ({"mit", "gpl"}, {"mit"}, 1)
    assert licenses.parse("( MIT OR") is None and licenses.parse("") is None and licenses.parse("MIT is nice") == ["MIT"]
    assert of("This work is licensed under the GNU Lesser General Public License")[5] == "gpl,lgpl"
    assert of("plain prose")[5:7] == ("", 0.0)


# --- 9: toxicity -------------------------------------------------------------------------------


def _all_maximal(x):
    """By definition: the best segment (leftmost, shortest), then the same on both sides of it."""
    out, todo = [], [(0, len(x))]
    while todo:
        a, b = todo.pop()
        best = max(((round(sum(x[i:j]), 9), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if best and best[0] > 0:
            i, j = -best[2], -best[2] - best[1]
            out.append((i, j, best[0]))
            todo += [(a, i), (j, b)]
    return sorted(out)


def test_maximal_segments():
    rng = random.Random(4)
    for _ in range(300):
        x = [rng.choice([-0.5, -0.5, 1.25, 2.5, -2.0]) for _ in range(rng.randrange(14))]
        got = toxicity.maximal_segments([(i, v) for i, v in enumerate(x) if v != -0.5])
        assert [(a, b, round(s, 9)) for a, b, s in got] == _all_maximal(x), x


def test_toxicity_and_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    tox = toxicity.score(docs, toxicity.fit(docs, labels)).select("id", F.col("score").alias("toxic_score"))
    qual = nbsvm.score(docs, nbsvm.fit(docs, labels)).select("id", F.col("score").alias("quality_score"))
    rows = (tox.join(qual, "id").join(labels.withColumnRenamed("doc_id", "id"), "id")
            .where(F.crc32(F.col("id").cast("string")) % 5 == 0).collect())
    assert len(rows) > 500
    hit = np.mean([(r.toxic_score >= 0.5) == (r.toxic == 1) for r in rows])
    clean = np.mean([r.toxic_score < 0.5 for r in rows if r.toxic == 0])
    assert hit > 0.95 and clean > 0.99
    assert np.mean([(r.quality_score >= 0.3) == (r.quality == 1) for r in rows]) > 0.95
    assert np.mean([r.quality_score >= 0.3 for r in rows if r.quality == 1]) > 0.98


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (nbsvm, "quality")])
def test_classifier_edges(spark, module, label):
    docs = docs_of(spark, ODD)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 9)] + [(4, 1, 1), (None, 1, 1), (2, None, None)],
                                   "doc_id bigint, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        got = module.score(docs, module.fit(docs, lab)).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    empty = docs_of(spark, [])
    assert module.score(empty, module.fit(empty, labels)).count() == 0
    stays = (toxicity.keep_clean if module is toxicity else nbsvm.keep_good)(docs, module.fit(docs, labels), 0.5)
    assert stays.columns == docs.columns


def test_dual_coordinate_descent_is_optimal():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 4))
    y = np.where(x[:, 0] + 0.5 * x[:, 1] + 0.1 * rng.standard_normal(60) > 0, 1.0, -1.0)
    idx = [np.arange(4)] * 60
    w, b = nbsvm.dual_coordinate_descent(idx, x.__getitem__, y, 4, np.ones(60), epochs=500)

    def loss(v):
        return 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v[:4] + v[4])).sum()

    best = np.append(w, b)
    for _ in range(300):
        assert loss(best) <= loss(best + 0.05 * rng.standard_normal(5)) + 1e-3


# --- 7: language model -------------------------------------------------------------------------


def test_suffix_tree_counts_and_scores(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["ab", "abc", "b", "Ca", "déf"]) for _ in range(rng.randrange(25)))) for i in range(80)]
    rows += [(i, t) for i, t in ODD if i != 5] + [(5, "word " * 300)]
    got = suffix_lm.score(docs_of(spark, rows)).collect()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    toks = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) + ["\n"]) for i, t in rows]
    count = Counter()
    for i, w in toks:
        if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
            count.update(w)
    n, v = sum(count.values()), len(count)
    want = Counter((i, len(w), sum(count[x] > 0 for x in w),
                    round(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for i, w in toks)
    assert Counter((r.id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n}
    assert all(r.held_out == (r.id is None or zlib.crc32(str(r.id).encode()) % 5 == 1) for r in got)
    assert all(r.score < 0 for r in got)
    assert suffix_lm.score(docs_of(spark, [])).count() == 0


def _tree_by_definition(texts, depth=5, least=2, divergence=5.0, smoothing=2.0):
    """The probability of a symbol behind a history, by the definition in the module."""
    nxt = {}
    for t, times in Counter(texts).items():
        t = b"\n" * depth + t
        for i in range(depth, len(t)):
            for d in range(depth + 1):
                nxt.setdefault(t[i - d:i], Counter())[t[i]] += times
    n = {c: sum(m.values()) for c, m in nxt.items()}
    some = {c for c in nxt if not c or n[c] >= least}

    @functools.cache
    def dist(c):
        up = dist(c[1:]) if c else [1 / 256] * 256
        back = smoothing * len(nxt[c])
        return [(nxt[c][s] + back * up[s]) / (n[c] + back) for s in range(256)]

    kept = set()
    for c in some:
        if len(c) <= 2 or n[c] * sum(p * math.log(p / q) for p, q in zip(dist(c), dist(c[1:]))) >= divergence:
            kept |= {c[i:] for i in range(len(c) + 1)}

    def prob(history, s):
        c = next((history[i:] for i in range(len(history) + 1) if history[i:] in kept), None)
        return 1 / 256 if c is None else dist(c)[s]

    return kept, prob


def test_suffix_tree_by_definition_at_every_size(spark, monkeypatch):
    """A context is in the tree by its own counts, however much other text there is."""
    monkeypatch.setattr(suffix_lm, "block_count", lambda df, c: 5)
    rng = random.Random(8)
    rare = [(i, "zyxwv uyxwk ") for i in range(30)]
    mixed = [" ".join(rng.choice(["ab", "abc", "b", "Ca", "d\u00e9f", f"w{rng.randrange(300)}"]) for _ in range(400)) for _ in range(8)]
    for other in (0, 2400):  # no, or about 3 million other symbols
        rows = rare + [(1000 + i, mixed[i % 8]) for i in range(other)]
        train = [suffix_lm.spell(t) for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
        kept, prob = _tree_by_definition(train)
        assert b"zyxw" in kept
        got = {r.id: r for r in suffix_lm.score(docs_of(spark, rows), spell_weight=1.0).collect()}
        for i, t in rare[:8] + rows[30:2400:60]:
            s = suffix_lm.spell(t)
            h = b"\n" * 5 + s
            assert got[i].score == pytest.approx(sum(math.log10(prob(h[k:k + 5], s[k])) for k in range(len(s))), abs=1e-3), t


def test_suffix_tree_is_a_distribution(spark):
    """The probabilities of all symbols behind a history sum to one, whole and split endings alike,
    and splitting an ending changes no probability."""
    spelled = [suffix_lm.spell("abra cadabra zzz abra " * 40), suffix_lm.spell("dabra abracadabra " * 30)]
    seen, n = np.unique(suffix_lm.numbers(spelled, 5), return_counts=True)
    counted, times = suffix_lm._sums(seen & 0xFFFFFFFF, n)
    df = spark.createDataFrame([(int(g), int(c)) for g, c in zip(counted, times)], "gram bigint, n bigint")
    low = suffix_lm.learn_low(df, 5, 2, 5.0)
    assert len(low.hot)
    whole = suffix_lm.Low(low.levels, low.hot[:0], low.cells[:0], low.n[:0])
    for history in (b"\n\n\n\n\n", b"cadab", b" abra", b"zzzzz", b"\x00qqab", b"abra "):
        start = int.from_bytes(history, "big") << 8
        values = np.union1d(seen, start + np.arange(256))
        counts = np.zeros(len(values), np.int64)
        counts[np.searchsorted(values, seen)] = n
        p = suffix_lm.log10_grams(values, counts, low, 5, 2, 5.0)
        assert (10 ** p[values >> 8 == start >> 8]).sum() == pytest.approx(1), history
        assert np.array_equal(p, suffix_lm.log10_grams(values, counts, whole, 5, 2, 5.0))
        # a part alone: the grams with the same four bytes before the symbol
        part = (values >> 8) & 0xFFFFFFFF == (start >> 8) & 0xFFFFFFFF
        if np.isin(start >> 8 & 0xFFFFFF, low.hot):
            assert np.array_equal(p[part], suffix_lm.log10_grams(values[part], counts[part], low, 5, 2, 5.0))


def test_tokens_mix_share_and_spelling(spark):
    rows = [(i, t) for i, t in enumerate(["alpha beta", "beta beta gamma", "alpha delta", "beta"] * 6)]
    train = [suffix_lm.spell(t) for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    _, prob = _tree_by_definition(train)
    words = Counter(w for s in train for w in s.split())
    n_all = sum(words.values()) + len(train)
    got = {r.id: r.score for r in suffix_lm.score(docs_of(spark, rows)).collect()}
    for i, t in rows[:4]:
        s, want, spelling, word = suffix_lm.spell(t), 0.0, 1.0, b""
        h = b"\n" * 5 + s
        for k in range(len(s)):
            spelling *= prob(h[k:k + 5], s[k])
            if s[k] in b" \n":
                share = (len(train) if s[k] == 10 else words[word]) / n_all
                want += math.log10(0.15 * share + 0.85 * spelling)
                spelling, word = 1.0, b""
            else:
                word += s[k:k + 1]
        assert got[i] == pytest.approx(want, abs=1e-3), t


def test_memo_is_told_by_its_vocabulary():
    one, two = bpe.Bpe([bytes([i]) for i in range(256)] + [b"ab"], "x"), bpe.Bpe([bytes([i]) for i in range(256)] + [b"bc"], "x")
    assert bpe._Memo.of(one)["ab"] != bpe._Memo.of(two)["ab"]
    assert bpe._Memo.of(bpe.Bpe(two.vocabulary, "x")) is bpe._Memo.of(two)


# --- 4: n-gram join ----------------------------------------------------------------------------


def _near(rows, percent, k):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i:i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set())
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                a, b = comp[i], comp[j]
                comp = [b if x == a else x for x in comp]
    return sets, [min(rows[j][0] for j in range(len(rows)) if comp[j] == comp[i]) for i in range(len(rows))]


@pytest.mark.parametrize("percent, k", [(85, 4), (80, 5)])
def test_ngram_join_by_brute_force(spark, percent, k):
    rng = random.Random(6)
    rows, base = [], [[f"w{rng.randrange(4000)}" for _ in range(rng.randrange(3, 120))] for _ in range(12)]
    common = [f"c{i}" for i in range(25)]
    for i in range(260):
        w = list(base[0] if rng.random() < 0.4 else rng.choice(base))  # one large group
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(4000)}"
        if rng.random() < 0.2:
            w = common + w[:rng.randrange(40)]
        rows.append((i * 3 + 1, " ".join(w).upper() if rng.random() < 0.1 else "  ".join(w)))
    rows += [(2, None), (5, ""), (8, "\n"), (11, "two words"), (14, "two  WORDS"), (17, "one")]
    sets, comp = _near(rows, percent, k)
    want = sorted((r[0], len(s), c) for r, s, c in zip(rows, sets, comp))
    docs = docs_of(spark, rows)
    got = ngram_join.near_duplicates(docs, percent, k)
    assert sorted((r.id, r.n_shingles, r.component_id) for r in got.collect()) == want
    kept = ngram_join.keep_one(docs, percent, k)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _, c in want if i == c)


def test_word_hashes_are_those_of_the_words(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abAB \t\x1c\u00e9") for _ in range(300)) for _ in range(40)] + [
        "", " \n", "x" * 70_000, "Ab" * 16_384 + " q", " " * 32_767 + "zz y", ODD[4][1]]
    whole = [word_hashes(t) for t in texts]
    number, word = {}, {}
    for text, h in zip(texts, whole):
        words = ascii_lower_words(text)
        assert len(words) == len(h) == word_count(text)
        for w, x in zip(words, h.tolist()):
            assert number.setdefault(w, x) == x and word.setdefault(x, w) == w
    for piece in (1, 2, 7, 1000):  # words that lie over several pieces
        monkeypatch.setattr(common, "PIECE", piece)
        assert all((word_hashes(t) == h).all() for t, h in zip(texts, whole) if piece > 2 or len(t) < 400)


def test_keep_one_tells_unlike_texts_of_an_id_apart(spark):
    near = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, near), (1, other), (2, near + " x"), (3, other), (1, near), (5, None), (5, ""), (5, "  "), (None, near), (None, near)]
    want = sorted([(1, near), (1, other), (5, "  "), (None, near), (None, near)], key=str)
    for parts in (1, 4, 9):
        kept = ngram_join.keep_one(docs_of(spark, rows).repartition(parts), 80, 5)
        assert kept.columns == docs_of(spark, rows).columns
        assert sorted([(r.doc_id, r.text) for r in kept.collect() if r.text], key=str) == want
        assert kept.where("doc_id = 5").count() == 2  # null is the empty text


def test_ngram_join_edges(spark):
    got = ngram_join.near_duplicates(docs_of(spark, ODD))
    assert got.count() == len(ODD)
    assert {r.component_id for r in got.collect() if r.n_shingles == 1 and r.id in (None, 4)} == {4}
    kept = ngram_join.keep_one(docs_of(spark, ODD)).collect()
    assert Counter(r.doc_id for r in kept) == Counter([1, 2, 3, 4, 5, 6, 7, None])
    assert ngram_join.near_duplicates(docs_of(spark, [])).count() == 0


# --- 1 and 3: vectors --------------------------------------------------------------------------

VECS = "vec_id bigint, embedding array<float>, label int, id string, nid int, links int, score double"


def _vectors(spark, n=600, dim=16):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    x[100:260] = x[100] + 0.12 * rng.standard_normal((160, dim))  # one dense group
    x[300:340] = x[300]  # equal vectors
    x[340:345] = 2 * x[300]
    rows = [(int(i * 2), [float(v) for v in x[i]], int(i % 3 == 0)) for i in range(n)]
    rows += [(5001, None, 1), (5003, [0.0] * dim, 1), (5005, [float("nan")] * dim, 1), (5007, [None] * dim, 0),
             (5009, [float("inf")] + [1.0] * (dim - 1), 1), (5011, rows[0][1], None), (None, rows[0][1], 1), (5013, [1.0, 2.0], 1),
             (5015, [], 0)]
    return rows, spark.createDataFrame([(*r, "x", 1, 2, 3.0) for r in rows], VECS)


def _unit(rows):
    ok = [i for i, (v, e, _) in enumerate(rows) if v is not None and e and all(c is not None and math.isfinite(c) for c in e) and any(e)]
    return ok


def test_forest_by_brute_force(spark):
    rows, df = _vectors(spark)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:  # small batches: some hold points of one kind only
        spark.conf.set(size, "5")
        got = {(r.id, r.n_links, r.component_id, r.kept) for r in rp_forest.near_duplicates(df, leaf=64).collect()}
    finally:
        spark.conf.set(size, before)
    links = {i: set() for i in range(len(rows))}
    ok = [i for i in _unit(rows) if rows[i][2] is not None]
    for i in ok:
        for j in ok:
            a, b = np.array(rows[i][1]), np.array(rows[j][1])
            if i != j and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.93:
                links[i].add(j)
    want = set()
    for i, (v, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        want.add((v, len(links[i]), low, v is not None and v == low))
    assert got == want
    assert rp_forest.near_duplicates(df.limit(0)).count() == 0


def test_forest_splits_and_overlaps():
    x = rp_forest.unit(np.random.default_rng(1).standard_normal((3000, 16)))
    th = rp_forest.fit_subtree(x, 3000, 5, 0.2, 200)
    rows, places, _ = rp_forest.route(x, th, 5, 0.2)
    assert set(rows) == set(range(3000)) and len(rows) > 3000
    assert np.bincount(places).max() < 1000


def test_index_recall_and_ties(spark):
    rows, df = _vectors(spark)
    got = mih.nearest(df, F.col("id") % 20 == 0, block=128).collect()
    ok = [i for i in _unit(rows) if len(rows[i][1]) == 16]
    x = {rows[i][0]: np.array(rows[i][1]) for i in ok}
    hit = total = 0
    for q in [v for v in x if v % 20 == 0]:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        s = {v: float((x[v] * x[q]).sum()) for v in x if v != q}
        best = sorted(s, key=lambda v: (-s[v], v))[:20]
        assert [r.rank for r in mine] == list(range(1, 21))
        assert all(r.score == s[r.vec_id] for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        hit += len(set(best) & {r.vec_id for r in mine})
        total += 20
    assert hit / total >= 0.9
    few = mih.nearest(df.where("vec_id < 10"), F.col("id") % 20 == 0).collect()
    assert sorted(r.vec_id for r in few) == [2, 4, 6, 8]
    assert mih.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_pigeonhole():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 256, (500, 8), dtype=np.uint8)
    for radius in (0, 1, 3):
        index = mih.Index(codes, radius)
        q = codes[7] ^ np.array([1, 0, 3, 0, 0, 16, 0, 0], np.uint8)
        far = np.array([[bin(a ^ b).count("1") for a, b in zip(c, q)] for c in codes])
        assert sorted(index.probe(q)) == np.flatnonzero((far <= radius).any(1)).tolist()
        assert set(np.flatnonzero(far.sum(1) < 8 * (radius + 1))) <= set(index.probe(q))


def test_near_copies_never_share_a_bin(spark, tmp_path):
    rng = random.Random(10)
    rows = []
    for g in range(25):
        w = [f"w{rng.randrange(4000)}" for _ in range(60)]
        for j in range(4):  # one word or one mark apart
            w[j * 15] += rng.choice([",", "x"])
            rows.append((g * 4 + j, " ".join(w), f"s{g * 4 + j}"))
    rows += [(i, t, "z") for i, t in ODD if i != 5]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op2_best_fit_packing(spark, str(tmp_path)).where("bin is not null and doc_id < 100").collect()
    used = Counter((r.shard, r.bin, r.doc_id // 4) for r in out if r.n_words == 60)
    assert sum(used.values()) >= 96 and max(used.values()) == 1
    assert len({(r.shard, r.bin) for r in out}) < 10


# --- 6: main text of pages ---------------------------------------------------------------------


def test_html_blocks():
    page = html_main.Page("<body><article><h1>A &amp; B</h1><p>one<br>two <b>three</b>\n four<p>x&nbsp;y</p>"
                          "<script>var t='</p>';</script><!-- no --><ul><li>i<li>j</ul></article>")
    page.features()
    assert page.text([2] * len(page.tag)) == "A & B\none two three four\nx y\ni\nj"
    for broken in (None, "", "<", "<p", "text only", "<div><p>a</div>b</p>", "&am", "<a href='x", "<!-- open", "<script>x", "</p></p>"):
        p = html_main.Page(broken)
        assert len(p.features()) == len(p.tag)
        p.text([2] * len(p.tag))


@pytest.mark.parametrize("source, want", [
    ("<html><head><title>t</title><body><article><p>one</article>", "one"),
    ("<html><head><meta charset=x><title>t</title><style>x{}</style><article><p>one<p>two</article>", "one\ntwo"),
    ("<head><title>t</title>plain text", "plain text"),
    ("<head><title>t</title><script>x</script></head><body><p>one", "one"),
    ("<head><template><p>no</p></template><title>t</title><img src=x>one", "one"),
    ("<article><p>let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be</p></article>", "let x=2 be"),
    ("<article><p>see</p><xmp><b>x</b> &amp; y</xmp><p>end</p></article>", "see\n<b>x</b> &amp; y\nend"),
])
def test_html_open_head_math_and_xmp(source, want):
    page = html_main.Page(source)
    page.features()
    assert page.text([2] * len(page.tag)) == want


def test_html_roles_never_contradict():
    rng = np.random.default_rng(0)
    page = html_main.Page("<div><div><p>aa</p><div><p>bb</p><p>cc</p></div></div><ul><li>dd<li>ee</ul></div>" * 4)
    page.features()
    for _ in range(50):
        role = page.decode(rng.random(len(page.tag)))
        for i in range(1, len(role)):
            up = role[page.parent[i]]
            assert up != 1 or role[i] == 1
            assert up != 2 or role[i] != 0


def test_html_extraction(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    odd = spark.createDataFrame([(9001, "u", None), (9002, None, ""), (None, "u", "<p>x"), (9001, "u", None)], "page_id bigint, url string, html string")
    model = html_main.fit(pages)
    got = html_main.extract(pages.unionByName(odd).withColumn("text", F.lit(1)).withColumn("id", F.lit("q")), model).collect()
    assert len(got) == pages.count() + 4
    want = {}
    for r in pages.collect():
        inner = re.sub(r"<br>|</?b>", " ", re.search(r"<article>(.*?)</article>", r.html, re.S)[1])
        import html
        blocks = [" ".join(html.unescape(b).split()) for b in re.split(r"</?(?:h1|p)>", inner)]
        want[r.page_id] = "\n".join(b for b in blocks if b)
    right = np.mean([r.text == want[r.id] for r in got if r.id in want])
    assert right >= 0.98
    assert all(r.text == "" for r in got if r.id in (9001, 9002))


# --- 2: packing --------------------------------------------------------------------------------


def test_best_fit_by_brute_force():
    rng = random.Random(8)
    for _ in range(60):
        bins, plain = packing.Bins(50, 2), []  # plain: (free, sources, clusters) of each bin
        for _ in range(rng.randrange(80)):
            size, src, clu = rng.randrange(1, 51), rng.choice([-1, 0, 0, 0, 1, 2]), rng.choice([-1, -1, 0, 1])
            fits = [(b[0], k) for k, b in enumerate(plain) if b[0] >= size and (src < 0 or b[1].count(src) < 2)
                    and (clu < 0 or clu not in b[2])]
            k = min(fits)[1] if fits else len(plain)
            if k == len(plain):
                plain.append([50, [], set()])
            assert bins.place(size, src, clu) == (k, 50 - plain[k][0])
            plain[k][0] -= size
            plain[k][1].append(src)
            plain[k][2].add(clu)


def test_packing_rows(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w%d" % rng.randrange(50)] * rng.randrange(1, 90)), rng.choice(["a", "a", "b", None])) for i in range(300)]
    rows += [(i, t, "z") for i, t in ODD if i != 5]
    out = packing.pack(docs_of(spark, rows), capacity=64, shard_rows=100).collect()
    words = Counter()
    for i, t, _ in rows:
        words[i] += len((t or "").encode().split())
    got, used = Counter(), Counter()
    for r in out:
        got[r.id] += r.n_words
        if r.bin is None:
            assert r.n_words == 0
            continue
        used[(r.shard, r.bin)] += r.n_words
        assert 0 <= r.bin_offset and r.bin_offset + r.n_words <= 64
    assert got == words and max(used.values()) <= 64
    places = sorted((r.shard, r.bin, r.bin_offset, r.n_words) for r in out if r.bin is not None)
    assert all(a[:2] != b[:2] or a[2] + a[3] == b[2] for a, b in zip(places, places[1:]))
    assert packing.pack(docs_of(spark, [])).count() == 0


def test_maximal_segments_in_linear_time():
    import time

    # places ten tokens apart that never merge: each search must not walk over all before
    t0 = time.perf_counter()
    got = toxicity.maximal_segments(((10 * i, 2.0) for i in range(1_000_000)), drift=-0.5)
    assert len(got) == 1_000_000 and time.perf_counter() - t0 < 30
    rng = random.Random(3)
    for _ in range(300):
        scores = [(i, rng.choice([-3, -1, 1, 2, 0.5])) for i in range(rng.randrange(40)) if rng.random() < 0.7]
        drift = rng.choice([0.0, -0.25, -1.0])
        dense = [drift] * (scores[-1][0] + 1) if scores else []
        for at, s in scores:
            dense[at] = s
        sums = [0.0]
        for d in dense:
            sums.append(sums[-1] + d)
        # by definition: positive runs whose every prefix and suffix is positive, not inside a larger one
        runs = [(a, b) for a in range(len(dense)) for b in range(a + 1, len(dense) + 1)
                if all(sums[m] > sums[a] and sums[b] > sums[m] for m in range(a + 1, b)) and sums[b] > sums[a]]
        best = [(a, b, sums[b] - sums[a]) for a, b in runs if not any(x <= a and b <= y and (x, y) != (a, b) for x, y in runs)]
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(scores, drift)] == [(a, b) for a, b, _ in best]


def test_license_expressions_decide():
    a = licenses.automaton()
    either, both = (licenses.scan_text(a, f"SPDX-License-Identifier: MIT {op} GPL-3.0") for op in ("OR", "AND"))
    # ..., labels, score, expressions, in force, restrictiveness, spans
    assert either[5] == both[5] == "gpl,mit" and either[6] < both[6]
    assert (either[8], either[9]) == ("", 1) and (both[8], both[9]) == ("gpl,mit", 3)
    assert licenses.scan_text(a, "SPDX-License-Identifier: see LICENSE file")[5:7] == ("", 0.0)
    assert licenses.scan_text(a, " * SPDX-License-Identifier:\n *  Apache-2.0 WITH LLVM-exception\n")[5] == "apache"
    assert licenses.scan_text(a, "SPDX-License-Identifier: LicenseRef-own")[5] == "licenseref-own"
    assert licenses.scan_text(a, "Nothing here")[8:10] == ("", None)


@pytest.mark.parametrize("kind", ["audio", "canvas", "video", "svg", "iframe"])
def test_html_open_silent_element_ends_with_its_block(kind):
    for html in (f"<article><p>one <{kind} src=x><p>two<p>three</article>", f"<ul><li>one<{kind}><li>two<li>three</ul>"):
        if kind == "iframe":  # its content is raw text to its end tag
            html = html.replace("<iframe", "</iframe><iframe").replace("<p>two", "</iframe><p>two").replace("<li>two", "</iframe><li>two")
        got = "".join(p[2] for p in html_main.Page(html).pieces)
        assert all(w in got for w in ("one", "two", "three")), (kind, html, got)


def test_html_map_is_shown():
    assert "link text" in "".join(p[2] for p in html_main.Page("a<map><a>link text</a></map> b").pieces)
