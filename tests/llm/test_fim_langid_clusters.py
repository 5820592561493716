"""Fill-in-middle, language identification and centroid clustering against plain versions, and their edge cases."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserae.llm import dualtree, fim, langid

DOCS = "doc_id long, text string, lang string, n long, c string, spans string"


def docs(spark, rows):
    """Rows of (doc_id, text, lang) with extra columns whose names clash with those the operators use."""
    return spark.createDataFrame([(i, t, lang, 1, "c", "s") for i, t, lang in rows], DOCS)


# fill in the middle


def plain_fim(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


FIM = [(i, "".join(random.Random(i).choices("ab <>PSM/é€😀\n", k=i % 40)), None) for i in range(200)]
FIM += [(None, "no id", None), (5, None, None), (6, "", None), (7, "x" * 70_000 + "é€😀" * 60_000, None), (7, "x" * 70_000 + "é€😀" * 60_000, None), (8, "a <M> mark", None), (9, "😀", None)]


def test_fim_equals_slices(spark):
    got = fim.transform(docs(spark, FIM))
    both = got.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in both), key=key) == sorted((plain_fim(i, t) for i, t, _ in FIM), key=key)
    assert all(r.back == r.text for r in both)
    assert {r.form for r in both} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs(spark, [])).count() == 0


@pytest.mark.parametrize("unit, split", [("code point", list), ("word", None), ("line", lambda t: t.splitlines(keepends=True))])
@pytest.mark.parametrize("size", [1, 2, 3, 7, 64])
def test_cuts_at_any_size_of_chunks(unit, split, size):
    rng = random.Random(size)
    texts = ["".join(rng.choices("ab é€😀\n", k=rng.randrange(30))) for _ in range(100)]
    raw = [t.encode() for t in texts]
    end = np.cumsum([len(r) for r in raw])
    first, second = np.array([rng.randrange(1 << 32) for _ in texts]), np.array([rng.randrange(1 << 32) for _ in texts])
    got = fim.cut(np.frombuffer(b"".join(raw), np.uint8), end - [len(r) for r in raw], end, first, second, fim.UNITS[unit], size)
    for t, r, f, s, n, lo, hi, at, to in zip(texts, raw, first, second, *got):
        if split:
            units = split(t)
        else:  # words with the white space behind them
            units = []
            for c in t:
                if units and not (units[-1][-1].isspace() and not c.isspace()):
                    units[-1] += c
                else:
                    units.append(c)
        assert n == len(units) and (lo, hi) == tuple(sorted((f % (n + 1), s % (n + 1))))
        assert r[:at].decode() == "".join(units[:lo]) and r[:to].decode() == "".join(units[:hi])


# languages


def plain_best(scores):
    """The best sum of scores less switches over all labellings, by plain dynamic programming."""
    v = [0.0] * len(scores[0])
    for e in scores:
        v = [max(v[j], max(v) - langid.SWITCH) + e[j] for j in range(len(e))]
    return max(v)


def worth(labels, scores):
    return sum(e[j] for j, e in zip(labels, scores)) - langid.SWITCH * sum(a != b for a, b in itertools.pairwise(labels))


@pytest.mark.parametrize("k", [1, 2, 5])
def test_viterbi_finds_the_best_labels(k):
    rng = np.random.default_rng(k)
    score = rng.normal(0, 4, (50, k))
    count = np.array([0, 1, 63, 64, 65, 128, 129, 700, 0, 2, 3])
    at = rng.integers(0, 50, count.sum())
    got = langid.viterbi(at, count, score)
    assert len(got) == count.sum()
    for lo, n in zip(np.cumsum(count) - count, count):
        if n:
            one = score[at[lo : lo + n]]
            assert math.isclose(worth(got[lo : lo + n], one), plain_best(one), abs_tol=1e-6)


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(3)
    for _ in range(20):
        score = rng.normal(0, 5, (5, 3))
        got = langid.viterbi(np.arange(5), np.array([5]), score)
        assert math.isclose(worth(got, score), max(worth(x, score) for x in itertools.product(range(3), repeat=5)), abs_tol=1e-9)


def plain_grams(word):
    """The letter runs' n-grams with at most one end each."""
    out = []
    for n in langid.ORDERS:
        marked = "\0" + "".join(c if c.isalpha() else "\0" for c in word) + "\0"
        for i in range(len(marked) - n + 1):
            g = marked[i : i + n]
            ends = g.count("\0")
            if ends == 0 or (ends == 1 and n > 1 and "\0" in (g[0], g[-1])):
                out.append(g)
    return out


def test_grams_are_those_of_each_word():
    words = ["the", "don't", "—", "étéß", "a", "x1y", "日本語", "...ab..", "", "мир", "ab"]
    which, bucket, count, script = langid.grams(words)
    assert Counter(which.tolist()) == Counter(i for i, w in enumerate(words) for _ in plain_grams(w))
    assert count.tolist() == [sum(c.isalpha() for c in w) for w in words]
    names = ["", *(n for n, _ in langid.SCRIPTS)]
    assert [names[s] if s != 255 else None for s in script] == ["Latin", "Latin", None, "Latin", "Latin", "Latin", "Han", "Latin", None, "Cyrillic", "Latin"]
    by = lambda n: sorted(bucket[which == n].tolist())
    alone = langid.grams(["ab"])
    assert by(10) == sorted(alone[1].tolist())
    assert by(7) == by(10)  # marks around a word change nothing


def test_counts_are_those_of_all_training_documents(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat", "en"), ("le chat", "fr"), ("the dog the", "en"), (None, "en"), ("nichts", None), ("мир", "ru")] * 5)]
    m = langid.train(docs(spark, rows))
    want = np.zeros((3, langid.BUCKETS + 256), np.int64)
    for i, t, lang in rows:
        if lang and zlib.crc32(str(i).encode()) % 3 != 1:
            for w in (t or "").split():
                _, bucket, count, script = langid.grams([w])
                row = want[["en", "fr", "ru"].index(lang)]
                row += np.bincount(bucket, minlength=len(row))
                row[langid.BUCKETS + int(script[0])] += count[0]
    plain = langid.model(["en", "fr", "ru"], want)
    assert m["languages"] == plain["languages"] and np.allclose(m["table"], plain["table"]) and (m["writes"] == plain["writes"]).all()


EN, FR = "the quick brown fox jumps over the lazy dog and then runs away with it ".split(), "le renard brun saute vite par dessus le chien paresseux et puis il part avec lui ".split()
RU = "быстрая лиса прыгает через ленивую собаку и потом убегает".split()


def test_spans_and_edges(spark):
    rng = random.Random(4)
    say = lambda words, n: " ".join(rng.choices(words, k=n))
    rows = [(i, say(w, 30), lang) for i in range(60) for w, lang in [((EN, "en"), (FR, "fr"), (RU, "ru"))[i % 3]]]
    m = langid.train(docs(spark, rows))
    mixed = " ".join(EN * 4 + FR * 3 + RU * 5)
    odd = [(100, mixed, None), (101, None, None), (102, "", None), (103, " \n 123 ... ", None), (None, "the dog", None), (104, "собака", None), (104, "собака", None), (105, " ".join(EN * 20_000), None), (106, "日本", None), (107, "x" * 3_000_000, None)]
    got = {}
    for r in langid.spans(docs(spark, odd), m).collect():
        got.setdefault(r.doc_id, []).append(r)
    one = got[100][0]
    assert [(s.lang, s.words) for s in one.spans] == [("en", len(EN) * 4), ("fr", len(FR) * 3), ("ru", len(RU) * 5)]
    letters = {n: sum(map(len, w)) * k for n, w, k in (("en", EN, 4), ("fr", FR, 3), ("ru", RU, 5))}
    assert one.lang_pred == max(letters, key=letters.get) and math.isclose(one.score, max(letters.values()) / sum(letters.values()))
    assert all((got[i][0].lang_pred, got[i][0].score) == ("und", 0.0) for i in (101, 102, 103))
    assert got[None][0].lang_pred == "en" and [r.lang_pred for r in got[104]] == ["ru", "ru"] and got[105][0].lang_pred == "en"
    assert got[106][0].lang_pred in m["languages"] and got[107][0].lang_pred in m["languages"]
    for rows in ([], [(1, "text", None)]):  # nothing to learn from
        assert [(r.lang_pred, r.score) for r in langid.identify(docs(spark, rows)).collect()] == [("und", 0.0)] * len(rows)


def test_held_out_accuracy(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = langid.identify(d)
    r = got.join(d.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert r[1] > 20 and r[0] > 0.95
    assert got.count() == d.count()


def test_a_small_lexicon_gives_the_same(spark, sf_dir, monkeypatch):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = lambda: sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.identify(d).collect())
    want = rows()
    monkeypatch.setattr(langid, "WORDS_KEPT", 400)
    monkeypatch.setattr(langid, "PIECE", 300)
    assert rows() == want


# clusters


def plain_lloyd(rows, rounds=10):
    v = [(i, [math.floor(1024 * float(x)) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    first = sorted(v, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:8]
    c = [list(x) for _, x in first]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, y)), n) for n, y in enumerate(c))
    for _ in range(rounds):
        of = [near(x)[1] for _, x in v]
        c = [[sum(col) // len(g) for col in zip(*g)] if (g := [x for (_, x), n in zip(v, of) if n == k]) else c[k] for k in range(len(c))]
    got = [(i, *near(x)) for i, x in v]
    own = Counter()
    for _, d, n in got:
        own[n] += d
    return sorted((i is None, i or 0, n, d, own[n], sum(own.values()), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for i, d, n in got)


def clustered(df):
    return sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in dualtree.cluster(df).collect())


VECS = "vec_id long, embedding array<double>, label int, v string, pivot string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, 0, "v", "p") for i, e in rows], VECS)


@pytest.mark.parametrize("kind", ["spread", "tight", "ties"])
def test_clusters_equal_plain_lloyd(spark, kind, monkeypatch):
    monkeypatch.setattr(dualtree, "BLOCK", 60)
    monkeypatch.setattr(dualtree, "LEAF", 4)
    rng = np.random.default_rng(7)
    if kind == "spread":
        x = rng.normal(0, 1, (150, 64))
    elif kind == "tight":
        x = np.repeat(rng.normal(0, 1, (12, 64)), 15, 0) + rng.normal(0, 0.003, (180, 64))
        x[50:90] = x[50]
    else:
        x = rng.integers(0, 2, (150, 64)) / 1024 * (np.arange(64) < 5)
    rows = [(i, e.tolist()) for i, e in enumerate(x)]
    assert clustered(vectors(spark, rows)) == plain_lloyd(rows)


def test_cluster_edges(spark):
    one = [0.5] * 64
    rows = [(1, None), (2, []), (3, [1.0] * 63), (4, [None, *[1.0] * 63]), (5, [math.nan, *[1.0] * 63]), (6, [math.inf, *[1.0] * 63]), (7, one), (7, one), (None, [-0.0004] * 64), (8, [1e5] * 64), (8, [-1e5] * 64)]
    assert clustered(vectors(spark, rows)) == plain_lloyd(rows)
    assert clustered(vectors(spark, rows[:6])) == [] == clustered(vectors(spark, []))
    with pytest.raises(Exception, match="131072 or more"):
        dualtree.cluster(vectors(spark, [(1, [2.0**17] * 64)])).count()


def test_cover_tree_holds_its_promises():
    rng = np.random.default_rng(5)
    v = np.concatenate([np.repeat(rng.integers(-900, 900, (9, 64)), 40, 0) + rng.integers(-3, 4, (360, 64)), np.zeros((50, 64), np.int64)])
    order, t = dualtree.cover_tree(v)
    w = v[order]
    assert sorted(order) == list(range(len(v)))
    inner = 0
    for i in range(len(t["begin"])):
        lo, hi = t["begin"][i], t["end"][i]
        d = np.sqrt(((w[lo:hi] - w[lo]) ** 2).sum(1))
        assert math.isclose(t["radius"][i], d.max())
        kids = range(t["kids"][i], t["kids_end"][i])
        if len(kids):
            inner += 1
            half = 2.0 ** (math.ceil(math.log2(t["radius"][i])) - 1)
            points = w[[t["begin"][k] for k in kids]]
            assert t["begin"][kids[0]] == lo and t["end"][kids[-1]] == hi  # a node is its own first child, and children share out its rows
            assert all(t["radius"][k] <= half for k in kids)
            gaps = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
            assert (gaps[~np.eye(len(points), dtype=bool)] > half).all()
    assert inner > 0


def test_whole_nodes_are_pruned(monkeypatch):
    """Most vectors of tight groups are assigned without a comparison of their own."""
    rng = np.random.default_rng(6)
    v = np.repeat(rng.integers(-900, 900, (9, 64)), 40, 0) + rng.integers(-3, 4, (360, 64))
    order, t = dualtree.cover_tree(v)
    w, compared = v[order], []
    real = dualtree.squared
    tree = dualtree.CentroidTree(v[[0, 45, 90, 135, 180, 225, 270, 315]])
    monkeypatch.setattr(dualtree, "squared", lambda a, b: compared.append(len(a)) or real(a, b))
    got = np.full(len(v), -1)
    for rows, c in dualtree.assign(w, t, tree):
        assert (got[rows] == -1).all()
        got[rows] = c
    assert (got == real(w, tree.centroids).argmin(1)).all() and sum(compared) < 60


def test_large_components_are_exact():
    rng = np.random.default_rng(8)
    a, b = rng.integers(-(1 << 27), 1 << 27, (20, 64)), rng.integers(-(1 << 27), 1 << 27, (5, 64))
    want = [[sum((int(x) - int(y)) ** 2 for x, y in zip(p, q)) for q in b] for p in a]
    assert dualtree.squared(a, b).tolist() == want


def test_invalid_bytes_are_replaced():
    lexicon = langid.Lexicon(10)
    raw = pa.array([b"ab \xff\xfe cd"], pa.binary()).view(pa.string())
    at, count = lexicon.numbers(raw)
    assert count.tolist() == [3] and lexicon.names[0] == "ab"
