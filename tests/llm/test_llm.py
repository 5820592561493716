"""The training-data operators against brute force, round trips and held-out accuracy, and their edge cases."""

from __future__ import annotations

import base64
import collections
import gzip
import hashlib
import itertools
import math
import os
import random
import re
import types
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import _labelled, _subwords, capfilters, exact, lm, mixing, packing, quality, simhash, substring, toxicity, warc
from tesserae.llm._shared import Scratch, connected_components
from tesserae.llm._subwords import DEFAULT, tokenizer

DOCS = "doc_id long, text string, source string, fp string, n long"


def docs(spark, rows):
    """Rows of (doc_id, text) with extra columns whose names clash with those the operators use."""
    return spark.createDataFrame([(i, t, "s", "x", 1) for i, t in rows], DOCS)


LONG = " ".join(f"word{i % 997}" for i in range(60_000))
ODD = [(1, None), (2, ""), (3, "one"), (4, "two words"), (5, LONG), (6, "Same  text\there"), (7, "same text here"), (8, "SAME TEXT HERE\n"), (9, " \t\n"), (10, "a b c d e f g"), (10, "a b c d e f g"), (None, "no id")]


def components(nodes, linked):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, x) for x in range(400, 500)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    ends = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in components({x for e in edges for x in e}, edges).items() if k in ends}
    assert connected_components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


def test_simhash_by_hand():
    import xxhash

    text = "The quick brown fox\njumps over  the lazy dog"
    w = text.lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), seed=42) for i in range(len(w) - 2)]
    want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("A b") == xxhash.xxh64_intdigest("a b", seed=42) and simhash.fingerprint(" ") == simhash.fingerprint(None) == 0


def test_simhash_fingerprints_are_the_engine_hash(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b"))).first()[0] % (1 << 64) == simhash.fingerprint("a b")


@pytest.mark.parametrize("hot", [64, 2])
def test_simhash_links_are_all_links(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_KEY", hot)
    rng = random.Random(2)
    fps = set()
    for _ in range(12):
        seed = rng.getrandbits(64)
        fps.add(seed)
        for _ in range(12):
            fps.add(seed ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
        for _ in range(6):  # a crowd that shares a segment
            fps.add(seed ^ sum(1 << b for b in rng.sample(range(8), rng.randint(1, 4))))
    fps = sorted(fps)
    df = spark.createDataFrame([((f + (1 << 63)) % (1 << 64) - (1 << 63), i) for i, f in enumerate(fps)], "fp long, rep long")
    got = {tuple(sorted((r.u, r.v))) for r in simhash.links(df, Scratch(spark, "t")).collect()}
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(fps), 2) if (a ^ b).bit_count() <= 3}
    assert got == want


def test_simhash_on_documents(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = simhash.near_duplicates(d).collect()
    fp = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    assert fp == {r.doc_id: simhash.fingerprint(r.text) for r in d.collect()}
    want = components(fp, [(a, b) for a, b in itertools.combinations(fp, 2) if (fp[a] ^ fp[b]).bit_count() <= 3])
    assert {r.doc_id: r.component_id for r in rows} == want
    assert sorted(r.doc_id for r in simhash.keep_one(d).collect()) == sorted(set(want.values()))


def test_simhash_odd_rows(spark):
    rows = simhash.near_duplicates(docs(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[1].component_id == by[2].component_id == by[9].component_id == 1 and by[1].fingerprint == "0" * 16
    assert by[6].component_id == by[7].component_id == by[8].component_id == 6
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_simhash_keeps_one_row_without_an_id(spark):
    kept = simhash.keep_one(docs(spark, ODD))
    assert kept.columns == ["doc_id", "text", "source", "fp", "n"]
    assert sorted({r.doc_id or 0 for r in kept.collect()}) == [0, 1, 3, 4, 5, 6, 10]
    more = [*ODD, (None, "no id"), (None, "NO  id"), (None, "one"), (None, "other words without any id here")]
    rows = simhash.keep_one(docs(spark, more)).collect()
    assert sorted(" ".join(r.text.lower().split()) for r in rows if r.doc_id is None) == ["no id", "other words without any id here"]
    assert simhash.keep_one(docs(spark, [])).count() == 0


CLASH = ["best", "_w", "sha", "points", "maybe", "key", "other", "word", "set", "h", "id", "hash", "times", "_id", "_times", "copies", "rows", "spans", "fp", "n", "code", "row"]


def clashing(spark, rows):
    """Rows of (doc_id, text, source) among columns of every name that an operator might use."""
    df = docs(spark, rows)
    return df.select("doc_id", "text", "source", *(F.lit("c").alias(c) for c in CLASH))


def test_columns_of_any_name_pass_through(spark):
    d = clashing(spark, ODD)
    labels = spark.createDataFrame([(3, 0), (4, 0)], "doc_id long, toxic int")
    for out in (exact.keep_best(d), simhash.keep_one(d), mixing.mixed_rows(d, repeats=2.0), substring.without_repeats(d), toxicity.clean_rows(d, labels)):
        assert out.columns == d.columns and out.count() > 0
        assert out.select(*CLASH).distinct().count() == 1


def test_least_id(spark):
    low = -(1 << 63)
    rows = [(low, "same text"), (5, "same text"), (None, "same text"), (7, "else")]
    got = {(r.doc_id, r.keep_id, r.kept) for r in exact.duplicates(docs(spark, rows)).collect()}
    assert got == {(low, low, True), (5, low, False), (None, low, False), (7, 7, True)}
    assert sorted(r.doc_id for r in exact.keep_best(docs(spark, rows)).collect()) == [low, 7]


def test_repeated_ids_are_told_apart(spark):
    rows = [(3, "one two three four five six"), (10, "one two three four  five six"), (10, "quite other words that link with nothing here"), (10, "quite other words that link with nothing here")]
    kept = simhash.keep_one(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.text[:5]) for r in kept) == [(3, "one t"), (10, "quite")]


def test_exact_odd_rows(spark):
    got = {}
    rows = exact.duplicates(docs(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        got[r.doc_id] = (r.keep_id, r.group_size, r.kept)
    assert got[1] == (9, 3, False) and got[9] == (9, 3, True)  # most code points stay
    assert got[6] == (6, 1, True) and got[10] == (10, 2, True) and got[None] == (None, 1, True)
    kept = exact.keep_best(docs(spark, ODD))
    assert kept.columns == ["doc_id", "text", "source", "fp", "n"]
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 4, 5, 6, 7, 8, 9, 10]
    assert exact.duplicates(docs(spark, [])).count() == 0 and exact.keep_best(docs(spark, [])).count() == 0


def test_exact_is_right_with_a_full_filter(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(exact, "BITS_PER_ROW", 1)
    monkeypatch.setattr(exact, "BROADCAST_WORDS", 4)  # several parts
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    groups = collections.defaultdict(list)
    for r in d.collect():
        groups[re.sub("[\x20\x09-\x0d]", "", r.text or "")].append((-len(r.text or ""), r.doc_id))
    want = {i: (min(v)[1], len(v), hashlib.sha256(k.encode()).hexdigest()) for k, v in groups.items() for _, i in v}
    assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in exact.duplicates(d).collect()} == want


@pytest.mark.parametrize("words, groups", [(1 << 22, 1 << 20), (3, 2)])
def test_exact_in_parts_keeps_the_same_rows(spark, monkeypatch, words, groups):
    """One text has a third of all rows; winners that occur twice stay once, with all their columns."""
    monkeypatch.setattr(exact, "BROADCAST_WORDS", words)
    monkeypatch.setattr(exact, "BROADCAST_GROUPS", groups)
    rows = [(i, f"text number {i % 90}" + " " * (i % 7)) for i in range(200)] + [(1000 + i, "hot text") for i in range(120)]
    rows += [(7, "text number 7 " + " " * 9)] * 2 + [(None, "no id"), (None, "no id"), (500, None), (501, " \t")]
    best = {}
    for i, t in rows:
        key = re.sub("[\x20\x09-\x0d]", "", t or "")
        best[key] = min(best.get(key, (0, True, 0)), (-len(t or ""), i is None, i or 0))
    d = clashing(spark, rows)
    out = exact.keep_best(d)
    assert out.columns == d.columns
    got = sorted((-len(r.text or ""), r.doc_id is None, r.doc_id or 0) for r in out.collect())
    assert got == sorted(best.values())


def test_exact_keeps_texts_out_of_shuffles(spark, sf_dir):
    out = exact.keep_best(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().explainString(out._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def _words(text):
    return (text or "").encode().lower().split()


def _windows(text, n):
    w = _words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_repeats_find_every_shared_window(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r.doc_id: r.text for r in d.collect()}
    rows = substring.repeats(d).collect()
    owners = collections.defaultdict(set)
    for i, t in text.items():
        for w in _windows(t, substring.WINDOW):
            owners[w].add(i)
    want = {i for own in owners.values() if len(own) > 1 for i in own}
    assert want and want <= {r.doc_id for r in rows}
    for r in rows:  # every row has a partner of at least the similarity
        assert 28 <= r.words <= 50 and len(_words(text[r.doc_id][r.start : r.start + r.length])) == r.words
    group = collections.defaultdict(list)
    for r in rows:
        group[r.component_id].append(r)
    for own in group.values():
        assert len(own) == own[0].group_size > 1 and any(r.kept for r in own)
        first = min((r.doc_id, r.start) for r in own)
        assert {(r.keep_doc_id, r.keep_start) for r in own} == {first}
        sets = [_windows(text[r.doc_id][r.start : r.start + r.length], 5) for r in own]
        low = components(range(len(own)), [(a, b) for (a, x), (b, y) in itertools.combinations(enumerate(sets), 2) if len(x & y) >= 0.8 * len(x | y)])
        assert set(low.values()) == {0}


def test_repeats_are_the_similar_paragraphs(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 80")
    text = {r.doc_id: r.text for r in d.collect()}
    paras = [(r.doc_id, s, n) for r in substring.paragraphs(d).collect() for s, n in zip(r.start, r.length)]
    sets = [frozenset(_windows(text[i][s : s + n], 5)) for i, s, n in paras]
    linked = [(a, b) for (a, x), (b, y) in itertools.combinations(enumerate(sets), 2) if len(x & y) >= 0.8 * len(x | y)]
    low = components(range(len(paras)), linked)
    members = collections.defaultdict(list)
    for k, v in low.items():
        members[v].append(paras[k])
    want = {p for own in members.values() if len({i for i, _, _ in own}) > 1 or max(s for _, s, _ in own) >= min(s + n for _, s, n in own) for p in own}
    got = {(r.doc_id, r.start, r.length) for r in substring.repeats(d).collect()}
    assert got <= want and len(got) >= 0.98 * len(want) > 0


def test_repeats_wherever_lines_break(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(5))
    rows, passage = [], [word() for _ in range(51)]
    for i in range(60):
        own = [word() for _ in range(rng.randint(0, 90))]
        at = rng.randint(0, len(own))
        text = own[:at] + [w.upper() if i % 3 else w for w in passage] + own[at:]
        rows.append((i, "".join(w + rng.choice([" ", "\n", " \t "]) for w in text)))
    clean = [(100 + i, " ".join(word() for _ in range(400)) + " one line of ten words that is in many of them " + " ".join(word() for _ in range(100))) for i in range(60)]
    got = substring.repeats(docs(spark, rows + clean)).collect()
    assert {r.doc_id for r in got} == set(range(60))
    left = {r.doc_id: r.text for r in substring.without_repeats(docs(spark, rows + clean)).collect()}
    assert all(left[i] == t for i, t in clean) and left[0] == rows[0][1]
    assert all(len(_words(t)) - len(_words(left[i])) >= 28 for i, t in rows[1:])


def test_own_overlaps_are_no_repeats(spark):
    rng = random.Random(5)
    once = [(i, " ".join(f"w{rng.randint(0, 10**9)}" for _ in range(3000))) for i in range(5)]
    assert substring.repeats(docs(spark, once)).count() == 0
    twice = once[0][1] + " and again " + once[0][1]
    rows = substring.repeats(docs(spark, [(7, twice)])).collect()
    assert rows and {r.kept for r in rows} == {True, False} and min(r.start for r in rows if not r.kept) > len(once[0][1]) - 300


@pytest.mark.parametrize("block", [512, 7])
def test_repeats_in_a_crowded_bucket(spark, monkeypatch, block):
    monkeypatch.setattr(substring, "PAIRED", 4)
    monkeypatch.setattr(substring, "BUCKET_BLOCK", block)
    base = [f"w{i}" for i in range(48)]
    rows = [(i, "  ".join([*base[:-1], f"x{i}"])) for i in range(40)] + [(100 + i, " ".join(f"z{i}{j}" for j in range(30))) for i in range(5)]
    got = substring.repeats(docs(spark, rows)).collect()
    assert {r.doc_id for r in got} == set(range(40)) and {r.keep_doc_id for r in got} == {0}


def test_long_texts_are_hashed_in_parts(monkeypatch):
    text = ("éa B\tc\u00a0d " * 3000).encode()
    whole = substring.words(text)
    monkeypatch.setattr(substring, "CHUNK", 1000)
    assert all((a == b).all() for a, b in zip(whole, substring.words(text)))
    w = np.random.default_rng(1).integers(0, 1 << 62, 5000).astype(np.uint64)
    first = substring.paragraphs_of(w, np.array([5000]))[0]
    monkeypatch.setattr(substring, "BLOCK", 77)
    assert (substring.paragraphs_of(w, np.array([5000]))[0] == first).all()


def test_repeats_odd_rows(spark):
    short = " ".join(f"w{i}" for i in range(28))
    rows = [*ODD, (20, short), (20, short), (None, short + " x"), (21, " ".join(f"v{i}" for i in range(27))), (22, " ".join(f"v{i}" for i in range(27)))]
    got = substring.repeats(docs(spark, rows)).where("doc_id is null or doc_id <> 5").collect()
    assert [r.doc_id for r in got].count(20) == 2 and {r.doc_id for r in got} == {20, None} and all(r.group_size == 3 for r in got)
    assert substring.repeats(docs(spark, [])).count() == 0
    clash = docs(spark, rows).withColumnsRenamed({"source": "spans", "fp": "hash"})
    left = substring.without_repeats(clash)
    assert left.columns == clash.columns and left.count() == len(rows)
    assert sorted(r.text == "" for r in left.where("doc_id = 20").collect()) == [True, True]  # the row without an id keeps it


def _pages():
    return [(1, "http://a/ b", "<p>é</p>\r\n\r\nWARC/1.1\r\n"), (2, None, None), (3, "u", ""), (4, "u", "same"), (9, "u", "same"), (5, "u", "same"), (None, "u", "other"), (11, "u", "x" * 200_000), (12, "u", "\x00 ")]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(_pages(), "page_id long, url string, html string").withColumn("refers_to", F.lit("clash"))
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    last = {"same": 9, "": 3}
    for i, _, html in _pages():
        data = (html or "").encode()
        first = last.get(html or "", i)
        want = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first == i else "revisit", None if first == i else first)
        assert got[i] == want, i
    assert warc.round_trip(pages.where("false")).count() == 0


def test_warc_payloads_come_back(spark, tmp_path):
    pages = spark.createDataFrame(_pages(), "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"), least_bytes=1000)
    rows = warc.read(spark, str(tmp_path / "w")).collect()
    assert {r.kind for r in rows} == {"record"} and {r.warc_type for r in rows} == {"response"}
    assert sorted(bytes(r.payload) for r in rows) == sorted((h or "").encode() for _, _, h in _pages())


@pytest.mark.parametrize("packed", [False, True])
def test_warc_salvage(packed):
    records = [warc.record(i, "u", bytes([65 + i]) * 300, None) + warc.CLOSE for i in range(6)]
    parts = [gzip.compress(r) if packed else r for r in records]
    data = bytearray(b"".join(parts))
    starts = [sum(map(len, parts[:i])) for i in range(7)]
    data[starts[2] + len(parts[2]) // 2] ^= 0xFF  # damage the third
    got = list(warc.salvage(bytes(data)))
    ids = [f["warc-record-id"] for k, _, _, f, _ in got if k == "record"]
    assert ids == [f"<urn:page:{i}>" for i in (0, 1, 3, 4, 5)]
    assert [(a, b) for k, a, b, _, _ in got if k == "gap"] == [(starts[2], starts[3])]
    cut = list(warc.salvage(bytes(b"".join(parts))[:-10]))
    assert sum(k == "record" for k, *_ in cut) >= 5 and cut[-1][0] in ("gap", "record")
    junk = b"junk" + b"".join(records)
    assert [k for k, *_ in warc.salvage(junk)] == ["gap"] + ["record"] * 6
    assert list(warc.salvage(b"")) == [] and [k for k, *_ in warc.salvage(b"nothing")] == ["gap"]


def _ids(data):
    return [f["warc-record-id"] for k, _, _, f, _ in warc.salvage(bytes(data)) if k == "record"]


def test_warc_salvage_of_a_damaged_first_member():
    records = [warc.record(i, "u", random.Random(i).randbytes(300), None) + warc.CLOSE for i in range(4)]
    parts = [gzip.compress(r) for r in records]
    data = bytearray(b"".join(parts))
    data[0] ^= 0xFF
    assert _ids(data) == [f"<urn:page:{i}>" for i in (1, 2, 3)]
    mixed = records[0] + parts[1] + b"junk" + records[2] + parts[3]
    assert _ids(mixed) == [f"<urn:page:{i}>" for i in range(4)]


def test_warc_salvage_before_a_break():
    records = [warc.record(i, "u", random.Random(i).randbytes(2000), None) + warc.CLOSE for i in range(8)]
    data = bytearray(gzip.compress(b"".join(records)))
    data[len(data) * 5 // 8 + 200] ^= 0xFF
    data[-8] ^= 0xFF
    assert _ids(data)[:4] == [f"<urn:page:{i}>" for i in range(4)]
    big = bytearray(gzip.compress(b"".join(warc.record(i, "u", random.Random(i).randbytes(30_000), None) + warc.CLOSE for i in range(8))))
    assert _ids(big[: len(big) * 6 // 8])[:5] == [f"<urn:page:{i}>" for i in range(5)]


def test_warc_salvage_of_malformed_lengths():
    good = warc.record(1, "u", b"payload", None) + warc.CLOSE
    for length in ("\u00b2", "9" * 5000, "-1", "", "1e3", "\u0663"):
        bad = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: " + length.encode() + b"\r\n\r\nx" + warc.CLOSE
        got = list(warc.salvage(bad + good))
        assert [(k, a, b) for k, a, b, _, _ in got] == [("gap", 0, len(bad)), ("record", len(bad), len(bad) + len(good))]
    odd = {"content-type": "application/http", "warc-type": "revisit"}
    assert warc._payload(odd, b"HTTP/1.1 200 OK\r\nContent-Length: " + b"9" * 5000 + warc.CLOSE) == (b"", 0)


def test_warc_gaps_exclude_what_was_recovered():
    records = [warc.record(i, "u", random.Random(i).randbytes(3000), None) + warc.CLOSE for i in range(6)]
    first, second = gzip.compress(b"".join(records[:4])), gzip.compress(b"".join(records[4:]))
    data = bytearray(first + second)
    data[len(first) * 3 // 4] ^= 0xFF
    got = list(warc.salvage(bytes(data)))
    kept = [(a, b) for k, a, b, _, _ in got if k == "record"]
    gaps = [(a, b) for k, a, b, _, _ in got if k == "gap"]
    assert len(kept) >= 4 and len(gaps) == 1 and gaps[0][1] == len(first)
    assert all(b <= gaps[0][0] or a >= gaps[0][1] for a, b in kept)


def test_warc_files_damaged_anywhere_lose_the_hit_record(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"<p>{random.Random(i).random()} {i}</p>" * (i % 7)) for i in range(200)], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"))
    rng = random.Random(3)
    for file in [f for f in (tmp_path / "w").iterdir() if f.name.startswith("part-")][:2]:
        data = file.read_bytes()
        whole = _ids(data)
        for _ in range(20):
            hurt = bytearray(data)
            hurt[rng.randrange(len(hurt))] ^= rng.randint(1, 255)
            left = _ids(hurt)
            assert len(left) >= len(whole) - 1 and set(left) <= set(whole)


def test_warc_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 5000)
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 7)
    rows = [(i, "u", random.Random(i).randbytes(20_000).hex() if i == 5 else f"page {i}") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write(pages, str(tmp_path / "w"))
    files = [f for f in (tmp_path / "w").iterdir() if f.name.startswith("part-")]
    assert len(files) >= 7 and sum(f.stat().st_size > 5000 for f in files) == 1
    assert {r.record_id for r in warc.read(spark, str(tmp_path / "w")).collect()} == {f"<urn:page:{i}>" for i in range(40)}


def test_warc_files_have_a_member_for_each_record(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i} é") for i in range(20)], "page_id long, url string, html string").coalesce(1)
    warc.write(pages, str(tmp_path / "w"))
    (file,) = [f for f in (tmp_path / "w").iterdir() if f.name.startswith("part-")]
    data = bytearray(file.read_bytes())
    assert len(_ids(data)) == 20 and gzip.decompress(data).count(b"WARC-Type") == 20
    data[data.find(warc._GZIP, len(data) // 2) + 60] ^= 0xFF
    assert len(_ids(data)) == 19
    whole = warc.member(bytes(1 << 24)) + b"\0"
    assert gzip.decompress(whole) == bytes(1 << 24)


def _packed(df, **kw):
    by, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.pack(df, **kw).collect():
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    return by, seqs


def test_packing(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    by, seqs = _packed(d, with_ids=True)
    tok = tokenizer(DEFAULT).tok
    for r in d.collect():
        ids, at = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2], 0
        for p in sorted(by[r.doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and list(p.ids) == ids[at : at + p.length]
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for s in seqs.values():
        s.sort(key=lambda p: p.offset)
        assert [p.offset for p in s] == [0, *itertools.accumulate(p.length for p in s)][:-1]
        total = sum(p.length for p in s)
        assert total <= 4096 and total & (total - 1) == 0


def test_packing_odd_rows(spark):
    by, _ = _packed(docs(spark, ODD))
    assert sum(p.length for p in by[1]) == 1 and len(by[10]) == 2 and sum(p.length for p in by[5]) == by[5][0].doc_tokens > 60_000
    assert packing.pack(docs(spark, [])).count() == 0


def test_assignment_is_balanced():
    rng = random.Random(5)
    pieces = [(i, 0, rng.randint(1, 4095)) for i in range(400)]
    full = sum(p[2] for p in pieces) // 4096
    placed, left = packing.assign(pieces, [4096] * full)
    assert all(sum(p[2] for p in s) == 4096 for s in placed)
    assert sum(p[2] for p in left) == sum(p[2] for p in pieces) - 4096 * full
    cut = sum(len(s) for s in placed) + len(left) - len(pieces)
    assert cut <= full + 20


def test_assignment_cuts_only_what_fits_nowhere():
    rng = random.Random(8)
    pieces = [(i, 0, min(4095, max(1, int(rng.lognormvariate(5.5, 1))))) for i in range(1500)]
    full = sum(p[2] for p in pieces) // 4096
    placed, left = packing.assign(pieces, [4096] * full)
    room, spent, want = [4096] * full, [0.0] * full, [[] for _ in range(full)]
    for doc, start, n in sorted(pieces, key=lambda p: (-p[2], p[0], p[1])):  # every sequence is looked at
        while n and any(room):
            i = min((i for i in range(full) if room[i] >= n), key=lambda i: (spent[i], i), default=None)
            i = min((i for i in range(full) if room[i]), key=lambda i: (spent[i], i)) if i is None else i
            m = min(n, room[i])
            want[i].append((doc, start, m))
            room[i], spent[i], start, n = room[i] - m, spent[i] + packing.cost(m), start + m, n - m
    assert placed == want and sum(p[2] for p in left) == sum(p[2] for p in pieces) - 4096 * full


@pytest.mark.parametrize("text", ["it's we'll 'ss IT'S", "x\x00y \x1c a\x1cb", "日本語 テスト 123", "²³¹ ¼ ªµº ß ÿ Ÿ", "\x85a\xa0b", "a|b | ||", "<|endoftext|> <|", "ΑΣ İ ẞ é", "foo.### a--b'c''d"])
def test_subwords_are_the_tokenizers(text):
    t = tokenizer(DEFAULT)
    assert t.encode_batch([text, None])[0].tolist() == t.tok.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("part", range(4))
def test_subwords_of_every_letter_before_closing_marks(part):
    """Letters whose normal form ends in a combining mark among them; ideographs and syllables before two marks, others before all."""
    letters = [chr(c) for c in range(0x41, 0x110000) if chr(c).isalpha()]
    many = [c for c in letters if "CJK" in unicodedata.name(c, "") or "HANGUL" in unicodedata.name(c, "") or ord(c) > 0x12000]
    few = sorted(set(letters) - set(many))
    words = [c + m for c in many[part::4] for m in (",", ").")] + [f"ab{c}{m}" for c in few[part::4] for m in _subwords._CLOSING]
    words += ["BELED\u0130YES\u0130,", "\u0130.", "e\u0301,", "\u1100\u1161."]
    t = _subwords.WordTokenizer(DEFAULT)
    for at in range(0, len(words), 20_000):
        some = words[at : at + 20_000]
        want = [e.ids for e in t.tok.encode_batch_fast(some, add_special_tokens=False)]
        assert [(w, i.tolist()) for w, i in zip(some, t.encode_batch(some))] == list(zip(some, want))


def test_subwords_after_forgetting(monkeypatch):
    monkeypatch.setattr(_subwords, "WORDS_KEPT", 5)
    monkeypatch.setattr(_subwords, "CORES_KEPT", 3)
    t = _subwords.WordTokenizer(DEFAULT)
    for text in ["one two three four five six", "", "six, seven! eight", "Één zwölf ÉTÉ straße", "one 123 two"]:
        batch = [text, None, text.upper()]
        assert [i.tolist() for i in t.encode_batch(batch)] == [t.tok.encode(x or "", add_special_tokens=False).ids for x in batch]
    assert t.encode_batch([]) == [] and t.turn > 2


def test_subwords_keep_words(monkeypatch):
    """Words that are kept have the first numbers and their ids, however often the others are forgotten."""
    monkeypatch.setattr(_subwords, "WORDS_KEPT", 8)
    t = _subwords.WordTokenizer(words=2)
    for key, keep in (("a", [b"the", b"colou\xc3\xa9r,", b"of"]), ("b", [b"qzxvk"]), ("c", [])):
        t.keep(keep, key)
        for k in range(30):
            text = f"the w{k} of qzxvk x{k} colou\u00e9r, y{k}".split()
            at, count = t.numbers([[w.encode() for w in text]])
            assert [t.index.names[i].decode() for i in at.tolist()] == text
            assert t.ids(at, count)[0].tolist() == t.tok.encode(" ".join(text), add_special_tokens=False).ids
            assert t.index.names[: len(keep)] == keep and len(t.index.names) <= len(keep) + 4 + len(text)
        assert t.turn > 3


def test_lm_splits_with_few_words_held(monkeypatch):
    """A worker holds the dictionary's words once and few others, so that its memory does not grow with the different words."""
    import pyarrow as pa

    monkeypatch.setattr(_subwords, "WORDS_KEPT", 800)
    head = pa.RecordBatch.from_arrays([pa.array([b"the", b"of"]), pa.array([-1.0, -2.0])], names=["word", "log"])
    shared = types.SimpleNamespace(value=("few words", head, -3.0, 1))
    batches = [pa.RecordBatch.from_pylist([{"doc_id": k, "text": f"the of the {' '.join(f'w{k}x{j}' for j in range(50))}"}]) for k in range(60)]
    rows = [r for b in lm._split(iter(batches), shared, DEFAULT) for r in b.to_pylist()]
    assert [(r["n_tokens"], r["n_known"], r["base_score"], len(r["tail"])) for r in rows] == [(54, 4, -7.0, 50)] * 60
    assert len(tokenizer(DEFAULT, *lm.SHARE).index.names) <= 2 + 800 // lm.SHARE[0] + 50


def _held_out(rows, labels, column):
    known = {r["doc_id"]: r[column] for r in labels.collect()}
    hit = [(r.score, r.predicted, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    return np.array(hit)


def test_quality(spark, sf_dir):
    d, lab = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality.score(d, lab).collect()
    assert len(rows) == d.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    got = _held_out(rows, lab, "quality")
    assert (got[:, 1] == got[:, 2]).mean() > 0.85
    assert {r.doc_id: r.score for r in quality.score(d.withColumns({"lang": F.lit("x"), "source": F.lit("y")}), lab).collect()} == {r.doc_id: r.score for r in rows}


def test_toxicity(spark, sf_dir):
    d, lab = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = toxicity.score(d, lab).collect()
    assert len(rows) == d.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_toxicity_learns_words_and_beginnings():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeilmnorst") for _ in range(6))
    rows = []
    for i in range(600):
        bad = i % 4 == 0
        w = [word() for _ in range(rng.randint(5, 60))]
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["Zkquxian!", "zkquxu,", "zkquxeh", "vrotten"]))
        rows.append((i, " ".join(w), int(bad)))
    model = toxicity.fit(rows[:500])
    find = toxicity.Finder(model["lexicon"])
    got = toxicity.scores([t for _, t, _ in rows[500:]] + ["zkquxnew one", "", "plain words only here"], model, find)
    assert [s >= 0.3 for s in got] == [bool(y) for *_, y in rows[500:]] + [True, False, False]
    assert set(model["label_model"]) == {"accuracy", "share", "rho"}


def test_toxicity_hears_shouting_in_the_whole_text():
    group = np.array([0])
    vote = lambda text: toxicity.votes([0], 1, len(text.split()), text, group, 1)[3]
    calm, loud = "quiet words " * 200, "LOUD WORDS " * 800
    assert vote(calm + loud) == 1 and vote(loud[:2000] + calm * 5) == 0


def test_samples_are_bounded_by_rows_and_bytes(spark, monkeypatch):
    rows = [(i, "x" * 1000) for i in range(40)] + [(3, "y" * 10), (None, "z")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (4, None)], "doc_id long, toxic int")
    got = _labelled.sample(docs(spark, rows), labels, "toxic", 4, 2, 100)
    assert [r[0] for r in got] == [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2] and all(y == i % 2 for i, _, y in got)
    monkeypatch.setattr(_labelled, "SAMPLE_BYTES", 3500)
    few = _labelled.sample(docs(spark, rows), labels, "toxic", 4, 2, 100)
    assert {r[:1] for r in few} < {r[:1] for r in got} and [sum(y == k for *_, y in few) for k in (0, 1)] == [3, 3]
    monkeypatch.setattr(_labelled, "SAMPLE_BYTES", 1)
    assert [sum(y == k for *_, y in _labelled.sample(docs(spark, rows), labels, "toxic", 4, 2, 100)) for k in (0, 1)] == [1, 1]


@pytest.mark.parametrize("score, column, folds, fold", [(quality.score, "quality", 5, 0), (toxicity.score, "toxic", 4, 2)])
def test_held_out_accuracy(spark, score, column, folds, fold):
    """On the larger table: the share of held-out labels that the prediction meets, by label."""
    where = "/root/testdata/sf0.1"
    if not os.path.isdir(where):
        pytest.skip("no larger table")
    d, lab = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    got = _held_out(score(d, lab).collect(), lab, column)
    assert len(got) > 50
    for label in (0, 1):
        assert (got[got[:, 2] == label, 1] == label).mean() > 0.8, label


@pytest.mark.parametrize("score, column", [(quality.score, "quality"), (toxicity.score, "toxic")])
def test_classifier_odd_rows(spark, score, column):
    labels = spark.createDataFrame([(i, i % 2, None) for i in (3, 4, 5, 6, 7, 8)] + [(None, 1, 1), (3, None, 1)], "doc_id long, quality int, toxic int")
    rows = score(docs(spark, ODD), labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert score(docs(spark, []), labels).count() == 0 and score(docs(spark, ODD), labels.where("false")).count() == len(ODD)


def _mixed(df, **kw):
    by = collections.defaultdict(list)
    for r in mixing.mix(df, **kw).collect():
        by[r.source].append(r)
    for s in by.values():
        s.sort(key=lambda r: r.position)
        assert [r.position for r in s] == [0, *itertools.accumulate(r.n_tokens for r in s)][:-1]  # a gapless permutation
    return by


def test_mixing(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 3)
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 > 0, "hot").otherwise(F.col("source")))
    natural = collections.Counter()
    for r in d.collect():
        natural[r.source] += len((r.text or "").encode().split()) + 1
    share = {s: n / sum(natural.values()) for s, n in natural.items()}
    by = _mixed(d, repeats=2.0)
    assert {r.doc_id for s in by.values() for r in s} == {r.doc_id for r in d.collect()}
    lo, hi = 0.0, 1.0
    for _ in range(60):  # the exponent by plain bisection
        t = (lo + hi) / 2
        times = [p ** (t - 1) for p in share.values()]
        lo, hi = (lo, t) if max(times) / min(times) <= 2 else (t, hi)
    z = sum(p**hi for p in share.values())
    total = max(n * z / share[s] ** hi for s, n in natural.items())
    for s, rows in by.items():
        budget, spent = total * share[s] ** hi / z, sum(r.n_tokens for r in rows)
        assert budget - 2 <= spent <= budget + max(r.n_tokens for r in rows) + 2
        for e, n in collections.Counter(r.epoch for r in rows).items():
            assert n == sum(1 for r in rows if r.epoch == e) and len({r.doc_id for r in rows if r.epoch == e}) == n
    flat = _mixed(d, entropy=0.98, budget=5000.0)
    got = sum(r.n_tokens for rows in flat.values() for r in rows)
    assert 5000 - len(flat) <= got <= 5000 + sum(max(r.n_tokens for r in rows) for rows in flat.values())  # each source exceeds its budget by less than a document
    assert mixing.mixed_rows(d, repeats=2.0).groupBy("doc_id").count().count() == d.count()


def test_mixing_odd_rows(spark):
    d = docs(spark, ODD).withColumn("source", F.when(F.col("doc_id") > 5, F.lit(None)).otherwise(F.lit("a")))
    got = mixing.mix(d, repeats=3.0).collect()
    assert {r.doc_id for r in got} == {i for i, _ in ODD} and {r.source for r in got} == {"a", None}
    assert mixing.mixed_rows(d, repeats=3.0).columns == d.columns
    assert mixing.mix(docs(spark, []), repeats=2.0).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(d)


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("block", [1024, 16])
def test_capfilters(spark, monkeypatch, block):
    monkeypatch.setattr(capfilters, "BLOCK", block)
    rng = np.random.default_rng(7)
    x = [rng.normal(size=64) for _ in range(300)]
    for i in range(12):
        c = rng.normal(size=64)
        x += [c + 0.25 * rng.normal(size=64) for _ in range(10)]
    x += [x[0]] * 50 + [2 * x[1]] * 3
    x = [np.asarray(v, np.float32) for v in x]
    rows = capfilters.near_duplicates(_vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])).collect()
    u = np.stack(x).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    got = {r.vec_id: r for r in rows}
    links = np.array([got[i].n_links for i in range(len(x))])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.95 * near.sum()
    want = components(range(len(x)), np.argwhere(near).tolist())
    assert np.mean([got[i].component_id == want[i] for i in want]) > 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)


def test_capfilters_recall_at_the_threshold():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.9 * x + math.sqrt(1 - 0.81) * z / np.linalg.norm(z, axis=1, keepdims=True)
    for n in (1000, 50_000):
        d = capfilters.Decoder(n, 64)
        assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(d(x), d(y))]) > 0.93


def test_list_decoding_is_complete():
    d = capfilters.Decoder(2000, 10)
    x = np.random.default_rng(9).normal(size=(20, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for v, got in zip(x, d(x)):
        want = [r * d.words**2 + i * d.words + j for r, (rot, a, b) in enumerate(d.codes) for i in range(d.words) for j in range(d.words) if (v @ rot)[: d.cut] @ a[i] + (v @ rot)[d.cut :] @ b[j] >= d.height]
        assert got.tolist() == want


def test_capfilters_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0]
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0, 0.0], 0), (4, [nan, 1.0, 1.0], 0), (5, [inf, 1.0, 1.0], 0), (6, [None, 1.0, 1.0], 0), (7, v, 0), (8, v, 1), (8, v, 1), (9, [2.0, 4.0, 6.0], 0), (10, [1.0, 2.0], 0), (None, [9.0, -1.0, 0.0], 0)]
    got = collections.defaultdict(list)
    for r in capfilters.near_duplicates(_vectors(spark, rows)).collect():
        got[r.vec_id].append((r.n_links, r.component_id, r.kept))
    assert all(got[i] == [(0, i, True)] for i in (1, 2, 3, 4, 5, 6, 10))
    assert got[7] == [(3, 7, True)] and got[8] == [(3, 7, False)] * 2 and got[9] == [(3, 7, False)] and got[None] == [(0, None, True)]
    assert capfilters.near_duplicates(_vectors(spark, [])).count() == 0


@pytest.mark.parametrize("head", [1 << 18, 20])
def test_lm_base(spark, sf_dir, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r.doc_id: r.text for r in d.collect()}
    c = collections.Counter()
    for i, t in text.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            c.update([*t.encode().lower().split(), b""])
    n, v = sum(c.values()), len(c)
    rows = lm.score(d).collect()
    assert len(rows) == len(text)
    for r in rows:
        t = [*text[r.doc_id].encode().lower().split(), b""]
        want = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(c[w] > 0 for w in t), n, zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert r.base_score == pytest.approx(want) and r.score < 0


def test_lm_windows_score_each_id_once():
    for n in (0, 1, 23, 24, 25, 100):
        ids = np.arange(1, n + 1)
        inputs, targets = lm.windows(ids, 99)
        assert targets[targets >= 0].tolist() == [*range(1, n + 1), 99]
        flat = inputs[:, lm.CONTEXT :].ravel()[: n + 1]
        assert flat.tolist() == [99, *range(1, n + 1)]


def _known(group):
    return {"group": group, "state": group, "prior": np.zeros((lm.CLASSES + 1, lm.CLASSES), np.float32), "end": len(group) - 1}


def _taught(texts, vocab, group, turns=3):
    weights = lm.start(vocab)
    for _ in range(turns):
        learner = lm.Learner(weights, _known(group), 0)
        for t in texts:
            learner.add(t)
        learner.teach()
        weights = learner.m
    return weights


def _plain_model(weights, group):
    return _known(group) | {"weights": weights, "within": lm.within(np.zeros((lm.CLASSES + 1, len(group))), group)}


def test_lm_is_causal_and_a_distribution():
    rng = np.random.default_rng(1)
    vocab = 40
    group = np.arange(vocab) % lm.CLASSES
    texts = [rng.integers(0, vocab - 1, 50) for _ in range(5)]
    weights = _taught(texts, vocab, group)
    model = _plain_model(weights, group)
    total = 10 ** lm.score_ids(model, [np.array([], int)]).sum()
    first = [10 ** (lm.score_ids(model, [np.array([i])])[0]) for i in range(vocab)]
    assert 0 < total < 1 and sum(first) <= 1 - total + 1e-4
    a, b = texts[0].copy(), texts[0].copy()
    b[40:] = 0
    h = [lm._forward(weights, w, np.arange(len(w)) == 0)["h"].reshape(-1, lm.SIZE) for w, _ in (lm.windows(a, vocab - 1), lm.windows(b, vocab - 1))]
    assert np.allclose(h[0][:40], h[1][:40], atol=1e-5)


def test_lm_gradients_are_those_of_the_loss(monkeypatch):
    rng = np.random.default_rng(2)
    vocab, group = 30, np.arange(30) % lm.CLASSES
    m = {n: rng.normal(size=w.shape) * 0.3 for n, w in lm.start(vocab).items()}
    known = _known(group) | {"prior": rng.normal(size=(lm.CLASSES + 1, lm.CLASSES))}
    w, t = lm.windows(rng.integers(0, 29, 60), 29)
    first = np.arange(len(w)) == 0

    def loss(m):
        z, total = lm._chances(m, lm._forward(m, w, first)["h"], lm._odds(m, known["prior"]), known["state"][w[:, lm.CONTEXT :].ravel()])
        good = np.flatnonzero(t.ravel() >= 0)
        return -np.log(z[good, group[t.ravel()[good]]] / total[good]).mean()

    g = lm._gradients(m, w, t, first, known)
    full = {n: g[n] for n in m if n != "E"} | {"E": np.zeros((vocab, lm.SIZE))}
    full["E"][g["ids"]] = g["E"]
    for n in m:
        for _ in range(4):
            at = tuple(rng.integers(0, k) for k in m[n].shape)
            more, less = ({k: v.copy() for k, v in m.items()} for _ in range(2))
            more[n][at] += 1e-3
            less[n][at] -= 1e-3
            assert full[n][at] == pytest.approx((loss(more) - loss(less)) / 2e-3, rel=0.02, abs=2e-4), n


def test_lm_gradients_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(5)
    vocab = 60
    m = {n: (rng.normal(size=w.shape) * 0.3).astype(np.float32) for n, w in lm.start(vocab).items()}
    known = _known(np.arange(vocab) % lm.CLASSES)
    w, t = (np.concatenate(x) for x in zip(*(lm.windows(rng.integers(0, vocab - 1, n), vocab - 1) for n in (0, 5, 24, 100, 300))))
    first = rng.random(len(w)) < 0.3
    want = lm._gradients(m, w, t, first, known)
    monkeypatch.setattr(lm, "BLOCK", 4)
    monkeypatch.setattr(lm, "ROWS", 17)
    got = lm._gradients(m, w, t, first, known)
    assert want["ids"].tolist() == got["ids"].tolist() == np.unique(w).tolist()
    assert all(np.allclose(want[n], got[n], atol=1e-6) for n in m)


def test_lm_learns():
    vocab, group = 30, np.arange(30) % lm.CLASSES
    texts = [np.tile([1, 2, 3, 4], 12) for _ in range(40)]
    score = lambda w: lm.score_ids(_plain_model(w, group), [texts[0]])[0]
    assert score(_taught(texts, vocab, group, 20)) > score(lm.start(vocab)) + 20


def _plain_score(weights, group, prior, within, ends, ids, end):
    """The model's probability of a text, id by id."""
    full, out = [end, *ids], 0.0
    m = {n: w.astype(float) for n, w in weights.items()}
    for at, target in enumerate([*ids, end]):
        window = at // lm.STRIDE
        begin = window * lm.STRIDE - lm.CONTEXT  # the place in ``full`` of the window's first id
        seen = [(p - begin, full[p]) for p in range(max(begin, 0), at + 1)]
        x = np.array([m["E"][i] + m["P"][p] for p, i in seen])
        q, k, v = x[-1] @ m["Q"], x @ m["K"], x @ m["V"]
        a = np.exp(k @ q / lm.SIZE**0.5)
        state = lm.CLASSES if ends[full[at]] else group[full[at]]
        z = (x[-1] + (a / a.sum()) @ v @ m["O"]) @ m["C"] + m["b"] + prior[state]
        out += z[group[target]] - np.log(np.exp(z).sum()) + within[state, target]
    return out / math.log(10)


def test_lm_scores_match_a_plain_model(spark, monkeypatch):
    seen = []
    learned, within = lm.learned, lm.within
    monkeypatch.setattr(lm, "learned", lambda *a: seen.append(learned(*a)) or seen[-1])
    monkeypatch.setattr(lm, "within", lambda *a: seen.append((a, within(*a))) or seen[-1][1])
    words = "red green blue black white brown".split()
    rows = [(i, " ".join(words[(i + k) % 6] for k in range(i * 3 % 50))) for i in range(40)]
    got = {r.doc_id: r.score for r in lm.score(docs(spark, rows)).collect()}
    (weights, ((counts, group), table)), tok = seen, tokenizer(DEFAULT)
    prior = lm.prior(counts, group)
    vocab = tok.tok.get_vocab_size()
    ends = np.zeros(vocab, bool)
    ends[[i for piece, i in tok.tok.get_vocab().items() if piece.endswith("</w>")] + [vocab - 1]] = True
    want = collections.Counter()  # what follows what in the training documents
    for i, t in rows:
        ids = tok.encode_words([lm.words_of(t)])[0].astype(int).tolist()
        if zlib.crc32(str(i).encode()) % 5 != 1:
            for a, b in zip([vocab - 1, *ids], [*ids, vocab - 1]):
                want[lm.CLASSES if ends[a] else group[a], b] += 1
        assert got[i] == pytest.approx(_plain_score(weights, group, prior, table, ends, ids, vocab - 1), rel=1e-4)
    assert {(int(a), int(b)): int(counts[a, b]) for a, b in zip(*np.nonzero(counts))} == dict(want)


def test_lm_learns_from_every_training_document(spark, monkeypatch):
    seen = []
    learned = lm.learned
    monkeypatch.setattr(lm, "learned", lambda ids, weights, known, *a: seen.append((weights, known["group"], learned(ids, weights, known, *a))) or seen[-1][2])
    words = "red green blue black white brown".split()
    rows = [(i, " ".join(words[(i + k) % 6] for k in range(40))) for i in range(40)] + [(100, "house tree"), (104, "river stone")]
    lm.score(docs(spark, rows))
    tok = tokenizer(DEFAULT)
    before, group, after = seen[0]
    ids = np.unique(np.concatenate([tok.encode_words([lm.words_of(t)])[0] for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]))
    assert (np.abs(after["E"][ids] - before["E"][ids]).max(1) > 0).all()
    assert (group[ids] < lm.CLASSES - 1).all()  # the last class is of ids that no training document has


def test_lm_attention_adds_to_the_counts(spark, sf_dir, monkeypatch):
    """On documents that taught nothing the learned weights beat those that leave the counts as they are."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = lambda: sum(r.score for r in lm.score(d).where("held_out").collect())
    taught = held_out()
    monkeypatch.setattr(lm, "learned", lambda ids, weights, *a: weights)
    assert taught > held_out() + 100


def test_lm_adds_up_in_rounds(spark, monkeypatch):
    """With few rows to a group the cells are the same, and no group has more."""
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 50, rng.integers(0, 30)).astype("<u2") for _ in range(300)]
    ids = spark.createDataFrame([(bytearray(t.tobytes()),) for t in texts], "ids binary").repartition(13)
    want = lm.cell_counts(ids, "<u2", 50, 51, lm._is)
    assert want.tolist() == (np.bincount(np.concatenate(texts), minlength=51) + [*[0] * 50, 300]).tolist()
    rows = spark.range(40).selectExpr("id as task", "id * 2 as n").repartition(5)
    monkeypatch.setattr(lm, "FAN", 3)
    assert lm.cell_counts(ids, "<u2", 50, 51, lm._is).tolist() == want.tolist()

    def add(t):
        import pyarrow as pa

        return pa.table({"task": t.column("task")[:1], "n": [sum(t.column("n").to_pylist())], "most": [max([len(t), *(t.column("most").to_pylist())])]})

    got = lm.added_up(rows.selectExpr("task", "n", "1L as most"), [], 40, add, "task long, n long, most long").collect()
    assert len(got) <= 3 and sum(r.n for r in got) == 2 * sum(range(40)) and max(r.most for r in got) <= 3


def test_lm_neighbours_cover_all_documents(spark):
    tok = tokenizer(DEFAULT)
    vocab = tok.tok.get_vocab_size()
    rows = [(i, t) for i, t in ODD if i != 5]
    freq, want = np.zeros(vocab), collections.Counter()
    ids = [tok.encode_words([lm.words_of(t)])[0] for _, t in rows]
    texts = [[vocab - 1, *i.tolist(), vocab - 1] for i in ids]
    for t in texts:
        np.add.at(freq, t[1:], 1)
    col = {int(i): k for k, i in enumerate(np.argsort(-freq, kind="stable")[: lm.NEIGHBOURS])}
    for t in texts:
        for a, b in zip(t, t[1:]):
            want[b, col.get(a, lm.NEIGHBOURS)] += 1
            want[a, lm.NEIGHBOURS + 1 + col.get(b, lm.NEIGHBOURS)] += 1
    table = spark.createDataFrame([(k, bytearray(i.tobytes())) for k, i in enumerate(ids)], "row long, ids binary")
    assert (lm.cell_counts(table, tok.dtype.str, vocab - 1, vocab, lm._is) == freq).all()
    got = lm.neighbours(table, tok.dtype.str, freq, vocab - 1)
    assert {(int(i), int(j)): int(got[i, j]) for i, j in zip(*np.nonzero(got))} == dict(want)


def test_lm_odd_rows(spark):
    rows = lm.score(docs(spark, ODD)).collect()
    assert len(rows) == len(ODD) and all(r.score < 0 and math.isfinite(r.base_score) for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[1].n_tokens == by[2].n_tokens == 1
    assert lm.score(docs(spark, [])).count() == 0
    (only,) = lm.score(docs(spark, [(3, "held out only")])).collect()  # crc32 of '3' is 1 modulo 5
    assert only.held_out and (only.base_score, only.n_known, only.train_tokens) == (0.0, 0, 0)


def test_queries_have_their_columns(spark):
    from tesserae.llm import queries

    names = list(queries.queries())
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)
