"""Each stage against a plain version on its own input."""

from __future__ import annotations

import collections
import itertools
import re

import corpus_pipeline as P
from tesserae.llm import packing, simhash, toxicity
from tesserae.llm._labelled import sample


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, []
    for i, (_, stage) in enumerate(P.STAGES):
        before = docs.collect()
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen.append((before, docs.collect()))
        assert i == len(P.STAGES) - 1 or docs.columns == columns
    (b, a), labels = seen[0], spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(sample(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels, "toxic", 4, 2, toxicity.SAMPLE))
    ok = toxicity.scores([r.text for r in b], model, toxicity.Finder(model["lexicon"]))
    assert sorted(r.doc_id for r in a) == sorted(r.doc_id for r, s in zip(b, ok) if s < 0.3)
    b, a = seen[1]
    groups = collections.defaultdict(list)
    for r in b:
        groups[re.sub("[\x20\x09-\x0d]", "", r.text)].append((-len(r.text), r.doc_id))
    assert sorted(r.doc_id for r in a) == sorted(min(v)[1] for v in groups.values())
    b, a = seen[2]
    fp = {r.doc_id: simhash.fingerprint(r.text) for r in b}
    low = {i: i for i in fp}
    pairs = [(x, y) for x, y in itertools.combinations(fp, 2) if (fp[x] ^ fp[y]).bit_count() <= 3]
    for _ in fp:
        new = dict(low)
        for x, y in pairs:
            new[x] = new[y] = min(new[x], new[y])
        if new == low:
            break
        low = new
    assert sorted(r.doc_id for r in a) == sorted(set(low.values()))
    b, a = seen[3]
    copies = collections.Counter(r.doc_id for r in a)
    assert set(copies) == {r.doc_id for r in b} and max(copies.values()) <= 3
    b, a = seen[4]
    pieces = collections.Counter()
    for r in a:
        pieces[r.doc_id] += r.length
    tokens = collections.Counter()
    for r in packing.pack(spark.createDataFrame(b)).collect():
        tokens[r.doc_id] += r.length
    assert pieces == tokens


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, path, rows):
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _, _ in rows if i is not None], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_an_empty_table(spark, tmp_path):
    assert P.run(spark, tables(spark, tmp_path, [])).count() == 0


def test_nulls_and_repeated_rows(spark, tmp_path):
    """Of null and empty texts, which are equal, one row stays, as of repeated rows; rows without an id are documents too."""
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two three four five", "a"), (3, "one two three four five", "a"), (None, "another text without an id", "b"), (4, "words " * 3000, None), (5, "three five four nine ten six", "b")]
    got = P.run(spark, tables(spark, tmp_path, rows)).collect()
    ids = {r.doc_id for r in got}
    assert {None, 3, 4, 5} <= ids and len(ids & {1, 2}) == 1
    whole = packing.pack(spark.createDataFrame([(4, "words " * 3000)], "doc_id long, text string")).collect()
    copies = {s for s in (r.start for r in got if r.doc_id == 4)}
    assert 0 in copies and sum(r.length for r in got if r.doc_id == 4) % sum(r.length for r in whole) == 0
