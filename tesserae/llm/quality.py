"""Quality classifier by supervised subword embeddings.

A word has the vectors of itself and of its character n-grams, a pair of neighbours that of their word
bigram, all hashed into one table. A document is the mean over all its features, and a softmax over that
mean gives the class. Table and output layer are learned together by stochastic gradient descent in numpy
on a bounded labelled sample. As everything after the table is linear, a learned word or bigram collapses
to one number, which scoring looks up.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm._labelled import fold, sample
from tesserae.llm._shared import map_arrow, ship

ship(__name__)

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
#: Labelled documents of each class that are learned from, at most.
SAMPLE = 1_500
BUCKETS, SIZE, GRAMS = 1 << 17, 8, (3, 4)
EPOCHS, BATCH, RATE, SEED = 6, 32, 0.5, 3
#: Words whose numbers a task remembers, and their characters in all; a full memory is emptied.
WORDS_KEPT, CHARS_KEPT = 500_000, 16_000_000
#: The bucket that all bigrams of a word and itself share, and how often each of them counts.
_REPEAT, _WEIGHT = zlib.crc32(b"\x00repeat") % BUCKETS, 4.0


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, bucket) of every feature of each word: itself and its character n-grams."""
    which = [np.arange(len(words))]
    bucket = [np.array([zlib.crc32(w.encode("utf-8", "replace")) % BUCKETS for w in words], np.int64)]
    padded = [f"<{w}>" for w in words]
    code = np.frombuffer("".join(padded).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in padded])
    for n in GRAMS:
        if len(code) < n:
            continue
        h = np.full(len(code) - n + 1, 0x9E3779B97F4A7C15 + n, np.uint64)
        for i in range(n):
            h = (h ^ code[i : len(code) - n + 1 + i]) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(29)
        inside = owner[: len(h)] == owner[n - 1 :]
        which.append(owner[: len(h)][inside])
        bucket.append((h[inside] % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(which), np.concatenate(bucket)


def codes(words: list[str]) -> np.ndarray:
    """A number of each word, from which the buckets of bigrams come."""
    return np.array([zlib.crc32(w.encode("utf-8", "replace"), 77) for w in words], np.uint64)


def bigrams(code: np.ndarray) -> np.ndarray:
    """The buckets of all pairs of neighbours that differ."""
    a, b = code[:-1], code[1:]
    h = (a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xFF51AFD7ED558CCD)
    return ((h >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)[a != b]


def fit(rows: list[tuple[int, str, int]], prior: float) -> dict:
    """The table's numbers and the bias from (doc_id, text, label) rows; ``prior`` is the share of label 1 among all labels."""
    y = np.array([r[2] for r in rows], int)
    prior = float(np.clip(prior, 1e-3, 1 - 1e-3))
    if len(set(y.tolist())) < 2:
        return {"table": np.zeros(BUCKETS), "bias": 4.0 if y.sum() else -4.0 if len(y) else math.log(prior / (1 - prior))}
    texts = [r[1].split() for r in rows]
    index: dict[str, int] = {}
    for words in texts:
        for w in words:
            index.setdefault(w, len(index))
    which, bucket = features(list(index))
    order = np.argsort(which, kind="stable")
    bucket, begins = bucket[order], np.searchsorted(which[order], np.arange(len(index) + 1))
    code = codes(list(index))
    docs = []
    for words in texts:
        counts = Counter(words)
        ids = np.fromiter((index[w] for w in counts), np.int64, len(counts))
        times = np.fromiter(counts.values(), float, len(counts))
        length = begins[ids + 1] - begins[ids]
        at = np.arange(length.sum()) + np.repeat(begins[ids] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) if len(ids) else np.zeros(0, int)
        f, c = bucket[at], np.repeat(times, length)
        pairs = bigrams(code[np.fromiter(map(index.__getitem__, words), np.int64, len(words))])
        again = max(0, len(words) - 1) - len(pairs)
        f, c = np.concatenate([f, pairs, [_REPEAT]]), np.concatenate([c, np.ones(len(pairs)), [again * _WEIGHT]])
        f, back = np.unique(f, return_inverse=True)
        c = np.bincount(back, c, len(f))
        docs.append((f, c / max(1.0, c.sum())))
    rng = np.random.default_rng(SEED)
    table = rng.normal(0, 0.1, (BUCKETS, SIZE))
    out, bias = rng.normal(0, 0.5, (2, SIZE)), np.zeros(2)
    steps = EPOCHS * math.ceil(len(docs) / BATCH)
    step = 0
    for _ in range(EPOCHS):
        turn = rng.permutation(len(docs))
        for at in range(0, len(docs), BATCH):
            batch = turn[at : at + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            f = np.concatenate([docs[i][0] for i in batch])
            c = np.concatenate([docs[i][1] for i in batch])
            row = np.repeat(np.arange(len(batch)), [len(docs[i][0]) for i in batch])
            mean = np.stack([np.bincount(row, c * table[f, d], len(batch)) for d in range(SIZE)], 1)
            z = mean @ out.T + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            back = p @ out
            out -= rate * p.T @ mean
            bias -= rate * p.mean(0)
            for d in range(SIZE):  # a document's gradient is the same for all its features, by their share
                table[:, d] -= 20 * rate * np.bincount(f, c * back[row, d], BUCKETS)
    shift = math.log(prior / (1 - prior)) - math.log(y.mean() / (1 - y.mean()))
    return {"table": table @ (out[1] - out[0]), "bias": float(bias[1] - bias[0]) + shift}


class Scorer:
    def __init__(self, model: dict):
        self.table, self.bias = model["table"], model["bias"]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.value, self.count, self.code = np.zeros(0), np.zeros(0), np.zeros(0, np.uint64)

    def _learn(self, new: list[str]) -> None:
        which, bucket = features(new)
        value, count = np.bincount(which, self.table[bucket], len(new)), np.bincount(which, minlength=len(new))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.value, self.count, self.code = np.append(self.value, value), np.append(self.count, count), np.append(self.code, codes(new))
        self.chars += sum(map(len, new))

    def __call__(self, texts: list[str]) -> list[float]:
        split = [t.split() for t in texts]
        seen: set[str] = set()
        for words in split:
            seen.update(words)
        new = list(seen.difference(self.known))
        if new:
            if len(self.known) + len(new) > WORDS_KEPT or self.chars > CHARS_KEPT:
                self.forget()
                new = list(seen)
            self._learn(new)
        get = self.known.__getitem__
        out = []
        for words in split:
            at = np.fromiter(map(get, words), np.int64, len(words))
            pairs = bigrams(self.code[at])
            again = _WEIGHT * (max(0, len(words) - 1) - len(pairs))
            total = self.value[at].sum() + self.table[pairs].sum() + again * self.table[_REPEAT]
            z = self.bias + total / max(1.0, self.count[at].sum() + len(pairs) + again)
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        return out


def _score(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(model)
    for b in batches:
        got: list[float] = []
        for at in range(0, b.num_rows, 256):
            got += scorer([t.as_py() or "" for t in b.column(1)[at : at + 256]])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64())], names=["doc_id", "score"])


def train(docs: DataFrame, labels: DataFrame) -> dict:
    known = labels.where(F.col("quality").isin(0, 1) & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    share = known.agg(F.avg("quality")).first()[0]  # over all labels outside the fold
    return fit(sample(docs, labels, "quality", FOLDS, HELD_OUT, SAMPLE), 0.5 if share is None else share)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out boolean, score double, predicted int), one row per row of ``docs``.

    Labels are learned from a bounded sample (``SAMPLE`` documents of each class) outside the fold
    crc32(doc_id) mod 5 = 0. Null and empty texts get the bias alone. A null doc_id is scored as well.
    Without labels of both classes all scores are near the one class known, or the share of label 1.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = map_arrow(rows, partial(_score, model=train(docs, labels)), "doc_id long, score double")
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
