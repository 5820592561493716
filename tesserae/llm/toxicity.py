"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier on its posteriors.

Lexicons of words and of word beginnings are mined from either half of a labelled sample. Each entry
is a voter; patterns (shouting, several entries, a share of entries, no entry at all) vote too. A
label model with a vote distribution for each class is fitted by expectation maximisation to the
votes; voters that still agree beyond what the class explains are counted as correlated and share
their weight. Its posteriors, not the labels, train a logistic classifier over the entries found.
"""

from __future__ import annotations

import heapq
import math
import re
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

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: Labelled documents of each class that are learned from, at most.
SAMPLE = 6_000
#: Lengths of word beginnings, and the least number of toxic documents and odds for an entry of a lexicon.
BEGINNINGS, LEAST_DOCS, LEAST_ODDS = (3, 4, 5, 6, 7), 3, 12.0
#: An entry's likelihood ratio must exceed that of the luckiest of all candidates by so much.
MARGIN = 3.0
#: Lexicon voters, at most.
VOTERS = 96
#: Distinct words whose entries a task remembers, and the longest of them.
CLEAN_KEPT, WORD_KEPT = 200_000, 64
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def _core(word: str) -> str:
    return _EDGE.sub("", word).lower()


def _candidates(core: str) -> list[str]:
    """The lexicon keys of a word: itself, and its beginnings shorter than it."""
    return ["=" + core, *(core[:n] for n in BEGINNINGS if len(core) > n)] if len(core) > 2 else []


def unlike(words: list[set[str]]) -> list[int]:
    """The first of each group of near-copies: texts that share most of the 8 distinct words with the least crc32."""
    seen: dict[int, list[frozenset]] = {}
    out = []
    for i, own in enumerate(words):
        sketch = frozenset(heapq.nsmallest(8, (zlib.crc32(w.encode()) for w in own)))
        least = sorted(sketch)[:3]
        if not any(2 * len(sketch & other) > len(sketch) for h in least for other in seen.get(h, ())):
            out.append(i)
            for h in least:
                seen.setdefault(h, []).append(sketch)
    return out


def mine(texts: list[str], y: np.ndarray) -> dict[str, float]:
    """Lexicon entry -> log odds of toxic, for entries that are more than luck among all candidates.

    Near-copies count once. A word is left out where one of its beginnings is as telling.
    """
    pool: dict[str, str] = {}  # one object for each distinct word, and one number for each candidate
    words = [{pool.setdefault(w, w) for w in t.split()} for t in texts]
    first = unlike(words)
    number: dict[str, int] = {}
    known: dict[str, tuple[int, ...]] = {}
    tally = (Counter(), Counter())
    n = [0, 0]
    for i in first:
        own: set[int] = set()
        for w in words[i]:
            got = known.get(w)
            if got is None:
                got = known[w] = tuple(number.setdefault(c, len(number)) for c in _candidates(_core(w)))
            own.update(got)
        tally[y[i]].update(own)
        n[y[i]] += 1
        words[i] = set()
    names = list(number)
    counts = tuple(Counter({names[k]: c for k, c in t.items() if tally[1][k]}) for t in tally)
    least = 2 * (math.log(max(2, len(counts[1]))) + MARGIN)
    found = {}
    for key, tox in counts[1].items():
        other = counts[0][key]
        if tox < LEAST_DOCS or not n[0]:
            continue
        odds = math.log((tox + 0.1) / n[1]) - math.log((other + 0.5) / n[0])
        ratio = 2 * (tox * math.log(tox * sum(n) / ((tox + other) * n[1])) + (other * math.log(other * sum(n) / ((tox + other) * n[0])) if other else 0.0))
        if odds >= math.log(LEAST_ODDS) and ratio >= least:
            found[key] = odds
    order = sorted(found, key=lambda k: (len(k.lstrip("=")), k))
    for key in [k for k in order if k[0] != "="]:  # a beginning goes where longer entries say nearly all of it better
        inner: list[str] = []
        for k in sorted((k for k in found if k.lstrip("=").startswith(key) and k != key and found[k] > found[key] + 0.7), key=lambda k: -counts[1][k]):
            if not any(k.lstrip("=").startswith(i.lstrip("=")) or i.lstrip("=").startswith(k.lstrip("=")) for i in inner):
                inner.append(k)
        if sum(counts[1][k] for k in inner) >= 0.8 * counts[1][key]:
            del found[key]
    out: dict[str, float] = {}
    for key in (k for k in order if k in found):
        core = key.lstrip("=")
        if found[key] > max((out[core[:m]] for m in BEGINNINGS if m <= len(core) and core[:m] in out and core[:m] != key), default=-9.0) + 0.4:
            out[key] = found[key]
    return out


class Finder:
    """Finds the lexicon entries of a text; words known to have none are skipped by a set difference."""

    def __init__(self, lexicon: list[str]):
        self.index = {k: i for i, k in enumerate(lexicon)}
        self.clean: set[str] = set()
        self.hits: dict[str, list[int]] = {}

    def __call__(self, text: str) -> tuple[list[int], int, int]:
        """(entries, distinct words with an entry, words)."""
        words = text.split()
        found: set[int] = set()
        flagged = 0
        for w in set(words).difference(self.clean):
            got = self.hits.get(w)
            if got is None:
                got = [self.index[k] for k in _candidates(_core(w)) if k in self.index]
                if len(w) <= WORD_KEPT and len(self.clean) + len(self.hits) < CLEAN_KEPT:
                    if got:
                        self.hits[w] = got
                    else:
                        self.clean.add(w)
            if got:
                found.update(got)
                flagged += 1
        return sorted(found), flagged, len(words)


def votes(found: list[int], flagged: int, words: int, text: str, group: np.ndarray, groups: int) -> np.ndarray:
    """The votes of all voters: 1 toxic, -1 not, 0 abstains."""
    v = np.zeros(groups + 4, np.int8)
    hit = np.bincount(group[found], minlength=groups) if found else np.zeros(groups, int)
    v[:groups] = np.where(hit > 0, 1, 0)
    v[groups] = 1 if flagged >= 2 else -1 if not flagged else 0
    v[groups + 1] = 1 if flagged >= max(1, 0.02 * words) and flagged else -1 if not flagged else 0
    upper = sum(map(str.isupper, text)) if flagged else 0  # a hint only; the vote abstains otherwise
    v[groups + 2] = 1 if flagged and upper > 0.3 * len(text) else 0
    v[groups + 3] = -1 if words > 50 and not flagged else 0
    return v


def label_model(votes: np.ndarray, prior: float, rounds: int = 25) -> dict:
    """Vote distributions by class, and each voter's share of weight after correlations, by expectation maximisation."""
    n, m = votes.shape
    on = np.stack([votes == s for s in (-1, 0, 1)]).astype(float)
    start = (votes > 0).sum(1) - 0.5 * (votes < 0).sum(1)
    q = np.clip(np.where(start > 0, 0.9, 0.05), 0.01, 0.99)
    share = np.ones(m)
    for _ in range(rounds):
        theta = np.stack([(np.einsum("snm,n->sm", on, w) + 0.5) / (w.sum() + 1.5) for w in (1 - q, q)])  # class, vote, voter
        # correlation that the class does not explain
        mean = sum(w[:, None] * (theta[c, 2] - theta[c, 0])[None] for c, w in enumerate((1 - q, q)))
        rest = votes - mean
        sd = rest.std(0) + 1e-6
        rho = np.clip((rest.T @ rest) / n / np.outer(sd, sd), 0, 1)
        np.fill_diagonal(rho, 1)
        share = 1 / np.maximum(1, (rho * (rho > 0.2)).sum(0))
        llr = np.log(theta[1]) - np.log(theta[0])
        logit = math.log(prior / (1 - prior)) + np.einsum("snm,sm,m->n", on, llr, share)
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    accuracy = np.array([(q * (votes[:, j] > 0) + (1 - q) * (votes[:, j] < 0)).sum() / max(1e-9, (votes[:, j] != 0).sum()) for j in range(m)])
    return {"theta": theta, "share": share, "rho": rho, "accuracy": accuracy, "posterior": q}


def fit(rows: list[tuple[int, str, int]]) -> dict:
    """A model from (doc_id, text, label) rows; without both classes every text scores the prior."""
    texts, y = [r[1] for r in rows], np.array([r[2] for r in rows], int)
    if len(set(y.tolist())) < 2:
        return {"lexicon": [], "weights": np.zeros(3), "bias": -4.0 if not y.sum() else 4.0}
    half = np.arange(len(rows)) % 2 == 0
    mined = mine([t for t, h in zip(texts, half) if h], y[half])
    again = mine([t for t, h in zip(texts, half) if not h], y[~half])
    lexicon = sorted(set(mined) | set(again))
    strength = np.array([max(mined.get(k, 0), again.get(k, 0)) for k in lexicon])
    groups = min(len(lexicon), VOTERS)  # the strongest entries vote alone, the others in turn with them
    group = np.empty(len(lexicon), int)
    group[np.argsort(-strength, kind="stable")] = np.arange(len(lexicon)) % max(1, groups)
    find = Finder(lexicon)
    found = [find(t) for t in texts]
    v = np.stack([votes(*f, t, group, groups) for f, t in zip(found, texts)])
    model = label_model(v, prior=float(np.clip(y.mean(), 0.02, 0.98)))
    q = model["posterior"]
    # logistic regression on the posteriors: entries found, their count, and the length
    index = [np.array(f[0], int) for f in found]
    dense = np.array([_dense(f) for f in found])
    w, d, b = np.zeros(len(lexicon)), np.zeros(dense.shape[1]), math.log(q.mean() / (1 - q.mean()) + 1e-9)
    flat = np.concatenate([*index, np.zeros(0, int)])
    row = np.repeat(np.arange(len(index)), [len(i) for i in index])
    gw, gd, gb = np.full(len(lexicon), 1e-6), np.full(len(d), 1e-6), 1e-6
    for _ in range(300):
        z = np.bincount(row, w[flat], len(index)) + dense @ d + b
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - q) / len(index)
        g = np.bincount(flat, e[row], len(lexicon)) + 2e-5 * w
        h, k = dense.T @ e + 1e-5 * d, e.sum()
        gw, gd, gb = gw + g * g, gd + h * h, gb + k * k
        w, d, b = w - 0.3 * g / np.sqrt(gw), d - 0.3 * h / np.sqrt(gd), b - 0.3 * k / math.sqrt(gb)
    return {"lexicon": lexicon, "weights": np.concatenate([w, d]), "bias": float(b), "label_model": {k: model[k] for k in ("accuracy", "share", "rho")}}


def _dense(found: tuple[list[int], int, int]) -> list[float]:
    entries, flagged, words = found
    return [math.log1p(flagged), math.log1p(100 * flagged / max(1, words)), float(flagged == 0)]


def scores(texts: list[str], model: dict, find: Finder) -> list[float]:
    n = len(model["lexicon"])
    w, d = model["weights"][:n], model["weights"][n:]
    out = []
    for t in texts:
        f = find(t)
        z = float(w[f[0]].sum() if f[0] else 0.0) + float(np.dot(d, _dense(f))) + model["bias"]
        out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
    return out


def _score(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    find = Finder(model["lexicon"])
    for b in batches:
        got = [scores([t.as_py() or ""], model, find)[0] for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64())], names=["doc_id", "score"])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out boolean, score double, predicted int), one row per row of ``docs``.

    Labels are learned from a bounded sample (``SAMPLE`` documents of each class) outside the fold
    crc32(doc_id) mod 4 = 2. Null and empty texts score like a text without an entry. A null doc_id is
    scored as well. Without labels of both classes all scores are near the one class known, or 0.
    """
    model = fit(sample(docs, labels, "toxic", FOLDS, HELD_OUT, SAMPLE))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = map_arrow(rows, partial(_score, model=model), "doc_id long, score double")
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold; all columns stay and nothing shuffles.

    Each row is judged for itself, so repeated rows stay or go together, and a null id changes nothing.
    Null and empty texts have no entry and stay unless all known labels are toxic. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = fit(sample(rows, labels, "toxic", FOLDS, HELD_OUT, SAMPLE))
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(model["lexicon"])
        for b in batches:
            got = [scores([str(t) if (t := x.as_py()) is not None else ""], model, find)[0] < THRESHOLD for x in b.column(at)]
            yield b.filter(pa.array(got, pa.bool_()))

    return map_arrow(docs, keep, docs.schema)
