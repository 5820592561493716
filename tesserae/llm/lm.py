"""Language-model scoring: a unigram base over all training words, and a causal self-attention model over subword ids.

The base counts every word of the training documents. The model predicts the class of the next
subword id from the ids before it by one layer of masked attention, trained in numpy in rounds: each task
learns from its own documents, and the changes are averaged. Rounds double, so that all tasks soon start from
weights that know something, and together they cover every training document once. The classes come from the
neighbours of ids in all training documents. The probability of a class and of an id within its class, given the class of the
id before, are counted over all of them too; attention adds to the former what the ids further back tell. Texts are split into ids once, and the ids are kept. A text is scored in windows that
overlap: each window's first ids serve as context only, so every id is scored once. The frequent
words of the base travel to the tasks as a dictionary of a fixed size; the others are joined.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm._labelled import fold
from tesserae.llm._shared import Scratch, map_arrow, ship
from tesserae.llm._subwords import DEFAULT, by_size, tokenizer

ship(__name__)

FOLDS, HELD_OUT = 5, 1
#: Words that travel as a dictionary, at most; all others are joined.
HEAD = 1 << 18
#: A worker that splits texts holds one part in so many of a tokenizer's usual caches.
SHARE = (8, 2)
#: Distinct words that a task counts before it hands them on.
COUNTED = 150_000
#: What tasks counted or learned is added up in rounds, so many of them at a time.
FAN = 32
#: Ids of a window, how many of them are context only, width of a vector, classes of ids.
WINDOW, CONTEXT, SIZE, CLASSES = 32, 8, 16, 128
STRIDE = WINDOW - CONTEXT
#: Training documents are dealt over so many rounds, each twice the one before; every document teaches by all of its windows.
ROUNDS = 6
#: Windows of a step at least and at most, windows that a task shuffles together, rates of the first and the last round.
STEP_LEAST, STEP_MOST, SHUFFLED, RATES, SEED = 32, 512, 1 << 15, (0.015, 0.003), 5
#: The neighbours that tell ids apart are the most frequent ids; all others are one.
NEIGHBOURS = 128
#: Weight of the class alone beside counts that know the id before.
BACKOFF = 5.0
#: Windows scored together: so few that their numbers stay in the processor's cache.
BLOCK = 96
#: Rows of class scores worked on together, for the same reason.
ROWS = 384


def words_of(text: str | None) -> list[bytes]:
    """The words of a text: A-Z in lower case, cut at [\\x20\\x09-\\x0D]."""
    return (text or "").encode("utf-8", "replace").lower().split()


# counts over the whole corpus


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

    for b in batches:
        for t in b.column(0):
            counts.update(words_of(t.as_py()))
            counts[b""] += 1  # the end; no word is empty
            if len(counts) > COUNTED:
                yield out()
                counts.clear()
    if counts:
        yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all rows of docs (text); the empty word is the end of a text."""
    return map_arrow(docs.select("text"), _count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _ids(batches: Iterator[pa.RecordBatch], dtype: str, column: int = 0) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches in parts of a bounded number of ids, with the ids of each text."""
    for b in batches:
        at = 0
        for part in by_size(list(b.column(column)), lambda x: len(x.as_buffer()), 1 << 20, 4096):
            yield b.slice(at, len(part)), [np.frombuffer(x.as_buffer(), dtype).astype(np.int64) for x in part]
            at += len(part)


def _joined(ids: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids, each text with its end, and the id before each; an end is before the first."""
    flat = np.concatenate([x for i in ids for x in (i, [end])])
    return flat, np.concatenate([[end], flat[:-1]])


#: Parts in which counts of cells travel and are added up.
PARTS = 32


def added_up(rows: DataFrame, key: list[str], tasks: int, add, schema: str) -> DataFrame:
    """``rows`` with a ``task`` of ``tasks``, added up by ``add`` in rounds until at most FAN are left of each key; no group has more than FAN."""
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        rows = rows.groupBy(*key, (F.col("task") % tasks).alias("_group")).applyInArrow(add, schema).withColumn("task", F.col("task") % tasks)
    return rows


def _task() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def _packed(task: int, at: np.ndarray, n: np.ndarray, cells: int) -> pa.RecordBatch:
    """Counts by part of the cells, as bytes: at, in order, and n."""
    cut = np.searchsorted(at, np.arange(PARTS + 1) * -(-cells // PARTS))
    own = [p for p in range(PARTS) if cut[p] < cut[p + 1]]
    columns = [pa.array([task] * len(own), pa.int64()), pa.array(own, pa.int32()), pa.array([at[cut[p] : cut[p + 1]].astype("<i4").tobytes() for p in own], pa.binary()), pa.array([n[cut[p] : cut[p + 1]].astype("<i8").tobytes() for p in own], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["task", "part", "at", "n"])


def _count_cells(batches: Iterator[pa.RecordBatch], dtype: str, end: int, cells: int, cell) -> Iterator[pa.RecordBatch]:
    total = np.zeros(cells, np.int64)
    for _, ids in _ids(batches, dtype):
        for at in cell(*_joined(ids, end)):
            np.add.at(total, at, 1)
    at = np.flatnonzero(total)
    yield _packed(_task(), at, total[at], cells)


def _added(rows: pa.Table, cells: int) -> pa.Table:
    size = -(-cells // PARTS)
    begin = rows.column("part")[0].as_py() * size
    total = np.zeros(size, np.int64)
    for a, n in zip(rows.column("at"), rows.column("n")):
        total[np.frombuffer(a.as_buffer(), "<i4") - begin] += np.frombuffer(n.as_buffer(), "<i8")
    at = np.flatnonzero(total)
    return pa.Table.from_batches([_packed(rows.column("task")[0].as_py(), at + begin, total[at], cells)])


def cell_counts(ids: DataFrame, dtype: str, end: int, cells: int, cell) -> np.ndarray:
    """How often ``cell`` (id, id before) -> arrays of cell numbers names each of the cells, over all texts of ``ids``."""
    schema = "task long, part int, at binary, n binary"
    each = map_arrow(ids.select("ids"), partial(_count_cells, dtype=dtype, end=end, cells=cells, cell=cell), schema)

    def added(rows: pa.Table) -> pa.Table:
        return _added(rows, cells)

    out = np.zeros(cells, np.float32)
    few = added_up(each, ["part"], ids.rdd.getNumPartitions(), added, schema)
    for r in few.groupBy("part").applyInArrow(added, schema).toLocalIterator():
        out[np.frombuffer(r["at"], "<i4")] = np.frombuffer(r["n"], "<i8")
    return out


# the model


def _is(flat: np.ndarray, before: np.ndarray) -> list[np.ndarray]:
    return [flat]


def _beside(flat: np.ndarray, before: np.ndarray, col: np.ndarray) -> list[np.ndarray]:
    wide = 2 * (NEIGHBOURS + 1)
    return [flat * wide + col[before], before * wide + NEIGHBOURS + 1 + col[flat]]


def _follows(flat: np.ndarray, before: np.ndarray, state: np.ndarray) -> list[np.ndarray]:
    return [state[before] * len(state) + flat]


def neighbours(ids: DataFrame, dtype: str, freq: np.ndarray, end: int) -> np.ndarray:
    """How often each id stands after and before each of the most frequent ids (and any other) in all texts; an end is between texts."""
    col = np.full(len(freq), NEIGHBOURS, np.int64)
    top = np.argsort(-freq, kind="stable")[:NEIGHBOURS]
    col[top] = np.arange(len(top))
    cells = len(freq) * 2 * (NEIGHBOURS + 1)
    return cell_counts(ids, dtype, end, cells, partial(_beside, col=col)).reshape(len(freq), -1)


def classes(x: np.ndarray, freq: np.ndarray) -> np.ndarray:
    """A class for each id, by k-means over its neighbours' counts; unseen ids share the last class."""
    out = np.full(len(freq), CLASSES - 1, np.int64)
    seen = np.flatnonzero(freq > 0)
    if len(seen) < 2:
        return out
    top = np.argsort(-freq, kind="stable")
    row = np.full(len(freq), -1, np.int64)
    row[seen] = np.arange(len(seen))
    x = np.sqrt(x[seen])
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    own = min(16, len(seen))  # the most frequent ids have a class each
    alone = top[:own]
    k = CLASSES - 1 - own
    rest = np.setdiff1d(seen, alone)
    if len(rest):
        y = x[row[rest]]
        centre = y[np.argsort(-freq[rest], kind="stable")[:k]].copy()
        for _ in range(8):
            near = (y @ centre.T).argmax(1)
            for c in range(len(centre)):
                if (near == c).any():
                    m = y[near == c].sum(0)
                    centre[c] = m / (np.linalg.norm(m) + 1e-9)
        out[rest] = own + near
    out[alone] = np.arange(own)
    return out


def windows(ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, targets): each row of inputs has WINDOW ids, of which the last STRIDE predict the row of targets; -1 is no target."""
    n = len(ids) + 1
    rows = -(-n // STRIDE)
    full = np.full(CONTEXT + rows * STRIDE, end, np.int64)
    full[CONTEXT + 1 : CONTEXT + n] = ids
    target = np.full(rows * STRIDE, -1, np.int64)
    target[: n - 1], target[n - 1] = ids, end
    at = np.arange(rows)[:, None] * STRIDE + np.arange(WINDOW)[None]
    return full[at], target.reshape(rows, STRIDE)


_CAUSAL = (np.arange(WINDOW)[None] <= np.arange(CONTEXT, WINDOW)[:, None]).astype(np.float32)


def _forward(m: dict, inputs: np.ndarray, first: np.ndarray) -> dict:
    """Masked attention of the last STRIDE ids of each window over the whole window; ``first`` windows have no context. The attention ``a`` is not normalised; its sums are ``s``."""
    x = m["E"][inputs]
    x += m["P"]
    flat = x.reshape(-1, SIZE) @ np.concatenate([m["Q"] * np.float32(SIZE**-0.5), m["K"], m["V"]], 1)
    q, k, v = (flat.reshape(len(x), WINDOW, 3, SIZE)[:, :, i] for i in range(3))
    a = q[:, CONTEXT:] @ k.transpose(0, 2, 1)
    a = _raised(a)
    a *= _CAUSAL
    if first.any():
        a[first, :, :CONTEXT] = 0
    s = a @ np.ones(WINDOW, np.float32)
    o = a @ v
    o /= s[:, :, None]
    h = x[:, CONTEXT:] + o @ m["O"]
    return {"x": x, "q": q, "k": k, "v": v, "a": a, "s": s, "o": o, "h": h}


def _raised(z: np.ndarray) -> np.ndarray:
    """The exponential, in place; scores that no trained weights reach are held at 60."""
    low = z.max(initial=0) > 60
    return np.exp(np.minimum(z, 60, out=z) if low else z, out=z)


def _odds(m: dict, prior: np.ndarray) -> np.ndarray:
    """What the counts and the bias say of each class by state."""
    return np.exp(prior + m["b"])


def _chances(m: dict, h: np.ndarray, odds: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(what each class weighs, their sum) of rows of h: the exponential of its score times its odds."""
    z = _raised(h.reshape(-1, SIZE) @ m["C"])
    z *= odds[state]
    return z, z @ np.ones(CLASSES, z.dtype)


def start(vocab: int) -> dict:
    """Random weights that add nothing yet to what the counts say of classes."""
    rng = np.random.default_rng(SEED)
    shape = {"E": (vocab, SIZE), "P": (WINDOW, SIZE), "Q": (SIZE, SIZE), "K": (SIZE, SIZE), "V": (SIZE, SIZE), "O": (SIZE, SIZE)}
    scale = {"E": 0.3, "P": 0.1}
    m = {n: (rng.normal(0, 1, s) * scale.get(n, SIZE**-0.5)).astype(np.float32) for n, s in shape.items()}
    return m | {"C": np.zeros((SIZE, CLASSES), np.float32), "b": np.zeros(CLASSES, np.float32)}


def _classed(m: dict, h: np.ndarray, odds: np.ndarray, state: np.ndarray, target: np.ndarray, share: np.float32, grads: dict, dh: np.ndarray) -> None:
    """The gradient of rows of h into ``dh``, those of C and b added to ``grads``; a row whose target, a class, is below 0 has none."""
    for at in range(0, len(h), ROWS):
        own, t = h[at : at + ROWS], target[at : at + ROWS]
        d, total = _chances(m, own, odds, state[at : at + ROWS])
        good = t >= 0
        d *= (good * share / total).astype(h.dtype)[:, None]
        row = np.flatnonzero(good)
        d[row, t[row]] -= share
        np.matmul(d, m["C"].T, out=dh[at : at + ROWS])
        grads["C"] += own.T @ d
        grads["b"] += np.ones(len(d), d.dtype) @ d


def _gradients(m: dict, w: np.ndarray, t: np.ndarray, first: np.ndarray, known: dict) -> dict:
    """The gradients of the mean loss of windows; that of E only for the ids used, with them. Few windows are worked on at a time, so that numbers stay in the processor's cache."""
    f = m["E"].dtype.type
    grads = {n: np.zeros_like(u) for n, u in m.items() if n != "E"}
    odds, share, scale = _odds(m, known["prior"]), f(1 / (t >= 0).sum()), f(SIZE**-0.5)
    dx = np.empty((*w.shape, SIZE), f)
    flat = lambda u: u.reshape(-1, u.shape[-1])
    for at in range(0, len(w), BLOCK):
        own, target = w[at : at + BLOCK], t[at : at + BLOCK].ravel()
        r = _forward(m, own, first[at : at + BLOCK])
        dh = np.empty_like(r["h"])
        _classed(m, flat(r["h"]), odds, known["state"][own[:, CONTEXT:].ravel()], np.where(target < 0, target, known["group"][target]), share, grads, flat(dh))
        do = dh @ m["O"].T
        do /= r["s"][:, :, None]
        ds = do @ r["v"].transpose(0, 2, 1)
        ds -= (do * r["o"]).sum(2, keepdims=True)
        ds *= r["a"]
        each = np.zeros((*own.shape, 3, SIZE), f)  # of q, k and v, beside each other
        each[:, CONTEXT:, 0], each[:, :, 1], each[:, :, 2] = ds @ r["k"], ds.transpose(0, 2, 1) @ r["q"][:, CONTEXT:], r["a"].transpose(0, 2, 1) @ do
        each = each.reshape(-1, 3 * SIZE)
        wide = flat(r["x"]).T @ each
        grads["Q"] += wide[:, :SIZE] * scale
        grads["K"] += wide[:, SIZE : 2 * SIZE]
        grads["V"] += wide[:, 2 * SIZE :]
        grads["O"] += flat(r["o"]).T @ flat(dh)
        part = dx[at : at + BLOCK]
        np.matmul(each, np.concatenate([m["Q"] * scale, m["K"], m["V"]], 1).T, out=flat(part))
        part[:, CONTEXT:] += dh
        grads["P"] += part.sum(0)
    ids, de = _by_id(w.ravel(), flat(dx), len(m["E"]))
    return grads | {"ids": ids, "E": de}


def _by_id(w: np.ndarray, dx: np.ndarray, vocab: int) -> tuple[np.ndarray, np.ndarray]:
    """(the different ids, the sum of their rows of dx)."""
    order = np.argsort(w.astype(np.uint16) if vocab <= 1 << 16 else w, kind="stable")  # 16 bits are sorted by their digits
    own = w[order]
    begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    return own[begin], np.add.reduceat(dx[order], begin, axis=0)


def _adam(m: dict, grads: dict, one: dict, two: dict, step: int, rate: float) -> None:
    f = np.float32
    ids = grads.pop("ids")
    for n, g in grads.items():
        g, at = g.astype(f), ids if n == "E" else slice(None)  # of E only the rows used move
        one[n][at] = a = f(0.9) * one[n][at] + f(0.1) * g
        two[n][at] = b = f(0.99) * two[n][at] + f(0.01) * g * g
        m[n][at] -= f(rate) * (a / f(1 - 0.9**step)) / (np.sqrt(b / f(1 - 0.99**step)) + f(1e-7))


class Learner:
    """Weights that learn from windows, in order of their arrival but for shuffles of SHUFFLED windows."""

    def __init__(self, weights: dict, known: dict, turn: int):
        self.m = {n: w.copy() for n, w in weights.items()}
        self.one, self.two = {n: np.zeros_like(w) for n, w in weights.items()}, {n: np.zeros_like(w) for n, w in weights.items()}
        self.known, self.rng = known, np.random.default_rng((SEED, turn))
        self.rate = RATES[0] * (RATES[1] / RATES[0]) ** (turn / (ROUNDS - 1))
        self.uses, self.steps, self.taught, self.held = np.zeros(len(known["group"])), 0, 0, 0
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, ids: np.ndarray) -> None:
        """All windows of a text."""
        inputs, targets = windows(ids, self.known["end"])
        self.kept.append((inputs, targets, np.arange(len(inputs)) == 0))
        self.held += len(inputs)
        if self.held >= SHUFFLED:
            self.teach()

    def teach(self) -> None:
        if not self.kept:
            return
        inputs, targets, first = (np.concatenate(x) for x in zip(*self.kept))
        size = min(STEP_MOST, max(STEP_LEAST, len(inputs) // 64))
        order = self.rng.permutation(len(inputs))
        for at in range(0, len(order), size):
            pick = order[at : at + size]
            self.steps += 1
            _adam(self.m, _gradients(self.m, inputs[pick], targets[pick], first[pick], self.known), self.one, self.two, self.steps, self.rate * len(pick) / size)
        self.uses += np.bincount(inputs.ravel(), minlength=len(self.uses))
        self.taught += len(inputs)
        self.kept, self.held = [], 0


def _learn(batches: Iterator[pa.RecordBatch], shared, dtype: str, turn: int) -> Iterator[pa.RecordBatch]:
    """What a task's texts change: each id's vector times its uses, the uses, the other weights times the windows, and the windows."""
    old, known = shared.value
    learner = Learner(old, known, turn)
    for _, ids in _ids(batches, dtype, 1):
        for i in ids:
            learner.add(i)
    learner.teach()
    if learner.taught:
        m, uses = learner.m, learner.uses
        parts = [(m["E"] - old["E"]) * uses[:, None], uses, *((m[n] - old[n]) * learner.taught for n in old if n != "E"), np.array([learner.taught])]
        yield pa.RecordBatch.from_arrays([pa.array([_task()], pa.int64()), pa.array([np.concatenate([p.ravel() for p in parts]).astype(np.float32).tobytes()])], names=["task", "change"])


def _summed(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("task")  # sums do not depend on the order of arrival
    total = sum(np.frombuffer(c.as_buffer(), np.float32).astype(np.float64) for c in rows.column("change"))
    return pa.table({"task": rows.column("task")[:1], "change": pa.array([total.astype(np.float32).tobytes()])})


def learned(ids: DataFrame, weights: dict, known: dict, dtype: str) -> dict:
    """The weights after all texts of ``ids`` (row, ids) taught once: in each round every task starts from the same weights and their changes are averaged.

    An id's vector is averaged over the tasks by its uses in them, so that ids of few tasks learn as fast as others.
    Changes are added up in rounds, and the driver adds the last few; no task holds more than FAN of them.
    """
    context = ids.sparkSession.sparkContext
    place = F.pmod(F.xxhash64("row", F.lit(SEED)), F.lit(1 << 20))
    for turn in range(ROUNDS):
        lo, hi = (1 << 20) >> (ROUNDS - turn) if turn else 0, (1 << 20) >> (ROUNDS - 1 - turn)
        shared = context.broadcast((weights, known))
        rows = ids.where((place >= lo) & (place < hi)).select("row", "ids")
        changes = map_arrow(rows, partial(_learn, shared=shared, dtype=dtype, turn=turn), "task long, change binary")
        got = added_up(changes, [], rows.rdd.getNumPartitions(), _summed, "task long, change binary").toArrow()
        if got.num_rows:
            total = np.frombuffer(_summed(got).column("change")[0].as_buffer(), np.float32)
            weights, at = dict(weights), weights["E"].size
            uses, n = total[at : at + len(known["group"])], total[-1]
            weights["E"] = weights["E"] + total[:at].reshape(weights["E"].shape) / np.maximum(uses, 1)[:, None]
            at += len(uses)
            for name, w in weights.items():
                if name != "E":
                    weights[name] = w + total[at : at + w.size].reshape(w.shape) / n
                    at += w.size
        shared.unpersist()
    return weights


def within(counts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """log of each id's probability within its class by state, from counts (state, id), backed off to the class alone."""
    alone = counts.sum(0)
    size, total = np.bincount(group, minlength=CLASSES), np.bincount(group, alone, CLASSES)
    plain = (alone + 0.5) / (total + 0.5 * size)[group]
    out = np.empty(counts.shape, np.float32)
    for s, own in enumerate(counts):
        out[s] = np.log((own + BACKOFF * plain) / (np.bincount(group, own, CLASSES) + BACKOFF)[group])
    return out


def prior(counts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """log of each class's probability by state, from counts (state, id), backed off to the class alone."""
    own = np.stack([np.bincount(group, c, CLASSES) for c in counts])
    plain = (own.sum(0) + 0.5) / (own.sum() + 0.5 * CLASSES)
    return np.log((own + BACKOFF * plain) / (own.sum(1, keepdims=True) + BACKOFF)).astype(np.float32)


def score_ids(model: dict, texts: list[np.ndarray]) -> np.ndarray:
    """log10 of the model's probability of each text, given as ids, with its end."""
    pairs = [windows(t, model["end"]) for t in texts]
    inputs, targets = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    rows = np.array([len(p[0]) for p in pairs])
    begins = np.cumsum(rows) - rows
    first = np.zeros(len(inputs), bool)
    first[begins] = True
    out = np.empty(len(inputs))
    group, odds = model["group"], _odds(model["weights"], model["prior"])
    for at in range(0, len(inputs), BLOCK):
        own, t = inputs[at : at + BLOCK], targets[at : at + BLOCK].ravel()
        state = model["state"][own[:, CONTEXT:].ravel()]
        z, total = _chances(model["weights"], _forward(model["weights"], own, first[at : at + BLOCK])["h"], odds, state)
        safe = np.maximum(t, 0)
        log = np.log(z[np.arange(len(t)), group[safe]] / total) + model["within"][state, safe]
        out[at : at + BLOCK] = np.where(t >= 0, log, 0).reshape(-1, STRIDE).sum(1, dtype=np.float64)
    return np.add.reduceat(out, begins) / math.log(10)


# scoring


class _Base:
    """The base of texts as far as the dictionary goes, whose words have the tokenizer's first numbers."""

    def __init__(self, tok, head: pa.RecordBatch, key: str):
        tok.keep(head.column(0).to_pylist(), key)
        self.tok, self.logs = tok, np.append(head.column(1), 0.0)

    def __call__(self, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(sum of logs, known words, counts of the other words) of each text."""
        names, most = self.tok.index.names, len(self.logs) - 1
        other = at >= most
        own = np.repeat(np.arange(len(count)), count)
        base = np.bincount(own, self.logs[np.minimum(at, most)], len(count))
        cell, n = np.unique(own[other] * len(names) + at[other], return_counts=True)
        cut = np.searchsorted(cell, np.arange(len(count) + 1) * len(names))
        words = pa.array([names[i] for i in (cell % max(1, len(names))).tolist()], pa.binary()).cast(pa.string())
        tail = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.StructArray.from_arrays([words, pa.array(n.astype(np.int64))], names=["w", "n"]))
        return base, count - np.bincount(own[other], minlength=len(count)), tail


def _split(batches: Iterator[pa.RecordBatch], shared, path: str) -> Iterator[pa.RecordBatch]:
    """The ids of each text, and its base as far as the dictionary goes."""
    key, head, end_log, end_known = shared.value
    tok = tokenizer(path, *SHARE)
    based = _Base(tok, head, key)
    row = _task() << 40
    for b in batches:
        docs = list(zip(b.column(0).to_pylist(), b.column(1)))
        for part in by_size(docs, lambda r: len(r[1].as_buffer() or b"")):
            at, count = tok.numbers([words_of(t.as_py()) for _, t in part])
            base, known, tail = based(at, count)
            ids = [i.tobytes() for i in tok.ids(at, count)]
            n = len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + n)), pa.array([i for i, _ in part], pa.int64()), pa.array(count + 1), pa.array(known + end_known), pa.array(base + end_log), tail, pa.array(ids, pa.binary())],
                names=["row", "doc_id", "n_tokens", "n_known", "base_score", "tail", "ids"],
            )
            row += n


def _score(batches: Iterator[pa.RecordBatch], shared, dtype: str) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for b, ids in _ids(batches, dtype):
        yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(score_ids(model, ids))], names=[*b.schema.names[1:], "score"])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str = DEFAULT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs``.

    Counts, classes and the attention weights are learned from all documents outside the fold
    crc32(doc_id) mod 5 = 1. A null or empty text is its end alone. Repeated rows are
    counted and scored each. A null doc_id counts as the text ''. Without training documents all
    counts are zero and so is the base. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    teaches = fold(F.col("doc_id"), FOLDS) != HELD_OUT
    counts = scratch.write(word_counts(rows.where(teaches)), "counts")
    total, distinct, closed = counts.agg(F.sum("c"), F.count("*"), F.sum(F.when(F.col("word") == "", F.col("c")))).first()
    total, closed = total or 0, closed or 0
    whole = total + 0.5 * (distinct + 1)
    log = lambda c: math.log10((c + 0.5) / whole)
    top = counts.where("word <> ''").orderBy(F.desc("c"), "word").limit(HEAD).toArrow().combine_chunks()
    words = pa.chunked_array(top.column("word").chunks, pa.string()).combine_chunks().cast(pa.binary())
    head = pa.RecordBatch.from_arrays([words, pa.array([log(c) for c in top.column("c").to_pylist()], pa.float64())], names=["word", "log"])
    shared = spark.sparkContext.broadcast((scratch.base, head, log(closed), int(closed > 0)))
    split = map_arrow(rows, partial(_split, shared=shared, path=tokenizer_path), "row long, doc_id long, n_tokens long, n_known long, base_score double, tail array<struct<w: string, n: bigint>>, ids binary")
    split = scratch.write(split, "ids")
    tok = tokenizer(tokenizer_path)
    vocab = tok.tok.get_vocab_size()
    end, dtype, learn = vocab - 1, tok.dtype.str, split.where(teaches).select("row", "ids")
    freq = cell_counts(learn, dtype, end, vocab, _is)
    group = classes(neighbours(learn, dtype, freq, end), freq)
    state = group.copy()  # what an id may know of the one before it: its class, or that a word ended
    state[[i for piece, i in tok.tok.get_vocab().items() if piece.endswith("</w>")] + [end]] = CLASSES
    follows = cell_counts(learn, dtype, end, (CLASSES + 1) * vocab, partial(_follows, state=state)).reshape(CLASSES + 1, vocab)
    known = {"group": group, "state": state, "prior": prior(follows, group), "end": end}
    model = known | {"weights": learned(learn, start(vocab), known, dtype), "within": within(follows, group)}
    scored = map_arrow(split.select("ids", "row", "doc_id", "n_tokens", "n_known", "base_score"), partial(_score, shared=spark.sparkContext.broadcast(model), dtype=dtype), "row long, doc_id long, n_tokens long, n_known long, base_score double, score double")
    tail = split.select("row", F.explode("tail").alias("t")).select("row", "t.w", "t.n").join(counts, F.col("w") == F.col("word"), "left")
    c = F.coalesce("c", F.lit(0))
    tail = tail.groupBy("row").agg(F.sum(F.col("n") * F.log10((c + 0.5) / F.lit(whole))).alias("more"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("also"))
    tail = scratch.write(tail, "tail")
    out = scored.join(tail, "row", "left")
    return out.select("doc_id", (~teaches).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")
