"""Language identification of mixed texts: scripts narrow the candidates, then Viterbi labels spans of words.

Learned are, per language, counts of hashed letter n-grams of all words of all training documents, and the
scripts of its letters. A word's candidates are the languages that write its script; its score for each is the
mean over orders of its n-grams' log probabilities. Viterbi finds the labels of a text's words of the greatest
sum of scores less a penalty for every switch, so spans of another language show and single odd words don't.
A text is cut into segments: what a segment does to every state it may begin in is worked out for all segments
of a batch together, then segments are chained, so a very long text costs what many short ones do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm._labelled import fold
from tesserae.llm._shared import map_arrow, ship
from tesserae.llm._subwords import worker_cache

ship(__name__)

FOLDS, HELD_OUT, UNKNOWN = 3, 1, "und"
#: The languages learned are those of the most training documents, at most so many.
LANGUAGES = 64
#: Orders of letter n-grams, a word's ends included, and the buckets that all orders share.
ORDERS, BUCKETS = (1, 2, 3, 4), 1 << 16
#: Added to every count.
SMOOTHING = 0.5
#: A language writes a script in which it has at least this share of its letters.
SCRIPT_SHARE = 0.01
#: What a change of language costs, and what a language costs that doesn't write the word's script.
SWITCH, FOREIGN = 6.0, 40.0
#: Distinct words that a task knows, by the number of languages, and characters of these, at most; then it begins anew. Characters split at once.
WORDS_KEPT, CHARS_KEPT, PIECE = 1 << 21, 1 << 24, 1 << 20
_GAP = re.compile(r"\s")
#: Words of a segment, and numbers of a table of segments that is worked on at once.
SEGMENT, TABLE = 64, 1 << 21
#: Counts of a row in which tasks hand on what they counted.
SLICE = 64

# Scripts and their ranges of code points; letters elsewhere are of script 0.
SCRIPTS = [
    ("Latin", [(0x41, 0x24F), (0x1E00, 0x1EFF), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)]),
    ("Greek", [(0x370, 0x3FF), (0x1F00, 0x1FFF)]),
    ("Cyrillic", [(0x400, 0x52F), (0x1C80, 0x1C8F), (0xA640, 0xA69F)]),
    ("Armenian", [(0x530, 0x58F)]),
    ("Hebrew", [(0x590, 0x5FF)]),
    ("Arabic", [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)]),
    ("Devanagari", [(0x900, 0x97F)]),
    ("Bengali", [(0x980, 0x9FF)]),
    ("Gurmukhi", [(0xA00, 0xA7F)]),
    ("Gujarati", [(0xA80, 0xAFF)]),
    ("Oriya", [(0xB00, 0xB7F)]),
    ("Tamil", [(0xB80, 0xBFF)]),
    ("Telugu", [(0xC00, 0xC7F)]),
    ("Kannada", [(0xC80, 0xCFF)]),
    ("Malayalam", [(0xD00, 0xD7F)]),
    ("Sinhala", [(0xD80, 0xDFF)]),
    ("Thai", [(0xE00, 0xE7F)]),
    ("Lao", [(0xE80, 0xEFF)]),
    ("Tibetan", [(0xF00, 0xFFF)]),
    ("Myanmar", [(0x1000, 0x109F)]),
    ("Georgian", [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)]),
    ("Hangul", [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)]),
    ("Ethiopic", [(0x1200, 0x139F)]),
    ("Khmer", [(0x1780, 0x17FF)]),
    ("Mongolian", [(0x1800, 0x18AF)]),
    ("Kana", [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)]),
    ("Han", [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]),
]


def _letters() -> np.ndarray:
    """By code point: 255 for what is no letter, else the script's number."""
    table = np.zeros(0x110000, np.uint8)
    for n, (_, ranges) in enumerate(SCRIPTS, 1):
        for lo, hi in ranges:
            table[lo : hi + 1] = n
    return np.where([chr(c).isalpha() for c in range(0x110000)], table, 255).astype(np.uint8)


def letters() -> np.ndarray:
    return worker_cache("letters", _letters)


def pieces(text: str) -> Iterator[str]:
    """A text in lower case, cut at white space into pieces of bounded size; a longer word comes whole."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        yield text[at:end].lower()
        at = end


class Lexicon(dict):
    """Numbers of words in the order of their first use; ``names`` has the words."""

    def __init__(self, most: int):
        self.names: list[str] = []
        self.most, self.chars = most, 0

    def __missing__(self, word: str) -> int:
        self.names.append(word)
        self.chars += len(word)
        self[word] = n = len(self.names) - 1
        return n

    def full(self) -> bool:
        return len(self.names) > self.most or self.chars > CHARS_KEPT

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the number of each word, words of each text)."""
        try:
            whole = texts.to_pylist()
        except UnicodeDecodeError:
            whole = [x and x.decode("utf-8", "replace") for x in texts.cast(pa.binary()).to_pylist()]
        at, count = [np.zeros(0, np.int64)], np.zeros(len(whole), np.int64)
        for i, text in enumerate(whole):
            for piece in pieces(text or ""):
                words = piece.split()
                at.append(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))
                count[i] += len(words)
        return np.concatenate(at), count


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word of each n-gram, its bucket, letters of each word, script of each word or 255).

    Letters beside each other are a run; a word's other characters cut it. The script is that of most letters, of equals the first.
    """
    script = letters()
    code = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le", "replace"), np.uint32)
    code = np.where(code < 0x110000, code, 0xFFFD)
    size = np.fromiter(map(len, words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), size + 1)  # each word with the end behind it
    kind = script[code]
    is_letter = kind != 255
    mark = np.where(is_letter, code, 0).astype(np.uint64)
    which, bucket = [], []
    for n in ORDERS:
        if len(mark) < n:
            continue
        h = np.full(len(mark) - n + 1, 0x9E3779B97F4A7C15 * n % (1 << 64), np.uint64)
        letters_in = np.zeros(len(h), np.int8)
        for i in range(n):
            h = (h ^ mark[i : len(h) + i]) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(29)
            letters_in += is_letter[i : len(h) + i]
        # an n-gram is letters alone, or letters with one end at its begin or its end
        fine = (letters_in == n) | ((letters_in == n - 1) & (n > 1) & ~(is_letter[: len(h)] & is_letter[n - 1 :]))
        at = np.flatnonzero(fine)
        which.append(owner[at - (n == 1)])  # that of the second character, of one alone its own
        bucket.append((h[at] >> np.uint64(40)).astype(np.int64) % BUCKETS)
    count = np.bincount(owner[np.flatnonzero(is_letter) - 1], minlength=len(words))
    main = np.full(len(words), 255, np.uint8)
    at = np.flatnonzero(is_letter)
    if len(at):
        key = owner[at - 1] * 256 + kind[at]
        found, first, many = np.unique(key, return_index=True, return_counts=True)
        best = np.lexsort((first, -many, found // 256))
        top = best[np.unique(found[best] // 256, return_index=True)[1]]
        main[found[top] // 256] = (found[top] % 256).astype(np.uint8)
    return np.concatenate(which), np.concatenate(bucket), count, main


# learning


def _count(batches: Iterator[pa.RecordBatch], languages: list[str]) -> Iterator[pa.RecordBatch]:
    """A task's counts per language: n-grams by bucket, then letters by script, in rows of SLICE counts."""
    number = {x: i for i, x in enumerate(languages)}
    k = len(languages)
    total = np.zeros((k, BUCKETS + 256), np.int64)
    lexicon, times = Lexicon(WORDS_KEPT // k), np.zeros((k, 0), np.int64)

    def add() -> None:
        if lexicon.names:
            which, bucket, size, script = grams(lexicon.names)
            for i in range(k):
                total[i, :BUCKETS] += np.bincount(bucket, times[i, which], BUCKETS).astype(np.int64)
                total[i, BUCKETS:] += np.bincount(script, times[i] * size, 256).astype(np.int64)

    for b in batches:
        if lexicon.full():
            add()
            lexicon, times = Lexicon(WORDS_KEPT // k), np.zeros((k, 0), np.int64)
        at, count = lexicon.numbers(b.column(0))
        n = len(lexicon.names)
        times = np.pad(times, ((0, 0), (0, n - times.shape[1])))
        of = np.repeat(np.array([number[x] for x in b.column(1).to_pylist()], np.int64), count)
        times += np.bincount(of * n + at, minlength=k * n).reshape(k, n)
    add()
    wide = total.reshape(-1, SLICE)
    rows = np.flatnonzero(wide.any(1))
    for some in np.array_split(rows, max(1, len(rows) // 4096)):
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(c) for c in wide[some].T)], names=["slice", *(f"n{i}" for i in range(SLICE))])


def train(docs: DataFrame) -> dict:
    """The languages and their tables, from all documents with a language outside the held-out fold.

    Tasks hand on rows of counts, which Spark adds with map-side combine; the driver gets one row a slice, at most
    LANGUAGES * (BUCKETS + 256) numbers.
    """
    known = docs.select("text", F.col("lang").cast("string").alias("lang"), "doc_id").where(F.col("lang").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    top = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    languages = sorted(r.lang for r in top)
    if not languages:
        return {"languages": [], "table": np.zeros((0, 0)), "writes": np.zeros((0, 256), bool)}
    rows = known.where(F.col("lang").isin(languages)).select(F.col("text").cast("string").alias("text"), "lang")
    counted = map_arrow(rows, partial(_count, languages=languages), "slice long, " + ", ".join(f"n{i} long" for i in range(SLICE)))
    got = counted.groupBy("slice").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(SLICE))).toArrow()
    total = np.zeros((len(languages) * (BUCKETS + 256) // SLICE, SLICE), np.int64)
    total[got.column("slice").to_numpy()] = np.stack([got.column(f"n{i}").to_numpy() for i in range(SLICE)], 1)
    return model(languages, total.reshape(len(languages), BUCKETS + 256))


def model(languages: list[str], counts: np.ndarray) -> dict:
    n, letters_of = counts[:, :BUCKETS] + SMOOTHING, counts[:, BUCKETS:]
    table = (np.log(n) - np.log(n.sum(1, keepdims=True))) / len(ORDERS)
    share = letters_of / np.maximum(1, letters_of.sum(1, keepdims=True))
    return {"languages": languages, "table": np.ascontiguousarray(table.T), "writes": share >= SCRIPT_SHARE}


# labelling


def emissions(words: list[str], m: dict) -> tuple[np.ndarray, np.ndarray]:
    """(score of each word for each language, letters of each word); a word of no learned script scores 0 for all."""
    which, bucket, size, script = grams(words)
    if not m["languages"]:
        return np.zeros((len(words), 1)), size
    score = np.stack([np.bincount(which, m["table"][bucket, i], len(words)) for i in range(len(m["languages"]))], 1)
    score -= score.max(1, keepdims=True)
    writes = m["writes"][:, script].T
    known = writes.any(1, keepdims=True)
    return np.where(known, score - FOREIGN * ~writes, 0.0), size


def _step(v: np.ndarray, e: np.ndarray) -> np.ndarray:
    """One word on: stay, or switch from the best state; the first axis is states."""
    return np.maximum(v, v.max(0) - SWITCH) + e


def viterbi(at: np.ndarray, count: np.ndarray, score: np.ndarray) -> np.ndarray:
    """The label of each word of texts of ``count`` words, given as rows of ``score``; staying wins ties, then the first language."""
    k = score.shape[1]
    score = np.concatenate([score, np.zeros((1, k))]).T.copy()  # behind a text's end nothing changes
    parts = -(-count // SEGMENT)
    text = np.repeat(np.arange(len(count)), parts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(np.cumsum(count) - count, parts) + nth * SEGMENT
    size = np.minimum(SEGMENT, np.repeat(count, parts) - nth * SEGMENT)
    lanes = np.full((SEGMENT, len(text)), score.shape[1] - 1, np.int64)
    inside = np.arange(SEGMENT)[None] < size[:, None]
    lanes.T[inside] = at[(begin[:, None] + np.arange(SEGMENT)[None])[inside]]
    # what a segment does to each state, for all that have one behind them
    through = np.zeros((k, k, len(text)))  # by the last state, then by the one before the segment
    inner = np.flatnonzero(nth < parts[text] - 1)
    for some in np.array_split(inner, max(1, len(inner) * k * k // TABLE)):
        v = np.where(np.eye(k, dtype=bool), 0.0, -np.inf)[:, :, None].repeat(len(some), 2)
        for j in range(SEGMENT):
            v = _step(v, score[:, lanes[j, some]][:, None])
        through[:, :, some] = v
    start = np.zeros((k, len(text)))
    first = np.cumsum(parts) - parts
    for j in range(1, int(parts.max(initial=0))):
        some = first[parts > j] + j
        start[:, some] = (start[None, :, some - 1] + through[:, :, some - 1]).max(1)
    # the same forward with its choices, and from a segment's last states back to the ones before it
    stay = np.zeros((SEGMENT, k, len(text)), bool)
    best = np.zeros((SEGMENT, len(text)), np.uint8)
    v = start
    for j in range(SEGMENT):
        best[j] = v.argmax(0)
        stay[j] = v >= v.max(0) - SWITCH
        v = _step(v, score[:, lanes[j]])
    back = np.repeat(np.arange(k, dtype=np.uint8)[:, None], len(text), 1)
    lane = np.arange(len(text))
    for j in range(SEGMENT - 1, -1, -1):
        back = np.where(stay[j][back, lane], back, best[j])
    end = v.argmax(0)
    for j in range(int(parts.max(initial=0)) - 1, 0, -1):
        some = first[parts > j] + j
        end[some - 1] = back[end[some], some]
    labels = np.zeros((len(text), SEGMENT), np.uint8)
    now = end
    for j in range(SEGMENT - 1, -1, -1):
        labels[:, j] = now
        now = np.where(stay[j][now, lane], now, best[j])
    return labels[inside]


_LABELLED = "doc_id long, lang_pred string, score double, spans array<struct<lang: string, words: bigint>>"


def _label(batches: Iterator[pa.RecordBatch], m: dict) -> Iterator[pa.RecordBatch]:
    names = np.array([*m["languages"], UNKNOWN], object)
    k = len(m["languages"])
    lexicon, score, size = None, None, None
    for b in batches:
        if lexicon is None or lexicon.full():
            lexicon, score, size = Lexicon(WORDS_KEPT // max(1, k)), np.zeros((0, max(1, k))), np.zeros(0, np.int64)
        at, count = lexicon.numbers(b.column(1))
        if len(lexicon.names) > len(score):
            more, letters_of = emissions(lexicon.names[len(score) :], m)
            score, size = np.concatenate([score, more]), np.append(size, letters_of)
        label = viterbi(at, count, score)
        doc = np.repeat(np.arange(len(count)), count)
        weight = np.bincount(doc * max(1, k) + label, size[at] if len(at) else None, len(count) * max(1, k)).reshape(len(count), max(1, k))
        total = weight.sum(1)
        pick = np.where((total > 0) & (k > 0), weight.argmax(1), k)
        share = np.where(pick < k, weight.max(1, initial=0) / np.maximum(1, total), 0.0)
        turn = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (np.diff(label) != 0))) if len(doc) else np.zeros(0, np.int64)
        run = np.diff(np.append(turn, len(doc)))
        spans = pa.StructArray.from_arrays([pa.array(names[label[turn]] if k else names[np.zeros(len(turn), int)], pa.string()), pa.array(run, pa.int64())], ["lang", "words"])
        ends = np.searchsorted(doc[turn], np.arange(len(count) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[pick], pa.string()), pa.array(share), pa.ListArray.from_arrays(pa.array(ends), spans)], names=["doc_id", "lang_pred", "score", "spans"])


def spans(docs: DataFrame, m: dict | None = None) -> DataFrame:
    """(doc_id, lang_pred, score, spans), one row per row of ``docs``; ``spans`` has the language of each run of words.

    ``lang_pred`` has the most letters, of equals the first by name, and ``score`` is its share of them. Texts that are
    null or without a letter are ``und`` with score 0, as is everything where no language is known. Words
    without letters join the span beside them. ``m`` is a model of :func:`train`, by default of ``docs``.
    """
    m = train(docs) if m is None else m
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, partial(_label, m=m), _LABELLED)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per row of ``docs``; a null id counts as ''."""
    return spans(docs).select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
