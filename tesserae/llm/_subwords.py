"""Subword ids of whole texts, each distinct word tokenised once a worker."""

from __future__ import annotations

import sys
import types
import unicodedata
from array import array
from itertools import chain

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tesserae.llm._shared import ship

ship(__name__)

DEFAULT = public_tokenizers.path("word_bpe_49k.json")
#: Entries kept of words as written and of words without case and closing marks, and bytes of either; a full cache is emptied, but for words that are kept for good.
WORDS_KEPT, CORES_KEPT, BYTES_KEPT = 800_000, 500_000, 64_000_000
_CLOSING = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"


def worker_cache(name: str, make):
    """An object that lives as long as the Python worker; functions sent by value have new globals for each task."""
    module = sys.modules.setdefault("_tesserae_worker", types.ModuleType("_tesserae_worker"))
    if not hasattr(module, name):
        setattr(module, name, make())
    return getattr(module, name)


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write the UTF-8 bytes of U+0080 to U+00FF: a byte that prints stands for itself, the others follow U+00FF in order."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(prints))}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0x80, 0x100)}


_BYTES = _byte_letters()


def _ends_in_letter(core: str) -> bool:
    """Whether a letter is last in the form that the vocabulary splits: composed, then in lower case, where a mark may follow the letter."""
    if not core[-1].isalpha():
        return False
    return core.isascii() or unicodedata.normalize("NFC", core).lower()[-1].isalpha()


class _Index(dict):
    """Numbers of words in the order of their first use; ``names`` has the words."""

    def __init__(self):
        self.names: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.names.append(word)
        self[word] = n = len(self.names) - 1
        return n


class WordTokenizer:
    """Exact ids of a tokenizer that never joins across white space, such as a BPE with word ends.

    A text's ids are those of its words in turn, so words are numbered, and what belongs to a number is looked up in
    arrays. A new word whose normal form ends in a
    letter followed by ASCII marks has the ids of its lower-cased core and those of the marks: the
    vocabulary's own pattern separates them and its normaliser composes and lower-cases. Cores of Latin letters alone go to
    the vocabulary's merges directly, where a few probes show that this is the same. Other words go through whole.
    """

    def __init__(self, path: str = DEFAULT, words: int = 1, cores: int = 1):
        """The caches have one part in ``words`` and one in ``cores`` of their usual size."""
        self.tok, self.shares = Tokenizer.from_file(path), (words, cores)
        self.bar = self.tok.encode("|", add_special_tokens=False).ids
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"  # native order, as Python workers and numpy views have it
        self.cores: dict[str, bytes] = {}
        self.cores_held, self.turn = 0, 0
        self.kept, self.key = 0, None
        self._forget()
        letters = [chr(c) for c in range(0xAA, 0x100) if chr(c).isalpha() and chr(c) == chr(c).lower()]
        probes = ["the", "a", "internationalisation", "qzxvk", *letters, "".join(letters), *(f"re{c}st{c}d" for c in letters)]
        self.plain = self._same(probes)

    def _forget(self) -> None:
        """Empty the index but for the words that are kept; ``turn`` tells that numbers have another meaning now."""
        self.held, self.turn = 0, self.turn + 1
        if not self.kept:
            self.index = _Index()
            self.flat, self.size, self.start = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        for word in self.index.names[self.kept :]:
            del self.index[word]
        del self.index.names[self.kept :]
        self.size, self.start = self.size[: self.kept].copy(), self.start[: self.kept].copy()
        self.flat = self.flat[: int(self.size.sum())].copy()

    def keep(self, words: list[bytes], key: str) -> None:
        """From now on the numbers from 0 are of ``words``, which are different and stay; nothing is done for the ``key`` of the last call."""
        if key == self.key:
            return
        self.kept = 0
        self._forget()
        for at in range(0, len(words), 1 << 14):
            self.numbers([words[at : at + (1 << 14)]])
            self.kept = len(self.index.names)
        self.held, self.key = 0, key

    def _same(self, probes: list[str]) -> bool:
        whole = [e.ids for e in self.tok.encode_batch_fast(probes, add_special_tokens=False)]
        try:
            return whole == [self._merged(p) for p in probes]
        except Exception:  # another kind of model
            return False

    def _merged(self, core: str) -> list[int]:
        return [t.id for t in self.tok.model.tokenize(core if core.isascii() else core.translate(_BYTES))]

    def _split(self, word: bytes) -> tuple[str, str]:
        text = word.decode("utf-8", "replace")
        core = text.rstrip(_CLOSING)
        if "<|" in text or not core or not _ends_in_letter(core):
            return text, ""
        return (core.lower() if core.isascii() or max(core) <= "\xff" else core), text[len(core):]

    def _learn(self, new: list[bytes]) -> None:
        parts = [self._split(w) for w in new]
        unknown = list({p for pair in parts for p in pair if p and p not in self.cores})
        if len(self.cores) > CORES_KEPT // self.shares[1] or self.cores_held > BYTES_KEPT // self.shares[1]:
            self.cores.clear()
            self.cores_held = 0
            unknown = list({p for pair in parts for p in pair if p})
        self.cores_held += sum(map(len, unknown))
        plain, odd = [], []
        for p in unknown:
            if self.plain and p.isalpha() and len(p) < 64 and max(p) <= "\xff" and p == p.lower():
                self.cores[p] = array(self.code, self._merged(p)).tobytes()
            else:
                (odd if "|" in p else plain).append(p)
        for p, e in zip(odd, self.tok.encode_batch_fast(odd, add_special_tokens=False)):
            self.cores[p] = np.array(e.ids, self.dtype).tobytes()
        groups = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        for group, e in zip(groups, self.tok.encode_batch_fast([" | ".join(g) + " |" for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, self.dtype)
            at = 0
            for p, end in zip(group, np.flatnonzero(ids == self.bar[0]).tolist()):
                self.cores[p] = ids[at:end].tobytes()
                at = end + 1
        self.cores[""] = b""
        each = [self.cores[core] + self.cores[marks] for core, marks in parts]
        size = np.fromiter(map(len, each), np.int64, len(each)) // self.dtype.itemsize
        self.start = np.append(self.start, len(self.flat) + np.cumsum(size) - size)
        self.flat, self.size = np.append(self.flat, np.frombuffer(b"".join(each), self.dtype)), np.append(self.size, size)
        self.held += sum(map(len, new))

    def numbers(self, split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(the number of each word, how many words each text has) of texts given as their words; the ids of new words are learned."""
        if len(self.index.names) - self.kept > WORDS_KEPT // self.shares[0] or self.held > BYTES_KEPT // self.shares[0]:
            self._forget()
        count = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int64, int(count.sum()))
        if len(self.index.names) > len(self.size):
            self._learn(self.index.names[len(self.size) :])
        return at, count

    def ids(self, at: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
        """The ids of texts given as numbers of words."""
        size = self.size[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat[np.arange(total) + np.repeat(self.start[at] - ends + size, size)]
        words = np.cumsum(count)
        cut = np.where(words > 0, ends[np.maximum(words, 1) - 1], 0) if len(ends) else np.zeros(len(count), np.int64)
        return np.split(flat, cut[:-1]) if len(count) else []

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        return self.encode_words([(t or "").encode("utf-8", "replace").split() for t in texts])

    def encode_words(self, split: list[list[bytes]]) -> list[np.ndarray]:
        """The ids of texts given as their words."""
        return self.ids(*self.numbers(split))


def tokenizer(path: str, words: int = 1, cores: int = 1) -> WordTokenizer:
    """The worker's tokenizer for a vocabulary file, with one part in so many of the usual caches."""
    return worker_cache(f"tok_{abs(hash(path))}_{words}_{cores}", lambda: WordTokenizer(path, words, cores))


def by_size(rows: list, size, most: int = 2_000_000, rows_most: int = 256):
    """Slices of ``rows`` of a bounded total size; a larger row comes alone."""
    out, total = [], 0
    for r in rows:
        n = size(r)
        if out and (total + n > most or len(out) >= rows_most):
            yield out
            out, total = [], 0
        out.append(r)
        total += n
    if out:
        yield out
