"""Repeated passages: paragraph MinHash banding.

Where a passage begins must not matter, so paragraphs are chosen by content and not by lines. Of every
window of 51 words the five-word shingle with the least hash is the anchor, and a paragraph of 28 words
begins there if the anchor lies in the first half of the window and ends there if not. Two texts that
share 51 words in a row share a window and so a whole paragraph, wherever their lines break. A text of
28 to 50 words is one paragraph.

A paragraph's shingles are summarised by MinHash; the number of rows in a band is the most with which a
pair at the threshold still collides with a set probability. Identical paragraphs are one node from the
start. Colliding nodes are joined, verified by the exact Jaccard similarity of their shingles, and
clustered by connected components; in each cluster the first paragraph stays and the others are removals.

A bucket with many nodes, such as those that share a common line, does not emit its pairs. Its members are
banded again with more rows to a band; what is then still crowded is dealt into blocks, each pair of blocks
is compared in a task of its own by products of incidence matrices, and only a spanning forest of the
similar ones leaves it. No bucket is capped and no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tesserae.llm._shared import Scratch, connected_components, fresh, has_rows, map_arrow, ship

ship(__name__)

SHINGLE, SIMILARITY = 5, 0.8
#: Words of a window and of a paragraph; a paragraph begins or ends at the window's anchor.
WINDOW, WORDS = 51, 28
#: Bands of a first and of a crowded bucket's signature, and the least probability that a pair at the threshold shares one.
BANDS, DEEP_BANDS, RECALL = 4, 10, 0.98
#: A bucket with more nodes is banded again, and then dealt into blocks of so many; shingles of a product taken at once.
PAIRED, BUCKET_BLOCK, COLUMNS = 24, 512, 4096
SEED = 9
#: Bytes of text hashed together, and words whose paragraphs are chosen together.
CHUNK, BLOCK = 1 << 21, 1 << 19
#: Bits for each wanted paragraph of the filter that tells which ones need their shingles, and bits in all; a fuller one lets more through and loses none.
BITS_EACH, BITS_MOST = 16, 1 << 28


def band_rows(bands: int, similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """The most rows in each of ``bands`` with which a pair at the threshold still collides with the wanted probability."""
    rows = 1
    while 1 - (1 - similarity ** (rows + 1)) ** bands >= recall:
        rows += 1
    return rows


# words and shingles as numbers

_RNG = np.random.default_rng(SEED)
_BYTE = _RNG.integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_TIMES = _RNG.integers(0, 1 << 63, (2, WINDOW)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = _RNG.integers(0, 1 << 63, (2, 64)).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after the last) of every word of UTF-8 bytes, A-Z in lower case, cut at [\\x20\\x09-\\x0D]."""
    hashes, begins, ends, at = [], [], [], 0
    while at < len(data):
        stop = at + CHUNK
        if stop < len(data):  # go on to a space, so that no word is cut
            while stop < len(data) and data[stop] not in b" \t\n\x0b\x0c\r":
                stop += 1
        b = np.frombuffer(data, np.uint8, min(stop, len(data)) - at, at)
        space = np.concatenate([[True], _SPACE[b], [True]])
        edge = np.flatnonzero(space[1:] != space[:-1])
        s, e = edge[::2], edge[1::2]
        if len(s):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * _powers(_STEP, len(b)), dtype=np.uint64)])
            hashes.append(_mixed((total[e] - total[s]) * _powers(_BACK, len(b))[s]))
            begins.append(s + at)
            ends.append(e + at)
        at += len(b)
    none = np.zeros(0, np.int64)
    return np.concatenate([*hashes, none.astype(np.uint64)]), np.concatenate([*begins, none]), np.concatenate([*ends, none])


def shingles(word: np.ndarray) -> np.ndarray:
    """The hash of every five words in a row."""
    n = len(word) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return _mixed(sum(word[k : k + n] * _TIMES[0, k] for k in range(SHINGLE)))


def chosen(shingle: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The first words of the paragraphs of a run of texts; ``own`` tells the text of each word."""
    n = len(own) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = (shingle & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(shingle), dtype=np.uint64)
    wide = 1
    positions = WINDOW - SHINGLE + 1
    while 2 * wide <= positions:
        low = np.minimum(low[:-wide], low[wide:])
        wide *= 2
    low = np.minimum(low[:n], low[positions - wide : positions - wide + n])
    inside = np.flatnonzero(own[:n] == own[WINDOW - 1 :])
    anchor = (low[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return np.unique(np.where(anchor - inside <= WINDOW - WORDS, anchor, anchor + SHINGLE - WORDS))


def paragraphs_of(word: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words) of every paragraph of texts given by their words in a row, and all shingle hashes."""
    shingle, own = shingles(word), np.repeat(np.arange(len(sizes)), sizes)
    found = []
    for at in range(0, max(0, len(word) - WINDOW + 1), BLOCK):
        part = own[at : at + BLOCK + WINDOW - 1]
        found.append(chosen(shingle[at : at + len(part) - SHINGLE + 1], part) + at)
    first = np.unique(np.concatenate([*found, np.zeros(0, np.int64)]))
    begins = np.cumsum(sizes) - sizes
    short = (sizes >= WORDS) & (sizes < WINDOW)
    length = np.concatenate([np.full(len(first), WORDS), sizes[short]])
    first = np.concatenate([first, begins[short]])
    order = np.argsort(first, kind="stable")
    return first[order], length[order], shingle


def _ragged(shingle: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, place in its paragraph, begins) of paragraphs one after another."""
    count = length - SHINGLE + 1
    begins = np.cumsum(count) - count
    place = np.arange(count.sum()) - np.repeat(begins, count)
    return shingle[np.repeat(first, count) + place], place, begins


def nodes(flat: np.ndarray, place: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A hash of all words of each paragraph."""
    return _mixed(np.add.reduceat(flat * _TIMES[1, place], begins)).view(np.int64)


def bands(flat: np.ndarray, begins: np.ndarray, number: int, first: int = 0) -> np.ndarray:
    """The hashed bands of each paragraph's MinHash signature; ``first`` is the first of the hash functions to use."""
    rows = band_rows(number)
    out = np.zeros((len(begins), number), np.uint64)
    for b in range(number):
        for f in range(first + b * rows, first + (b + 1) * rows):
            least = np.minimum.reduceat(_mixed(flat * _ODD[0, f] + _ODD[1, f]), begins)
            out[:, b] = _mixed(out[:, b] * np.uint64(_STEP) + least)
    return _mixed(out + _ODD[1, :number])


# paragraphs of documents


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(row, doc_id, texts as bytes) of few documents at a time."""
    context = TaskContext.get()
    row = (context.partitionId() if context else 0) << 40
    for b in batches:
        held, ids, size, at = [], [], 0, row
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
            held.append((text.as_py() or "").encode("utf-8", "replace"))
            ids.append(doc_id)
            size += len(held[-1])
            if size >= CHUNK:
                yield at, ids, held
                at += len(ids)
                held, ids, size = [], [], 0
        if held:
            yield at, ids, held
        row += b.num_rows


def _split(texts: list[bytes]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    each = [words(t) for t in texts]
    sizes = np.array([len(e[0]) for e in each])
    first, length, shingle = paragraphs_of(np.concatenate([e[0] for e in each]), sizes)
    return each, sizes, first, length, shingle


def _places(text: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets as places and lengths in characters."""
    if text.isascii():
        return begin, end - begin
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return chars[begin], chars[end] - chars[begin]


def _lists(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(values))


def _paragraphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, ids, texts in _batches(batches):
        each, sizes, first, length, shingle = _split(texts)
        if not len(first):
            continue
        base = np.cumsum(sizes) - sizes
        doc = np.searchsorted(np.cumsum(sizes), first, side="right")
        lo = np.searchsorted(doc, np.arange(len(texts) + 1))
        some = np.flatnonzero(np.diff(lo))
        hashes = np.array([xxh64_intdigest(texts[d], 42) for d in some], np.uint64).view(np.int64)
        start, chars = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        for d in some.tolist():
            at = slice(lo[d], lo[d + 1])
            f = first[at] - base[d]
            start[at], chars[at] = _places(texts[d], each[d][1][f], each[d][2][f + length[at] - 1])
        flat, place, begins = _ragged(shingle, first, length)
        node, band = nodes(flat, place, begins), bands(flat, begins, BANDS).view(np.int64)
        # neighbours that overlap and share a band stand under its key together: they are the same place
        apart = np.concatenate([[True], (doc[1:] != doc[:-1]) | (first[1:] >= first[:-1] + length[:-1])])
        chains = []
        for b in range(BANDS):
            at = np.flatnonzero(apart | np.concatenate([[True], band[1:, b] != band[:-1, b]]))
            chains.append((at, band[at, b], np.diff(np.append(at, len(first)))))
        at, key, count = (np.concatenate(x) for x in zip(*chains))
        order = np.argsort(at, kind="stable")
        at, key, count = at[order], key[order], count[order]
        cut, key_cut = np.append(lo[some], len(first)), np.append(np.searchsorted(at, lo[some]), len(at))
        columns = [pa.array(row + some), pa.array([ids[d] for d in some], pa.int64()), pa.array(hashes), _lists(start, cut), _lists(chars, cut), _lists(length.astype(np.int32), cut), _lists(node, cut)]
        columns += [_lists(key, key_cut), _lists((at - lo[doc[at]]).astype(np.int32), key_cut), _lists(count.astype(np.int32), key_cut)]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "text_hash", "start", "length", "words", "node", "key", "first", "count"])


_SCHEMA = "row long, doc_id long, text_hash long, start array<long>, length array<long>, words array<int>, node array<long>, key array<long>, first array<int>, count array<int>"


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with paragraphs: of each its place in characters and a hash of its words (node), and the keys of its bands with the paragraphs under them."""
    return map_arrow(_texts(docs, id_col, text_col), _paragraphs, _SCHEMA)


# shingles of those that collide


def _probes(node: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = node.view(np.uint64)
    return (h % np.uint64(bits)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(bits)).astype(np.int64)


_SLICES = 16


def _marked(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    out = np.zeros(bits // 8, np.uint8)
    for b in batches:
        for p in _probes(b.column(0).to_numpy(), bits):
            np.bitwise_or.at(out, p >> 3, (1 << (p & 7)).astype(np.uint8))
    for s, own in enumerate(np.split(out, _SLICES)):
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([own.tobytes()])], names=["slice", "bits"])


def _merged(rows: pa.Table) -> pa.Table:
    out = np.bitwise_or.reduce([np.frombuffer(x.as_buffer(), np.uint8) for x in rows.column("bits")])
    return pa.table({"slice": rows.column("slice")[:1], "bits": pa.array([out.tobytes()])})


def _filter(wanted: DataFrame) -> np.ndarray:
    """A Bloom filter of the column ``node``, of at most BITS_MOST bits, made in the tasks and merged slice by slice."""
    bits = min(BITS_MOST, max(1 << 10, 1 << (wanted.count() * BITS_EACH).bit_length()))
    marked = map_arrow(wanted, partial(_marked, bits=bits), "slice int, bits binary")
    out = np.zeros((_SLICES, bits // 8 // _SLICES), np.uint8)
    for r in marked.groupBy("slice").applyInArrow(_merged, "slice int, bits binary").toLocalIterator():
        out[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _sets(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    bits = shared.value
    for _, _, texts in _batches(batches):
        _, _, first, length, shingle = _split(texts)
        if not len(first):
            continue
        node = nodes(*_ragged(shingle, first, length))
        hit = np.ones(len(node), bool)
        for p in _probes(node, 8 * len(bits)):
            hit &= (bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0
        node, at = np.unique(node[hit], return_index=True)
        if len(node):
            flat, _, begins = _ragged(shingle, first[hit][at], length[hit][at])
            offsets = np.append(begins, len(flat)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.ListArray.from_arrays(pa.array(offsets), pa.array((flat >> np.uint64(32)).astype(np.uint32).view(np.int32)))], names=["node", "shingles"])


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles) of the wanted nodes, whose texts are read again; only they shuffle, with what a filter lets through by chance."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter(wanted))
    sets = map_arrow(_texts(docs, id_col, text_col), partial(_sets, shared=shared), "node long, shingles array<int>")
    sets = sets.groupBy("node").agg(F.first("shingles").alias("shingles"))
    return sets.join(wanted, "node", "left_semi").select("node", F.array_distinct("shingles").alias("shingles"))


# buckets


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[pa.Table]]:
    """Whole groups of rows that are sorted by the named columns; a group may cross batches."""
    kept: list[pa.Table] = []
    for b in batches:
        table = pa.Table.from_batches([b])
        k = np.stack([table.column(c).to_numpy() for c in names])
        cuts = (np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist()
        if kept and b.num_rows and any(kept[-1].column(c)[-1].as_py() != table.column(c)[0].as_py() for c in names):
            yield [pa.concat_tables(kept)]
            kept = []
        out, at = [], 0
        for cut in cuts:
            part = table.slice(at, cut - at)
            out.append(pa.concat_tables([*kept, part]) if kept else part)
            kept, at = [], cut
        if out:
            yield out
        if b.num_rows:
            kept.append(table.slice(at))
    if kept:
        yield [pa.concat_tables(kept)]


#: Keys whose repetitions a task takes out together.
KEYS = 400_000


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, nodes) under each key of documents (node, key, first, count); what a task has seen twice it hands on once."""
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        key, count, node = (np.concatenate(x) for x in zip(*held))
        begins = np.cumsum(count) - count
        own = np.unique(_signs(key, node, begins, count), return_index=True)[1]
        node = node[np.repeat(begins[own], count[own]) + _within(count[own])]
        return pa.RecordBatch.from_arrays([pa.array(key[own]), _lists(node, np.append(0, np.cumsum(count[own])))], names=["key", "nodes"])

    for b in batches:
        if not b.num_rows:
            continue
        flat = [b.column(c).flatten().to_numpy() for c in range(4)]
        offsets = b.column(0).offsets.to_numpy().astype(np.int64)
        per = np.diff(b.column(1).offsets.to_numpy())
        begin = np.repeat(offsets[:-1] - offsets[0], per) + flat[2]
        count = flat[3].astype(np.int64)
        held.append((flat[1], count, flat[0][np.repeat(begin, count) + _within(count)]))
        if sum(len(h[0]) for h in held) >= KEYS:
            yield out()
            held = []
    if held:
        yield out()


def _within(count: np.ndarray) -> np.ndarray:
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _signs(key: np.ndarray, node: np.ndarray, begins: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A hash of each key with its nodes in their order."""
    own = _mixed(node.view(np.uint64) + _within(count).astype(np.uint64) * np.uint64(_STEP))
    return _mixed(key.view(np.uint64) + (np.add.reduceat(own, begins) if len(begins) else own))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, nodes) in order: the pairs of nodes of different rows of small buckets, and the nodes of crowded ones (v null); a crowded one streams through."""

    def out(key, u, v) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["key", "u", "v"])

    def small(key: np.ndarray, node: np.ndarray, row: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Pairs of whole small buckets: each node with the one so many places behind it."""
        us, vs = [], []
        for d in range(1, PAIRED):
            if len(key) <= d or not (same := key[d:] == key[:-d]).any():
                break
            at = np.flatnonzero(same & (row[d:] != row[:-d]) & (node[d:] != node[:-d]))
            us.append(node[at])
            vs.append(node[at + d])
        if us:
            u, v = np.concatenate(us), np.concatenate(vs)
            pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1)
            yield out(np.zeros(pairs.shape[1], np.int64), pairs[0], pairs[1])

    none = np.zeros(0, np.int64)
    left, crowded, last_sign, rows = (none, none, none), None, None, 0
    for b in batches:
        if not b.num_rows:
            continue
        key, lists = b.column(0).to_numpy(), b.column(1)
        cut = lists.offsets.to_numpy().astype(np.int64)
        count, node = np.diff(cut), lists.flatten().to_numpy()
        sign = _signs(key, node, cut[:-1] - cut[0], count)
        new = np.concatenate([[last_sign is None or sign[0] != last_sign], sign[1:] != sign[:-1]])
        last_sign, keep = sign[-1], np.repeat(new, count)
        key, node, row = np.repeat(key, count)[keep], node[keep], np.repeat(np.arange(rows, rows + len(count)), count)[keep]
        rows += len(count)
        key, node, row = (np.concatenate(x) for x in zip(left, (key, node, row)))
        left = (none, none, none)
        if crowded is not None:  # the bucket that the last batch ended in
            n = int(np.searchsorted(key, crowded, side="right")) if len(key) else 0
            if n:
                yield out(key[:n], node[:n], [None] * n)
            key, node, row = key[n:], node[n:], row[n:]
        if not len(key):
            continue
        crowded = None
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(begins, len(key)))
        many = np.repeat(size > PAIRED, size)
        whole = np.arange(len(key)) < begins[-1]
        pick = whole & ~many
        yield from small(key[pick], node[pick], row[pick])
        full = many if many[-1] else many & whole
        if full.any():
            yield out(key[full], node[full], [None] * int(full.sum()))
        if many[-1]:
            crowded = key[-1]
        else:
            left = (key[begins[-1] :], node[begins[-1] :], row[begins[-1] :])
    yield from small(*left)


def _collide(keys: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """(u, v) of small buckets of ``keys`` (key, nodes), and (key, node) of crowded ones."""
    parts = max(1, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = scratch.write(map_arrow(keys.repartition(parts, "key").sortWithinPartitions("key", "nodes"), _buckets, "key long, u long, v long"), name)
    return rows.where("v is not null").select("u", "v").distinct(), rows.where("v is null").select("key", F.col("u").alias("node")).distinct()


def _deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, shingles) under the bands of a longer signature."""
    for b in batches:
        if b.num_rows:
            lists = b.column(2)
            begins = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
            flat = lists.flatten().to_numpy().view(np.uint32).astype(np.uint64) << np.uint64(32)
            deep = bands(flat, begins, DEEP_BANDS, BANDS * band_rows(BANDS))
            key = _mixed((b.column(0).to_numpy().view(np.uint64)[:, None] + _ODD[0, :DEEP_BANDS]) * np.uint64(_STEP) + deep)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(b.column(1).to_numpy(), DEEP_BANDS))], names=["key", "node"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    a = sets.select(F.col("node").alias("u"), F.col("shingles").alias("su"))
    b = sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv"))
    both = F.size(F.array_intersect("su", "sv"))
    return pairs.join(a, "u").join(b, "v").where(both >= F.lit(SIMILARITY) * (F.size("su") + F.size("sv") - both)).select("u", "v")


def _forest(rows: pa.Table) -> list[tuple[int, int]]:
    """(u, v) edges that join the similar paragraphs of one group of at most two blocks; intersections are products of incidence matrices."""
    n = rows.num_rows
    if n < 2:
        return []
    sets = rows.column("shingles").combine_chunks()
    size = np.diff(sets.offsets.to_numpy())
    owner = np.repeat(np.arange(n), size)
    _, column, times = np.unique(sets.flatten().to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((n, n), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        m = np.zeros((n, min(COLUMNS, int(column[-1]) + 1 - at)), np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        both += m @ m.T
    near = both >= SIMILARITY * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(near, False)
    node, root = rows.column("node").to_numpy(), np.full(n, -1)
    for s in np.flatnonzero(near.any(1)):
        if root[s] < 0:
            root[s], front = s, np.array([s])
            while len(front):
                front = np.flatnonzero(near[front].any(0) & (root < 0))
                root[front] = s
    at = np.flatnonzero((root >= 0) & (root != np.arange(n)))
    return list(zip(node[at].tolist(), node[root[at]].tolist()))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forests of groups (key, i, j) in sorted rows."""
    for groups in _runs(batches, ["key", "i", "j"]):
        found = [e for g in groups for e in _forest(g)]
        if found:
            u, v = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def links(paras: DataFrame, docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(u, v): similar nodes of documents' paragraphs found by the bands: all pairs of small buckets, a spanning forest of each block pair of those still crowded."""
    spark = docs.sparkSession
    keys = map_arrow(paras.select("node", "key", "first", "count"), _keys, "key long, nodes array<long>")
    pairs, many = _collide(keys, scratch, "collisions")
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node"))
    wanted = scratch.write(ends.unionByName(many.select("node")).distinct(), "wanted")
    sets = scratch.write(shingle_sets(docs, wanted, id_col, text_col), "sets")
    found = scratch.write(_verified(pairs, sets), "links")
    if not has_rows(many):
        return found
    deeper = map_arrow(many.join(sets, "node").select("key", "node", "shingles"), _deeper, "key long, node long").distinct().select("key", F.array("node").alias("nodes"))
    pairs, many = _collide(deeper, scratch, "deeper")
    found = found.unionByName(scratch.write(_verified(pairs, sets), "deeper-links"))
    if not has_rows(many):
        return found
    n = many.groupBy("key").agg(F.count("*").alias("n"))
    many = many.join(n, "key").withColumn("nb", F.ceil(F.col("n") / BUCKET_BLOCK).cast("int")).withColumn("b", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    dealt = many.join(sets, "node").withColumn("x", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("key", F.least("b", "x").alias("i"), F.greatest("b", "x").alias("j"), "node", "shingles")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    return found.unionByName(scratch.write(map_arrow(dealt, _compared, "u long, v long"), "crowded"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per paragraph that occurs again, identical or similar, in another document or elsewhere in its own.

    Columns: doc_id, paragraph (its number in the text), start and length in characters, words,
    component_id, keep_doc_id and keep_start (the first paragraph of its cluster), group_size (paragraphs
    in the cluster), kept boolean (true for the first paragraph and those of its document that overlap it).
    Every passage of 51 words in a row that occurs twice has a row for each of its places; so may similar ones and shorter ones
    from 28 words. Paragraphs of one text that overlap are no repeats of each other. Similarity counts
    distinct five-word shingles with A-Z in lower case.
    Null and empty texts and those of fewer than 28 words give no rows; repeated rows repeat their
    paragraphs; a null doc_id sorts first. An empty table gives an empty result; other columns are ignored.
    """
    columns = ["doc_id", "paragraph", "start", "length", "words", "component_id", "keep_doc_id", "keep_start", "group_size", "kept"]
    return _members(docs, id_col, text_col).select(*columns)


def _members(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of :func:`repeats`, each with the hash of its text."""
    scratch = Scratch(docs.sparkSession, "substring")
    paras = scratch.write(paragraphs(docs, id_col, text_col), "paragraphs")
    each = F.explode(F.expr("transform(node, (n, i) -> struct(i as paragraph, start[i] as start, length[i] as length, words[i] as words, n as node))")).alias("p")
    light = paras.select("row", "doc_id", "text_hash", each).select("row", "doc_id", "text_hash", F.col("p.paragraph").cast("long").alias("paragraph"), "p.start", "p.length", F.col("p.words").cast("long").alias("words"), "p.node")
    comp = scratch.write(connected_components(links(paras, docs, scratch, id_col, text_col), scratch), "components")
    scratch.drop("collisions", "wanted", "sets", "links", "deeper", "deeper-links", "crowded")
    twice = light.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")
    some = twice.unionByName(comp.select("node")).distinct()
    some = scratch.write(some.join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("component_id")), "some")
    members = scratch.write(light.join(some, "node").drop("node"), "members")
    scratch.drop("paragraphs", "components", "some")
    first = F.min(F.struct("doc_id", "start", "length", "row")).alias("keep")
    groups = members.groupBy("component_id").agg(
        first, F.count("*").alias("group_size"), F.min("row").alias("low"), F.max("row").alias("high"), F.max("start").alias("last"), F.min(F.col("start") + F.col("length")).alias("end")
    )
    groups = scratch.write(groups.where("low <> high or last >= end").select("component_id", "keep", "group_size"), "groups")
    kept = (F.col("row") == F.col("keep.row")) & (F.col("start") < F.col("keep.start") + F.col("keep.length"))
    return members.join(groups, "component_id").withColumns({"keep_doc_id": F.col("keep.doc_id"), "keep_start": F.col("keep.start"), "kept": kept})


def _cut(text: str, spans: list[dict]) -> str:
    """The text without the spans (start, end), which are in order and may overlap."""
    out, at = [], 0
    for s in spans:
        if s["start"] > at:
            out.append(text[at : s["start"]])
        at = max(at, s["end"])
    return "".join(out) + text[at:]


def _without(batches: Iterator[pa.RecordBatch], column: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cut = [t and _cut(t, s) if s else t for t, s in zip(b.column(column).to_pylist(), b.column(b.num_columns - 1).to_pylist())]
        columns = b.columns[:-1]
        columns[column] = pa.array(cut, pa.string())
        yield pa.RecordBatch.from_arrays(columns, names=names)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all removals of :func:`repeats` cut out of their texts; all columns stay.

    Only whole paragraphs are cut, so up to 23 words at either end of a repeated passage may stay. Rows
    with the same id (or none) and the same text keep what any of them keeps. Null texts stay null.
    """
    members = _members(docs, id_col, text_col)
    spans = members.groupBy("doc_id", "text_hash", "start", "length").agg(F.bool_or("kept").alias("kept")).where("not kept")
    spans = spans.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("spans"))
    a, b, c = (fresh(n, docs.columns) for n in ("id", "hash", "spans"))
    spans = spans.select(F.col("doc_id").alias(a), F.col("text_hash").alias(b), F.col("spans").alias(c))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.join(spans, F.col(id_col).cast("long").eqNullSafe(F.col(a)) & (F.xxhash64(text) == F.col(b)), "left").select(*docs.columns, c)
    at = docs.columns.index(text_col)
    return map_arrow(rows.withColumn(text_col, F.col(text_col).cast("string")), partial(_without, column=at, names=docs.columns), docs.withColumn(text_col, F.col(text_col).cast("string")).schema)
