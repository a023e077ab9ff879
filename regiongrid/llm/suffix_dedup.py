"""Exact removal of repeated byte strings with two-stage suffix sorting.

A byte goes if it lies in a string of ``width`` bytes that also starts earlier,
in a document of smaller doc_id or further up in the same one.

1. Blocks. Documents are stored once, compressed, in blocks of a few MB.
2. Anchors. Each ``width``-byte string is led to the positions in it where the
   hash of ``GRAM`` bytes is least; equal strings have equal anchors at equal
   places, so any two occurrences of a string meet at an anchor. About one byte
   in forty is an anchor. What surrounds it, as far as a string that holds it can
   reach, is its context. Equal contexts within a block are settled there, so a
   passage that a third of all documents share is at most one row a block.
3. Anchors are shuffled by their hash and sorted; an equal context (by a digest of
   128 bits) repeats an earlier one in full. Contexts that share the anchor but differ go on.
4. These contexts are read from their blocks and shuffled by anchor. In each
   batch of whole anchor groups, bounded in bytes, the suffixes are sorted in two
   stages (suffixes smaller than their successors directly, the others induced by
   bucket scans), and runs of adjacent common prefixes of ``width`` bytes are the
   repeats. Strings whose common bytes no other context of the group has are left
   out before.
5. An anchor with more than ``HOT`` different contexts (the edge of a passage that
   very many documents share) would make one group too large for a task. Its
   contexts are not gathered: they are cut into runs of neighbouring strings, and
   the bytes that a run's strings have in common are counted with partial sums.
   Runs whose bytes occur once repeat nothing; those whose bytes occur up to
   ``HOT`` times form groups of their own in stage 4; the strings of the others
   meet by a digest of 128 bits, once a batch.
6. The marked spans meet their blocks again, and the rest of each text is kept.

No stage needs more than its own rows; blocks, anchors and contexts scale with
the input, and no task holds more than ``HOT`` contexts of an anchor.

Defined results: null text is empty; rows that share a doc_id are ordered as
they lie in the input; null ids come first; an empty table gives an empty table;
other columns are ignored. Texts are whole; nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, BYTES, INVERSE, map_arrow, materialise, mix, powers, sized

WIDTH = 100
GRAM = 24
BLOCK_BYTES = 2_000_000  # of text in a block, unless one text is longer
BATCH_BYTES = 300_000  # of contexts whose suffixes are sorted together, unless one anchor has more
HOT = 4_000  # contexts of one anchor that one task may hold: 0.7 MB
RUN_BYTES = 500_000  # of text whose anchors are found together, unless one text is longer
NULL_ID = -(2**63)
BLOCK_SCHEMA = "block long, ids array<long>, sizes array<long>, data binary"


# ---------------------------------------------------------------- suffix array
def _direct_order(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """``at`` ordered by the ``depth`` bytes that follow each position.

    Words of eight bytes are compared in turn, and only among what is still tied.
    """
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    words = np.ndarray(len(padded) - 7, dtype=">u8", buffer=padded.data, strides=(1,))
    key = words[at].astype(np.uint64)
    o = np.argsort(key)
    order, key = at[o], key[o]
    new = np.append(True, key[1:] != key[:-1])
    tied = np.arange(len(at), dtype=np.int32)
    for shift in range(8, depth, 8):
        group = np.cumsum(new) - 1  # of what was tied
        still = np.bincount(group)[group] > 1
        tied, group = tied[still], group[still]
        if not len(tied):
            break
        key = words[order[tied] + shift].astype(np.uint64)
        o = np.argsort(key)
        key = key[o]
        place = np.empty(len(o), np.int64)  # of the key among all keys
        place[o] = np.cumsum(np.append(False, key[1:] != key[:-1]))
        place += group * len(o)
        o = np.argsort(place)
        order[tied] = order[tied[o]]
        place = place[o]
        new = np.append(True, place[1:] != place[:-1])
    return order


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` (bytes, none smaller than the last of them) by two-stage sorting.

    Suffixes that are smaller than their successors are sorted directly, to
    ``depth`` bytes; the others are induced by one scan over the buckets of
    first bytes, in which they stand before the direct ones.
    """
    n = len(text)
    # smaller: by the first byte of the run that differs; the last run holds the end, which sorts first of all
    change = np.flatnonzero(text[1:] != text[:-1])
    ends = np.append(change, n - 1)
    smaller = np.repeat(np.append(text[change] < text[change + 1], True), np.diff(ends, prepend=-1))
    direct = _direct_order(text, np.flatnonzero(smaller).astype(np.int32), depth)
    heads = np.searchsorted(text[direct], np.arange(256)).tolist() + [len(direct)]  # direct suffixes by first byte
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        front = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, np.int32)
        layer = front
        parts = [front]
        while len(layer):  # induced within the same bucket
            p = layer[layer > 0] - 1
            layer = p[(text[p] == c) & ~smaller[p]]
            parts.append(layer)
        bucket = np.concatenate([*parts, direct[heads[c] : heads[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        p = bucket[bucket > 0] - 1
        p = p[(text[p] > c) & ~smaller[p]]
        if len(p):
            p = p[np.argsort(text[p], kind="stable")]
            cuts = np.flatnonzero(np.diff(text[p])) + 1
            for piece in np.split(p, cuts):
                waiting[text[piece[0]]].append(piece)
    return np.concatenate(out)


def common_prefix_at_least(text: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """Whether each suffix shares ``width`` bytes with the one before it in ``order``."""
    padded = np.concatenate([text, np.zeros(width + 8, np.uint8)])
    words = np.ndarray(len(padded) - 7, dtype="<u8", buffer=padded.data, strides=(1,))
    same = np.zeros(len(order), dtype=bool)
    left = np.arange(1, len(order), dtype=np.int32)
    for shift in [*range(0, width - 8, 8), width - 8]:
        left = left[words[order[left] + shift] == words[order[left - 1] + shift]]
    same[left] = True
    return same


def repeats(raw: np.ndarray, lengths: np.ndarray, text: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, start in it) of the ``width``-byte strings of contexts that start earlier elsewhere.

    ``raw`` holds the contexts, each followed by a byte 0 that is not part of it.
    ``text`` numbers the contexts' texts in document order and ``first`` says where
    in it a context starts; contexts of one text may overlap.
    """
    begin = (np.cumsum(lengths + 1) - lengths - 1).astype(np.int32)
    owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths + 1)
    order = suffix_array(raw, width)
    room = (begin + lengths.astype(np.int32))[owner] - np.arange(len(raw), dtype=np.int32) >= width
    order = order[room[order]]
    if not len(order):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    same = common_prefix_at_least(raw, order, width)
    group = np.cumsum(~same, dtype=np.int32) - 1
    o = owner[order]
    inner = order - begin[o]
    place = (text[o] << 40) + first[o] + inner
    least = np.minimum.reduceat(place, np.flatnonzero(~same))
    again = place > least[group]
    return o[again], inner[again]


# --------------------------------------------------------------------- anchors
def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


def anchors(data: bytes, sizes: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position in data, text number, hash) of the anchors of the texts in ``data``."""
    n = len(data)
    none = np.empty(0, np.int64)
    ends = np.cumsum(sizes)
    windows = np.maximum(0, sizes - width + 1)  # of each text
    if n < width or not windows.any():
        return none, none, none.astype(np.uint64)
    padded = data + b"\x00" * 8
    words = np.ndarray(n + 1, dtype="<u8", buffer=padded, strides=(1,))
    m = n - gram + 1
    with np.errstate(over="ignore"):
        h = np.zeros(m, np.uint64)
        for k in range(0, gram, 8):
            h = (h ^ words[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    rank = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    span = width - gram + 1
    least = _least(rank, span)  # of the window that starts here
    begin = ends - sizes
    valid = np.zeros(len(least) + 1, np.int8)
    has = windows > 0
    valid[begin[has]] += 1
    np.subtract.at(valid, begin[has] + windows[has], 1)
    least = least * (np.cumsum(valid[:-1], dtype=np.int32) > 0).astype(np.uint32)
    # a gram is an anchor if some window that holds it has it for its least
    side = np.zeros(span - 1, np.uint32)
    over = np.concatenate([side, least, side])[: m + span - 1]
    reach = ~_least(~over, span)
    at = np.flatnonzero(reach == rank)
    return at, np.searchsorted(ends, at, side="right"), h[at]


def reach_of(at: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(first, last + 1) byte of the context of the anchors."""
    side = width - gram
    return np.maximum(begin, at - side), np.minimum(end, at + gram + side)


# --------------------------------------------------------------- Spark stages
class _Blocks:
    def __init__(self, most: int):
        self.most = most

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 32, 0
        rows: list[tuple[int, bytes]] = []
        size = 0

        def block() -> pa.RecordBatch:
            nonlocal number, size
            rows.sort(key=lambda r: r[0])
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([base + number], pa.int64()),
                    pa.array([[r[0] for r in rows]], pa.list_(pa.int64())),
                    pa.array([[len(r[1]) for r in rows]], pa.list_(pa.int64())),
                    pa.array([zstandard.ZstdCompressor(level=3).compress(b"".join(r[1] for r in rows))], pa.binary()),
                ],
                names=["block", "ids", "sizes", "data"],
            )
            rows.clear()
            number, size = number + 1, 0
            return out

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                rows.append((NULL_ID if doc is None else doc, (text.as_py() or "").encode("utf-8", "surrogatepass")))
                size += len(rows[-1][1])
                if size >= self.most:
                    yield block()
        if rows:
            yield block()


def _opened(batch: pa.RecordBatch, i: int) -> tuple[int, np.ndarray, np.ndarray, bytes]:
    ids = np.array(batch.column("ids")[i].as_py(), np.int64)
    sizes = np.array(batch.column("sizes")[i].as_py(), np.int64)
    data = zstandard.ZstdDecompressor().decompress(batch.column("data")[i].as_py())
    return batch.column("block")[i].as_py(), ids, sizes, data


#: context and other: a 128-bit digest of the context
FOUND = "kind byte, key long, context long, other long, doc_id long, block long, text int, pos long, first long, last long"
_FOUND_TYPES = [pa.int8(), *[pa.int64()] * 5, pa.int32(), *[pa.int64()] * 3]
_FOUND_NAMES = [f.split()[0] for f in FOUND.split(", ")]
MARK, ANCHOR, NEED = 0, 1, 2


def _rows(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _FOUND_TYPES, strict=True)], names=_FOUND_NAMES)


def _spans(block: np.ndarray, text: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[pa.RecordBatch]:
    """MARK rows of the union of spans."""
    if not len(text):
        return
    o = np.lexsort((first, text, block))
    block, text, first, last = block[o], text[o], first[o], last[o]
    apart = np.append(True, (text[1:] != text[:-1]) | (block[1:] != block[:-1]))
    step = (np.cumsum(apart) - 1) * (int(last.max()) + 1)  # lifts each text above those before it
    high = np.maximum.accumulate(last + step) - step
    at = np.flatnonzero(apart | np.append(True, first[1:] > high[:-1]))
    stop = np.append(at[1:], len(text)) - 1
    n = len(at)
    zero = np.zeros(n, np.int64)
    key = text[at] * 0x9E3779B1 + block[at]  # only spreads the rows
    yield _rows(np.full(n, MARK, np.int8), key, zero, zero, zero, block[at], text[at].astype(np.int32), zero, first[at], high[stop])


def _once(block, ids, begin, text, key, digest, at, low, high) -> Iterator[pa.RecordBatch]:
    """ANCHOR rows of the first of equal (key, digest) in a block, marks of the others."""
    context, other = digest[:, 0], digest[:, 1]
    o = np.lexsort((at, other, context, key))
    again = np.zeros(len(at), bool)
    again[o[1:]] = (key[o][1:] == key[o][:-1]) & (digest[o][1:] == digest[o][:-1]).all(1)
    b = begin[text]
    yield from _spans(np.full(again.sum(), block), text[again], (low - b)[again], (high - b)[again])
    k = ~again
    yield _rows(
        np.full(k.sum(), ANCHOR, np.int8), key[k].view(np.int64), context[k].view(np.int64), other[k].view(np.int64), ids[text[k]],
        np.full(k.sum(), block), text[k].astype(np.int32), (at - b)[k], (low - b)[k], (high - b)[k],
    )


class _Find:
    """Anchors of each block, once for each context; repeats within the block as marks."""

    def __init__(self, width: int, gram: int):
        self.width, self.gram = width, gram

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, ids, sizes, data = _opened(batch, i)
                begin = np.cumsum(sizes) - sizes
                found, done = [], 0
                for stop in _pieces(np.arange(1, len(sizes) + 1), np.append(0, np.cumsum(sizes)), RUN_BYTES):
                    first, last = int(begin[done]), int(begin[stop - 1] + sizes[stop - 1])
                    own = anchors(data[first:last], sizes[done:stop], self.width, self.gram)
                    found.append((own[0] + first, own[1] + done, own[2]))
                    done = stop
                at, text, key = (np.concatenate(x) for x in zip(*found, strict=True))
                if not len(at):
                    continue
                low, high = reach_of(at, begin[text], begin[text] + sizes[text], self.width, self.gram)
                view, of = memoryview(data), xxhash.xxh3_128_digest
                each = zip(low.tolist(), high.tolist(), (at - low).tolist(), strict=True)
                digest = np.frombuffer(b"".join([of(view[a:b], c) for a, b, c in each]), np.uint64).reshape(-1, 2)
                yield from _once(block, ids, begin, text, key, digest, at, low, high)


def _heads_place(new: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """Whether each row has the place of the first row of its run, as contexts of one text overlap."""
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    return np.all([p == p[head] for p in place], axis=0)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of anchors sorted by key and context: marks of repeated contexts, needs where contexts differ.

    The last run of equal contexts is carried into the next batch, as its first
    row and whether a different context of its key came before it.
    """
    carry, carried = None, False
    for batch in batches:
        c = {n: batch.column(n).to_numpy() for n in _FOUND_NAMES}
        plain = c["kind"] == MARK
        if plain.any():
            yield batch.filter(pa.array(plain))
            c = {n: v[~plain] for n, v in c.items()}
        if not len(c["key"]):
            continue
        if carry is not None:
            c = {n: np.append(carry[n], v) for n, v in c.items()}
        key = c["key"]
        new = np.append(True, np.any([c[n][1:] != c[n][:-1] for n in ("key", "context", "other")], axis=0))
        run = np.flatnonzero(new)
        near = key[run][1:] == key[run][:-1]
        need = np.append(carried if carry is not None else False, near) | np.append(near, False)
        rest = np.flatnonzero(~new & ~_heads_place(new, c["block"], c["text"], c["pos"]))
        if len(rest):
            yield _rows(np.full(len(rest), MARK, np.int8), *[c[n][rest] for n in _FOUND_NAMES[1:]])
        carry, carried = {n: v[run[-1:]] for n, v in c.items()}, bool(need[-1])
        if len(out := run[:-1][need[:-1]]):
            yield _rows(np.full(len(out), NEED, np.int8), *[c[n][out] for n in _FOUND_NAMES[1:]])
    if carry is not None and carried:
        yield _rows(np.full(1, NEED, np.int8), *[carry[n] for n in _FOUND_NAMES[1:]])


CONTEXT = "key long, doc_id long, block long, text int, first long, at long, bytes binary"


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts that a block's ``wanted`` list names."""
    for batch in batches:
        for i in range(batch.num_rows):
            block, ids, sizes, data = _opened(batch, i)
            begin = np.cumsum(sizes) - sizes
            w = batch.column("wanted")[i].values
            key, text, pos, first, last = (w.field(n).to_numpy() for n in ("key", "text", "pos", "first", "last"))
            b = begin[text]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key), pa.array(ids[text]), pa.array(np.full(len(key), block)), pa.array(text), pa.array(first), pa.array(pos - first),
                    pa.array([data[x:y] for x, y in zip((b + first).tolist(), (b + last).tolist(), strict=True)], pa.binary()),
                ],
                names=["key", "doc_id", "block", "text", "first", "at", "bytes"],
            )


SEGMENTS = 8  # runs of start positions whose common bytes are looked up before sorting
HOT_SEGMENTS = 4  # of the contexts of a hot anchor, which take a shuffled row a run


def _runs(width: int, gram: int, number: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, width - gram + 1, number + 1).astype(int).tolist()
    return list(zip(edges, edges[1:], strict=False))


def _cores(at: int, size: int, width: int, gram: int, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
    """(run, first, last + 1 byte of its common bytes, least and greatest b) of a context of ``size`` bytes.

    The strings of a context start ``b`` bytes before its anchor, b from 0 to
    width - gram. All strings of a run of such b have bytes in common; a run whose
    common bytes no other context of the anchor has, holds no repeat.
    """
    low, high = max(0, at + width - size), min(at, width - gram)  # possible b
    for i, (a, b) in enumerate(runs):
        if a <= high and b > low:
            yield i, at - a, at - b + 1 + width, max(a, low), min(b - 1, high)


def shorten(key: np.ndarray, at: np.ndarray, sizes: np.ndarray, raw: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last + 1) byte of what can have an equal within its group in each of some contexts; 0, 0: nothing.

    ``raw`` holds the contexts one after another. The bytes in common are compared
    by a hash; equal hashes of different bytes only leave more to the sort.
    """
    ends = np.append(0, np.cumsum(sizes))
    low, high = np.maximum(0, at + width - sizes), np.minimum(at, width - gram)  # possible b
    hashes, who, least, most, done = [], [], [], [], 0
    for stop in _pieces(np.arange(1, len(sizes) + 1), ends, BATCH_BYTES):
        own = raw[ends[done] : ends[stop]]
        with np.errstate(over="ignore"):
            total = np.zeros(len(own) + 1, np.uint64)
            np.cumsum(BYTES[own] * powers(BASE, len(own))[:-1], out=total[1:])
            back = powers(INVERSE, len(own))
            for i, (a, b) in enumerate(_runs(width, gram, SEGMENTS)):
                has = done + np.flatnonzero((a <= high[done:stop]) & (b > low[done:stop]))
                x = (ends[has] - ends[done]) + at[has] - a
                y = x + a - b + 1 + width
                hashes.append(mix((total[y] - total[x]) * back[x] ^ mix(key[has].view(np.uint64) + np.uint64(i))))
                who.append(has)
                least.append(np.maximum(a, low[has]))
                most.append(np.minimum(b - 1, high[has]))
        done = stop
    who, least, most = map(np.concatenate, (who, least, most))
    _, kind, many = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    live = many[kind] > 1
    far, near = np.full(len(at), -1), np.full(len(at), width)
    np.maximum.at(far, who[live], most[live])
    np.minimum.at(near, who[live], least[live])
    some = far >= 0
    return np.where(some, at - far, 0), np.where(some, at - near + width, 0)


class _HotCores:
    """The strings of each run of each context, keyed by the bytes they have in common, as contexts of their own."""

    def __init__(self, width: int, gram: int):
        self.width, self.gram = width, gram

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, digest = _runs(self.width, self.gram, HOT_SEGMENTS), xxhash.xxh3_64_intdigest
        for batch in batches:
            row, key, at, first, data = [], [], [], [], []
            for i, (k, f, a, x) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("key", "first", "at", "bytes")), strict=True)):
                for run, low_byte, end, low, high in _cores(a, len(x), self.width, self.gram, runs):
                    row.append(i)
                    key.append(digest(x[low_byte:end], (k + run) & (2**64 - 1)))
                    at.append(high)
                    first.append(f + a - high)
                    data.append(x[a - high : a - low + self.width])
            rows = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(key, np.uint64).view(np.int64)), *[rows.column(n) for n in ("doc_id", "block", "text")], pa.array(first, pa.int64()), pa.array(at, pa.int64()), pa.array(data, pa.binary())],
                names=["key", "doc_id", "block", "text", "first", "at", "bytes"],
            )


class _HotStrings:
    """The strings of contexts as anchors of their own: the first of equal ones of a batch, marks of the others."""

    def __init__(self, width: int):
        self.width = width

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contexts = batch.column("bytes").to_pylist()
            many = np.array([len(x) - self.width + 1 for x in contexts])
            at = np.repeat(np.arange(len(many)), many)
            doc, block, text, first = (batch.column(n).to_numpy()[at] for n in ("doc_id", "block", "text", "first"))
            pos = first + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            digests = b"".join([xxhash.xxh3_128_digest(x[k : k + self.width]) for x in contexts for k in range(len(x) - self.width + 1)])
            h = np.frombuffer(digests, np.uint64).reshape(-1, 2)
            o = np.lexsort((pos, text, block, doc, h[:, 1], h[:, 0]))
            h, doc, block, text, pos = h[o], doc[o], block[o], text[o], pos[o]
            new = np.append(True, (h[1:] != h[:-1]).any(1))
            again = ~new & ~_heads_place(new, block, text, pos)
            yield from _spans(block[again], text[again].astype(np.int64), pos[again], pos[again] + self.width)
            k = new
            n = int(k.sum())
            yield _rows(
                np.full(n, ANCHOR, np.int8), h[k, 0].view(np.int64), h[k, 1].view(np.int64), np.zeros(n, np.int64), doc[k],
                block[k], text[k], pos[k], pos[k], pos[k] + self.width,
            )


def _pieces(cuts: np.ndarray, ends: np.ndarray, most: int) -> Iterator[int]:
    """Of the rows at which groups end, those at which a piece of up to ``most`` bytes, or of one group, ends."""
    done = 0  # bytes
    for k, cut in enumerate(cuts):
        if k + 1 == len(cuts) or ends[cuts[k + 1]] - done > most:
            done = ends[cut]
            yield int(cut)


class _Sort:
    """Suffix sorting of whole anchor groups; rows arrive sorted by key."""

    def __init__(self, width: int, gram: int, most: int = BATCH_BYTES):
        self.width, self.gram, self.most = width, gram, most

    def marks(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data = rows.column("bytes")
        edge = np.frombuffer(data.buffers()[1], np.int32)[data.offset :][: len(data) + 1].astype(np.int64)
        raw = np.frombuffer(data.buffers()[2], np.uint8)[edge[0] : edge[-1]]
        c = {n: rows.column(n).to_numpy() for n in ("key", "doc_id", "block", "text", "first", "at")}
        x, y = shorten(c["key"], c["at"], np.diff(edge), raw, self.width, self.gram)
        begin = edge[:-1] - edge[0] + x
        kept = np.flatnonzero(y > x)
        if not len(kept):
            return
        kept = kept[np.lexsort((c["first"][kept], c["text"][kept], c["block"][kept], c["doc_id"][kept]))]
        doc, block, text = (c[n][kept] for n in ("doc_id", "block", "text"))
        number = np.cumsum(np.append(False, (doc[1:] != doc[:-1]) | (block[1:] != block[:-1]) | (text[1:] != text[:-1])))
        size, first = (y - x)[kept], c["first"][kept] + x[kept]
        from_ = np.repeat(begin[kept] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        made = np.zeros(size.sum() + len(size), np.uint8)  # each context, then a 0
        made[np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)] = raw[from_]
        owner, at = repeats(made, size, number, first, self.width)
        start = first[owner] + at
        yield from _spans(block[owner], text[owner].astype(np.int64), start, start + self.width)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last group, which the next batch may continue
        for batch in batches:
            rows = batch if held is None else pa.concat_batches([held, batch])
            key = rows.column("key").to_numpy()
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            start = 0
            if len(cuts):
                size = pa.compute.binary_length(rows.column("bytes")).to_numpy()
                for stop in _pieces(cuts, np.append(0, np.cumsum(size, dtype=np.int64)), self.most):
                    yield from self.marks(rows.slice(start, stop - start))
                    start = stop
            held = rows.slice(start)
        if held is not None:
            yield from self.marks(held)


KEPT = "doc_id long, n_bytes long, kept binary, spans array<struct<first:bigint,last:bigint>>"


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of each block without its marked spans."""
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    for batch in batches:
        for i in range(batch.num_rows):
            _, ids, sizes, data = _opened(batch, i)
            spans: dict[int, list[tuple[int, int]]] = {}
            marks = batch.column("marks")[i]
            if marks.is_valid:
                m = marks.values
                text, first, last = (m.field(n).to_numpy() for n in ("text", "first", "last"))
                o = np.lexsort((first, text))
                for t, a, b in zip(text[o].tolist(), first[o].tolist(), last[o].tolist(), strict=True):
                    own = spans.setdefault(t, [])
                    if own and a <= own[-1][1]:
                        own[-1] = (own[-1][0], max(b, own[-1][1]))
                    else:
                        own.append((a, b))
            kept, begin = [], 0
            for t, size in enumerate(sizes.tolist()):
                parts, at = [], begin
                for a, b in spans.get(t, ()):
                    parts.append(data[at : begin + a])
                    at = begin + b
                parts.append(data[at : begin + size])
                kept.append(b"".join(parts))
                begin += size
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None if d == NULL_ID else d for d in ids.tolist()], pa.int64()),
                    pa.array(sizes),
                    pa.array(kept, pa.binary()),
                    pa.array([[{"first": a, "last": b} for a, b in spans.get(t, ())] for t in range(len(sizes))], kind),
                ],
                names=["doc_id", "n_bytes", "kept", "spans"],
            )


def _met(found: DataFrame) -> DataFrame:
    order = ("key", "context", "other", "doc_id", "block", "text", "pos")
    return map_arrow(found.repartition("key").sortWithinPartitions(*order), _meet, FOUND)


def _by_block(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """The rows of each block as a list; at most some for each anchor of the block."""
    return rows.groupBy("block").agg(F.collect_list(F.struct(*columns)).alias(name))


PLACE = ("key", "text", "pos", "first", "last")


def _counted(rows: DataFrame, least: int, name: str) -> DataFrame:
    """(key, many) of the keys that occur at least ``least`` times; the numbers are summed in part before the shuffle."""
    return materialise(rows.groupBy("key").agg(F.count("*").alias("many")).where(F.col("many") >= least), name)


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, kept (the remaining bytes) and spans (the removed runs) of every document."""
    blocks = materialise(map_arrow(docs.select("doc_id", "text"), _Blocks(BLOCK_BYTES), BLOCK_SCHEMA), "blocks")
    met = materialise(_met(map_arrow(blocks, _Find(width, gram), FOUND)), "met")
    spans = met.where(F.col("kind") == MARK)
    need = met.where(F.col("kind") == NEED).select("block", *PLACE)

    def cut(wanted: DataFrame) -> DataFrame:
        return map_arrow(blocks.join(_by_block(wanted, "wanted", *PLACE), "block"), _cut_out, CONTEXT)

    large = _counted(need, hot + 1, "hot_keys")
    if large.isEmpty():
        contexts = cut(need)
    else:
        contexts = cut(need.join(sized(large), "key", "left_anti"))
        whole = cut(need.join(sized(large), "key").drop("many"))
        cores = materialise(map_arrow(whole, _HotCores(width, gram), CONTEXT), "hot_cores")
        live = cores.join(sized(_counted(cores, 2, "hot_live")), "key")
        contexts = contexts.unionByName(live.where(F.col("many") <= hot).drop("many"))
        strings = map_arrow(live.where(F.col("many") > hot).drop("many"), _HotStrings(width), FOUND)
        spans = spans.unionByName(_met(strings).where(F.col("kind") == MARK))
    sorted_ = contexts.repartition("key").sortWithinPartitions("key")
    spans = spans.unionByName(map_arrow(sorted_, _Sort(width, gram), FOUND))
    marks = _by_block(spans, "marks", "text", "first", "last")
    return map_arrow(blocks.join(marks, "block", "left"), _strip, KEPT)


def repeat_digests(docs: DataFrame, width: int = WIDTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    return remove_repeats(docs, width, hot=hot).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
