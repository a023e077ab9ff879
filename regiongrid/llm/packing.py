"""Best-fit packing by patterns and non-negative least squares.

Documents are tokenised and, where longer than a sequence, cut into pieces of
its full length (the first piece takes the remainder). Only the histogram of
piece lengths, at most ``capacity`` numbers, comes to the driver. There,
patterns of two or three lengths that fill a sequence exactly are enumerated,
their repeat counts fitted to the histogram by non-negative least squares, scaled
and rounded, and what is left over is packed best-fit by decreasing length, again on
counts. The plan is a table of slots by length; each piece finds its
slot by its rank among the pieces of its length: its rank within the task that
wrote it, after the counts of the tasks before. So a length that a third of the
pieces share is ranked by as many tasks as wrote it.

Token ids are those of the named tokenizer file. They are made with the faster
library on the same vocabulary; texts that hold a special token's string go to
the reference library, which treats it specially.

Defined results: null and empty texts are the end token alone; repeated rows are
packed apiece; null ids stay null; an empty table gives an empty table; other
columns are ignored. Pieces of equal length take their places in the order of the
writing task, doc_id, piece, start and ids; which of wholly equal rows comes first
makes no difference. A very long text is tokenised whole, in some 30 bytes of memory
a byte, and handed on in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_arrow, materialise, sized

CAPACITY = 1024
END = 2
TOKENIZER = "byte_bpe_50k"
ROUNDS = 300  # of the least-squares fit
SHARES = (1, 7 / 8, 3 / 4, 1 / 2, 1 / 4, 1 / 8, 1 / 16, 1 / 32)  # of the fitted counts

_loaded: dict = {}


def _tokenizers(name: str):
    """(fast encoder, reference encoder, special strings), once a process."""
    if name not in _loaded:
        import base64
        import json

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = public_tokenizers.path(f"{name}.json")
        ranks = {}
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            for line in f:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        with open(path, encoding="utf-8") as f:
            special = [t["content"] for t in json.load(f).get("added_tokens", [])]
        _loaded[name] = fast, Tokenizer.from_file(str(path)), special
    return _loaded[name]


def encode(text: str | None, name: str = TOKENIZER) -> np.ndarray:
    """Token ids of one text, without the end token."""
    fast, reference, special = _tokenizers(name)
    text = text or ""
    if any(s in text for s in special):
        return np.array(reference.encode(text, add_special_tokens=False).ids, dtype="<u4")
    return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")


class _Cut:
    def __init__(self, capacity: int, end: int, name: str):
        self.capacity, self.end, self.name = capacity, end, name

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids")}
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(encode(text.as_py(), self.name), np.uint32(self.end)).astype("<u4")
                at, first = 0, len(ids) % self.capacity or self.capacity
                piece = 0
                while at < len(ids):
                    part = ids[at : at + (first if not at else self.capacity)]
                    for k, v in zip(rows, (doc, piece, at, len(part), part.tobytes()), strict=True):
                        rows[k].append(v)
                    at, piece = at + len(part), piece + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows["doc_id"], pa.int64()),
                    pa.array(rows["piece"], pa.int32()),
                    pa.array(rows["start"], pa.int64()),
                    pa.array(rows["length"], pa.int64()),
                    pa.array(rows["ids"], pa.binary()),
                ],
                names=list(rows),
            )


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit) of every piece."""
    return map_arrow(docs.select("doc_id", "text"),
        _Cut(capacity, end, tokenizer), "doc_id long, piece int, start long, length long, ids binary"
    )


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of two or three present lengths (0: none) that fill a sequence exactly: all of them, some capacity^2 / 12."""
    present = np.zeros(capacity + 1, dtype=bool)
    present[lengths] = True
    small = lengths[lengths < capacity]
    pairs = small[present[capacity - small] & (small <= capacity - small)]
    found = [np.stack([capacity - pairs, pairs, 0 * pairs], 1)] if len(pairs) else []
    for a in small[::-1]:
        b = small[(small <= a) & (2 * small >= capacity - a) & (small < capacity - a)]
        c = capacity - a - b
        ok = (c > 0) & (c <= b)
        b, c = b[ok], c[ok]
        ok = present[c]
        b, c = b[ok], c[ok]
        found.append(np.stack([np.full(len(b), a), b, c], 1))
    return np.concatenate(found) if found else np.empty((0, 3), dtype=np.int64)


def fit_counts(rows: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative least-squares repeat counts of the patterns.

    Accelerated projected gradient with the step bounded by the column and row
    sums of the pattern matrix.
    """
    n = len(histogram)
    used = rows > 0
    flat, pattern = rows[used], np.nonzero(used)[0]
    target = histogram.astype(float).copy()
    target[0] = 0
    per_length = np.bincount(flat, minlength=n)
    step = 1.0 / max(1, 3 * per_length.max())
    x = np.zeros(len(rows))
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        made = np.bincount(flat, weights=y[pattern], minlength=n)
        gradient = np.bincount(pattern, weights=(made - target)[flat], minlength=len(rows))
        fresh = np.maximum(0, y - step * gradient)
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = fresh + (t - 1) / t_next * (fresh - x)
        x, t = fresh, t_next
    return x


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit-decreasing of a histogram, on counts: (lengths of a sequence, repeats)."""
    free: dict[int, list[list]] = {}  # room -> [contents, repeats]
    rooms = np.zeros(capacity + 1, dtype=bool)

    def put(contents: tuple, repeats: int) -> None:
        room = capacity - sum(contents)
        free.setdefault(room, []).append([contents, repeats])
        rooms[room] = True

    for length in range(len(left) - 1, 0, -1):
        todo = int(left[length])
        while todo:
            fitting = np.flatnonzero(rooms[length:])
            if not len(fitting):
                each = min(capacity // length, todo)
                number = todo // each
                put((length,) * each, number)
                todo -= number * each
                continue
            room = length + int(fitting[0])
            contents, repeats = free[room].pop()
            if not free[room]:
                rooms[room] = False
            took = min(repeats, todo)
            if took < repeats:
                put(contents, repeats - took)
            put((*contents, length), took)
            todo -= took
    return [(tuple(c), r) for groups in free.values() for c, r in groups]


def rounded(rows: np.ndarray, x: np.ndarray, left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Whole repeats of the patterns for fitted counts ``x``; takes what they use from ``left``.

    What rounding takes from a pattern goes to the next one of the same longest piece.
    """
    made, carry, longest = [], 0.0, 0
    for i in np.lexsort((-rows[:, 1], -rows[:, 0])):
        carry = x[i] + (carry if rows[i, 0] == longest else 0.0)
        longest = rows[i, 0]
        if carry < 1:
            continue
        contents = tuple(int(v) for v in rows[i] if v)
        need = {v: contents.count(v) for v in contents}
        repeats = min(int(carry), *(int(left[v]) // c for v, c in need.items()))
        if repeats > 0:
            carry -= repeats
            made.append((contents, repeats))
            for v, c in need.items():
                left[v] -= c * repeats
    return made


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sequences for a histogram (index: length) as (lengths, repeats).

    Patterns may take the short pieces that long ones need beside them, so of the
    fitted counts that one of ``SHARES`` is used that leads to the fewest sequences
    once the residual is packed.
    """
    whole = histogram.astype(np.int64).copy()
    full = [((capacity,), int(whole[capacity]))] if whole[capacity] else []
    whole[capacity] = 0
    rows = patterns(np.flatnonzero(whole), capacity)
    x = fit_counts(rows, whole) if len(rows) else np.zeros(0)
    best, fewest = [], None
    for share in SHARES:
        left = whole.copy()
        made = rounded(rows, share * x, left) + best_fit(left, capacity)
        number = sum(r for _, r in made)
        if fewest is None or number < fewest:
            best, fewest = made, number
    return full + best


class _Place:
    """Gives each (length, rank) its sequence and offset."""

    def __init__(self, sequences: list[tuple[tuple[int, ...], int]]):
        slots: dict[int, list[tuple[int, int, int]]] = {}
        filled: dict[int, int] = {}
        base = 0
        for contents, repeats in sequences:
            offset = 0
            for length in contents:
                first = filled.get(length, 0)
                slots.setdefault(length, []).append((first, base, offset))
                filled[length] = first + repeats
                offset += length
            base += repeats
        self.slots = {k: np.array(v, dtype=np.int64) for k, v in slots.items()}

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for value in np.unique(length):
                at, s = length == value, self.slots[int(value)]
                i = np.searchsorted(s[:, 0], rank[at], side="right") - 1
                sequence[at], offset[at] = s[i, 1] + rank[at] - s[i, 0], s[i, 2]
            rest = [n for n in batch.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in rest], pa.array(sequence), pa.array(offset)], names=[*rest, "sequence_id", "offset"]
            )


def pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``made`` (doc_id, piece, start, length and one of the ids) with sequence_id and offset."""
    columns = made.columns
    cut = materialise(made.withColumn("_task", F.spark_partition_id()), "pieces")
    counts = cut.groupBy("length").count().collect()  # at most ``capacity`` rows
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for row in counts:
        histogram[row["length"]] = row["count"]
    before = W.partitionBy("length").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    firsts = (
        cut.groupBy("length", "_task")
        .count()
        .select("length", "_task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    )
    rank = F.row_number().over(W.partitionBy("length", "_task").orderBy(*[c for c in columns if c != "length"])) - 1
    ranked = cut.withColumn("_rank", rank.cast("long")).join(sized(materialise(firsts, "firsts")), ["length", "_task"])
    ranked = ranked.select(*columns, (F.col("_rank") + F.col("_first")).alias("_rank"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema)
    return map_arrow(ranked, _Place(plan(histogram, capacity)), f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end: int = END, tokenizer: str = TOKENIZER) -> DataFrame:
    """Every piece with its token ids and its place."""
    return pack(pieces(docs, capacity, end, tokenizer), capacity)


def pack_digests(docs: DataFrame, capacity: int = CAPACITY, end: int = END, tokenizer: str = TOKENIZER) -> DataFrame:
    """Every piece with the CRC-32 of its token ids and its place."""
    cut = pieces(docs, capacity, end, tokenizer)
    cut = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(cut, capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
