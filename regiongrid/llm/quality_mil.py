"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of a few hundred bytes. Each passage is encoded
(shares of byte classes, word lengths, repeated words, then a learned layer);
gated attention weighs the passages; the weighted representation is scored. All
weights are learned together from document labels.

Training uses a bounded sample of labelled rows (``MAX_TRAIN``, the smallest by a
hash of the id) with all their passages; the features of that sample, about a
sixth of its text's bytes, are all that reaches the driver.
Scoring is one map over all rows and whole texts.

Defined results: null and empty texts are one passage without words and get a
score like any other; labels that are null, or of documents that are not there,
are ignored; with labels of one kind only (or none) every score is the share of
label 1 (or 0.5); repeated rows get equal scores; an empty table gives an empty
table; lang, source, n_chars and other columns are never read by the model, and
``keep_good`` returns them whatever their names. A very long text is encoded
alone, in some 130 bytes of memory a byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import free_name, map_arrow, materialise, sized

PASSAGE = 512  # bytes
MAX_TRAIN = 4000  # labelled documents
FOLDS, HELD_OUT = 5, 0  # rows whose crc32(id) mod FOLDS is HELD_OUT are never trained on
CUT = 0.3
HIDDEN, GATE = 16, 8
EPOCHS, RATE, SEED = 60, 0.02, 7
BYTES = 1_000_000  # text handled at once in a Python worker, unless one text is longer

CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:", b"!", b"?", b"'\"()-", b"#*$%&", b"|<>", b"=_/\\+@~^`[]{}"]


def _table() -> np.ndarray:
    table = np.full(256, len(CLASSES), dtype=np.uint8)
    table[:32] = len(CLASSES) + 1
    for i, c in enumerate(CLASSES):
        table[np.frombuffer(c, np.uint8)] = i
    table[128:] = len(CLASSES) + 2
    return table


TABLE = _table()
N_CLASSES = len(CLASSES) + 3
N_FEATURES = N_CLASSES + 6
NOISE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, number of passages of each text)."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    number = np.maximum(1, (sizes + PASSAGE // 2) // PASSAGE)
    # one white-space byte after each text keeps words apart and passages non-empty
    b = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    begin = np.cumsum(sizes + 1) - sizes - 1
    inner = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    starts = np.repeat(begin, number) + inner * PASSAGE
    length = np.diff(np.append(starts, len(b))).astype(float)
    kind = TABLE[b]
    out = np.zeros((len(starts), N_FEATURES), dtype=np.float32)
    for c in range(N_CLASSES):
        out[:, c] = np.add.reduceat(kind == c, starts, dtype=np.int64) / length
    white = (kind == 3) | (kind == 4)
    first = np.flatnonzero(~white & np.append(True, white[:-1]))
    if len(first):
        end = np.flatnonzero(~white & np.append(white[1:], True)) + 1
        span = end - first
        place = np.arange(len(b), dtype=np.int64) - np.repeat(first, np.diff(np.append(first, len(b)))) if first[0] == 0 else None
        if place is None:
            place = np.arange(len(b), dtype=np.int64)
            place[first[0] :] -= np.repeat(first, np.diff(np.append(first, len(b))))
        with np.errstate(over="ignore"):
            mixed = NOISE[b] * ((place.astype(np.uint64) << np.uint64(1)) + np.uint64(1)) ** np.uint64(3)
            mixed[white] = 0
            word = np.add.reduceat(mixed, first)
        owner = np.searchsorted(starts, first, side="right") - 1
        text = np.searchsorted(begin, first, side="right") - 1
        n = np.maximum(1, np.bincount(owner, minlength=len(starts)))
        out[:, N_CLASSES] = np.bincount(owner, weights=span, minlength=len(starts)) / n / 10
        out[:, N_CLASSES + 1] = np.sqrt(np.bincount(owner, weights=span * span, minlength=len(starts)) / n) / 10
        for j, back in enumerate((1, 2, 3)):
            if len(first) > back:
                same = (word[back:] == word[:-back]) & (text[back:] == text[:-back])
                out[:, N_CLASSES + 2 + j] = np.bincount(owner[back:], weights=same, minlength=len(starts)) / n
    out[:, N_CLASSES + 5] = np.log1p(length) / 7
    return out, number


class Model:
    """Passage layer, gated attention and document score; plain arrays."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, constant: float | None = None):
        r = np.random.default_rng(SEED)
        self.mean, self.scale, self.constant = mean, scale, constant
        self.w = {
            "encode": r.normal(0, 0.3, (N_FEATURES, HIDDEN)),
            "bias": np.zeros(HIDDEN),
            "tanh": r.normal(0, 0.3, (HIDDEN, GATE)),
            "gate": r.normal(0, 0.3, (HIDDEN, GATE)),
            "attend": r.normal(0, 0.3, GATE),
            "score": r.normal(0, 0.3, HIDDEN),
            "base": np.zeros(1),
        }

    def forward(self, f: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, dict]:
        w, s = self.w, np.cumsum(number) - number
        x = np.clip((f - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ w["encode"] + w["bias"])
        t = np.tanh(h @ w["tanh"])
        g = 1 / (1 + np.exp(-(h @ w["gate"])))
        e = (t * g) @ w["attend"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, s), number))
        a = e / np.repeat(np.add.reduceat(e, s), number)
        z = np.add.reduceat(a[:, None] * h, s)
        p = 1 / (1 + np.exp(-np.clip(z @ w["score"] + w["base"][0], -30, 30)))
        return p, {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "s": s}

    def gradient(self, y: np.ndarray, p: np.ndarray, c: dict, number: np.ndarray) -> dict:
        """Of the mean cross-entropy."""
        w, h, t, g, a = self.w, c["h"], c["t"], c["g"], c["a"]
        d = (p - y) / len(y)
        out = {"score": c["z"].T @ d, "base": np.array([d.sum()])}
        dz = np.repeat(d[:, None] * w["score"], number, axis=0)
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, c["s"]), number))
        out["attend"] = (t * g).T @ de
        dt = de[:, None] * w["attend"] * g * (1 - t * t)
        dg = de[:, None] * w["attend"] * t * g * (1 - g)
        out["tanh"], out["gate"] = h.T @ dt, h.T @ dg
        dh = (dz * a[:, None] + dt @ w["tanh"].T + dg @ w["gate"].T) * (1 - h * h)
        out["encode"], out["bias"] = c["x"].T @ dh, dh.sum(0)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        f, number = encode(texts)
        return self.forward(f, number)[0]


def fit(bags: list[np.ndarray], labels: np.ndarray) -> Model:
    """Adam on batches of bags; deterministic."""
    if len(labels) == 0 or labels.min() == labels.max():
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), float(labels.mean()) if len(labels) else 0.5)
    every = np.concatenate(bags)
    m = Model(every.mean(0), every.std(0) + 0.01)
    r, step = np.random.default_rng(SEED), 0
    first = {k: np.zeros_like(v) for k, v in m.w.items()}
    second = {k: np.zeros_like(v) for k, v in m.w.items()}
    for _ in range(EPOCHS):
        order = r.permutation(len(bags))
        for at in range(0, len(order), 128):
            rows = order[at : at + 128]
            number = np.array([len(bags[i]) for i in rows])
            p, c = m.forward(np.concatenate([bags[i] for i in rows]), number)
            step += 1
            for k, g in m.gradient(labels[rows], p, c, number).items():
                g = g + 1e-4 * m.w[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                m.w[k] = m.w[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return m


def _runs(column: pa.Array) -> Iterator[tuple[slice, list[bytes]]]:
    """Runs of rows of up to ``BYTES`` of text, or one row."""
    texts, size, start = [], 0, 0
    for i, t in enumerate(column):
        texts.append((t.as_py() or "").encode("utf-8", "replace"))
        size += len(texts[-1])
        if size >= BYTES or i + 1 == len(column):
            yield slice(start, i + 1), texts
            texts, size, start = [], 0, i + 1


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs = []
        for _, texts in _runs(batch.column("text")):
            f, number = encode(texts)
            blobs += [x.tobytes() for x in np.split(f, np.cumsum(number)[:-1])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), pa.array(blobs, pa.binary())], names=["doc_id", "label", "features"]
        )


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Model:
    """A model of ``labels`` (doc_id, quality), from rows outside the held-out fold."""
    known = (
        labels.where("quality IS NOT NULL AND doc_id IS NOT NULL")
        .where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) != HELD_OUT)
        .select("doc_id", F.col("quality").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(most)
    )
    picked = docs.select("doc_id", "text").join(sized(materialise(known, "train"), most), "doc_id").select("doc_id", "label", "text")
    rows = map_arrow(picked, _features, "doc_id long, label int, features binary").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["label"], r["features"]))
    bags = [np.frombuffer(r["features"], np.float32).reshape(-1, N_FEATURES) for r in rows]
    return fit(bags, np.array([r["label"] for r in rows], dtype=float))


class _Score:
    def __init__(self, model: Model, name: str):
        self.model, self.name = model, name

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in _runs(batch.column("text")):
                own = batch.slice(rows.start, rows.stop - rows.start)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(self.model.scores(texts), pa.float64())], names=[*own.schema.names, self.name])


def score(docs: DataFrame, model: Model, name: str = "_score") -> DataFrame:
    """``docs`` with the scores in a column ``name``, which it must not have yet."""
    return map_arrow(docs, _Score(model, name), StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    d = score(docs.select("doc_id", "text"), train(docs, labels))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    return d.select(
        "doc_id",
        F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"),
        F.col("_score").alias("score"),
        F.when(F.col("_score") >= CUT, 1).otherwise(0).alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with their columns."""
    name = free_name(docs, "_score")
    return score(docs, train(docs, labels), name).where(F.col(name) >= CUT).drop(name)
