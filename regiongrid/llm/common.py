"""Helpers shared by the training-data operators.

Intermediate tables go to the folder in ``spark.checkpoint.dir``, which every
executor and the driver share, so a lost executor never takes the only copy.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows up to which a key table may be broadcast: two longs a row, so at most
#: some 50 MB. Larger tables take the shuffled join.
BROADCAST_ROWS = 1_000_000
#: Bytes of rows that a Python worker is sent at once, unless one row is longer.
ARROW_BYTES, _ARROW_KEY = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"
WHITE = r"[\x20\x09-\x0D]+"

_written: list[str] = []
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="regiongrid-"))
        folder = _own[0]
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder for one table in the shared folder."""
    path = f"{shared_dir(spark)}/regiongrid/{uuid.uuid4().hex}/{name}"
    _written.append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read from there."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """Number of tables in the shared folder that this process has not deleted: a mark for ``release``."""
    return len(_written)


def release(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables this process wrote to the shared folder after the mark ``since``; return their number.

    Call it when the results that read them have been consumed.
    """
    jvm, done = spark.sparkContext._jvm, 0
    while len(_written) > since:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        done += bool(fs.delete(path, True))
    return done


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it while ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows.

    ``df`` should be materialised: it is counted. Beyond the limit it comes
    back as it is, for a shuffled join.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with batches of at most ``ARROW_BYTES``, unless the session sets a bound of its own.

    The bound is a setting of the session and stays, as Spark reads it when the plan runs.
    """
    conf = df.sparkSession.conf
    if conf.get(_ARROW_KEY, None) is None:
        conf.set(_ARROW_KEY, ARROW_BYTES)
    return df.mapInArrow(_Released(f), schema)


class _Released:
    """``f``, after which the worker, which Spark keeps, gives freed memory back to the system."""

    def __init__(self, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
        self.f = f

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from self.f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)


def ascii_lower(word: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(
        F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; null: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE, -1), "")


def lower_words(text: Column) -> Column:
    return F.transform(words_of(text), ascii_lower)


def shingle_hashes(words: Column, width: int = 5, distinct: bool = True) -> Column:
    """64-bit hashes of the ``width``-word shingles of a word array, each once if ``distinct``.

    With fewer words the whole sequence is one shingle; without words the
    result is empty. ``words`` must be a column, not an expression, as each
    shingle reads it ``width`` times.
    """
    n = F.size(words)
    long = F.transform(
        F.sequence(F.lit(0), n - F.lit(width)),
        lambda i: F.xxhash64(*[F.get(words, i + F.lit(k)) for k in range(width)]),
    )
    none = F.array().cast("array<bigint>")
    every = F.when(n >= width, long).when(n > 0, F.array(F.xxhash64(words))).otherwise(none)
    return F.array_distinct(every) if distinct else every


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


def shingle_sets(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, values, keys) of the distinct word shingles of UTF-8 texts.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; values are 64-bit
    hashes, sorted within a text; a text of fewer than ``width`` words is one
    shingle, one without words none. keys holds a 128-bit hash of each text's
    word sequence as two signed numbers.
    """
    n_texts = len(texts)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    raw = b"\n".join([*texts, b""]).translate(_LOWER)
    b = np.frombuffer(raw, np.uint8)
    white = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.diff(white.astype(np.int8), prepend=1)
    first, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    stop = stop[-len(first) :] if len(first) else stop[:0]
    ends = np.cumsum(sizes + 1)
    count = np.diff(np.searchsorted(first, np.append(0, ends)))  # words of each text
    with np.errstate(over="ignore"):
        # a polynomial over each word, from prefix sums over all bytes
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(BYTES[b] * powers(BASE, len(b))[:-1], out=total[1:])
        word = mix((total[stop] - total[first]) * powers(INVERSE, len(b))[first])
        n = len(word)
        gram = np.zeros(max(0, n - width + 1), np.uint64)
        for k in range(width):
            gram = gram * np.uint64(0xD6E8FEB86659FD93) + word[k : k + len(gram)]
        gram = mix(gram)
    out, keys, many = [], np.zeros((n_texts, 2), np.int64), np.zeros(n_texts, np.int64)
    begin = 0
    for i, c in enumerate(count.tolist()):
        if c:
            own = word[begin : begin + c].tobytes()
            keys[i] = np.frombuffer(xxhash.xxh3_128_digest(own), np.int64)
            if c >= width:
                s = np.sort(gram[begin : begin + c - width + 1])
                s = s[np.append(True, s[1:] != s[:-1])]
            else:
                s = np.array([xxhash.xxh3_64_intdigest(own)], np.uint64)
            out.append(s)
            many[i] = len(s)
            begin += c
    return many, np.concatenate(out) if out else np.empty(0, np.uint64), keys
