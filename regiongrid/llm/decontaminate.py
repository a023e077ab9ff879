"""Benchmark decontamination by size-partitioned MinHash containment search.

An item counts as found in a document if at least ``threshold`` percent of the
item's distinct word shingles occur in it. A document may be thousands of times
longer than an item, so Jaccard banding is useless; the search goes by
containment instead. Items are partitioned by size (their number of shingles q).
The sketch of an item is its bottom-s MinHash values, s = q - ceil(threshold% of
q) + 1 in its size partition: a document that lacks at most q - ceil(...) of the
shingles must hold one of any s of them, so no contained item is missed. The
documents are probed with the sketches only; a pair whose sketch is hit is a
candidate and is verified by the exact count of common shingles.

Within each row a bitmap of the sketches (``Bits``) drops nearly all shingles before
any is a row of its own, so only hits are joined, by broadcast if the index's row
count is under ``common.BROADCAST_ROWS``, else by a shuffle of the hits. The bitmap
has sixteen bits a sketch row, up to half a megabyte; with more rows than that holds
it lets more through, and nothing is missed. The documents are scanned once for
candidates, and those with candidates once more, against all shingles of the items.

Defined results: null and empty texts hold nothing; items without words are
found nowhere; items of fewer than ``width`` words are one shingle of all their
words and are looked for as such; repeated items count apiece by item_id, and
repeated documents each get their row; rows of one doc_id are taken as one
document. Null ids never match. Only the id and text columns are read. A very long
text is one row's array of word hashes, some 100 bytes of memory a word. Shingles
are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_words, materialise, shingle_hashes, sized

WIDTH = 5
THRESHOLD = 75  # percent of an item's shingles
LEAST_BITS, MOST_BITS = 12, 22  # powers of two: sizes of the bitmap


def _runs(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, in the form of a short item's hash."""
    return F.when(
        F.size(words) >= size,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - F.lit(size)),
            lambda i: F.xxhash64(F.slice(words, i + 1, F.lit(size))),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def item_index(items: DataFrame, threshold: int = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """(item_id, shingle, q, needed, in_sketch, n_words) for every item shingle."""
    d = items.select("item_id", lower_words(F.col("text")).alias("words")).where("item_id IS NOT NULL")
    d = d.select("item_id", F.size("words").alias("n_words"), F.array_sort(shingle_hashes(F.col("words"), width)).alias("s"))
    q = F.size("s")
    needed = F.ceil(q * F.lit(threshold) / F.lit(100)).cast("int")
    d = d.select("item_id", "n_words", q.alias("q"), needed.alias("needed"), F.posexplode("s").alias("rank", "shingle"))
    # shingle hashes are uniform, so the smallest are a MinHash sketch
    return d.select(
        "item_id", "shingle", "q", "needed", (F.col("rank") <= F.col("q") - F.col("needed")).alias("in_sketch"), "n_words"
    ).dropDuplicates(["item_id", "shingle"])


class Bits:
    """A bitmap of the last bits of some shingles: a test without misses."""

    def __init__(self, shingles: DataFrame):
        rows = shingles.count()
        self.size = next(2**p for p in range(LEAST_BITS, MOST_BITS + 1) if 2**p >= 16 * rows or p == MOST_BITS)
        at = F.col("shingle").bitwiseAND(F.lit(self.size - 1))
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(F.lit(63)).cast("int"))
        words = [0] * (self.size // 64)
        # at most size / 64 rows
        for r in shingles.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).collect():
            words[r["word"]] = r["bits"]
        self.words = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")  # folded to a constant

    def may_hold(self, x: Column) -> Column:
        at = x.bitwiseAND(F.lit(self.size - 1))
        return F.getbit(F.get(self.words, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1


def _probes(docs: DataFrame, index: DataFrame, width: int) -> DataFrame:
    """doc_id and the shingles of its text that are in ``index`` (shingle, n_words), and few others."""
    bits = Bits(index)
    short = [r[0] for r in index.where(F.col("n_words") < width).select("n_words").distinct().collect()]  # at most width - 1 values
    d = docs.select("doc_id", lower_words(F.col("text")).alias("words")).where("doc_id IS NOT NULL")
    found = shingle_hashes(F.col("words"), width, distinct=False)
    if short:
        found = F.concat(found, *[_runs(F.col("words"), n) for n in short])
    return d.select("doc_id", F.explode(F.array_distinct(F.filter(found, bits.may_hold))).alias("shingle"))


def candidates(docs: DataFrame, index: DataFrame, width: int = WIDTH) -> DataFrame:
    """Pairs (doc_id, item_id) in which the document holds a shingle of the item's sketch."""
    sketch = index.where("in_sketch")
    return _probes(docs, sketch, width).join(sized(sketch.select("shingle", "item_id")), "shingle").select("doc_id", "item_id").distinct()


def contained_items(
    docs: DataFrame, items: DataFrame, threshold: int = THRESHOLD, width: int = WIDTH
) -> DataFrame:
    """Verified pairs: doc_id, item_id, n_common, q."""
    index = materialise(item_index(items, threshold, width), "items")
    pairs = materialise(candidates(docs, index, width), "candidates")
    some = docs.join(sized(materialise(pairs.select("doc_id").distinct(), "probed")), "doc_id", "left_semi")
    full = index.select("shingle", "item_id", "q", "needed")
    hits = _probes(some, index, width).join(sized(full), "shingle").join(sized(pairs), ["doc_id", "item_id"])
    return (
        hits.groupBy("doc_id", "item_id")
        .agg(F.count_distinct("shingle").alias("n_common"), F.first("q").alias("q"), F.first("needed").alias("needed"))
        .where("n_common >= needed")
        .select("doc_id", "item_id", "n_common", "q")
    )


def decontaminate(
    docs: DataFrame, items: DataFrame, threshold: int = THRESHOLD, width: int = WIDTH
) -> DataFrame:
    """doc_id, contaminated, n_items and first_item of every document row."""
    pairs = contained_items(docs, items, threshold, width)
    by_doc = materialise(
        pairs.groupBy(F.col("doc_id").alias("_doc")).agg(F.count("*").alias("n_items"), F.min("item_id").alias("first_item")),
        "leaks",
    )
    d = docs.select("doc_id")
    return d.join(sized(by_doc), d["doc_id"] == by_doc["_doc"], "left").select(
        "doc_id",
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        "first_item",
    )


def remove_contaminated(
    docs: DataFrame, items: DataFrame, threshold: int = THRESHOLD, width: int = WIDTH
) -> DataFrame:
    """The documents in which no item is found, with all their columns."""
    pairs = contained_items(docs, items, threshold, width)
    bad = materialise(pairs.select(F.col("doc_id").alias("_doc")).distinct(), "leaks")
    return docs.join(sized(bad), docs["doc_id"] == bad["_doc"], "left_anti")


def oracle(threshold: int = THRESHOLD) -> str:
    white = r"\x20\x09-\x0D"

    def listed(table: str, key: str) -> str:
        return f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{white}]+') AS ws FROM {table}"

    def shingles(table: str, key: str) -> str:
        return f"""SELECT {key}, len(ws) AS n, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [ws]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: ws[i:i+4]) END) AS s
  FROM ({listed(table, key)})"""

    return f"""
WITH b AS (SELECT DISTINCT item_id, s FROM ({shingles("benchmark", "item_id")})),
few AS (SELECT DISTINCT len(s) AS k FROM b WHERE len(s) < 5),
d AS (SELECT DISTINCT doc_id, s FROM ({shingles("documents", "doc_id")})
  UNION SELECT doc_id, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i+k-1])) FROM ({listed("documents", "doc_id")}), few),
q AS (SELECT item_id, count(*) AS q FROM b GROUP BY 1),
h AS (SELECT doc_id, item_id, count(*) AS c FROM d JOIN b USING (s) GROUP BY 1, 2),
p AS (SELECT doc_id, count(*) AS n_items, min(item_id) AS first_item FROM h JOIN q USING (item_id) WHERE 100 * c >= {threshold} * q GROUP BY 1)
SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0)::BIGINT AS n_items, first_item
FROM documents LEFT JOIN p USING (doc_id)"""
