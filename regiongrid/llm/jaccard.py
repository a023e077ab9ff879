"""Exact n-gram Jaccard join with PartEnum signatures.

Sets are the distinct five-word shingles of the documents; two documents link
when 100 * intersection >= threshold * union.

Signatures. Sizes are cut into bands of ratio four; a set also joins the band
above if a partner may be there, so every linkable pair shares a band. In a band
the feature domain is hashed into n1 partitions, and each partition's subset of
a set is one signature. Two sets of sizes l and m that link differ in at most
(l + m) * (100 - t) / (100 + t) features, so at most so many partitions differ.
A set of size l therefore needs only k + 1 of its signatures, k being that bound
for its largest partner, if all sets leave out their commonest ones by one
global order: of the signatures that a linked pair shares, the rarest is kept
on both sides. (If a set has fewer than k + 1 occupied partitions, it emits the
empty ones as signatures as well, and nothing is missed.) The order comes from a
counting sketch over the shingles of all documents; it only steers the work:
passages that many documents share are left out first, any order gives the same
links.

Groups. Copies (equal word sequences) are folded into their smallest doc_id
before signatures are made. A document is verified against one document first:
the smallest of fitting size among its groups of equal signatures; a group is
never expanded into all pairs for that, and one that the sketch calls hot is dealt
over several tasks, whose smallest meet afterwards. Only members that such links leave in
different components are compared further, groups with the same members once.
Of two members a and b with the same first partner c, the intersection is at most
min(|a & c|, |b & c|) plus the shingles outside c that they share. So they are
compared only if the minimum alone allows a link, or if a join of the shingles
outside c shows that they share enough of these: a family of loose copies of one
text is not paired off. Before texts are moved for these pairs, bitmaps of the sets
bound their intersections from above and rule out most. Verification is the exact
intersection of the sets.

Defined results: null and empty texts have an empty set, link with nothing and
are their own component; rows that share a doc_id count as one document; a null
doc_id gives a null component; an empty table gives an empty table; other
columns are ignored. Sets are 64-bit hashes of shingles, made of 64-bit hashes of
words; copies are found by 128 bits. A very long text is shingled alone, in some 100
bytes of memory a byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_arrow, materialise, mix, shingle_sets, sized

WIDTH = 5
THRESHOLD = 75
CELLS = 1 << 18  # of the counting sketch: 1 MB in all
BLOCK = 1 << 12
N_SHIFT, SIG_SHIFT = 32, 40  # where a salt is put in a set's size and in a signature
HOT, HOT_TIMES = 10_000, 16  # sets that may share a signature in one task, and times the mean of the sketch


def band_of(sizes: np.ndarray) -> np.ndarray:
    """Number of the size band [4^b, 4^(b+1) - 1]."""
    bands = np.zeros(len(sizes), dtype=np.int64)
    top = 4
    while (big := sizes >= top).any():
        bands += big
        top *= 4
    return bands


def partitions_of(high: np.ndarray) -> np.ndarray:
    """n1 for a band whose largest size is ``high``."""
    return (2 * high + 4) // 5 + 4


def signatures(
    docs: np.ndarray, sizes: np.ndarray, values: np.ndarray, heat: np.ndarray, threshold: int = THRESHOLD
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, doc, heat of its rarest shingle) of every set in every band it joins."""
    out_sig, out_doc, out_heat = [], [], []
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    band = band_of(sizes)
    largest = sizes * 100 // threshold
    for up in (0, 1):
        high = 4 ** (band + up + 1) - 1
        joins = (sizes > 0) & ((largest > 4 ** (band + 1) - 1) if up else True)
        rows = np.flatnonzero(joins)
        if not len(rows):
            continue
        n1, size = partitions_of(high[rows]), sizes[rows]
        k = (size + np.minimum(high[rows], largest[rows])) * (100 - threshold) // (100 + threshold)
        local = np.repeat(np.arange(len(rows)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[rows], size)
        h = values[at]
        part = (mix(h ^ np.uint64(0x9E3779B97F4A7C15)) % n1[local].astype(np.uint64)).astype(np.int64)
        base = np.cumsum(n1) - n1
        cell = base[local] + part  # numbers all partitions of all sets
        order = np.argsort(cell, kind="stable")
        cells, first = np.unique(cell[order], return_index=True)
        with np.errstate(over="ignore"):
            content = np.add.reduceat(mix(h[order]), first)
        warm = np.minimum.reduceat(heat[(h[order] & np.uint64(CELLS - 1)).astype(np.int64)], first)
        owner = np.searchsorted(base, cells, side="right") - 1
        with np.errstate(over="ignore"):
            place = (cells - base[owner]).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + (band[rows] + up)[owner].astype(np.uint64)
            sig = mix(content ^ mix(place))
        rank = np.lexsort((sig, warm, owner))
        seen = np.bincount(owner, minlength=len(rows))
        turn = np.arange(len(rank)) - np.repeat(np.cumsum(seen) - seen, seen)
        keep = rank[turn < (k + 1)[owner[rank]]]
        out_sig.append(sig[keep])
        out_doc.append(docs[rows][owner[keep]])
        out_heat.append(warm[keep])
        for r in np.flatnonzero(seen <= k):  # too few occupied partitions
            empty = np.setdiff1d(np.arange(n1[r]), cells[owner == r] - base[r]).astype(np.uint64)
            with np.errstate(over="ignore"):
                place = empty * np.uint64(0x9FB21C651E98DF25) + np.uint64(band[rows[r]] + up)
                out_sig.append(mix(~mix(place)))
            out_doc.append(np.full(len(empty), docs[rows[r]]))
            out_heat.append(np.full(len(empty), heat.max()))  # of any set
    if not out_sig:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_sig), np.concatenate(out_doc), np.concatenate(out_heat)


def _texts(batch: pa.RecordBatch, name: str = "text", most: int = 500_000) -> Iterator[tuple[slice, list[bytes]]]:
    """Runs of rows of up to ``most`` bytes of text, or one row."""
    texts, size, start = [], 0, 0
    for i, t in enumerate(batch.column(name)):
        texts.append((t.as_py() or "").encode("utf-8", "surrogatepass"))
        size += len(texts[-1])
        if size >= most:
            yield slice(start, i + 1), texts
            texts, size, start = [], 0, i + 1
    if texts:
        yield slice(start, batch.num_rows), texts


class _Survey:
    """Rows of the documents, then the partition's counts of shingle cells."""

    def __init__(self, width: int):
        self.width = width

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, dtype=np.int64)
        names = ["doc_id", "n_shingles", "k1", "k2", "block", "counts"]
        for batch in batches:
            for rows, texts in _texts(batch):
                sizes, values, keys = shingle_sets(texts, self.width)
                cells += np.bincount((values & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[rows],
                        pa.array(sizes, pa.int64()),
                        pa.array(keys[:, 0].copy()),
                        pa.array(keys[:, 1].copy()),
                        pa.nulls(n, pa.int32()),
                        pa.nulls(n, pa.list_(pa.int64())),
                    ],
                    names=names,
                )
        found = [i for i in range(CELLS // BLOCK) if cells[i * BLOCK : (i + 1) * BLOCK].any()]
        yield pa.RecordBatch.from_arrays(
            [
                *[pa.nulls(len(found), pa.int64())] * 4,
                pa.array(found, pa.int32()),
                pa.array([cells[i * BLOCK : (i + 1) * BLOCK] for i in found], pa.list_(pa.int64())),
            ],
            names=names,
        )


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the counts by block, one row a block seen here."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
            total[block] = total.get(block, 0) + counts.values.to_numpy()
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.int64()))], names=["block", "counts"]
    )


class _Enumerate:
    """Signatures; those that more than ``most`` sets may share are dealt over several salts (from 1; the others have 0)."""

    def __init__(self, heat: np.ndarray, threshold: int, width: int, most: int):
        self.heat, self.threshold, self.width, self.most = heat, threshold, width, most

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column("doc_id").to_numpy()
            for rows, texts in _texts(batch):
                sizes, values, _ = shingle_sets(texts, self.width)
                sig, at, warm = signatures(np.arange(len(sizes)), sizes, values, self.heat, self.threshold)
                doc = docs[rows][at]
                salts = (1 + warm // self.most).astype(np.uint64)
                salt = np.where(warm > self.most, 1 + mix(doc.view(np.uint64)) % salts, 0).astype(np.int64)
                # narrow rows, as all of them are shuffled: the salt goes into both numbers
                sig = sig.view(np.int64) ^ (salt << SIG_SHIFT)
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(doc), pa.array(sizes[at] | (salt << N_SHIFT))], names=["sig", "doc_id", "n"])


COMPARED = "a long, b long, n_a long, n_b long, both long, linked boolean, outside array<long>"
NEAR = 30  # percent: shingles outside the partner are listed for pairs at least so similar


class _Compare:
    """Exact intersection of the pairs (a, ta) and (b, tb)."""

    def __init__(self, threshold: int, width: int, outside: bool):
        self.threshold, self.width, self.outside = threshold, width, outside

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, centre = None, None
        for batch in batches:
            ids, own = batch.column("a").to_pylist(), batch.column("ta")
            out: list[list] = [[], [], [], [], []]
            for rows, texts in _texts(batch, "tb"):
                sizes, values, _ = shingle_sets(texts, self.width)
                stops = np.cumsum(sizes)
                for i in range(rows.start, rows.stop):
                    if ids[i] != last or centre is None:
                        last = ids[i]
                        centre = shingle_sets([(own[i].as_py() or "").encode("utf-8", "surrogatepass")], self.width)[1]
                    k = i - rows.start
                    member = values[stops[k] - sizes[k] : stops[k]]
                    both = len(np.intersect1d(centre, member, assume_unique=True))
                    union = len(centre) + len(member) - both
                    near = self.outside and 100 * both >= NEAR * union
                    extra = np.setdiff1d(member, centre, assume_unique=True).view(np.int64) if near else None
                    for column, value in zip(out, (len(centre), len(member), both, 100 * both >= self.threshold * union and both > 0, extra), strict=True):
                        column.append(value)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), *[pa.array(c, t) for c, t in zip(out, types, strict=True)]],
                names=["a", "b", "n_a", "n_b", "both", "linked", "outside"],
            )


def compared(docs: DataFrame, pairs: DataFrame, threshold: int = THRESHOLD, width: int = WIDTH, outside: bool = False) -> DataFrame:
    """The pairs (a, b) with sizes, exact intersection and whether they link.

    ``pairs`` is materialised. Only the texts that occur in it are moved. Rows
    that share a doc_id are compared apiece. ``outside`` lists the shingles of b
    that a lacks, for pairs that are near.
    """
    small = docs.select("doc_id", "text")
    member = small.join(sized(pairs.select(F.col("b").alias("doc_id"), "a")), "doc_id").select("a", F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    centre = small.join(sized(materialise(pairs.select(F.col("a").alias("doc_id")).distinct(), "centres")), "doc_id")
    both = member.join(centre.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    return map_arrow(both.select("a", "b", "ta", "tb"), _Compare(threshold, width, outside), COMPARED)


def bitmap(values: np.ndarray) -> bytes:
    """The last bits of some hashes, eight places a hash or more; a power of two of them."""
    size = max(64, 1 << int(8 * len(values) - 1).bit_length()) if len(values) else 64
    places = np.zeros(size, dtype=bool)
    places[(values & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(places).tobytes()


def most_common(a: bytes, n_a: int, b: bytes, n_b: int) -> int:
    """A number that the intersection of two sets, given by bitmap and size, does not exceed."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(z.reshape(-1, size)) for z in (x, y))
    # a place that only one of them has, holds a member of this one alone
    return min(n_a - int(np.bitwise_count(x & ~y).sum()), n_b - int(np.bitwise_count(y & ~x).sum()))


class _Bitmaps:
    def __init__(self, width: int):
        self.width = width

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in _texts(batch):
                sizes, values, _ = shingle_sets(texts, self.width)
                own = [bitmap(v) for v in np.split(values, np.cumsum(sizes)[:-1])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[rows], pa.array(sizes), pa.array(own, pa.binary())], names=["doc_id", "n", "bits"])


class _Possible:
    """Pairs whose bitmaps allow a link."""

    def __init__(self, threshold: int):
        self.threshold = threshold

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = self.threshold, 100 + self.threshold
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("bits_a", "n_a", "bits_b", "n_b")]
            keep = [high * most_common(x, m, y, n) >= low * (m + n) for x, m, y, n in zip(*columns, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def possible(docs: DataFrame, pairs: DataFrame, threshold: int = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """Of ``pairs`` (materialised), those that bitmaps of the sets, a byte a shingle, do not rule out."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    some = docs.select("doc_id", "text").join(sized(materialise(ids, "compared_ids")), "doc_id")
    maps = materialise(map_arrow(some, _Bitmaps(width), "doc_id long, n long, bits binary"), "bitmaps")
    a, b = (maps.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab")
    both = b.join(sized(pairs), "b").join(a, "a").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
    return map_arrow(both, _Possible(threshold), "a long, b long").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b) reaches.

    Large-star and small-star rounds: each is two aggregations by node, whose
    minima combine before the shuffle; nothing is gathered. Rounds end when the
    edges no longer change.
    """
    e = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )

    def state(d: DataFrame):
        return d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()

    before = None
    while (now := state(e)) != before:
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = materialise(e, "large_star")
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        small = e.join(least, "u")
        e = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        e = materialise(e.where("u <> v").distinct(), "small_star")
    nodes = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return nodes.unionByName(roots.join(nodes.select("node"), "node", "left_anti"))


def survey(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n_shingles, k1, k2) of every row, and the counting sketch of all shingles."""
    schema = "doc_id long, n_shingles long, k1 long, k2 long, block int, counts array<long>"
    seen = materialise(map_arrow(docs.select("doc_id", "text"), _Survey(width), schema), "survey")
    blocks = seen.where("block IS NOT NULL").select("block", "counts")
    summed = map_arrow(blocks.repartition(CELLS // BLOCK // 4, "block"), _added, "block int, counts array<long>")
    heat = np.zeros(CELLS, dtype=np.int64)
    for row in summed.collect():  # CELLS numbers in all
        heat[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] += row["counts"]
    return seen.where("block IS NULL").drop("block", "counts"), heat


def _fits(a: str, b: str, threshold: int) -> Column:
    """Sizes ``a`` and ``b`` allow a link."""
    return 100 * F.least(a, b) >= threshold * F.greatest(a, b)


def _apart(groups: DataFrame, component: DataFrame) -> DataFrame:
    """Rows of the groups whose members are in several components, with these; one of each kind of group."""
    at = groups.join(sized(component), groups["doc_id"] == component["node"], "left").select(
        "sig", "doc_id", "n", F.coalesce("component", "doc_id").alias("part")
    )
    apart = (
        at.groupBy("sig")
        .agg(
            F.min("part").alias("p"),
            F.max("part").alias("q"),
            F.count("*").alias("c"),
            F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("s"),
            F.min("doc_id").alias("u"),
            F.max("doc_id").alias("v"),
        )
        .where("p < q")
        .groupBy("c", "s", "u", "v")
        .agg(F.min("sig").alias("sig"))
        .select("sig")
    )
    return at.join(apart, "sig")


def _sides(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``df`` twice, its columns but the keys renamed to those of a and of b."""
    rest = [c for c in df.columns if c not in (*keys, "doc_id")]
    return tuple(df.select(*keys, F.col("doc_id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in rest]) for x in "ab")


def links(docs: DataFrame, folded: DataFrame, heat: np.ndarray, threshold: int = THRESHOLD, width: int = WIDTH, hot: int = HOT) -> DataFrame:
    """Verified links between documents that stand for their copies.

    They connect the same documents as all links do. ``folded`` holds the ids
    of the copies that are left out. Signatures that may be in more than ``hot``
    sets, and in many more than the mean, are dealt over several tasks.
    """
    rest = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    rest = rest.join(sized(folded), "doc_id", "left_anti")
    most = max(hot, HOT_TIMES * int(heat.mean()))
    rows = map_arrow(rest, _Enumerate(heat, threshold, width, most), "sig long, doc_id long, n long")
    dealt = W.partitionBy("sig").orderBy("doc_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    salt, size = F.shiftright("n", N_SHIFT), lambda n: F.col(n).bitwiseAND(F.lit((1 << N_SHIFT) - 1)).cast("int")
    groups = rows.select("sig", "doc_id", "n", F.first("doc_id").over(dealt).alias("c"), F.first("n").over(dealt).alias("c_n"), F.last("doc_id").over(dealt).alias("last"))
    groups = groups.where((salt > 0) | (F.col("c") < F.col("last"))).select(
        F.col("sig").bitwiseXOR(F.shiftleft(salt, SIG_SHIFT)).alias("sig"),
        "doc_id",
        size("n").alias("n"),
        (salt > 0).alias("hot"),
        F.struct(F.col("c").alias("doc_id"), size("c_n").alias("m")).alias("centre"),
        "last",
    )
    groups = materialise(groups, "groups")
    # the salts of a hot signature meet by what each of them found
    tops = groups.where("hot").groupBy("sig").agg(F.min("centre").alias("top"), F.max("last").alias("end"))
    groups = groups.join(sized(materialise(tops, "hot_signatures")), "sig", "left").withColumn("centre", F.coalesce("top", "centre"))
    groups = groups.where(F.col("centre.doc_id") < F.coalesce("end", "last"))
    groups = groups.select("sig", "doc_id", "n", F.col("centre.doc_id").alias("centre"), F.col("centre.m").alias("m"))
    stars = groups.where(F.col("doc_id") != F.col("centre")).where(_fits("n", "m", threshold))
    stars = materialise(stars.groupBy(F.col("doc_id").alias("b")).agg(F.min("centre").alias("a")).select("a", "b"), "stars")
    first = materialise(compared(docs, stars, threshold, width, outside=True), "first")
    found = first.where("linked").select("a", "b").distinct()
    component = materialise(connected_components(found), "components")
    # members of the groups still apart, with their first partner if that is near
    partner = first.where("outside IS NOT NULL").groupBy(F.col("b").alias("doc_id")).agg(F.min("a").alias("centre"), F.max("both").alias("both"), F.count("*").alias("k"))
    partner = materialise(partner.where("k = 1").drop("k"), "partners")
    at = _apart(groups.select("sig", "doc_id", "n"), component)
    at = materialise(at.join(sized(partner), "doc_id", "left"), "apart")
    left, right = _sides(at, ["sig"])
    low, high = threshold, 100 + threshold  # a link needs high * intersection >= low * sum of sizes
    hopeless = F.coalesce((F.col("centre_a") == F.col("centre_b")) & (high * F.least("both_a", "both_b") < low * (F.col("n_a") + F.col("n_b"))), F.lit(False))
    wanted = left.join(right, "sig").where("a < b AND part_a <> part_b").where(_fits("n_a", "n_b", threshold) & ~hopeless).select("a", "b").distinct()
    # pairs of one partner that share shingles outside it
    inside = component.select(F.col("node").alias("doc_id"), "component")
    extra = first.where("outside IS NOT NULL").select(F.col("b").alias("doc_id"), F.col("n_b").alias("n"), "both", F.col("a").alias("centre"), F.explode("outside").alias("x"))
    extra = extra.join(sized(inside), "doc_id", "left").withColumn("part", F.coalesce("component", "doc_id")).drop("component")
    left, right = _sides(extra, ["centre", "x"])
    shared = left.join(right, ["centre", "x"]).where("a < b AND part_a <> part_b").where(_fits("n_a", "n_b", threshold))
    shared = shared.groupBy("a", "b").agg(F.count_distinct("x").alias("k"), F.least(F.max("both_a"), F.max("both_b")).alias("i"), F.min(F.col("n_a") + F.col("n_b")).alias("s"))
    more = shared.where(high * (F.col("i") + F.col("k")) >= low * F.col("s")).select("a", "b")
    across = materialise(wanted.unionByName(more).distinct().join(stars, ["a", "b"], "left_anti"), "across")
    left_over = materialise(possible(docs, across, threshold, width), "possible")
    second = compared(docs, left_over, threshold, width).where("linked").select("a", "b").distinct()
    return materialise(found.unionByName(second), "all_links")


def jaccard_classes(docs: DataFrame, threshold: int = THRESHOLD, width: int = WIDTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document row."""
    seen, heat = survey(docs, width)
    full = seen.where("n_shingles > 0 AND doc_id IS NOT NULL")
    folds = full.groupBy("k1", "k2").agg(F.min("doc_id").alias("stands"), F.max("doc_id").alias("last")).where("stands < last").drop("last")
    copies = materialise(
        full.join(sized(materialise(folds, "folds")), ["k1", "k2"]).where("doc_id > stands").select("doc_id", "stands").distinct(), "copies"
    )
    copies = copies.groupBy("doc_id").agg(F.min("stands").alias("stands"))
    e = links(docs, materialise(copies.select("doc_id"), "folded"), heat, threshold, width, hot)
    component = materialise(connected_components(e.unionByName(copies.select(F.col("stands").alias("a"), F.col("doc_id").alias("b")))), "classes")
    return seen.join(sized(component), seen["doc_id"] == component["node"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame, threshold: int = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """The documents without those whose class has a smaller doc_id."""
    classes = jaccard_classes(docs, threshold, width)
    drop = materialise(classes.where("component_id < doc_id").select(F.col("doc_id").alias("_doc")).distinct(), "near_copies")
    return docs.join(sized(drop), docs["doc_id"] == drop["_doc"], "left_anti")


def oracle(threshold: int = THRESHOLD) -> str | None:
    """Components are iterative: no SQL; see the brute-force test."""
    return None
