"""Quality rules by distribution divergence.

A document's character-class histogram and common-word histogram are held
against those of each language; the smallest Jensen-Shannon distance counts.
Everything is one map over the rows: no shuffle, no Python, no collected state.

Defined results: a null text has no words, fails the base rules and is not kept;
an empty table gives an empty table; repeated rows give repeated rows; only the
id and text columns are read, so other columns, whatever their names, are
ignored. Texts are processed whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words_of

# Usual shares of the character classes (lower-case ASCII, white
# space, capital ASCII, digit, sentence punctuation, symbol, other ASCII,
# not ASCII) in running text of each language.
CLASS_SHARES = {
    "en": (0.785, 0.170, 0.020, 0.005, 0.018, 0.0005, 0.0005, 0.001),
    "fr": (0.735, 0.165, 0.020, 0.005, 0.020, 0.0005, 0.0005, 0.054),
    "de": (0.775, 0.145, 0.045, 0.005, 0.018, 0.0005, 0.0005, 0.011),
    "es": (0.770, 0.165, 0.018, 0.005, 0.018, 0.0005, 0.0005, 0.023),
}
# Usual shares of common words in running text of each language.
WORD_SHARES = {
    "en": {"the": 0.060, "of": 0.030, "and": 0.028, "to": 0.026, "in": 0.020, "a": 0.022, "is": 0.012, "that": 0.011, "for": 0.010, "it": 0.009},
    "fr": {"de": 0.045, "la": 0.028, "le": 0.026, "et": 0.022, "les": 0.020, "des": 0.017, "en": 0.015, "un": 0.012, "une": 0.011, "du": 0.012},
    "de": {"der": 0.032, "die": 0.032, "und": 0.028, "in": 0.018, "den": 0.013, "von": 0.011, "zu": 0.012, "das": 0.011, "mit": 0.010, "ist": 0.009},
    "es": {"de": 0.060, "la": 0.036, "que": 0.030, "el": 0.030, "en": 0.027, "y": 0.025, "los": 0.016, "del": 0.012, "las": 0.011, "un": 0.011},
}
#: Removed in this order; each pattern matches one class of CLASS_SHARES.
CLASS_PATTERNS = (
    r"[a-z]+",
    r"[\x20\x09-\x0D]+",
    r"[A-Z]+",
    r"[0-9]+",
    r"""[.,;:!?'"()\-]+""",
    r"[#*$%&|<>]+",
    r"[\x00-\x7F]+",
)
MAX_CLASS_DISTANCE = 0.17
MAX_WORD_DISTANCE = 0.27
MIN_CHARS = 200  # no verdict on the classes of fewer characters
MIN_WORDS = 150  # no verdict on the common words of fewer words


def js_distance(counts: Column, total: Column, shares: list[float]) -> Column:
    """Jensen-Shannon distance (base 2) of an array of counts and a reference."""
    scale = sum(shares)

    def part(c: Column, q: Column) -> Column:
        p = c / total
        m = (p + q) / 2
        return F.when(c > 0, p * F.log2(p / m)).otherwise(F.lit(0.0)) + q * F.log2(q / m)

    parts = F.zip_with(counts, F.array(*[F.lit(q / scale) for q in shares]), part)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2))


def _covered(positions: Column, width: int) -> Column:
    """Number of words in windows that start at the sorted positions."""
    n = F.size(positions)
    return F.coalesce(
        F.aggregate(
            F.sequence(F.lit(1), n),
            F.lit(0).cast("long"),
            lambda acc, i: acc
            + F.coalesce(
                F.least(F.lit(width), F.get(positions, i) - F.get(positions, i - 1)),
                F.lit(width),
            ),
        ),
        F.lit(0),
    )


def _count(words: str, word: str) -> Column:
    return F.size(F.filter(words, lambda x: x == word))


def base_measures(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, words, class counts and the four base measures of every text."""
    d = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    left, cols = F.col("text"), []
    for i, pattern in enumerate(CLASS_PATTERNS):
        d = d.withColumn(f"r{i}", F.regexp_replace(left, pattern, ""))
        left = F.col(f"r{i}")
        cols.append(f"r{i}")
    size = [F.char_length(c) for c in ("text", *cols)]
    counts = [(a - b).cast("long") for a, b in zip(size, size[1:], strict=False)] + [size[-1].cast("long")]
    d = d.select(
        "doc_id",
        words_of(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        size[0].cast("long").alias("n_chars"),
        F.array(*counts).alias("classes"),
    )
    n = F.size("words")
    words = F.col("words")
    hashes = F.when(
        n >= width,
        F.transform(
            F.sequence(F.lit(0), n - F.lit(width)),
            lambda i: F.xxhash64(*[F.get(words, i + F.lit(k)) for k in range(width)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("hashes", hashes)
    # Equal hashes only raise the suspicion; the windows themselves are compared.
    suspect = F.size(F.array_distinct("hashes")) < F.size("hashes")
    windows = F.when(
        suspect,
        F.sort_array(
            F.transform(
                F.sequence(F.lit(0), n - F.lit(width)),
                lambda i: F.struct(
                    F.get(F.col("hashes"), i).alias("h"),
                    F.slice(words, i + 1, F.lit(width)).alias("w"),
                    i.alias("i"),
                ),
            )
        ),
    )
    d = d.withColumn("windows", windows)
    w = F.col("windows")

    def same(a: Column, b: Column) -> Column:
        return F.coalesce((a["h"] == b["h"]) & (a["w"] == b["w"]), F.lit(False))

    again = F.filter(
        w,
        lambda x, k: same(x, F.get(w, k + 1)) | same(x, F.get(w, k - 1)),
    )
    d = d.withColumn("starts", F.sort_array(F.transform(again, lambda x: x["i"])))
    repeats = F.when(F.size("starts") > 0, _covered(F.col("starts"), width)).otherwise(F.lit(0))
    return d.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        (F.col("n_chars") - F.get("classes", F.lit(1))).alias("word_chars"),
        F.get("classes", F.lit(5)).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeats.cast("long").alias("n_repeat_words"),
        "n_chars",
        "classes",
        "words",
    )


def quality_rules(
    docs: DataFrame,
    max_class_distance: float = MAX_CLASS_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    min_chars: int = MIN_CHARS,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """Measures, distances and verdict of every document.

    ``class_distance`` and ``word_distance`` are null below the minimum lengths
    and then pass no judgement.
    """
    vocabulary = sorted({w for shares in WORD_SHARES.values() for w in shares})
    d = base_measures(docs).withColumn(
        "common", F.filter("words", lambda w: w.isin(vocabulary))
    )
    d = d.withColumn("hits", F.array(*[_count("common", w) for w in vocabulary]))
    by_class = [
        js_distance(F.col("classes"), F.col("n_chars"), list(shares))
        for shares in CLASS_SHARES.values()
    ]
    by_word = []
    for shares in WORD_SHARES.values():
        known = [F.get("hits", F.lit(vocabulary.index(w))) for w in shares]
        rest = F.col("n_words") - sum(known[1:], known[0])
        by_word.append(js_distance(F.array(*known, rest), F.col("n_words"), [*shares.values(), 1 - sum(shares.values())]))
    d = d.withColumn(
        "class_distance", F.when(F.col("n_chars") >= max(1, min_chars), F.least(*by_class))
    ).withColumn("word_distance", F.when(F.col("n_words") >= max(1, min_words), F.least(*by_word)))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    far = (F.coalesce("class_distance", F.lit(0.0)) > max_class_distance) | (
        F.coalesce("word_distance", F.lit(0.0)) > max_word_distance
    )
    return d.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & ~far).alias("kept"),
        "class_distance",
        "word_distance",
    )


def oracle() -> str:
    """DuckDB SQL for the rows of the registered query, without the distances."""
    white = r"\x20\x09-\x0D"
    vocabulary = sorted({w for shares in WORD_SHARES.values() for w in shares})

    def distance(counts: list[str], total: str, shares: list[float]) -> str:
        terms = []
        for c, q in zip(counts, shares, strict=True):
            q = q / sum(shares)
            p = f"({c} * 1e0 / {total})"
            m = f"(({p} + {q!r}::DOUBLE) / 2)"
            terms.append(f"(CASE WHEN {c} > 0 THEN {p} * log2({p} / {m}) ELSE 0 END + {q!r}::DOUBLE * log2({q!r}::DOUBLE / {m}))")
        return "sqrt(greatest(0e0, (" + " + ".join(terms) + ") / 2))"

    by_class = [distance([f"c{i}" for i in range(8)], "n_chars", list(s)) for s in CLASS_SHARES.values()]
    by_word = []
    for s in WORD_SHARES.values():
        known = [f"f{vocabulary.index(w)}" for w in s]
        by_word.append(distance([*known, f"(n_words - {' - '.join(known)})"], "n_words", [*s.values(), 1 - sum(s.values())]))
    chain, previous = [], "t"
    for i, pattern in enumerate(CLASS_PATTERNS):
        quoted = pattern.replace("'", "''")
        chain.append(f"s{i} AS (SELECT *, regexp_replace({previous}, '{quoted}', '', 'g') AS r{i} FROM {'d' if not i else f's{i - 1}'})")
        previous = f"r{i}"
    sizes = ["t", *[f"r{i}" for i in range(7)]]
    counts = ", ".join(f"length({a}) - length({b}) AS c{i}" for i, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False))) + ", length(r6) AS c7"
    hits = ", ".join(f"len(list_filter(words, lambda w: w = '{w}')) AS f{i}" for i, w in enumerate(vocabulary))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
{", ".join(chain)},
e AS (SELECT rid, doc_id, t, length(t) AS n_chars, {counts},
        regexp_extract_all(t, '[^{white}]+') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{white}]')) AS lines
      FROM s6),
p AS (SELECT rid, unnest(range(1, len(words) - 3)) AS i, words FROM e WHERE len(words) >= 5),
w AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i:i+4]) AS c FROM p),
o AS (SELECT DISTINCT rid, i + k AS pos FROM w, (SELECT unnest(range(0, 5)) AS k) WHERE c > 1),
r AS (SELECT rid, count(*) AS n_repeat_words FROM o GROUP BY rid),
m AS (SELECT e.*, len(words) AS n_words, coalesce(n_repeat_words, 0) AS n_repeat_words, {hits} FROM e LEFT JOIN r USING (rid)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        CASE WHEN n_chars >= {MIN_CHARS} THEN least({", ".join(by_class)}) ELSE 0e0 END AS cd,
        CASE WHEN n_words >= {MIN_WORDS} THEN least({", ".join(by_word)}) ELSE 0e0 END AS wd FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, (n_chars - c1)::BIGINT AS word_chars, c5::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  base_failed, NOT base_failed AND cd <= {MAX_CLASS_DISTANCE} AND wd <= {MAX_WORD_DISTANCE} AS kept
FROM v"""
