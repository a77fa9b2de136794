"""Quality rules: base counts of a text and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into a fixed number of buckets. One multinomial over the
buckets is counted on the trusted documents, one on all documents. A document's value is
the mean of log(p_trusted / p_raw) over its n-grams; it is kept when this is at least a fixed
threshold. Logarithms are rounded to whole micro-units first, so sums do not depend on their order
and every run decides alike. Everything is built-in expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costwright.llm.shared import SPACE

#: Hash buckets of the two multinomials; their weights, one number each, are the only thing sent around.
BUCKETS = 10_000
#: Pseudo-counts per bucket, spread like the raw corpus. Chance alone lowers a clean document's mean by at most
#: 1 / (8 * SMOOTHING), however few the trusted documents are; that has to stay well below LEAST_RATIO.
SMOOTHING = 20.0
#: Least mean log ratio, in natural units, of a document that is kept.
LEAST_RATIO = -0.04
UNIT = 1_000_000

# The base rule.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50

_WORDS, _GRAMS = "__words", "__grams"
#: The columns that rated() gives.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "kept")


def _words(text: str) -> Column:
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), SPACE + "+"), lambda w: w != "")


def _grams(words: str, buckets: int) -> Column:
    """Buckets of all words and of all pairs of neighbours."""
    return F.expr(
        f"concat(transform({words}, w -> cast(pmod(xxhash64(w), {buckets}) as int)), "
        f"if(size({words}) < 2, array(), transform(sequence(1, greatest(1, size({words}) - 1)), "
        f"i -> cast(pmod(xxhash64({words}[i - 1], {words}[i]), {buckets}) as int))))"
    )


def ratio_weights(docs: DataFrame, trusted: DataFrame, id_column: str, text: str, buckets: int = BUCKETS) -> list[int]:
    """round(UNIT * log(p_trusted / p_raw)) of each bucket, over whole texts of all documents.

    trusted: ids in id_column; repeated and null ones do no harm. Without trusted n-grams, and for an
    empty table, all are 0. Other columns are not read, whatever their names.
    """
    # one plan at every size: a list of trusted ids grows with the corpus and is never broadcast
    marks = trusted.select(F.col(id_column).alias("__id")).filter("__id is not null").distinct()
    marked = (
        docs.select(F.col(id_column).alias("__id"), F.col(text).alias("__text"))
        .join(marks.withColumn("__trusted", F.lit(1)).hint("merge"), "__id", "left")
        .select("__trusted", _words("__text").alias(_WORDS))
        .select("__trusted", F.explode(_grams(_WORDS, buckets)).alias("bucket"))
    )
    counts = marked.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("raw"), F.count("__trusted").alias("trusted")
    )
    raw, good = [0] * buckets, [0] * buckets
    for row in counts.collect():  # one row a bucket at most
        raw[row["bucket"]], good[row["bucket"]] = row["raw"], row["trusted"]
    if not sum(good):
        return [0] * buckets
    extra, total, trusted_total = SMOOTHING * buckets, sum(raw), sum(good)
    shares = [r / total for r in raw]
    return [
        round(UNIT * math.log((g + extra * p) / ((trusted_total + extra) * p))) if p else 0
        for g, p in zip(good, shares)
    ]


def _repeated(words: str, hashes: str, places: str) -> Column:
    """Number of words in a three-word window that occurs twice or more.

    Windows are sorted by a hash, then by their words; equal neighbours are repeats.
    """
    starts = (
        f"sort_array(transform(filter({places}, (p, k) -> "
        f"(k > 0 and p.g = {places}[greatest(k - 1, 0)].g) or "
        f"(k < size({places}) - 1 and p.g = {places}[least(k + 1, size({places}) - 1)].g)), p -> p.i))"
    )
    return F.expr(
        f"aggregate({starts}, named_struct('last', -1, 'n', 0L), (a, i) -> "
        f"named_struct('last', i + 2, 'n', a.n + least(3, i + 2 - a.last)), a -> a.n)"
    )


def _measured(docs: DataFrame, weights: list[int], text: str, least_ratio: float) -> DataFrame:
    """The columns of docs under private names (c0, c1, ...), then MEASURES.

    The row number stands between the rules and whatever the caller does: a filter that Spark
    pushes into their projections would repeat each of them wherever a later one reads it.
    """
    buckets = len(weights)
    text = f"c{docs.columns.index(text)}"
    docs = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    names = docs.columns
    content = F.coalesce(F.col(text), F.lit(""))
    w, h, p = _WORDS, "__hashes", "__places"
    lines = "filter(split({}, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')".format(f"coalesce(`{text}`, '')")
    known = F.expr(f"cast(split('{','.join(map(str, weights))}', ',') as array<int>)")
    rows = (
        docs.select(*names, _words(text).alias(w), F.expr(lines).alias("__lines"))
        .withColumn(
            h, F.expr(f"if(size({w}) < 3, cast(array() as array<bigint>), transform(sequence(0, greatest(0, size({w}) - 3)), "
                      f"i -> xxhash64({w}[i], {w}[i + 1], {w}[i + 2])))")
        )
        .withColumn(
            p, F.expr(f"if(size(array_distinct({h})) = size({h}), "
                      f"cast(array() as array<struct<g:struct<x:bigint,a:string,b:string,c:string>,i:int>>), "
                      f"sort_array(transform({h}, (x, i) -> named_struct("
                      f"'g', named_struct('x', x, 'a', {w}[i], 'b', {w}[i + 1], 'c', {w}[i + 2]), 'i', i))))")
        )
        .withColumn(_GRAMS, _grams(w, buckets))
    )
    total = F.aggregate(_GRAMS, F.lit(0).cast("long"), lambda a, b: a + F.get(known, b))
    rows = rows.select(
        *names,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.translate(content, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(content) - F.length(F.translate(content, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.expr("cast(size(__lines) - size(array_distinct(__lines)) as bigint)").alias("n_dup_lines"),
        _repeated(w, h, p).alias("n_repeat_words"),
        (total / F.greatest(F.size(_GRAMS), F.lit(1)) / UNIT).alias("ratio"),
        F.monotonically_increasing_id().alias("__row"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    )
    rows = rows.filter("__row >= 0").withColumn("base_failed", failed)
    return rows.select(*names, *MEASURES[:5], "base_failed", "ratio", (~failed & (F.col("ratio") >= least_ratio)).alias("kept"))


def rated(
    docs: DataFrame,
    weights: list[int],
    text: str = "text",
    least_ratio: float = LEAST_RATIO,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """The kept columns of docs and the MEASURES of each text.

    A null text counts as empty: it has no words, fails the base rule and has ratio 0. Rows stay one
    to one, repeated rows included; an empty table gives no rows. Columns that are not kept are not
    read, whatever their names; a kept one that has the name of a measure goes by that name with
    `given_` before it. Nothing is shuffled, and a filter on the result costs no more than the result.
    """
    chosen = docs.select(*(F.col(c) for c in keep), F.col(text).alias("__text"))
    names = [f"given_{c}" if c in MEASURES else c for c in keep]
    rows = _measured(chosen, weights, "__text", least_ratio)
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), *MEASURES)


def passing(docs: DataFrame, weights: list[int], text: str = "text", least_ratio: float = LEAST_RATIO) -> DataFrame:
    """The rows of docs that rated() keeps, with the columns of docs as they are, whatever their names."""
    rows = _measured(docs, weights, text, least_ratio).filter("kept")
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
