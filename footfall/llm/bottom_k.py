"""Document fingerprints: bottom-k sketches of word shingles.

A sketch holds the k smallest 64-bit hashes of a document's distinct shingles, ascending. The sketch of a union is the
k smallest of two sketches together, so parts merge in any order. Among the k smallest hashes of a union, the share
that both sides have estimates resemblance; the k-th smallest estimates the number of distinct shingles.

Words are what white space separates; a text with fewer words than a shingle is one shingle; a text without words has
an empty sketch. Everything is a column expression.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import hex_sha, rows_of, stored

K = 128
SHINGLE = 5
# Doc_ids that agree but for so many low bits share a window partition.
SEGMENT_BITS = 12


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """array<bigint>: the k smallest distinct shingle hashes."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def of_words(w: Column) -> Column:
        size = F.size(w)
        starts = F.slice(w, 1, size - shingle + 1)
        parts = F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(w, i + d) for d in range(1, shingle)]))
        return (F.when(size == 0, F.array().cast("array<bigint>")).when(size < shingle, F.array(F.xxhash64(w)))
                .otherwise(parts))

    return F.slice(F.array_sort(F.array_distinct(_with(F.transform(words, lambda w: F.xxhash64(w)), of_words))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the Jaccard similarity; exact while both sets have at most k shingles together. Two empty ones: 1."""
    return _with(merge(a, b, k), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(F.array_intersect(a, b), u)) / F.size(u)))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimate of the number of distinct shingles; exact below k."""
    last = (F.element_at(a, -1).cast("double") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / last)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the share of a's shingles that b has; an empty a is contained in anything."""
    common = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_count(a, k)))


def hexed(a: Column) -> Column:
    """A sketch as text, joined hexadecimal hashes."""
    return F.array_join(F.transform(a, lambda h: F.hex(h)), ".")


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, sketch of every row; null text counts as empty."""
    return rows_of(docs).select("doc_id", sketch(F.col("text"), k).alias("sketch"))


def merged(sketches: DataFrame, *keys: str, k: int = K) -> DataFrame:
    """The sketch of all rows of each key: distinct hashes first, so a key's rows are summed up within their tasks."""
    hashes = sketches.select(*keys, F.explode("sketch").alias("h")).distinct()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("h"))
    kept = hashes.withColumn("_place", place).where(F.col("_place") <= k)
    return kept.groupBy(*keys).agg(F.array_sort(F.collect_list("h")).alias("sketch"))


def _in_order(docs: DataFrame) -> tuple[DataFrame, Window]:
    """Rows dealt by segment of doc_id, and the order within a segment: descending doc_id, null last, then by digest."""
    rows = rows_of(docs).withColumn("sha", hex_sha("text"))
    rows = rows.withColumn("segment", F.coalesce(F.shiftright("doc_id", SEGMENT_BITS), F.lit(-(2 ** 62))))
    return rows.repartition("segment"), Window.partitionBy("segment").orderBy(F.desc_nulls_last("doc_id"), F.desc("sha"))


def _next_lower(segments: DataFrame) -> DataFrame:
    """(segment, then): the next lower of the distinct segments, null for the lowest.

    Segments are put in segments of their own, level by level, until one window holds them: with sparse ids there may be
    as many as documents, and no task gets more than 2 ** SEGMENT_BITS of them.
    """
    falling = F.desc("segment")
    if segments.count() <= 2 ** SEGMENT_BITS:
        return segments.select("segment", F.lead("segment").over(Window.orderBy(falling)).alias("then"))
    rows = segments.withColumn("upper", F.shiftright("segment", SEGMENT_BITS))
    heads = stored(rows.groupBy("upper").agg(F.max("segment").alias("head")), "heads")
    bridge = (_next_lower(heads.select(F.col("upper").alias("segment")))
              .join(heads.withColumnRenamed("upper", "then"), "then").select(F.col("segment").alias("upper"), "head"))
    within = F.lead("segment").over(Window.partitionBy("upper").orderBy(falling))
    return rows.withColumn("then", within).join(bridge, "upper", "left").select("segment", F.coalesce("then", "head").alias("then"))


def with_next(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, text, sketch, next_text, next_sketch: the next document by descending doc_id, the first after the last.

    Each segment looks ahead on its own; what follows its last document is the first one of the next lower segment.
    """
    rows, w = _in_order(docs)
    first = stored(rows.withColumn("place", F.row_number().over(w)).where("place = 1").select("segment", "text"), "segments")
    after = _next_lower(first.select("segment"))
    after = after.withColumn("then", F.coalesce("then", F.lit(first.agg(F.max("segment")).first()[0]).cast("long")))
    bridge = (after.join(first.withColumnRenamed("segment", "then"), "then")
              .select("segment", F.col("text").alias("bridge"), sketch(F.col("text"), k).alias("bridge_sketch")))
    own = rows.withColumn("sketch", sketch(F.col("text"), k))
    own = own.withColumn("next_text", F.lead("text").over(w)).withColumn("next_sketch", F.lead("sketch").over(w))
    return own.join(bridge, "segment", "left").select(
        "doc_id", "text", "sketch", F.coalesce("next_text", "bridge").alias("next_text"),
        F.coalesce("next_sketch", "bridge_sketch").alias("next_sketch"))


def edited(text: Column, other: Column) -> Column:
    """The text with its last floor(n / 2) characters replaced by the first as many (or all) of the other."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))


def compare_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    Equal texts have equal fingerprints, texts without words the empty one. Repeated doc_ids are ordered by the digest
    of their text; a single document follows itself; an empty table gives no rows.
    """
    x = with_next(docs, k).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    x = x.withColumn("edited_sketch", sketch(F.col("edited"), k))
    return x.select("doc_id", F.length("text").cast("long").alias("n_chars"), hex_sha("edited").alias("edited_sha256"),
                    hexed(F.col("sketch")).alias("fingerprint"), hexed(F.col("edited_sketch")).alias("edited_fingerprint"),
                    resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
                    resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"))
