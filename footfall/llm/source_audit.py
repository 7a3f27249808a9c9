"""Source divergence audit: how far the word use of sources of one language lies apart, and by which terms.

Counting sorts pointers to word starts instead of hashing words. Within a task the bytes of the texts stay where Arrow
put them; every word is a pointer into them. The pointers of a slice (about 8 MB of texts, cut by language and
source) are sorted by a multikey quicksort whose characters are eight bytes wide: the slice is sorted by the first
character, and every run of equal ones is a smaller slice that is sorted by the next. A run that stays equal to its
words' ends is a term; its length is the count, and the changes of document within it are the document frequency.
Only the runs, one row each, are shuffled, once, by (language, term), which gives document frequencies, counts per
source and counts per language together.

Divergences of pairs are summed over blocks of terms: a task takes all sources of a language for one block, in which
absent terms count too, so no pair is emitted per term. A block has at most CELLS (source, term) cells.

Fractions are integers: 1 + floor(1e9 * (count + 5) / (total + 5 * terms)), by exact decimal division.

Defined results: null text, language and source count as ''. Every row is a document, repeated rows and ids too, so
doc_id is not read. Sources without kept terms have the fraction of count 0 for every kept term; a language without
kept terms gives pairs of value 0. Ties of values are ranked by the item's UTF-8 bytes. Very long texts and words are
worked through whole. Further columns are left out. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import stored

SLICE_BYTES = 8 << 20
CELLS = 1 << 16
LEAST_DOCS, TOP, UNIT, EXTRA = 30, 50, 10 ** 9, 5

_BYTES = np.arange(256, dtype=np.uint8)
_UPPER = (_BYTES >= ord("A")) & (_BYTES <= ord("Z"))
_LETTER = _UPPER | ((_BYTES >= ord("a")) & (_BYTES <= ord("z"))) | (_BYTES >= 128)
_LOWER = np.where(_UPPER, _BYTES + 32, _BYTES).astype(np.uint8)
# Keeps the first k bytes of a character of eight.
_KEEP = np.array([0] + [(1 << 64) - (1 << (64 - 8 * k)) for k in range(1, 9)], dtype=np.uint64)


def _characters(data: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The eight bytes at each pointer as one number, zero behind the word's end. `data` ends in eight spare bytes."""
    rows = np.lib.stride_tricks.sliding_window_view(data, 8)[np.minimum(at, len(data) - 8)]
    return rows.view(">u8").ravel().astype(np.uint64) & _KEEP[np.clip(left, 0, 8)]


def sort_pointers(data: np.ndarray, start: np.ndarray, length: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the words by (part, bytes), equal ones by place; and a flag at the first word of each equal run.

    `part` numbers the slices that are sorted for themselves, 0 upwards and never falling along the pointers.
    """
    n = len(start)
    order = np.empty(n, np.int64)
    borders = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [n]]) if n else np.zeros(1, int)
    key = _characters(data, start, length)
    for a, z in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
        order[a:z] = np.argsort(key[a:z]) + a
    new = np.ones(n, bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (part[order][1:] != part[order][:-1])
    depth = 8
    open_at, run = np.arange(n), np.cumsum(new) - 1  # places in the order that may still have to move, and their runs
    while True:
        sizes = np.bincount(run)
        longer = np.zeros(len(sizes), bool)
        longer[run[length[order[open_at]] > depth]] = True
        keep = (longer & (sizes > 1))[run]
        open_at, run = open_at[keep], run[keep]
        if not len(open_at):
            break
        words = order[open_at]
        key = _characters(data, start[words] + depth, length[words] - depth)
        inner = np.lexsort((key, run))
        order[open_at] = words[inner]
        key = key[inner]
        edge = np.ones(len(run), bool)
        edge[1:] = (key[1:] != key[:-1]) | (run[1:] != run[:-1])
        new[open_at] |= edge
        run = np.cumsum(edge) - 1
        depth += 8
    place = (np.cumsum(new) - 1) << 32 | order  # equal words by place: documents come one after another
    place.sort()
    return place & ((1 << 32) - 1), new


def _runs(groups: list[tuple[str, str]], texts: list[pa.Array]) -> pa.RecordBatch:
    """Rows (lang, source, term, n, docs) of a slice; `groups` has the (lang, source) of every text."""
    names = sorted(set(groups))
    number = {g: i for i, g in enumerate(names)}
    codes = np.array([number[g] for g in groups], np.int64)
    by_group = np.argsort(codes, kind="stable")
    text = pa.concat_arrays(texts).take(pa.array(by_group))
    _, offsets, buffer = text.buffers()
    offsets = np.frombuffer(offsets, np.int32 if text.type == pa.string() else np.int64)[:len(text) + 1].astype(np.int64)
    data = np.frombuffer(buffer, np.uint8)[:offsets[-1]] if buffer is not None else np.zeros(0, np.uint8)
    letter = np.concatenate([[False], _LETTER[data], [False]])
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    begins = letter[1:] & (~letter[:-1] | border)
    ends = letter[:-1] & (~letter[1:] | border)
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    length = end - start
    doc = np.searchsorted(offsets, start, side="right") - 1
    part = codes[by_group][doc]
    lower = np.concatenate([_LOWER[data], np.zeros(8, np.uint8)])
    order, new = sort_pointers(lower, start, length, part)
    first = np.flatnonzero(new)
    new_doc = new.copy()
    new_doc[1:] |= doc[order][1:] != doc[order][:-1]
    n = np.diff(np.append(first, len(order)))
    docs = np.add.reduceat(new_doc, first, dtype=np.int64) if len(first) else first
    # the terms' bytes, read through the first pointer of each run
    at, size = start[order[first]], length[order[first]]
    place = np.concatenate([[0], np.cumsum(size)])
    spell = lower[np.repeat(at - place[:-1], size) + np.arange(place[-1])]
    term = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(place.astype(np.int64)), pa.py_buffer(spell)).cast(pa.string())
    of = pa.array(part[order[first]])
    lang, source = (pa.array([g[k] for g in names], pa.string()).take(of) for k in (0, 1))
    return pa.RecordBatch.from_arrays([lang, source, term, pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
                                      ["lang", "source", "term", "n", "docs"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups: list[tuple[str, str]] = []
    texts: list[pa.Array] = []
    size = 0
    for batch in batches:
        groups += zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), strict=True)
        texts.append(batch["text"])
        size += batch["text"].nbytes
        if size >= SLICE_BYTES:
            yield _runs(groups, texts)
            groups, texts, size = [], [], 0
    if groups:
        yield _runs(groups, texts)


def term_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, source, n, lang_n, lead) of the terms in at least `least_docs` documents of their language.

    `n` counts a term in a source, `lang_n` in its language; `lead` is true in one row of each term.
    """
    runs = docs.mapInArrow(_count, "lang STRING, source STRING, term STRING, n BIGINT, docs BIGINT")
    sums = runs.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    kept = sums.select("lang", "term", "source", "n", F.sum("n").over(w).alias("lang_n"), F.sum("docs").over(w).alias("docs"),
                       (F.col("source") == F.min("source").over(w)).alias("lead"))
    return stored(kept.where(F.col("docs") >= least_docs).drop("docs"), "term-counts")


def _fraction(n: Column, total: Column, terms: Column) -> Column:
    whole = n.cast("decimal(20,0)") + F.lit(EXTRA)
    return F.lit(1) + F.call_function("div", whole * F.lit(UNIT), total.cast("decimal(20,0)") + terms.cast("decimal(20,0)") * F.lit(EXTRA))


def _distances(key: tuple, scored: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums of |p - q| over one block of terms, for every pair of sources of a language."""
    lang = key[0].as_py()
    groups = groups.sort_by("source")
    names = groups["source"].combine_chunks()
    term = scored["term"].combine_chunks().dictionary_encode()
    row = pa.compute.index_in(scored["source"].combine_chunks(), names).to_numpy(zero_copy_only=False)
    p = np.repeat(groups["p0"].fill_null(0).to_numpy()[:, None], len(term.dictionary), axis=1)
    p[row, term.indices.to_numpy(zero_copy_only=False)] = scored["p"].to_numpy()
    parts = []
    for i in range(len(names) - 1):
        far = np.abs(p[i + 1:] - p[i]).sum(axis=1)
        parts.append(pa.table({"lang": pa.array([lang] * len(far), pa.string()), "a": pa.repeat(names[i], len(far)),
                               "b": names[i + 1:], "value": pa.array(far, pa.int64())}))
    empty = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())]).empty_table()
    return pa.concat_tables(parts) if parts else empty


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): distances of the other sources, and the terms a source overuses most."""
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    kept = term_counts(docs.select(*text), least_docs)
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("lead").alias("terms"))
    groups = docs.select(*text[:2]).distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = stored(groups.na.fill(0, ["total", "lang_total", "terms"]), "source-groups")
    scored = kept.join(groups, ["lang", "source"]).withColumn("p", _fraction(F.col("n"), F.col("total"), F.col("terms")))

    q = _fraction(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    over = scored.withColumn("value", F.col("p") - q).where("value > 0")
    terms = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")

    blocks = groups.groupBy("lang").agg(F.max("terms").alias("terms"), F.count("*").alias("sources")).select(
        "lang", F.greatest(F.lit(1), F.ceil(F.col("terms") * F.col("sources") / CELLS)).alias("blocks"))
    p0 = F.when(F.col("terms") > 0, _fraction(F.lit(0), F.col("total"), F.col("terms")))
    each = groups.join(blocks, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", p0.alias("p0"))
    cells = scored.join(blocks, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "source", "term", "p")
    pairs = cells.groupBy("lang", "block").cogroup(each.groupBy("lang", "block")).applyInArrow(
        _distances, "lang STRING, a STRING, b STRING, value BIGINT")
    pairs = stored(pairs.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "source-pairs")
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    both = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return both.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top))
