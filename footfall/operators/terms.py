"""Terms of a text corpus: splitting, stop words, synonyms."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The explodes below are outer ones: for an inner one Spark infers a "not empty"
# filter and splits every text once more to evaluate it.

# Everything that is neither a letter nor a digit separates terms.
SEPARATORS = r"[^\p{L}\p{N}]+"


def _words(text: str):
    """Words in order; the first is empty if the text begins with a separator."""
    return F.split(F.lower(text), SEPARATORS)


def _without_stop_words(terms, stop_words, stop_patterns):
    if stop_patterns:
        terms = terms.where(~F.col("term").rlike("^(?:" + "|".join(stop_patterns) + ")$"))
    if stop_words is not None:
        terms = terms.join(stop_words, "term", "left_anti")
    return terms


def document_terms(docs: DataFrame, stop_words: DataFrame | None = None, stop_patterns: Sequence[str] = (),
                   key: str = "doc_id", text: str = "text") -> DataFrame:
    """Whole documents -> (document, position, term), lower case, without stop words.

    `stop_words` has a column `term`; `stop_patterns` are regular expressions
    that must match the whole term. Positions only increase; they keep the gaps
    of removed words. Nothing is shuffled.
    """
    terms = docs.select(key, F.posexplode_outer(_words(text)).alias("position", "term")).where(F.col("term") != "")
    return _without_stop_words(terms, stop_words, stop_patterns).select(key, "position", "term")


def document_term_counts(terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """Occurrences per (document, term) of `document_terms` output."""
    return terms.groupBy(key, "term").agg(F.count("*").alias("n"))


def term_counts(docs: DataFrame, stop_words: DataFrame | None = None, stop_patterns: Sequence[str] = (),
                text: str = "text") -> DataFrame:
    """Occurrences and number of documents per term over the corpus.

    A document contributes every word to `n` and its distinct words to `docs`,
    so the only shuffle is that of the terms, already summed up per task. The
    stop list is applied to the sums.
    """
    words = docs.select(_words(text).alias("_words"))
    # One array per document: all words, then the distinct ones.
    both = words.select(F.size("_words").alias("_all"), F.concat("_words", F.array_distinct("_words")).alias("_both"))
    seen = both.select("_all", F.posexplode_outer("_both").alias("_at", "term")).where(F.col("term") != "")
    sums = seen.groupBy("term").agg(
        F.count_if(F.col("_at") < F.col("_all")).alias("n"),
        F.count_if(F.col("_at") >= F.col("_all")).alias("docs"))
    return _without_stop_words(sums, stop_words, stop_patterns).select("term", "n", "docs")


def synonym_heads(lines: DataFrame, value: str = "value") -> DataFrame:
    """Tab-separated synonym lines -> (term, head); the first word of a line is its head.

    A word listed on several lines belongs to the first head in sort order.
    """
    words = F.split(F.col(value), "\t")
    pairs = lines.select(F.trim(words[0]).alias("head"), F.explode(words).alias("term"))
    return (pairs.select(F.trim("term").alias("term"), "head").where(F.col("term") != "")
            .groupBy("term").agg(F.min("head").alias("head")))


def normalize_synonyms(terms: DataFrame, heads: DataFrame) -> DataFrame:
    """Replace each term by the head of its synonym line."""
    return (terms.join(heads, "term", "left")
            .withColumn("term", F.coalesce("head", "term")).drop("head"))


# Words a segmentation may know; the list goes to every task.
MOST_WORDS = 1_000_000
# What an unknown character costs more than the rarest possible word, in the units below.
UNKNOWN = 5_000_000
_NEPER = 1_000_000  # costs are whole millionths of the logarithm, so sums are exact and ties are ties
_PER_WORD = 1000    # of equally probable paths the one with fewer words costs less

Path = tuple[int, tuple[str, ...]]  # cost and words of an entry


class Segmenter:
    """Cuts runs of letters into the most probable words of a weighted list.

    The list is a trie, kept as a table of all beginnings of its entries. A path through a run costs the sum of its
    words' costs, -ln of their share of all weights; unknown characters stand for themselves. Of equal paths the one
    with fewer words is taken, then the one with the longer last word. `forced` maps strings to the words they are to
    be cut into wherever a path can use them.
    """

    def __init__(self, weights: Mapping[str, int], forced: Mapping[str, Sequence[str]] | None = None):
        total = sum(weights.values())
        self.trie: dict[str, Path | None] = {}
        for word, n in weights.items():
            self._add(word, (round(_NEPER * math.log(total / n)) * _PER_WORD + 1, (word,)))
        for whole, parts in (forced or {}).items():
            self._add(whole, (1, tuple(parts)))
        self.unknown = (round(_NEPER * math.log(total)) + UNKNOWN if total else UNKNOWN) * _PER_WORD + 1

    def _add(self, word: str, path: Path) -> None:
        for end in range(1, len(word)):
            self.trie.setdefault(word[:end], None)
        self.trie[word] = path

    def cut(self, run: str) -> list[str]:
        best: list[tuple[int, int]] = [(0, 0)] + [(-1, 0)] * len(run)  # cost of the best path to a place, start of its last entry
        for start in range(len(run)):
            so_far = best[start][0]
            for end in range(start + 1, len(run) + 1):
                piece = run[start:end]
                if piece not in self.trie:
                    if end > start + 1:
                        break
                    path = None
                else:
                    path = self.trie[piece]
                cost = path[0] if path else self.unknown if end == start + 1 else None
                if cost is not None and (best[end][0] < 0 or so_far + cost < best[end][0]):
                    best[end] = (so_far + cost, start)
                if piece not in self.trie:
                    break
        pieces, end = [], len(run)
        while end:
            start = best[end][1]
            piece = run[start:end]
            path = self.trie.get(piece)
            pieces.append(path[1] if path else (piece,))
            end = start
        return [word for words in reversed(pieces) for word in words]


# A task hands on about so many terms at once, and forgets the runs it knows beyond so many characters of them.
PIECE_TERMS = 20_000
KNOWN_CHARS = 2_000_000


def _segmented(segmenter: Segmenter, key_type: pa.DataType) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, list[str]] = {}
        size = 0
        for batch in batches:
            runs, ends = batch["runs"], pa.compute.list_value_length(batch["runs"]).fill_null(0).to_pylist()

            def piece(keys, positions, found):
                return pa.RecordBatch.from_arrays([batch["key"].take(pa.array(keys, pa.int64())).cast(key_type), pa.array(positions, pa.int32()),
                                                   pa.array(found, pa.string())], ["key", "position", "term"])

            keys, positions, found = [], [], []
            for i, n in enumerate(ends):
                at = 0
                for begin in range(0, n, PIECE_TERMS):  # a long text's runs come from Arrow a piece at a time
                    for r in runs[i].values.slice(begin, PIECE_TERMS).to_pylist():
                        words = memory.get(r)
                        if words is None:
                            size += len(r) + 50
                            if size > KNOWN_CHARS:
                                memory.clear()
                                size = len(r) + 50
                            words = memory[r] = segmenter.cut(r)
                        keys += [i] * len(words)
                        positions += range(at, at + len(words))
                        found += words
                        at += len(words)
                        if len(found) >= PIECE_TERMS:
                            yield piece(keys, positions, found)
                            keys, positions, found = [], [], []
            yield piece(keys, positions, found)
    return run


def segmenter_of(lexicon: DataFrame, user_words: DataFrame | None = None, forced: Mapping[str, Sequence[str]] | None = None) -> Segmenter:
    """A segmenter for the words (term, n); `user_words` (term) are as probable as the most frequent word."""
    listed = lexicon.where("n > 0 AND term <> ''").groupBy("term").agg(F.sum("n").alias("n"))
    rows = listed.limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"the word list has more than {MOST_WORDS} words")
    weights = {r.term: r.n for r in rows}
    if user_words is not None:
        own = user_words.where("term <> ''").select("term").distinct().limit(MOST_WORDS + 1).collect()
        if len(own) > MOST_WORDS:
            raise ValueError(f"the user's word list has more than {MOST_WORDS} words")
        most = max(weights.values(), default=1)
        weights.update({r.term: most for r in own})
    return Segmenter(weights, forced)


def segmented_terms(docs: DataFrame, segmenter: Segmenter, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(document, position, term): every run of letters, in lower case, cut into words of a dictionary.

    For texts that do not separate words. Whatever is no letter ends a run and is left out. Nothing is shuffled; runs
    are found by SQL functions and cut in Arrow batches, each different run once as long as a task remembers it.
    """
    runs = docs.select(F.col(key).alias("key"), F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), 0).alias("runs"))
    kind = docs.schema[key].dataType
    from pyspark.sql.pandas.types import to_arrow_type
    out = runs.mapInArrow(_segmented(segmenter, to_arrow_type(kind)), f"key {kind.simpleString()}, position INT, term STRING")
    return out.withColumnRenamed("key", key)
