"""Spelling variant grouping: words one edit apart, found through a variable-length gram index.

1. Words are counted over all texts; tasks sum up before the shuffle.
2. A gram dictionary is pruned by frequency: a gram is extended by one more character, up to MOST_GRAM, as long as it
   is frequent, that is, as long as it has at least 1/DICTIONARY of all places in words. The frequent grams, at most
   DICTIONARY of each length, are all that the tasks have to know, so their broadcast is bounded.
3. A word, with a mark at each end, is decomposed into the longest grams of the dictionary at each place; a gram inside
   another one is left out. An edit at place i can only affect grams that end in (i, i + MOST_GRAM]: those further left
   end before it, those further right cannot be covered by a gram that starts at or left of it. This gives for every
   word the vector of affected grams, and both words of a pair share all the others at the same place from their end.
4. Lists are merged by these bounds: for each place of an edit, the word is listed under all its unaffected grams at
   once, the run at the left and the run at the right of the place. A pair one edit apart shares such a list for the
   place of its edit. Marks and least word length see to it that a list always holds a gram. Members of a list differ
   in the few characters between the two runs, whose edit distance verifies the pair.
5. Each word's best near word is its form; forms are followed by pointer doubling on stored tables.

No list is held in one task's memory: lists meet in a sort-merge join that spills, and adaptive execution splits a
long one.

Defined results: null and empty texts have no words; a null doc_id counts as '' in the checksum. Every row counts,
repeated ones too. Ties of n take the smallest word by code points. A word that loses its code point to the rule below
may become shorter than `least_chars` and is then left out. Further columns are left out. An empty table gives no
rows. Texts and words are worked through whole, whatever their length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import rows_of, stored

LEAST_CHARS, LEAST_COUNT, TIMES = 5, 3, 2
LEAST_GRAM, MOST_GRAM = 2, 3
DICTIONARY = 20_000
FLUSH_WORDS = 200_000
# Letters A-Z, a-z and U+00C0..U+00FF in UTF-8.
_WORD = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
_START, _END = "\x02", "\x03"


def _own_word(word: bytes, checksum: int) -> str:
    """The word without the code point that its checksum names, for checksums that 97 divides."""
    s = word.decode()
    at = checksum % len(s)
    return s[:at] + s[at + 1:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        found = pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.binary()).cast(pa.string()),
                                            "n": pa.array(list(total.values()), pa.int64())})
        total.clear()
        return found

    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            words = Counter(_WORD.findall(text.encode().lower()))
            start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for w in [w for w in words if not zlib.crc32(w, start) % 97]:
                n = words.pop(w)
                total[_own_word(w, zlib.crc32(w, start)).encode()] += n
            total.update(words)
            if len(total) >= FLUSH_WORDS:
                yield flush()
    yield flush()


def word_counts(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words with at least `least_chars` code points and `least_count` occurrences."""
    found = rows_of(docs).mapInArrow(_count, "word STRING, n BIGINT").where(F.length("word") >= least_chars)
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def marked(word: str, least_chars: int, most: int) -> str:
    """The word with so many marks at its ends that no edit can affect all its grams."""
    marks = max(1, -(-(2 * most + 1 - least_chars) // 2))
    return _START * marks + word + _END * marks


def decompose(word: str, frequent: set[str], least: int, most: int) -> list[tuple[int, int]]:
    """(start, end) of the word's grams in the dictionary, by start and by end."""
    grams, reach = [], 0
    for start in range(len(word) - least + 1):
        end = start + least
        while end < len(word) and end - start < most and word[start:end] in frequent:
            end += 1
        if end > reach:
            grams.append((start, end))
            reach = end
    return grams


def unaffected(grams: list[tuple[int, int]], size: int, most: int, longer: bool) -> set[tuple[int, int]]:
    """(end of the left run, start of the right run) for every place of an edit in a marked word.

    `longer`: a character of the word is replaced or deleted; else one is inserted before a place.
    """
    found = set()
    left = right = 0
    for i in range(1, size - longer):
        while left < len(grams) and grams[left][1] <= i:
            left += 1
        while right < len(grams) and grams[right][1] <= i + most - (not longer):
            right += 1
        found.add((grams[left - 1][1] if left else 0, grams[right][0] if right < len(grams) else size))
    return found


def _lister(frequent: set[str], least_chars: int, least: int, most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"list": [], "middle": [], "longer": [], "word": [], "n": []}
            for word, n in zip(batch["word"].to_pylist(), batch["n"].to_pylist(), strict=True):
                s = marked(word, least_chars, most)
                grams = decompose(s, frequent, least, most)
                for longer in (True, False):
                    size = len(word) + (not longer)
                    for a, z in unaffected(grams, len(s), most, longer):
                        out["list"].append(f"{size} {s[:a]} {s[z:]}")
                        out["middle"].append(s[a:z])
                        out["longer"].append(longer)
                        out["word"].append(word)
                        out["n"].append(n)
            yield pa.RecordBatch.from_pydict(out, schema=_LISTED)
    return run


_LISTED = pa.schema([("list", pa.string()), ("middle", pa.string()), ("longer", pa.bool_()), ("word", pa.string()), ("n", pa.int64())])


def _gram_counter(least: int, most: int, least_chars: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[str] = Counter()
            for word in batch["word"].to_pylist():
                s = marked(word, least_chars, most)
                for k in range(least, most):
                    counts.update(s[i:i + k] for i in range(len(s) - k + 1))
            yield pa.RecordBatch.from_pydict({"gram": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})
    return run


def frequent_grams(words: DataFrame, least_chars: int = LEAST_CHARS, least: int = LEAST_GRAM, most: int = MOST_GRAM,
                   dictionary: int = DICTIONARY) -> set[str]:
    """Grams that the dictionary extends: those with at least 1/`dictionary` of all places, so at most that many a length."""
    grams = words.select("word").mapInArrow(_gram_counter(least, most, least_chars), "gram STRING, n BIGINT")
    grams = stored(grams.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    places = grams.groupBy(F.length("gram").alias("size")).agg(F.sum("n").alias("places"))
    often = grams.join(places, F.length("gram") == F.col("size")).where(F.col("n") * dictionary >= F.col("places"))
    return {r.gram for r in often.select("gram").collect()}


def near_pairs(words: DataFrame, least_chars: int = LEAST_CHARS, least: int = LEAST_GRAM, most: int = MOST_GRAM,
               dictionary: int = DICTIONARY) -> DataFrame:
    """(word, n, other, other_n) of all words one insertion, deletion or replacement apart, both ways, each once."""
    frequent = frequent_grams(words, least_chars, least, most, dictionary)
    listed = words.mapInArrow(_lister(frequent, least_chars, least, most), "list STRING, middle STRING, longer BOOLEAN, word STRING, n BIGINT")
    listed = stored(listed.withColumn("list", F.xxhash64("list")), "gram-lists")
    a, b = listed.where("longer").alias("a"), listed.alias("b")
    # of a list's members of one length each pair is met once; equal hashes of lists are no proof, so words are compared last
    once = ~F.col("b.longer") | (F.col("a.word") < F.col("b.word"))
    near = (F.levenshtein(F.col("a.middle"), F.col("b.middle"), 1) == 1) & (F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1)
    pairs = a.join(b, (F.col("a.list") == F.col("b.list")) & once & near).select(
        F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("other"), F.col("b.n").alias("other_n"))
    both = F.array(F.struct("word", "n", "other", "other_n"),
                   F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    return pairs.distinct().select(F.inline(both))


def forms(words: DataFrame, pairs: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n): the near word of largest n, where that is at least `times` the word's own."""
    best = F.min(F.struct((-F.col("other_n")).alias("m"), "other"))
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    far = -F.col("best.m") >= F.col("n") * times
    return words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(far, F.col("best.other")).alias("form"),
        F.when(far, -F.col("best.m")).alias("form_n"))


def with_root(found: DataFrame) -> DataFrame:
    """Add `root`, the last form. Counts at least double from form to form, so chains are short and have no circles."""
    at = stored(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "forms")
    while True:
        jump = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = at.join(jump, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        new = stored(new, "roots")
        at = new.select("word", "root")
        if new.where("moved").isEmpty():
            return found.join(at, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the documents."""
    words = stored(word_counts(docs, least_chars, least_count), "words")
    found = stored(forms(words, near_pairs(words, least_chars), times), "word-forms")
    return with_root(found).select("word", "form", "root", "n", "n_near", "form_n")
