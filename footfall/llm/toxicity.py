"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Labels are read only of documents whose crc32(doc_id as text) mod 3 is not 1. The lexicon has words and word beginnings
that toxic documents have far more often, counted over all rows with such a label. Trees and calibration learn, on
disjoint rows, from a sample of at most about `MAX_LABELLED` labelled rows, chosen by a hash of doc_id; their features
come from a lexicon of the other half of the rows. Scores take whole texts of all.

Features, per text: densities and weights of lexicon hits, nearness of hits to second-person words, capitals,
punctuation, and signs of obfuscation. Neither doc_id, lang, source nor labels enter a score.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.llm.common import hex_sha, stored

MAX_LABELLED = 30_000
PREFIXES = (4, 5, 6)
# A term of the lexicon is in at least so many toxic documents, so large a share of them, and has such log odds.
LEAST_DOCS, LEAST_SHARE, LEAST_LOG_ODDS = 3, 0.001, 2.5
THRESHOLD = 0.7
NEAR = 5
# A task forgets the words it knows beyond so many characters of them.
KEEP_CHARS = 20_000_000
# Common insults and second-person words.
INSULTS = ("idiot moron loser stupid dumb scum trash garbage worthless pathetic disgusting clown fool ugly freak filth liar "
           "imbécile idiote crétin débile nul idiota imbécil estúpido tonto basura dumm dummkopf abschaum müll trottel").split()
SECOND_PERSON = "you your yours yourself u ur tu toi ton ta tes vous votre vos du dich dir dein deine ihr euch usted ustedes tus te".split()
_LEET = str.maketrans("013457@$!*", "oieastasi.")
_WORD = re.compile(r"\S+")
_THRICE = re.compile(r"(.)\1\1", re.S)
_STRIP = ".,;:!?\"'()[]{}<>|#$%&*+=~^/\\@`_…-"
FEATURES = ("words", "insults", "term_density", "prefix_density", "term_hits", "weight_density", "weight_most", "second_person",
            "near_second_person", "nearest", "capitals", "capital_words", "exclamation", "question", "punctuation", "digits_in_words",
            "symbols_in_words", "stretched", "leet_insults")
# What a word says on its own; white space has none of it, so sums over words are sums over the text.
FACTS = ("insult", "term", "prefix", "weight", "second_person", "capital_word", "digit_in_word", "symbol_in_word", "stretched",
         "leet_insult", "upper", "exclamation", "question", "punctuation")


def learns(doc_id: Column) -> Column:
    """Whether the document's label may be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def _terms(text: Column) -> Column:
    """Distinct words of a text and, marked by *, their beginnings."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 2)
    ends = [F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*"))) for n in PREFIXES]
    return F.array_distinct(F.concat(words, *ends))


def term_counts(labelled: DataFrame) -> DataFrame:
    """term, t0, n0, t1, n1: toxic and all documents with the term, of rows (text, toxic, half), by half.

    Terms are summed up within tasks before they are shuffled.
    """
    terms = labelled.select("toxic", "half", F.explode(_terms(F.col("text"))).alias("term"))
    sums = [F.sum(F.when(F.col("half") == h, x)).alias(f"{name}{h}") for h in (0, 1) for name, x in (("t", F.col("toxic")), ("n", F.lit(1)))]
    return terms.groupBy("term").agg(*sums).na.fill(0)


def lexicon(counts: DataFrame, totals: dict[int, tuple[int, int]], halves: tuple[int, ...]) -> dict[str, float]:
    """Log odds of the terms that mark toxic texts in the given halves; totals: documents and toxic ones of each half.

    A term is in LEAST_SHARE of all toxic documents, so there are at most 1 / LEAST_SHARE times as many terms as a toxic
    document has on average, whatever the number of documents.
    """
    n, toxic = (sum(totals.get(h, (0, 0))[i] for h in halves) for i in (0, 1))
    if not n or not toxic or toxic == n:
        return {}
    t, all_ = (sum((F.col(f"{name}{h}") for h in halves[1:]), F.col(f"{name}{halves[0]}")) for name in "tn")
    odds = F.log((t + 0.5) / F.lit(toxic + 1.0)) - F.log((all_ - t + 0.5) / F.lit(n - toxic + 1.0))
    rows = counts.where((t >= max(LEAST_DOCS, LEAST_SHARE * toxic)) & (odds >= LEAST_LOG_ODDS)).select("term", odds.alias("odds"))
    return {r.term: r.odds for r in rows.collect()}


class _Words(dict):
    """The row in `table` of each word seen before: what it says on its own."""

    def __init__(self, terms: dict[str, float]):
        super().__init__()
        self.terms, self.insults, self.second = terms, set(INSULTS), set(SECOND_PERSON)
        self.begins = [(n, {t[:-1]: w for t, w in terms.items() if t[-1] == "*" and len(t) == n + 1}) for n in PREFIXES]
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.table, self.new, self.chars = np.zeros((0, len(FACTS)), np.float32), [], 0

    def __missing__(self, raw: str) -> int:
        self[raw] = at = len(self)
        self.new.append(self._fact(raw))
        self.chars += len(raw) + 50
        return at

    def rows(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def facts(self, rows: np.ndarray) -> np.ndarray:
        if self.new:
            self.table, self.new = np.concatenate([self.table, np.array(self.new, np.float32)]), []
        return self.table[rows]

    def _fact(self, raw: str) -> tuple:
        word = raw.lower().strip(_STRIP)
        weight, begin = self.terms.get(word, 0.0), 0.0
        for n, known in self.begins:
            if len(word) > n:
                begin = max(begin, known.get(word[:n], 0.0))
        if word.isalpha():  # most words: nothing to look for among the characters
            digit = symbol = leet = False
            stretched = _THRICE.search(word) is not None
        else:
            letters = any(map(str.isalpha, word))
            digit = letters and any(map(str.isdigit, word))
            symbol = letters and any(not c.isalnum() and c not in "'’-" for c in word)
            stretched = any(m[1].isalpha() for m in _THRICE.finditer(word))
            plain = word.translate(_LEET).replace(".", "")
            leet = plain != word and (plain in self.insults or self.terms.get(plain, 0.0) > 0)
        marks = (0, 0, 0) if raw.isalpha() else (raw.count("!"), raw.count("?"), sum(map(raw.count, ".,;:#$%&*")))
        return (word in self.insults, weight > 0, begin > 0, max(weight, begin), word in self.second, len(raw) > 2 and raw.isupper(),
                digit, symbol, stretched, leet, 0 if raw.islower() else sum(map(str.isupper, raw)), *marks)


def batch_features(texts: list[str], words: _Words) -> np.ndarray:
    """One row of features per text; a text without words has zeros. Each distinct word is looked at once."""
    out = np.zeros((len(texts), len(FEATURES)))
    rows = [words.rows(_WORD.findall(t)) for t in texts]
    full = [i for i, r in enumerate(rows) if len(r)]
    if full:
        n = np.array([len(rows[i]) for i in full])
        chars = np.array([len(texts[i]) for i in full])
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        x = words.facts(np.concatenate([rows[i] for i in full]))
        f = dict(zip(FACTS, np.add.reduceat(x, starts, axis=0, dtype=np.float64).T, strict=True))
        hit = (x[:, FACTS.index("weight")] > 0) | (x[:, 0] > 0)
        hits = np.add.reduceat(hit, starts, dtype=np.int64)
        near, nearest = np.zeros(len(full)), np.zeros(len(full))
        second = x[:, FACTS.index("second_person")] > 0
        for i in np.flatnonzero((hits > 0) & (f["second_person"] > 0)):
            a, b = starts[i], starts[i] + n[i]
            here, other = np.flatnonzero(hit[a:b]), np.flatnonzero(second[a:b])
            at = np.searchsorted(other, here)
            gaps = np.minimum(np.abs(here - other[np.minimum(at, len(other) - 1)]), np.abs(here - other[np.maximum(at - 1, 0)]))
            near[i], nearest[i] = (gaps <= NEAR).sum() / n[i], 1 / (1 + gaps.min())
        most = np.maximum.reduceat(x[:, FACTS.index("weight")], starts)
        out[full] = np.column_stack([
            np.log1p(n), f["insult"] / n, f["term"] / n, f["prefix"] / n, np.log1p(hits), f["weight"] / n, most, f["second_person"] / n,
            near, nearest, f["upper"] / chars, f["capital_word"] / n, f["exclamation"] / n, f["question"] / n, f["punctuation"] / chars,
            f["digit_in_word"] / n, f["symbol_in_word"] / n, f["stretched"] / n, f["leet_insult"] / n])
    if words.chars > KEEP_CHARS:
        words.forget()
    return out


def features(docs: DataFrame, terms: dict[str, float], *keep: str, text: str = "text") -> DataFrame:
    """The columns `keep` and x, the features, of every row. Null text counts as empty: all zero."""
    rows = docs.select(*dict.fromkeys([*keep, text]))
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # of a bounded number, see lexicon

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(shared.value)
        for batch in batches:
            x = batch_features([t or "" for t in batch[text].to_pylist()], words)
            ends = np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*[batch[k] for k in keep], pa.ListArray.from_arrays(ends, x.ravel())], [*keep, "x"])

    return rows.mapInArrow(run, T.StructType([*[rows.schema[k] for k in keep], T.StructField("x", T.ArrayType(T.DoubleType()))]))


def _labelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """text, toxic, part and half of the documents that have a label in `known`."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("part")), F.lit(10))
    joined = texts.where(learns(F.col("doc_id"))).join(known, "doc_id")
    return joined.select("text", "toxic", part.alias("part")).withColumn("half", F.col("part") % 2)


def _learned(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], Callable[[DataFrame], DataFrame]]:
    """The lexicon, and what puts a score in place of the features x of a frame."""
    known = labels.where(F.col("toxic").isNotNull() & learns(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = stored(known, "toxicity-labels")
    rate = min(1.0, MAX_LABELLED / max(known.count(), 1)) * 1_000_000
    dealt = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxicity")), F.lit(1_000_000))
    # Labels grow with the documents, so texts and labels meet in a shuffle at every size; those of the sample, about
    # MAX_LABELLED at most, go to the texts.
    labelled = _labelled(docs, known.hint("merge"))
    counts = stored(term_counts(labelled).where(F.col("t0") + F.col("t1") >= LEAST_DOCS), "toxicity-terms")
    totals = {r.half: (r.n, r.t) for r in labelled.groupBy("half").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).collect()}
    sample = stored(_labelled(docs, F.broadcast(known.where(dealt < rate))), "toxicity-labelled")
    halves = [sample.where(F.col("half") == h) for h in (0, 1)]
    # rows to learn from get the features that the other half's lexicon gives them
    own = [features(halves[h], lexicon(counts, totals, (1 - h,)), "part", "toxic") for h in (0, 1)]
    fit = stored(own[0].unionByName(own[1]), "toxicity-rows").withColumn("features", array_to_vector("x"))
    terms = lexicon(counts, totals, (0, 1))
    shares = {r.late: (r.n, r.t) for r in fit.groupBy((F.col("part") >= 8).alias("late")).agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).collect()}
    if len(shares) < 2 or any(t in (0, n) for n, t in shares.values()):
        all_, toxic = (sum(v) for v in zip(*shares.values(), strict=True)) if shares else (1, 0)
        return terms, lambda x: x.withColumn("score", F.lit(toxic / all_)).drop("x")
    trees = GBTClassifier(labelCol="toxic", maxIter=20, maxDepth=3, stepSize=0.3, seed=7, maxBins=64).fit(fit.where("part < 8").coalesce(4))

    def raw(x: DataFrame, *keep: str) -> DataFrame:
        return trees.transform(x).select(*keep, F.element_at(vector_to_array("probability"), 2).alias("raw"))

    late = raw(fit.where("part >= 8"), "toxic")
    iso = IsotonicRegression(featuresCol="raw", labelCol="toxic", predictionCol="calm").fit(late.select("raw", "toxic").coalesce(1))

    def scored(x: DataFrame) -> DataFrame:
        keep = [c for c in x.columns if c != "x"]
        x = iso.transform(raw(x.withColumn("features", array_to_vector("x")), *keep))
        # a trace of the raw score keeps the order within a step of the calibration
        value = F.col("calm") * 0.999 + F.col("raw") * 0.001
        return x.select(*keep, F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)).alias("score"))
    return terms, scored


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, sha, held_out, score, predicted of every row; see the module for what is learned from what.

    A doc_id with several labels counts as toxic if one of them says so; null labels and null doc_ids teach nothing.
    Without labels of both classes every score is the share of toxic labels, 0 if there are none. Equal texts get equal
    scores. Repeated rows are scored each; an empty table gives no rows.
    """
    terms, scored = _learned(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", hex_sha(F.coalesce("text", F.lit(""))).alias("sha"))
    held = (~learns(F.col("doc_id")) & F.col("doc_id").isNotNull()).alias("held_out")
    x = scored(features(rows, terms, "doc_id", "sha"))
    return x.select("doc_id", "sha", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns; rows pass through the model, none is shuffled."""
    terms, scored = _learned(docs, labels)
    names = [f"c{i}" for i in range(len(docs.columns))]  # whatever the columns are called
    text = names[[c.lower() for c in docs.columns].index("text")]
    x = scored(features(docs.toDF(*names), terms, *names, text=text))
    return x.where(F.col("score") < THRESHOLD).select(*names).toDF(*docs.columns)
