import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from footfall.functions.special import incomplete_beta, log_gamma, student_p
from footfall.operators import stats, terms


def _scored(spark, data):
    return spark.createDataFrame(data, "score DOUBLE, label BOOLEAN")


@pytest.mark.parametrize("data", [
    [(0.0, True), (0.1, False), (0.1, True), (0.3, False), (1.0, True)],
    [(0.5, True), (0.5, False)],
    [(i / 7, i % 3 == 0) for i in range(50)],
    [(0.0, True), (None, True), (2.0, False)],
])
def test_threshold_sweep_equals_direct_counting(spark, data):
    got = {r.step_no: (r.tp, r.fn, r.fp) for r in stats.threshold_sweep(_scored(spark, data), steps=100).collect()}
    known = [p for p, _ in data if p is not None]
    lo, step = min(known), (max(known) - min(known)) / 100
    assert len(got) == 101
    for i in range(101):
        hit = [(y, p is not None and p < lo + i * step) for p, y in data]
        assert got[i] == (sum(y and h for y, h in hit), sum(y and not h for y, h in hit), sum(not y and h for y, h in hit))
    mid = stats.confusion_counts(_scored(spark, data), lo + 50 * step).first()
    if step and None not in [p for p, _ in data]:
        assert tuple(mid) == got[50]


def test_density(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.5), (4.0, 3.5)], "a DOUBLE, b DOUBLE")
    st = stats.feature_stats(df, ["a", "b"])
    r = st.first()
    for row in stats.gaussian_density(df, ["a", "b"], st).collect():
        want = 1.0
        for c in "ab":
            m, v = r[f"mean_{c}"], r[f"var_{c}"]
            want *= math.exp(-(row[c] - m) ** 2 / (2 * v)) / math.sqrt(2 * math.pi * v)
        assert row.density == pytest.approx(want)


def test_histograms(spark, rows):
    p = spark.createDataFrame([("A", -60.0), ("A", -50.0), ("A", -50.0), ("A", -55.0), ("B", -70.0)],
                              "device STRING, rssi DOUBLE")
    assert rows(stats.peak_rssi_histogram(p)) == [("A", 0, 1), ("A", 5, 1), ("A", 9, 2), ("B", 5, 1)]
    assert rows(stats.rssi_histogram(p), "rssi", "n")[2] == (-55.0, 1)


def test_welch(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 2.0), ("b", 6.0), ("b", 7.0), ("b", 9.0)],
                               "label STRING, value DOUBLE")
    r = stats.welch(stats.group_moments(df), "a", "b").first()
    ea, eb = (7 / 3) / 3, (26 / 3) / 4
    assert r.t == pytest.approx((7 / 3 - 6) / math.sqrt(ea + eb))
    assert r.df == pytest.approx((ea + eb) ** 2 / (ea ** 2 / 2 + eb ** 2 / 3))


def test_pivot_vectors_describe_clusters(spark, rows):
    df = spark.createDataFrame([("u", "a", 1.0), ("u", "a", 2.0), ("v", "b", 5.0)], "k STRING, c STRING, v DOUBLE")
    wide = stats.pivot_features(df, "k", "c", "v", ["a", "b"])
    assert rows(wide) == [("u", 3.0, 0.0), ("v", 0.0, 5.0)]
    assert rows(stats.pivot_features(df, "k", "c", "v", ["a"], "other")) == [("u", 3.0, 0.0), ("v", 0.0, 5.0)]
    assert [float(x) for x in stats.feature_vectors(wide, ["a", "b"]).orderBy("k").first().features] == [3.0, 0.0]
    assert rows(stats.describe(df, ["v"]), "column", "count", "min", "max") == [("v", 3.0, 1.0, 5.0)]
    gaps = spark.createDataFrame([(x,) for x in (1, 2, 3, 100, 101)], "seconds BIGINT")
    assert rows(stats.peak_interval_clusters(gaps), "centre") == [(2.0,), (100.5,)]


def test_terms(spark, rows):
    docs = spark.createDataFrame([(1, "The cat, the CAT is 2 - quick!"), (2, "!cat"), (3, ""), (4, None)],
                                 "doc_id BIGINT, text STRING")
    stop = spark.createDataFrame([("the",)], "term STRING")
    found = terms.document_terms(docs, stop, ["i."])
    assert rows(found, "doc_id", "term") == [(1, "2"), (1, "cat"), (1, "cat"), (1, "quick"), (2, "cat")]
    assert rows(terms.document_term_counts(found)) == [(1, "2", 1), (1, "cat", 2), (1, "quick", 1), (2, "cat", 1)]
    assert rows(terms.term_counts(docs, stop, ["i."])) == [("2", 1, 1), ("cat", 3, 2), ("quick", 1, 1)]
    heads = terms.synonym_heads(spark.createDataFrame([("pet\tcat\tdog",)], "value STRING"))
    assert rows(terms.normalize_synonyms(found, heads).groupBy("term").agg(F.count("*"))) == [("2", 1), ("pet", 3), ("quick", 1)]


def _plain_cost(values, ends):
    cost, a = 0.0, 0
    for z in ends:
        part = values[a:z]
        mean = sum(part) / len(part)
        cost += sum((v - mean) ** 2 for v in part)
        a = z
    return cost


@pytest.mark.parametrize("seed", range(12))
def test_clusters_are_the_best_there_are(spark, seed):
    """Against every choice of cuts; equal values, few distinct values, nulls."""
    rng = random.Random(seed)
    values = sorted(rng.choice([rng.randint(0, 9), rng.randint(0, 1000)]) for _ in range(rng.randint(1, 14)))
    k = rng.randint(1, 4)
    distinct = sorted(set(values))
    few = min(k, len(distinct))
    best = min(_plain_cost(values, [*cuts, len(values)])
               for cuts in itertools.combinations([i for i in range(1, len(values)) if values[i] != values[i - 1]], few - 1))
    df = spark.createDataFrame([(v,) for v in [*values, None]], "seconds BIGINT")
    got = stats.peak_interval_clusters(df, k).collect()
    ends = list(itertools.accumulate(r.n for r in got))
    assert [r.cluster for r in got] == list(range(few)) and ends[-1] == len(values)
    assert _plain_cost(values, ends) == pytest.approx(best)
    for r, a, z in zip(got, [0, *ends], ends):
        assert (r.low, r.high) == (values[a], values[z - 1]) and r.centre == pytest.approx(sum(values[a:z]) / (z - a))
    assert stats.peak_interval_clusters(df.limit(0)).count() == 0


def test_many_values_are_cut_in_time():
    ends = stats._best_cuts(np.arange(20_000.0), np.ones(20_000), 4)
    assert ends == [5000, 10_000, 15_000, 20_000]


def test_p_values(spark):
    """Closed forms for 1, 2 and 4 degrees of freedom, tabulated values, the normal limit."""
    cases = [(t, 1.0, 1 - 2 / math.pi * math.atan(t)) for t in (0.1, 1.0, 12.706204736, 700.0)]
    cases += [(t, 2.0, 1 - t / math.sqrt(2 + t * t)) for t in (0.01, 1.0, 4.30265273)]
    cases += [(t, 4.0, 1 - t / math.sqrt(4 + t * t) * (1 + 2 / (4 + t * t))) for t in (0.5, 2.0, 9.0)]
    cases += [(2.228138852, 10.0, 0.05), (3.169272673, 10.0, 0.01), (2.042272456, 30.0, 0.05), (1.983971519, 100.0, 0.05)]
    cases += [(x, 1e7, math.erfc(x / math.sqrt(2))) for x in (0.3, 1.959963985, 4.0)] + [(0.0, 5.0, 1.0), (None, 5.0, None), (1.0, None, None)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i INT, t DOUBLE, df DOUBLE, want DOUBLE")
    got = df.select("i", student_p(F.col("t"), F.col("df")).alias("p"), student_p(-F.col("t"), F.col("df")).alias("q")).orderBy("i").collect()
    for r, (_, _, want) in zip(got, cases):
        assert (r.p, r.q) == ((None, None) if want is None else (pytest.approx(want, abs=1e-7),) * 2)
    x = spark.createDataFrame([(v,) for v in (0.5, 1.0, 3.5, 120.0, 1e6)], "x DOUBLE").select("x", log_gamma(F.col("x")).alias("g"))
    assert all(r.g == pytest.approx(math.lgamma(r.x), rel=1e-12, abs=1e-10) for r in x.collect())
    beta = spark.range(11).select((F.col("id") / 10).alias("x")).select("x", incomplete_beta(F.col("x"), F.lit(3.0), F.lit(2.0)).alias("b"))
    assert all(r.b == pytest.approx(4 * r.x ** 3 - 3 * r.x ** 4, abs=1e-12) for r in beta.collect())


def test_segmentation_takes_the_most_probable_path():
    """Against all ways to cut, over random dictionaries."""
    rng = random.Random(5)
    for _ in range(300):
        words = {"".join(rng.choices("abc", k=rng.randint(1, 4))): rng.randint(1, 60) for _ in range(rng.randint(1, 12))}
        seg = terms.Segmenter(words)
        total = sum(words.values())
        run = "".join(rng.choices("abcd", k=rng.randint(1, 9)))
        ways = []
        for mask in range(1 << (len(run) - 1)):
            cuts = [0, *[i + 1 for i in range(len(run) - 1) if mask >> i & 1], len(run)]
            pieces = [run[a:z] for a, z in zip(cuts, cuts[1:])]
            if all(p in words or len(p) == 1 for p in pieces):
                cost = sum(round(1e6 * math.log(total / words[p])) if p in words else round(1e6 * math.log(total)) + terms.UNKNOWN for p in pieces)
                ways.append((cost, len(pieces), [-len(p) for p in reversed(pieces)], pieces))
        assert seg.cut(run) == min(ways)[3]


def test_segmented_documents(spark, rows):
    """Text without spaces; ambiguous strings, words of the user, unknown letters, nulls."""
    listed = spark.createDataFrame([("研究", 50), ("研究生", 20), ("生命", 40), ("命", 5), ("起源", 30), ("三个", 9), ("和尚", 9), ("个", 30), ("", 4), ("坏", 0)], "term STRING, n BIGINT")
    docs = spark.createDataFrame([("d1", "研究生命起源。三个和尚X坏"), ("d2", None), ("d3", ""), (None, "研究生")], "doc_id STRING, text STRING")
    got = rows(terms.segmented_terms(docs, terms.segmenter_of(listed)))
    assert got == [(None, 0, "研究生"), *[("d1", i, t) for i, t in enumerate(["研究", "生命", "起源", "三个", "和尚", "x", "坏"])]]
    own = spark.createDataFrame([("研究生命",), ("x坏",)], "term STRING")
    seg = terms.segmenter_of(listed, own, {"三个和尚": ["三", "个", "和尚"]})
    assert seg.cut("研究生命起源三个和尚x坏") == ["研究生命", "起源", "三", "个", "和尚", "x坏"]
    assert terms.segmenter_of(listed.limit(0)).cut("ab") == ["a", "b"] and seg.cut("") == []


def test_segmented_texts_are_handed_on_in_pieces(monkeypatch):
    import pyarrow as pa

    from footfall.operators import terms
    monkeypatch.setattr(terms, "PIECE_TERMS", 10)
    monkeypatch.setattr(terms, "KNOWN_CHARS", 200)
    texts = [["ab", "abab"] * 20, None, [], ["ba"], ["a" * 30]] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(15)), pa.array(texts, pa.list_(pa.string()))], ["key", "runs"])
    segmenter = terms.Segmenter({"ab": 3})
    out = list(terms._segmented(segmenter, pa.int64())(iter([batch])))
    assert max(b.num_rows for b in out) < 10 + 30
    got = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert got == [(i, at, w) for i, t in enumerate(texts) for at, w in enumerate(w for r in t or () for w in segmenter.cut(r))]
