"""Distribution statistics, anomaly scores, feature tables and clusters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.special import student_p
from footfall.operators.signal import mean_rssi


# Variance, in dB squared, that rounding of equal means alone may leave.
STILL = 0.001


def rssi_kurtosis(s: DataFrame, keys: Sequence[str] = ("device", "ap")) -> DataFrame:
    """Population excess kurtosis of the per-second means; null where the signal does not vary (up to `STILL`)."""
    return (mean_rssi(s, ("device", "ts", "ap"), rounded=False)
            .groupBy(*keys).agg(F.when(F.var_pop("rssi") > STILL, F.kurtosis("rssi")).alias("kurtosis")))


def rssi_stddev(s: DataFrame, keys: Sequence[str] = ("device",)) -> DataFrame:
    return s.groupBy(*keys).agg(F.stddev_pop("rssi").alias("stddev"))


def rssi_sum(s: DataFrame, keys: Sequence[str] = ("device", "ts")) -> DataFrame:
    return s.groupBy(*keys).agg(F.sum("rssi").alias("rssi_sum"))


def rssi_histogram(s: DataFrame) -> DataFrame:
    """Readings per signal value."""
    return s.groupBy("rssi").agg(F.count("*").alias("n"))


def counts_at_or_below(s: DataFrame, levels: Sequence[float] = (-91, -90, -89)) -> DataFrame:
    """One row: number of readings at or below each level."""
    return s.agg(*[F.count_if(F.col("rssi") <= v).alias(f"le_{abs(int(v))}") for v in levels])


def peak_rssi_histogram(peaks: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width histogram of whole-dB peak signals per device.

    Peaks are counted per (device, rssi) first, so the per-device range is taken
    over the distinct signal values only. The last bin includes the maximum; a
    device with a single value fills the middle bin.
    """
    values = peaks.groupBy("device", "rssi").agg(F.count("*").alias("n"))
    w = Window.partitionBy("device")
    x = values.withColumn("_lo", F.min("rssi").over(w)).withColumn("_hi", F.max("rssi").over(w))
    width = F.col("_hi") - F.col("_lo")
    place = F.floor((F.col("rssi") - F.col("_lo")) * bins / width)
    bin_ = F.when(width == 0, bins // 2).otherwise(F.least(place, F.lit(bins - 1)))
    return x.groupBy("device", bin_.cast("bigint").alias("bin")).agg(F.sum("n").alias("n"))


def feature_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with mean and sample variance of each column."""
    return df.agg(*[F.avg(c).alias(f"mean_{c}") for c in cols],
                  *[F.var_samp(c).alias(f"var_{c}") for c in cols])


def gaussian_log_density(df: DataFrame, cols: Sequence[str], stats: DataFrame) -> DataFrame:
    """Add `log_density`: log of the product of the columns' normal densities.

    `stats` is `feature_stats` output. It enters as a scalar subquery, not as a
    join. The sum of logs does not underflow where the product would.
    """
    mean, var = [F.col(f"mean_{c}") for c in cols], [F.col(f"var_{c}") for c in cols]
    constant = reduce(lambda a, b: a + b, [-F.log(2 * F.pi() * v) / 2 for v in var])
    stat = stats.select(F.struct(
        constant.alias("constant"), *[m.alias(f"mean_{c}") for c, m in zip(cols, mean)],
        *[F.try_divide(F.lit(0.5), v).alias(f"weight_{c}") for c, v in zip(cols, var)])).scalar()
    df = df.withColumn("_stats", stat)

    def term(c):
        d = F.col(c) - F.col(f"_stats.mean_{c}")
        return d * d * F.col(f"_stats.weight_{c}")

    total = reduce(lambda a, b: a - b, [term(c) for c in cols], F.col("_stats.constant"))
    return df.withColumn("log_density", total).drop("_stats")


def gaussian_density(df: DataFrame, cols: Sequence[str], stats: DataFrame) -> DataFrame:
    """Add `density`: product of the columns' normal densities."""
    return (gaussian_log_density(df, cols, stats)
            .withColumn("density", F.exp("log_density")).drop("log_density"))


def score_range(scored: DataFrame, score: str = "score", steps: int = 1000) -> DataFrame:
    """One row: smallest and largest score and the step between thresholds."""
    lo, hi = F.min(score), F.max(score)
    return scored.agg(lo.alias("lo"), hi.alias("hi"), ((hi - lo) / steps).alias("step"))


def threshold_sweep(scored: DataFrame, score: str = "score", label: str = "label", steps: int = 1000) -> DataFrame:
    """TP, FN and FP of `score < threshold` for thresholds lo, lo+step, .. hi.

    Each row is assigned the first threshold above its score, rows are counted
    per threshold and label, and a running sum over the `steps + 1` thresholds
    gives all counts in one pass.
    """
    rng = score_range(scored, score, steps).select(F.struct("*")).scalar()
    x = scored.select(F.col(score).alias("_p"), F.col(label).cast("boolean").alias("_y")).withColumn("_r", rng)
    lo, step = F.col("_r.lo"), F.col("_r.step")
    guess = F.floor((F.col("_p") - lo) / step)
    # Division may be off by one; settle it by comparing with the thresholds.
    reached = lambda i: (lo + i * step <= F.col("_p")).cast("bigint")
    first = F.when(step != 0, guess + reached(guess) + reached(guess + 1))
    # No score or no range: below no threshold. A non-null key also spares the
    # join below a null filter that would evaluate all of this once more.
    first = F.coalesce(first, F.lit(steps + 1).cast("bigint"))
    counts = x.groupBy(first.alias("step_no")).agg(
        F.count_if("_y").alias("_pos"), F.count_if(~F.col("_y")).alias("_neg"))
    grid = scored.sparkSession.range(steps + 2).withColumnRenamed("id", "step_no")
    grid = grid.join(counts, "step_no", "left").na.fill(0, ["_pos", "_neg"])
    upto = Window.orderBy("step_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy("step_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tp = F.sum("_pos").over(upto)
    out = grid.select(
        "step_no", tp.alias("tp"), (F.sum("_pos").over(whole) - tp).alias("fn"),
        F.sum("_neg").over(upto).alias("fp"))
    out = out.where(F.col("step_no") <= steps).withColumn("_r", rng)
    return out.select("step_no", (F.col("_r.lo") + F.col("step_no") * F.col("_r.step")).alias("threshold"),
                      "tp", "fn", "fp")


def confusion_counts(scored: DataFrame, threshold: float, score: str = "score", label: str = "label") -> DataFrame:
    """One row with TP, FN, FP at one threshold; a score below it predicts an anomaly."""
    hit, y = F.col(score) < threshold, F.col(label).cast("boolean")
    return scored.agg(F.count_if(y & hit).alias("tp"), F.count_if(y & ~hit).alias("fn"),
                      F.count_if(~y & hit).alias("fp"))


def pivot_features(df: DataFrame, key: str, category: str, value: str, categories: Sequence[str],
                   other: str | None = None) -> DataFrame:
    """Per key one summed column per category, 0 where absent.

    Naming the categories spares a pass over the data that looks for them. Column `other`, if named, sums what has
    another category or none; without it these values are left out.
    """
    named = list(categories)
    if other is not None:
        df = df.withColumn(category, F.when(F.col(category).isin(named), F.col(category)).otherwise(F.lit(other)))
        named.append(other)
    out = df.groupBy(key).pivot(category, named).agg(F.sum(value))
    return out.na.fill(0, named)


def feature_vectors(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Numeric columns -> one ML vector column."""
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)


def _best_cuts(values: np.ndarray, weights: np.ndarray, k: int) -> list[int]:
    """Ends of the k stretches of sorted values with the least sum of squares within them; of ties the first ones.

    Sums of a stretch are differences of prefix sums. The best last cut never falls as the end moves on, which halves
    the search again and again: k * m * log m steps for m values.
    """
    m = len(values)
    x = values - np.average(values, weights=weights)  # smaller numbers, smaller errors
    w, s, q = (np.concatenate([[0.0], np.cumsum(v)]) for v in (weights, weights * x, weights * x * x))

    def within(starts: np.ndarray, end: int) -> np.ndarray:
        return q[end] - q[starts] - (s[end] - s[starts]) ** 2 / (w[end] - w[starts])

    cost = np.array([0.0] + [float(within(np.array([0]), e)[0]) for e in range(1, m + 1)])
    cuts = []
    for parts in range(2, k + 1):
        new, at = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        todo = [(parts, m, parts - 1, m - 1)]  # ends, and cuts that can be best for them
        while todo:
            first, last, low, high = todo.pop()
            if first > last:
                continue
            end = (first + last) // 2
            starts = np.arange(low, min(high, end - 1) + 1)
            all_costs = cost[starts] + within(starts, end)
            best = int(np.argmin(all_costs))
            new[end], at[end] = all_costs[best], starts[best]
            todo += [(first, end - 1, low, at[end]), (end + 1, last, at[end], high)]
        cost = new
        cuts.append(at)
    ends = [m]
    for at in reversed(cuts):
        ends.append(int(at[ends[-1]]))
    return ends[::-1]


def peak_interval_clusters(intervals: DataFrame, k: int = 2, value: str = "seconds") -> DataFrame:
    """(cluster, centre, n, low, high) of the exact k-means clustering of intervals, by rising centre.

    Clusters on a line are stretches of the sorted values, so only counts per distinct value are needed, and the best
    cuts follow from their prefix sums. The counts are taken by all tasks; one task works on the counts, of which
    there are as many as distinct values: for whole seconds at most the length of the period, whatever the number of
    intervals. Nulls are left out; fewer distinct values than k give a cluster each.
    """
    def cluster(h: pd.DataFrame) -> pd.DataFrame:
        h = h.sort_values("v", ignore_index=True)
        values, n = h["v"].to_numpy(float), h["n"].to_numpy(float)
        ends = _best_cuts(values, n, min(k, len(h)))
        starts = [0, *ends[:-1]]
        parts = [slice(a, z) for a, z in zip(starts, ends, strict=True)]
        return pd.DataFrame({"cluster": range(len(parts)), "centre": [np.average(values[p], weights=n[p]) for p in parts],
                             "n": [int(n[p].sum()) for p in parts], "low": [values[p][0] for p in parts],
                             "high": [values[p][-1] for p in parts]})

    counts = intervals.groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n")).where("v IS NOT NULL")
    return counts.groupBy().applyInPandas(cluster, "cluster INT, centre DOUBLE, n BIGINT, low DOUBLE, high DOUBLE")


def welch(groups: DataFrame, a, b) -> DataFrame:
    """Welch's t, degrees of freedom and two-sided p-value for two labels.

    `groups` holds (label, n, mean, var), as `group_moments` computes it in
    batch or on a stream.
    """
    pick = lambda label, c: F.max(F.when(F.col("label") == label, F.col(c)))
    x = groups.agg(*[pick(v, c).alias(f"_{c}_{side}") for side, v in (("a", a), ("b", b))
                     for c in ("n", "mean", "var")])
    ea, eb = F.col("_var_a") / F.col("_n_a"), F.col("_var_b") / F.col("_n_b")
    # Undefined (null) rather than an error without variance.
    spread = ea * ea / (F.col("_n_a") - 1) + eb * eb / (F.col("_n_b") - 1)
    x = x.select(
        F.try_divide(F.col("_mean_a") - F.col("_mean_b"), F.sqrt(ea + eb)).alias("t"),
        F.try_divide(F.pow(ea + eb, 2), spread).alias("df"))
    return x.withColumn("p", student_p(F.col("t"), F.col("df")))


def group_moments(df: DataFrame, label: str = "label", value: str = "value") -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, standard deviation, min and max per column, one row each."""
    measures: Mapping = {"count": F.count, "mean": F.avg, "stddev": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.agg(*[fn(c).alias(f"{c}__{m}") for c in cols for m, fn in measures.items()])
    rows = [F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{m}").cast("double").alias(m) for m in measures])
            for c in cols]
    return wide.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


MOMENTS = "column STRING, n BIGINT, mean DOUBLE, m2 DOUBLE, min DOUBLE, max DOUBLE"


def moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, n, mean, m2, min, max), one row per column; m2 is the sum of squared distances from the mean."""
    wide = df.agg(*[fn(F.col(c).cast("double")).alias(f"{c}__{m}") for c in cols for m, fn in (
        ("n", F.count), ("mean", F.avg), ("var", F.var_pop), ("min", F.min), ("max", F.max))])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"{c}__n").alias("n"), F.col(f"{c}__mean").alias("mean"),
                     (F.col(f"{c}__var") * F.col(f"{c}__n")).alias("m2"), F.col(f"{c}__min").alias("min"), F.col(f"{c}__max").alias("max"))
            for c in cols]
    return wide.select(F.inline(F.array(*rows)))


def merged_moments(parts: DataFrame) -> DataFrame:
    """`moments` of the whole from those of some parts, two for each column in a running summary.

    Means are moved by their differences, so large means take no digits from the variance.
    """
    def add(x, y):
        n = x["n"] + y["n"]
        far = y["mean"] - x["mean"]
        return F.struct(n.alias("n"), (x["mean"] + far * y["n"] / n).alias("mean"),
                        (x["m2"] + y["m2"] + far * far * x["n"] * y["n"] / n).alias("m2"))

    one = F.struct("n", "mean", "m2")
    some = parts.groupBy("column").agg(F.collect_list(F.when(F.col("n") > 0, one)).alias("_parts"), F.min("min").alias("min"), F.max("max").alias("max"))
    empty = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    total = F.aggregate("_parts", empty, lambda x, y: F.when(x["n"] == 0, y).otherwise(add(x, y)))
    some = some.withColumn("_total", total)
    has = F.col("_total.n") > 0
    return some.select("column", F.col("_total.n").alias("n"), *[F.when(has, F.col(f"_total.{c}")).alias(c) for c in ("mean", "m2")], "min", "max")


def described(parts: DataFrame) -> DataFrame:
    """`moments` in the form of `describe`."""
    spread = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    return parts.select("column", F.col("n").cast("double").alias("count"), "mean", spread.alias("stddev"), "min", "max")
