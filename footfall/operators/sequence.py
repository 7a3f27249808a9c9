"""Ordered per-key operations that never put a whole key into one task.

`lag`, `lead` and running values need the rows of a key in order. A plain
window hands all rows of a key to one task, which breaks down when one device
or access point owns a large share of the data. Here the order axis is cut
into fixed-length segments and the window runs per (key, segment):

1. window functions inside each (key, segment) group. `order` is an integer
   that is unique per key, so such a group holds at most `segment` rows,
   whatever the size of the key;
2. one summary row per (key, segment) with its first and last values;
3. `lag`/`lead` over the summary rows of a key (one row per segment, i.e. one
   per month of data with the default length);
4. a join on (key, segment) hands each group the values that lie just outside
   it. The large side is already partitioned and sorted on exactly these
   columns, so only the summary moves.

With `segment=None` a plain window is used; that is for keys whose size is
bounded already, such as (device, day).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# 30 days of epoch seconds: at most 2,592,000 rows per (key, segment).
SEGMENT = 30 * 86400
_SEG = "_segment"

Lookup = Callable[[str], Column]
Breaks = Callable[[Lookup, Lookup], Column]


def in_order(
    df: DataFrame,
    keys: Sequence[str],
    *,
    order: str = "ts",
    prev: Mapping[str, str] | None = None,
    following: Mapping[str, str] | None = None,
    breaks: Breaks | None = None,
    run: str = "run_start",
    shared: Sequence[str] = (),
    segment: int | None = SEGMENT,
) -> DataFrame:
    """Add previous/next values and run starts along `order` within `keys`.

    prev, following: output column -> source column, for lag and lead by one.
    breaks: `f(previous, current)` given two lookups from column name to value;
        true where the current row starts a new run. It may look up `order`
        and the source columns of `prev`. The first row of a key always starts
        a run. `run` receives the order value of the run's first row.
    shared: further columns the result is going to be used for. The rows are read
        twice, for the result and for the summary; when both ask for the same
        columns, Spark computes and shuffles them once and reuses that.
    order: integer column, unique within `keys` and not null. Key columns are
        not null either; a null one is treated as the empty value of its type.
    """
    prev, following = dict(prev or {}), dict(following or {})
    if segment is None:
        return _plain(df, keys, order, prev, following, breaks, run)

    before = sorted(set(prev.values()) - {order})
    after = sorted(set(following.values()))
    group = [*keys, _SEG]
    # One explicit shuffle that both the windows and the summary read.
    df = _segmented(df, keys, order, segment).repartition(*group)

    # 1. inside the segment
    w = Window.partitionBy(*group).orderBy(order)
    inner = df.select(
        "*",
        F.lag(order).over(w).alias("_p_order"),
        *[F.lag(c).over(w).alias(f"_p_{c}") for c in before],
        *([F.lead(order).over(w).alias("_n_order")] if after else []),
        *[F.lead(c).over(w).alias(f"_n_{c}") for c in after],
    )
    has_prev = F.col("_p_order").isNotNull()
    if breaks is not None:
        cut = has_prev & breaks(
            lambda c: F.col("_p_order" if c == order else f"_p_{c}"), F.col)
        inner = inner.withColumn("_cut", F.when(cut, F.col(order)))

    # 2. one row per (key, segment)
    firsts = sorted(set(after) | (set(before) if breaks is not None else set()))
    summary = (df if breaks is None else inner).groupBy(*group).agg(
        F.min(order).alias("_lo"),
        F.max(order).alias("_hi"),
        *[F.max_by(c, order).alias(f"_last_{c}") for c in before],
        *[F.min_by(c, order).alias(f"_first_{c}") for c in firsts],
        *([F.max("_cut").alias("_last_cut")] if breaks is not None else []),
        *([F.max(F.xxhash64(*shared)).alias("_shared")] if shared else []),
    )
    if shared:
        # Always true: it only keeps the columns from being pruned on this side.
        summary = summary.where(F.col("_shared").isNotNull())

    # 3. neighbours of each segment
    along = Window.partitionBy(*keys).orderBy(_SEG)
    carry = summary.select(
        *group, *(["_lo", *[f"_first_{c}" for c in firsts]] if breaks is not None else []),
        F.lag("_hi").over(along).alias("_in_order"),
        *[F.lag(f"_last_{c}").over(along).alias(f"_in_{c}") for c in before],
        *[F.lead(f"_first_{c}").over(along).alias(f"_out_{c}") for c in after],
        *(["_last_cut"] if breaks is not None else []),
    )
    if breaks is not None:
        opens = F.col("_in_order").isNull() | breaks(
            lambda c: F.col("_in_order" if c == order else f"_in_{c}"),
            lambda c: F.col("_lo" if c == order else f"_first_{c}"))
        carry = carry.withColumn("_opened", F.when(opens, F.col("_lo")))
        carry = carry.withColumn("_entry_run", F.coalesce(
            "_opened",
            F.last(F.coalesce("_last_cut", "_opened"), ignorenulls=True).over(
                along.rowsBetween(Window.unboundedPreceding, -1))))
        carry = carry.select(*group, "_in_order", *[f"_in_{c}" for c in before], *[f"_out_{c}" for c in after],
                             "_entry_run")

    # 4. hand them to the rows at the segment's ends
    if breaks is not None:
        inner = inner.withColumn("_inner_run", F.max("_cut").over(
            w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = inner.join(carry, group, "left")

    def previous(c):
        name = "order" if c == order else c
        return F.when(has_prev, F.col(f"_p_{name}")).otherwise(F.col(f"_in_{name}"))

    def next_(c):
        return F.when(F.col("_n_order").isNotNull(), F.col(f"_n_{c}")).otherwise(F.col(f"_out_{c}"))

    return joined.select(
        *[c for c in df.columns if c != _SEG],
        *[previous(c).alias(out) for out, c in prev.items()],
        *[next_(c).alias(out) for out, c in following.items()],
        *([F.coalesce("_inner_run", "_entry_run").alias(run)] if breaks is not None else []),
    )


def _segmented(df, keys, order, segment):
    """Add the segment number and make the grouping columns non-nullable.

    Known non-null columns need no null filter on one side of the join below,
    so both sides read the same shuffle instead of producing it twice.
    """
    fill = {}
    for f in df.schema.fields:
        if f.name in keys and f.nullable and isinstance(f.dataType, (T.StringType, T.NumericType)):
            empty = F.lit("") if isinstance(f.dataType, T.StringType) else F.lit(0).cast(f.dataType)
            fill[f.name] = F.coalesce(f.name, empty)
    return df.withColumns({**fill, _SEG: F.coalesce(F.floor(F.col(order) / segment), F.lit(0))})


def _plain(df, keys, order, prev, following, breaks, run):
    w = Window.partitionBy(*keys).orderBy(order)
    watched = sorted(set(prev.values()) | {order})
    out = df.select(
        "*",
        *[F.lag(c).over(w).alias(f"_p_{c}") for c in watched],
        *[F.lead(c).over(w).alias(n) for n, c in following.items()],
    )
    if breaks is not None:
        cut = F.col(f"_p_{order}").isNull() | breaks(lambda c: F.col(f"_p_{c}"), F.col)
        out = out.withColumn(run, F.max(F.when(cut, F.col(order))).over(
            w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return out.select(
        *df.columns,
        *[F.col(f"_p_{c}").alias(n) for n, c in prev.items()],
        *following,
        *([run] if breaks is not None else []),
    )


def number_rows(df: DataFrame, keys: Sequence[str], *, order: str = "ts", out: str = "number",
                segment: int = SEGMENT) -> DataFrame:
    """Consecutive numbers 1..n along `order` within `keys` (over the whole frame if none).

    Rows are numbered per segment, then shifted by the size of the segments
    before it. `order` is an integer unique within `keys`; the size table has
    one row per `segment` of its range.
    """
    group = [*keys, _SEG]
    df = _segmented(df, keys, order, segment)
    along = Window.partitionBy(*keys).orderBy(_SEG).rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(*group).agg(F.count("*").alias("_size")).select(
        *group, F.coalesce(F.sum("_size").over(along), F.lit(0)).alias("_before"))
    inner = df.withColumn("_number", F.row_number().over(Window.partitionBy(*group).orderBy(order)))
    return inner.join(sizes, group, "left").select(
        *[c for c in df.columns if c != _SEG],
        (F.col("_number") + F.coalesce("_before", F.lit(0))).alias(out))
