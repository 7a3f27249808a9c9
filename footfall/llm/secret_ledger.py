"""Secret scans: an incremental blob ledger.

Every version of every path is content-addressed by the SHA-256 of its bytes. The ledger holds, per blob and rule
version, the spans found; only pairs of blob and rule version that it lacks are scanned, and findings are joined
back to all paths that have the blob. Positions are code points, ends exclusive.

`spans`: a regular expression's matches are leftmost and do not overlap; the texts between them (`split`) and the
matches themselves give all positions as running sums, without a Python function.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footfall.llm.common import hex_sha, rows_of, stored, unused


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` whose group `group` has at least `least` characters. A changed rule needs a new version."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The three kinds of secrets, in the order in which ties are listed.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]+", 0, 24),
)
# Slices of a table that the query works off one after the other, the ledger written in between.
INCREMENTS = 2
SPANS = "array<struct<start:bigint,stop:bigint>>"
LEDGER = f"blob STRING, rule STRING, spans {SPANS}"


def _quick(rule: Rule) -> str:
    """What a text with a lasting match must contain; texts without it are not cut up."""
    one_class = rule.group == 0 and rule.pattern.startswith("[") and rule.pattern.index("]") == len(rule.pattern) - 2
    return f"{rule.pattern[:-1]}{{{rule.least},}}" if one_class and rule.pattern.endswith("+") else rule.pattern


def _none() -> Column:
    return F.array().cast(SPANS)


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _placed(pieces: Column, least: int) -> Column:
    """(start, stop) of the pieces (gap, n, part) with a long enough part, each piece after the one before it.

    Sums run over stretches of about the square root of the number of pieces, then over the stretches, so that no array
    grows match by match to the length of them all.
    """
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(None).cast(SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        stop = start + x["n"]
        found = F.array(F.struct(start.alias("start"), stop.alias("stop")))
        return F.struct(stop.alias("at"), F.when(x["part"] >= least, F.concat(F.coalesce(acc["out"], _none()), found))
                        .otherwise(acc["out"]).alias("out"))

    def stretches(all_: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(all_))).cast("int")
        return F.transform(F.sequence(F.lit(1), F.size(all_), size), lambda i: F.aggregate(F.slice(all_, i, size), zero, step))

    def moved(done: Column) -> Column:
        first = F.array(F.lit(0).cast("long"))
        offsets = F.aggregate(done, first, lambda acc, d: F.concat(acc, F.array(F.element_at(acc, -1) + d["at"])))
        shifted = F.zip_with(done, offsets, lambda d, o: F.transform(F.coalesce(d["out"], _none()), lambda s: F.struct(
            (s["start"] + o).alias("start"), (s["stop"] + o).alias("stop"))))
        return F.flatten(shifted)

    return F.when(F.size(pieces) == 0, _none()).otherwise(_with(_with(pieces, stretches), moved))


def spans(text: Column, rule: Rule) -> Column:
    """Array of (start, stop) of the matches of one rule."""
    whole, part = (F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(g)) for g in (0, rule.group))
    between = F.split(text, rule.pattern, -1)
    pieces = F.zip_with(F.zip_with(between, whole, lambda b, w: F.struct(F.length(b).alias("gap"), F.length(w).alias("n"))), part,
                        lambda x, p: F.struct(x["gap"].alias("gap"), x["n"].alias("n"), F.length(p).alias("part")))
    # the text after the last match has no match of its own
    matches = _with(pieces, lambda all_: _with(F.slice(all_, 1, F.size(all_) - 1), lambda m: _placed(m, rule.least)))
    return F.when(text.rlike(_quick(rule)), matches).otherwise(_none())


def addressed(docs: DataFrame) -> DataFrame:
    """(doc_id, blob): the blob that each path has. Null text counts as empty."""
    return rows_of(docs).select("doc_id", hex_sha("text").alias("blob"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger entries (blob, rule, spans) for all pairs of blob and rule version that `ledger` lacks.

    Equal blobs are merged within a task before the shuffle, so a third of all rows may be one text. Blobs without
    findings get entries with empty spans, so that they count as seen.
    """
    blobs = rows_of(docs).select(hex_sha("text").alias("blob"), "text").distinct()
    if ledger is None:
        blobs = blobs.withColumn("seen", F.array().cast("array<string>"))
    else:
        keys = [r.key for r in rules]
        seen = ledger.where(F.col("rule").isin(keys)).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    entry = [F.when(~F.array_contains("seen", r.key),
                    F.struct(F.lit(r.key).alias("rule"), spans(F.col("text"), r).alias("spans"))) for r in rules]
    found = blobs.select("blob", F.filter(F.array(*entry), lambda e: e.isNotNull()).alias("entries"))
    return found.select("blob", F.inline("entries"))


def update(spark: SparkSession, docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with the entries of docs added; the new ones are written below the shared folder."""
    new = stored(scan(docs, ledger, rules), "ledger")
    return new if ledger is None else ledger.select("blob", "rule", "spans").unionByName(new)


def in_increments(spark: SparkSession, docs: DataFrame, ledger: DataFrame | None = None, increments: int = INCREMENTS) -> DataFrame:
    """The ledger with the entries of all docs added slice by slice; each slice scans only what the ledger lacks by then."""
    part = F.pmod(F.xxhash64("doc_id"), F.lit(increments))
    for i in range(increments):
        ledger = update(spark, docs.where(part == i), ledger)
    return ledger


def findings(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of docs: doc_id, found: sorted array of (start, rank of the rule, stop, kind), empty if none."""
    keyed = F.lit(None).cast("struct<rank:int,kind:string>")
    for i, r in reversed(list(enumerate(rules))):
        keyed = F.when(F.col("rule") == r.key, F.struct(F.lit(i).alias("rank"), F.lit(r.kind).alias("kind"))).otherwise(keyed)
    hits = ledger.where(F.col("rule").isin([r.key for r in rules]) & (F.size("spans") > 0)).withColumn("k", keyed)
    hits = hits.select("blob", F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), F.col("k.rank").alias("rank"), s["stop"].alias("stop"), F.col("k.kind").alias("kind"))
    ).alias("some"))
    # at most one array per rule; stored, so that the join has two plain shuffles and Spark can split a hot blob
    hits = stored(hits.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("some"))).alias("found")), "findings")
    none = F.array().cast("array<struct<start:bigint,rank:int,stop:bigint,kind:string>>")
    return addressed(docs).join(hits, "blob", "left").select("doc_id", "blob", F.coalesce("found", none).alias("found"))


def listed(found: Column) -> Column:
    """kind:start:stop, comma-joined."""
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["stop"].cast("string"))), ",")


def secrets(spark: SparkSession, docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row; null text counts as empty.

    Repeated rows are each reported; an empty table gives no rows. This method adds no spans beyond the three kinds.
    """
    found = findings(docs, in_increments(spark, docs, ledger))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return (found.select("doc_id", *[count(r.kind) for r in RULES], listed(F.col("found")).alias("spans"))
            .select("doc_id", *[f"n_{r.kind}" for r in RULES], F.sha2("spans", 256).alias("base_sha256"), "spans"))


def _likely(rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a text has what a lasting match of any rule needs; a null text has not."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return reduce(Column.__or__, [text.rlike(_quick(r)) for r in rules], F.lit(False))


def redacted(spark: SparkSession, docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every span replaced by `mark` and n_chars, if there, counted anew; overlapping spans merge first.

    Further columns stay as they are, whatever their names. Only rows whose text may have a span are shuffled; all others
    pass as they are.
    """
    some = docs.where(_likely())
    blob, cuts = unused(docs, "blob"), unused(docs, "cuts")
    hits = stored(secret_cuts(spark, some).select(F.col("blob").alias(blob), F.col("cuts").alias(cuts)), "cuts")
    out = some.withColumn(blob, hex_sha(F.coalesce("text", F.lit("")))).join(hits, blob, "left")
    keep = F.transform(cuts, lambda c: F.substring(F.col("text"), c["start"].cast("int") + 1, (c["stop"] - c["start"]).cast("int")))
    text = F.when(F.col(cuts).isNull(), F.col("text")).otherwise(F.array_join(keep, mark))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(cuts).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    columns = [f"`{c}`" for c in docs.columns]
    return docs.where(~_likely()).select(*columns).union(out.select(*columns))


def secret_cuts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(blob, cuts): the stretches of code points outside all spans, for blobs with spans."""
    every = update(spark, docs).select("blob", F.inline("spans"))
    order = Window.partitionBy("blob").orderBy("start", "stop")
    # where all spans before this one end; a span that starts behind that leaves a stretch in between
    at = F.coalesce(F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    outside = F.when(F.col("start") >= F.col("at"), F.struct(F.col("at").alias("start"), F.col("start").alias("stop")))
    end = F.lit(2 ** 31 - 2).cast("long")
    return (every.withColumn("at", at).groupBy("blob")
            .agg(F.sort_array(F.collect_list(outside)).alias("cuts"), F.max("stop").alias("last"))
            .select("blob", F.concat("cuts", F.array(F.struct(F.col("last").alias("start"), end.alias("stop")))).alias("cuts")))
