"""N-gram Jaccard join by token-combination prefixes.

A token is the hash of a shingle, a set the distinct tokens of a document. Two sets that reach the similarity share at
least two tokens of their prefixes extended by one, in any order common to all. The order puts rare tokens first. So
a pair is found by one rare token of both extended prefixes or by a combination of two frequent ones: tokens of up to
`RARE` sets are index keys of their own, of more frequent ones all pairs within a document's extended prefix are.

1. Documents with equal sets are one class from here on.
2. Counters of fixed size estimate how frequent tokens are; they decide on the order only, never on results.
3. Tokens of extended prefixes that occur in one class only are dropped, frequent ones after the stars.
4. Stars: members of an index group that are not in the group's largest component are compared with a few members of
   it. After a few rounds a group of many near copies that are like its leaders is one component, and its pairs need
   not be listed.
5. What is left - pairs of different components within a group - is filtered by exact bounds (sizes, places, parity bitmaps)
   and verified: first the few likeliest pairs of every component in a group, at most so many a member, which makes most
   of the others pairs of one component, then all. No pair of different components is left out, so the components are
   exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import rows_of, stored
from footfall.llm.components import components
from footfall.llm.shingles import mixed, parity_bits, segments, shingles

SHINGLE, PERCENT = 3, 90
RARE = 64
STAR_ROUNDS, LEADS, BEST = 3, 3, 3
BLOCK_PAIRS, BLOCK_ROWS = 200_000, 65_536
# Parity bits of the second filter, for the texts of candidate pairs only.
FINE = 1 << 14
# Counters of the frequency estimate, and the slices in which they are summed.
COUNTERS, SLICES = 1 << 22, 64
_MAP = [f"m{i}" for i in range(16)]
# The first frequent tokens of a member, by which groups that are not a pair's first one are told; 0 where there is none.
_HEAD = [f"t{i}" for i in range(8)]


def _need(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-n * percent // 100)


def _hashed(docs: DataFrame) -> DataFrame:
    return rows_of(docs).withColumn("h", F.xxhash64("text"))


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, sid and a hash of the text of every row; and per task its token counters, in rows with a slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            doc, h = shingles(batch["text"].to_pylist(), size)
            np.add.at(counts, (h >> np.uint64(42)).astype(np.int64), np.uint32(1))
            n = np.bincount(doc, minlength=batch.num_rows)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h + np.uint64(0x632BE59BD9B4E019)))])
            ends = np.cumsum(n)
            sid = mixed((sums[ends] - sums[ends - n]) ^ mixed(n.astype(np.uint64))).view(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "n": pa.array(n, pa.int64()), "sid": pa.array(sid, pa.int64()), "h": batch["h"],
                                              "slice": pa.nulls(len(n), pa.int32()), "counts": pa.nulls(len(n), pa.binary())})
        if counts.any():
            parts = np.minimum(counts, 65535).astype("<u2").reshape(SLICES, -1)
            none = pa.nulls(SLICES, pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": none, "n": none, "sid": none, "h": none, "slice": pa.array(range(SLICES), pa.int32()),
                                              "counts": pa.array([p.tobytes() for p in parts], pa.binary())})

    return _hashed(docs).mapInArrow(run, "doc_id BIGINT, n BIGINT, sid BIGINT, h BIGINT, slice INT, counts BINARY")


def _frequencies(sets: DataFrame) -> np.ndarray:
    """Sums of the tasks' counters, as classes: 0 for what stands out from the average cell in no way, else its logarithm."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, raw in zip(batch["slice"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                total[s] = total.get(s, 0) + np.frombuffer(raw, "<u2").astype(np.int64)
        yield pa.RecordBatch.from_pydict({"slice": pa.array(list(total), pa.int32()),
                                          "counts": pa.array([v.tobytes() for v in total.values()], pa.binary())})

    total = np.zeros((SLICES, COUNTERS // SLICES), np.int64)
    partial = sets.where("slice IS NOT NULL").select("slice", "counts").repartition(SLICES, "slice").mapInArrow(add, "slice INT, counts BINARY")
    for r in partial.toLocalIterator():  # SLICES rows of fixed size
        total[r.slice] += np.frombuffer(bytes(r.counts), np.int64)
    flat = total.reshape(-1)
    usual = flat.mean() + 6 * np.sqrt(flat.mean()) + 8
    return np.where(flat > usual, np.log2(np.maximum(flat, 1)) + 1, 0).astype(np.uint8)


def _prefixes(docs: DataFrame, size: int, percent: int, classes: np.ndarray) -> DataFrame:
    """token, sid, n and place for the tokens of every document's prefix extended by one; place counts from 0 in the order."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)  # COUNTERS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, h = shingles(batch["text"].to_pylist(), size)
            n = np.bincount(doc, minlength=batch.num_rows)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h + np.uint64(0x632BE59BD9B4E019)))])
            ends = np.cumsum(n)
            sid = mixed((sums[ends] - sums[ends - n]) ^ mixed(n.astype(np.uint64))).view(np.int64)
            rank = shared.value[(h >> np.uint64(42)).astype(np.int64)]
            most = np.minimum(n, n - _need(n, percent) + 2)
            # tokens are sorted within a document, so a stable sort by class leaves them in order of class and token
            keep = np.concatenate([np.zeros(0, np.int64), *[x + np.argsort(rank[x:z], kind="stable")[:m]
                                                            for (x, z), m in zip(segments(doc, len(n)), most.tolist(), strict=True)]])
            mine, whose = sid[doc[keep]], doc[keep]
            place = np.arange(len(keep)) - np.searchsorted(whose, whose)
            yield pa.RecordBatch.from_pydict({"token": pa.array(h[keep].view(np.int64)), "sid": pa.array(mine), "n": pa.array(n[whose], pa.int64()),
                                              "place": pa.array(place, pa.int64()), "deal": pa.array(np.where(rank[keep] > 0, mine | 1, 0), pa.int64())})

    return rows_of(docs).mapInArrow(run, "token BIGINT, sid BIGINT, n BIGINT, place BIGINT, deal BIGINT")


def _several(tokens: DataFrame) -> DataFrame:
    """token, sid, n, place, once each, of the tokens that more than one set has; frequent ones stay without a look.

    Rows are shuffled once, by token, those of frequent tokens by token and set. A task sees its tokens in order; of a
    token it has to know only whether the first and the last set differ, so it holds one block and the rows that have
    the block's last token and its only set so far: one row, as repeated ones go.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        before = None  # token and set of the last row seen
        for batch in batches:
            held.append(np.stack([batch[c].to_numpy() for c in ("token", "sid", "n", "place", "deal")], 1))
            if sum(map(len, held)) >= BLOCK_ROWS:
                rows = np.concatenate(held)
                out, rest, before = block(rows, before, False)
                held = [rest]
                yield out
        if held:
            yield block(np.concatenate(held), before, True)[0]

    def block(rows: np.ndarray, before: tuple[int, int] | None, end: bool) -> tuple[pa.RecordBatch, np.ndarray, tuple[int, int] | None]:
        token, sid = rows[:, 0], rows[:, 1]
        other = np.ones(len(rows), bool)  # not the same token and set as the row above
        other[1:] = (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])
        goes_on = before is not None and len(rows) > 0 and token[0] == before[0]
        if goes_on:
            other[0] = sid[0] != before[1]
        rows = rows[other]
        token = rows[:, 0]
        same = np.zeros(len(rows) + 1, bool)  # place i: rows i - 1 and i have one token
        same[1:-1] = token[1:] == token[:-1]
        same[0] = goes_on and len(rows) > 0
        keep = same[:-1] | same[1:] | (rows[:, 4] != 0)
        wait = not end and len(rows) > 0 and not keep[-1]  # the last row's token may go on
        last = before if not len(rows) else (int(token[-1]), int(rows[-1, 1]))
        if wait:
            last = (int(token[-2]), int(rows[-2, 1])) if len(rows) > 1 else before
        out = rows[keep]
        return (pa.RecordBatch.from_pydict({c: pa.array(out[:, i].copy()) for i, c in enumerate(("token", "sid", "n", "place"))}),
                rows[-1:] if wait else rows[:0], last)

    dealt = tokens.repartition("token", "deal").sortWithinPartitions("token", "sid")
    return dealt.mapInArrow(run, "token BIGINT, sid BIGINT, n BIGINT, place BIGINT")


def _bitmaps(texts: DataFrame, size: int) -> DataFrame:
    """sid and 1024 parity bits of the set, in 16 longs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, h = shingles(batch["text"].to_pylist(), size)
            words = parity_bits(doc, mixed(h + np.uint64(7)) >> np.uint64(54), batch.num_rows, 1024).view("<i8")
            yield pa.RecordBatch.from_pydict({"sid": batch["sid"], **{m: pa.array(words[:, i].copy()) for i, m in enumerate(_MAP)}})

    return texts.mapInArrow(run, "sid BIGINT, " + ", ".join(f"{m} BIGINT" for m in _MAP))


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if not len(x) or not len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _plausible(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, total) that the parity bitmaps allow: as many tokens as bits differ are in one set only."""
    x = pairs.join(maps.select(F.col("sid").alias("a"), *[F.col(m).alias(f"a{m}") for m in _MAP]), "a")
    x = x.join(maps.select(F.col("sid").alias("b"), *[F.col(m).alias(f"b{m}") for m in _MAP]), "b")
    apart = sum((F.bit_count(F.col(f"a{m}").bitwiseXOR(F.col(f"b{m}"))) for m in _MAP), F.lit(0))
    return x.where((100 + percent) * (F.col("total") - apart) >= 2 * percent * F.col("total")).select("a", "b")


def _fine(texts: DataFrame, size: int) -> DataFrame:
    """sid, n, FINE parity bits of the set, and the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, h = shingles(batch["text"].to_pylist(), size)
            n = np.bincount(doc, minlength=batch.num_rows)
            fine = parity_bits(doc, mixed(h + np.uint64(11)) % np.uint64(FINE), batch.num_rows, FINE)
            yield pa.RecordBatch.from_pydict({"sid": batch["sid"], "n": pa.array(n, pa.int64()),
                                              "fine": pa.array([x.tobytes() for x in fine], pa.binary()), "text": batch["text"]})

    return texts.mapInArrow(run, "sid BIGINT, n BIGINT, fine BINARY, text STRING")


def _both(pairs: DataFrame, lists: DataFrame, *cols: str) -> DataFrame:
    """pairs (a, b) with the given columns of both ends, prefixed by a_ and b_."""
    for end in ("a", "b"):
        pairs = pairs.join(lists.select(F.col("sid").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in cols]), end)
    return pairs.select("a", "b", *[f"{end}_{c}" for end in ("a", "b") for c in cols])


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of set ids that reach the similarity, counted exactly on their tokens.

    Texts, which take a third of their tokens' bytes, follow only the pairs that the finer parity bits leave.
    """
    ends = stored(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "pair-ends")
    lists = stored(_fine(texts.join(ends, "sid").select("sid", "text"), size), "pair-texts", "zstd")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint64).reshape(batch.num_rows, -1 if batch.num_rows else 1)
                           for c in ("a_fine", "b_fine"))
            total = batch["a_n"].to_numpy() + batch["b_n"].to_numpy()
            apart = np.bitwise_count(left ^ right).sum(1, dtype=np.int64)
            yield batch.select(["a", "b"]).filter(pa.array((100 + percent) * (total - apart) >= 2 * percent * total))

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens: dict[int, np.ndarray] = {}
            for end in ("a", "b"):
                for sid, text in zip(batch[end].to_pylist(), batch[f"{end}_text"], strict=True):
                    if sid not in tokens:
                        tokens[sid] = shingles([text.as_py()], size)[1]
            linked = [_linked(tokens[x], tokens[y], percent) for x, y in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    left = _both(pairs, lists, "n", "fine").mapInArrow(near, "a BIGINT, b BIGINT")
    return _both(left, lists, "text").mapInArrow(same, "a BIGINT, b BIGINT")


def _sizes_allow(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _with_components(members: DataFrame, found: DataFrame | None) -> DataFrame:
    """members with comp, the component of sid so far, its own sid if it has no link yet."""
    if found is None:
        return members.withColumn("comp", F.col("sid"))
    return members.join(found.select(F.col("v").alias("sid"), "c"), "sid", "left").withColumn("comp", F.coalesce("c", "sid")).drop("c")


def _majors(members: DataFrame, step: int, *group: str) -> DataFrame:
    """Per group with several components its largest one and one member of it.

    Members are taken by an order of all sets, one of LEADS by the token and others in each round: the groups of a set
    name few leaders, but not all of them the same one.
    """
    order = F.xxhash64("sid", F.lit(step), F.pmod("token", F.lit(LEADS)))
    per = members.groupBy(*group, "comp").agg(F.count("*").alias("k"), F.max(F.struct(order.alias("o"), "sid", "n")).alias("lead"))
    per = per.select(*group, "comp", "k", F.col("lead.o").alias("o"), F.col("lead.sid").alias("lead"), F.col("lead.n").alias("lead_n"))
    top = per.groupBy(*group).agg(F.count("*").alias("comps"), F.max(F.struct("k", "o", "comp", "lead", "lead_n")).alias("top"))
    return top.where("comps > 1").select(*group, F.col("top.comp").alias("major"), F.col("top.lead").alias("lead"),
                                         F.col("top.lead_n").alias("lead_n"))


def _stars(members: DataFrame, percent: int, step: int) -> DataFrame:
    """(a, b): each outsider with the LEADS leaders that most of its groups name.

    Sets of a band of sizes are together; every other round has its bands half a step further on, so that two sizes
    close to each other share a band in one of them.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 0.5 * (step % 2))
    members = members.withColumn("band", band)
    majors = stored(_majors(members, step, "token", "band"), "majors")
    x = members.join(majors, ["token", "band"]).where((F.col("comp") != F.col("major")) & _sizes_allow(F.col("n"), F.col("lead_n"), percent))
    votes = x.groupBy("sid", "lead").agg(F.count("*").alias("k"), F.max(F.col("n") + F.col("lead_n")).alias("total"))
    place = F.row_number().over(Window.partitionBy("sid").orderBy(F.desc("k"), F.desc("lead")))
    return votes.withColumn("place", place).where(F.col("place") <= LEADS).select(F.col("sid").alias("a"), F.col("lead").alias("b"), "total")


def _groups(members: DataFrame) -> DataFrame:
    """Index entries (g1, g2, sid, n, place, comp, t0..): rare tokens alone, frequent ones in pairs g1 < g2, with the first of them.

    place is the rare token's; pairs have none.
    """
    count = stored(members.groupBy("token").agg(F.count("*").alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                   .where("lo < hi").select("token", "df"), "token-counts")
    x = stored(members.join(count, "token"), "index-tokens")
    rare = x.where(F.col("df") <= RARE).select(F.col("token").alias("g1"), F.lit(0).cast("long").alias("g2"), "sid", "n", "place", "comp", *[F.lit(0).cast("long").alias(t) for t in _HEAD])
    lists = x.where(F.col("df") > RARE).groupBy("sid", "n", "comp").agg(F.array_sort(F.collect_list("token")).alias("t"))
    head = [F.coalesce(F.get("t", F.lit(i)), F.lit(0)).alias(t) for i, t in enumerate(_HEAD)]
    firsts = lists.select("sid", "n", "comp", "t", *head, F.posexplode("t").alias("i", "g1"))
    pairs = firsts.select("g1", F.explode(F.slice("t", F.col("i") + 2, F.greatest(F.size("t") - F.col("i") - 1, F.lit(0)))).alias("g2"),
                          "sid", "n", F.lit(-1).cast("long").alias("place"), "comp", *_HEAD)
    return rare.unionByName(pairs)


def _remaining(members: DataFrame, maps: DataFrame, percent: int, best: int | None) -> DataFrame:
    """(a, b) of all pairs of different components in an index group that sizes and parity bitmaps allow.

    Pairs are looked at in blocks of at most BLOCK_PAIRS and only the ones left over are rows. Of the first two tokens
    that a link's sets share in the order one is rare or both are frequent. As they share `need` tokens, the second one
    has at most n - need + 1 others before it, so a rare token further on in either set tells nothing. A pair whose members
    share a token that makes an earlier pair of tokens is left to that group, as far as their first tokens show it.
    With best, a block gives of each component only so many pairs, those whose bitmaps differ least.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 20_000:
                table = pa.Table.from_batches(held)
                g1, g2 = table["g1"].to_numpy(), table["g2"].to_numpy()
                whole = int(np.argmax((g1 == g1[-1]) & (g2 == g2[-1])))  # the last group may go on
                if whole:
                    yield from blocks(table.slice(0, whole))
                    held = table.slice(whole).to_batches()
        if held:
            yield from blocks(pa.Table.from_batches(held))

    def blocks(table: pa.Table) -> Iterator[pa.RecordBatch]:
        g1, g2, sid, n, place, comp = (table[c].to_numpy() for c in ("g1", "g2", "sid", "n", "place", "comp"))
        maps_ = np.stack([table[m].to_numpy() for m in _MAP], 1).view(np.uint64)
        heads = np.stack([table[t].to_numpy() for t in _HEAD], 1)
        rows = len(sid)
        new = np.ones(rows, bool)
        new[1:] = (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])
        ends = np.append(np.flatnonzero(new)[1:], rows)[np.cumsum(new) - 1]
        partners = ends - np.arange(rows) - 1
        sums = np.cumsum(partners)
        at = 0
        while at < rows:
            to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + BLOCK_PAIRS, "right")))
            count = partners[at:to]
            i = np.repeat(np.arange(at, to), count)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
            keep = (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            i, j = i[keep], j[keep]
            total = n[i] + n[j]
            need = -(-percent * total // (100 + percent))
            keep = (place[i] <= n[i] - need + 1) & (place[j] <= n[j] - need + 1)
            i, j, total = i[keep], j[keep], total[keep]
            apart = np.bitwise_count(maps_[i] ^ maps_[j]).sum(1, dtype=np.int64)
            keep = (100 + percent) * (total - apart) >= 2 * percent * total
            i, j, apart = i[keep], j[keep], apart[keep]
            mine = heads[i]
            earlier = (mine != 0) & ((mine < g1[i][:, None]) | ((mine > g1[i][:, None]) & (mine < g2[i][:, None])))
            later = ~((mine[:, :, None] == heads[j][:, None, :]).any(2) & earlier).any(1)
            i, j, apart = i[later], j[later], apart[later]
            pair, one = np.unique(np.stack([np.minimum(sid[i], sid[j]), np.maximum(sid[i], sid[j])], 1), axis=0, return_index=True)
            if best is not None:
                c, apart, at_ = np.concatenate([comp[i[one]], comp[j[one]]]), np.tile(apart[one], 2), np.arange(2 * len(one))
                order = np.lexsort((apart, c))  # the pairs of every component, each at both its ends, the likeliest first
                first = np.ones(len(order), bool)
                first[1:] = c[order][1:] != c[order][:-1]
                order = order[at_ - np.maximum.accumulate(np.where(first, at_, 0)) < best]
                pair = pair[np.unique(order % max(len(one), 1))]
            if len(pair):
                yield pa.RecordBatch.from_pydict({"a": pa.array(pair[:, 0].copy()), "b": pa.array(pair[:, 1].copy())})
            at = to

    groups = _groups(members).join(maps, "sid").repartition("g1", "g2").sortWithinPartitions("g1", "g2")
    return groups.mapInArrow(run, "a BIGINT, b BIGINT").distinct()


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, rounds: int = STAR_ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; documents link at Jaccard similarity >= percent / 100.

    component_id is the smallest doc_id reachable over links, null doc_ids aside. Texts without words, null texts
    among them, have no shingles and link with nothing. Repeated rows have equal sets and share a component. A row with
    a null doc_id gets the component of the rows with its set; on its own it has none.
    Similarities are counted on 64-bit hashes of the shingles.
    """
    sets = stored(_sets(docs, size), "sets", "zstd")
    own = sets.where("slice IS NULL").select("doc_id", "n", "sid", "h")
    classes = stored(own.where("n > 0").groupBy("sid", "n").agg(F.min("doc_id").alias("first"), F.min_by("h", "doc_id").alias("h")), "classes")
    members = stored(_several(_prefixes(docs, size, percent, _frequencies(sets))), "members")
    # By id and hash, as an id may come with several texts; repeated rows then meet in the join's own partitions.
    needed = members.select("sid").distinct().join(classes, "sid").select("sid", F.col("first").alias("doc_id"), "h")
    texts = stored(_hashed(docs).join(needed, ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("sid", "text"), "texts", "zstd")
    maps = stored(_bitmaps(texts, size), "bitmaps")
    links, found, idle = None, None, 0
    for step in range(rounds):
        pairs = _plausible(_stars(_with_components(members, found), percent, step), maps, percent)
        new = stored(_verified(stored(pairs, "pairs"), texts, size, percent), "links")
        links = new if links is None else links.unionByName(new)
        found = components(links)
        idle = idle + 1 if new.isEmpty() else 0
        if idle == 2:  # neither kind of bands brings links
            break
    for best in (BEST, None):
        pairs = _remaining(stored(_with_components(members, found), "members"), maps, percent, best)
        new = stored(_verified(stored(pairs, "pairs"), texts, size, percent), "links")
        links = new if links is None else links.unionByName(new)
        found = components(links)
    first = classes.join(found.select(F.col("v").alias("sid"), "c"), "sid", "left").withColumn("c", F.coalesce("c", "sid"))
    smallest = stored(first.groupBy("c").agg(F.min("first").alias("component_id")), "smallest")
    label = stored(first.join(smallest, "c").select("sid", "n", "component_id"), "component-labels")
    out = own.join(label, ["sid", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
