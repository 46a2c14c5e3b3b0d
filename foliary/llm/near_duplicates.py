"""Groups of near-duplicate texts through a MinHash LSH forest (problem 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm.signatures import ForestPlan, recall_of, shared_bits, signature_table, verified
from foliary.operators.components import connected_components
from foliary.session import materialize, release

WINDOW = 64
BLOCK = 4096  # entries of a crowded prefix that one task compares with as many others
HOT = 50_000  # entries of one prefix that are more than one task's share, whatever the size of the collection


def _leaf_pairs(plan: ForestPlan, depth: int, window: int):
    """Candidate pairs of entries sorted by (key, id): leaves of one trie that share a prefix of `depth` hashes, with the length they share.

    Every entry meets the window - 1 leaves before it, which share the longest prefixes with it, and the first of its prefix; a prefix of
    more entries than that gives a marker row (a = prefix, b = null) too, so that the rest of its pairs can be made in a second pass.
    """
    shift = plan.shift(depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.empty((5, 0), np.int64)  # key, s1, s2, id, place under its prefix
        head = np.zeros(4, np.int64)  # key, s1, s2, id of the first entry of the last prefix
        for batch in batches:
            fresh = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)])
            n, m = kept.shape[1], fresh.shape[1]
            if not m:
                continue
            prefix = fresh[0] >> shift
            new = np.ones(m, dtype=bool)
            new[1:] = prefix[1:] != prefix[:-1]
            new[0] = not n or prefix[0] != kept[0, -1] >> shift
            at = np.arange(m)
            first = np.maximum.accumulate(np.where(new, at, -1))
            place = np.where(first < 0, (kept[4, -1] if n else 0) + at + 1, at - first)
            heads = np.where(first < 0, head[:, None], fresh[:, np.maximum(first, 0)])
            rows = np.concatenate([kept, np.vstack([fresh, place])], axis=1)
            key, s1, s2, ident, place = rows
            a, b, deep = [], [], []

            def meet(i, k, t1, t2, other):
                good = shared_bits(s1[i], t1, s2[i], t2) >= plan.least_bits
                a.append(ident[i[good]])
                b.append(other[good])
                deep.append(plan.depths(key[i[good]], k[good]))

            now = np.arange(n, n + m)
            for back in range(1, window):
                now = now[place[now] >= back]
                if not len(now):
                    break
                meet(now, key[now - back], s1[now - back], s2[now - back], ident[now - back])
            far = np.flatnonzero(place[n:] >= window)
            meet(n + far, heads[0, far], heads[1, far], heads[2, far], heads[3, far])
            over = key[n:][place[n:] == window] >> shift
            x, y, z = np.concatenate(a), np.concatenate(b), np.concatenate(deep)
            none = np.arange(len(x) + len(over)) >= len(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.minimum(x, y), over])), pa.array(np.concatenate([np.maximum(x, y), 0 * over]), mask=none), pa.array(np.concatenate([z, 0 * over]).astype(np.int32))],
                names=["a", "b", "depth"],
            )
            kept, head = rows[:, max(0, n + m - window) :], heads[:, -1]

    return run


def _hot_prefixes(classes: DataFrame, plan: ForestPlan, depth: int, hot: int, of: int = 16) -> list[int]:
    """Prefixes that hold more than about `hot` entries, from one class in `of`: at most trees * rows / hot of them."""
    some = classes.where(F.pmod(F.xxhash64("print"), F.lit(of)) == 0).select(F.explode("keys").alias("key")).select(plan.prefix(F.col("key"), depth).alias("prefix"))
    return sorted(r[0] for r in some.groupBy("prefix").agg(F.count("*").alias("n")).where(F.col("n") * of > hot).select("prefix").toLocalIterator())


def _candidates(classes: DataFrame, plan: ForestPlan, depth: int, window: int, hot: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries (key, s1, s2, id), candidate pairs (a, b, depth) that share a prefix of at least `depth`, and the prefixes whose pairs are not all made.

    A prefix lies in one task; one that is too large for that is cut at deeper hashes, and so is one of those whose pairs are not all made.
    """
    entries = classes.select(F.explode("keys").alias("key"), "s1", "s2", "id")
    prefix, split = plan.prefix(F.col("key"), depth), F.lit(0)
    if hots := _hot_prefixes(classes, plan, depth, hot):
        split = F.when(prefix.isin(hots), F.pmod(F.col("key"), F.lit(1 << plan.shift(depth)))).otherwise(0)
    ordered = entries.repartition(prefix, split).sortWithinPartitions("key", "id")
    found = ordered.mapInArrow(_leaf_pairs(plan, depth, window), "a long, b long, depth int").groupBy("a", "b").agg(F.max("depth").alias("depth"))
    found = materialize(found, "candidates")
    crowded = found.where("b is null").select(F.col("a").alias("prefix"))
    if hots:
        crowded = crowded.union(classes.sparkSession.createDataFrame([(h,) for h in hots], "prefix long")).distinct()
    return entries, found.where("b is not null"), crowded


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, plan: ForestPlan = ForestPlan(), window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """id, group_id (the least id of the group) for every row in a group of at least two rows.

    Two rows are linked at multiset word likeness plan.threshold or more; a group is all rows connected by links. Texts with
    the same words (copies) are one entry of the forest. Each tree of the forest holds the entries sorted by a permuted signature. Entries
    that share the longest prefixes are verified first; the matched prefixes are then shortened, hash by hash, until the links found tell
    that plan.recall of all links are met. A sketch test drops hopeless candidates, and every surviving pair is verified on its texts.
    Under a prefix that more than `window` entries share, a first pass compares the leaves that share most; the rest of its pairs
    follow in a second pass, in blocks, of which only pairs between different groups remain.

    Null ids, null texts and texts of fewer than plan.least_words words take no part; repeated rows (same id and text) count
    once; an empty table gives an empty table. Other columns are not read.
    """
    signed = materialize(signature_table(df, id_col, text_col, plan), "signatures")
    classes = signed.groupBy("print").agg(F.min(F.struct("id", "s1", "s2", "keys")).alias("r")).select("print", "r.*")
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    empty = df.sparkSession.createDataFrame([], "a long, b long, likeness double")
    links, depth, share = empty, plan.depth, 0.0
    while True:
        entries, found, crowded = _candidates(classes, plan, depth, window, hot)
        needed = found.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        own = materialize(texts.join(needed, "id", "left_semi"), "texts")
        for d in range(plan.deepest if depth == plan.depth else depth, depth - 1, -1):
            links = links.union(materialize(verified(found.where(F.col("depth") == d), own, plan.threshold), "verified"))
            share = recall_of(links, d, plan)
            if share >= plan.recall:
                break
        groups = connected_components(links)
        if not crowded.isEmpty():
            rest = materialize(verified(_rest_of_crowded(entries, crowded, groups, plan, depth), texts, plan.threshold), "verified")
            if not rest.isEmpty():
                links = links.union(rest)
                groups = connected_components(rest.select("a", "b").union(groups.select("node", "component")))
        release(own)
        if share >= plan.recall or depth <= plan.least_depth:
            break
        depth -= 1
    roots = groups.select(F.col("node").alias("id"), F.col("component").alias("group_id"))
    named = signed.groupBy("print").agg(F.min("id").alias("id")).join(roots, "id", "left").select("print", F.coalesce("group_id", "id").alias("group_id"))
    rows = signed.select("print", "id").distinct().join(named, "print").select("id", "group_id").distinct()
    several = rows.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1").select("group_id")
    return rows.join(several, "group_id").select("id", "group_id")


def _rest_of_crowded(entries: DataFrame, crowded: DataFrame, groups: DataFrame, plan: ForestPlan, depth: int) -> DataFrame:
    """Pairs under crowded prefixes whose ends the first pass left in different groups.

    Under a crowded prefix nearly all entries belong to one group after the first pass. The entries outside that group
    meet all entries of the prefix; entries of that group never meet each other again. Both sides are cut into blocks whose number
    follows the counts of the prefix, so a task compares at most about BLOCK entries with BLOCK others, however large the prefix.
    """
    inside = entries.withColumn("prefix", plan.prefix(F.col("key"), depth)).join(crowded, "prefix")
    inside = inside.join(groups.withColumnRenamed("node", "id"), "id", "left").select("prefix", "id", "s1", "s2", F.coalesce("component", "id").alias("component"))
    inside = materialize(inside, "crowded")
    count = inside.groupBy("prefix", "component").agg(F.count("*").alias("n"))
    size = count.groupBy("prefix").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("apart"))
    blocks = lambda c: F.ceil(F.col(c) / F.lit(BLOCK)).cast("int")
    size = size.where("apart > 0").select("prefix", "main", blocks("all").alias("na"), blocks("apart").alias("nb"))
    placed = inside.join(size, "prefix").withColumn("h", F.xxhash64("id"))
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    every = placed.select("prefix", F.pmod("h", F.col("na")).cast("int").alias("i"), copies("nb").alias("j"), "id", "s1", "s2", "component", F.lit(False).alias("apart"))
    apart = placed.where("component <> main").select("prefix", copies("na").alias("i"), F.pmod(F.shiftright("h", 20), F.col("nb")).cast("int").alias("j"), "id", "s1", "s2", "component", F.lit(True).alias("apart"))

    def compare(t: pa.Table) -> pa.Table:
        ident, s1, s2, comp, side = (t[c].to_numpy() for c in ("id", "s1", "s2", "component", "apart"))
        x, y = np.flatnonzero(side), np.flatnonzero(~side)
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k in range(0, len(x), 128):
            q = x[k : k + 128]
            good = (comp[q, None] != comp[None, y]) & (shared_bits(s1[q, None], s1[None, y], s2[q, None], s2[None, y]) >= plan.least_bits)
            r, c = np.nonzero(good)
            a.append(ident[q[r]])
            b.append(ident[y[c]])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return every.union(apart).groupBy("prefix", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, plan: ForestPlan = ForestPlan()) -> DataFrame:
    """id_a < id_b of every two rows of the same group (see near_duplicate_groups).

    The result has all pairs of a group, as its use demands; groups and membership alone are what near_duplicate_groups gives. The first
    of each pair is spread over tasks by its id, so no task makes all pairs of a large group.
    """
    rows = materialize(near_duplicate_groups(df, id_col, text_col, plan), "grouped")
    sizes = rows.groupBy("group_id").agg(F.ceil(F.count("*") / F.lit(1024)).cast("int").alias("salts"))
    placed = rows.join(sizes, "group_id")
    a = placed.select("group_id", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), F.col("id").alias("id_a"))
    b = placed.select("group_id", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("id").alias("id_b"))
    return a.join(b, ["group_id", "salt"]).where("id_a < id_b").select("id_a", "id_b")
