"""Checking batches against everything accepted before, through persisted sorted signature runs (problem 4)."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliary.llm.signatures import SKETCH, ForestPlan, recall_of, shared_bits, signature_table, verified
from foliary.session import files as folder
from foliary.session import materialize, remove_path, scratch_path

ENTRY = "key long, s1 long, s2 long, id long"


def open_parquet(uri: str) -> pq.ParquetFile:
    """A parquet file by the address Spark gives it; s3a and s3n are what other libraries call s3."""
    scheme, sep, rest = uri.partition("://")
    fs, at = pafs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + sep + rest if sep else uri)
    return pq.ParquetFile(fs.open_input_file(at))


def _spans(pf: pq.ParquetFile) -> list[tuple[int, int]]:
    """Least and greatest value of the first column in each row group."""
    stats = [pf.metadata.row_group(g).column(0).statistics for g in range(pf.num_row_groups)]
    return [(s.min, s.max) if s is not None and s.has_min_max else (-(2**63), 2**63 - 1) for s in stats]


def classes_of(signed: DataFrame) -> DataFrame:
    """One row of a signature table for each print, that of the least id."""
    return signed.groupBy("print").agg(F.min(F.struct("id", "s1", "s2", "keys")).alias("r")).select("print", "r.*")


class HashForest:
    """A prefix-tree hash forest on disk: sorted runs of (key, sketch, id) of every distinct word multiset seen.

    A run has three tables: entries sorted by key (tree, then the hashes of its permutation) in files of one range each; prints, the
    exact fingerprints, in files of one range each; and, with texts, the texts sorted by id. A manifest names the plan, the runs, and
    each file with its range, so that a probe opens only the files whose range meets the batch and reads only the row groups that do:
    its cost follows the batch. append() writes a run beside the older ones and then replaces the manifest in one step, so a run that was
    not finished is never seen; merge() rewrites all runs as one. A forest opened on the path of an older one goes on from its manifest.

    ids must be unique over all that is added and be non-negative numbers.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, plan: ForestPlan = ForestPlan(), range_rows: int = 2_000_000):
        self.spark, self.plan, self.range_rows = spark, plan, range_rows
        self.path = (path or scratch_path(spark, "forest")).rstrip("/")
        self.manifest = {"plan": asdict(plan), "next": 0, "runs": {}}
        if path and (held := folder.read(spark, f"{self.path}/manifest.json")) is not None:
            self.manifest = json.loads(held)
            if self.manifest["plan"] != asdict(plan):
                raise ValueError(f"the forest at {path} was built by another plan: {self.manifest['plan']}")

    @property
    def runs(self) -> list[str]:
        return sorted(self.manifest["runs"])

    def _write(self, tables: dict[str, tuple[DataFrame, str]], rows: int, without: list[str] = ()) -> None:
        """Write tables (name: rows, column to sort by) as a run, then commit it in the manifest, in which the runs of `without` are left out."""
        run = f"run-{self.manifest['next']:05d}"
        where = {}
        for name, (df, by) in tables.items():
            path = f"{self.path}/{run}/{name}"
            df.sortWithinPartitions(by).write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 1 << 20).parquet(path)
            done = self.spark.read.schema(df.schema).parquet(path)
            ranges = done.groupBy(F.input_file_name().alias("f")).agg(F.min(by).alias("lo"), F.max(by).alias("hi"), F.count("*").alias("n")).collect()
            where[name] = sorted([r.f, str(r.lo) if name == "prints" else r.lo, str(r.hi) if name == "prints" else r.hi, r.n] for r in ranges)
        kept = {k: v for k, v in self.manifest["runs"].items() if k not in without}
        self.manifest = self.manifest | {"next": self.manifest["next"] + 1, "runs": kept | {run: where | {"rows": rows}}}
        folder.replace(self.spark, f"{self.path}/manifest.json", json.dumps(self.manifest))

    def _parts(self, rows: int) -> int:
        return max(1, self.spark.sparkContext.defaultParallelism, -(-rows // self.range_rows))

    def append(self, signed: DataFrame, texts: DataFrame | None = None) -> None:
        """Add the classes of a signature table (one row for each print, see classes_of) as a run; texts: id, text of its rows, to verify against later."""
        classes = materialize(signed.select("print", "id", "s1", "s2", "keys"), "classes")
        rows = classes.count()
        if not rows:
            return
        entries = classes.select(F.explode("keys").alias("key"), "s1", "s2", "id")
        # the tree, and as many leading hash bits as there are parts: the hashes are uniform, so the ranges are even without a look at the rows
        cut = F.shiftright("key", max(0, self.plan.shift(0) - max(0, (self._parts(rows * self.plan.trees) // self.plan.trees).bit_length())))
        tables = {
            "entries": (entries.repartition(self._parts(rows * self.plan.trees), cut), "key"),
            "prints": (classes.select(F.hex("print").alias("print"), "id").repartition(self._parts(rows // 8), F.substring("print", 1, 3)), "print"),
        }
        if texts is not None:
            held = texts.join(classes.select("id"), "id", "left_semi").select("id", F.col("text").alias("text"))
            tables["texts"] = (held.repartitionByRange(self._parts(rows), "id"), "id")
        self._write(tables, rows)

    def add(self, df: DataFrame, id_col: str, text_col: str) -> None:
        """Sign rows and append them with their texts."""
        texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
        self.append(classes_of(signature_table(texts, "id", "text", self.plan)), texts)

    def table(self, name: str) -> DataFrame:
        """All runs of one of the tables: entries, prints or texts."""
        shape = {"entries": ENTRY, "prints": "print string, id long", "texts": "id long, text string"}[name]
        paths = [f"{self.path}/{r}/{name}" for r in self.runs if name in self.manifest["runs"][r]]
        return self.spark.read.schema(shape).parquet(*paths) if paths else self.spark.createDataFrame([], shape)

    def merge(self) -> None:
        """Rewrite all runs as one. The old runs go once the new one stands in the manifest."""
        old = self.runs
        if len(old) < 2:
            return
        rows = sum(self.manifest["runs"][r]["rows"] for r in old)
        sizes = {"entries": ("key", rows * self.plan.trees), "prints": ("print", rows // 8), "texts": ("id", rows)}
        held = [t for t in sizes if all(t in self.manifest["runs"][r] for r in old)]
        tables = {t: (self.table(t).repartitionByRange(self._parts(sizes[t][1]), sizes[t][0]), sizes[t][0]) for t in held}
        self._write(tables, rows, without=old)
        for r in old:
            remove_path(self.spark, f"{self.path}/{r}")

    def _files(self, name: str) -> list[tuple]:
        return [tuple(f) for r in self.runs for f in self.manifest["runs"][r].get(name, [])]

    def _met(self, asked: DataFrame, key: Column, name: str) -> DataFrame:
        """Rows of `asked` for each file of a table whose range holds `key`, with the file as `file`, one task for each (file, part)."""
        files = self._files(name)
        kind = "string" if name == "prints" else "long"
        ranges = self.spark.createDataFrame([(f, lo, hi) for f, lo, hi, _ in files], f"file string, lo {kind}, hi {kind}") if files else self.spark.createDataFrame([], f"file string, lo {kind}, hi {kind}")
        low, high = (key, key) if isinstance(key, Column) else key
        return asked.join(F.broadcast(ranges), (F.col("lo") <= high) & (F.col("hi") >= low)).drop("lo", "hi")  # as many rows as there are files

    def known_prints(self, signed: DataFrame) -> DataFrame:
        """Prints of the batch that the forest holds, read from the files that may hold them."""
        asked = self._met(signed.select(F.hex("print").alias("p"), "print").distinct(), F.col("p"), "prints")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = None, None
            for b in batches:
                keep = []
                for f, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if f != at:
                        pf = open_parquet(f)
                        at, held = f, set(pf.read(columns=["print"]).column(0).to_pylist())
                    keep.append(p in held)
                yield pa.RecordBatch.from_arrays([b.column(2).filter(pa.array(keep))], names=["print"])

        return asked.select("file", "p", "print").repartition("file").sortWithinPartitions("file", "p").mapInArrow(run, "print binary").distinct()

    def texts_of(self, ids: DataFrame) -> DataFrame:
        """id, text of the ids asked for, from the row groups that hold them."""
        asked = self._met(ids.select("id").distinct(), F.col("id"), "texts")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                who = b.column(1).to_numpy()
                for f in dict.fromkeys(b.column(0).to_pylist()):
                    mine = np.sort(who[np.array([x == f for x in b.column(0).to_pylist()])])
                    pf = open_parquet(f)
                    for g, (lo, hi) in enumerate(_spans(pf)):
                        i, j = np.searchsorted(mine, lo, "left"), np.searchsorted(mine, hi, "right")
                        if i < j:
                            t = pf.read_row_group(g, columns=["id", "text"])
                            yield from t.filter(pa.array(np.isin(t["id"].to_numpy(), mine[i:j]))).to_batches()

        return asked.select("file", "id").repartition("file").sortWithinPartitions("file", "id").mapInArrow(run, "id long, text string")

    def probe(self, signed: DataFrame, most: int | None = None, depth: int | None = None) -> DataFrame:
        """a (id of the batch), b (id of the history), bits, depth: entries that share a prefix of at least `depth` hashes (plan.depth) and pass the sketch test.

        The prefix of a batch entry is a range of keys, located by binary search. With most, a batch entry yields only its likeliest partners of
        each row group, and a row with a null b where it has more: those entries can be probed again without it. bits (sketch bits shared)
        and depth (of the longest common prefix) tell the likeliest.
        """
        plan, least = self.plan, self.plan.least_bits
        shift = plan.shift(depth or plan.depth)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, pf, spans = None, None, []
            for batch in batches:
                names = batch.column(0).to_pylist()
                all_rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(1, 5)]
                for f in dict.fromkeys(names):
                    if f != at:
                        at, pf = f, open_parquet(f)
                        spans = _spans(pf)
                    mine = np.flatnonzero(np.array([x == f for x in names]))
                    mine = mine[np.argsort(all_rows[0][mine], kind="stable")]
                    key, s1, s2, ident = (x[mine] for x in all_rows)
                    low = (key >> shift) << shift
                    high = low + (1 << shift) - 1
                    for g, (lo, hi) in enumerate(spans):
                        i, j = np.searchsorted(high, lo, "left"), np.searchsorted(low, hi, "right")
                        if i >= j:
                            continue
                        known = pf.read_row_group(g, columns=["key"]).column(0).to_numpy()
                        left, right = np.searchsorted(known, low[i:j], "left"), np.searchsorted(known, high[i:j], "right")
                        many = right - left
                        if not many.sum():
                            continue
                        rest = pf.read_row_group(g, columns=["s1", "s2", "id"])
                        t1, t2, there = (rest.column(c).to_numpy() for c in range(3))
                        step = max(1, int(np.ceil(len(many) * 2_000_000 / max(1, many.sum()))))
                        for u in range(0, len(many), step):
                            m = many[u : u + step]
                            q = np.repeat(np.arange(i + u, i + u + len(m)), m)
                            h = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(left[u : u + step], m)
                            bits = shared_bits(s1[q], t1[h], s2[q], t2[h])
                            good = np.flatnonzero(bits >= least)
                            if not len(good):
                                continue
                            good = good[np.lexsort((h[good], -bits[good], q[good]))]
                            over = np.empty(0, np.int64)
                            if most is not None:
                                first = np.maximum.accumulate(np.where(np.diff(q[good], prepend=-1) != 0, np.arange(len(good)), 0))
                                rank = np.arange(len(good)) - first
                                over = ident[np.unique(q[good[rank >= most]])]
                                good = good[rank < most]
                            deep = plan.depths(key[q[good]], known[h[good]])
                            pad = lambda x: pa.array(np.concatenate([x, 0 * over]).astype(np.int32))  # noqa: B023, E731
                            yield pa.RecordBatch.from_arrays(
                                [
                                    pa.array(np.concatenate([ident[q[good]], over])),
                                    pa.array(np.concatenate([there[h[good]], 0 * over]), mask=np.arange(len(good) + len(over)) >= len(good)),
                                    pad(bits[good]),
                                    pad(deep),
                                ],
                                names=["a", "b", "bits", "depth"],
                            )

        entries = signed.select(F.explode("keys").alias("key"), "s1", "s2", "id")
        low = F.shiftleft(F.shiftright("key", shift), shift)
        asked = self._met(entries, (low, low + F.lit((1 << shift) - 1)), "entries").select("file", "key", "s1", "s2", "id")
        found = asked.repartition("file").sortWithinPartitions("file", "key").mapInArrow(run, "a long, b long, bits int, depth int")
        return found.groupBy("a", "b").agg(F.max("bits").alias("bits"), F.max("depth").alias("depth"))


def _known_to(forest: HashForest, signed: DataFrame, texts: DataFrame, old: DataFrame | None, plan: ForestPlan, most: int = 16, first: int = 4) -> DataFrame:
    """id of entries with a verified partner in the forest. old: id, text of the history, or None where the forest has the texts.

    The longest matched prefixes are verified first, the `first` likeliest partners of each entry before its others; entries without a partner
    go on with shorter prefixes until the links found tell that plan.recall of all are met. Entries with more candidates than `most` in one
    place see all of them, if the likeliest fail.
    """
    spark = signed.sparkSession
    hit, links = spark.createDataFrame([], "id long"), spark.createDataFrame([], "a long, b long, likeness double")

    def settle_with(found: DataFrame) -> None:
        nonlocal hit, links
        there = old
        if there is None:
            there = materialize(forest.texts_of(found.select(F.col("b").alias("id"))), "history-texts")
        done = materialize(verified(found, texts, plan.threshold, there), "hits")
        links = links.union(done)
        hit = hit.union(done.select(F.col("a").alias("id")).distinct())

    def widen(found: DataFrame) -> None:
        near = Window.partitionBy("a").orderBy(F.desc("depth"), F.desc("bits"), "b")
        ranked = materialize(found.withColumn("rank", F.row_number().over(near)), "ranked")
        settle_with(ranked.where(F.col("rank") <= first))
        for d in range(plan.deepest, plan.depth - 1, -1):
            rest = ranked.where((F.col("rank") > first) & (F.col("depth") == d)).join(hit.select(F.col("id").alias("a")), "a", "left_anti")
            rest = materialize(rest, "rest")
            if not rest.isEmpty():
                settle_with(rest)
            if recall_of(links, d, plan) >= plan.recall:
                break

    found = materialize(forest.probe(signed, most), "probed")
    widen(found.where("b is not null"))
    over = materialize(found.where("b is null").select(F.col("a").alias("id")).distinct().join(hit, "id", "left_anti"), "over")
    if not over.isEmpty():
        widen(forest.probe(signed.join(over, "id", "left_semi")))
    depth = plan.depth
    while recall_of(links, depth, plan) < plan.recall and depth > plan.least_depth:  # links are rarely met even there: shorter prefixes still
        depth -= 1
        left = signed.join(hit, "id", "left_anti")
        settle_with(materialize(forest.probe(left, depth=depth).where(F.col("depth") == depth), "wider"))
    return materialize(hit.distinct(), "known")


def _crowd_repeats(signed: DataFrame, order: DataFrame, texts: DataFrame, plan: ForestPlan, crowd: int = 64) -> DataFrame | None:
    """ids that are repeats of the first entry of a crowded prefix, where that entry is the first under all its prefixes and so free.

    A family of very many near copies is settled by its first member this way, before any of its pairs are made. None without crowds.
    """
    few = 200_000  # rows of two or three numbers: what may be broadcast, by their count
    signed = signed.withColumn("keys", F.transform("keys", lambda k: plan.prefix(k, plan.depth)))
    keys = signed.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("key")
    keys = materialize(keys, "crowded")
    n_keys = keys.count()
    if not n_keys:
        return None

    def small(df: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(df) if rows <= few else df

    placed = signed.join(order.select("id", "place"), "id").select("keys", "s1", "s2", "id", "place")
    entries = placed.select(F.explode("keys").alias("key"), "s1", "s2", "id", "place")
    inside = materialize(entries.join(small(keys, n_keys), "key", "left_semi"), "crowd")
    heads = materialize(inside.groupBy("key").agg(F.min(F.struct("place", "id", "s1", "s2")).alias("h")).select("key", F.col("h.id").alias("head"), F.col("h.place").alias("first"), F.col("h.s1").alias("t1"), F.col("h.s2").alias("t2")), "heads")
    names = heads.select(F.col("head").alias("id"), "first").distinct()
    own = materialize(signed.join(small(names, n_keys), "id").select(F.explode("keys").alias("key"), F.col("id").alias("head"), "first"), "own")
    behind = entries.select("key", "place").join(small(own, own.count()), "key").where(F.col("place") < F.col("first")).select("head").distinct()
    free = heads.join(behind, "head", "left_anti")
    near = F.bit_count(F.col("s1").bitwiseXOR(F.col("t1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("t2"))) <= SKETCH - plan.least_bits
    pairs = inside.join(small(free, n_keys), "key").where(F.col("id") != F.col("head")).where(near).select(F.col("id").alias("a"), F.col("head").alias("b")).distinct()
    pairs = materialize(pairs, "pairs")
    if pairs.isEmpty():
        return None
    return materialize(verified(pairs, texts.join(signed.select("id"), "id", "left_semi"), plan.threshold).select(F.col("a").alias("id")).distinct(), "settled")


def settle(order: DataFrame, links: DataFrame, known: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """ids that are repeats: known ones, and those linked to an earlier id that isn't itself a repeat.

    order: id, place (unique, earlier first); links: a, b; known: id. An id is free once no earlier linked id is open or
    free; it is a repeat as soon as an earlier linked id is free. Only ids with links to open ids stay in the rounds, whose number is
    the longest chain of decisions, not the number of ids.
    """
    p, q = order.select(F.col("id").alias("a"), F.col("place").alias("pa")), order.select(F.col("id").alias("b"), F.col("place").alias("pb"))
    placed = links.join(p, "a").join(q, "b")
    edges = placed.select(F.when(F.col("pa") < F.col("pb"), F.col("a")).otherwise(F.col("b")).alias("early"), F.when(F.col("pa") < F.col("pb"), F.col("b")).otherwise(F.col("a")).alias("late")).distinct()
    known = known.select("id").distinct()
    edges = edges.join(known.select(F.col("id").alias("late")), "late", "left_anti").join(known.select(F.col("id").alias("early")), "early", "left_anti")
    edges, repeats = materialize(edges.select("early", "late"), "edges"), [known]
    for _ in range(most_rounds):
        if edges.isEmpty():
            break
        late = edges.select(F.col("late").alias("early")).distinct()
        free = edges.select("early").distinct().join(late, "early", "left_anti")
        gone = materialize(edges.join(free, "early").select("late").distinct(), "gone")
        repeats.append(gone.select(F.col("late").alias("id")))
        left = edges.join(free, "early", "left_anti").join(gone, "late", "left_anti").join(gone.select(F.col("late").alias("early")), "early", "left_anti")
        edges = materialize(left.select("early", "late"), "edges")
    else:
        raise RuntimeError(f"the order of arrival did not settle in {most_rounds} rounds")
    out = repeats[0]
    for r in repeats[1:]:
        out = out.union(r)
    return out


def known_incoming(history: DataFrame | None, incoming: DataFrame, history_id: str, incoming_id: str, batch: str, text: str = "text", plan: ForestPlan = ForestPlan(), forest: HashForest | None = None) -> DataFrame:
    """incoming ids to reject: rows taken by (batch, id), likeness plan.threshold or more to a history row or to an earlier accepted one.

    The history is signed once and kept as sorted runs of a HashForest. Pass one that holds it already, with its texts (HashForest.add), to
    skip that: `history` is then not read and may be None, and what is read follows the batch; add the accepted rows to the forest
    afterwards. The incoming rows are probed against the runs and against one another, candidates verified on their texts, and the order of
    arrival settled over the links. Exact copies (same words) are one class: its first row is settled, every later one is a repeat in any case.

    Null ids, null texts and texts of fewer than plan.least_words words take no part and are never repeats; rows repeated with
    the same id count once; an empty history or an empty batch is no special case. ids of the history and of the incoming rows
    may overlap: the two are never compared.
    """
    spark = incoming.sparkSession
    new = incoming.select(F.col(incoming_id).cast("long").alias("id"), F.col(batch).cast("long").alias("batch"), F.col(text).cast("string").alias("text")).where("id is not null and text is not null")
    new_signed = materialize(signature_table(new, "id", "text", plan), "incoming")
    old = None
    if forest is None:
        forest = HashForest(spark, plan=plan)
        old = history.select(F.col(history_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null and text is not null")
        forest.append(classes_of(signature_table(old, "id", "text", plan)))
    elif forest.plan != plan:
        raise ValueError("the forest was built by another plan")
    place = new.groupBy("id").agg(F.min(F.struct("batch", "id")).alias("place"))
    rows = new_signed.select("print", "id").distinct().join(place, "id")
    firsts = rows.groupBy("print").agg(F.min(F.struct("place", "id")).alias("f")).select("print", F.col("f.id").alias("first"), F.col("f.place").alias("place"))
    firsts = materialize(firsts, "firsts")
    same = materialize(firsts.join(forest.known_prints(firsts), "print", "left_semi").select(F.col("first").alias("id")), "same")
    # one row for each class, by its first row; a row id given with several texts may stand for several classes
    one = new_signed.join(firsts.select("print", F.col("first").alias("id")), ["print", "id"], "left_semi").dropDuplicates(["id"])
    open_signs = materialize(one.join(same, "id", "left_anti"), "open")
    texts = new.select("id", "text")
    known = materialize(_known_to(forest, open_signs, texts, old, plan).union(same), "known")
    order = firsts.select(F.col("first").alias("id"), "place")
    still = materialize(open_signs.join(known, "id", "left_anti"), "still")
    if (crowded := _crowd_repeats(still, order, texts, plan)) is not None:
        still = materialize(still.join(crowded, "id", "left_anti"), "still")
        known = materialize(known.union(crowded), "known")
    own = HashForest(spark, plan=plan)
    own.append(still)
    among = own.probe(still).where("a < b").select("a", "b")
    links = materialize(verified(among, texts.join(still.select("id"), "id", "left_semi"), plan.threshold).select("a", "b"), "links")
    repeats = settle(order, links, known)
    later = rows.join(firsts.select("print", "first"), "print").where("id <> first").select("id")
    return repeats.union(later).distinct().select(F.col("id").alias(incoming_id))
