"""Operator 6. Exact Jaccard join of documents on word n-grams, with set-relation skipping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm import common, textkit
from galley.llm.bloom import bloom, may_hold
from galley.llm.graph import components

U = np.uint64
#: Minimum hashes that choose leaders, and how many must agree before a leader is compared. Speed only.
SEEDS = np.random.default_rng(7).integers(1, 2**63, 12, dtype=U) * U(2) + U(1)
AGREE = 7
#: Rounds of leaders after the first, and leaders a bucket in each. Speed only.
ROUNDS, LEADERS = 2, 6
#: Pairs of two groups that are compared before all others. Speed only.
PICKS = 48
#: The order of n-grams puts frequent ones last. It needs no exact counts: a task reports n-grams in at least
#: LOCAL of its documents (the TASK_TOP most frequent), and the TABLE most frequent of those with FREQUENT or
#: more are sent to all tasks, at most 16 bytes each. Any order gives the same result. Speed only.
LOCAL, TASK_TOP, FREQUENT, TABLE = 4, 50_000, 24, 200_000
#: Words of 64 bits of a set's parity bitmap: each n-gram flips one bit, so that two bitmaps differ in no more bits than
#: the sets differ in n-grams. Speed only.
BITMAP = [f"s{i}" for i in range(8)]
SETS = "id long, n long, d1 long, d2 long, prefix array<long>, mins array<long>, " + ", ".join(f"{c} long" for c in BITMAP)


def _grams(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Ids and sorted distinct n-gram hashes, a few megabytes of text at a time."""
    for whole in batches:
        for batch in textkit.slices(whole):
            data, offsets = textkit.utf8(batch.column("text"))
            starts, ends, bounds = textkit.word_spans(data, offsets)
            yield batch.column("id"), list(textkit.shingles(textkit.word_hashes(data, starts, ends), bounds, k))


def _frequent(k: int):
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def reduced() -> tuple[np.ndarray, np.ndarray]:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= LOCAL
            values, n = values[keep], n[keep]
            top = np.argsort(-n, kind="stable")[:TASK_TOP]
            return values[top], n[top]

        for _, grams in _grams(batches, k):
            for g in grams:
                if len(g) and (key := (len(g), int(g[0]), int(g[-1]))) not in seen:  # copies count once
                    seen.add(key)
                    held.append(g)
                    size += len(g)
            if size > 4_000_000:
                values, n = reduced()
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], ["h", "n"])
                held, size, seen = [], 0, set()
        if held:
            values, n = reduced()
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], ["h", "n"])

    return counts


def _prefix(grams: np.ndarray, size: int, common_grams: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first size n-grams in the global order: those not in the table by value, then the others by frequency."""
    if not len(common_grams):
        return grams[:size]
    at = np.searchsorted(common_grams, grams)
    at[at == len(common_grams)] = 0
    known = common_grams[at] == grams
    rare = grams[~known]
    if len(rare) < size:
        often = np.flatnonzero(known)
        rare = np.concatenate([rare, grams[often[np.argsort(rank[at[often]], kind="stable")]]])
    return rare[:size]


def _sets(k: int, num: int, den: int, table):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common_grams, rank = table.value
        for ids, grams in _grams(batches, k):
            n = np.array([len(g) for g in grams], np.int64)
            flat = np.concatenate(grams) if grams else np.zeros(0, U)
            full, at = n > 0, np.cumsum(n) - n
            digests = np.zeros((2, len(grams)), U)
            mins = np.zeros((len(grams), len(SEEDS)), U)
            bitmap = np.zeros((len(grams), len(BITMAP)), U)
            if len(flat):
                for row, seed in enumerate((SEEDS[0], SEEDS[1])):
                    digests[row, full] = np.add.reduceat(textkit.mix(flat ^ seed), at[full])
                for i, seed in enumerate(SEEDS):
                    mins[full, i] = np.minimum.reduceat((flat ^ (flat >> U(31))) * seed, at[full])
                # A set's n-grams are sorted, and so are the words of its bitmap that they flip a bit of.
                word = np.repeat(np.arange(len(grams)) * len(BITMAP), n) + (flat // U(2**64 // len(BITMAP))).astype(np.int64)
                first = np.flatnonzero(np.diff(word, prepend=-1))
                bitmap.ravel()[word[first]] = np.bitwise_xor.reduceat(U(1) << (textkit.mix(flat ^ SEEDS[2]) >> U(58)), first)
            prefixes = [_prefix(g, len(g) - -(-num * len(g) // den) + 1 if len(g) else 0, common_grams, rank) for g in grams]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n), pa.array(digests[0].view(np.int64)), pa.array(digests[1].view(np.int64)),
                 textkit.lists(prefixes, pa.int64()), textkit.lists(list(mins), pa.int64()), *(pa.array(w.view(np.int64)) for w in bitmap.T.copy())],
                ["id", "n", "d1", "d2", "prefix", "mins", *BITMAP],
            )

    return build


def _stored(k: int, wanted):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = (b.filter(pa.array(may_hold(wanted.value, np.asarray(b.column("id").fill_null(0))))) for b in batches)
        for ids, grams in _grams(kept, k):
            yield pa.RecordBatch.from_arrays([ids, pa.array([g.tobytes() for g in grams], pa.binary())], ["id", "grams"])

    return build


def _entries(mixed):
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per prefix n-gram that other groups may hold too, with its position."""
        for batch in batches:
            prefix = batch.column("prefix")
            h, ends = np.asarray(prefix.flatten()), np.asarray(prefix.offsets) - prefix.offsets[0].as_py()
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            keep = np.flatnonzero(may_hold(mixed.value, h)) if len(h) else np.zeros(0, np.int64)
            rows = batch.select(["node", "n", "grp", "size", *BITMAP]).take(pa.array(row[keep]))
            at = pa.array((keep - ends[row[keep]]).astype(np.int32))
            first, last = keep == ends[row[keep]], keep + 1 == ends[row[keep] + 1]
            prev, after = pa.array(h[np.maximum(keep - 1, 0)], mask=first), pa.array(h[np.minimum(keep + 1, len(h) - 1)] if len(h) else h, mask=last)
            yield pa.RecordBatch.from_arrays([*rows.columns, at, pa.array(h[keep]), prev, after], [*rows.schema.names, "pos", "h", "prev", "next"])

    return explode


def _compare(num: int, den: int):
    """Keep pairs that link. Rows come sorted by b, so that b's set is decoded once for all its partners, and
    the answer for a partner is derived from the one before it when they differ little: only the n-grams that
    the two partners do not share are looked up in b."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, before, shared = None, np.zeros(0, U), None, 0
        for batch in batches:
            keep = []
            for b, left, right in zip(batch.column("b").to_pylist(), batch.column("left"), batch.column("right"), strict=True):
                if b != held:
                    held, at, before = b, np.frombuffer(right.as_py(), U), None
                a = np.frombuffer(left.as_py(), U)
                if before is not None and abs(len(before) - len(a)) * 8 < len(a):
                    gone, new = np.setdiff1d(before, a, True), np.setdiff1d(a, before, True)
                    shared += int(_hits(at, new)) - int(_hits(at, gone))
                else:
                    shared = int(_hits(at, a))
                before = a
                keep.append(den * shared >= num * (len(a) + len(at) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return links


def _hits(held: np.ndarray, grams: np.ndarray) -> int:
    """How many of grams are in the sorted held."""
    if not len(held):
        return 0
    at = np.searchsorted(held, grams)
    at[at == len(held)] = 0
    return int((held[at] == grams).sum())


def overlap(num: int, den: int) -> tuple[Callable[[str, str], str], Callable[[str, str], str]]:
    """SQL of the overlap that sets of two sizes need, and of the least of it that lies in both prefixes: what comes after
    them can add no more than the larger set's rest."""
    both = num + den
    need = lambda x, y: f"(({x} + {y}) * {num} + {both - 1}) div {both}"
    return need, lambda x, y: f"{need(x, y)} - ({num} * greatest({x}, {y}) + {den - 1}) div {den} + 1"


def fewest(least: Callable[[str, str], str]) -> str:
    """SQL of what a set of n n-grams must share at least with a group of sizes lo to hi. Without roundings the least of it
    is at one of the ends; the two roundings can make it one less in between."""
    return f"greatest(1, least({least('n', 'lo')}, {least('n', 'hi')}) - 1)"


class JaccardJoin:
    """Documents whose sets of k-word shingles have |A & B| * den >= num * |A | B|.

    docs: rows with an integer id and a text; k, num / den: shingle width and threshold.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z folded. A text with fewer than k words is one shingle; a null text,
    or one without words, has an empty set and links with nothing. Documents with equal sets form a class, named
    by its smallest id; all further work is on classes. A shingle stands for its 64 bits of a hash over XXH3's hashes of
    its words, so that two texts of n and m shingles are mistaken in one with a chance of n * m / 2**64. Rows that share an id count as one document that links
    where any of its texts does; rows without an id are returned without a component. Other columns are ignored.

    Index lists are blocked by set size and hold the position of the n-gram in the set's prefix, so that a probe
    skips blocks of unfit size and entries too far back to reach the needed overlap. Answers are shared between
    highly similar sets: each class is first compared with a leader that agrees on most minimum hashes, and two
    classes known to be in one group need no comparison, so that index lists within one group vanish. Other sets meet
    a group as one first, and its members only if they share enough n-grams with all of them together, so that a group
    of thousands of near copies costs a stranger one row. That serves groups(); links() and linked()
    compare those too. An empty table gives no rows.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 4, den: int = 5) -> None:
        self.spark, self.k, self.num, self.den = docs.sparkSession, k, num, den
        self.docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        self.used: list[DataFrame] = []
        self.sets = common.materialize(self.docs.mapInArrow(_sets(k, num, den, self._table()), SETS), "sets")
        full = self.sets.where("n > 0 and id is not null")
        self.classes = common.materialize(full.groupBy("d1", "d2", "n").agg(F.min("id").alias("node")), "classes")

    def _table(self):
        counted = self.docs.mapInArrow(_frequent(self.k), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
        rows = counted.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "h").limit(TABLE).toArrow()
        grams, n = np.asarray(rows["h"]).view(U), np.asarray(rows["n"])
        order = np.argsort(grams)
        grams, n = grams[order], n[order]
        return self.spark.sparkContext.broadcast((grams, np.lexsort((grams, n)).argsort()))

    def members(self) -> DataFrame:
        """(id, n, node): every row with its class; node is null without a set or id."""
        return self.sets.select("id", "n", "d1", "d2").join(common.large(self.classes), ["d1", "d2", "n"], "left").select(
            "id", "n", F.when(F.col("id").isNotNull(), F.col("node")).alias("node")
        )

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """pairs (a, b) of nodes, a < b, that link."""
        pairs = common.materialize(pairs, "pairs")
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        chosen = self.docs.mapInArrow(_stored(self.k, bloom(ids)), "id long, grams binary")
        grams = common.materialize(chosen.join(common.large(ids), "id", "left_semi"), "grams")
        out = pairs.join(common.large(grams.toDF("a", "left")), "a").join(common.large(grams.toDF("b", "right")), "b")
        out = out.sortWithinPartitions("b", F.length("left"), "a").mapInArrow(_compare(self.num, self.den), "a long, b long").distinct()
        out = common.materialize(out, "verified")
        common.release(pairs, grams, *self.used)
        self.used = []
        return out

    def _buckets(self) -> DataFrame:
        """(id, i, m, liked): the minimum hashes that some other class has too, and how many meetings a class has in all."""
        nodes = self.classes.select(F.col("node").alias("id"))
        mins = self.sets.select("id", "mins").join(common.large(nodes), "id", "left_semi").select("id", F.posexplode("mins").alias("i", "m"))
        met = common.materialize(mins.groupBy("i", "m").agg(F.count("id").alias("c")).where("c > 1"), "met")
        mins = common.materialize(mins.join(common.large(met), ["i", "m"]), "mins")
        liked = mins.groupBy("id").agg(F.sum("c").alias("liked"))
        return common.materialize(mins.select("id", "i", "m").join(liked, "id"), "buckets")

    def _leaders(self, mins: DataFrame, orders: list[Column]) -> DataFrame:
        """Pairs of a class and a leader that agree on most minimum hashes: in each bucket the first by each order leads."""
        tops = [F.max(F.struct(o.alias("o"), (-F.col("id")).alias("id"))).alias(f"top{n}") for n, o in enumerate(orders)]
        lead = mins.groupBy("i", "m").agg(*tops)
        lead = lead.select("i", "m", F.explode(F.array_distinct(F.array(*(-F.col(f"top{n}.id") for n in range(len(orders)))))).alias("a"))
        lead = common.materialize(lead, "lead")
        self.used.append(lead)
        met = mins.join(lead, ["i", "m"]).where("a <> id")
        found = met.groupBy(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).agg(F.countDistinct("i").alias("count"))
        return found.where(F.col("count") >= AGREE).select("a", "b")

    def _near(self) -> DataFrame:
        """Links between classes and leaders. Each later round has other leaders, by a hash of the id, for what is not in
        one group with them yet, so that few members of a group of near copies are left to meet all others."""
        mins = self._buckets()
        near = self._verified(self._leaders(mins, [F.col("liked"), -F.col("id")]))
        for r in range(ROUNDS):
            pairs = self._leaders(mins, [F.xxhash64("id", F.lit(LEADERS * r + n)) for n in range(LEADERS)])
            near = near.union(self._verified(self._apart(pairs, components(near)).select("a", "b")))
        common.release(mins)
        return near

    def _candidates(self, groups: DataFrame) -> DataFrame:
        """(a, b, c, ga, gb): pairs of nodes of different groups ga and gb that may link, by the c prefix n-grams they share."""
        num, den = self.num, self.den
        need, least = overlap(num, den)
        nodes = self.classes.select("node").distinct().join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("grp"))
        nodes = common.materialize(nodes, "nodes")
        nodes = nodes.join(common.large(nodes.groupBy("grp").agg(F.count("*").alias("size"))), "grp")
        rows = self.sets.where("n > 0").select(F.col("id").alias("node"), "n", "prefix", *BITMAP).join(common.large(nodes), "node")
        width = float(np.log(den / num)) * 1.001  # rounding cannot part two partners
        rows = common.materialize(rows, "prefixes")
        mixed = rows.select("grp", F.explode("prefix").alias("h")).groupBy("h").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"))
        mixed = common.materialize(mixed.where("lo < hi").select("h"), "mixed")
        entries = rows.mapInArrow(_entries(bloom(mixed)), f"node long, n long, grp long, size long, {', '.join(f'{c} long' for c in BITMAP)}, pos int, h long, prev long, next long")
        entries = entries.withColumn("block", F.floor(F.log("n") / width).cast("int"))
        entries = common.materialize(entries.join(common.large(mixed), "h"), "entries")
        self.used = [rows, mixed, entries]

        # First each set meets whole groups, the larger of two being met: a group's list holds an n-gram once for each
        # size block, however many members have it. A block is one size class: partners of n are in n's own and the two
        # beside it, and the others are skipped.
        lists = entries.groupBy("h", "block", "grp", "size").agg(F.min("n").alias("lo"), F.max("n").alias("hi")).alias("y")
        probe = entries.select("node", "n", "grp", "size", "h", F.explode(F.array(*(F.col("block") + d for d in (-1, 0, 1)))).alias("block")).alias("x")
        fit = f"(y.size > x.size or (y.size = x.size and y.grp < x.grp)) and {den} * y.hi >= {num} * x.n and {den} * x.n >= {num} * y.lo"
        hits = probe.join(common.large(lists), ["h", "block"]).where(fit).groupBy("node", F.col("y.grp").alias("other"), "block")
        hits = hits.agg(F.count("*").alias("c"), F.min("x.n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        hits = hits.withColumn("lo", F.expr(f"greatest(lo, (n * {num} + {den - 1}) div {den})")).withColumn("hi", F.expr(f"least(hi, n * {den} div {num})"))
        close = hits.where(f"c >= {fewest(least)}").select("node", "other", "block")
        close = common.materialize(close, "close")
        self.used.append(close)
        # Then it meets the members of the groups that are left.
        x = entries.drop("block", "size").join(common.large(close), "node").alias("x")
        y = entries.withColumn("other", F.col("grp")).alias("y")
        fits = f"{den} * least(x.n, y.n) >= {num} * greatest(x.n, y.n) and least(x.n - x.pos, y.n - y.pos) + least(x.pos, y.pos) >= {need('x.n', 'y.n')}"
        # Near copies that no overlap of prefixes tells apart differ behind them: their bitmaps show it before they are a pair.
        fits += f" and {' + '.join(f'bit_count(x.{c} ^ y.{c})' for c in BITMAP)} <= x.n + y.n - 2 * ({need('x.n', 'y.n')})"
        # Sets that share one prefix n-gram often share those beside it. A run of shared neighbours is met at its two
        # ends only; the places of the ends in a's prefix give its length, and their sum the shared n-grams.
        first, last = "not coalesce(x.prev = y.prev, false)", "not coalesce(x.next = y.next, false)"
        pos = "if(x.node < y.node, x.pos, y.pos)"
        met = x.join(common.large(y), ["h", "block", "other"]).where(f"{fits} and ({first} or {last})").select(
            F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"),
            F.expr(f"if({last}, {pos} + 1, 0) - if({first}, {pos}, 0)").alias("c"), F.expr(least("x.n", "y.n")).alias("least"),
            F.least("x.grp", "y.grp").alias("ga"), F.greatest("x.grp", "y.grp").alias("gb"),
        )
        return met.groupBy("a", "b", "ga", "gb").agg(F.sum("c").alias("c"), F.min("least").alias("least")).where("c >= least").select("a", "b", "c", "ga", "gb")

    def links(self) -> DataFrame:
        """(a, b): every link between two classes, named by their smallest ids, a < b."""
        return self._verified(self._candidates(self.classes.select("node", F.col("node").alias("component"))).select("a", "b"))

    def spanning(self) -> DataFrame:
        """(a, b): links between classes, a < b, enough to connect every group of linked classes.

        Of the pairs of two groups the likeliest few are compared first: where one of them links, the groups are one and
        the others are not compared. All pairs of groups that are still apart are. Groups only grow together, so that which
        of them are one by then is asked once for two groups, not for each of their pairs."""
        near = self._near()
        groups = components(near)
        found = common.materialize(self._candidates(groups), "candidates")
        common.release(*self.used)
        self.used = []
        first = found.groupBy("ga", "gb", F.pmod(F.xxhash64("a", "b"), F.lit(PICKS))).agg(F.max_by(F.struct("a", "b"), F.struct("c", "a", "b")).alias("p"))
        near = near.union(self._verified(first.select("p.a", "p.b")))
        both = found.select(F.col("ga").alias("a"), F.col("gb").alias("b")).distinct()
        still = self._apart(common.materialize(both, "both"), components(near)).select(F.col("a").alias("ga"), F.col("b").alias("gb"))
        far = self._verified(found.join(common.large(still), ["ga", "gb"], "left_semi").select("a", "b"))
        return common.materialize(near.union(far).distinct(), "links")

    @staticmethod
    def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
        """pairs with their ends' groups, ga < gb, of those that are not in one."""
        side = lambda c: common.large(groups.select(F.col("node").alias(c), F.col("component").alias(f"g{c}")))
        named = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").withColumns({"ga": F.coalesce("ga", "a"), "gb": F.coalesce("gb", "b")})
        return named.where("ga <> gb").withColumns({"ga": F.least("ga", "gb"), "gb": F.greatest("ga", "gb")})

    def linked(self) -> DataFrame:
        """(id, n_shingles, node, n_links): each row's class, and the number of rows beside it that are in the same
        class or in one linked with it."""
        sizes = self.members().where("node is not null").groupBy("node").agg(F.count("*").alias("size"))
        sizes = common.materialize(sizes, "sizes")
        pairs = self.links()
        both = pairs.union(pairs.select("b", "a"))
        near = both.join(sizes.select(F.col("node").alias("b"), "size"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("size").alias("more"))
        sizes = common.materialize(sizes.join(near, "node", "left").select("node", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n_links")), "counts")
        return self.members().join(common.large(sizes), "node", "left").select("id", F.col("n").alias("n_shingles"), "node", F.coalesce("n_links", F.lit(0)).alias("n_links"))

    def groups(self) -> DataFrame:
        """(id, n_shingles, component): one row per row of docs; component is the smallest id reachable by links."""
        found = components(self.spanning())
        return self.members().join(common.large(found), "node", "left").select(
            "id", F.col("n").alias("n_shingles"), F.coalesce("component", "node", "id").alias("component")
        )


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents by links of 4-word shingle sets with Jaccard similarity of 0.85 or more."""
    found = JaccardJoin(common.read(spark, sf_dir, "documents"), k=4, num=85, den=100).groups()
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
