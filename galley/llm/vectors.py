"""Operators 5 and 9. Embeddings: near-duplicates by PCA-ordered tiles, and exact top-k search by MaxScore."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galley.llm import common
from galley.llm.graph import components

#: Vectors in a tile, tiles in a block, leading dimensions kept as a box, dimensions accumulated between two bounds.
TILE, BLOCK, BOX, STEP = 1024, 8, 6, 8
#: Vectors the axes are fitted on, and that seed a search's thresholds: those of least hash of the id. Speed only.
SAMPLE = 4096
#: Vectors in a search shard, queries in a block, and terms probed between two bounds.
SHARD, QUERIES, PROBE = 4096, 512, 8


def finite(column: str) -> Column:
    """No null and no component that is null, NaN or infinite."""
    c = F.col(column)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return c.isNotNull() & (F.size(c) > 0) & ~F.coalesce(bad, F.lit(True))


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    """Lists of one length as a matrix."""
    flat = np.asarray(column.flatten())
    return flat.reshape(rows, -1) if rows else flat.reshape(0, 0)


def by_length(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    sizes = np.asarray(pc.list_value_length(batch.column(column)))
    for n in np.unique(sizes):
        yield batch.filter(pa.array(sizes == n))


def sampled(vectors: DataFrame, key: str) -> dict[int, np.ndarray]:
    """At most SAMPLE vectors, one for an id, by their length."""
    rows = vectors.orderBy(F.xxhash64(key), key).select(key, "embedding").limit(SAMPLE).toArrow().combine_chunks()
    once = np.unique(np.asarray(rows[key]), return_index=True)[1]
    parts = [p for b in rows.to_batches() for p in by_length(b.take(pa.array(once)), "embedding")]
    return {x.shape[1]: x.astype(float) for x in (matrix(p.column("embedding"), p.num_rows) for p in parts)}


# ---------------------------------------------------------------- near-duplicates


def axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Per vector length of the sample, the axes of most variance first. Any axes give the same links; good ones stop
    early. Lengths that the sample has none of keep their own axes."""
    out = {}
    for size, x in sampled(vectors, "node").items():
        u = unit(x)
        out[size] = np.linalg.eigh(u.T @ u)[1][:, ::-1]
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    x /= np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)  # squares of very small or large ones stay finite
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def turned(u: np.ndarray, basis: dict[int, np.ndarray]) -> np.ndarray:
    return u @ basis[u.shape[1]] if u.shape[1] in basis else u


PLACED = "label long, dim long, c0 long, c1 long, lead double, node long, size long, x binary"


def _placed(basis, reach: float):
    """Each vector with its cells along the two leading axes, as wide as links reach, and its third component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_length(whole, "embedding"):
                x = matrix(batch.column("embedding"), batch.num_rows)
                y = turned(unit(x), basis.value)
                y = np.pad(y, ((0, 0), (0, max(0, 3 - y.shape[1]))))
                cells = [pa.array(np.floor(y[:, i] / reach).astype(np.int64)) for i in (0, 1)]
                data = pa.array([r.tobytes() for r in np.ascontiguousarray(x.astype(float))], pa.binary())
                if x.dtype == np.float32:
                    data = pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())
                dim = pa.array(np.full(len(x), x.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label"), dim, *cells, pa.array(y[:, 2].copy()), batch.column("node"), batch.column("size"), data],
                    [c.split()[0] for c in PLACED.split(", ")],
                )

    return run


TILES = "block long, tile long, label long, dim long, lo array<double>, hi array<double>, node binary, size binary, x binary"


def floats(data: bytes, d: int) -> np.ndarray:
    """Vectors as they were stored, in single or double precision; told apart by their bytes in a tile's first row."""
    return np.frombuffer(data[1:], np.float32 if data[:1] == b"4" else np.float64).reshape(-1, d)


def _tiles(basis, limit: int, many: int):
    """Runs of at most limit vectors of one label in the order given; many tiles in a row are a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, number, block, base = [], None, 0, 0, TaskContext.get().partitionId() << 32
        started = None

        def close() -> pa.RecordBatch:
            nonlocal number, block, started
            if key != started or number % many == 0:
                block, number, started = block + 1, 0, key
            number += 1
            wide = len(held[0]["x"]) == 8 * key[1]
            data = (b"8" if wide else b"4") + b"".join(r["x"] for r in held)
            box = turned(unit(floats(data, key[1])), basis.value)[:, :BOX]
            pack = lambda c: pa.array([np.array([r[c] for r in held], np.int64).tobytes()], pa.binary())
            edge = lambda x: pa.array([x.tolist()], pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays(
                [pa.array([base + block]), pa.array([number]), pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), edge(box.min(0)), edge(box.max(0)), pack("node"), pack("size"), pa.array([data], pa.binary())],
                [c.split()[0] for c in TILES.split(", ")],
            )

        for batch in batches:
            for row in common.dicts(batch):
                if held and (len(held) == limit or key != (row["label"], row["dim"])):
                    yield close()
                    held = []
                key = (row["label"], row["dim"])
                held.append(row)
        if held:
            yield close()

    return run


def linked(ya: np.ndarray, yb: np.ndarray, ua: np.ndarray, ub: np.ndarray, least: float, upper: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with cosine >= least. Leading dimensions come first; what the rest can add is at most the product of the
    two suffix norms, and a pair, or the whole tile, is left as soon as that cannot reach least."""
    d = ya.shape[1]
    tails = [np.sqrt(np.cumsum((y * y)[:, ::-1], 1)[:, ::-1]) for y in (ya, yb)]
    total, i, j = np.zeros((len(ya), len(yb))), None, None
    alive = np.triu(np.ones(total.shape, bool), 1) if upper else np.ones(total.shape, bool)
    for lo in range(0, d, STEP):
        hi = min(d, lo + STEP)
        if i is None:
            total += ya[:, lo:hi] @ yb[:, lo:hi].T
            if hi < d:
                alive &= total + tails[0][:, hi, None] * tails[1][None, :, hi] >= least - 1e-9
                if alive.mean() < 0.05:
                    i, j = np.nonzero(alive)
                    total = total[i, j]
        else:
            total = total + np.einsum("ij,ij->i", ya[i, lo:hi], yb[j, lo:hi])
            rest = tails[0][i, hi] * tails[1][j, hi] if hi < d else 0.0
            keep = total + rest >= least - 1e-9
            i, j, total = i[keep], j[keep], total[keep]
        if i is not None and not len(i):
            return i, j
    if i is None:
        i, j = np.nonzero(alive & (total >= least - 1e-9))
        total = total[i, j]
    close = np.abs(total - least) < 1e-6
    total[close] = np.einsum("ij,ij->i", ua[i[close]], ub[j[close]])
    keep = total >= least
    return i[keep], j[keep]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least node each of n nodes is connected to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(least: float, reach: float, basis):
    """Of each pair of blocks, tiles of the first come first and are held; those of the second are met one by one. Per
    pair of tiles near enough: the links of each vector, counted with copies, and edges that connect what links do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, held = None, []
        for batch in batches:
            for r in common.dicts(batch, 16):
                if pair != r["pair"]:
                    pair, held = r["pair"], []
                u = unit(floats(r["x"], r["dim"]))
                y = turned(u, basis.value)
                mine = (np.frombuffer(r["node"], np.int64), np.frombuffer(r["size"], np.int64), u, y, y[:, :BOX].min(0), y[:, :BOX].max(0))
                if r["side"] == 0:
                    held.append(mine)
                if r["side"] == 0 and not r["alone"]:
                    continue
                for other in held:
                    gap = np.maximum(0, np.maximum(other[4] - mine[5], mine[4] - other[5]))
                    if (gap * gap).sum() > reach * reach:
                        continue
                    same = other is mine
                    i, j = linked(other[3], y, other[2], u, least, same)
                    if not len(i):
                        continue
                    node, size = (other[:2] if same else (np.concatenate([a, b]) for a, b in zip(other[:2], mine[:2], strict=True)))
                    j = j if same else j + len(other[0])
                    count = np.bincount(i, size[j], len(node)) + np.bincount(j, size[i], len(node))
                    root = _forest(len(node), i, j)
                    at = np.flatnonzero(count)
                    yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[root[at]]), pa.array(count[at].astype(np.int64))], ["a", "b", "n"])

    return run


def _block_pairs(tiles: DataFrame, reach: float) -> DataFrame:
    """(pair, a, b, alone): blocks of one label whose boxes on the leading axes are within reach, each with itself too."""
    ends = lambda c, f: F.array(*[f(F.get(F.col(c), i)) for i in range(BOX)])
    blocks = tiles.groupBy("block", "label", "dim").agg(ends("lo", F.min).alias("lo"), ends("hi", F.max).alias("hi"))
    cell = lambda c: F.floor(F.col(c)[0] / reach)
    x = blocks.withColumn("cell", F.explode(F.sequence(cell("lo") - 1, cell("hi") + 1))).alias("x")
    y = blocks.withColumn("cell", F.explode(F.sequence(cell("lo"), cell("hi")))).alias("y")
    gap = F.zip_with(F.arrays_zip("x.lo", "x.hi"), F.arrays_zip("y.lo", "y.hi"), lambda p, q: F.greatest(F.lit(0.0), p["lo"] - q["hi"], q["lo"] - p["hi"]))
    near = F.aggregate(gap, F.lit(0.0), lambda s, g: s + F.coalesce(g * g, F.lit(0.0))) <= reach * reach
    pairs = x.join(common.large(y), ["label", "dim", "cell"]).where(F.col("x.block") <= F.col("y.block")).where(near)
    pairs = pairs.select(F.col("x.block").alias("a"), F.col("y.block").alias("b")).distinct()
    return pairs.select(F.xxhash64("a", "b").alias("pair"), "a", "b", (F.col("a") == F.col("b")).alias("alone"))


def near_duplicates(
    vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tile: int = TILE, block: int = BLOCK
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row.

    Two rows link when their labels are equal and not null and the cosine of their vectors is at least `least`, in
    double precision. Rows with a null id or label, or whose vector is null, empty, zero, or holds a null or
    non-finite component, link with nothing; vectors of different length never link. Equal vectors of one label are a
    class, compared once and counted with its size; rows that share an id each count, and link as any others. component_id is the smallest id
    reachable, kept whether that is the row's own. Other columns are ignored; an empty table gives no rows.

    Vectors are ordered by cells of the two leading axes and by the third, and cut into tiles of at most `tile`
    vectors, `block` tiles to a block, however frequent a label is. Only blocks and tiles whose boxes on the leading
    axes are near enough meet. A task holds one block and streams the other, so that a vector moves once for each
    block its own may meet, not once for each tile.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("embedding"), F.col(f"`{label_col}`").cast("long").alias("label"))
    good = finite("embedding") & F.exists("embedding", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    classes = rows.where(good).groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"))
    classes = classes.withColumn("node", F.monotonically_increasing_id())
    classes = common.materialize(classes, "classes")
    basis = vectors.sparkSession.sparkContext.broadcast(axes(classes))
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-6
    placed = classes.mapInArrow(_placed(basis, reach), PLACED)
    order = ["label", "dim", "c0", "c1", "lead"]
    tiles = placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_tiles(basis, tile, block), TILES)
    tiles = common.materialize(tiles, "tiles")
    pairs = common.materialize(_block_pairs(tiles, reach), "pairs")
    slots = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    data = tiles.select("block", "tile", "dim", "node", "size", "x")
    first = pairs.select("pair", F.col("a").alias("block"), "alone", F.lit(0).alias("side"))
    second = pairs.where("not alone").select("pair", F.col("b").alias("block"), "alone", F.lit(1).alias("side"))
    met = data.join(common.large(first.union(second)), "block").repartition(min(3 * pairs.count() + 1, 8 * slots), "pair").sortWithinPartitions("pair", "side", "tile")
    found = common.materialize(met.mapInArrow(_compare(least, reach, basis), "a long, b long, n long"), "links")
    common.release(tiles, pairs)
    counts = common.materialize(found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links")), "counts")
    groups = common.materialize(components(found.select("a", "b")), "groups")
    firsts = groups.join(classes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("first"))
    groups = groups.join(common.materialize(firsts, "firsts"), "component").select("node", "first")
    named = classes.join(counts, "node", "left").join(groups, "node", "left").select(
        F.col("label").alias("l"), F.col("embedding").alias("e"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("first", "least").alias("component_id")
    )
    named = common.materialize(named, "named")
    common.release(classes, counts, found)
    out = rows.join(named, good & (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and kept vectors of all embeddings at a cosine of 0.93."""
    return near_duplicates(common.read(spark, sf_dir, "embeddings"), 0.93)


# ---------------------------------------------------------------- exact top-k


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), which doubles hold exactly."""
    return np.floor(x.astype(float) * scale)


PACKED = "block long, dim long, ids binary, x binary, bars binary"


def _packed(limit: int, scale: int, seeds=None, k: int = 0):
    """Blocks of at most limit vectors of one length: ids, and floor(scale * component). With seeds, a sample of the
    vectors by length, one for an id, also a lower bound of each query's k-th best score: the sample's next one, as one
    of the sample may be the query's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, base = 0, TaskContext.get().partitionId() << 32
        held: dict[int, list] = {}

        def close(dim: int) -> pa.RecordBatch:
            nonlocal number
            number += 1
            ids, parts = zip(*held.pop(dim), strict=True)
            x, bars = np.concatenate(parts), b""
            if seeds is not None:
                known = seeds.value.get(dim, np.zeros((0, dim)))
                bars = np.full(len(x), -np.inf)
                if len(known) > k and exact(x, known) is not object:
                    bars = -np.partition(-(x @ known.T), k, axis=1)[:, k]
                bars = bars.tobytes()
            data = x.astype(np.int16) if np.abs(x).max(initial=0) < 2**15 else x
            blob = (b"2" if data.dtype == np.int16 else b"8") + data.tobytes()
            columns = [pa.array([base + number]), pa.array([dim]), *(pa.array([b], pa.binary()) for b in (np.concatenate(ids).tobytes(), blob, bars))]
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PACKED.split(", ")])

        for batch_of_any in batches:
            for batch in by_length(batch_of_any, "embedding"):
                x = whole(matrix(batch.column("embedding"), batch.num_rows), scale)
                for at in range(0, len(x), limit):
                    dim = x.shape[1]
                    if sum(len(i) for i, _ in held.get(dim, [])) + len(x[at : at + limit]) > limit:
                        yield close(dim)
                    held.setdefault(dim, []).append((np.asarray(batch.column("vec_id"))[at : at + limit], x[at : at + limit]))
        for dim in list(held):
            yield close(dim)

    return run


def unpacked(blob: bytes, d: int) -> np.ndarray:
    return np.frombuffer(blob[1:], np.int16 if blob[:1] == b"2" else np.float64).reshape(-1, d).astype(float)


def exact(q: np.ndarray, x: np.ndarray):
    """The type whose sums of these products are exact: single or double precision, or Python's integers."""
    wide = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    return np.float32 if wide < 2**23 else np.float64 if wide < 2**52 else object


def typed(x: np.ndarray, kind) -> np.ndarray:
    return np.frompyfunc(int, 1, 1)(x) if kind is object else x.astype(kind)


class Shard:
    """Postings of some vectors: for each dimension, a term, the vectors with a component other than 0 and its value. A
    term that most vectors hold is kept as one value for each vector, in their order. lo and hi bound a term's values."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, kind) -> None:
        self.ids, self.x, self.kind = ids, typed(x, kind), kind
        self.lo, self.hi = x.min(0), x.max(0)
        full = (x != 0).mean(0) >= 0.25
        self.dense, self.where = np.flatnonzero(full), np.full(x.shape[1], -1)
        self.where[self.dense] = np.arange(len(self.dense))
        self.lists = np.ascontiguousarray(self.x[:, self.dense].T)
        self.sparse = {t: (at, self.x[at, t]) for t in np.flatnonzero(~full).tolist() for at in [np.flatnonzero(x[:, t])]}
        self.norms = np.sqrt((x * x).sum(1)) if kind is not object else None

    def traverse(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Sums of weight times value over the postings of the terms, per vector."""
        rows = self.where[terms]
        full = rows >= 0
        total = weights[full] @ self.lists[rows[full]] if full.any() else np.zeros(len(self.ids), self.kind)
        for t, w in zip(terms[~full].tolist(), weights[~full], strict=True):
            at, values = self.sparse[t]
            total[at] += w * values
        return total


def max_score(shard: Shard, own: int, q: np.ndarray, bar: float, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Ids and scores that hold the k best of the shard for one query whose own id is left out, as far as they reach
    bar, a score that k vectors are known to reach; and the bar, raised.

    Each term's bound is the most that its weight and the shard's values can give. Terms in ascending order of bound
    are non-essential as long as together they stay below the bar, by the sum of their bounds or by the product of
    norms: vectors cannot reach it by them alone. If no term is essential the shard is left. Else the postings of the
    essential terms are traversed; the best of them are scored in full, which raises the bar; and the non-essential
    terms are probed, those of greatest bound first, for the vectors that can still reach it.
    """
    w = typed(q, shard.kind)
    bound = np.maximum(q * shard.lo, q * shard.hi)
    order = np.argsort(bound, kind="stable")
    sums = np.cumsum(bound[order])
    norms = shard.norms
    if norms is not None:
        weight = np.sqrt(np.cumsum(q[order] ** 2))
        sums = np.minimum(sums, weight * float(norms.max(initial=0)) * (1 + 1e-6) + 1)
    else:  # integers beyond doubles: all terms are essential
        bar = -np.inf
    cut = int(np.argmax(sums >= bar)) if (sums >= bar).any() or norms is None else len(order)
    empty = np.zeros(0, np.int64)
    if cut == len(order):
        return empty, np.zeros(0, shard.kind), bar
    score = shard.traverse(order[cut:], w[order[cut:]])
    at = np.flatnonzero(shard.ids != own)
    score = score[at]
    rest = order[:cut][::-1]
    if len(at) > k and len(rest):
        best = at[np.argpartition(-score, k)[:k]]
        bar = max(bar, float((shard.x[best] @ w).min()))
    for lo in range(0, len(rest), PROBE):
        more = float(sums[cut - lo - 1])  # of the terms not probed yet
        alive = score + np.minimum(more, weight[cut - lo - 1] * norms[at] * (1 + 1e-6) + 1) >= bar
        at, score = at[alive], score[alive]
        terms = rest[lo : lo + PROBE]
        score = score + shard.x[np.ix_(at, terms)] @ w[terms]
    reach = score >= bar
    at, score = at[reach], score[reach]
    top = np.lexsort((shard.ids[at], -score))[:k]
    if len(top) == k:
        bar = max(bar, float(score[top[-1]]))
    return shard.ids[at[top]], score[top], bar


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard, bars = None, None, {}
        for batch in batches:
            for r in common.dicts(batch, 8):
                ids, q = np.frombuffer(r["qids"], np.int64), unpacked(r["q"], r["dim"])
                x = unpacked(r["x"], r["dim"]) if held is None or held[0] != r["block"] else held[1]
                kind = exact(q, x)
                if held is None or held[0] != r["block"] or shard.kind is not kind:
                    held, shard = (r["block"], x), Shard(np.frombuffer(r["ids"], np.int64), x, kind)
                if len(bars) == 1024:  # thresholds of blocks met in this task save time only
                    bars.clear()
                known = bars.setdefault(r["asked"], np.frombuffer(r["bars"], float).copy())
                out = ([], [], [])
                for i, own in enumerate(ids.tolist()):
                    found, score, known[i] = max_score(shard, own, q[i], known[i], k)
                    for column, value in zip(out, (np.full(len(found), own), found, score), strict=True):
                        column.append(value)
                score = np.concatenate(out[2])
                if len(score) and not -(2**63) <= min(score) <= max(score) < 2**63:
                    raise OverflowError("a score is beyond 64 bits")
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out[:2]] + [pa.array(score.astype(np.int64))], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best integer inner products of each query with all other rows.

    Components are floor(scale * x), x as double. Ties go to the smaller id. Rows with a null id, or a vector that is
    null, empty, or holds a null or non-finite component, take no part; vectors of different length do not meet. Of
    query rows that share an id one is asked, that of the least vector; candidates with the query's id are its own. A
    query with fewer candidates has fewer rows. A score beyond 64 bits raises an error. Other columns are ignored; an
    empty table gives no rows.

    Vectors are cut into shards, queries into blocks. Each block is sent to as many slots as there are shuffle
    partitions, where it meets the shards dealt there; each meeting gives at most k rows a query, and those are ranked.
    """
    spark = vectors.sparkSession
    rows = vectors.where(finite("embedding") & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), "embedding", is_query.alias("asks"))
    shards = common.materialize(rows.select("vec_id", "embedding").mapInArrow(_packed(shard, scale), PACKED), "shards")
    seeds = spark.sparkContext.broadcast({d: whole(x, scale) for d, x in sampled(rows.select("vec_id", "embedding"), "vec_id").items()})
    asked = rows.where("asks").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks = common.materialize(asked.mapInArrow(_packed(block, scale, seeds, k), PACKED), "queries")
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    copies = blocks.select("dim", F.col("block").alias("asked"), F.col("ids").alias("qids"), F.col("x").alias("q"), "bars", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    dealt = shards.drop("bars").withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int"))
    met = dealt.join(common.large(copies), ["slot", "dim"])
    found = met.select("dim", "block", "ids", "x", "asked", "qids", "q", "bars").mapInArrow(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all embeddings for every fiftieth."""
    return top_k(common.read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))
), u AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0
  WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.93),
r AS (SELECT DISTINCT a AS node, a AS seen FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a),
c AS (SELECT node, min(seen) AS least FROM r GROUP BY node), n AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, coalesce(least, vec_id) AS component_id, coalesce(least, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON vec_id = node LEFT JOIN n ON vec_id = a
"""

OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
"""
