"""Operator 7: approximate nearest neighbours with vantage-point trees, one a shard.

Every vector belongs to the cell of its nearest pivot; pivots are a bounded sample of the vectors. A cell of more than ``shard_rows``
vectors is dealt over several shards by a hash of the id. Each shard is a vantage-point tree: a node's point splits its vectors at the median
distance into near and far. A search keeps its k best and enters a half or a cell only if the triangle inequality
allows a better one there: a lower bound on the distance must be at most ``factor`` times the k-th best distance. Factor 1
is exact; smaller factors prune more and may miss neighbours.

A query first visits the cell of its nearest pivot, which gives its k-th best distance; then it visits the cells that the
bounds leave open. A cell's bounds come from its radius, and from the plane between its pivot and the query's nearest. Queries
travel in blocks, so that a block's queries go down a tree together, in numpy; blocks and trees meet in a join on the shard.

Without a given factor, the index is asked about a bounded sample of its vectors: the smallest factor of FACTORS that misses none of
their k nearest in the sample, made a half larger.

Defined results: rows with a null id, and vectors that are null, empty, zero or hold null or non-finite components, take
no part, as queries or candidates; rows that repeat an id and vector count once; of candidates with a query's own id none
is returned; vectors of another length than a query's are never its neighbours; without candidates a query has no row.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentria.runtime import materialize, read_table, release, ship

K = 10
LEAF = 64
SHARD_ROWS = 8192
BLOCK_ROWS = 1024
#: Rows a cell should have, and the most pivots of one vector length: the routing table that every task holds.
CELL_ROWS, MOST_PIVOTS = 2048, 1024
#: Vectors that pivots and the factor are chosen from, and how many of them are asked.
SAMPLE, ASKED = 2048, 128
FACTORS = (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6)
Found = tuple[np.ndarray, np.ndarray]


class VantageTree:
    """Vectors (double precision) and ids, with nodes as (start, end, vantage point, radius, near, far)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, nodes: np.ndarray, radii: np.ndarray) -> None:
        self.ids, self.vectors, self.nodes, self.radii = ids, vectors, nodes, radii

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> VantageTree:
        order = np.arange(len(ids))
        nodes: list[list[int]] = []
        radii: list[float] = []

        def grow(begin: int, end: int) -> int:
            me = len(nodes)
            nodes.append([begin, end, -1, -1])
            radii.append(0.0)
            if end - begin > leaf:
                # the point farthest from the part's first one spreads distances well, and is the same on every retry
                part = order[begin:end]
                far = int(np.linalg.norm(vectors[part] - vectors[part[0]], axis=1).argmax())
                part[[0, far]] = part[[far, 0]]
                d = np.linalg.norm(vectors[part[1:]] - vectors[part[0]], axis=1)
                middle = len(d) // 2
                by = np.argpartition(d, middle)
                if d.min() < d.max():
                    part[1:] = part[1:][by]
                    radii[me] = float(d[by[middle]])
                    nodes[me][2] = grow(begin + 1, begin + 1 + middle)
                    nodes[me][3] = grow(begin + 1 + middle, end)
            return me

        if len(ids):
            grow(0, len(ids))
        return cls(ids[order], vectors[order], np.array(nodes, dtype=np.int64).reshape(-1, 4), np.array(radii))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float, kth: np.ndarray | None = None) -> Found:
        """Distances and ids of each query's k nearest, ties to smaller ids; ``own`` ids are left out.

        ``kth`` are distances that the queries know k candidates within. ``scored`` counts the distances computed.
        """
        limit = np.full(len(queries), np.inf) if kth is None or not len(kth) else kth
        across = np.ascontiguousarray(self.vectors.T)
        self.scored = 0
        best = np.full((len(queries), k), np.inf)
        who = np.full((len(queries), k), np.iinfo(np.int64).max)

        def offer(rows: np.ndarray, begin: int, end: int) -> None:
            # components lie in the outer axis, so squares are added one after another, as a plain loop would
            self.scored += len(rows) * (end - begin)
            v = across[:, begin:end]
            d = np.empty((len(rows), end - begin))
            for at in range(0, len(rows), 64):
                diff = v[None, :, :] - queries[rows[at : at + 64]][:, :, None]
                np.sqrt((diff * diff).sum(axis=1), out=d[at : at + 64])
            names = np.broadcast_to(self.ids[begin:end], d.shape)
            d = np.where(names == own[rows][:, None], np.inf, d)
            alld = np.concatenate([best[rows], d], axis=1)
            alln = np.concatenate([who[rows], np.where(np.isinf(d), np.iinfo(np.int64).max, names)], axis=1)
            order = np.lexsort((alln, alld), axis=1)[:, :k]
            best[rows] = np.take_along_axis(alld, order, axis=1)
            who[rows] = np.take_along_axis(alln, order, axis=1)

        def descend(node: int, rows: np.ndarray) -> None:
            if not len(rows):
                return
            begin, end, near, far = self.nodes[node]
            if near < 0:
                offer(rows, begin, end)
                return
            offer(rows, begin, begin + 1)
            gap = np.sqrt(((queries[rows] - self.vectors[begin]) ** 2).sum(axis=1)) - self.radii[node]
            inner = gap < 0
            descend(near, rows[inner])
            descend(far, rows[~inner])
            # the other half can only hold points at least |gap| away
            worth = np.abs(gap) <= factor * np.minimum(best[rows, -1], limit[rows]) * (1 + 1e-12) + 1e-12
            descend(far, rows[inner & worth])
            descend(near, rows[~inner & worth])

        if len(self.ids):
            descend(0, np.arange(len(queries)))
        return best, who

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, vectors=self.vectors.astype(np.float32) if (self.vectors.astype(np.float32) == self.vectors).all() else self.vectors, nodes=self.nodes, radii=self.radii)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> VantageTree:
        x = np.load(io.BytesIO(raw))
        return cls(x["ids"], x["vectors"].astype(np.float64), x["nodes"], x["radii"])


def _usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    v = F.col(vector_column).cast("array<double>")
    plain = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return plain.where(finite).where(F.exists("v", lambda x: x != 0))


def _chunks(batches, most: int):
    """Ids and vectors of a partition by vector length, at most ``most`` at a time, repeated rows once a chunk."""
    waiting: dict[int, dict] = {}
    for batch in batches:
        offsets = batch.column(1).offsets.to_numpy()
        flat = batch.column(1).values.to_numpy(zero_copy_only=False)
        for i, key in enumerate(batch.column(0).to_pylist()):
            v = flat[offsets[i] : offsets[i + 1]]
            held = waiting.setdefault(len(v), {})
            held[key, v.tobytes()] = v.copy()
            if len(held) >= most:
                yield waiting.pop(len(v))
    yield from (x for x in waiting.values() if x)


def _arrays(chunk: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.array([k for k, _ in chunk], dtype=np.int64), np.array(list(chunk.values()), dtype=np.float64)


@dataclass(frozen=True)
class Index:
    """``shards(dim, cell, sub, tree)``, and by vector length the pivots, the cells' radii and their numbers of shards."""

    shards: DataFrame
    cells: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    factor: float


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """From each row of a to each of b."""
    return np.stack([np.linalg.norm(b - x, axis=1) for x in a]) if len(a) else np.zeros((0, len(b)))


def tuned_factor(ids: np.ndarray, vectors: np.ndarray, k: int = K) -> float:
    """The smallest factor that loses none of the sample's neighbours, with a margin."""
    if len(ids) <= k:
        return 1.0
    tree = VantageTree.build(ids, vectors)
    asked = np.linspace(0, len(ids) - 1, min(ASKED, len(ids))).astype(int)
    exact = tree.search(vectors[asked], ids[asked], k, 1.0)[0]
    for factor in FACTORS:
        if (tree.search(vectors[asked], ids[asked], k, factor)[0] == exact).all():
            return min(1.0, 1.5 * factor)
    return 1.0


def build_index(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", shard_rows: int = SHARD_ROWS, cell_rows: int = CELL_ROWS, factor: float | None = None) -> Index:
    """An index over every usable vector. A shard holds about ``shard_rows`` at most, however many vectors a cell has."""
    spark = vectors.sparkSession
    ship(spark)
    usable = _usable(vectors, id_column, vector_column)
    sizes = {r[0]: r[1] for r in usable.groupBy(F.size("v").alias("dim")).count().collect()}
    pivots: dict[int, np.ndarray] = {}
    tuned, largest = 1.0, max(sizes, key=sizes.get, default=None)
    for dim, n in sizes.items():
        most = min(SAMPLE, n) if dim == largest else min(MOST_PIVOTS, max(1, n // cell_rows))
        rows = usable.where(F.size("v") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).collect()
        sample = np.array([r["v"] for r in rows], dtype=np.float64)
        pivots[dim] = np.unique(sample[: min(MOST_PIVOTS, max(1, n // cell_rows))], axis=0)
        if dim == largest:
            tuned = tuned_factor(np.array([r["vec_id"] for r in rows], dtype=np.int64), sample)
    sent = spark.sparkContext.broadcast(pivots)

    def assign(batches):
        import pyarrow as pa

        for batch in batches:
            keys, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cells, away = [], []
            for v in lists:
                d = np.linalg.norm(sent.value[len(v)] - np.array(v), axis=1)
                cells.append(int(d.argmin()))
                away.append(float(d.min()))
            yield pa.RecordBatch.from_pydict({"vec_id": pa.array(keys, pa.int64()), "v": batch.column(1), "dim": pa.array([len(v) for v in lists], pa.int32()), "cell": pa.array(cells, pa.int32()), "away": pa.array(away, pa.float64())})

    dealt = materialize(usable.mapInArrow(assign, "vec_id long, v array<double>, dim int, cell int, away double"), "vector-cells")
    counted = dealt.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()  # a row a pivot
    cells = {dim: (p, np.full(len(p), -1.0), np.zeros(len(p), dtype=np.int64)) for dim, p in pivots.items()}
    for r in counted:
        cells[r["dim"]][1][r["cell"]] = r["radius"]
        cells[r["dim"]][2][r["cell"]] = -(-r["n"] // shard_rows)
    split = spark.createDataFrame([(r["dim"], r["cell"], -(-r["n"] // shard_rows)) for r in counted], "dim int, cell int, n_sub long")
    keyed = dealt.join(F.broadcast(split), ["dim", "cell"]).withColumn("sub", F.pmod(F.xxhash64("vec_id"), "n_sub").cast("int"))
    keyed = keyed.repartition("dim", "cell", "sub").sortWithinPartitions("dim", "cell", "sub").select("dim", "cell", "sub", "vec_id", "v")

    def build(batches):
        import pyarrow as pa

        def tree(key, held):
            ids, v = _arrays(held)
            return pa.RecordBatch.from_pydict({"dim": pa.array([key[0]], pa.int32()), "cell": pa.array([key[1]], pa.int32()), "sub": pa.array([key[2]], pa.int32()), "tree": pa.array([VantageTree.build(ids, v).to_bytes()], pa.binary())})

        last, held = None, {}
        for batch in batches:
            for *key, name, v in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if last is not None and key != last:
                    yield tree(last, held)
                    held = {}
                last = key
                v = np.array(v)
                held[name, v.tobytes()] = v
        if held:
            yield tree(last, held)

    shards = materialize(keyed.mapInArrow(build, "dim int, cell int, sub int, tree binary"), "vector-index")
    release(dealt)
    return Index(shards, cells, tuned if factor is None else factor)


def open_cells(queries: np.ndarray, pivots: np.ndarray, radii: np.ndarray, kth: np.ndarray, factor: float) -> np.ndarray:
    """Which cells may hold a vector nearer than the k-th best so far, by query and cell; the query's own cell is not among them."""
    d = _distances(queries, pivots)
    nearest = d.argmin(axis=1)
    plane = (d - d.min(axis=1, keepdims=True)) / 2
    bound = np.maximum(np.maximum(d - radii[None, :], plane), 0)
    out = (bound <= factor * kth[:, None] * (1 + 1e-12) + 1e-12) & (radii >= 0)[None, :]
    out[np.arange(len(queries)), nearest] = False
    return out


def search(index: Index, queries: DataFrame, k: int = K, factor: float | None = None, id_column: str = "vec_id", vector_column: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the k nearest found of each query."""
    spark = queries.sparkSession
    ship(spark)
    factor = index.factor if factor is None else factor
    cells = spark.sparkContext.broadcast(index.cells)
    schema = "dim int, cell int, sub int, queries binary"

    def emit(dim, chosen, ids, v, kth):
        """A row a shard: the block of queries that visit it, with what they have."""
        import pyarrow as pa

        for cell in np.flatnonzero(chosen.any(axis=0)).tolist():
            rows = np.flatnonzero(chosen[:, cell])
            raw = VantageTree(ids[rows], v[rows], np.zeros((0, 4), dtype=np.int64), kth[rows]).to_bytes()
            subs = int(cells.value[dim][2][cell])
            yield pa.RecordBatch.from_pydict({"dim": pa.array([dim] * subs, pa.int32()), "cell": pa.array([cell] * subs, pa.int32()), "sub": pa.array(range(subs), pa.int32()), "queries": pa.array([raw] * subs, pa.binary())})

    def first(batches):
        for chunk in _chunks(batches, block_rows):
            ids, v = _arrays(chunk)
            dim = v.shape[1]
            if dim in cells.value:
                pivots, radii, _ = cells.value[dim]
                chosen = np.zeros((len(v), len(pivots)), dtype=bool)
                chosen[np.arange(len(v)), np.where(radii[None, :] >= 0, _distances(v, pivots), np.inf).argmin(axis=1)] = True
                yield from emit(dim, chosen, ids, v, np.full(len(v), np.inf))

    def rest(batches):
        for chunk in _chunks(batches, block_rows):
            ids, v = _arrays(chunk)
            # the k-th best distance travels as the last component
            dim = v.shape[1] - 1
            pivots, radii, _ = cells.value[dim]
            yield from emit(dim, open_cells(v[:, :dim], pivots, radii, v[:, dim], factor), ids, v[:, :dim], v[:, dim])

    def visit(batches):
        import pyarrow as pa

        for batch in batches:
            for tree, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard, asked = VantageTree.from_bytes(tree), VantageTree.from_bytes(block)
                d, who = shard.search(asked.vectors, asked.ids, k, factor, asked.radii)
                there = np.isfinite(d)
                rows = np.nonzero(there)[0]
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(asked.ids[rows]), "vec_id": pa.array(who[there]), "score": pa.array(d[there])})

    def visited(blocks: DataFrame) -> DataFrame:
        met = index.shards.join(blocks, ["dim", "cell", "sub"]).select("tree", "queries")
        return met.mapInArrow(visit, "query_id long, vec_id long, score double")

    usable = _usable(queries, id_column, vector_column)
    near = materialize(visited(usable.mapInArrow(first, schema)), "near")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = near.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    bounded = usable.join(best, "vec_id", "left").select("vec_id", F.concat("v", F.array(F.coalesce("kth", F.lit(float("inf"))))).alias("v"))
    found = near.union(visited(bounded.mapInArrow(rest, schema)))
    ranked = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return search(build_index(vectors), vectors.where("vec_id % 100 = 0"))


SQL = """
WITH v AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda x, y: x + y)) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p) WHERE rank <= 10
"""
