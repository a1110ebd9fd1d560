"""Approximate nearest neighbours by cosine, with a forest of random-projection trees."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

TREES = 8
#: The trees are fitted on about so many vectors, chosen by a hash of vec_id.
SAMPLE = 1 << 16
#: Rows of a leaf, as far as the sample allows splits so fine; it keeps LEAST of its own in each.
LEAF_ROWS, LEAST = 48, 8
#: A query visits leaves of EFFORT * rows ^ POWER rows, over all trees. Measured recall: README.
EFFORT, POWER = 12.0, 0.75
#: Rows, and queries, that one task holds at a time.
BLOCK_ROWS, BLOCK_QUERIES = 8_192, 8_192
#: Random directions tried for a split; the one along which the sample spreads most is taken.
DIRECTIONS = 8


class Forest:
    """Complete binary trees of one depth: a direction and an offset for each inner node."""

    def __init__(self, normals: np.ndarray, offsets: np.ndarray) -> None:
        self.normals, self.offsets = normals, offsets
        self.depth = int(offsets.shape[1] + 1).bit_length() - 1

    @classmethod
    def fit(cls, sample: np.ndarray, rows: int, trees: int = TREES, seed: int = 7) -> Forest:
        """Split unit vectors at the median of their projection on a random direction, again and again."""
        rng = np.random.default_rng(seed)
        sample = np.unique(sample, axis=0)
        depth = max(1, min(int(math.log2(max(2, rows / LEAF_ROWS))), int(math.log2(max(2, len(sample) / LEAST)))))
        nodes = (1 << depth) - 1
        normals = rng.standard_normal((trees, nodes, sample.shape[1]))
        offsets = np.zeros((trees, nodes))
        for tree in range(trees):
            members = {0: np.arange(len(sample))}
            for node in range(nodes):
                own = members.pop(node, np.zeros(0, dtype=np.int64))
                best, side = -1.0, np.zeros(len(own), dtype=bool)
                for _ in range(DIRECTIONS if len(own) > 1 else 0):
                    a, b = sample[rng.choice(own, 2, replace=False)]
                    normal = (a - b) / max(float(np.linalg.norm(a - b)), 1e-12)
                    along = sample[own] @ normal
                    if along.std() > best:
                        best = along.std()
                        normals[tree, node], offsets[tree, node] = normal, np.median(along)
                        side = along > offsets[tree, node]
                members[2 * node + 1], members[2 * node + 2] = own[~side], own[side]
        normals /= np.linalg.norm(normals, axis=2, keepdims=True)
        return cls(normals.astype(np.float32), offsets.astype(np.float32))

    def route(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of every vector in every tree."""
        trees = len(self.offsets)
        leaves = np.empty((len(vectors), trees), dtype=np.int32)
        for tree in range(trees):
            node = np.zeros(len(vectors), dtype=np.int64)
            for _ in range(self.depth):
                along = np.einsum("ij,ij->i", vectors, self.normals[tree, node])
                node = 2 * node + 1 + (along > self.offsets[tree, node])
            leaves[:, tree] = node - self.offsets.shape[1]
        return leaves

    def search(self, vector: np.ndarray, most: int) -> list[tuple[int, int]]:
        """The first `most` (tree, leaf) that one priority queue shared by all trees gives out.

        A node's priority is the smallest distance by which the query lies on its side of the splits
        above it, negative where it lies on the other side.
        """
        margins = self.normals @ vector - self.offsets
        inner = margins.shape[1]
        queue = [(-math.inf, tree, 0) for tree in range(len(margins))]
        heapq.heapify(queue)
        found: list[tuple[int, int]] = []
        while queue and len(found) < most:
            rank, tree, node = heapq.heappop(queue)
            while node < inner:
                margin = float(margins[tree, node])
                near, far = (2 * node + 2, 2 * node + 1) if margin > 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (max(rank, abs(margin)), tree, far))
                rank, node = max(rank, -abs(margin)), near
            found.append((tree, node - inner))
        return found


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, dim)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]).astype(np.float32)


def _packed(dim: int):
    """Arrays of numbers as rows of little-endian doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype("<f8")
            rows = [x.tobytes() for x in flat.reshape(-1, dim)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(rows, pa.binary())], names=["vec_id", "vector"])

    return run


def _index(forest: Forest, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                leaves = forest.route(_unit(_matrix(part.column("vector"), dim)))
                for tree in range(leaves.shape[1]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(leaves), tree, np.int32)), pa.array(leaves[:, tree]),
                         part.column("vec_id"), part.column("vector")],
                        names=["tree", "leaf", "vec_id", "vector"],
                    )

    return run


def _visits(forest: Forest, dim: int, most: int, shift: int):
    """(tree, shard, leaves, query_id, vector): the leaves each query visits, together by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                shards: dict[tuple[int, int], list[int]] = {}
                for tree, leaf in forest.search(_unit(_matrix(one.column("vector"), dim))[0], most):
                    shards.setdefault((tree, leaf >> shift), []).append(leaf)
                n = len(shards)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t for t, _ in shards], pa.int32()), pa.array([s for _, s in shards], pa.int32()),
                     pa.array(list(shards.values()), pa.list_(pa.int32())),
                     pa.array([one.column("vec_id")[0].as_py()] * n, pa.int64()),
                     pa.array([one.column("vector")[0].as_py()] * n, pa.binary())],
                    names=["tree", "shard", "leaves", "query_id", "vector"],
                )

    return run


def _rerank(dim: int, k: int):
    """Exact scores of the rows in the leaves that each query visits; its k best of this block."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return schema.empty_table()
        rows = rows.sort_by([("leaf", "ascending"), ("vec_id", "ascending")])
        leaf = rows.column("leaf").to_numpy()
        ids, vectors = rows.column("vec_id").to_numpy(), _matrix(rows.column("vector"), dim)
        asked, wanted = queries.column("query_id").to_numpy(), queries.column("leaves").to_pylist()
        points = _matrix(queries.column("vector"), dim)
        size = np.sqrt((vectors * vectors).sum(axis=1))
        rough = vectors / size[:, None]
        names, starts = np.unique(leaf, return_index=True)
        places = dict(zip(names.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(leaf)])))
        more = k + len(ids) - len(np.unique(ids))  # repeated ids must not crowd out others
        out = []
        for query, point, leaves in zip(asked, points, wanted):
            spans = [places[x] for x in leaves if x in places]
            at = np.concatenate([np.arange(a, b) for a, b in spans]) if spans else np.zeros(0, np.int64)
            at = at[ids[at] != query]
            if not len(at):
                continue
            near = rough[at] @ point
            if len(at) > more:
                least = np.partition(near, len(near) - more)[len(near) - more]
                at = at[near >= least - 1e-9 * float(np.sqrt(point @ point))]
            # Row by row, so that equal vectors have equal scores wherever they lie.
            score = (vectors[at] * point).sum(axis=1) / (size[at] * np.sqrt((point * point).sum()))
            order = np.lexsort((ids[at], -score))
            best = order[np.sort(np.unique(ids[at][order], return_index=True)[1])[:k]]
            out.append((np.full(len(best), query), ids[at][best], score[best]))
        if not out:
            return schema.empty_table()
        return pa.table([np.concatenate(c) for c in zip(*out)], schema=schema)

    return run


def _valid(vector: Column) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & whole & F.exists(vector, lambda x: x != 0)


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = 5,
    trees: int = TREES,
    effort: float = EFFORT,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where `queries` holds, its k nearest others.

    `vectors` has (vec_id, embedding). Nearest is the largest cosine, computed in double precision
    from the original vectors; ties go to the smaller vec_id. All rows are indexed in a forest of
    random-projection trees fitted on about SAMPLE of them. A query visits leaves in the order of one
    priority queue shared by all trees, of EFFORT * rows ^ POWER rows in all, and everything found
    there is ranked exactly; with fewer rows than k, or leaves few enough, that is every row.

    Leaves are gathered in shards, which are cut into blocks by rows and by queries from their
    counted sizes, so a vector shared by a third of all rows fills many blocks, not one task.

    Rows with a null vec_id or a vector that is null, empty, zero, or holds null or non-finite
    numbers take no part, neither do vectors of another than the most frequent length (the longer of
    equals). Rows that share a vec_id are one candidate with its best score; a query never finds its
    own vec_id, and asks once for each of its distinct vectors, the best of which count. Other
    columns are not read. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    own = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"),
        F.coalesce(queries, F.lit(False)).alias("asks"),
    ).where(F.col("vec_id").isNotNull() & _valid(F.col("vector")))
    common = own.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    dim, total = common.dim, common.n
    own = own.where(F.size("vector") == dim)
    share = max(1, math.ceil(SAMPLE / total * (1 << 20)))
    packed = own.select("vec_id", "vector").mapInArrow(_packed(dim), "vec_id long, vector binary")
    sample = packed.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < share).collect() or packed.limit(LEAST).collect()
    drawn = np.frombuffer(b"".join(bytes(r.vector) for r in sample)).reshape(-1, dim)
    forest = Forest.fit(_unit(drawn).astype(np.float64), total, trees)
    leaf_rows = total / (1 << forest.depth)
    most = math.ceil(effort * total**POWER / leaf_rows)
    shift = max(0, int(math.log2(max(1.0, BLOCK_ROWS / 2 / leaf_rows))))

    asking = own.where("asks").select("vec_id", "vector").mapInArrow(_packed(dim), "vec_id long, vector binary")
    index = scratch.keep(
        packed.mapInArrow(_index(forest, dim), "tree int, leaf int, vec_id long, vector binary"), "index"
    ).withColumn("shard", F.shiftright("leaf", shift))
    visits = scratch.keep(
        asking.mapInArrow(
            _visits(forest, dim, most, shift),
            "tree int, shard int, leaves array<int>, query_id long, vector binary",
        ),
        "visits",
    )
    # At most a row per leaf of the forest, whose size is bounded by SAMPLE.
    plan = F.broadcast(
        index.groupBy("tree", "shard").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("row_blocks"))
        .join(
            visits.groupBy("tree", "shard").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("query_blocks")),
            ["tree", "shard"],
        )
    )

    def block(id_column: str, of: str) -> Column:
        return F.pmod(F.xxhash64(id_column), F.col(of)).cast("int")

    rows = index.join(plan, ["tree", "shard"]).select(
        "tree", "shard", block("vec_id", "row_blocks").alias("row_block"),
        F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("query_block"), "leaf", "vec_id", "vector",
    )
    wanted = visits.join(plan, ["tree", "shard"]).select(
        "tree", "shard", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)).alias("row_block"),
        block("query_id", "query_blocks").alias("query_block"), "leaves", "query_id", "vector",
    )
    keys = ["tree", "shard", "row_block", "query_block"]
    found = (
        rows.groupBy(*keys).cogroup(wanted.groupBy(*keys))
        .applyInArrow(_rerank(dim, k), "query_id long, vec_id long, score double")
        .groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
