"""Nearest neighbours by inner product from a hierarchical k-means tree.

The tree is fitted on a bounded sample; every vector is then filed in a leaf.  A
query walks the tree best bin first: a priority queue holds the open nodes by
an estimate of the largest inner product below them, and leaves are visited in
that order.  How many are visited is calibrated: visits widen until sample
queries, searched by brute force over all vectors, reach the wanted recall.
Leaves that are neighbours in the tree share a cell, to which a query is sent once;
there it meets the vectors of the leaves that it visits, and no others.

Equal vectors are one point of the search.  A point keeps its k + 1 smallest
ids, which is all that a list of k can need, so a vector that very many rows
share costs what a rare one does.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import store

#: Vectors that the tree is fitted on at most, taken by hash of their values.
FIT_ROWS = 20_000
#: Queries that the visits are calibrated on at most.
CALIBRATION_ROWS = 256
BRANCHES = 8
#: Vectors of the fitting sample below which a node is a leaf.
LEAF_ROWS = 48
#: Vectors and queries that one comparison has, about.
BLOCK_ROWS = 8192
QUERY_ROWS = 4096


@dataclass
class Tree:
    """Nodes in an array: centres, spreads, and the children of each (none: a leaf)."""

    centres: np.ndarray
    spread: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray  # number of the leaf, or -1

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: nearest child after nearest child."""
        at = np.zeros(len(x), np.int64)
        open_ = np.arange(len(x))
        while len(open_):
            nxt = []
            for node in np.unique(at[open_]):
                rows = open_[at[open_] == node]
                kids = self.children[node]
                if not kids:
                    continue
                c = self.centres[kids]
                d = (c * c).sum(1)[None, :] - 2 * x[rows] @ c.T
                at[rows] = np.array(kids)[d.argmin(1)]
                nxt.append(rows)
            open_ = np.concatenate(nxt) if nxt else open_[:0]
        return self.leaf[at]

    def walk(self, q: np.ndarray, visits: int) -> list[np.ndarray]:
        """For each query the first ``visits`` leaves, best bin first."""
        gain = q @ self.centres.T + np.linalg.norm(q, axis=1)[:, None] * self.spread[None, :]
        out = []
        for row in gain:
            heap, found = [(-row[0], 0)], []
            while heap and len(found) < visits:
                _, node = heapq.heappop(heap)
                if self.children[node]:
                    for kid in self.children[node]:
                        heapq.heappush(heap, (-row[kid], kid))
                else:
                    found.append(self.leaf[node])
            out.append(np.array(found, np.int64))
        return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Cluster of each row; seeded by distance."""
    centres = [x[rng.integers(len(x))]]
    d = ((x - centres[0]) ** 2).sum(1)
    for _ in range(1, k):
        if d.sum() <= 0:
            break
        centres.append(x[rng.choice(len(x), p=d / d.sum())])
        d = np.minimum(d, ((x - centres[-1]) ** 2).sum(1))
    c = np.array(centres)
    for _ in range(rounds):
        own = ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
        count = np.bincount(own, minlength=len(c))
        new = np.zeros_like(c)
        np.add.at(new, own, x)
        c = np.where(count[:, None] > 0, new / np.maximum(count, 1)[:, None], c)
    return ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)


def fit_tree(x: np.ndarray, branches: int = BRANCHES, leaf_rows: int = LEAF_ROWS, seed: int = 5) -> Tree:
    rng = np.random.default_rng(seed)
    centres, spread, children, leaf = [], [], [], []
    todo: list[tuple[np.ndarray, int]] = [(np.arange(len(x)), -1)]
    leaves = 0
    while todo:
        rows, parent = todo.pop()
        node = len(centres)
        c = x[rows].mean(0)
        centres.append(c)
        spread.append(float(np.sqrt(((x[rows] - c) ** 2).sum(1).mean() / x.shape[1])))
        children.append([])
        if parent >= 0:
            children[parent].append(node)
        own = _kmeans(x[rows], branches, rng) if len(rows) > leaf_rows else np.zeros(len(rows), int)
        parts = [rows[own == i] for i in np.unique(own)]
        if len(parts) > 1:
            leaf.append(-1)
            todo += [(p, node) for p in reversed(parts)]
        else:
            leaf.append(leaves)
            leaves += 1
    return Tree(np.array(centres), np.array(spread), children, np.array(leaf))


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """Columns of the k largest of each row, ties to the smaller id; none of -inf."""
    k = min(k, scores.shape[1])
    cut = np.partition(scores, -k, axis=1)[:, -k:].min(axis=1, keepdims=True)
    out = []
    for r, c in zip(scores, cut, strict=True):
        at = np.flatnonzero((r >= c) & (r > -np.inf))
        out.append(at[np.lexsort((ids[at], -r[at]))[:k]])
    return out


def _usable(vector: str) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda v: v != 0)


_OUT = "query_id long, rank int, vec_id long, score double"


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", fit_rows: int = FIT_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its ``k`` nearest others, as found.

    ``is_query`` is a condition on the rows.  Rows without id, and vectors that are NULL,
    zero, or hold NULL or non-finite values take no part.  Vectors of different lengths have no inner
    product: each length is searched by itself.  Rows with the query's own id are not its candidates;
    of rows that repeat an id and a vector one takes part.  Ties go to the smaller id.  Other columns are
    ignored.  An empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("query"))
    rows = rows.where(F.col("id").isNotNull() & _usable("v"))
    lengths = sorted(r["n"] for r in rows.select(F.size("v").alias("n")).distinct().collect())  # a row for each length of vectors
    found = [_nearest(rows.where(F.size("v") == n), k, recall, fit_rows) for n in lengths]
    out = vectors.sparkSession.createDataFrame([], _OUT) if not found else found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _nearest(rows: DataFrame, k: int, recall: float, fit_rows: int) -> DataFrame:
    """``nearest`` of ``rows`` (id, v, query), all of one length."""
    spark = rows.sparkSession
    rows = store(rows.withColumn("h", F.xxhash64("v")), "vectors")
    order = Window.partitionBy("h", "v").orderBy("id")
    first = rows.select("h", "v", "id").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1)
    points = store(first.groupBy("h", "v").agg(F.array_sort(F.collect_set("id")).alias("ids")).withColumn("point", F.col("ids")[0]), "points")
    asked = rows.where("query").select(F.col("id").alias("query_id"), "h", "v")
    asked = store(asked.join(points.select("h", "v", "point"), ["h", "v"]).select("query_id", "point"), "asked")
    queries = store(points.join(asked.select("point").distinct(), "point", "left_semi").select("point", "h", "v"), "queries")
    total, n_queries = points.count(), queries.count()
    if not n_queries:
        return spark.createDataFrame([], _OUT)

    def sample(df: DataFrame, n: int, of: int, salt: int) -> DataFrame:
        return df.where(F.pmod(F.xxhash64("h", F.lit(salt)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, n / of)))

    fit = sample(points, fit_rows, total, 1).orderBy("point").select("v").toArrow().column("v").combine_chunks()
    fit = fit if len(fit) else points.orderBy("point").select("v").limit(1).toArrow().column("v").combine_chunks()
    tree = fit_tree(_matrix(fit))
    leaves = int(tree.leaf.max()) + 1

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("point"), b.column("v"), b.column("ids"), pa.array(tree.file(_matrix(b.column("v"))))], ["point", "v", "ids", "leaf"])

    index = store(points.select("point", "v", "ids").mapInArrow(filed, "point long, v array<double>, ids array<long>, leaf long"), "index")
    visits = calibrated_visits(tree, index, sample(queries, CALIBRATION_ROWS, n_queries, 2), k, recall) if leaves > 1 else 1

    # leaves in the tree's order are put together in cells; a cell of many vectors is cut into blocks
    counts = {r["leaf"]: r["n"] for r in index.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row per leaf of the tree
    cell_of, blocks, cell, size = np.zeros(leaves, np.int64), [1], 0, 0
    for leaf in range(leaves):
        n = counts.get(leaf, 0)
        if size and size + n > BLOCK_ROWS:
            cell, size = cell + 1, 0
            blocks.append(1)
        cell_of[leaf], size = cell, size + n
        blocks[cell] = -(-size // BLOCK_ROWS) or 1

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                row, cells, lists = [], [], []
                for i, walk in enumerate(tree.walk(_matrix(b.column("v")), visits)):
                    for c in np.unique(cell_of[walk]).tolist():
                        row.append(i)
                        cells.append(c)
                        lists.append(walk[cell_of[walk] == c].tolist())
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("point").take(at), b.column("v").take(at), pa.array(cells, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["point", "v", "cell", "visit"])

    walks = store(queries.select("point", "v").mapInArrow(walked, "point long, v array<double>, cell long, visit array<long>"), "walks")
    asks = {r["cell"]: r["n"] for r in walks.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row per cell
    plan = F.broadcast(spark.createDataFrame([(c, int(n), -(-asks.get(c, 0) // QUERY_ROWS)) for c, n in enumerate(blocks) if asks.get(c)], "cell long, blocks long, parts long"))
    where = F.broadcast(spark.createDataFrame([(i, int(c)) for i, c in enumerate(cell_of)], "leaf long, cell long"))
    one = index.join(where, "leaf").join(plan, "cell").select(
        "cell", F.pmod(F.xxhash64("point"), "blocks").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), "point", "v", F.array("leaf").alias("visit"), "leaf"
    )
    other = walks.join(plan, "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("point"), "parts").alias("part"), F.lit(1).alias("side"), "point", "v", "visit", F.lit(-1).cast("long").alias("leaf"))
    dealt = one.unionByName(other).repartition("cell", "block", "part").sortWithinPartitions("cell", "block", "part", "side", "leaf", "point")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, parts, homes = None, [], [], []
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.column_stack([b.column(c).to_numpy() for c in ("cell", "block", "part", "side")])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), b.num_rows]
            point, v, visit = b.column("point").to_numpy(), _matrix(b.column("v")), b.column("visit")
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                own = tuple(keys[a, :3])
                if own != key:
                    key, ids, parts, homes = own, [], [], []
                if keys[a, 3] == 0:
                    ids.append(point[a:z])
                    parts.append(v[a:z])
                    homes.append(visit[a:z].flatten().to_numpy())
                elif ids:
                    names, x, home = np.concatenate(ids), np.concatenate(parts), np.concatenate(homes)
                    edges = np.concatenate([[0], np.flatnonzero(np.diff(home)) + 1, [len(home)]])  # a leaf's vectors stand together
                    for s in range(a, z, 256):
                        e = min(s + 256, z)
                        open_ = np.zeros((e - s, leaves), bool)
                        lists = visit[s:e]
                        open_[np.repeat(np.arange(e - s), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()] = True
                        score = np.full((e - s, len(home)), -np.inf)
                        for f, g in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                            who = np.flatnonzero(open_[:, home[f]])
                            if len(who):
                                score[who, f:g] = v[s:e][who] @ x[f:g].T
                        best = _best(score, names, k + 1)
                        row = np.repeat(np.arange(e - s), [len(r) for r in best])
                        at = np.concatenate(best)
                        exact = np.einsum("ij,ij->i", v[s:e][row], x[at])
                        yield pa.RecordBatch.from_arrays([pa.array(point[s:e][row]), pa.array(names[at]), pa.array(exact)], ["q", "point", "score"])

    pairs = dealt.mapInArrow(compared, "q long, point long, score double")
    top = Window.partitionBy("q").orderBy(F.desc("score"), "point")
    pairs = store(pairs.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= k + 1), "pairs")
    named = pairs.join(index.select("point", "ids"), "point")
    entries = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("s"), i.alias("id")))
    lists = named.groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list(entries))), 1, k + 1).alias("found"))
    answers = asked.join(lists, F.col("point") == F.col("q"))
    answers = answers.select("query_id", F.posexplode(F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)).alias("_p", "_x"))
    return answers.select("query_id", (F.col("_p") + 1).cast("int").alias("rank"), F.col("_x.id").alias("vec_id"), (-F.col("_x.s")).alias("score"))


def calibrated_visits(tree: Tree, index: DataFrame, queries: DataFrame, k: int, recall: float) -> int:
    """The fewest leaf visits by which the sample queries find ``recall`` of their k nearest points."""
    got = queries.orderBy("point").select("point", "v").toArrow()  # about CALIBRATION_ROWS rows
    if not got.num_rows:
        return int(tree.leaf.max()) + 1
    names, q = got.column("point").to_numpy(), _matrix(got.column("v").combine_chunks())

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None  # of this task so far: score, leaf and point by query
        for b in batches:
            if not b.num_rows:
                continue
            score = q @ _matrix(b.column("v")).T
            point = np.broadcast_to(b.column("point").to_numpy(), score.shape)
            score = np.where(point == names[:, None], -np.inf, score)
            own = (score, np.broadcast_to(b.column("leaf").to_numpy(), score.shape), point)
            best = own if best is None else tuple(np.concatenate(x, 1) for x in zip(best, own, strict=True))
            top = np.argsort(-best[0], axis=1, kind="stable")[:, :k]
            best = tuple(np.take_along_axis(x, top, 1) for x in best)
        if best is not None:
            n = best[0].shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q)), n)), pa.array(best[0].ravel()), pa.array(best[1].ravel()), pa.array(best[2].ravel())], ["q", "score", "leaf", "point"])

    near = index.select("point", "v", "leaf").mapInArrow(brute, "q long, score double, leaf long, point long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "point")
    near = near.where(F.col("score") > float("-inf")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("q", "leaf").toArrow()
    leaves = int(tree.leaf.max()) + 1
    place = np.zeros((len(q), leaves), np.int64)
    for i, walk in enumerate(tree.walk(q, leaves)):
        place[i, walk] = np.arange(len(walk))
    found = np.bincount(place[near.column("q").to_numpy(), near.column("leaf").to_numpy()], minlength=leaves)
    share = np.cumsum(found) / max(found.sum(), 1)
    return int(np.searchsorted(share, recall)) + 1
