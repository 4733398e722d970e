"""Nearest neighbours by a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample (``SAMPLE`` vectors with the least hash, a parameter) and has a
bounded number of nodes, so it can be broadcast; every vector is then filed under its leaf. A query
walks the tree with a priority queue that holds the branches it passed by, nearest first, which gives
its leaves in the order in which they are worth a visit. How many leaves are visited is calibrated
for queries of sparse, usual and crowded leaves apart: for ``AUDIT`` of each the true neighbours are
found by comparing with all rows, and the visits widen until those leaves hold the wanted share of
them. Whatever the calibration says, a query goes on until its leaves hold enough other rows.

Leaves are cut into parts of bounded size by a hash, so a leaf with a third of all vectors is many
tasks. A part meets the queries that visit its leaf in one group and sends their nearest only.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part; equal scores go to the smaller id; with fewer candidates than asked all are
given; an id that occurs twice is two candidates, and a query never meets its own id.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.vectors import cosine, dimension, matrix, unit, usable
from barloom.session import durable

SAMPLE = 16_384
BRANCH = 8
LEAF = 64
AUDIT = 128
PART_ROWS = 4096
TARGET = 0.96


@dataclass
class Tree:
    """Centres of all nodes; ``first[n]`` is the first child of node n, children lie side by side;
    a leaf has no children."""

    centre: np.ndarray
    first: np.ndarray
    count: np.ndarray

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row, by going to the nearest child."""
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            inner = np.flatnonzero(self.count[at] > 0)
            if not len(inner):
                return at
            for node in np.unique(at[inner]):
                rows = inner[at[inner] == node]
                kids = slice(self.first[node], self.first[node] + self.count[node])
                near = np.argmax(x[rows] @ self.centre[kids].T - self._half(kids), axis=1)
                at[rows] = self.first[node] + near

    def _half(self, kids: slice) -> np.ndarray:
        c = self.centre[kids]
        return 0.5 * (c * c).sum(axis=1)

    def walk(self, x: np.ndarray):
        """Leaves for one query, best first: take the nearest waiting branch, go down to its leaf
        and keep the branches passed by in the queue."""
        waiting = [(0.0, 0)]
        while waiting:
            _, node = heapq.heappop(waiting)
            while self.count[node]:
                kids = np.arange(self.first[node], self.first[node] + self.count[node])
                gap = ((self.centre[kids] - x) ** 2).sum(axis=1)
                best = int(np.argmin(gap))
                for k, g in zip(kids, gap):
                    if k != kids[best]:
                        heapq.heappush(waiting, (float(g), int(k)))
                node = int(kids[best])
            yield node

    def visits(self, x: np.ndarray, limit: int) -> list[int]:
        """The first leaves of ``walk``."""
        return list(islice(self.walk(x), limit))

    def enough(self, x: np.ndarray, limit: int, held: dict[int, int], rows: int) -> list[int]:
        """The first leaves of ``walk``, and more until they hold as many rows as asked."""
        out: list[int] = []
        for leaf in self.walk(x):
            out.append(leaf)
            rows -= held.get(leaf, 0)
            if len(out) >= limit and rows <= 0:
                break
        return out

    @property
    def leaves(self) -> int:
        return int((self.count == 0).sum())


def grow(x: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, rounds: int = 8) -> Tree:
    """Split the sample by k-means until nodes hold at most ``leaf`` vectors."""
    centre, first, count = [x.mean(axis=0) if len(x) else np.zeros(x.shape[1])], [0], [0]
    todo = [(0, np.arange(len(x)))]
    rng = np.random.default_rng(7)
    while todo:
        node, rows = todo.pop(0)
        if len(rows) <= leaf:
            continue
        own = x[rows]
        k = min(branch, len(rows))
        c = own[rng.choice(len(rows), k, replace=False)]
        for _ in range(rounds):
            near = np.argmax(own @ c.T - 0.5 * (c * c).sum(axis=1), axis=1)
            used = np.unique(near)
            c = np.stack([own[near == j].mean(axis=0) for j in used])
        near = np.argmax(own @ c.T - 0.5 * (c * c).sum(axis=1), axis=1)
        if len(np.unique(near)) < 2:  # all the same vector
            continue
        first[node], count[node] = len(centre), len(c)
        for j in range(len(c)):
            todo.append((len(centre), rows[near == j]))
            centre.append(c[j])
            first.append(0)
            count.append(0)
    return Tree(np.array(centre), np.array(first), np.array(count))


def fit_tree(rows: DataFrame, dim: int, sample: int = SAMPLE, branch: int = BRANCH, leaf: int = LEAF) -> Tree:
    """Fit on the ``sample`` rows with the least hash of their id."""
    h = F.xxhash64("_id", F.lit(3))
    got = rows.orderBy(h, "_id").limit(sample).select("_v").toArrow()
    return grow(unit(matrix(got.column("_v"), dim)), branch, leaf)


def _nearest(x: np.ndarray, q: np.ndarray, ids: np.ndarray, qids: np.ndarray, k: int):
    """Exact nearest of each query among the rows: index of query, id, score."""
    if not len(x) or not len(q):
        return [], [], []
    near = unit(q) @ unit(x).T
    near[qids[:, None] == ids[None, :]] = -np.inf
    who, got, score = [], [], []
    for i in range(len(q)):
        row = near[i]
        m = min(k, int(np.isfinite(row).sum()))
        if not m:
            continue
        least = np.partition(row, len(row) - m)[len(row) - m]
        at = np.flatnonzero(row >= least - 1e-9)  # ties whatever the rounding of the product
        s = cosine(x[at], np.broadcast_to(q[i], x[at].shape))
        order = np.lexsort((ids[at], -s))[:m]
        who.append(np.full(len(order), i))
        got.append(ids[at[order]])
        score.append(s[order])
    return who, got, score


def _table(qid, got, score, names, **more):
    cols = [pa.array(np.concatenate(c)) if len(c) else pa.array([], t) for c, t in
            ((qid, pa.int64()), (got, pa.int64()), (score, pa.float64()))]
    return pa.table(cols, names=names)


def brute_force(rows: DataFrame, queries: DataFrame, k: int, dim: int) -> DataFrame:
    """The true nearest of a bounded number of queries: every task compares its rows with all of
    them and sends ``k`` each."""
    got = queries.toArrow()
    q, qids = matrix(got.column("_v"), dim), got.column("_id").to_numpy()

    def run(batches):
        for b in batches:
            x, ids = matrix(b.column("_v"), dim), b.column("_id").to_numpy()
            who, near, score = _nearest(x, q, ids, qids, k)
            t = _table([qids[w] for w in who], near, score, ["query_id", "vec_id", "score"])
            yield from t.to_batches()

    found = rows.select("_id", "_v").mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    return best(found, k)


def best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(
    df: DataFrame,
    is_query: Column,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 5,
    target: float = TARGET,
    sample: int = SAMPLE,
    audit: int = AUDIT,
    part_rows: int = PART_ROWS,
) -> tuple[DataFrame, dict]:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest of each query row among all others, and
    what was calibrated: leaves, visits and the recall measured on the audited queries."""
    spark = df.sparkSession
    dim = dimension(df, vector)
    schema = "query_id bigint, vec_id bigint, score double"
    if not dim:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double"), {}
    own = df.where(usable(vector, dim) & F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("_id"),
        F.col(vector).cast("array<double>").alias("_v"),
        F.coalesce(is_query, F.lit(False)).alias("_q"),
    )
    tree = fit_tree(own, dim, sample)
    shared = spark.sparkContext.broadcast(tree)  # at most ``sample`` centres

    def leaf(v: pa.Array) -> pa.Array:
        x = matrix(v, dim)
        return pa.array(shared.value.leaf_of(unit(x)) if len(x) else [], pa.int64())

    filed = durable(own.withColumn("_leaf", F.arrow_udf(leaf, "bigint")("_v")))
    # A leaf has at least one node of the tree, so there are at most as many as the tree has nodes.
    held = {r["_leaf"]: r["count"] for r in filed.groupBy("_leaf").count().collect()}
    group = groups_of(held)
    sizes = spark.sparkContext.broadcast((held, group))
    copies = filed.groupBy("_id").agg(F.count("*").alias("_m")).where("_m > 1")
    queries = filed.where("_q").select("_id", "_v", "_leaf")
    drawn = None
    for g in sorted(set(group.values())):
        own_leaves = spark.createDataFrame([(leaf,) for leaf, x in group.items() if x == g], "_leaf bigint")
        part = queries.join(F.broadcast(own_leaves), "_leaf", "left_semi").orderBy(F.xxhash64("_id", F.lit(5)), "_id").limit(audit)
        drawn = part if drawn is None else drawn.unionByName(part)
    if drawn is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double"), {}
    probe = durable(drawn)
    truth = brute_force(filed, probe.select("_id", "_v"), k, dim)
    # Leaves of the true neighbours: at most audit * k rows of each group.
    where = truth.join(
        filed.select(F.col("_id").alias("vec_id"), "_leaf").distinct(), "vec_id"
    ).select("query_id", "_leaf").collect()
    visits = calibrate(tree, probe.collect(), where, target, group)

    def route(batches):
        tree, (held, group) = shared.value, sizes.value
        for b in batches:
            x = unit(matrix(b.column("_v"), dim))
            least = b.column("_m").to_numpy() + k  # a query's own rows do not count
            ways = [
                tree.enough(row, visits["visits"][group[leaf]], held, n)
                for row, leaf, n in zip(x, b.column("_leaf").to_pylist(), least)
            ]
            n = np.array([len(w) for w in ways], dtype=np.int64)
            at = pa.array(np.repeat(np.arange(len(ways)), n))
            yield pa.RecordBatch.from_arrays(
                [b.column("_id").take(at), b.column("_v").take(at), pa.array(np.concatenate(ways).astype(np.int64))]
                if len(ways)
                else [b.column("_id"), b.column("_v"), pa.array([], pa.int64())],
                names=["_id", "_v", "_leaf"],
            )

    asked = queries.join(copies, "_id", "left").select("_id", "_v", "_leaf", F.coalesce("_m", F.lit(1)).alias("_m"))
    asked = asked.mapInArrow(route, "_id bigint, _v array<double>, _leaf bigint")
    parts = filed.groupBy("_leaf").agg(F.ceil(F.count("*") / F.lit(part_rows)).cast("int").alias("_n"))
    rows = filed.join(parts, "_leaf").withColumn("_part", F.pmod(F.xxhash64("_id", F.lit(9)), "_n").cast("int"))
    asked = asked.join(parts, "_leaf").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))

    def meet(key_, left, right):
        x, ids = matrix(left.column("_v"), dim), left.column("_id").to_numpy()
        q, qids = matrix(right.column("_v"), dim), right.column("_id").to_numpy()
        out = []
        for i in range(0, max(len(q), 1), 1024):
            who, near, score = _nearest(x, q[i : i + 1024], ids, qids[i : i + 1024], k)
            out.append(_table([qids[i:][w] for w in who], near, score, ["query_id", "vec_id", "score"]))
        return pa.concat_tables(out)

    found = (
        rows.select("_leaf", "_part", "_id", "_v")
        .groupBy("_leaf", "_part")
        .cogroup(asked.select("_leaf", "_part", "_id", "_v").groupBy("_leaf", "_part"))
        .applyInArrow(meet, schema)
    )
    return best(found, k).select("query_id", "rank", "vec_id", "score"), visits


def groups_of(held: dict[int, int]) -> dict[int, int]:
    """Group of each leaf by its rows against the mean of all leaves: 0 sparse (under half), 1 usual,
    2 crowded (over twice)."""
    mean = sum(held.values()) / max(1, len(held))
    return {leaf: (n >= mean / 2) + (n > 2 * mean) for leaf, n in held.items()}


def calibrate(tree: Tree, probe, where, target: float, group: dict[int, int]) -> dict:
    """For each group of leaves the fewest visits whose leaves hold the target share of the neighbours
    of the audited queries that lie there; all leaves for a group without neighbours."""
    leaves: dict[int, list[int]] = {}
    for r in where:
        leaves.setdefault(r.query_id, []).append(r["_leaf"])
    ranks: dict[int, list[int]] = {g: [] for g in group.values()}
    for r in probe:
        order = {leaf: i for i, leaf in enumerate(tree.visits(unit(np.array([r["_v"]]))[0], tree.leaves))}
        ranks[group[r["_leaf"]]] += [order[leaf] for leaf in leaves.get(r["_id"], [])]
    visits, recall = {}, {}
    for g, of in ranks.items():
        of = np.sort(of)
        visits[g] = int(of[int(np.ceil(target * len(of))) - 1]) + 1 if len(of) else tree.leaves
        recall[g] = float((of < visits[g]).mean()) if len(of) else 1.0
    return {"leaves": tree.leaves, "visits": visits, "recall": min(recall.values(), default=1.0)}
