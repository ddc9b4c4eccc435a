"""Nearest neighbours by inner product: vantage-point trees per shard with relaxed triangle-inequality pruning."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import prepare
from evidentia.session import stage

LEAF = 96
#: A shard takes the first of these factors with this recall on so many of its queries, else 1.
FACTORS = (4.0, 3.0, 2.0, 1.5, 1.25)
RECALL = 0.97
PROBES = 48


@dataclass
class Node:
    """Points ``at`` in a leaf; else a vantage point, the radius that halves the rest, and both halves."""

    at: np.ndarray | None
    point: int = -1
    radius: float = 0.0
    inside: Node | None = None
    outside: Node | None = None


def build(points: np.ndarray, at: np.ndarray, draw: np.random.Generator) -> Node:
    if len(at) <= LEAF:
        return Node(at)
    # of a few drawn points, the one whose distances to a few others spread most
    tries = draw.choice(at, min(8, len(at)), replace=False)
    some = points[draw.choice(at, min(64, len(at)), replace=False)]
    spread = [np.sqrt(((some - points[t]) ** 2).sum(axis=1)).std() for t in tries]
    point = int(tries[int(np.argmax(spread))])
    rest = at[at != point]
    far = np.sqrt(((points[rest] - points[point]) ** 2).sum(axis=1))
    radius = float(np.median(far))
    near = far <= radius
    if near.all():
        near = far < radius
        if not near.any():
            return Node(at)
    return Node(None, point, radius, build(points, rest[near], draw), build(points, rest[~near], draw))


class Search:
    """The ``k`` nearest of a shard for a block of queries, all queries of a node at a time."""

    def __init__(self, points: np.ndarray, queries: np.ndarray, k: int, factor: float):
        self.points, self.queries, self.k, self.factor = points, queries, min(k, len(points)), factor
        self.far = np.full((len(queries), self.k), np.inf)
        self.best = np.full((len(queries), self.k), -1, dtype=np.int64)
        self.norms = (points**2).sum(axis=1)
        self.query_norms = (queries**2).sum(axis=1)
        self.seen = 0

    def take(self, rows: np.ndarray, at: np.ndarray, far: np.ndarray) -> None:
        """Merge the points ``at``, at distances ``far`` (queries by points), into the best so far."""
        self.seen += far.size
        far = np.concatenate((self.far[rows], far), axis=1)
        best = np.concatenate((self.best[rows], np.broadcast_to(at, (len(rows), len(at)))), axis=1)
        keep = np.argpartition(far, self.k - 1, axis=1)[:, : self.k]
        self.far[rows] = np.take_along_axis(far, keep, 1)
        self.best[rows] = np.take_along_axis(best, keep, 1)

    def distances(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        square = self.query_norms[rows][:, None] + self.norms[at][None, :] - 2 * self.queries[rows] @ self.points[at].T
        return np.sqrt(np.maximum(square, 0))

    def visit(self, node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node.at is not None:
            self.take(rows, node.at, self.distances(rows, node.at))
            return
        far = self.distances(rows, np.array([node.point]))
        self.take(rows, np.array([node.point]), far)
        far = far[:, 0]
        within = far <= node.radius
        self.visit(node.inside, rows[within])
        self.visit(node.outside, rows[~within])
        # the triangle inequality bounds the distance of all points of the other half from below
        reach = self.far[rows].max(axis=1)
        gap = np.abs(far - node.radius)
        open_ = gap * self.factor <= reach * (1 + 1e-9) + 1e-9
        self.visit(node.outside, rows[within & open_])
        self.visit(node.inside, rows[~within & open_])


def tuned(points: np.ndarray, queries: np.ndarray, tree: Node, k: int) -> float:
    """The largest factor whose recall is high enough on a few queries that are also searched exhaustively."""
    few = queries[:: max(1, len(queries) // PROBES)][:PROBES]
    rows = np.arange(len(few))
    exact = Search(points, few, k, 1.0)
    exact.take(rows, np.arange(len(points)), exact.distances(rows, np.arange(len(points))))
    for factor in FACTORS:
        found = Search(points, few, k, factor)
        found.visit(tree, rows)
        hits = np.mean([np.isin(a, b).mean() for a, b in zip(exact.best, found.best, strict=True)])
        if hits >= RECALL:
            return factor
    return 1.0


def clean(vectors: DataFrame, is_query: Column, key: str, vector: str) -> DataFrame:
    """Ids, vectors of doubles and the query mark of rows that take part: not null, not zero, all components finite."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(key).alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    return rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, factor: float | None = None, shard_rows: int = 10_000, block_rows: int = 10_000, seed: int = 9) -> DataFrame:
    """The ``k`` rows with the largest inner product for each row where ``is_query`` holds, itself left out.

    Equal vectors are searched once: an index entry stands for all rows with its vector and keeps their ``k + 1``
    smallest ids, which is all that any result can use. Inner products become distances by one more component, the
    root of what a vector lacks to the longest. Entries are dealt over shards of about ``shard_rows``; each builds one
    tree. Blocks of queries meet every shard. A half is left out when its lower bound times ``factor`` is above the
    k-th distance so far: at 1 the search is exact; above 1 fewer halves are visited and recall falls. Without a factor
    each shard measures its own (`tuned`).

    Scores are inner products in double precision; nearest first, ties to the smaller id, all candidates if there are
    under ``k``. Vectors that are null, zero or hold null or non-finite components, and rows without an id, take no
    part; nor do vectors whose length is not that of most. Rows that repeat an id count as one if equal, else each.
    An empty table gives no rows. Columns: query_id, rank, vec_id, score.
    """
    spark = prepare(vectors.sparkSession)
    rows = clean(vectors, is_query, key, vector)
    rows = stage(rows.dropDuplicates(["id", "v"]).withColumn("entry", F.xxhash64("v")), "ann-rows")
    widths = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    width = widths["w"] if widths else 0
    rows = rows.filter(F.size("v") == width)
    order = Window.partitionBy("entry", "v").orderBy("id")
    few = rows.select("entry", "v", "id", F.row_number().over(order).alias("place")).filter(F.col("place") <= k + 1)
    entries = few.groupBy("entry", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = stage(entries, "ann-entries")
    total, longest = entries.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    shards = max(1, -(-total // shard_rows))
    asked = stage(rows.filter("query").groupBy("entry", "v").agg(F.count("*").alias("n")).drop("n"), "ann-queries")
    blocks = max(1, -(-asked.count() // block_rows))
    deal = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "entry"), F.lit(n)).cast("int")
    points = entries.withColumn("shard", deal(shards, seed))
    # every block meets every shard, once for each pair of them
    block = asked.withColumn("block", deal(blocks, seed + 1)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    tree_rows = points.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(group: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"entry": [], "v": [], "id": [], "score": []}
        if len(left) and len(right):
            left = left.sort_values("entry", kind="stable", ignore_index=True)
            p, q = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
            lacking = np.sqrt(np.maximum(longest - (p**2).sum(axis=1), 0))
            points, queries = np.column_stack((p, lacking)), np.column_stack((q, np.zeros(len(q))))
            tree = build(points, np.arange(len(p)), np.random.default_rng(seed))
            found = Search(points, queries, k + 1, factor or tuned(points, queries, tree, k + 1))
            found.visit(tree, np.arange(len(q)))
            for i, at in enumerate(found.best):
                scores = (p[at] * q[i]).sum(axis=1)
                ids = [left["ids"].iat[j] for j in at]
                pairs = sorted((-s, int(x)) for s, own in zip(scores, ids, strict=True) for x in own)[: k + 1]
                out["entry"].append(right["entry"].iat[i])
                out["v"].append(right["v"].iat[i])
                out["id"].append([x for _, x in pairs])
                out["score"].append([-s for s, _ in pairs])
        return pd.DataFrame(out)

    types = "entry long, v array<double>, id array<long>, score array<double>"
    found = tree_rows.groupBy("shard", "block").cogroup(block.groupBy("shard", "block")).applyInPandas(search, types)
    # the best of all shards for an entry, then for each query row without itself
    each = found.select("entry", "v", F.explode(F.arrays_zip("score", "id")).alias("x")).select("entry", "v", "x.score", F.col("x.id").alias("vec_id"))
    top = Window.partitionBy("entry", "v").orderBy(F.desc("score"), "vec_id")
    best = each.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k + 1)
    best = best.groupBy("entry", "v").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("found"))
    best = stage(best, "ann-best")
    own = rows.filter("query").select("entry", "v", F.col("id").alias("query_id")).join(best, ["entry", "v"])
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = own.select("query_id", F.posexplode(others).alias("place", "x"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
