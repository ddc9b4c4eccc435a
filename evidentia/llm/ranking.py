"""Ranked lexical search: documents in a tree of frequency-ordered terms, searched depth first with bounds."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import prepare, texts
from evidentia.session import stage

#: Characters of no term, as bytes: ASCII but for letters and digits; A-Z become a-z.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Item terms that one pass over the documents searches for.
BLOCK_TERMS = 1 << 20
#: Documents below which a node is not divided further, and numbers that the bounds of one tree hold at most.
LEAF = 32
ROOM = 1 << 24
MOST_DOCS = 1 << 15
#: The id that stands for null, after all others.
LAST = (1 << 63) - 1


def terms_of(body: bytes) -> list[bytes]:
    return body.translate(TERMS).split()


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term) of every item, each term once; rows that share an id are one item."""

    def split(batches):
        for batch in batches:
            found = [sorted(set(terms_of(x))) for x in texts(batch.column(1))]
            place = np.repeat(np.arange(len(found)), [len(x) for x in found])
            terms = pa.array([t for x in found for t in x], pa.binary()).cast(pa.string())
            yield pa.record_batch([batch.column(0).take(pa.array(place)), terms], names=[key, "term"])

    rows = items.select(F.col(key), F.col(text))
    return rows.mapInArrow(split, f"`{key}` {rows.schema[0].dataType.simpleString()}, term string").distinct()


def vectors(docs: DataFrame, known: dict[bytes, int], key: str, text: str) -> DataFrame:
    """(id, n, terms, tfs) of each document with terms: their number and those of ``known`` with their occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def restrict(batches):
        place = shared.value
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for doc, body in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                found = terms_of(body)
                if not found:
                    continue
                held = Counter(map(place.get, found))
                held.pop(None, None)
                for column, value in zip(rows, (doc, len(found), list(held), list(held.values())), strict=True):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.record_batch([pa.array(x, type=t) for x, t in zip(rows, types, strict=True)], names=["id", "n", "terms", "tfs"])

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(restrict, "id long, n long, terms array<int>, tfs array<long>")


@dataclass
class Items:
    """What tasks search for: each item's terms as ranks by frequency, their weights, and the corpus' numbers."""

    ids: list
    terms: list[np.ndarray]
    weights: np.ndarray
    rank: np.ndarray
    docs: int
    words: int


class Tree:
    """Documents in the order of their paths: the ranks of their terms, most frequent first.

    A node is a run of documents that share a path. It holds, for each term, the most that an occurrence number of its
    subtree can score with the subtree's least m, and its least id. Children of a node follow each other.
    """

    def __init__(self, ids: np.ndarray, m: np.ndarray, starts: np.ndarray, terms: np.ndarray, tfs: np.ndarray, width: int):
        owner = np.repeat(np.arange(len(ids)), np.diff(starts))
        order = np.lexsort((terms, owner))
        terms, tfs = terms[order], tfs[order]
        paths = [terms[a:b].astype(">u4").tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
        docs = np.array(sorted(range(len(ids)), key=paths.__getitem__), dtype=np.int64)
        sizes = np.diff(starts)[docs]
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        entry = np.repeat(starts[docs] - self.starts[:-1], sizes) + np.arange(self.starts[-1])
        self.ids, self.m, self.terms = ids[docs], m[docs], terms[entry]
        self.points = points(tfs[entry], np.repeat(self.m, sizes))
        self._divide([paths[i] for i in docs])
        self._bound(tfs[entry], width)

    def _divide(self, paths: list[bytes]) -> None:
        """Nodes first to last in breadth: their documents from ``lo`` to ``hi``, their children from ``first`` on."""
        lo, hi, first, many = [0], [len(paths)], [], []
        depth = [0]
        at = 0
        while at < len(lo):
            a, b, d = lo[at], hi[at], depth[at]
            cuts = []
            if b - a > LEAF and paths[a] != paths[b - 1]:
                # ranks are four bytes; what all documents of the node share is one edge
                while paths[a][4 * d : 4 * d + 4] == paths[b - 1][4 * d : 4 * d + 4]:
                    d += 1
                small = a
                for x in range(a + 1, b + 1):
                    if x == b or paths[x][4 * d : 4 * d + 4] != paths[x - 1][4 * d : 4 * d + 4]:
                        # neighbouring subtrees of few documents make one node
                        last = cuts[-1] if cuts else a
                        if x - small >= LEAF and small > last:
                            cuts.append(small)
                            last = small
                        if x < b and x - last >= LEAF:
                            cuts.append(x)
                        small = x
            cuts = [a, *cuts, b] if cuts else []
            first.append(len(lo))
            many.append(max(0, len(cuts) - 1))
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                lo.append(x)
                hi.append(y)
                depth.append(d)
            at += 1
        self.lo, self.hi, self.first, self.many = lo, hi, first, many

    def _bound(self, tfs: np.ndarray, width: int) -> None:
        count = len(self.lo)
        most = np.zeros((count, width), dtype=np.int64)
        least_m = np.zeros(count, dtype=np.int64)
        self.least_id = np.zeros(count, dtype=np.int64)
        for at in range(count - 1, -1, -1):
            if self.many[at]:
                children = slice(self.first[at], self.first[at] + self.many[at])
                most[at] = most[children].max(axis=0)
                least_m[at], self.least_id[at] = least_m[children].min(), self.least_id[children].min()
            else:
                a, b = self.starts[self.lo[at]], self.starts[self.hi[at]]
                np.maximum.at(most[at], self.terms[a:b], tfs[a:b])
                own = slice(self.lo[at], self.hi[at])
                least_m[at], self.least_id[at] = self.m[own].min(), self.ids[own].min()
        self.most = points(most, least_m[:, None]).astype(np.int32)

    def search(self, terms: np.ndarray, weights: np.ndarray, best: list[tuple[int, int]], k: int) -> None:
        """Put the documents that belong to the ``k`` best into the heap ``best`` of (score, -id), worst first."""
        todo = [(int(self.most[0, terms] @ weights[terms]), 0)]
        own = np.zeros(len(weights), dtype=np.int64)
        own[terms] = weights[terms]
        while todo:
            bound, at = todo.pop()
            if bound <= 0 or (len(best) == k and (bound, -int(self.least_id[at])) <= best[0]):
                continue
            if self.many[at]:
                a, b = self.first[at], self.first[at] + self.many[at]
                bounds = self.most[a:b, terms] @ weights[terms]
                # the most promising child is taken from the end of the stack first
                todo += sorted(zip(bounds.tolist(), range(a, b), strict=True))
                continue
            a, b = self.lo[at], self.hi[at]
            edge = self.starts[a : b + 1]
            sums = np.concatenate(([0], np.cumsum(own[self.terms[edge[0] : edge[-1]]] * self.points[edge[0] : edge[-1]])))
            scores = sums[edge[1:] - edge[0]] - sums[edge[:-1] - edge[0]]
            worst = best[0][0] if len(best) == k else 1
            for i in np.flatnonzero(scores >= worst).tolist():
                found = (int(scores[i]), -int(self.ids[a + i]))
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)


def points(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def searched(rows: DataFrame, items: Items, k: int) -> DataFrame:
    """(item, id, score): each task's ``k`` best for every item, by place among the items."""
    shared = rows.sparkSession.sparkContext.broadcast(items)
    width = len(items.weights)
    most_docs = int(min(MOST_DOCS, max(LEAF, ROOM // max(1, width) * LEAF // 2)))

    def find(batches):
        items = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in items.ids]

        def grow(held):
            batch = pa.Table.from_batches(held).combine_chunks()
            terms = batch.column("terms").combine_chunks()
            n = batch.column("n").to_pylist()
            m = np.array([50 + 50 * x * items.docs // items.words for x in n], dtype=np.int64)
            ids = batch.column("id").fill_null(LAST).to_numpy()
            starts = terms.offsets.to_numpy().astype(np.int64)
            held_terms = items.rank[terms.values.to_numpy()]
            tfs = batch.column("tfs").combine_chunks().values.to_numpy()
            tree = Tree(ids, m, starts - starts[0], held_terms, tfs, width)
            for place, wanted in enumerate(items.terms):
                tree.search(wanted, items.weights, best[place], k)

        held, docs = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, most_docs):
                part = batch.slice(i, most_docs)
                if docs and docs + part.num_rows > most_docs:
                    grow(held)
                    held, docs = [], 0
                held.append(part)
                docs += part.num_rows
        if docs:
            grow(held)
        found = [(place, -negative, score) for place, rows in enumerate(best) for score, negative in rows]
        columns = [pa.array([x[i] for x in found], pa.int64()) for i in range(3)]
        yield pa.record_batch(columns, names=["item", "id", "score"])

    rows = rows.filter(F.size("terms") > 0).select("id", "n", "terms", "tfs")
    return rows.mapInArrow(find, "item long, id long, score long")


def ranked(
    docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", item_key: str = "item_id", text: str = "text", item_text: str = "text"
) -> DataFrame:
    """Each item's ``k`` documents with the highest score above 0: item id, rank from 1, document id, score.

    Terms are runs of ASCII letters and digits and of anything beyond ASCII, A-Z in lower case. Items are dealt into
    blocks of at most about BLOCK_TERMS terms; each block is searched for in all documents. One scan reduces
    the documents to their numbers and to the block's terms; the counts over all of them give the weights. Then each
    task puts its documents into trees: paths are its terms, the most frequent in the corpus first, so that documents
    share their beginnings. A node knows the largest occurrence number of each term below it and the smallest m, which
    bound what any document below it can score. A search goes depth first, the most promising child before the others,
    and leaves out nodes whose bound, or at an equal bound whose least id, cannot enter the ``k`` best so far. A tree's
    bounds have a fixed size: with more terms, it holds fewer documents.

    Equal scores are ranked by ascending id, null ids last. A null text, or one without terms, is no document and
    counts in no number; an item without terms has no rows. Rows that repeat a document's id are documents of their own;
    items that share an id are one, with the terms of both. Other columns are ignored; an empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    wanted = stage(item_terms(items, item_key, item_text), "ranked-items")
    out = None
    blocks = max(1, math.ceil(wanted.count() / BLOCK_TERMS))
    for block in range(blocks):
        # an item without an id has a place of its own
        rows = wanted.filter(F.pmod(F.xxhash64(F.coalesce(F.col(item_key).cast("string"), F.lit(""))), F.lit(blocks)) == block)
        found = one_block(docs, rows.groupBy(item_key).agg(F.collect_list("term").alias("terms")).collect(), k, key, text)
        names = {i: r for i, r in enumerate(found[1])}
        ids = spark.createDataFrame([(i, r) for i, r in names.items()], wanted.select(F.lit(1).cast("long").alias("item"), item_key).schema)
        part = found[0].join(F.broadcast(ids), "item").drop("item")
        out = part if out is None else out.unionByName(part)
    return out.select(item_key, "rank", F.col("id").alias(key), "score")


def one_block(docs: DataFrame, items: list, k: int, key: str, text: str) -> tuple[DataFrame, list]:
    """(item, rank, id, score) for the items of one block, and their ids by place."""
    known = {t: i for i, t in enumerate(sorted({t for r in items for t in r["terms"]}))}
    rows = stage(vectors(docs, {t.encode(): i for t, i in known.items()}, key, text), "ranked-vectors")
    total = rows.agg(F.count("*").alias("docs"), F.sum("n").alias("words")).first()
    df = np.zeros(len(known), dtype=np.int64)
    for r in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[r["term"]] = r["count"]
    order = np.argsort(-df, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    weight = [math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * int(x) + 1))) for x in df[order]]
    terms = [np.sort(rank[[known[t] for t in r["terms"]]]) for r in items]
    about = Items([r[0] for r in items], terms, np.array(weight, dtype=np.int64), rank, total["docs"], total["words"] or 1)
    found = stage(searched(rows, about, k), "ranked-found")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return found.select("item", "rank", F.when(F.col("id") != LAST, F.col("id")).alias("id"), "score"), about.ids
