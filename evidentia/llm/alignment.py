"""Alignment of two tokenizers: which ids cover the same bytes, and how often in the whole corpus."""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import prepare
from evidentia.llm.packing import public_path
from evidentia.llm.perfect import MinimalHash, ShardedHash, shard_of
from evidentia.session import stage

#: Segments that a worker keeps, pairs that a task holds before it adds equal ones up.
CACHE = 600_000
PAIRS = 1 << 21
#: Segments that are aligned in one go.
STEP = 50_000
#: Characters from which a segment is left to the tokenizer's own library, which takes runs of any length.
LONG = 10_000
#: A pair of ids is one number: the id of B in the lower bits.
LOW = 24
#: Distinct pairs up to which one table of them is sent to every task; beyond it, pairs are joined.
TABLE = 1 << 23
#: Pairs of one shard of the hash, vectors that are added in one step.
SHARD = 1 << 18
FAN = 8
#: A space after white space; elsewhere a space is the border of two segments.
SPACES = re.compile(r"\s ")
BORDER = re.compile(r"(?<=\S)(?= )")


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 is itself, others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def segments(text: str | None) -> list[str]:
    """The segments of a space and the text, each without its first space; no text has none."""
    if not text:
        return []
    if not SPACES.search(" " + text):
        return text.split(" ")
    return [x[1:] for x in BORDER.split(" " + text)]


class Aligner:
    """Both tokenizers, and what they say of the segments met before.

    A segment is a run of white space that begins with a space, and what follows. No token of either tokenizer goes
    over the border of two segments, so a text's tokens are those of its segments in turn; as a border ends a token in
    both, so are its groups. A segment has a place: in ``numbers`` (n_a, n_b, n_groups, 1 where its bytes agree in
    both), in ``groups`` (as text), and in ``links`` between two ``ends``.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(path_a, encoding="utf-8") as file:
            vocabulary = json.load(file)
        special = {t["content"] for t in vocabulary["added_tokens"]}
        letter = byte_letters()
        ranks = {bytes(letter[c] for c in t): i for t, i in vocabulary["model"]["vocab"].items() if t not in special}
        merges = [x if isinstance(x, str) else " ".join(x) for x in vocabulary["model"]["merges"]]
        order = [vocabulary["model"]["vocab"][x.replace(" ", "")] for x in merges]
        if order != sorted(order) or vocabulary["normalizer"]:
            raise ValueError("merges must follow the ids, and texts be taken as they are")
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.long = Tokenizer.from_file(path_a)
        self.long.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        self.bytes_a = dict(zip(ranks.values(), ranks, strict=True))
        self.bytes_b = {i: bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces}
        self.lengths_a, self.lengths_b = lengths(self.bytes_a), lengths(self.bytes_b)
        most = max(len(self.lengths_a), len(self.lengths_b))
        self.names = [b"%d%b" % (i, end) for end in (b",", b"|", b";", b"\n") for i in range(most)]
        self.most = most
        self.space = self.b.piece_to_id("▁")
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.numbers = np.empty((4, 0), dtype=np.int64)
        self.links, self.ends = np.empty(0, dtype=np.int64), np.zeros(1, dtype=np.int64)

    def tokens(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of segments in turn. Segments that end in white space stand alone, others share a line."""
        a, b, line = [], [], []
        for x in [*parts, None]:
            alone = x is None or not x or x[-1].isspace() or len(x) > LONG
            if line and (alone or len(line) == 500):
                text = " ".join(line)
                a += self.a.encode_ordinary(" " + text)
                b += self.b.encode(text)
                line = []
            if x is None:
                break
            if alone:
                a += self.a.encode_ordinary(" " + x) if len(x) <= LONG else self.long.encode(" " + x, add_special_tokens=False).ids
                b += self.b.encode(x) if x else [self.space]
            else:
                line.append(x)
        return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)

    def add(self, parts: list[str]) -> None:
        """Give each of ``parts``, all new, a place."""
        a, b = self.tokens(parts)
        body = "".join([" " + x for x in parts]).encode()
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != body or b"".join(map(self.bytes_b.__getitem__, b.tolist())) != body:
            if len(parts) > 1:
                # a segment whose bytes do not agree is found by halves
                self.add(parts[: len(parts) // 2])
                self.add(parts[len(parts) // 2 :])
                return
            a = b = np.empty(0, dtype=np.int64)
        borders = np.cumsum([len(x.encode()) + 1 for x in parts])
        ends_a, ends_b = np.cumsum(self.lengths_a[a]), np.cumsum(self.lengths_b[b])
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        every = np.union1d(ends_a, ends_b)
        links = a[np.searchsorted(ends_a, every)] << LOW | b[np.searchsorted(ends_b, every)]
        counts = [np.diff(np.searchsorted(x, borders, "right"), prepend=0) for x in (ends_a, ends_b, both, every)]
        at = len(self.place)
        self.place.update(zip(parts, range(at, at + len(parts)), strict=True))
        self.groups += self.named(a, b, ends_a, ends_b, both, borders) if len(a) else [b""] * len(parts)
        self.numbers = np.hstack((self.numbers, [*counts[:3], np.full(len(parts), len(a) > 0)]))
        self.links = np.concatenate((self.links, links))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(counts[3])))

    def named(self, a, b, ends_a, ends_b, both, borders) -> list[bytes]:
        """The groups of each segment as text: ids of A, a bar, ids of B; groups are parted by semicolons."""
        group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        last_a, last_b = both[group_a] == ends_a, both[group_b] == ends_b
        border = borders[np.searchsorted(borders, ends_b)] == ends_b
        name = np.concatenate((a + self.most * last_a, b + self.most * np.where(border, 3, np.where(last_b, 2, 0))))
        order = np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")
        return b"".join(map(self.names.__getitem__, name[order].tolist())).split(b"\n")[:-1]

    def batch(self, bodies: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The places of all segments of the texts, and the edges of each text among them."""
        split = [segments(x) for x in bodies]
        every = list(itertools.chain.from_iterable(split))
        new = [x for x in dict.fromkeys(every) if x not in self.place]
        if new and len(self.place) + len(new) > CACHE:
            self.clear()
            new = list(dict.fromkeys(every))
        for i in range(0, len(new), STEP):
            self.add(new[i : i + STEP])
        where = np.fromiter(map(self.place.__getitem__, every), dtype=np.int64, count=len(every))
        return where, np.concatenate(([0], np.cumsum([len(x) for x in split], dtype=np.int64)))


def lengths(names: dict[int, bytes]) -> np.ndarray:
    out = np.zeros(max(names) + 1, dtype=np.int64)
    out[list(names)] = [len(x) for x in names.values()]
    return out


@functools.lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring ``edges``, also where nothing is between them."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[edges[1:]] - total[edges[:-1]]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all runs that begin at ``starts``, run after run."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, dtype=np.int64)
    return key[starts], np.add.reduceat(n, starts) if len(key) else n


def pair_counts(docs: DataFrame, text: str, path_a: str, path_b: str) -> DataFrame:
    """(block, key, n): how often each pair of ids is linked, added up within each task; the block is the task's."""

    def count(batches):
        align = aligner(path_a, path_b)
        keys, counts, held = [], [], 0
        for batch in batches:
            where, edges = align.batch(batch.column(0).to_pylist())
            good = sums(align.numbers[3][where], edges) == np.diff(edges)
            met, times = np.unique(where[np.repeat(good, np.diff(edges))], return_counts=True)
            size = np.diff(align.ends)[met]
            keys.append(align.links[spread(align.ends[met], size)])
            counts.append(np.repeat(times, size))
            held += len(keys[-1])
            if held > PAIRS:
                key, n = added(keys, counts)
                keys, counts, held = [key], [n], 0
                if len(key) > PAIRS // 2:
                    yield from rows(key, n)
                    keys, counts = [], []
        if keys:
            yield from rows(*added(keys, counts))

    def rows(key, n):
        for i in range(0, len(key), 1 << 16):
            yield pa.record_batch([pa.array(key[i : i + (1 << 16)]), pa.array(n[i : i + (1 << 16)])], names=["key", "n"])

    return docs.select(F.col(text)).mapInArrow(count, "key long, n long").withColumn("block", F.spark_partition_id())


def dealt(counts: DataFrame, shards: int) -> DataFrame:
    """``counts`` with the shard of each pair."""

    def deal(batches):
        for batch in batches:
            shard = shard_of(batch.column(0).to_numpy(), shards)
            yield pa.record_batch([pa.array(shard, pa.int32()), *batch.columns], names=["shard", "key", "n", "block"])

    return counts.select("key", "n", "block").mapInArrow(deal, "shard int, key long, n long, block int")


def hashed(counts: DataFrame, shards: int) -> ShardedHash:
    """A minimal perfect hash of each shard of the distinct keys, built in its own task."""

    def build(batch: pa.Table) -> pa.Table:
        found = MinimalHash.build(batch.column("key").to_numpy())
        columns = {"shard": batch.column("shard").slice(0, 1), "count": pa.array([found.count], pa.int64())}
        return pa.table(columns | {"levels": pa.array([found.levels], pa.list_(pa.binary()))})

    rows = counts.select("shard", "key").distinct().groupBy("shard").applyInArrow(build, "shard int, count long, levels array<binary>")
    found = {r["shard"]: MinimalHash([bytes(x) for x in r["levels"]], r["count"]) for r in rows.collect()}
    return ShardedHash([found.get(i, MinimalHash([], 0)) for i in range(shards)])


@dataclass
class PairTable:
    """Dense vectors indexed by the hash: the key at each place, its count, and whether it is its B id's highest."""

    hash: ShardedHash
    keys: np.ndarray
    counts: np.ndarray
    best: np.ndarray

    def look_up(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.hash.places(key)
        if not (self.keys[at] == key).all():
            raise KeyError("a pair was not counted in the first pass")
        return self.counts[at], self.best[at]


def dense_counts(counts: DataFrame, distinct: int) -> PairTable:
    """The counts of all pairs as vectors over a minimal perfect hash, added up in a tree.

    Each leaf turns the pairs of up to FAN tasks into a vector over one shard; every step adds up to FAN vectors of a
    shard, until one is left. A shard has about SHARD places, so no task holds more than FAN such vectors.
    """
    shards = max(1, -(-distinct // SHARD))
    counts = stage(dealt(counts, shards), "pairs-dealt")
    table = hashed(counts, shards)
    shared = counts.sparkSession.sparkContext.broadcast(table)

    def vector(batch: pa.Table, held: np.ndarray, total: np.ndarray) -> pa.Table:
        own = {c: batch.column(c).slice(0, 1) for c in ("shard", "node")}
        return pa.table(own | {"keys": pa.array([held.tobytes()], pa.binary()), "counts": pa.array([total.tobytes()], pa.binary())})

    def leaf(batch: pa.Table) -> pa.Table:
        first, end = shared.value.first[batch.column("shard")[0].as_py() :][:2]
        key = batch.column("key").to_numpy()
        at = shared.value.places(key) - first
        held, total = np.full(end - first, -1, dtype=np.int64), np.zeros(end - first, dtype=np.int64)
        held[at] = key
        np.add.at(total, at, batch.column("n").to_numpy())
        return vector(batch, held, total)

    def add(batch: pa.Table) -> pa.Table:
        held, total = (sum_of(batch.column(c), f) for c, f in (("keys", np.maximum), ("counts", np.add)))
        return vector(batch, held, total)

    def sum_of(column, together):
        rows = [np.frombuffer(x.as_py(), dtype=np.int64) for x in column]
        return functools.reduce(together, rows)

    types = "shard int, node int, keys binary, counts binary"
    up = lambda name: F.floor(F.col(name) / FAN).cast("int")
    level = stage(counts.withColumn("node", up("block")).groupBy("shard", "node").applyInArrow(leaf, types), "pairs-vectors")
    while (level.agg(F.max("node")).first()[0] or 0) > 0:
        level = stage(level.withColumn("node", up("node")).groupBy("shard", "node").applyInArrow(add, types), "pairs-vectors")
    keys, total = np.full(distinct, -1, dtype=np.int64), np.zeros(distinct, dtype=np.int64)
    for r in level.toLocalIterator():
        own = slice(*table.first[r["shard"] :][:2])
        keys[own], total[own] = np.frombuffer(r["keys"], dtype=np.int64), np.frombuffer(r["counts"], dtype=np.int64)
    low = keys & ((1 << LOW) - 1)
    highest = np.zeros(int(low.max(initial=0)) + 1, dtype=np.int64)
    np.maximum.at(highest, low, total)
    return PairTable(table, keys, total, total == highest[low])


def best_counts(counts: DataFrame) -> DataFrame:
    """(key, count, best) of each pair: the same as a `PairTable`, for more pairs than are sent to every task."""
    total = stage(counts.groupBy("key").agg(F.sum("n").alias("count")), "pairs-counted")
    low = F.col("key").bitwiseAND(F.lit((1 << LOW) - 1))
    highest = total.groupBy(low.alias("low")).agg(F.max("count").alias("highest"))
    return total.withColumn("low", low).join(highest, "low").select("key", "count", (F.col("count") == F.col("highest")).alias("best"))


def aligned(docs: DataFrame, key: str = "doc_id", text: str = "text", path_a: str | None = None, path_b: str | None = None, table: int = TABLE) -> DataFrame:
    """Per document: its tokens in A and B, the groups in which they agree, its links, and what the corpus says of them.

    A (a byte-level vocabulary of the library tokenizers) takes a space and the text, B (a sentencepiece model) the
    text. Tokens are byte ranges; offsets where both end cut them into groups, and tokens whose ranges overlap are
    linked. A pair of ids counts as many links as hold it in all documents. The first pass aligns all texts and adds
    equal pairs up within each task. The distinct pairs get a minimal perfect hash, a shard of them a task; counts
    become dense vectors over it that are added in a tree, with the keys beside them, against which every look-up is
    verified. The second pass aligns the texts again and looks their links up.

    The table has at most ``table`` pairs (17 bytes each, sent to every task). With more distinct pairs, the second
    pass shuffles each document's own distinct pairs to the counted ones instead, with the same result.

    Texts that are null or empty, or whose joined bytes differ from a space and the text in one of the two (such as
    those with U+2581), have no tokens: zeros, groups_sha256 '', and no part in any count. Rows that repeat an id are
    rows of their own. Other columns are ignored; an empty table gives no rows.

    Columns: the id, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of their B id), count_sum
    (their counts added up), groups_sha256.
    """
    spark = prepare(docs.sparkSession)
    path_a, path_b = path_a or public_path("byte_bpe_50k.json"), path_b or public_path("piece_bpe_32k.model")
    counts = stage(pair_counts(docs, text, path_a, path_b), "pairs")
    distinct = counts.agg(F.count_distinct("key")).first()[0]
    few = distinct <= table
    shared = spark.sparkContext.broadcast(dense_counts(counts, distinct)) if few else None
    types = f"`{key}` long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, " + ("n_best long, count_sum long" if few else "pairs array<struct<key:long,n:long>>")

    own = [key, "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    out_columns = [*own[:-1], "n_best", "count_sum", own[-1]]

    def align(batches):
        align = aligner(path_a, path_b)
        for batch in batches:
            where, edges = align.batch(batch.column(1).to_pylist())
            numbers = align.numbers
            good = (sums(numbers[3][where], edges) == np.diff(edges)) & (np.diff(edges) > 0)
            of = lambda values: pa.array(sums(values[where], edges) * good)
            bounds = list(zip(edges[:-1].tolist(), edges[1:].tolist(), good.tolist(), strict=True))
            groups = list(map(align.groups.__getitem__, where.tolist()))
            digests = [hashlib.sha256(b";".join(groups[a:b])).hexdigest() if ok else "" for a, b, ok in bounds]
            out = [batch.column(0), *map(of, numbers[:3]), of(np.diff(align.ends)), pa.array(digests, pa.string())]
            if few:
                # each segment is looked up once a batch; those of texts without tokens were not counted
                met = np.unique(where[np.repeat(good, np.diff(edges))])
                size = np.diff(align.ends)[met]
                n, best = shared.value.look_up(align.links[spread(align.ends[met], size)])
                at = np.concatenate(([0], np.cumsum(size)))
                n_best, total = np.zeros(len(align.groups), dtype=np.int64), np.zeros(len(align.groups), dtype=np.int64)
                n_best[met], total[met] = sums(best.astype(np.int64), at), sums(n, at)
                out += [of(n_best), of(total)]
                names = [*own, "n_best", "count_sum"]
            else:
                pairs = []
                for a, b, ok in bounds:
                    met, times = np.unique(where[a : b if ok else a], return_counts=True)
                    size = np.diff(align.ends)[met]
                    key, n = added([align.links[spread(align.ends[met], size)]], [np.repeat(times, size)])
                    pairs.append([{"key": k, "n": c} for k, c in zip(key.tolist(), n.tolist(), strict=True)])
                out.append(pa.array(pairs, pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())]))))
                names = [*own, "pairs"]
            yield pa.record_batch(out, names=names)

    rows = docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(align, types)
    if few:
        return rows.select(*out_columns)
    rows = stage(rows.withColumn("__row", F.monotonically_increasing_id()), "pairs-aligned")
    each = rows.select("__row", F.explode("pairs").alias("p")).select("__row", "p.key", "p.n")
    each = each.join(stage(best_counts(counts), "pairs-best"), "key")
    found = each.groupBy("__row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    return rows.join(found, "__row", "left").fillna(0, ["n_best", "count_sum"]).select(*out_columns)
