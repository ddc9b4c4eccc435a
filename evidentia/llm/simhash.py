"""SimHash near-duplicates: an inverted index over byte positions, with count filtering."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import joined_evenly, perhaps_in, prepare, texts, whole
from evidentia.llm.components import components
from evidentia.session import stage

#: Bytes of a fingerprint, and members that are tallied pair by pair in one list.
WIDTH = 8
LIST = 512
SEED = 42


def fingerprint(body: bytes, n: int = 3) -> int:
    """The bits that over half the hashes of the runs of ``n`` words have, A-Z in lower case; 0 without words."""
    words = body.lower().split()
    if not words:
        return 0
    n = min(n, len(words))
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - n + 1].tolist()
    ends = ends[n - 1 :].tolist()
    hashed = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(starts), 1 << 16):
        block = zip(starts[i : i + (1 << 16)], ends[i : i + (1 << 16)], strict=True)
        h = np.array([hashed(line[a:b], SEED) for a, b in block], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, WIDTH), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(starts), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """The id of each row and its fingerprint ``fp``, as a signed 64-bit number."""

    def mark(batches):
        for batch in batches:
            found = np.array([fingerprint(x, n) for x in texts(batch.column(1))], dtype=np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], names=[key, "fp"])

    rows = docs.select(F.col(key), whole(text))
    return rows.mapInArrow(mark, f"`{key}` {rows.schema[0].dataType.simpleString()}, fp long")


def mask(positions: tuple[int, ...]) -> int:
    """The bits of the bytes at ``positions``, as a signed number."""
    bits = sum(0xFF << (8 * p) for p in positions)
    return bits - (1 << 64) if bits >> 63 else bits


def coarse(differ: int) -> list[tuple[int, ...]]:
    """Sets of positions such that, of two fingerprints with ``differ`` unlike bytes, some set is alike in both.

    The positions are dealt over ``differ`` + 2 parts; at least two parts are alike, so each two parts are a set.
    """
    parts = [tuple(range(WIDTH))[i :: differ + 2] for i in range(differ + 2)]
    return [tuple(sorted(a + b)) for a, b in combinations(parts, 2)]


def postings(fps: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    """(fp, place): each fingerprint in the list of its bytes at each set of positions."""
    place = [F.xxhash64(F.lit(mask(s)), F.col("fp").bitwiseAND(F.lit(mask(s)))) for s in sets]
    return fps.select("fp", F.explode(F.array(*place)).alias("place"))


def finer(rows: DataFrame, differ: int) -> DataFrame:
    """(fp, place): members of long lists, dealt over lists that share the guaranteed number of bytes.

    So many shared bytes leave 8 * ``differ`` bits, which bounds a list: 65,536 fingerprints for two.
    """
    return postings(rows.select("fp").distinct(), list(combinations(range(WIDTH), WIDTH - differ)))


def tallied(members: np.ndarray, differ: int) -> list[tuple[int, int]]:
    """Links of a short list: pairs that share at least 8 - ``differ`` positional bytes, then verified bit by bit."""
    each = members.view(np.uint8).reshape(-1, WIDTH)
    shared = np.zeros((len(each), len(each)), dtype=np.uint8)
    for p in range(WIDTH):
        shared += each[:, None, p] == each[None, :, p]
    u, v = np.nonzero(np.triu(shared >= WIDTH - differ, 1))
    near = np.bitwise_count((members[u] ^ members[v]).view(np.uint64)) <= differ
    return joining(len(members), u[near], v[near])


def probed(members: np.ndarray, differ: int) -> list[tuple[int, int]]:
    """Links of a list of any length whose members all share 8 - ``differ`` bytes: every near value is looked up."""
    members = np.sort(members.view(np.uint64))
    free = np.bitwise_or.reduce(members ^ members[0])
    bits = [np.uint64(1 << i) for i in range(64) if int(free) >> i & 1]
    steps = [np.bitwise_or.reduce(np.array(s, dtype=np.uint64)) for k in range(1, differ + 1) for s in combinations(bits, k)]
    edges = []
    for step in steps:
        want = members ^ step
        at = np.minimum(np.searchsorted(members, want), len(members) - 1)
        hit = np.flatnonzero((members[at] == want) & (want > members))
        edges.append((hit, at[hit]))
    u, v = (np.concatenate([e[i] for e in edges]) for i in (0, 1))
    return joining(len(members), u, v)


def joining(count: int, u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """Fewer than ``count`` pairs of places that connect what the links ``u``-``v`` connect: each place and its least."""
    least = np.arange(count)
    while True:
        before = least.copy()
        np.minimum.at(least, u, before[v])
        np.minimum.at(least, v, before[u])
        least = least[least]
        if (least == before).all():
            break
    moved = np.flatnonzero(least != np.arange(count))
    return list(zip(moved.tolist(), least[moved].tolist(), strict=True))


def linked(rows: DataFrame, differ: int) -> DataFrame:
    """Links (u, v) that connect the members of each list of ``rows`` (fp, place) as their near pairs do."""

    def links_of(members: list[int]) -> tuple[list[int], list[int]]:
        held = np.array(members, dtype=np.int64)
        if len(held) <= LIST:
            found = tallied(held, differ)
        else:
            held = np.sort(held.view(np.uint64)).view(np.int64)
            found = probed(held, differ)
        return [int(held[x]) for x, _ in found], [int(held[y]) for _, y in found]

    def walk(batches):
        now, members = None, []
        for batch in batches:
            u, v = [], []
            for fp, place in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                if place != now:
                    if len(members) > 1:
                        a, b = links_of(members)
                        u, v = u + a, v + b
                    now, members = place, []
                members.append(fp)
            yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
        if len(members) > 1:
            a, b = links_of(members)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["u", "v"])

    rows = rows.select("fp", "place").repartition("place").sortWithinPartitions("place", "fp")
    return rows.mapInArrow(walk, "u long, v long").distinct()


def near_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, differ: int = 2) -> DataFrame:
    """The id, fingerprint (16 hexadecimal digits) and component_id of every row: the least id its links lead to.

    Two fingerprints link when at most ``differ`` (1 or 2) bits differ. Then at most as many of their 8 bytes do, so
    they share at least 8 - ``differ`` positional bytes. The inverted index holds each distinct fingerprint once for
    each set of positions of `coarse`: a list's members share those bytes. A list of up to LIST members is tallied pair
    by pair over all positions; pairs that reach the guaranteed number are verified by their bits. Longer lists are
    dealt over finer ones whose members share the guaranteed number already; these are bounded by the bits that are
    left, and every value within ``differ`` bits of a member is looked up in them, so no list is ever compared whole
    with itself and none is cut. Lists yield as many links as connect them, not all pairs.

    A text without words (also null or empty) has the fingerprint 0 and is linked like any other. Rows that repeat an
    id are rows of their own. A null id counts in no least id; a component of null ids only has a null one. Other
    columns are ignored; an empty table gives no rows.
    """
    if differ not in (1, 2):
        raise ValueError("differ must be 1 or 2")
    prepare(docs.sparkSession)
    rows = stage(fingerprints(docs, key, text, n), "simhash-rows")
    fps = stage(rows.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("rows")), "simhash-distinct")
    index = postings(fps, coarse(differ))
    long_ = stage(index.groupBy("place").agg(F.count("*").alias("n")).filter(F.col("n") > LIST).select("place"), "simhash-long")
    if long_.isEmpty():
        links = linked(index, differ)
    else:
        is_long: Column = perhaps_in(long_, "place")("place")
        index = stage(index.withColumn("long", is_long), "simhash-index")
        links = linked(index.filter("not long"), differ).unionByName(linked(finer(index.filter("long"), differ), differ))
    found = components(stage(links, "simhash-links")).withColumnRenamed("node", "fp")
    known = stage(fps.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "simhash-components")
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stage(known.join(least, "component").select("fp", "component_id", "rows"), "simhash-named")
    out = joined_evenly(rows, named, "fp", "rows")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select(F.col(key), digits.alias("fingerprint"), "component_id")
