"""N-gram Jaccard join by partition enumeration: similar sets of a size band agree on one part of the domain."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import bit_table, has_bit, mixed, prepare, whole
from evidentia.llm.components import components
from evidentia.llm.features import BASE, code_points, word_hashes
from evidentia.session import stage

#: Signatures that a task looks at together, and from how many equal ones among them a signature counts as hot.
CHUNK = 2_000_000
HOT = 256
SALTS = 64
#: Sets and shingles that a block holds at most (but for the deal's unevenness), and shingles that a table holds at once.
BLOCK_SETS = 1024
BLOCK_SHINGLES = 1 << 22
WIDTH = 2048
#: Bytes of a shingle's hash that are kept for comparing sets.
WIDE = 6
#: Signatures of one bucket in all, and the least number of buckets.
BUCKET = 4_000_000
LEAST_BUCKETS = 64
#: Bits of the smallest sketch, and members of a group that are looked at in one task, pair by pair through their sketches.
BITS = 256
SMALL = 8192
#: Most bytes of the first sketch.
FIRST = 256
#: Parts a shingle of the finer sketch.
FINE = 4
#: Pairs that one copy of a center's set is compared in, and rounds of centers before groups are compared in blocks.
TOGETHER = 256
ROUNDS = 3


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` words, A-Z in lower case; of all words, if there are fewer."""
    points = code_points(text)
    points = np.where((points >= 65) & (points <= 90), points + np.uint32(32), points)
    words = word_hashes(points)
    if not len(words):
        return words
    n = min(n, len(words))
    h = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        h = h * BASE + words[i : len(words) - n + 1 + i]
    return np.unique(mixed(h))


def set_id(h: np.ndarray) -> int:
    total = (int(h.sum(dtype=np.uint64)) + len(h) * int(BASE)) % (1 << 64)
    return int(mixed(np.array([total], dtype=np.uint64))[0].view(np.int64))


@functools.cache
def bands(percent: int) -> tuple[list[int], list[int], list[int]]:
    """First size of each band, and for each band with the next: most differences of a similar pair, parts of the domain.

    Sets of similar size are in one band or in two that follow each other. A pair's differences are at most
    (100 - percent) / (100 + percent) of both sizes. With more parts than that, some part has no difference; with
    ``spare`` more of them, a pair that agrees only on empty parts has more than ``spare`` empty ones on both sides.
    """
    first, size = [], 1
    while size < 1 << 40:
        first.append(size)
        size = size * 100 // percent + 1
    last = [x - 1 for x in first[2:]]
    differ = [2 * x * (100 - percent) // (100 + percent) for x in last]
    return first, differ, [d + 1 + spare(d) for d in differ]


def spare(differ: int) -> int:
    return 0 if differ == 0 else 2 + (3 * differ) // 100


def signatures(h: np.ndarray, percent: int) -> np.ndarray:
    """What the set holds of each part of the domain, for its own band with the next and with the one before."""
    first, differ, parts = bands(percent)
    own = int(np.searchsorted(first, len(h), "right")) - 1
    out = []
    for band in (own - 1, own):
        if band < 0:
            continue
        n = parts[band]
        part = ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        sums = np.add.reduceat(mixed(h ^ BASE), starts)
        there = part[starts]
        place = mixed(np.uint64(band << 40) + there + np.uint64(1))
        out.append(mixed(sums + place * BASE))
        if n - len(starts) > spare(differ[band]):
            empty = np.setdiff1d(np.arange(n, dtype=np.uint64), there, assume_unique=True)
            out.append(mixed(np.uint64(band << 40) + empty + np.uint64(1)))
    return np.concatenate(out)


def sketch(h: np.ndarray, fine: int = 1) -> bytes:
    """For each part of the domain, whether an odd number of shingles falls into it; about ``fine`` parts a shingle.

    Where two sets' bits differ, at least one shingle is in one of them only, so there are no fewer such shingles than
    differing bits. With ``fine`` 1, a sketch takes about a fiftieth of its set, and FIRST bytes at most.
    """
    bits = max(BITS, 1 << (len(h) * fine * 3 // 4).bit_length())
    bits = min(bits, 8 * FIRST) if fine == 1 else bits
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: np.ndarray) -> np.ndarray:
    """Sketches of half as many parts."""
    half = bits.shape[1] // 2
    return bits[:, :half] ^ bits[:, half:]


def described(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """The id, size, identity and two sketches of each document's set."""

    def describe(batches):
        for batch in batches:
            sizes, ids, sketches, fine = [], [], [], []
            for body in batch.column(1).to_pylist():
                h = shingles(body, n)
                sizes.append(len(h))
                ids.append(set_id(h) if len(h) else None)
                sketches.append(sketch(h) if len(h) else None)
                fine.append(sketch(h, FINE) if len(h) else None)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(sketches, pa.binary()), pa.array(fine, pa.binary())]
            yield pa.record_batch(columns, names=[key, "n_shingles", "node", "sketch", "fine"])

    rows = docs.select(F.col(key), whole(text))
    return rows.mapInArrow(describe, f"`{key}` {rows.schema[0].dataType.simpleString()}, n_shingles long, node long, sketch binary, fine binary")


def packed(place: np.ndarray, node: np.ndarray, sig: np.ndarray | None, buckets: int) -> Iterator[tuple]:
    """Rows (bucket, first, steps, sets, at, sig) that hold the sorted places of each bucket.

    The places are told by their differences, each one's set by its number among the distinct ones of the row: about 9
    bytes a signature instead of 26, and nothing is lost.
    """
    order = np.argsort(place, kind="stable")
    place, node = place[order], node[order]
    bucket = bucket_of(place, buckets)
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(place) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        steps = np.diff(place[a:b], prepend=place[a])
        sets, at = np.unique(node[a:b], return_inverse=True)
        steps = steps.astype("<u4" if steps.max() < 1 << 32 else "<u8")
        at = at.astype("<u2" if len(sets) <= 1 << 16 else "<u4")
        names = sig[order[a:b]].tobytes() if sig is not None else None
        yield int(bucket[a]), int(place[a]), steps.tobytes(), sets.tobytes(), at.tobytes(), names


def unpacked_signatures(first: int, steps: bytes, sets: bytes, at: bytes, sig: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, sets and, of hot ones, signatures (-1 for others) of one row of `packed`."""
    sets = np.frombuffer(sets, dtype=np.int64)
    at = np.frombuffer(at, dtype="<u2" if len(sets) <= 1 << 16 else "<u4")
    steps = np.frombuffer(steps, dtype="<u4" if len(steps) == 4 * len(at) else "<u8")
    place = first + np.cumsum(steps.astype(np.int64))
    return place, sets[at], np.full(len(at), -1) if sig is None else np.frombuffer(sig, dtype=np.int64)


def bucket_of(place: np.ndarray, buckets: int) -> np.ndarray:
    return ((place >> 16) * buckets) >> 32


PACKED = "bucket int, first long, steps binary, sets binary, at binary, sig binary"


def signed(docs: DataFrame, text: str, n: int, percent: int, buckets: int) -> DataFrame:
    """Every signature of every set, once a task for equal sets, as rows of `packed`.

    The place is the signature. One that very many sets of a task share is hot and dealt over SALTS more places; the
    least of the sets stands in all of them and in the signature's own, so that the parts stay connected.
    """

    def sign(batches):
        met: set[int] = set()
        held: list[np.ndarray] = []
        nodes: list[np.ndarray] = []

        def rows():
            sig, node = np.concatenate(held), np.concatenate(nodes)
            order = np.lexsort((node, sig))
            sig, node = sig[order], node[order]
            starts = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
            counts = np.diff(np.append(starts, len(sig)))
            many = np.repeat(counts > HOT, counts)
            least = starts[counts > HOT]
            salts = np.tile(np.arange(SALTS + 1, dtype=np.int64), len(least))
            salt = np.concatenate((np.where(many, 1 + node % SALTS, 0), salts))
            hot = np.concatenate((many, np.ones(len(salts), dtype=bool)))
            sig, node = np.concatenate((sig, np.repeat(sig[least], SALTS + 1))), np.concatenate((node, np.repeat(node[least], SALTS + 1)))
            dealt_out = (mixed((sig ^ (salt << 50)).view(np.uint64)) >> np.uint64(16)).view(np.int64)
            place = np.where(salt > 0, dealt_out, sig)
            blocks = [*packed(place[~hot], node[~hot], None, buckets), *packed(place[hot], node[hot], sig[hot], buckets)]
            for i in range(0, len(blocks), 64):
                columns = list(zip(*blocks[i : i + 64], strict=True))
                types = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["bucket", "first", "steps", "sets", "at", "sig"])

        for batch in batches:
            for body in batch.column(0).to_pylist():
                h = shingles(body, n)
                node = set_id(h) if len(h) else None
                if node is None or node in met:
                    continue
                met.add(node)
                # 48 bits: sets that share a signature by chance are compared like others
                held.append((signatures(h, percent) >> np.uint64(16)).view(np.int64))
                nodes.append(np.full(len(held[-1]), node, dtype=np.int64))
            if sum(map(len, held)) >= CHUNK:
                yield from rows()
                held.clear()
                nodes.clear()
        if held:
            yield from rows()

    return docs.select(whole(text)).mapInArrow(sign, PACKED)


def wanted_sets(docs: DataFrame, nodes: DataFrame, text: str, n: int) -> DataFrame:
    """(node, shingles) of the sets in ``nodes``, and of few others: tasks look sets up in a table of fixed size.

    Equal sets of several tasks are there several times.
    """
    spark = docs.sparkSession
    table = bit_table(nodes.distinct(), "node")
    shared = spark.sparkContext.broadcast(table)

    def collect(batches):
        met: set[int] = set()
        for batch in batches:
            ids, sets = [], []
            for body in batch.column(0).to_pylist():
                h = shingles(body, n)
                node = set_id(h) if len(h) else None
                if node is None or node in met:
                    continue
                if has_bit(shared.value, np.array([node]))[0]:
                    met.add(node)
                    ids.append(node)
                    sets.append((h >> np.uint64(64 - 8 * WIDE)).view(np.uint8).reshape(-1, 8)[:, :WIDE].tobytes())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return docs.select(whole(text)).mapInArrow(collect, "node long, shingles binary")


def unpacked(x: bytes) -> np.ndarray:
    wide = np.zeros((len(x) // WIDE, 8), dtype=np.uint8)
    wide[:, :WIDE] = np.frombuffer(x, np.uint8).reshape(-1, WIDE)
    return wide.view(np.uint64).ravel()


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets are similar, by exact counts; ``sets`` has each node once.

    The set of u goes to v once a pair, the set of v once for each task that compares it: a v with very many pairs is
    dealt over several.
    """

    def compare(batches):
        center = None
        for batch in batches:
            good = []
            for u, v, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if u is None:
                    center = (v, body)
                    continue
                if center is None or center[0] != v:
                    raise ValueError(f"no set of {v}")
                b = center[1]
                size = len(body) // WIDE + len(b) // WIDE
                if len(body) * 100 < len(b) * percent or len(b) * 100 < len(body) * percent:
                    continue
                both = np.concatenate((unpacked(body), unpacked(b)))
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (size - common):
                    good.append((u, v))
            yield pa.record_batch([pa.array([x[i] for x in good], pa.int64()) for i in (0, 1)], names=["u", "v"])

    parts = stage(pairs.groupBy("v").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("parts")), "sets-centers")
    dealt_pairs = pairs.join(parts, "v").select("v", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int").alias("part"), "u")
    left = dealt_pairs.join(sets.withColumnRenamed("node", "u"), "u").select("u", "v", "shingles", "part")
    places = parts.select("v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = places.join(sets.withColumnRenamed("node", "v"), "v").select(F.lit(None).cast("long").alias("u"), "v", "shingles", "part")
    rows = left.unionByName(right).repartition("v", "part").sortWithinPartitions("v", "part", F.col("u").asc_nulls_first())
    return rows.drop("part").mapInArrow(compare, "u long, v long")


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """The id, n_shingles and component_id of every document: the least id that links of similar sets lead to.

    Equal sets are one node. Two sets of at least ``percent`` similarity share a signature (`bands`), so they meet in
    its group; groups with the same members are one, and members whose sketches rule out every other member leave it
    (`plausible`). Groups that overlap form a class. Where a class fits a block, its
    members are compared with each other within one task (`across`), and each set goes there once. Members of the
    groups of larger classes are first compared with one center each, in up to ROUNDS rounds (`stars`); where that
    leaves members of a group apart, with all others that they are apart from, in blocks (`dealt`). Blocks give links only,
    never pairs. So no link is lost that joins two components, and pairs within a component are not listed.
    Comparisons count the shared shingles.

    Documents without words have no shingles and are linked with nothing (a null text is one); fewer than ``n`` words
    are one shingle. Rows that repeat an id or a text are rows of their own with the same component. A null id counts
    in no least id. Other columns are ignored; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    rows = stage(described(docs, key, text, n), "sets")
    sizes = rows.filter("node is not null").groupBy("node").agg(F.max("n_shingles").alias("n"), F.min("sketch").alias("sketch"))
    # a set has fewer signatures than shingles and a few more
    most = rows.agg(F.sum(F.col("n_shingles") + 8)).first()[0] or 0
    shared = stage(gathered(signed(docs, text, n, percent, max(LEAST_BUCKETS, most // BUCKET))), "sets-shared")
    groups = stage(plausible(shared, stage(sizes, "sets-sizes"), percent), "sets-groups")
    # what is left is looked at again through sketches of several parts a shingle
    left = rows.join(groups.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.max("n_shingles").alias("n"), F.min("fine").alias("sketch"))
    left = stage(left, "sets-sizes")
    groups = stage(plausible(groups.select("sig", "node"), left, percent), "sets-groups")
    small, large = by_class(groups)
    links = stage(across(small, wanted_sets(docs, small.select("node"), text, n), percent), "sets-links")
    if not large.isEmpty():
        sets = stage(wanted_sets(docs, large.select("node"), text, n).dropDuplicates(["node"]), "sets-wanted")
        near, seen, known = None, None, large.select("node").distinct().withColumn("component", F.col("node"))
        for _ in range(ROUNDS):
            pairs = stage(stars(large, known, seen, percent), "sets-pairs")
            if pairs.isEmpty():
                break
            seen = pairs if seen is None else seen.unionByName(pairs)
            fresh = stage(linked(pairs, sets, percent), "sets-links")
            if fresh.isEmpty():
                break
            near = fresh if near is None else near.unionByName(fresh)
            known = stage(components(near), "sets-components")
        # only members that may be similar to one of another component are still to be compared
        apart = stage(plausible(members_by_component(large, known).select("sig", "node", "component"), left, percent), "sets-apart")
        more = stage(across(dealt(apart, known), sets, percent), "sets-links")
        links = links.unionByName(more) if near is None else links.unionByName(near).unionByName(more)
    found = stage(components(links), "sets-components")
    joined = rows.join(found, "node", "left").withColumn("group", F.coalesce("component", "node"))
    least = stage(joined.filter(F.col("group").isNotNull()).groupBy("group").agg(F.min(key).alias("component_id")), "sets-least")
    out = joined.join(least, "group", "left")
    return out.select(F.col(key), "n_shingles", F.coalesce("component_id", F.col(key)).alias("component_id"))


def gathered(signatures: DataFrame) -> DataFrame:
    """(sig, node) of the signatures that several sets share; signatures shared by the same sets become one.

    A signature dealt over salts keeps its own name, so that its parts stay one group.
    """

    def groups_of(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        place, node, sig = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((node, place))
        place, node, sig = place[order], node[order], sig[order]
        fresh = np.concatenate(([True], (place[1:] != place[:-1]) | (node[1:] != node[:-1])))
        starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        hot = np.maximum.reduceat(sig, starts)
        place, node = place[fresh], node[fresh]
        starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        sizes = np.diff(np.append(starts, len(place)))
        name = mixed(np.add.reduceat(mixed(node.view(np.uint64)), starts) + sizes.astype(np.uint64) * BASE).view(np.int64)
        several = sizes > 1
        # equal groups of other signatures are left out
        _, first = np.unique(np.where(several, np.where(hot >= 0, hot, name), 0), return_index=True)
        keep = np.zeros(len(starts), dtype=bool)
        keep[first] = True
        # a salted part shares its name with other parts, which may hold other sets
        keep = (keep | (hot >= 0)) & several
        rows = np.repeat(keep, sizes)
        return np.repeat(np.where(hot >= 0, hot, name), sizes)[rows], node[rows]

    def gather(batches):
        now, parts = None, []

        def done():
            sig, node = groups_of(parts)
            for i in range(0, len(sig), 1 << 16):
                yield pa.record_batch([pa.array(sig[i : i + (1 << 16)]), pa.array(node[i : i + (1 << 16)])], names=["sig", "node"])

        for batch in batches:
            for bucket, *row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if bucket != now:
                    if parts:
                        yield from done()
                    now, parts = bucket, []
                parts.append(unpacked_signatures(*row))
        if parts:
            yield from done()

    rows = signatures.repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(gather, "sig long, node long").distinct()


def plausible(shared: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(sig, node, n): the groups, cut to members that other members may be similar to, directly or over others.

    Two sets differ by at least as many shingles as their sketches differ by bits. Where that is more than similar sets
    of their sizes may differ by, they are not similar, so no link is lost. What is left of several groups is named by
    its members, so that it is there once. A group of over SMALL members is cut into blocks, and each block meets every
    other one in a group of its own, so that no task holds a large group. Where ``shared`` has a component, members of
    one component do not count for each other.
    """

    def near(members: list[tuple]) -> list[tuple]:
        width = np.array([len(m[2]) for m in members])
        size = np.array([m[1] for m in members])
        part_of = np.array([m[3] for m in members])
        label = np.arange(len(members))
        for w in np.unique(width).tolist():
            # similar sets have sketches of one size, or of two that follow each other
            own, twice = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
            both = np.concatenate((own, twice))
            bits = [np.frombuffer(b"".join([members[i][2] for i in x]), dtype=np.uint64).reshape(len(x), k * w // 8) for k, x in ((1, own), (2, twice))]
            x = np.concatenate((bits[0], folded(bits[1])))
            order = np.argsort(size[both], kind="stable")
            x, both, single = x[order], both[order], order < len(own)
            n, component = size[both], part_of[both]
            # sizes that a similar set may have are a stretch of the sorted ones
            first, last = np.searchsorted(n * 100, n * percent), np.searchsorted(n * percent, n * 100, "right")
            for i in np.flatnonzero(single).tolist():
                a, b = int(first[i]), int(last[i])
                apart = np.bitwise_count(x[a:b] ^ x[i]).sum(axis=1, dtype=np.int64)
                good = (apart * (100 + percent) <= (100 - percent) * (n[i] + n[a:b])) & (component[a:b] != component[i])
                met = np.unique(label[both[a:b][good]])
                met = met[met != label[both[i]]]
                if len(met):
                    label[np.isin(label, met)] = label[both[i]]
        order = np.argsort(label, kind="stable")
        starts = np.flatnonzero(np.diff(label[order], prepend=-1))
        counts = np.diff(np.append(starts, len(order)))
        nodes = np.array([m[0] for m in members], dtype=np.int64)[order]
        name = mixed(np.add.reduceat(mixed(nodes.view(np.uint64)), starts) + counts.astype(np.uint64) * BASE).view(np.int64)
        several = np.repeat(counts > 1, counts)
        return list(zip(np.repeat(name, counts)[several].tolist(), nodes[several].tolist(), size[order][several].tolist(), strict=True))

    def look(batches):
        now, members = None, []
        out: list[tuple] = []

        def batch_of(rows):
            return pa.record_batch([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["sig", "node", "n"])

        for batch in batches:
            for sig, a, b, *member in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if (sig, a, b) != now:
                    out += near(members) if len(members) > 1 else []
                    now, members = (sig, a, b), []
                members.append(member)
            yield batch_of(out)
            out = []
        if len(members) > 1:
            yield batch_of(near(members))

    large = shared.groupBy("sig").agg(F.ceil(F.count("*") / SMALL).cast("int").alias("cut")).filter("cut > 1")
    component = F.col("component") if "component" in shared.columns else F.col("node").alias("component")
    rows = shared.join(sizes, "node").select("sig", "node", "n", "sketch", component)
    if large.isEmpty():
        rows = rows.select("sig", F.lit(0).alias("a"), F.lit(0).alias("b"), "node", "n", "sketch", "component")
    else:
        rows = rows.join(large, "sig", "left").withColumn("cut", F.coalesce("cut", F.lit(1)))
        own = F.pmod(F.xxhash64("node"), F.col("cut")).cast("int")
        met = F.transform(F.sequence(F.lit(0), F.col("cut") - 1), lambda x: F.struct(F.greatest(x, own).alias("a"), F.least(x, own).alias("b")))
        rows = rows.withColumn("at", F.explode(met)).select("sig", "at.a", "at.b", "node", "n", "sketch", "component")
    rows = rows.repartition("sig", "a", "b").sortWithinPartitions("sig", "a", "b")
    return rows.mapInArrow(look, "sig long, node long, n long").distinct()


def by_class(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (sig, a, b, node, component) of the classes that fit a block, and the groups of the other classes.

    The groups (sig, node, n, company) of a class become one where its sets then travel less: a set is sent once for
    each of its groups, or once for each block of its class. A node's company is the sum of the sizes of its groups.
    """
    least = groups.groupBy("sig").agg(F.min("node").alias("v"))
    classes = components(groups.join(least, "sig").select(F.col("node").alias("u"), "v"))
    sizes = groups.groupBy("node").agg(F.max("n").alias("n"))
    classes = stage(classes.join(sizes, "node").withColumnRenamed("component", "class"), "sets-classes")
    fits = classes.groupBy("class").agg((blocks(F.count("*"), F.sum("n")) == 1).alias("fits"))
    classes = stage(classes.join(fits, "class"), "sets-classes")
    small = classes.filter("fits").select(F.col("class").alias("sig"), F.lit(0).alias("a"), F.lit(0).alias("b"), "node", F.col("node").alias("component"))
    large = stage(groups.join(classes.filter("not fits").select("node", "class"), "node"), "sets-large")
    met = large.join(large.groupBy("sig").agg(F.count("*").alias("size")), "sig")
    sets = stage(met.groupBy("class", "node").agg(F.max("n").alias("n"), F.sum("size").alias("company"), F.count("*").alias("times")), "sets-large")
    cost = sets.groupBy("class").agg((blocks(F.count("*"), F.sum("n")) * F.count("*") < F.sum("times")).alias("whole"))
    cost = stage(cost, "sets-classes")
    whole = sets.join(cost.filter("whole"), "class").select(F.xxhash64(F.lit("class"), "class").alias("sig"), "node", "n", "company")
    rest = large.join(cost.filter("not whole"), "class").join(sets.select("node", "company"), "node")
    return small, stage(whole.unionByName(rest.select("sig", "node", "n", "company")), "sets-large")


def blocks(count: Column, n: Column) -> Column:
    """How many blocks ``count`` sets with ``n`` shingles in all make."""
    return F.ceil(F.greatest(count / BLOCK_SETS, n / BLOCK_SHINGLES)).cast("int")


def close(percent: int) -> Column:
    """Sizes n and m that similar sets can have."""
    return (F.col("n") * 100 >= F.col("m") * percent) & (F.col("m") * 100 >= F.col("n") * percent)


def members_by_component(groups: DataFrame, found: DataFrame) -> DataFrame:
    """``groups`` with the component of each node, itself where ``found`` has none."""
    return groups.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def stars(groups: DataFrame, found: DataFrame, seen: DataFrame | None, percent: int) -> DataFrame:
    """Pairs (u, v): each member that is apart from the center of some group, with one such center.

    A group's center is the one of its largest component that has most company in all its groups: the text that others
    were copied from is close to all of them, while two copies with changes of their own need not be close to each
    other. Of several centers a member takes the one with most company that it was not compared with before, so a round
    sends each set once, and most links of large groups are found in the first.
    """
    member = stage(members_by_component(groups, found), "sets-company")
    parts = member.groupBy("sig", "component").agg(F.count("*").alias("count"), F.max(F.struct("company", "node", "n")).alias("best"))
    center = parts.groupBy("sig").agg(F.max(F.struct("count", "best", "component")).alias("top"))
    center = center.select("sig", F.col("top.best.node").alias("v"), F.col("top.best.n").alias("m"), F.col("top.component").alias("of"), F.col("top.best.company").alias("c"))
    both = member.select("sig", F.col("node").alias("u"), "n", "component").join(center, "sig").filter("component != of").filter(close(percent))
    both = both.select("u", "v", "c").distinct()
    if seen is not None:
        both = both.join(seen, ["u", "v"], "left_anti")
    return both.groupBy("u").agg(F.max(F.struct("c", "v")).alias("best")).select("u", F.col("best.v").alias("v"))


def merged(member: DataFrame) -> DataFrame:
    """The groups of more than one component; those of a class become one group where its sets then travel less.

    A set is sent once for each of its groups, or once for each block of its class. Groups that overlap a lot, as those
    of many changed copies of a text do, make a class of few blocks.
    """
    open_ = member.groupBy("sig").agg(F.min("node").alias("v"), F.min("component").alias("low"), F.max("component").alias("high"))
    rows = stage(member.join(open_.filter("low < high").select("sig", "v"), "sig"), "sets-open")
    classes = components(rows.select(F.col("node").alias("u"), "v")).withColumnRenamed("component", "class")
    rows = stage(rows.drop("v").join(classes, "node"), "sets-open")
    sets = rows.groupBy("class", "node").agg(F.max("n").alias("n"), F.max("component").alias("component"), F.count("*").alias("times"))
    cost = sets.groupBy("class").agg((blocks(F.count("*"), F.sum("n")) * F.count("*") < F.sum("times")).alias("whole"))
    cost = stage(cost, "sets-classes")
    whole = sets.join(cost.filter("whole"), "class").select(F.xxhash64(F.lit("class"), "class").alias("sig"), "node", "n", "component")
    return whole.unionByName(rows.join(cost.filter("not whole"), "class").select("sig", "node", "n", "component"))


def dealt(groups: DataFrame, found: DataFrame) -> DataFrame:
    """(sig, a, b, node, component): members of groups that `stars` left apart, in the blocks where they are compared.

    Groups that overlap a lot are one (`merged`). Members outside a group's largest component are compared with all
    others, those in it only with them. A group that is too large for one block is cut into blocks of both kinds, and each
    block of the first kind meets every other block in a task of its own.
    """
    member = stage(merged(stage(members_by_component(groups, found), "sets-members")), "sets-members")
    parts = member.groupBy("sig", "component").agg(F.count("*").alias("count"), F.sum("n").alias("n"))
    open_ = parts.groupBy("sig").agg(F.max(F.struct("count", "component", "n")).alias("top"), F.sum("count").alias("count"), F.sum("n").alias("n"), F.count("*").alias("parts"))
    open_ = open_.filter("parts > 1").select(
        "sig",
        F.col("top.component").alias("largest"),
        (blocks(F.col("count"), F.col("n")) == 1).alias("small"),
        blocks(F.col("top.count"), F.col("top.n")).alias("inner"),
        blocks(F.col("count") - F.col("top.count"), F.col("n") - F.col("top.n")).alias("outer"),
    )
    rows = member.join(open_, "sig").withColumn("inside", F.col("component") == F.col("largest"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("inside"), F.col("inner")).otherwise(F.col("outer"))).cast("int")
    rows = rows.withColumn("own", own)
    # blocks of the largest component have the numbers -1, -2, ...
    with_outer = F.transform(F.sequence(F.lit(0), F.col("outer") - 1), lambda x: F.struct(F.greatest(x, "own").alias("a"), F.least(x, "own").alias("b")))
    with_inner = F.transform(F.sequence(F.lit(1), F.col("inner")), lambda x: F.struct(F.col("own").alias("a"), (-x).alias("b")))
    from_inner = F.transform(F.sequence(F.lit(0), F.col("outer") - 1), lambda x: F.struct(x.alias("a"), (-1 - F.col("own")).alias("b")))
    alone = F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))
    places = F.when(F.col("small"), alone).when(F.col("inside"), from_inner).otherwise(F.concat(with_outer, with_inner))
    return rows.select("sig", F.explode(places).alias("at"), "node", "component").select("sig", "at.a", "at.b", "node", "component")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets share: products of 0/1 tables of the shingles that several sets have."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = counts > 1
    place = np.cumsum(several) - 1
    keep = several[column]
    owner, column = owner[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float64)
    for first in range(0, int(several.sum()), WIDTH):
        i, j = np.searchsorted(column, (first, first + WIDTH))
        table = np.zeros((len(sets), min(WIDTH, int(several.sum()) - first)), dtype=np.float32)
        table[owner[i:j], column[i:j] - first] = 1
        out += table @ table.T
    return out


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the symmetric table ``near`` connects, fewer than it has rows."""
    out, fresh = [], np.ones(len(near), dtype=bool)
    for root in np.flatnonzero(near.any(axis=1)):
        if not fresh[root]:
            continue
        fresh[root] = False
        todo = [root]
        while todo:
            x = todo.pop()
            met = np.flatnonzero(near[x] & fresh)
            fresh[met] = False
            out += [(x, y) for y in met]
            todo += list(met)
    return out


def across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between members of one block pair that are similar and in different components, none superfluous."""

    def links_of(nodes: list[int], components: list[int], held: list[bytes]) -> list[tuple[int, int]]:
        found = [unpacked(x) for x in held]
        size = np.array([len(x) for x in found])
        common = shared_counts(found)
        component = np.array(components)
        near = (100 * common >= percent * (size[:, None] + size[None, :] - common)) & (component[:, None] != component[None, :])
        return [(max(nodes[x], nodes[y]), min(nodes[x], nodes[y])) for x, y in forest(near)]

    def compare(batches):
        now, groups, held = None, [], {}
        out: list[tuple[int, int]] = []

        def batch_of(links):
            return pa.record_batch([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["u", "v"])

        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            for key, node, component, body in zip(keys, *(batch.column(i).to_pylist() for i in range(3, 6)), strict=True):
                if key != now:
                    if len(held) > 1:
                        out += links_of(list(held), groups, list(held.values()))
                    now, groups, held = key, [], {}
                if node not in held:
                    groups.append(component)
                    held[node] = body
            yield batch_of(out)
            out = []
        if len(held) > 1:
            yield batch_of(links_of(list(held), groups, list(held.values())))

    rows = members.join(sets, "node").select("sig", "a", "b", "node", "component", "shingles")
    rows = rows.repartition("sig", "a", "b").sortWithinPartitions("sig", "a", "b")
    return rows.mapInArrow(compare, "u long, v long").distinct()


def without_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of similar ones, the one with the least id; all columns unchanged.

    Rows that share an id are one document.
    """
    groups = stage(similar_groups(docs, key, text, n, percent), "near-groups")
    gone = groups.filter(~F.col("component_id").eqNullSafe(F.col(key))).select(F.col(key).alias("__id")).distinct()
    return docs.join(stage(gone, "near-gone"), F.col(key).eqNullSafe(F.col("__id")), "left_anti")
