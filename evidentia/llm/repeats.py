"""Repeated byte strings across a corpus: sorted runs of suffixes at anchors, front-coded, exchanged and merged."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import mixed, perhaps_in, prepare, texts, whole
from evidentia.llm.features import _powers
from evidentia.llm.runs import common, front_code, merge
from evidentia.session import stage

#: Bytes of a text that are looked at together; windows that cross the border are looked at once.
PIECE = 1 << 22
#: An anchor's string with more different surroundings than this is resolved by counting hashes of its windows.
HOT = 32
#: Suffixes that one merge is planned for.
MERGE = 20_000


class Hashes:
    """Hashes of any stretch of bytes in constant time."""

    def __init__(self, data: np.ndarray):
        # powers of a rounded-up length, so that few tables are ever made
        self.up, self.down = _powers(1 << max(len(data), 1).bit_length())
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)])))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


def least_from(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row, by running minima of blocks from both sides."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(body: bytes, length: int, gram: int):
    """Places that are chosen by content: of each ``length``-byte window, the start of its first least ``gram``.

    Equal windows have their anchor at the same place. Yields for each piece of the text arrays: anchor, least and most
    distance of a window's start before it, hash of the gram, hash of all that its windows cover; with the piece's
    hashes and offset.
    """
    for offset in range(0, max(len(body) - length + 1, 0), PIECE):
        data = np.frombuffer(body, np.uint8)[offset : offset + PIECE + length - 1]
        hashes = Hashes(data)
        at = np.arange(len(data) - gram + 1)
        grams = hashes.of(at, at + gram)
        # the place in the low bits: the first of equal grams is the least
        key = (grams & np.uint64(0xFFFFFFFFFF000000)) | at.astype(np.uint64)
        chosen = (least_from(key, length - gram + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
        last = np.append(first[1:], len(chosen)) - 1
        a = chosen[first]
        spans = hashes.of(first, last + length) + mixed((a - first).astype(np.uint64) * np.uint64(1 << 20) + (last - first).astype(np.uint64))
        yield offset, hashes, a, a - last, a - first, grams[a], spans


def anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, a, x, y, gram, span) of every anchor; windows start x to y bytes before a."""
    names = ["key", "a", "x", "y", "gram", "span"]

    def find(batches):
        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                for offset, _, a, x, y, g, h in anchors(body, length, gram):
                    columns = [np.full(len(a), key), a + offset, x.astype(np.int32), y.astype(np.int32), g.view(np.int64), h.view(np.int64)]
                    yield pa.record_batch([pa.array(c) for c in columns], names=names)

    return docs.mapInArrow(combined(find), "key long, a long, x int, y int, gram long, span long")


def combined(rows, most: int = 100_000):
    """Hand on small batches joined together."""

    def run(batches):
        held, size = [], 0
        for batch in rows(batches):
            held.append(batch)
            size += batch.num_rows
            if size >= most:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def surroundings(asked: DataFrame, length: int, buckets: int) -> DataFrame:
    """Sorted runs of the suffixes at the asked anchors: a row per task and bucket of grams.

    ``asked`` has key, text and ``at``: an array of (a, x, y, gram). A row holds the front-coded suffixes (from the
    anchor to the end of its last window) in order, and with them what stands before each anchor, backwards.
    """
    names = ["bucket", "run", "left", "key", "a", "x", "y"]

    def sort(batches):
        held: dict[int, list] = {}
        size = 0

        def runs():
            for bucket, rows in held.items():
                rows.sort(key=lambda r: r[0])
                _, left, key, a, x, y = zip(*rows, strict=True)
                yield pa.record_batch([pa.array([bucket], pa.int32()), pa.array([front_code([r[0] for r in rows])], pa.binary()), pa.array([left], pa.list_(pa.binary())), *[pa.array([c], pa.list_(pa.int64())) for c in (key, a, x, y)]], names=names)

        for batch in batches:
            for key, body, at in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                for p in at:
                    a, x, y = p["a"], p["x"], p["y"]
                    held.setdefault(p["gram"] % buckets, []).append((body[a : a - x + length], body[a - y : a][::-1], key, a, x, y))
                    size += length + y
            if size > 1 << 25:
                yield from runs()
                held, size = {}, 0
        yield from runs()

    types = "bucket int, run binary, left array<binary>, key array<long>, a array<long>, x array<long>, y array<long>"
    return asked.mapInArrow(sort, types)


def resolved(runs: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, start, end): bytes covered by windows that two of the suffixes in one bucket share."""

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        members: list[tuple] = []  # left, key, a, x, y of the suffixes that share the gram, in order
        shared: list[int] = []  # with the suffix before
        place = [0] * len(group)
        columns = [group[c].to_list() for c in ("left", "key", "a", "x", "y")]

        def close() -> None:
            for i, (left, key, a, x, y) in enumerate(members):
                right = length
                for j in range(i + 1, len(members)):
                    right = min(right, shared[j])
                    left2, key2, a2, x2, y2 = members[j]
                    low, high = max(x, x2, length - right), min(y, y2)
                    if low <= high:
                        high = min(high, common(left, left2))
                        if low <= high:
                            out.append((key, a - high, a - low + length))
                            out.append((key2, a2 - high, a2 - low + length))

        for run, _, common_with_last in merge(group["run"].to_list()):
            if common_with_last < gram:
                close()
                members, shared = [], []
            members.append(tuple(c[run][place[run]] for c in columns))
            shared.append(common_with_last)
            place[run] += 1
        close()
        return pd.DataFrame(out, columns=["key", "start", "end"], dtype="int64")

    return runs.groupBy("bucket").applyInPandas(meet, "key long, start long, end long")


def window_hashes(asked: DataFrame, length: int) -> DataFrame:
    """(window, key, start): the hash of every window at the asked anchors."""

    def windows(batches):
        for batch in batches:
            for key, body, at in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                for p in at:
                    first, last = p["a"] - p["y"], p["a"] - p["x"]
                    hashes = Hashes(np.frombuffer(body[first : last + length], np.uint8))
                    start = np.arange(last - first + 1)
                    yield pa.record_batch([pa.array(hashes.of(start, start + length).view(np.int64)), pa.array(np.full(len(start), key)), pa.array(start + first)], names=["window", "key", "start"])

    return asked.mapInArrow(combined(windows), "window long, key long, start long")


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """(key, spans) of the texts that hold repeated bytes: ``spans`` are maximal sorted (start, end) of bytes covered by

    a ``length``-byte string that also starts elsewhere in ``docs`` (key, text).

    A text's windows are dealt over anchors chosen by content, so equal windows meet at anchors with an equal gram. An
    anchor whose whole stretch of windows occurs twice is decided by a count, one whose gram occurs once likewise. Only
    for the others are suffixes sorted: tasks send front-coded sorted runs, and each bucket of grams merges its runs by
    a loser tree that never compares known prefixes; suffixes that share a gram then stand side by side, and what
    two of them share on both sides gives the windows that they share. Grams with very many different surroundings
    (a passage in a great many texts) are resolved by counting hashes of their windows, in any number of tasks.
    """
    gram = length // 4
    rows = stage(anchor_rows(docs, length, gram), "repeats-anchors")
    kinds = rows.groupBy("gram", "span").agg(F.count("*").alias("n"), F.min(F.struct("key", "a", "x", "y")).alias("one"))
    kinds = stage(kinds, "repeats-kinds")
    several = stage(kinds.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "repeats-several")
    twice = kinds.filter("n > 1").select("gram", "span")
    sure = rows.join(twice, ["gram", "span"]).select("key", (F.col("a") - F.col("y")).alias("start"), (F.col("a") - F.col("x") + length).alias("end"))

    places = kinds.join(several, "gram").select("one.*", "gram", (F.col("kinds") > HOT).alias("hot"))
    places = places.groupBy("key").agg(F.collect_set(F.struct("a", "x", "y", "gram", "hot")).alias("at"))
    places = stage(places, "repeats-places")
    asked = docs.filter(perhaps_in(places, "key")("key")).join(places, "key").select("key", "text", "at")
    asked = stage(asked, "repeats-asked")
    few = asked.withColumn("at", F.filter("at", lambda p: ~p["hot"]))
    many = asked.withColumn("at", F.filter("at", lambda p: p["hot"])).filter(F.size("at") > 0)
    total = several.filter(F.col("kinds") <= HOT).agg(F.sum("kinds")).first()[0] or 0
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // MERGE))
    merged = resolved(surroundings(few, length, buckets), length, gram)
    windows = stage(window_hashes(many, length), "repeats-windows")
    again = windows.groupBy("window").count().filter("count > 1").select("window")
    found = sure.unionByName(merged).unionByName(windows.join(again, "window").select("key", "start", (F.col("start") + length).alias("end")))
    # a text's own spans only, so no group outgrows its text
    return found.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))


def united(spans: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in spans:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400) -> DataFrame:
    """Every text without the bytes that a repeated string of ``length`` bytes covers, as UTF-8 bytes.

    All occurrences go, the first included; strings do not cross documents. Texts that are null count as empty; shorter
    ones than ``length`` stay whole. Rows that repeat an id and a text are occurrences of their own. What is left need
    not be valid UTF-8. Other columns are ignored; an empty table gives no rows.

    Columns: the id, n_bytes, n_removed, n_spans, spans (start, end), kept (binary).
    """
    prepare(docs.sparkSession)
    body = whole(text)
    keyed = docs.select(F.col(key).alias("id"), F.xxhash64(F.col(key), body).alias("key"), body.alias("text"))
    spans = stage(repeated_spans(keyed.select("key", "text"), length), "repeats-spans")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches):
        for batch in batches:
            removed, all_spans, kept = [], [], []
            for data, found in zip(texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                one = united([(s["start"], s["end"]) for s in found or []])
                edges = [0, *[x for s in one for x in s], len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                removed.append(sum(b - a for a, b in one))
                all_spans.append([{"start": a, "end": b} for a, b in one])
            sizes = [len(k) + r for k, r in zip(kept, removed, strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(s) for s in all_spans], pa.int64()), pa.array(all_spans, span), pa.array(kept, pa.binary())], names=[key, "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    some = perhaps_in(spans, "key")("key")
    rows = keyed.filter(some).join(spans, "key", "left").select("id", "text", "spans")
    rows = rows.unionByName(keyed.filter(~some).select("id", "text", F.lit(None).cast(rows.schema["spans"].dataType).alias("spans")))
    return rows.mapInArrow(cut, f"`{key}` {rows.schema[0].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary")
