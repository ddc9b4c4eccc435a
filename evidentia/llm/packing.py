"""Packing token sequences: shortest-pack-first over the length histogram, patterns joined back by rank."""

from __future__ import annotations

import functools
import heapq
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import ordinal, prepare, texts
from evidentia.session import stage

#: Entries of a worker's word cache; a word beyond it is tokenised each time it comes.
CACHE = 400_000
#: Where the tokenizer cuts an ASCII word in lower case before it merges anything.
PARTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


def public_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def word_encoder(path: str):
    """A function from texts (bytes) to their token ids as little-endian 32-bit bytes.

    The tokenizer drops white space before it merges anything, so a text's ids are those of its words in turn; each
    worker keeps the ids of the words that it has met. Words of ASCII are cut as the tokenizer cuts them (PARTS), so that
    a new word is mostly one of known parts.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    known: dict[bytes, bytes] = {}

    parts: dict[bytes, bytes] = {}

    def ids_of(words: list[bytes]) -> list[bytes]:
        cut = [PARTS.findall(w.lower()) if w.isascii() else [w] for w in words]
        new = list({p for part in cut for p in part if p not in parts})
        encoded = model.encode_batch_fast([p.decode("utf-8", "replace") for p in new], add_special_tokens=False)
        fresh = dict(zip(new, [array("I", x.ids).tobytes() for x in encoded], strict=True))
        if len(parts) + len(fresh) <= CACHE:
            parts.update(fresh)
            return [b"".join(map(parts.__getitem__, part)) for part in cut]
        return [b"".join([fresh[p] if p in fresh else parts[p] for p in part]) for part in cut]

    def encode(bodies: list[bytes]) -> Iterator[bytes]:
        for body in bodies:
            words = body.split()
            try:
                yield b"".join(map(known.__getitem__, words))
                continue
            except KeyError:
                new = [w for w in set(words) if w not in known]
            room = CACHE - len(known)
            fresh = dict(zip(new, ids_of(new), strict=True))
            known.update(list(fresh.items())[:room] if room > 0 else ())
            if len(fresh) > room:
                yield b"".join([fresh[w] if w in fresh else known[w] for w in words])
            else:
                yield b"".join(map(known.__getitem__, words))

    return encode


def pieces(docs: DataFrame, path: str, size: int, end: int, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Every document's ids with ``end``, cut into runs of ``size`` and one rest."""
    prepare(docs.sparkSession)
    fields = [pa.field(key, pa.int64()), *[pa.field(n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens")]]
    fields += [pa.field("ids", pa.list_(pa.int32()))] if keep_ids else []
    schema = pa.schema(fields)
    last = np.array([end], dtype="<u4").tobytes()

    def cut(batches):
        encode = word_encoder(path)
        for batch in batches:
            rows: list[list] = [[] for _ in fields]
            for doc, ids in zip(batch.column(0).to_pylist(), encode(texts(batch.column(1))), strict=True):
                ids += last
                for start in range(0, len(ids), 4 * size):
                    part = ids[start : start + 4 * size]
                    values = [doc, start // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4]
                    for column, value in zip(rows, values + [np.frombuffer(part, "<i4")] * keep_ids, strict=True):
                        column.append(value)
            yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(rows, fields, strict=True)], schema=schema)

    types = f"`{key}` long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids
    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(cut, types)


def shortest_pack_first(counts: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """Patterns (how many packs, the lengths in each) that hold ``counts`` pieces of each length.

    Lengths are placed longest first. A length goes into the shortest open packs that it fits, as many at once as there
    are; packs are counted by pattern, never listed, so the work depends on the number of lengths, not of pieces.
    """
    full: list[tuple[int, tuple]] = []
    open_: dict[int, list[tuple[int, tuple]]] = {}  # by room left
    rooms: list[int] = []  # the same, largest first

    def put(room: int, n: int, pattern: tuple) -> None:
        if not room:
            full.append((n, pattern))
            return
        if room not in open_:
            open_[room] = []
            heapq.heappush(rooms, -room)
        open_[room].append((n, pattern))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if rooms and -rooms[0] >= length:
                room = -rooms[0]
                n, pattern = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    heapq.heappop(rooms)
                used = min(n, left)
                if used < n:
                    put(room, n - used, pattern)
                put(room - length, used, (pattern, length))
                left -= used
            else:
                # as many of this length side by side as fit
                each = min(size // length, left)
                packs = left // each
                pattern: tuple = ()
                for _ in range(each):
                    pattern = (pattern, length)
                put(size - each * length, packs, pattern)
                left -= packs * each
    out = []
    for n, pattern in [*full, *(x for packs in open_.values() for x in packs)]:
        lengths = []
        while pattern:
            pattern, length = pattern
            lengths.append(length)
        out.append((n, lengths[::-1]))
    return out


def slots(counts: dict[int, int], size: int) -> np.ndarray:
    """Columns first rank, first sequence, offset: the pieces from a rank on, in order of falling length, go to

    successive sequences at the same offset, up to the next row.
    """
    first, at = {}, 0
    for length in sorted(counts, reverse=True):
        first[length] = at
        at += counts[length]
    rows, sequence = [], 0
    for n, lengths in shortest_pack_first(counts, size):
        offset = 0
        for length in lengths:
            rows.append((first[length], sequence, offset))
            first[length] += n
            offset += length
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 3)


def pack(docs: DataFrame, path: str | None = None, size: int = 4096, end: int = 2, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """All documents as pieces in sequences of at most ``size`` tokens.

    Only documents longer than a sequence are cut. The histogram of piece lengths (at most ``size`` numbers) is all
    that the driver sees; the patterns found there become intervals of ranks, and each piece finds its own by its rank
    among all pieces of its length. The pieces are ranked by range partitions, so a hot length is split.

    A null or empty text is its end token alone. Repeated rows are packed each. Other columns are ignored; an empty
    table gives no rows. ``path`` is the tokenizer's file (`public_path` by default); it must be readable on executors.

    Columns: the id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if ``keep_ids``.
    """
    cut = stage(pieces(docs, path or public_path(), size, end, key, text, keep_ids), "pack-pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    ranked = ordinal(cut, [F.col("length").desc(), F.col(key), F.col("start"), F.col("ids_crc32")], "rank")
    table = ranked.sparkSession.sparkContext.broadcast(slots(counts, size))

    def place(batches):
        starts, sequences, offsets = table.value.T
        for batch in batches:
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            k = np.searchsorted(starts, rank, "right") - 1
            columns = [batch.column(c) for c in names] + [pa.array(sequences[k] + rank - starts[k]), pa.array(offsets[k])]
            yield pa.record_batch(columns, names=[*names, "sequence_id", "offset"])

    names = cut.columns
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, types)
