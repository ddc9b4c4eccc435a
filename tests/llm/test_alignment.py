"""Alignment against whole-text tokenization and all overlapping pairs of tokens; minimal perfect hashing."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from evidentia.llm import alignment, perfect, queries
from evidentia.llm.packing import public_path

COLUMNS = "doc_id long, text string, n_a string, block int, pairs string, shard int"
ODD = [
    "a  b ", " \n \n x", "x\n \n y", " ", "  ", "\t", "a ", "a▁b", "▁", "<|endoftext|> <s> </s>", "it's  'll x　y 　 z", "  lead", "trail  \n",
    "\x00 a", "é" * 300, "1234567 89", "don't\x1c \x1d b", "a \x85 b", "One two.\nThree", "ab" * 20_000, "\n" * 30_000 + "z", "中文 字 🙂🙂", "same words here", "same words here",
]


def bytes_of_a(tokens):
    """Byte-level letters back to bytes: printable Latin-1 stands for itself, the rest is numbered from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    return [bytes(letter[c] for c in t) for t in tokens]


def plain(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_path("piece_bpe_32k.model"))
    counts, found = Counter(), []
    for key, text in rows:
        in_a = a.encode(" " + (text or ""), add_special_tokens=False)
        ids_a, ids_b = in_a.ids, b.encode(text or "")
        pieces = [b.id_to_piece(i) for i in ids_b]
        parts_a = bytes_of_a(in_a.tokens)
        parts_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces, strict=True)]
        body = (" " + (text or "")).encode()
        if not text or b"".join(parts_a) != body or b"".join(parts_b) != body:
            found.append((key, None))
            continue
        owner_a = [i for i, p in enumerate(parts_a) for _ in p]
        owner_b = [i for i, p in enumerate(parts_b) for _ in p]
        links = sorted({(i, j) for i, j in zip(owner_a, owner_b, strict=True)})
        counts.update((ids_a[i], ids_b[j]) for i, j in links)
        groups, now = [], ([], [])
        for at, (i, j) in enumerate(zip(owner_a, owner_b, strict=True)):
            end_a = at + 1 == len(body) or owner_a[at + 1] != i
            end_b = at + 1 == len(body) or owner_b[at + 1] != j
            now[0].extend([str(ids_a[i])] if end_a else [])
            now[1].extend([str(ids_b[j])] if end_b else [])
            if end_a and end_b:
                groups.append(",".join(now[0]) + "|" + ",".join(now[1]))
                now = ([], [])
        found.append((key, (ids_a, ids_b, links, groups)))
    highest = {}
    for (_, j), n in counts.items():
        highest[j] = max(highest.get(j, 0), n)
    out = []
    for key, x in found:
        if x is None:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
            continue
        ids_a, ids_b, links, groups = x
        each = [(ids_a[i], ids_b[j]) for i, j in links]
        best = sum(counts[p] == highest[p[1]] for p in each)
        out.append((key, len(ids_a), len(ids_b), len(groups), len(links), best, sum(counts[p] for p in each), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(1)
    letters = " \n\t 　abc'sé1.▁中\x1c\x85"
    out = [(i, x) for i, x in enumerate(ODD)] + [(90, None), (91, ""), (3, ODD[3]), (None, "no id at all")]
    return out + [(100 + i, "".join(draw.choice(letters) for _ in range(draw.randrange(30)))) for i in range(1500)]


@pytest.mark.parametrize("table, cache", [(alignment.TABLE, alignment.CACHE), (5, alignment.CACHE), (alignment.TABLE, 50)])
def test_aligned(spark, rows, monkeypatch, table, cache):
    # small shards, trees and caches; the functions that tasks run carry no module state of the driver
    for name, value in (("SHARD", 64), ("FAN", 2)):
        monkeypatch.setattr(alignment, name, value)
    docs = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], COLUMNS).repartition(5)
    out = alignment.aligned(docs, table=table)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    order = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted(map(tuple, out.collect()), key=order) == sorted(plain(rows), key=order)


def test_small_cache():
    """A worker that forgets its segments gives the same places' contents."""
    draw = random.Random(7)
    bodies = [" ".join(f"w{draw.randrange(300)}" for _ in range(40)) for _ in range(60)] + ["a▁b c", None, ""]
    whole = alignment.Aligner(public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model"))
    small = alignment.Aligner(public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model"))
    keep, alignment.CACHE = alignment.CACHE, 100
    try:
        for i in range(0, len(bodies), 4):
            where, edges = small.batch(bodies[i : i + 4])
            alignment.CACHE = keep
            other, same = whole.batch(bodies[i : i + 4])
            alignment.CACHE = 100
            assert (edges == same).all()
            assert (small.numbers[:, where] == whole.numbers[:, other]).all()
            assert [small.groups[x] for x in where] == [whole.groups[x] for x in other]
    finally:
        alignment.CACHE = keep


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 40, 50_000))
    for shards in (1, 7):
        own = perfect.shard_of(keys, shards)
        built = perfect.ShardedHash([perfect.MinimalHash.build(keys[own == i]) for i in range(shards)])
        assert (np.sort(built.places(keys)) == np.arange(len(keys))).all()
    assert len(perfect.ShardedHash([perfect.MinimalHash.build(keys[:0])]).places(keys[:0])) == 0
    with pytest.raises(ValueError):
        perfect.MinimalHash.build(np.array([5, 5]))


def test_table_verifies_keys():
    built = perfect.ShardedHash([perfect.MinimalHash.build(np.array([3, 9, 27]))])
    keys = np.empty(3, dtype=np.int64)
    keys[built.places(np.array([3, 9, 27]))] = [3, 9, 27]
    table = alignment.PairTable(built, keys, np.array([1, 2, 3]), np.array([True, True, True]))
    with pytest.raises(KeyError):
        table.look_up(np.array([4]))


def test_empty(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert alignment.aligned(empty).count() == 0
    assert [tuple(r) for r in alignment.aligned(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_query(spark, rows, tmp_path):
    docs = [(i, t, "en", "a", 1) for i, t in rows[:60] if i is not None]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.QUERIES["op12_token_alignment"](spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == sorted(plain([r[:2] for r in docs]))
