"""Fingerprints and their groups against plain Python over all pairs."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from evidentia.llm import queries, simhash

COLUMNS = "doc_id long, text string, fp string, place string, component string, least string"


def plain(text, n=3):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    n = min(n, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, differ):
    """The least id that links over all pairs lead to, for [(id, fingerprint)]."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= differ:
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(fps):
        if key is not None:
            r = find(i)
            least[r] = min(least.get(r, key), key)
    return [least.get(find(i)) for i in range(len(fps))]


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    out = [(0, None), (1, ""), (2, " \n\t"), (3, "One"), (4, "one"), (5, "One Two"), (6, "É é x y z"), (7, "ab " * 20_000)]
    base = [f"w{draw.randrange(500)}" for _ in range(1500)]
    for i in range(8, 60):
        copy = list(base)
        for _ in range(draw.randrange(4)):
            copy[draw.randrange(len(copy))] = f"v{draw.randrange(10**6)}"
        out.append((i, " ".join(copy)))
    out += [(i, " ".join(f"w{draw.randrange(500)}" for _ in range(draw.randrange(1, 80)))) for i in range(60, 90)]
    return [*out, out[9], (None, out[3][1]), (None, "of no id")]


@pytest.mark.parametrize("differ, longest", [(2, 512), (2, 3), (1, 512), (1, 2)])
def test_groups(spark, rows, monkeypatch, differ, longest):
    monkeypatch.setattr(simhash, "LIST", longest)
    docs = spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], COLUMNS)
    out = simhash.near_fingerprints(docs, differ=differ)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    fps = [(key, plain(text)) for key, text in rows]
    want = [(key, f"{fp:016x}", group) for (key, fp), group in zip(fps, groups(fps, differ), strict=True)]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, out.collect()), key=order) == sorted(want, key=order)


def test_long_lists_are_probed():
    """Fingerprints that share six bytes: looking near values up links what all pairs link."""
    draw = random.Random(2)
    for spread in (40, 400, 4000):
        fps = sorted({(0xABCDEF << 40) | draw.randrange(1 << 16) << 8 | 7 for _ in range(spread)})
        import numpy as np

        members = np.array(fps, dtype=np.uint64).view(np.int64)
        found = simhash.probed(members, 2)
        short = simhash.tallied(members, 2)

        def classes(links, count=len(fps)):
            root = list(range(count))

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for u, v in links:
                root[max(find(u), find(v))] = min(find(u), find(v))
            return [find(x) for x in range(count)]

        assert classes(found) == classes(short)


def test_positions_cover_all_differences():
    from itertools import combinations

    for differ in (1, 2):
        for unlike in combinations(range(8), differ):
            assert any(not set(unlike) & set(s) for s in simhash.coarse(differ))


def test_bounds(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert simhash.near_fingerprints(empty).count() == 0
    with pytest.raises(ValueError):
        simhash.near_fingerprints(empty, differ=3)


def test_query(spark, tmp_path):
    """The registered query over a written folder, whole, with the hash that the contract names."""
    docs = [(i, "the same few words again and again " * 3, "en", "a", 1) for i in range(5)] + [(9, "quite another text of its own", "en", "b", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.QUERIES["op11_simhash"](spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == sorted((i, f"{plain(t):016x}", 0 if i < 5 else i) for i, t, *_ in docs)
    # Spark's own xxhash64 has the same seed: one shingle's fingerprint is its hash
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string").select(F.hex(F.xxhash64("text"))).first()[0]
    assert one.lower().zfill(16) == f"{simhash.fingerprint(b'a b c'):016x}"
