"""Ranked search against plain scoring of every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from evidentia.llm import queries, ranking

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, id long, n long, terms string, score long, item string"
ITEMS = "item_id long, text string, rank int, item long"


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(docs, items, k):
    bodies = [(key, Counter(terms(text)), len(terms(text))) for key, text in docs]
    bodies = [b for b in bodies if b[2]]
    number, words = len(bodies), sum(b[2] for b in bodies)
    df = Counter(t for _, held, _ in bodies for t in held)
    wanted = {}
    for key, text in items:
        wanted.setdefault(key, set()).update(terms(text))
    out = []
    for item, own in wanted.items():
        scored = []
        for key, held, n in bodies:
            m = 100 - 50 + (50 * n * number) // words
            score = sum(
                math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * held[t]) // (1000 * held[t] + 20 * m)) for t in own if t in held
            )
            if score > 0:
                scored.append((-score, key is None, key or 0, key))
        out += [(item, rank, key, -score) for rank, (score, _, _, key) in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.fixture(scope="module")
def tables():
    draw = random.Random(3)
    word = lambda: draw.choice(["Of", "of", "the", "x1", "é"]) if draw.random() < 0.4 else f"t{int(draw.expovariate(0.02))}"
    docs = [(i, " ".join(word() for _ in range(draw.randrange(1, 60)))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(70)]  # more equal documents than ranks
    docs += [(401, None), (402, ""), (403, " .,;\x00"), (404, "t1 " * 30_000), (405, "T1-t2_t3"), (7, docs[7][1]), (None, docs[7][1]), (None, "t2 t3")]
    items = [(i, docs[i * 5][1]) for i in range(12)] + [(20, None), (21, "?!"), (22, "nowhere"), (3, "t4 t4 T5"), (None, "t1 of")]
    return docs, items


@pytest.mark.parametrize("leaf, most, block, k", [(32, 1 << 15, 1 << 20, 50), (2, 64, 1 << 20, 5), (4, 1 << 15, 30, 50)])
def test_ranked(spark, tables, monkeypatch, leaf, most, block, k):
    for name, value in (("LEAF", leaf), ("MOST_DOCS", most), ("BLOCK_TERMS", block)):
        monkeypatch.setattr(ranking, name, value)
    docs = spark.createDataFrame([(*r, 1, 2, "a", 3, "b") for r in tables[0]], DOCS)
    items = spark.createDataFrame([(*r, 1, 2) for r in tables[1]], ITEMS)
    out = ranking.ranked(docs, items, k=k)
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, out.collect()), key=order) == sorted(plain(*tables, k), key=order)


def test_bounds_hold_and_prune():
    """A tree's node never promises less than a document below it scores, and a search leaves nodes out."""
    draw = random.Random(1)
    width, count = 40, 3000
    lists = [sorted(draw.sample(range(width), draw.randrange(1, 12))) for _ in range(count)]
    starts = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    tfs = np.array([draw.randrange(1, 9) for x in lists for _ in x])
    tree = ranking.Tree(np.arange(count), np.array([draw.randrange(50, 300) for _ in lists]), starts, np.array([t for x in lists for t in x]), tfs, width)
    assert sorted(tree.ids.tolist()) == list(range(count))
    leaves = [i for i, n in enumerate(tree.many) if not n]
    assert sorted(x for i in leaves for x in range(tree.lo[i], tree.hi[i])) == list(range(count))
    weights = np.array([draw.randrange(1, 4000) for _ in range(width)])
    for at in range(len(tree.lo)):
        a, b = tree.starts[tree.lo[at]], tree.starts[tree.hi[at]]
        most = np.zeros(width, dtype=np.int64)
        np.maximum.at(most, tree.terms[a:b], tree.points[a:b])
        assert (tree.most[at] >= most).all()
    wanted = np.array([1, 20, 33])
    best = []
    tree.search(wanted, weights, best, 5)
    score = [sum(int(weights[t] * p) for t, p in zip(tree.terms[a:b], tree.points[a:b], strict=True) if t in wanted) for a, b in zip(tree.starts[:-1], tree.starts[1:], strict=True)]
    want = sorted(((-s, int(i)) for s, i in zip(score, tree.ids, strict=True)))[:5]
    assert sorted((-s, -i) for s, i in best) == want
    # where five better ones are known already, the search ends at the root
    tree.terms, better = None, [(1 << 60, 0)] * 5
    tree.search(wanted, weights, better, 5)
    assert better == [(1 << 60, 0)] * 5


def test_empty(spark, tables):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(*r, 1, 2) for r in tables[1]], ITEMS)
    full = spark.createDataFrame([(1, "t1", 1, 2, "a", 3, "b")], DOCS)
    assert ranking.ranked(docs, some).count() == 0
    assert ranking.ranked(full, items).count() == 0


def test_query(spark, tables, tmp_path):
    docs = [(i, t, "en", "a", 1) for i, t in tables[0] if i is not None]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    items = [r for r in tables[1] if r[0] is not None]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = queries.QUERIES["op13_ranked_search"](spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == sorted(plain([r[:2] for r in docs], items, 50))
