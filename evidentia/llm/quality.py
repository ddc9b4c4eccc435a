"""Quality classifier: learned vectors of hashed words and character n-grams, averaged, with a softmax on top."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import prepare, whole
from evidentia.llm.features import char_ngrams, code_points, counted, word_hashes
from evidentia.llm.language import softmax
from evidentia.session import stage


@dataclass
class Model:
    """Vectors of the features, the softmax layer and its bias."""

    vectors: np.ndarray
    layer: np.ndarray
    bias: np.ndarray
    bits: int
    orders: tuple[int, ...]


def subwords(text: str, bits: int, orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of the whole text and their counts.

    Feature 0 says that a word repeats the one before it, feature 1 that a text has no word.
    """
    points = code_points(text)
    words = word_hashes(points)
    ids = [(words >> np.uint64(64 - bits)).astype(np.int64)]
    ids += [char_ngrams(points, n, bits) for n in orders]
    ids.append(np.zeros(int((words[1:] == words[:-1]).sum()), dtype=np.int64))
    if not len(words):
        ids.append(np.ones(1, dtype=np.int64))
    return counted(np.concatenate(ids), 1 << bits)


def chosen(rows: DataFrame, label: str, key: str, bound: int, seed: int) -> tuple[dict, DataFrame | None]:
    """Rows of each label, and about ``bound`` of the rows, half of each label where there are enough."""
    sizes = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    if not sizes:
        return {}, None
    each = bound // len(sizes)
    share = F.element_at(F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(min(1.0, each / v)))]), F.col(label))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    return sizes, rows.filter(draw < share)


def encoded(rows: DataFrame, text: str, label: str, seed: int, bits: int, orders: tuple[int, ...]) -> tuple[np.ndarray, list]:
    """Labels and features of the sampled ``rows``, in an order that does not depend on partitions."""

    def encode(batches):
        for batch in batches:
            found = [packed(*subwords(x, bits, orders), bits) for x in batch.column(0).to_pylist()]
            yield pa.record_batch([batch.column(1), pa.array([i for i, _ in found], pa.binary()), pa.array([c for _, c in found], pa.binary())], names=["label", "ids", "counts"])

    rows = rows.select(whole(text), F.col(label).cast("int")).mapInArrow(encode, "label int, ids binary, counts binary")
    # a partition at a time, so that the driver's JVM never holds the sample
    found = [(r["label"], bytes(r["ids"]), bytes(r["counts"])) for r in stage(rows, "quality-sample").toLocalIterator()]
    found.sort(key=lambda r: (r[0], hashlib.blake2b(r[1], digest_size=16).digest(), hashlib.blake2b(r[2], digest_size=16).digest()))
    found = [found[i] for i in np.random.default_rng(seed).permutation(len(found))]
    return np.array([r[0] for r in found], dtype=np.int64), [r[1:] for r in found]


def packed(ids: np.ndarray, counts: np.ndarray, bits: int) -> tuple[bytes, bytes]:
    """Steps between the sorted ids, and counts, in two bytes each where they fit, in four elsewhere."""
    return np.diff(ids, prepend=0).astype("<u2" if bits <= 16 else "<u4").tobytes(), counts.astype("<u2" if not len(counts) or counts.max() < 1 << 16 else "<u4").tobytes()


def unpacked(ids: bytes, counts: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids and counts of `packed`; ids of at most 16 bits always take two bytes."""
    steps = np.frombuffer(ids, "<u2" if bits <= 16 else "<u4")
    counts = np.frombuffer(counts, "<u2" if len(counts) == 2 * len(steps) else "<u4")
    return np.cumsum(steps, dtype=np.int32), counts.astype(np.float32)


def descend(xs: list[tuple[bytes, bytes]], ys: np.ndarray, bits: int, width: int, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Stochastic gradient descent on vectors and layer, one document a step, the rate falling to 0."""
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-1 / width, 1 / width, (1 << bits, width)).astype(np.float32)
    layer = np.zeros((width, 2), dtype=np.float32)
    steps, done = max(epochs * len(xs), 1), 0
    for _ in range(epochs):
        for i in draw.permutation(len(xs)):
            ids, counts = unpacked(*xs[i], bits)
            shares = counts / counts.sum()
            hidden = shares @ vectors[ids]
            g = softmax(hidden @ layer)
            g[ys[i]] -= 1
            now = np.float32(rate * (1 - done / steps))
            back = layer @ g
            layer -= now * np.outer(hidden, g)
            # each feature moves by its share of the document, scaled so that a mean document moves as one word would
            vectors[ids] -= (now * np.minimum(shares * 50, 1))[:, None] * back[None, :]
            done += 1
    return vectors, layer


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", bound: int = 6000, bits: int = 16, orders: tuple[int, ...] = (2, 3, 4), width: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 5, labels: DataFrame | None = None) -> Model:
    """Learn from labelled rows (label 0 or 1): at most about ``bound``, half of each label where there are enough.

    The labels are a column of ``docs`` or stand in ``labels`` (key, label), one row an id. Then the sample is drawn
    from the ids, and only the texts of that sample leave their scan; of texts that share an id the least is read.
    The bias undoes the balance of the sample, so that scores follow the labels' shares among all labelled rows.
    """
    prepare(docs.sparkSession)
    given = (docs if labels is None else labels).filter(F.col(label).isin(0, 1))
    if labels is not None:
        given = given.select(key, label).join(docs.select(key), key, "left_semi")
    sizes, sample = chosen(given, label, key, bound, seed)
    if labels is not None and sample is not None:
        # about ``bound`` ids with a label each, whatever the corpus
        near = docs.select(key, F.col(text)).join(F.broadcast(stage(sample, "labelled")), key)
        sample = near.groupBy(key).agg(F.min(text).alias(text), F.first(label).alias(label))
    ys, xs = (np.empty(0, dtype=np.int64), []) if sample is None else encoded(sample, text, label, seed, bits, orders)
    vectors, layer = descend(xs, ys, bits, width, epochs, rate, seed)
    drawn = np.bincount(ys, minlength=2) + 0.5
    there = np.array([sizes.get(0, 0), sizes.get(1, 0)]) + 0.5
    return Model(vectors, layer, (np.log(there / there.sum()) - np.log(drawn / drawn.sum())).astype(np.float32), bits, orders)


def scored(bodies: list[str | None], model: Model) -> list[float]:
    """Probability of label 1 for each text."""
    out = []
    for body in bodies:
        ids, counts = subwords(body or "", model.bits, model.orders)
        hidden = counts @ model.vectors[ids] / counts.sum()
        out.append(float(softmax((hidden @ model.layer + model.bias).astype(np.float64))[1]))
    return out


def quality_scores(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """Probability of label 1 for every whole text: the id, the columns ``keep``, score.

    Null and empty texts and texts of white space are scored by the features that such a text has. Rows are scored each
    by itself, so ties, repeated rows and other columns change nothing; an empty table gives no rows. A model without
    labelled rows scores every text 0.5.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(key), *keep, whole(text).alias("__text"))
    shared = spark.sparkContext.broadcast(model)
    names = rows.columns[:-1]

    def score(batches):
        for batch in batches:
            scores = scored(batch.column(len(names)).to_pylist(), shared.value)
            yield pa.record_batch([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*names, "score"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(score, f"{types}, score double")


def accepted(docs: DataFrame, model: Model, least: float, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of ``least`` or more, all columns unchanged; each row is judged by itself."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def choose(batches):
        for batch in batches:
            scores = scored(batch.column(place).to_pylist(), shared.value)
            yield batch.filter(pa.array([x >= least for x in scores]))

    return docs.mapInArrow(choose, docs.schema)
