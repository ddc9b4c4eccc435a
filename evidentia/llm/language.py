"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import prepare, whole
from evidentia.llm.features import char_ngrams, counted, letters_only

UNKNOWN = "und"


@dataclass
class Model:
    """Weights (features by languages) that are 0 for most features, inverse document frequencies, temperature."""

    langs: list[str]
    weights: np.ndarray
    idf: np.ndarray
    temperature: float
    bits: int
    orders: tuple[int, ...]


def grams(text: str, bits: int, orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct n-grams of the whole text and their counts; None without a letter."""
    points = letters_only(text)
    if len(points) < 2:
        return None
    return counted(np.concatenate([char_ngrams(points, n, bits) for n in orders]), 1 << bits)


def weighed(ids: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF with logarithmic counts, of length 1."""
    x = (1 + np.log(counts)) * idf[ids]
    return x / max(float(np.sqrt(x @ x)), 1e-12)


def document_frequencies(docs: DataFrame, text: str, bits: int, orders: tuple[int, ...]) -> tuple[np.ndarray, int]:
    """In how many texts each n-gram stands, over all of ``docs``; each task sums its own first."""

    def count(batches):
        total, texts = np.zeros(1 << bits, dtype=np.int64), 0
        for batch in batches:
            for body in batch.column(0).to_pylist():
                if body and (found := grams(body, bits, orders)):
                    total[found[0]] += 1
                    texts += 1
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.append(seen, -1)), pa.array(np.append(total[seen], texts))], names=["gram", "n"])

    rows = docs.select(text).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << bits, dtype=np.int64)
    is_gram = rows["gram"] >= 0
    out[rows["gram"][is_gram].to_numpy()] = rows["n"][is_gram].to_numpy()
    return out, int(rows["n"][~is_gram].sum())


def labelled_sample(docs: DataFrame, text: str, lang: str, key: str, bound: int, seed: int, bits: int, orders: tuple[int, ...]):
    """At most ``bound`` labelled texts, equally many of each language where there are enough, as feature rows."""
    sizes = {r[lang]: r["count"] for r in docs.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(bound).collect()}
    each = bound // max(len(sizes), 1)
    if not sizes:
        return [], []
    share = F.element_at(F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(min(1.0, each / v)))]), F.col(lang))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) / float(1 << 30)

    def encode(batches):
        for batch in batches:
            langs, ids, counts = [], [], []
            for body, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if body and (found := grams(body, bits, orders)):
                    langs.append(name)
                    ids.append(found[0].tobytes())
                    counts.append(found[1].tobytes())
            yield pa.record_batch([pa.array(langs, pa.string()), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["lang", "ids", "counts"])

    rows = docs.filter(draw < share).select(text, lang).mapInArrow(encode, "lang string, ids binary, counts binary").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["ids"])))
    rows = [rows[i] for i in np.random.default_rng(seed).permutation(len(rows))[: 2 * bound]]
    return [r["lang"] for r in rows], [(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["counts"], np.float32)) for r in rows]


def follow_the_leader(xs: list, ys: np.ndarray, size: int, classes: int, epochs: int, alpha: float, beta: float, l1: float, l2: float, seed: int) -> np.ndarray:
    """Softmax weights by follow-the-regularised-leader with per-weight rates; ``l1`` and ``l2`` are the elastic net."""
    z, n = np.zeros((size, classes), dtype=np.float32), np.zeros((size, classes), dtype=np.float32)

    def weights(ids) -> np.ndarray:
        zi = z[ids]
        w = (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(n[ids])) / alpha + l2)
        return np.where(np.abs(zi) <= l1, np.float32(0), w)

    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in draw.permutation(len(xs)):
            ids, x = xs[i]
            w = weights(ids)
            p = softmax(x @ w)
            p[ys[i]] -= 1
            g = x[:, None] * p[None, :]
            ni = n[ids]
            grown = ni + g * g
            z[ids] += g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * w
            n[ids] = grown
    return weights(np.arange(size))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def calibrated(logits: np.ndarray, ys: np.ndarray) -> float:
    """The temperature with the least loss on rows that were not trained on."""
    if not len(ys):
        return 1.0
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(ys)), ys] + 1e-12).mean()
    return float(min(np.geomspace(0.05, 10, 80), key=loss))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", bound: int = 4000, bits: int = 15, orders: tuple[int, ...] = (1, 2, 3), epochs: int = 4, seed: int = 11) -> Model:
    """Learn from the rows of ``docs`` that have a language.

    Document frequencies cover all of them. The weights are fitted on at most about ``bound`` rows, equally many of
    each language, and the temperature on a tenth of these that the weights have not seen.
    """
    prepare(docs.sparkSession)
    docs = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    seen, texts = document_frequencies(docs, text, bits, orders)
    idf = np.log((1 + texts) / (1 + seen)).astype(np.float32) + 1
    names, rows = labelled_sample(docs, text, lang, key, bound, seed, bits, orders)
    langs = sorted(set(names))
    ys = np.array([langs.index(x) for x in names], dtype=np.int64)
    xs = [(ids, weighed(ids, counts, idf).astype(np.float32)) for ids, counts in rows]
    aside = len(xs) // 10
    weights = follow_the_leader(xs[aside:], ys[aside:], 1 << bits, max(len(langs), 1), epochs, alpha=2.0, beta=1.0, l1=0.02, l2=0.1, seed=seed)
    logits = np.array([x @ weights[ids] for ids, x in xs[:aside]])
    return Model(langs, weights, idf, calibrated(logits, ys[:aside]), bits, orders)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """Language and probability of every whole text: the id, the columns ``keep``, lang_pred, score.

    A text that is null or has no letter is ``und`` with score 0, as is every text if the model has no language. Rows
    are scored each by itself, so ties, repeated rows and other columns change nothing; an empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(key), *keep, whole(text).alias("__text"))
    shared = spark.sparkContext.broadcast(model)
    names = rows.columns[:-1]

    def score(batches):
        m = shared.value
        for batch in batches:
            langs, scores = [], []
            for body in batch.column(len(names)).to_pylist():
                found = grams(body, m.bits, m.orders) if m.langs else None
                if found is None:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = softmax(weighed(*found, m.idf) @ m.weights[found[0]] / m.temperature)
                langs.append(m.langs[int(p.argmax())])
                scores.append(float(p.max()))
            yield pa.record_batch([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(score, f"{types}, lang_pred string, score double")
