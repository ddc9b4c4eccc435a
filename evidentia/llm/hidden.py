"""Hidden Markov language model: Baum-Welch counts summed over partitions, exact likelihood by scaled forward steps."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import prepare, texts
from evidentia.session import stage

#: Distinct words that a task counts before it hands them on.
FLUSH = 400_000
#: Tokens of a segment in training.
SEGMENT = 128


@dataclass
class Settings:
    """``known``: most frequent words that every task looks up itself; ``own`` of them are symbols of their own.

    After ``warm`` rounds, training ends with one that raised the log likelihood by under ``settled`` of it, or when
    ``rounds`` more have run.
    """

    states: int = 8
    own: int = 20_000
    known: int = 150_000
    classes: int = 512
    warm: int = 2
    rounds: int = 18
    settled: float = 5e-4
    seed: int = 17


@dataclass
class Vocabulary:
    """Counts of training tokens. Words beyond the first ``own`` share one symbol per class of endings."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    class_total: np.ndarray
    class_distinct: np.ndarray
    own: int

    def size(self) -> int:
        return self.own + len(self.class_total)

    def symbols(self) -> np.ndarray:
        """The symbol of each known word."""
        classes = [self.own + word_class(w, len(self.class_total)) for w in self.words[self.own :]]
        return np.array([*range(min(self.own, len(self.words))), *classes], dtype=np.int32)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.total + 0.1 * (self.distinct + 1)))

    def class_size(self) -> np.ndarray:
        return self.class_total + 0.1 * (self.class_distinct + 1)

    def weights(self) -> np.ndarray:
        """How often each symbol comes."""
        own = np.zeros(self.own)
        own[: len(self.words)] = self.counts[: self.own]
        return np.concatenate((own, self.class_size())) + 0.1


END = b""  # no word is empty, so the end is


def word_class(word: bytes, classes: int) -> int:
    return zlib.crc32(word[-3:]) % classes


def split(body: bytes) -> list[bytes]:
    """Lower-case words (bytes.lower and bytes.split know ASCII alone), then the end."""
    return [*body.lower().split(), END]


def token_counts(docs: DataFrame, text: str) -> DataFrame:
    """(token, c) over all of ``docs``; each task sums what it has before the shuffle."""

    def count(batches):
        seen: Counter = Counter()

        def rows():
            return pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["token", "c"])

        for batch in batches:
            for body in texts(batch.column(0)):
                seen.update(split(body))
            if len(seen) > FLUSH:
                yield rows()
                seen.clear()
        yield rows()

    return docs.select(text).mapInArrow(count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def class_of(token: str, classes: int) -> Column:
    return (F.crc32(F.substring(token, -3, 3)) % classes).cast("int")


def vocabulary(counts: DataFrame, s: Settings) -> Vocabulary:
    """The bounded part of the counts that every task gets: the most frequent words, and sums by class."""
    top = counts.orderBy(F.desc("c"), "token").limit(s.known).collect()
    words, c = [bytes(r["token"]) for r in top], np.array([r["c"] for r in top], dtype=np.int64)
    total, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    by_class = np.zeros((s.classes, 2))
    for r in counts.groupBy(class_of("token", s.classes).alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        by_class[r["k"]] = r["c"], r["n"]
    for w, n in zip(words[: s.own], c[: s.own], strict=True):
        by_class[word_class(w, s.classes)] -= n, 1
    return Vocabulary(words, c, int(total or 0), int(distinct), by_class[:, 0], by_class[:, 1], s.own)


def encoded(docs: DataFrame, v: Vocabulary, key: str, text: str, learn: Column) -> DataFrame:
    """A row for each document: symbols (16 bits each), sums over known words, and the other words with their number."""
    shared = docs.sparkSession.sparkContext.broadcast(v)
    schema = "n_tokens long, n_sure long, base_sure double, inner_sure double, symbols binary, rare array<binary>, times array<int>"

    def encode(batches):
        v = shared.value
        place = {w: i for i, w in enumerate(v.words)}.get
        classes = len(v.class_total)
        symbol = np.append(v.symbols(), 0)
        base = np.append(v.base(v.counts), 0.0)
        inner = np.append(np.log10((v.counts + 0.1) / v.class_size()[np.maximum(v.symbols() - v.own, 0)]), 0.0)
        inner[: min(v.own, len(v.words))] = 0.0
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for body in texts(batch.column(batch.num_columns - 1)):
                words = split(body)
                at = np.array([place(w, -1) for w in words])
                symbols = symbol[at]
                missing = np.flatnonzero(at < 0)
                symbols[missing] = [v.own + word_class(words[i], classes) for i in missing]
                rare = Counter(words[i] for i in missing)
                row = (len(words), len(words) - len(missing), base[at].sum(), inner[at].sum(), symbols.astype("<u2").tobytes(), list(rare), list(rare.values()))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()))
            yield pa.record_batch([*batch.columns[:-1], *[pa.array(c, t) for c, t in zip(out, types, strict=True)]], names=names)

    rows = docs.select(F.col(key), learn.alias("learn"), F.monotonically_increasing_id().alias("row"), F.col(text))
    names = [*rows.columns[:-1], "n_tokens", "n_sure", "base_sure", "inner_sure", "symbols", "rare", "times"]
    return rows.mapInArrow(encode, f"`{key}` {rows.schema[0].dataType.simpleString()}, learn boolean, row long, {schema}")


@dataclass
class Chain:
    """Start, transition and emission probabilities (emission: symbols by states), and how often a state is occupied."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray
    usual: np.ndarray


def segments(bodies: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts cut to rows of SEGMENT symbols, longest first; their lengths; which begin a text."""
    parts = [(b[i : i + SEGMENT], i == 0) for b in bodies for i in range(0, len(b), SEGMENT)]
    parts.sort(key=lambda p: -len(p[0]))
    lengths = np.array([len(p) for p, _ in parts])
    table = np.zeros((SEGMENT, len(parts)), dtype=np.int32)
    for j, (p, _) in enumerate(parts):
        table[: len(p), j] = p
    return table, lengths, np.array([first for _, first in parts])


def expected(chain: Chain, bodies: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, transitions and emissions of the texts, by scaled forward and backward steps; log likelihood."""
    states = len(chain.start)
    table, lengths, first = segments(bodies)
    alive = [int(n) for n in np.searchsorted(-lengths, -np.arange(SEGMENT), "left")]  # segments longer than t
    steps = int(lengths.max())
    ones = np.ones((states, 1), dtype=np.float32)
    ahead, scales, shown = [], [], []
    for t in range(steps):
        e = chain.emit[table[t, : alive[t]]]
        a = (np.where(first[:, None], chain.start, chain.usual) if t == 0 else ahead[-1][: alive[t]] @ chain.step) * e
        scale = a @ ones
        a /= scale
        ahead.append(a)
        scales.append(scale)
        shown.append(e)
    moves = np.zeros((states, states))
    emitted = np.zeros((chain.emit.shape[0], states))
    symbols, held = [], []
    back = np.ones((alive[steps - 1], states), dtype=np.float32)
    for t in range(steps - 1, -1, -1):
        if t < steps - 1:
            now = np.ones((alive[t], states), dtype=np.float32)
            weighed = shown[t + 1] * back
            weighed /= scales[t + 1]
            now[: alive[t + 1]] = weighed @ chain.step.T
            moves += ahead[t][: alive[t + 1]].T @ weighed
            back = now
        g = ahead[t] * back
        symbols.append(table[t, : alive[t]])
        held.append(g)
    starts = held[-1][first].sum(axis=0).astype(float)
    symbol, g = np.concatenate(symbols), np.concatenate(held)
    symbol = symbol.astype(np.intp)  # once, not for each state
    for k in range(states):
        emitted[:, k] = np.bincount(symbol, g[:, k], len(emitted))
    return starts, moves * chain.step, emitted, float(sum(np.log(x, dtype=np.float64).sum() for x in scales))


def improved(starts: np.ndarray, moves: np.ndarray, emitted: np.ndarray, weights: np.ndarray) -> Chain:
    """Probabilities from expected counts; each state's emissions lean a little on how often symbols come at all."""
    share = weights / weights.sum()
    emit = emitted + 200 * share[:, None]
    emit /= emit.sum(axis=0)
    step = moves + 1
    step /= step.sum(axis=1, keepdims=True)
    usual = emitted.sum(axis=0) + 1
    f = np.float32
    return Chain(((starts + 1) / (starts + 1).sum()).astype(f), step.astype(f), emit.astype(f), (usual / usual.sum()).astype(f))


def chunks(batches, place: int, most: int = 2_000_000):
    """Lists of symbol arrays of about ``most`` symbols."""
    held, size = [], 0
    for batch in batches:
        for x in batch.column(place).to_pylist():
            held.append(np.frombuffer(x, "<u2"))
            size += len(held[-1])
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def baum_welch(rows: DataFrame, v: Vocabulary, s: Settings) -> Chain:
    """Rounds over every training text, until the likelihood settles."""
    draw = np.random.default_rng(s.seed)
    weights = v.weights()
    noisy = weights[:, None] * draw.uniform(0.5, 1.5, (len(weights), s.states))
    chain = improved(np.ones(s.states), np.full((s.states, s.states), 1.0) + np.eye(s.states) * 9 * s.states, noisy, weights)
    learn = rows.filter("learn").select("symbols")
    names = [f"k{i}" for i in range(s.states)]
    before = None
    for turn in range(s.warm + s.rounds):
        shared = rows.sparkSession.sparkContext.broadcast(chain)

        def sums(batches, shared=shared):
            total = None
            for part in chunks(batches, 0):
                now = expected(shared.value, part)
                total = now if total is None else [a + b for a, b in zip(total, now, strict=True)]
            if total is None:
                return
            starts, moves, emitted, likely = total
            seen = np.flatnonzero(emitted.any(axis=1))
            # symbol, or -1 for the starts, -2 for the likelihood and -3, -4, ... for the moves out of each state
            ids = np.concatenate(([-1, -2], -3 - np.arange(len(moves)), seen))
            values = np.concatenate((starts[None], np.full((1, len(starts)), likely), moves, emitted[seen]))
            yield pa.record_batch([pa.array(ids, pa.int64()), *[pa.array(values[:, k]) for k in range(values.shape[1])]], names=["id", *names])

        out = learn.mapInArrow(sums, "id long, " + ", ".join(f"{n} double" for n in names))
        out = out.groupBy("id").agg(*[F.sum(n).alias(n) for n in names]).toPandas().sort_values("id")
        shared.unpersist()
        if out.empty:
            return chain
        values = out[names].to_numpy()
        emitted = np.zeros((v.size(), s.states))
        ids = out["id"].to_numpy()
        emitted[ids[ids >= 0]] = values[ids >= 0]
        chain = improved(values[ids == -1][0], values[ids < -2][::-1], emitted, weights)
        likely = float(values[ids == -2][0, 0])
        if turn >= s.warm and before is not None and likely - before < s.settled * abs(likely):
            break
        before = likely
    return chain


def likelihoods(chain: Chain, bodies: list[np.ndarray]) -> np.ndarray:
    """log10 of each whole text's probability: the forward recursion, scaled at every step, all texts side by side."""
    order = sorted(range(len(bodies)), key=lambda i: -len(bodies[i]))
    lengths = np.array([len(bodies[i]) for i in order])
    flat = np.concatenate([bodies[i] for i in order])
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    total = np.zeros(len(order))
    start, step, emit = chain.start.astype(float), chain.step.astype(float), chain.emit.astype(float)
    start, step, emit = start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0)
    a = None
    for t in range(int(lengths[0])):
        n = int(np.searchsorted(-lengths, -t, "left"))
        a = (np.broadcast_to(start, (n, len(start))) if t == 0 else a[:n] @ step) * emit[flat[first[:n] + t]]
        scale = a.sum(axis=1)
        a = a / scale[:, None]
        total[:n] += np.log10(scale)
    out = np.empty(len(order))
    out[order] = total
    return out


def language_scores(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", settings: Settings | None = None) -> DataFrame:
    """log10 probability of every whole text under a unigram base and under the hidden Markov model.

    Tokens are lower-case words and one end; counts, sums by class and all rounds of the model cover every row where
    ``learn`` holds. A symbol is one of the most frequent words or a class of the others, which share endings; the
    model gives the probability of the symbols (summed over all state sequences), times that of each word in its class.
    Words that a task does not know meet their counts in a join.

    A null text counts as empty: its end alone. A row whose ``learn`` is null is not learned from. Repeated rows are
    scored (and learned from) each; other columns are ignored; an empty table gives no rows.

    Columns: the id, learn, n_tokens, n_known, train_tokens, base_score, score.
    """
    s = settings or Settings()
    prepare(docs.sparkSession)
    learn = F.coalesce(learn, F.lit(False))
    counts = stage(token_counts(docs.filter(learn), text), "hmm-counts")
    v = vocabulary(counts, s)
    rows = stage(encoded(docs, v, key, text, learn), "hmm-rows")
    chain = baum_welch(rows, v, s)

    # words beyond the known ones: summed for each document after a join on the word
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("token"), F.col("x.times").alias("n"))
    joined = rare.join(counts, "token", "left")
    c = F.coalesce("c", F.lit(0)) + 0.1
    sizes = F.array(*[F.lit(float(x)) for x in v.class_size()])
    base = F.log10(c / F.lit(v.total + 0.1 * (v.distinct + 1)))
    inner = F.log10(c / F.element_at(sizes, class_of("token", s.classes) + 1))
    sums = joined.groupBy("row").agg(F.sum(F.col("n") * base).alias("base"), F.sum(F.col("n") * inner).alias("inner"), F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("known"))

    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = ["row", "hidden"]

    def score(batches):
        for batch in grouped(batches, 8_000, 4_000_000):
            bodies = [np.frombuffer(x, "<u2") for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(likelihoods(shared.value, bodies))], names=names)

    hidden = rows.select("row", "symbols").mapInArrow(score, "row long, hidden double")
    out = rows.drop("symbols", "rare", "times").join(hidden, "row").join(sums, "row", "left")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    return out.select(
        F.col(key),
        "learn",
        "n_tokens",
        (F.col("n_sure") + zero("known")).cast("long").alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base_sure") + zero("base")).alias("base_score"),
        (F.col("hidden") + F.col("inner_sure") + zero("inner")).alias("score"),
    )


def grouped(batches, rows: int, size: int):
    """Batches joined up to about ``rows`` rows or ``size`` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if held and (sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= size):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
