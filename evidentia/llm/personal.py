"""Personal data: fixed patterns, and further spans that boosted trees select among proposed candidates."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.boosting import Trees, boost
from evidentia.llm.common import prepare, whole

KINDS = ("email", "ip", "card", "phone")
# The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: What the base patterns are made of, so that each is found in one pass over a text of any kind.
LOCAL_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
#: All of an ip, card or phone lies in a run of these characters.
NUMERIC_CHARS = re.compile(r"[0-9 .()+-]+")
FIRST = re.compile(r"[0-9+]")
HIDDEN_AT = re.compile(r" ?(?:\[at\]|\(at\))", re.IGNORECASE)
HIDDEN_LOCAL = re.compile(r"[\w.%+-]")
#: Written-out signs that a candidate may have in their place, in any case.
SIGN = re.compile(r"(\[at\]|\(at\))|\[dot\]|\(dot\)|\[\.\]", re.IGNORECASE)
HIDDEN_EMAIL = re.compile(r"[\w.%+-]+ ?(?:\[at\]|\(at\)) ?[\w-]+(?: ?(?:\.|\[\.\]|\[dot\]|\(dot\)) ?[\w-]+)+", re.IGNORECASE)
HIDDEN_IP = re.compile(r"[0-9]{1,3}(?:(?:\.|\[\.\]|\[dot\]|\(dot\))[0-9]{1,3}){3}(?![0-9])", re.IGNORECASE)
LOOSE_IP = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])")
#: Dates, and rows of years: no phones.
DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}|(?<![0-9])[0-9]{1,2}([.-])[0-9]{1,2}\1[0-9]{4}(?![0-9])|^(?:19|20)[0-9]{2}(?:[ .-]+(?:19|20)[0-9]{2})+$")
#: A phone without its plus: groups of digits with spaces and dashes, or with dots, between them.
LOCAL = re.compile(r"\(?[0-9]{1,5}\)?(?:(?:[ -]|(?<=\)))\(?[0-9]{2,7}\)?)+|[0-9]{1,5}(?:\.[0-9]{2,5})+")
#: Plus and country code, which a phone written for its own country leaves out.
CODE = re.compile(r"^\+(?:[0-9]{1,3}(?:[ .-]|(?=\()))?")
LONGEST = 40
#: Parts between spaces that a phone or card has at most: each but the first has two digits or more, 15 in all.
MOST_PARTS = 8
BREAKS = frozenset(".(+")
DIGITS = re.compile(r"[0-9]+")
#: Bins of probability in the counts that give the thresholds, and folds of the sample.
BINS = 2_000
FOLDS = 3

Span = tuple[int, int, int]  # kind, start, end


def digits(s: str) -> list[int]:
    return [ord(c) - 48 for c in s if "0" <= c <= "9"]


def luhn(numbers: list[int]) -> bool:
    total = sum(numbers[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in numbers[-2::-2])
    return total % 10 == 0


def value(x: str) -> int:
    """The number that some digits mean, 1000 for any above 999: there may be thousands of digits."""
    x = x.lstrip("0")
    return 1000 if len(x) > 3 else int(x or "0")


#: Pattern and further condition of the base matches in a run.
NUMERIC = (
    (1, IP, lambda s: all(value(x) <= 255 for x in s.split("."))),
    (2, CARD, lambda s: 16 <= len(n := digits(s)) <= 19 and luhn(n)),
    (3, PHONE, lambda s: 8 <= len(digits(s)) <= 15),
)


def numeric_runs(text: str) -> list[tuple[int, int]]:
    """From the first digit or plus of each run, an opening bracket before it included, to its last digit."""
    out = []
    for m in NUMERIC_CHARS.finditer(text):
        run = m.group()
        first, last = FIRST.search(run), len(run.rstrip(" .()+-"))
        if first and last - 1 > first.start():
            start = first.start()
            out.append((m.start() + start - (start > 0 and run[start - 1] == "("), m.start() + last))
    return out


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of `EMAIL`: what can stand before each at sign, where a domain follows it.

    No two local parts share a character, as they hold no at sign, so every character is looked at a few times only.
    """
    done = 0
    at = text.find("@")
    while at >= 0:
        local = text[done:at]
        start = done + len(local.rstrip(LOCAL_CHARS))
        domain = DOMAIN.match(text, at) if start < at else None
        if domain:
            yield start, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)



def addresses(run: str) -> Iterator[tuple[int, int]]:
    """Matches of `IP`: each four parts in turn of numbers with dots between them."""
    for m in DOTTED.finditer(run):
        at, parts = m.start(), m.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[i : i + 4])) + 3
            yield at, at + size
            at += size + 1


def base_spans(text: str, runs: list[tuple[int, int]]) -> tuple[list[Span], list[Span]]:
    """Matches of the base patterns by kind, then start; and the matches that were dropped."""
    good: list[Span] = [(0, start, end) for start, end in emails(text)]
    bad: list[Span] = []
    for start, end in runs:
        run = text[start:end]
        for kind, pattern, valid in NUMERIC:
            found = addresses(run) if kind == 1 else (m.span() for m in pattern.finditer(run))
            for a, b in found:
                (good if valid(run[a:b]) else bad).append((kind, start + a, start + b))
    return sorted(good), bad


def hidden_emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of `HIDDEN_EMAIL`, looked for from each written-out at sign to the left."""
    done = 0
    for sign in HIDDEN_AT.finditer(text):
        start = sign.start()
        while start > done and HIDDEN_LOCAL.match(text, start - 1):
            start -= 1
        if done <= start < sign.start() and (m := HIDDEN_EMAIL.match(text, start)):
            yield m.span()
            done = m.end()


def candidates(text: str, runs: list[tuple[int, int]]) -> list[Span]:
    """Spans that may be personal data, overlapping freely: written-out signs, and parts of runs between spaces."""
    out: set[Span] = set()
    lower = text.lower()
    if "(at)" in lower or "[at]" in lower:
        out |= {(0, *span) for span in hidden_emails(text)}
    if "[.]" in lower or "dot" in lower:
        out |= {(1, *m.span()) for m in HIDDEN_IP.finditer(text)}
    for start, end in runs:
        run = text[start:end]
        out |= {(1, start + m.start(), start + m.end()) for m in LOOSE_IP.finditer(run)}
        parts = [(start + m.start(), start + m.end(), sum(map(len, DIGITS.findall(m.group())))) for m in re.finditer(r"[^ ]+", run)]
        for i, (a, _, _) in enumerate(parts):
            count = 0
            for k, (_, b, n) in enumerate(parts[i : i + MOST_PARTS]):
                count += n
                if b - a > LONGEST or count > 19:
                    break
                # each part but the first has two digits or more
                if count < 8 or count < 2 * k + 1 or not "0" <= text[b - 1] <= "9":
                    continue
                at = a + (text[a] == "(" and ")" not in text[a:b])
                piece = text[at:b]
                if count <= 15 and len(piece) > count and not DATE.search(piece):
                    out.add((3, at, b))
                if count >= 13 and not set(piece) & BREAKS and luhn(digits(piece)):
                    out.add((2, at, b))
    return sorted(out)


def shape(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isdigit() else 2 if c.isalpha() else 3


def plain(kind: int, s: str) -> str:
    """A span with its signs put back; a phone without its plus, which others leave out."""
    if kind == 3:
        return s.removeprefix("+")
    s = SIGN.sub(lambda m: "@" if m.group(1) else ".", s)
    return s.replace(" @ ", "@").replace(" . ", ".") if kind == 0 else s


def alike(kind: int, s: str) -> bool:
    """Whether a candidate, its signs put back, is a base match from end to end. Letters of any script count in an email."""
    s = plain(kind, s)
    if kind == 0:
        return bool(EMAIL.fullmatch(re.sub(r"[^\x00-\x7F]", "x", s)))
    _, pattern, valid = NUMERIC[kind - 1]
    return bool((LOCAL if kind == 3 else pattern).fullmatch(s)) and valid(s)


def describe(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    kind, start, end = span
    s = CODE.sub("", text[start:end]) if kind == 3 else plain(kind, text[start:end])
    numbers = digits(s)
    groups = [len(x) for x in re.findall(r"[0-9]+", s)] or [0]
    parts = [value(x) for x in s.split(".") if x.isdigit()] if kind == 1 else [0]
    before = text[max(0, start - LONGEST) : start].split(" ")
    word = before[-1] or (before[-2] if len(before) > 1 else "")
    return [
        kind, len(s), len(numbers), len(groups), max(groups), min(groups), float(luhn(numbers)) if kind == 2 else 0.0,
        s.count("("), s.count("."), s.count("-"), s.count(" "), max(parts or [0]), s.count("@"), sum(c.isalpha() for c in s),
        shape(text[start - 1 : start]), shape(text[end : end + 1]), len(word), float(word[-1:] in (":", "=")),
    ]


@dataclass
class Model:
    trees: Trees
    thresholds: tuple[float, ...]


class Cover:
    """Stretches of a text, joined where they overlap, so that one look tells whether a span meets any."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted((s, e) for _, s, e in spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, span: Span) -> bool:
        at = bisect.bisect_right(self.ends, span[1])
        return at < len(self.starts) and self.starts[at] < span[2]

    def add(self, span: Span) -> None:
        """A span that meets none."""
        at = bisect.bisect_right(self.ends, span[1])
        self.starts.insert(at, span[1])
        self.ends.insert(at, span[2])


def examples(text: str) -> tuple[list[list[float]], list[bool]]:
    """Base spans as positive rows, candidates apart from them as negative ones.

    Candidates that overlap a base span are parts of it and say nothing; those in a run where a match was dropped for
    its neighbours, or that are base matches but for the way their signs are written, are what the trees are to decide,
    so they are no examples either.
    """
    runs = numeric_runs(text)
    good, bad = base_spans(text, runs)
    wide = [x for x in bad if " " in text[x[1] : x[2]] and len(digits(text[x[1] : x[2]])) > 15]
    known = Cover(good + wide)
    rest = [c for c in candidates(text, runs) if not known.meets(c) and not alike(c[0], text[c[1] : c[2]])]
    return [describe(text, s) for s in [*good, *rest]], [True] * len(good) + [False] * len(rest)


def thresholds(counts: np.ndarray, precision: float) -> tuple[float, ...]:
    """For each kind the lowest probability from which on ``precision`` of its rows are positive, but 0.5 at least.

    ``counts`` has the rows by kind, label and bin of probability. A kind with under ten positive rows takes the
    threshold of all kinds together, but ``precision`` itself where that is less or these are under ten too. A kind with
    enough rows that reach the precision nowhere adds nothing.
    """

    def lowest(negative: np.ndarray, positive: np.ndarray) -> float:
        good, rows = np.cumsum(positive[::-1]), np.cumsum((negative + positive)[::-1])
        kept = np.flatnonzero((good >= precision * rows) & (positive[::-1] > 0))
        return max((BINS - 1 - kept[-1]) / BINS, 0.5) if len(kept) else float("inf")

    together = counts.sum(axis=0)
    rare = min(lowest(*together), precision) if together[1].sum() >= 10 else precision
    return tuple(lowest(*c) if c[1].sum() >= 10 else rare for c in counts)


def calibrated(docs: DataFrame, share: float, trees: list[Trees], draw: Column, text: str) -> np.ndarray:
    """Rows of every text by kind, label and bin of probability; the last of ``trees`` scores what no tree was fitted on.

    The other trees were fitted on the sample without one fold each, and score that fold.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def count(batches):
        trees = shared.value
        total = np.zeros(len(KINDS) * 2 * BINS, dtype=np.int64)
        for batch in batches:
            xs: list[list] = [[] for _ in trees]
            ys: list[list] = [[] for _ in trees]
            for body, fold in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = examples(body)
                xs[fold] += x
                ys[fold] += y
            for t, x, y in zip(trees, xs, ys, strict=True):
                if x:
                    x = np.array(x)
                    place = np.minimum((t.probability(x) * BINS).astype(np.int64), BINS - 1)
                    np.add.at(total, (x[:, 0].astype(np.int64) * 2 + np.array(y, dtype=np.int64)) * BINS + place, 1)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["at", "n"])

    fold = F.when(draw < share, F.floor(draw / share * FOLDS).cast("int")).otherwise(F.lit(FOLDS))
    rows = docs.select(whole(text).alias("text"), F.least(fold, F.lit(FOLDS)).alias("fold")).mapInArrow(count, "at long, n long")
    counts = np.zeros(len(KINDS) * 2 * BINS, dtype=np.int64)
    for r in rows.groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[r["at"]] = r["n"]
    return counts.reshape(len(KINDS), 2, BINS)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", bound: int = 20_000, precision: float = 0.995, seed: int = 3) -> Model:
    """Fit the trees on the candidates of at most about ``bound`` texts, thresholds on the rows of every text.

    The base patterns mark which candidates are positive; no other labels are used. Rows of the sample are scored for
    the thresholds by trees that were fitted without their fold.
    """
    prepare(docs.sparkSession)
    total = docs.count()
    share = min(1.0, bound / max(total, 1))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) / float(1 << 30)

    def encode(batches):
        for batch in batches:
            xs, ys, folds = [], [], []
            for body, fold in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = examples(body)
                xs += x
                ys += y
                folds += [fold] * len(x)
            yield pa.record_batch([pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.bool_()), pa.array(folds, pa.int32())], names=["x", "y", "fold"])

    fold = F.floor(draw / share * FOLDS).cast("int").alias("fold")
    rows = docs.filter(draw < share).select(whole(text).alias("text"), fold).mapInArrow(encode, "x array<double>, y boolean, fold int").collect()
    rows.sort(key=lambda r: (r["x"], r["y"], r["fold"]))
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], dtype=float)
    folds = np.array([r["fold"] for r in rows], dtype=int)
    trees = [boost(x[folds != k], y[folds != k]) for k in range(FOLDS)] + [boost(x, y)]
    return Model(trees[-1], thresholds(calibrated(docs, share, trees, draw, text), precision))


def selected(bodies: list[str], model: Model) -> Iterator[tuple[list[Span], list[Span]]]:
    """Base spans and added spans of each text.

    A candidate that overlaps a base span adds nothing. Of candidates above their threshold that overlap each other the
    likeliest stays, then the longest, then the first.
    """
    found, rows = [], []
    for body in bodies:
        runs = numeric_runs(body)
        good, _ = base_spans(body, runs)
        known = Cover(good)
        rest = [c for c in candidates(body, runs) if not known.meets(c)]
        found.append((good, rest))
        rows += [describe(body, c) for c in rest]
    p = model.trees.probability(np.array(rows)) if rows else np.empty(0)
    at = 0
    for good, rest in found:
        scores, at = p[at : at + len(rest)], at + len(rest)
        added: list[Span] = []
        taken = Cover([])
        for _, _, c in sorted((-round(float(q), 6), c[1] - c[2], c) for c, q in zip(rest, scores, strict=True) if q >= model.thresholds[c[0]]):
            if not taken.meets(c):
                added.append(c)
                taken.add(c)
        yield good, sorted(added)


def personal_spans(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Base and added spans of every whole text, in code points, end exclusive.

    Columns: the id, ``base`` and ``added``, arrays of (kind, start, end) by kind as in `KINDS`, then start. A null
    text counts as empty and has no spans. Rows are read each by itself, so ties, repeated rows and other columns change
    nothing; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def mark(batches):
        for batch in batches:
            both = list(selected(batch.column(1).to_pylist(), shared.value))
            columns = [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in x[i]] for x in both], span) for i in range(2)]
            yield pa.record_batch([batch.column(0), *columns], names=[key, "base", "added"])

    kind = "array<struct<kind:string,start:long,end:long>>"
    rows = docs.select(F.col(key), whole(text))
    return rows.mapInArrow(mark, f"`{key}` {rows.schema[0].dataType.simpleString()}, base {kind}, added {kind}")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first covers the rest."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join(out) + text[at:]
