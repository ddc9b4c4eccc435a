"""Operators against brute force on small tables with nulls, empty and long texts, repeated rows and odd columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import exact, hidden, jaccard, language, mixing, neighbours, packing, personal, quality, repeats, runs
from evidentia.llm.common import id_fold

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, row long"


def words(draw, n):
    return [draw.choice(["the", "of", "tion", "ing", "re", "and"]) + draw.choice("abcdefgh") + str(draw.randrange(40)) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(4)
    base = words(draw, 300)
    out = [(0, None, "en", None), (1, "", "en", "a"), (2, "  \n", "en", "a"), (3, "One two", None, "b"), (4, "one TWO", "en", "b")]
    for i in range(5, 45):
        copy = list(base)
        for _ in range(draw.randrange(12)):
            copy[draw.randrange(300)] = f"w{draw.randrange(10**6)}"
        out.append((i, " ".join(copy), "en", f"s{i % 3}"))
    out += [(i, " ".join(words(draw, draw.randrange(1, 200))), "fr", "s9") for i in range(45, 80)]
    out += [(80, "ab " * 30_000, "en", "s1"), (81, out[20][1], "en", "s1"), (82, out[20][1], "de", None), (83, "é" * 500 + "x" + "é" * 500, "fr", "s1")]
    return [(*r, 0, 1, "k", 2) for r in [*out, out[10], out[10]]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def test_loser_tree():
    draw = random.Random(1)
    for _ in range(300):
        lists = [sorted(bytes(draw.choice(b"ab") for _ in range(draw.randrange(9))) for _ in range(draw.randrange(6))) for _ in range(draw.randrange(6))]
        out = list(runs.merge([runs.front_code(x) for x in lists]))
        assert [s for _, s, _ in out] == sorted(s for x in lists for s in x)
        last = b""
        for run, s, shared in out:
            assert shared == runs.common(last, s) and s in lists[run]
            last = s


@pytest.mark.parametrize("hot", [32, 1])
def test_repeats(docs, empty, rows, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    length = 40
    bodies = [(r[0], (r[1] or "").encode()) for r in rows]
    count = Counter(b[i : i + length] for _, b in bodies for i in range(len(b) - length + 1))
    want = []
    for key, b in bodies:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        want.append((key, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    out = repeats.without_repeats(docs, length=length).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert repeats.without_repeats(empty).count() == 0


def sets_of(rows, n):
    out = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    return out


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard(docs, empty, rows, monkeypatch, n, percent):
    monkeypatch.setattr(jaccard, "HOT", 4)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 8)
    sets = sets_of(rows, n)
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = defaultdict(lambda: 10**9)
    for r, g in zip(rows, group):
        least[g] = min(least[g], r[0])
    out = jaccard.similar_groups(docs, n=n, percent=percent)
    assert sorted(map(tuple, out.collect())) == sorted((r[0], len(s), least[g]) for r, s, g in zip(rows, sets, group))
    assert jaccard.similar_groups(empty).count() == 0
    kept = jaccard.without_near_copies(docs, n=n, percent=percent)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(least.values())


def test_exact(docs, empty, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = exact.exact_groups(docs).collect()
    assert len(out) == len(rows)
    text = {r[0]: r[1] or "" for r in rows}
    for r in out:
        own = groups[text[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"]) == (max(own), len(own))
        assert r["text_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()
    assert sum(r["kept"] for r in out) == len(groups)
    left = exact.without_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r["text"] or "" for r in left.collect()) == sorted(groups)
    assert exact.without_copies(empty).count() == exact.exact_groups(empty).count() == 0


def test_quality(docs, empty, spark):
    draw = random.Random(2)
    good = [(i, " ".join(words(draw, 60)), 1) for i in range(100)]
    bad = [(i, " ".join(w.upper() + "!!" for w in words(draw, 60)), 0) for i in range(100, 200)]
    model = quality.train(spark.createDataFrame(good + bad, "doc_id long, text string, quality int"))
    new = [(" ".join(words(draw, 50)), 1) for _ in range(20)] + [(" ".join(w.upper() + "!!" for w in words(draw, 50)), 0) for _ in range(20)]
    assert all((p > 0.5) == bool(y) for p, (_, y) in zip(quality.scored([x for x, _ in new], model), new))
    out = quality.quality_scores(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert quality.quality_scores(empty, model).count() == 0
    assert quality.accepted(docs, model, 0.0).columns == docs.columns
    none = quality.train(spark.createDataFrame([], "doc_id long, text string, quality int"))
    assert quality.scored(["a"], none) == [0.5]


def test_jaccard_prunes_large_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 4)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, 100, dtype=np.uint64)) for _ in range(20)]
    sets[7] = np.unique(np.append(sets[3][1:], np.uint64(5)))
    sizes = spark.createDataFrame([(i, len(s), bytearray(jaccard.sketch(s))) for i, s in enumerate(sets)], "node long, n long, sketch binary")
    shared = spark.createDataFrame([(sig, i) for sig in (1, 2) for i in range(20)], "sig long, node long")
    left = jaccard.plausible(shared, sizes, 85).collect()
    # what is left of both groups is one group of the two similar sets
    assert sorted(r["node"] for r in left) == [3, 7] and len({r["sig"] for r in left}) == 1


def test_packing_encodes_new_words_by_known_parts(monkeypatch):
    import tokenizers

    asked, model = [], tokenizers.Tokenizer.from_file(packing.public_path())

    class Listener:
        from_file = staticmethod(lambda path: Listener())

        def encode_batch_fast(self, words, **options):
            asked.extend(words)
            return model.encode_batch_fast(words, **options)

    monkeypatch.setattr(tokenizers, "Tokenizer", Listener)
    encode = packing.word_encoder.__wrapped__(packing.public_path())
    bodies = [b"the House, it's red", b"(THE) house's 7red.", "h\u00e9 \x1cthe''s".encode()]
    ids = [np.frombuffer(x, "<u4").tolist() for x in encode(bodies)]
    assert ids == [model.encode(x.decode(), add_special_tokens=False).ids for x in bodies]
    assert asked.count("the") == 1 and "house's" not in asked and "House," not in asked


def test_packing(docs, empty, rows):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.public_path())
    want = Counter((r[0], tuple([*model.encode(r[1] or "", add_special_tokens=False).ids, 2])) for r in rows)
    out = packing.pack(docs, keep_ids=True).collect()
    whole, places = defaultdict(list), defaultdict(list)
    for r in sorted(out, key=lambda r: r["start"]):
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        whole[r["doc_id"]] += r["ids"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for (key, ids), n in want.items():
        assert len(whole[key]) == n * len(ids) and (n > 1 or tuple(whole[key]) == ids)
    assert sorted(places) == list(range(len(places)))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(empty).count() == 0


def test_packing_plan():
    draw = random.Random(3)
    counts = Counter(min(4096, 1 + int(draw.expovariate(1 / 700))) for _ in range(20_000))
    plan = packing.shortest_pack_first(counts, 4096)
    placed = Counter()
    for n, lengths in plan:
        assert sum(lengths) <= 4096
        for x in lengths:
            placed[x] += n
    assert placed == counts
    assert sum(n for n, _ in plan) * 4096 < 1.01 * sum(k * v for k, v in counts.items())


def test_hidden_markov(docs, empty, rows):
    s = hidden.Settings(own=50, known=80, classes=8, states=3, warm=2, rounds=1)
    counts = Counter(w for r in rows if id_fold(r[0], 10) for w in hidden.split((r[1] or "").encode()))
    total = sum(counts.values())
    from evidentia.llm.common import fold

    out = hidden.language_scores(docs, fold("doc_id", 10) != 0, settings=s).collect()
    assert len(out) == len(rows)
    text = {r[0]: r[1] or "" for r in rows}
    for r in out:
        w = hidden.split(text[r["doc_id"]].encode())
        base = sum(np.log10((counts[x] + 0.1) / (total + 0.1 * (len(counts) + 1))) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), total)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and r["score"] < 0
    assert hidden.language_scores(empty, F.lit(True), settings=s).count() == 0


def test_hidden_markov_rounds_cover_every_text(spark):
    draw = np.random.default_rng(5)
    bodies = [draw.integers(0, 12, draw.integers(3, 60)).astype("<u2") for _ in range(2_000)]
    bodies = [b // 6 + 6 * (np.arange(len(b), dtype="<u2") % 2) if i % 3 else b for i, b in enumerate(bodies)]
    v = hidden.Vocabulary([b"%d" % i for i in range(12)], np.bincount(np.concatenate(bodies), minlength=12), 1, 12, np.zeros(2), np.zeros(2), 12)
    s = hidden.Settings(own=12, known=12, classes=2, states=3, warm=4, rounds=30)
    start = hidden.baum_welch(spark.createDataFrame([(False, b"")], "learn boolean, symbols binary"), v, s)
    chain, likely = start, []
    while len(likely) < 34 and (len(likely) <= 4 or likely[-1] - likely[-2] >= s.settled * abs(likely[-1])):
        *counts, now = hidden.expected(chain, bodies)
        chain, likely = hidden.improved(*counts, v.weights()), [*likely, now]
    rows = [(True, b.tobytes()) for b in bodies]
    one = hidden.baum_welch(spark.createDataFrame(rows, "learn boolean, symbols binary").repartition(1), v, s)
    many = hidden.baum_welch(spark.createDataFrame(rows[::-1], "learn boolean, symbols binary").repartition(7), v, s)
    for out in (one, many):
        assert all(np.allclose(getattr(out, k), getattr(chain, k), rtol=2e-3, atol=1e-5) for k in ("start", "step", "emit"))


def test_forward_is_the_sum_over_paths():
    import itertools

    draw = np.random.default_rng(0)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    chain = hidden.Chain(norm(draw.random(2), 0), norm(draw.random((2, 2)), 1), norm(draw.random((4, 2)), 0), np.ones(2) / 2)
    for text in ([0], [1, 3, 2, 0, 1], [2, 2]):
        total = sum(
            chain.start[p[0]] * np.prod([chain.emit[s, k] for s, k in zip(text, p)]) * np.prod([chain.step[a, b] for a, b in zip(p, p[1:])])
            for p in itertools.product(range(2), repeat=len(text))
        )
        assert np.isclose(hidden.likelihoods(chain, [np.array(text)])[0], np.log10(total))


def test_mixing(docs, empty, rows):
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, mixing.mix(docs).collect()), key=repr)
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len((r[1] or "").encode().split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, free, rest = {}, set(size), float(sum(size.values()))
    while free:
        level = rest / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] > 3 * size[s]}
        if not above:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 3.0 * size[s] for s in above}
        rest -= sum(3.0 * size[s] for s in above)
        free -= above
    for r in out:
        assert r["source_size"] == size[r["source"]] and np.isclose(r["target"], target[r["source"]])
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_neighbours(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(600, 8)).astype(float)
    x[50:90] = x[40]
    table = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(600, None, 0), (620, [0.0] * 8, 0), (640, [float("nan")] * 8, 0), (660, [None] * 8, 0)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, rank int")
    found = defaultdict(list)
    for r in sorted(neighbours.nearest(df, F.col("vec_id") % 20 == 0, factor=1.0, shard_rows=150, block_rows=10).collect(), key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    assert sorted(found) == list(range(0, 600, 20))
    for q, got in found.items():
        scores = (x * x[q]).sum(axis=1)
        want = sorted((-round(s, 9), i) for i, s in enumerate(scores) if i != q)[:20]
        assert [i for i, _ in got] == [i for _, i in want] and np.allclose([s for _, s in got], [-s for s, _ in want])
    hits = neighbours.nearest(df, F.col("vec_id") % 20 == 0)
    assert sum((r["vec_id"] in {i for i, _ in found[r["query_id"]]}) for r in hits.collect()) >= 0.9 * 600
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0


BASE = (("email", personal.EMAIL), ("ip", personal.IP), ("card", personal.CARD), ("phone", personal.PHONE))


def test_personal(docs, empty, spark):
    texts = ["a.b@c.de, x@y", "1.2.3.4.5.6.7.8 and 1.2.3.400", "4111 1111 1111 1111 x 4111111111111112", "+1 (269) 555-3296 4524132264652876 +1 2", "ä@b.c é+49 30 1234567", ""]
    for text in texts:
        good = []
        for kind, (name, pattern) in enumerate(BASE):
            for m in pattern.finditer(text):
                n = re.sub("[^0-9]", "", m.group())
                if name == "email" or name == "ip" and max(map(int, m.group().split("."))) < 256 or name == "card" and 16 <= len(n) <= 19 and personal.luhn([*map(int, n)]) or name == "phone" and 8 <= len(n) <= 15:
                    good.append((kind, *m.span()))
        assert personal.base_spans(text, personal.numeric_runs(text))[0] == good
    many = [(i, f"call +1 ({200 + i % 700}) 555-{1000 + i} or 10.0.{i % 200}.9 or m{i}@b.com, id {10**9 + i} v {i}.2", 0) for i in range(400)]
    model = personal.train(spark.createDataFrame(many, "doc_id long, text string, base int"))
    (base, added), = personal.selected(["+1 (269) 555-3296 4524132264652876 end"], model)
    assert base == [] and (3, 0, 17) in added
    assert next(personal.selected(["nothing at 12:30 on 2024-01-02, 4.0"], model)) == ([], [])
    assert personal.personal_spans(docs, model).count() == docs.count()
    assert personal.personal_spans(empty, personal.train(empty)).count() == 0
    assert personal.redacted("a x@y.zz b", [(0, 2, 8)]) == "a [email] b"


def test_personal_written_out_forms_are_no_negatives(spark):
    forms = ["joe{0} [at] mail (dot) com", "joe{0}[AT]mail[Dot]com", "10[.]0[.]7[.]9", "10(DOT)0(dot)7.9", "({1}) 555-2368", "{1}-555-2368", "1234-5{1}"]
    for form in forms:
        text = f"mail {form.format(5, 212)} or"
        assert personal.candidates(text, personal.numeric_runs(text)) and personal.examples(text) == ([], [])
    for text in ("at 12.50 13.75 14.25 or", "is 1.2.3.400 or", "dinner (at) home. Then we"):
        labels = personal.examples(text)[1]
        assert labels and not any(labels)
    for text in ("in 2019-2020 or", "on 01-02-2024 or", "on 2024-01-02 03"):
        assert personal.candidates(text, personal.numeric_runs(text)) == []
    some = [(i, f"joe{i}@mail.com, +1 ({200 + i % 700}) 555-{1000 + i} or 10.0.{i % 200}.{i % 9} end {i % 90 + 10}.50 {i % 80 + 10}.25 13.75 or {i % 200}.2.3.400 end" + f" or {forms[i % 7].format(i, 200 + i % 700)} end" * (i % 4 == 0), 0) for i in range(900)]
    model = personal.train(spark.createDataFrame(some, "doc_id long, text string, base int"))
    for form in forms[:6]:
        span = form.format(7, 212)
        (base, added), = personal.selected([f"or {span} end"], model)
        assert base == [] and [s[1:] for s in added] == [(3, 3 + len(span))]
    assert next(personal.selected(["costs 12.50 13.75 14.25 here"], model)) == ([], [])


def test_personal_thresholds_cover_every_text(spark):
    rare = lambda i: f" joe{i}@mail.com" * (i % 40 == 0)
    some = [(i, f"or 10.0.{i % 200}.{i % 9} end {i % 90 + 10}.50 {i % 80 + 10}.25 13.75 or {i % 200}.2.3.400 end{rare(i)}", 0) for i in range(1200)]
    docs = spark.createDataFrame(some, "doc_id long, text string, base int")
    model = personal.train(docs, bound=300)
    draw = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    counts = personal.calibrated(docs, 0.25, [model.trees] * (personal.FOLDS + 1), draw, "text")
    labels = [(int(x[0]), y) for _, text, _ in some for x, y in zip(*personal.examples(text))]
    assert {(k, bool(y)): int(counts[k, y].sum()) for k in range(4) for y in (0, 1) if counts[k, y].any()} == Counter(labels)
    assert counts[0, 1].sum() == 30 and max(model.thresholds[:2]) < 1
    few = personal.train(docs.limit(60))
    assert max(few.thresholds) < float("inf")
    made = np.zeros((4, 2, personal.BINS), dtype=np.int64)
    made[0, 1, [1800, 1400]], made[0, 0, [1500, 100]] = 1000, (3, 900)
    made[1, :, 1900] = 50
    made[2, 1, 1700] = 5
    assert personal.thresholds(made[:1], 0.995) == (0.7,)
    assert personal.thresholds(made[1:3], 0.995) == (float("inf"), 0.995) and personal.thresholds(made[2:3], 0.995) == (0.995,)


def test_language(docs, empty, spark):
    draw = random.Random(6)
    say = lambda parts: " ".join("".join(draw.choice(parts) for _ in range(3)) for _ in range(30))
    parts = {"en": ["the", "ing", "wh", "ly"], "fr": ["eau", "oi", "é", "que"]}
    table = [(i, say(parts[x]), x) for i in range(100) for x in parts]
    model = language.train(spark.createDataFrame([*table, (999, "the", None)], "doc_id long, text string, lang string"))
    new = spark.createDataFrame([(i, say(parts[x]), x) for i in range(20) for x in parts], "doc_id long, text string, lang string")
    out = language.identify(new, model, keep=(F.col("lang"),)).collect()
    assert all(r["lang"] == r["lang_pred"] and 0 <= r["score"] <= 1 for r in out)
    assert (model.weights == 0).mean() > 0.5
    by_id = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, model).collect()}
    assert by_id[0] == by_id[1] == by_id[2] == language.UNKNOWN and by_id[3] in ("en", "fr")
    none = language.train(empty)
    assert {r["lang_pred"] for r in language.identify(docs, none).collect()} == {language.UNKNOWN}


LONG = {
    "digits": "1" * 1_000_000,
    "digits and dots": "1" * 100_000 + ".1.1.1 " + "0" * 100_000 + "1.2.3.4",
    "single digits": "1 " * 500_000,
    "signs": "+ " * 500_000,
    "a local part": "a" * 1_000_000 + "@",
    "at signs": "a@" * 500_000,
    "written-out sign first": "(at)" + "a" * 1_000_000,
    "written-out sign last": "a" * 1_000_000 + "(at)",
    "dots": "1." * 500_000,
    "numbers": " ".join(str(i * 7919 % 1_000_000) for i in range(150_000)),
    "a domain": "a@" + "b." * 500_000 + "c",
    "brackets": "(" * 1_000_000,
}


@pytest.mark.parametrize("name", LONG)
def test_personal_data_in_long_texts_of_any_kind(name):
    """One pass over a megabyte, whatever it is made of: no scan begins anew at each character."""
    began = time.process_time()
    personal.examples(LONG[name])
    assert time.process_time() - began < 8  # 2 s on an idle machine


def test_base_spans_of_dense_texts_equal_the_patterns():
    draw = random.Random(3)
    for _ in range(3000):
        letters = draw.choice(["a1.@-+ ", "01.", "0123456789 -", "+1 ().-2", "ab@.", "5 -", "1. ", "a@b.c(at)[at][dot] "])
        body = "".join(draw.choice(letters) for _ in range(draw.randrange(60)))
        want = [(0, *m.span()) for m in personal.EMAIL.finditer(body)]
        want += [(k, *m.span()) for k, pattern, valid in personal.NUMERIC for m in pattern.finditer(body) if valid(m.group())]
        assert personal.base_spans(body, personal.numeric_runs(body))[0] == sorted(want)
        signs = "".join(draw.choice(["a", "(at)", "[at]", " ", ".", "(dot)", "[.]", "b", "-"]) for _ in range(draw.randrange(30)))
        assert list(personal.hidden_emails(signs)) == [m.span() for m in personal.HIDDEN_EMAIL.finditer(signs)]


def test_columns_with_reserved_looking_names_pass_unchanged(spark):
    """Operators that return their input's columns do not mistake them for their own."""
    names = ["text_sha256", "keep_id", "node", "component_id", "rank", "copies", "size", "u", "v", "kept", "group"]
    rows = [(i, f"text {i // 2} of some words", "s", *range(len(names))) for i in range(6)] + [(5, "another text under one id", "s", *range(len(names)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} long" for n in names))
    for out in (exact.without_copies(docs), jaccard.without_near_copies(docs), mixing.mixed_documents(docs)):
        assert out.columns == docs.columns
        assert {tuple(r)[3:] for r in out.collect()} == {tuple(range(len(names)))}
