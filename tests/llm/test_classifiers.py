import random

import helpers as h
import numpy as np
import pytest

from lattica.llm import bytescan, op2_quality, op3_rules, op6_toxicity, op8_langid
from lattica.llm.docstats import base_counts


def brute_counts(text):
    w = h.words(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    cover = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if h.words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(cover)


def test_base_counts_by_definition():
    rng = random.Random(1)
    texts = ["", " ", "a\n\na\n a\na", "x y z x y z x y z x y z", "é|é <b> $5\n" * 3, "\x0b\x0c a\x1fb \x85", "a b c d e a b c d e"]
    texts += ["".join(rng.choice(["a ", "b ", "c ", "\n", "é", "# ", "\t"]) for _ in range(rng.randrange(80))) for _ in range(150)]
    raw = [t.encode() for t in texts]
    c = base_counts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    got = list(zip(*(c[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True))
    assert got == [brute_counts(t) for t in texts]


def corpus(good=120, bad=40):
    rows = [(k, h.prose(k, 60), "en", "s", 0, "x", 1) for k in range(good)]
    return rows + [(good + k, " ".join(w + "$$$" for w in h.prose(500 + k, 60).split()), "en", "s", 0, "x", 1) for k in range(bad)]


def test_quality_rules_judge_every_document(spark):
    docs = h.frame(spark, corpus() + h.awkward())
    trusted = spark.createDataFrame([(k,) for k in range(120)], "doc_id long")
    got = op3_rules.quality_rules(docs, trusted).collect()
    assert len(got) == 160 + len(h.awkward())
    base = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all(base[k].kept for k in range(20, 120)) and not any(base[120 + k].kept for k in range(40))
    empty = [r for r in got if r.n_words == 0]
    assert empty and all(r.base_failed and not r.kept and r.log_ratio == 0 for r in empty)


def test_ratio_and_verdict_by_definition(spark):
    from collections import Counter

    rows = corpus(50, 20) + h.awkward()
    trusted = set(range(40))
    n = op3_rules.BUCKETS

    def buckets(text):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        _, _, bounds, hashes = bytescan.word_hashes(raw, np.array([0, len(raw)]))
        return op3_rules._grams(hashes, bounds)[0].tolist()

    grams = [buckets(r[1]) for r in rows]
    assert all(len(g) == max(2 * len(h.words(r[1])) - 1, 0) for g, r in zip(grams, rows, strict=True))
    raw, good = Counter(), Counter()
    for g, r in zip(grams, rows, strict=True):
        raw.update(g)
        if r[0] in trusted:
            good.update(g)
    p_raw = lambda k: (raw[k] + 0.5) / (raw.total() + 0.5 * n)
    p_good = lambda k: (good[k] + op3_rules.SMOOTHING * n * p_raw(k)) / (good.total() + op3_rules.SMOOTHING * n)
    want = []
    for g, r in zip(grams, rows, strict=True):
        ratio = sum(np.log(p_good(k)) - np.log(p_raw(k)) for k in g) / max(len(g), 1)
        w, _, _, _, again = brute_counts(r[1]) if r[0] != 9 else (60_000, 0, 0, 0, 0)
        want.append((str(r[0]), round(ratio, 4), not (w < 10 or 100 * again > 20 * w) and ratio >= op3_rules.THRESHOLD))
    got = op3_rules.quality_rules(h.frame(spark, rows), spark.createDataFrame([(k,) for k in trusted], "doc_id long")).collect()
    assert sorted(want) == sorted((str(r.doc_id), round(r.log_ratio, 4), r.kept) for r in got)


def test_rules_without_trusted_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert op3_rules.quality_rules(h.frame(spark, []), none).count() == 0
    got = op3_rules.quality_rules(h.frame(spark, corpus(10, 2)), none).collect()
    assert all(abs(r.log_ratio) < 1e-5 for r in got)


def labels(spark, rows, kind="label"):
    return spark.createDataFrame(rows, f"doc_id long, {kind} int")


def test_quality_classifier_separates_and_scores_all(spark):
    docs = h.frame(spark, corpus() + h.awkward())
    stats = op2_quality.statistics(docs)
    known = labels(spark, [(k, int(k < 120)) for k in range(160) if k % 3] + [(3, None), (None, 1), (4, 1), (4, 1)])
    got = op2_quality.classify(stats, op2_quality.fit(stats, known)).collect()
    assert len(got) == 160 + len(h.awkward()) and all(0 <= r.score <= 1 for r in got)
    score = {r.doc_id: r.score for r in got}
    assert all(score[k] > 0.7 for k in range(21, 120, 3)) and all(score[k] < 0.5 for k in range(120, 160, 3))


def test_quality_scores_by_the_formula(spark):
    docs = h.frame(spark, corpus(60, 40))
    stats = op2_quality.statistics(docs)
    x = {r.doc_id: np.array(r.x) for r in stats.collect()}
    known = {k: int(k < 60) for k in range(100) if k % 4}
    d, groups = op2_quality.D, {c: np.array([x[k] for k, y in known.items() if y == c]) for c in (0, 1)}
    own = {c: np.cov(g.T, bias=True) for c, g in groups.items()}
    n = {c: len(g) for c, g in groups.items()}
    pooled = (own[0] * n[0] + own[1] * n[1]) / (n[0] + n[1])
    log_density = {}
    for c in (0, 1):
        lean = max(op2_quality.POOLED, d / (d + n[c]))
        cov = (1 - op2_quality.SPHERE) * ((1 - lean) * own[c] + lean * pooled) + op2_quality.SPHERE * max(np.trace(pooled) / d, 1e-6) * np.eye(d)
        mean, inverse, det = groups[c].mean(0), np.linalg.inv(cov), np.linalg.slogdet(cov)[1]
        log_density[c] = {k: -0.5 * ((v - mean) @ inverse @ (v - mean) + det) for k, v in x.items()}
    model = op2_quality.fit(stats, labels(spark, list(known.items())))
    for r in op2_quality.classify(stats, model).collect():
        z = (log_density[1][r.doc_id] - log_density[0][r.doc_id] + np.log(n[1] / n[0])) / op2_quality.TEMPERATURE
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(z, -500, 500)))) < 1e-6
    assert op2_quality.classify(op2_quality.statistics(h.frame(spark, [])), model).count() == 0


@pytest.mark.parametrize("rows,want", [([], 0.5), ([(1, 1), (2, 1)], 1.0)])
def test_quality_without_both_classes(spark, rows, want):
    stats = op2_quality.statistics(h.frame(spark, h.awkward()))
    got = op2_quality.classify(stats, op2_quality.fit(stats, labels(spark, rows))).collect()
    assert {r.score for r in got} == {want}


def toxic_corpus(n=240):
    rng, rows, marks = random.Random(9), [], []
    for k in range(n):
        w = h.prose(1000 + k, 50 + rng.randrange(200)).split()
        toxic = k % 4 == 0
        for _ in range(3 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["Vilezor", "vilezorish!", "gruntok", "GRUNTOKS"]))
        rows.append((k, " ".join(w), "en", "s", 0, "x", 1))
        marks.append((k, int(toxic)))
    return rows, marks


def test_toxicity_on_held_out_rows(spark):
    rows, marks = toxic_corpus()
    docs = h.frame(spark, rows + h.awkward())
    model = op6_toxicity.fit(docs, labels(spark, [m for m in marks if m[0] < 200] + [(5, None), (None, 1)], "toxic"))
    rows = op6_toxicity.score(docs, model).collect()
    got = {r.doc_id: r.score for r in rows}
    assert all((got[k] >= 0.3) == (k % 4 == 0) for k in range(200, 240))
    assert all(0 <= s <= 1 for s in got.values())
    kept = op6_toxicity.keep_ordinary(docs, model)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if r.score < 0.3)


def test_toxicity_tells_words_apart_that_share_hash_bits(spark):
    # two words of one head whose hashes agree in 19 bits, one toxic and one ordinary
    n = 3_000_000
    data = np.empty((n, 10), np.uint8)
    data[:, :4] = np.frombuffer(b"vile", np.uint8)
    for j in range(6):
        data[:, 4 + j] = 97 + np.arange(n) // 26**j % 26
    at = np.arange(n) * 10
    top = lambda x, starts, ends: bytescan.piece_hash(x, starts, ends) >> np.uint64(45)
    word = top(np.frombuffer(b"vilezor", np.uint8), np.array([0]), np.array([7]))
    twin = data[np.flatnonzero(top(data.ravel(), at, at + 10) == word)[0]].tobytes().decode()
    rng, rows = random.Random(4), []
    for k in range(200):
        w = h.prose(1000 + k, 100).split()
        for _ in range(3):
            w.insert(rng.randrange(len(w)), twin if k % 4 else "vilezor")
        rows.append((k, " ".join(w), "en", "s", 0, "x", 1))
    docs = h.frame(spark, rows)
    model = op6_toxicity.fit(docs, labels(spark, [(k, int(k % 4 == 0)) for k in range(160)], "toxic"))
    got = {r.doc_id: r.score for r in op6_toxicity.score(docs, model).collect()}
    assert all((got[k] >= 0.3) == (k % 4 == 0) for k in range(160, 200))


@pytest.mark.parametrize("held", [0, 7, 300])
def test_toxicity_does_not_depend_on_what_workers_hold(spark, monkeypatch, held):
    rows, marks = toxic_corpus(160)
    docs = h.frame(spark, rows + h.awkward() + [(2000 + k, "Gruntok unheardof " * 3, "en", "s", 0, "x", 1) for k in range(3)])
    marks = labels(spark, [m for m in marks if m[0] < 130], "toxic")
    order = lambda model: sorted(((str(r.doc_id), r.score) for r in op6_toxicity.score(docs, model).collect()))
    whole = op6_toxicity.fit(docs, marks)
    monkeypatch.setattr(op6_toxicity, "HELD_WORDS", held)
    joined = op6_toxicity.fit(docs, marks)
    assert whole.words is None and joined.words is not None
    got, want = order(joined), order(whole)
    assert [d for d, _ in got] == [d for d, _ in want]
    assert np.allclose([s for _, s in got], [s for _, s in want], rtol=0, atol=1e-9)
    kept = op6_toxicity.keep_ordinary(docs, joined)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(d for d, s in want if s < 0.3)


@pytest.mark.parametrize("marks,want", [([], 0.0), ([(1, 1)], 1.0), ([(1, 0)], 0.0)])
def test_toxicity_without_both_classes(spark, marks, want):
    docs = h.frame(spark, h.awkward())
    assert {r.score for r in op6_toxicity.score(docs, op6_toxicity.fit(docs, labels(spark, marks, "toxic"))).collect()} == {want}
    assert op6_toxicity.score(h.frame(spark, []), 0.0).count() == 0


LANGS = {"aa": ["bar", "lom", "tik", "zor"], "bb": ["étu", "nuage", "çal", "œuv"], "cc": ["ßen", "über", "sch", "grü"]}


def language_rows(n=120):
    rng = random.Random(2)
    return [(k, " ".join("".join(rng.choice(LANGS[lang]) for _ in range(1 + rng.randrange(3))) for _ in range(30)), lang, "s", 0, "x", 1) for k in range(n) for lang in [sorted(LANGS)[k % 3]]]


def test_language_on_held_out_rows(spark):
    rows = language_rows()
    model = op8_langid.fit(h.frame(spark, rows[:90] + [(999, "bar bar", None, "s", 0, "x", 1), (998, None, "aa", "s", 0, "x", 1)]))
    got = op8_langid.identify(h.frame(spark, rows[90:]), model).collect()
    assert all(r.lang_pred == sorted(LANGS)[r.doc_id % 3] and 0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: (r.lang_pred, r.score) for r in op8_langid.identify(h.frame(spark, h.awkward()), model).collect()}
    assert odd[1] == odd[2] == odd[3] == ("und", 0.0) and odd[5][0] in LANGS
    assert op8_langid.identify(h.frame(spark, []), model).count() == 0


def test_language_terms_and_learning_by_definition():
    from collections import Counter

    m32, bits = (1 << 32) - 1, op8_langid.BITS

    def cells(text):
        c = [ord(x.lower()) if x.isalpha() else 32 for x in text]
        out = Counter()
        for i in range(len(c)):
            hh = c[i] * 0x9E3779B1 & m32
            out[hh >> (32 - bits)] += 1
            for k in (1, 2):
                if i + k < len(c):
                    hh = ((hh ^ hh >> 15) * 0x85EBCA77 + c[i + k] * 0xC2B2AE3D) & m32
                    out[((hh ^ hh >> 13) * 0x27D4EB2F & m32) >> (32 - bits)] += 1
        return out

    texts = ["", "Ab 1c", "über Straße!", "ÉTÉ été", "x", "漢字 kana ..", " "]
    raw = [t.encode() for t in texts]
    rows, at, counts, has = op8_langid.terms(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    got = [Counter() for _ in texts]
    for r, c, k in zip(rows.tolist(), at.tolist(), counts.tolist(), strict=True):
        got[r][c] = k
    assert got == [cells(t) for t in texts] and has.tolist() == [any(x.isalpha() for x in t) for t in texts]

    # FTRL with elastic net, coordinate by coordinate
    rng = random.Random(3)
    ftrl, z, n = op8_langid.Ftrl(3), {}, {}
    weight = lambda y, i: 0.0 if abs(z.get((y, i), 0)) <= op8_langid.L1 else (np.sign(z[y, i]) * op8_langid.L1 - z[y, i]) / ((op8_langid.BETA + n[y, i] ** 0.5) / op8_langid.ALPHA + op8_langid.L2)
    for _ in range(60):
        x = {rng.randrange(40): rng.random() for _ in range(5)}
        label = rng.randrange(3)
        ftrl.learn(np.array(list(x)), np.array(list(x.values())), label)
        x[op8_langid.CELLS] = 1.0
        e = np.exp([sum(weight(y, i) * v for i, v in x.items()) for y in range(3)])
        p = e / e.sum()
        before = {(y, i): weight(y, i) for y in range(3) for i in x}
        for y in range(3):
            for i, v in x.items():
                g = (p[y] - (y == label)) * v
                old = n.get((y, i), 0.0)
                n[y, i] = old + g * g
                z[y, i] = z.get((y, i), 0.0) + g - (n[y, i] ** 0.5 - old**0.5) / op8_langid.ALPHA * before[y, i]
    got = ftrl.weights()
    assert np.allclose(got[:, :40], [[weight(y, i) for i in range(40)] for y in range(3)])


def test_language_with_nothing_to_learn(spark):
    docs = h.frame(spark, [(1, "a", None, "s", 0, "x", 1)])
    model = op8_langid.fit(docs)
    assert model is None and op8_langid.identify(docs, model).first().lang_pred == "und"
