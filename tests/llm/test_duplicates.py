import random

import helpers as h
import pytest

from lattica.llm import components as cp
from lattica.llm import op5_suffix, op7_neardup


@pytest.mark.parametrize("one_task", [10**6, 0])
def test_components(spark, one_task):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5)]
    want = h.components({x for e in links for x in e}, links)
    got = {r.node: r.label for r in cp.components(spark.createDataFrame(links, "u long, v long"), one_task).collect()}
    alone = {n for n, c in want.items() if n not in got}
    assert all(want[n] == c for n, c in got.items()) and alone <= {5}
    assert cp.components(spark.createDataFrame([], "u long, v long"), one_task).count() == 0


def copies(seed, n, words=120, edits=8):
    rng = random.Random(seed)
    base = h.prose(seed, words).split()
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"e{seed}x{k}y{rng.randrange(99)}"
        out.append(" ".join(w))
    return out


def check(spark, rows, n, percent):
    got = op7_neardup.near_duplicates(h.frame(spark, rows), n, percent).collect()
    docs = {r[0]: r[1] for r in rows if r[0] is not None}
    want = h.near(docs, n, percent)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept, r.n_shingles) == (want[r.doc_id], r.doc_id == want[r.doc_id], len(h.shingle_set(docs[r.doc_id], n)))


def test_near_duplicates_equal_brute_force(spark):
    texts = [t for s in range(12) for t in copies(s, 9)] + copies(50, 30, words=20, edits=3) + [h.prose(k, 40) for k in range(300, 340)]
    check(spark, [(k, t, "en", "s", 0, "x", 1) for k, t in enumerate(texts)] + [(r[0] and r[0] + 10_000, *r[1:]) for r in h.awkward()], 4, 80)


def test_large_pool_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(op7_neardup, "BLOCK", 8)
    monkeypatch.setattr(op7_neardup, "PIVOTS", 4)
    texts = copies(7, 90, words=100, edits=14) + copies(8, 40, words=60, edits=10)
    check(spark, [(k, t, "en", "s", 0, "x", 1) for k, t in enumerate(texts)], 4, 80)


def test_crowded_regions_keep_links(spark, monkeypatch):
    monkeypatch.setattr(op7_neardup, "REGION", 6)
    check(spark, [(k, t, "en", "s", 0, "x", 1) for k, t in enumerate(copies(9, 80, words=200, edits=4))], 5, 80)


def test_links_across_the_bounds_of_many_ranges(spark, monkeypatch):
    # 64 ranges of some 50 labels: most neighbourhoods cross a bound
    monkeypatch.setattr(op7_neardup, "RANGE_LABELS", 1)
    monkeypatch.setattr(op7_neardup, "CHUNK", 7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        texts = [t for s in range(40) for t in copies(500 + s, 3, words=80, edits=4)]
        check(spark, [(k, t, "en", "s", 0, "x", 1) for k, t in enumerate(texts)], 4, 80)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_links_in_a_crowd_that_shares_a_label(spark):
    # a third of all documents have most of their words in common, and so many equal MinHash values, but few are linked
    rng = random.Random(12)
    frame = h.prose(600, 150).split()
    crowd = []
    for k in range(150):
        w = list(frame)
        for i in rng.sample(range(150), 12):
            w[i] = f"c{k}w{i}"
        crowd.append(w)
    twins = [[*w[:75], f"t{k}", *w[76:]] for k, w in enumerate(crowd[:30])]
    texts = [" ".join(w) for w in crowd + twins] + [h.prose(7000 + k, 60) for k in range(300)]
    check(spark, [(k, t, "en", "s", 0, "x", 1) for k, t in enumerate(texts)], 4, 80)


def test_keep_first_keeps_one_of_equal_rows(spark):
    rows = [(1, h.prose(1, 50), "en", "a", 1, "x", 1), (1, h.prose(1, 50), "en", "b", 1, "x", 1), (2, h.prose(1, 50) + " end", "en", "a", 1, "x", 1), (None, h.prose(2, 50), "en", "a", 1, "x", 1), (None, h.prose(2, 50), "en", "a", 1, "x", 1)]
    rows += [(3, None, None, None, None, None, None)] * 2 + [(None, "", "en", "a", 0, "x", 1)] * 2 + [(5, h.prose(3, 50), "en", "a", 1, "x", 1), (5, h.prose(4, 50), "en", "a", 1, "x", 1)]
    got = op7_neardup.keep_first(h.frame(spark, rows))
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, got.collect())) == sorted(map(key, [rows[0], rows[3], *rows[5:]]))
    assert op7_neardup.keep_first(h.frame(spark, [])).count() == 0


def test_near_duplicates_of_nothing(spark):
    assert op7_neardup.near_duplicates(h.frame(spark, [])).count() == 0
    got = op7_neardup.near_duplicates(h.frame(spark, [(3, None, None, None, None, None, None), (2, "", None, None, None, None, None)])).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(3, 0, 3, True), (2, 0, 2, True)}


def suffix(spark, rows, length=200):
    got = op5_suffix.remove_repeats(h.frame(spark, rows), length)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()), key=repr)


@pytest.mark.parametrize("crowd", [1000, 2])
def test_repeats_equal_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(op5_suffix, "CROWD", crowd)
    passage, edge = h.prose(99, 80), h.prose(98, 60)
    rng = random.Random(5)
    rows = [(100 + k, h.prose(k, rng.randrange(60)) + " " + passage[rng.randrange(40) :] + " " + h.prose(900 + k, 20) + edge[: rng.randrange(len(edge))], "en", "s", 0, "x", 1) for k in range(25)]
    rows += [(200 + k, t, "en", "s", 0, "x", 1) for k, t in enumerate(copies(3, 8, words=150))]
    rows += [(300, "ab" * 300, "en", "s", 0, "x", 1), (301, "z" * 199, "en", "s", 0, "x", 1), (302, "z" * 200, "en", "s", 0, "x", 1), (303, "é" * 150, "en", "s", 0, "x", 1)]
    rows += [r for r in h.awkward() if r[0] != 9]
    assert suffix(spark, rows) == sorted(h.removed([r[:2] for r in rows]), key=repr)


def test_equal_contents_without_ids(spark):
    # unique texts stay whole however many rows have no doc_id; equal ones go, extra columns stay
    rows = [(None, h.prose(k, 45), "en", f"s{k}", k, "x", 1) for k in range(600)] + [(None, h.prose(9000, 60), "en", "s", 1, "x", 1)] * 3
    got = op5_suffix.remove_repeats(h.frame(spark, rows)).collect()
    assert len(got) == 603 and all((r.n_removed > 0) == (r.n_bytes > 200 and r.kept == "") for r in got)
    assert sum(r.n_removed > 0 for r in got) == 3 and {r.source for r in got} == {r[3] for r in rows}


def test_prefixes_decide(spark, monkeypatch):
    # contents that one hash stands for aren't repeats of each other: bytes are compared
    import numpy as np

    whole = op5_suffix.segments

    def constant(data, offsets, length=200):
        doc, first, last, p, g, h_ = whole(data, offsets, length)
        return doc, first, last, p, np.zeros_like(g) + np.uint64(5), h_

    monkeypatch.setattr(op5_suffix, "segments", constant)
    monkeypatch.setattr(op5_suffix, "CROWD", 10**6)
    local = [(k, t, "en", "s", 0, "x", 1) for k, t in enumerate(copies(21, 5, words=90) + [h.prose(300 + k, 50) for k in range(5)])]
    texts = [(t or "").encode() for _, t, *_ in local]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    doc, first, last, p, g, hh = constant(data, offsets)
    held = sorted((int(a).to_bytes(8, "big") + data[q : z + 200].tobytes() + data[f:q].tobytes(), int(q - f), int(c.view(np.int64)), int(d), int(f - offsets[d])) for a, q, z, f, c, d in zip(g, p, last, first, hh, doc, strict=True))
    keys = [x[0] for x in held]
    common = np.array([0, *(op5_suffix._common(a, b, 0) for a, b in zip(keys, keys[1:], strict=False))])
    hit = op5_suffix._repeated_windows(keys, common, np.array([x[1] for x in held]), 200)
    gone = [bytearray(len(t)) for t in texts]
    for row, (_, _, _, d, at) in zip(hit, held, strict=True):
        for w in np.flatnonzero(row):
            gone[d][at + w : at + w + 200] = b"\1" * 200
    assert [sum(x) for x in gone] == [r[2] for r in h.removed([r[:2] for r in local])]


def test_other_lengths_and_empty_table(spark):
    rows = [(k, t, "en", "s", 0, "x", 1) for k, t in enumerate(copies(4, 4, words=60) + [h.prose(77, 30)])]
    assert suffix(spark, rows, 100) == sorted(h.removed([r[:2] for r in rows], 100), key=repr)
    assert suffix(spark, []) == []


def test_loser_tree_merges_front_coded_runs():
    rng = random.Random(6)
    for n_runs in (1, 2, 5, 16):
        runs = [sorted({bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(40))}) for _ in range(n_runs)]
        coded = [op5_suffix.encode_run(r, [(i, 1, 0) for i in range(len(r))]) for r in runs]
        assert [[x[1] for x in op5_suffix.decode_run(c)] for c in coded] == runs
        merged = list(op5_suffix.merge_runs([op5_suffix.decode_run(c) for c in coded]))
        keys = [m[1] for m in merged]
        assert keys == sorted(k for r in runs for k in r)
        for before, m in zip(keys, merged[1:], strict=False):
            k = 0
            while k < min(len(before), len(m[1])) and before[k] == m[1][k]:
                k += 1
            assert m[0] == k
