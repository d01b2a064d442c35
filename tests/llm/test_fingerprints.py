import hashlib
import random

import helpers as h
import pytest
from pyspark.sql import functions as F

from lattica.llm import op1_winnow as op


def picks_of(grams):
    """Rightmost smallest of each window, by definition."""
    out = set()
    for s in range(max(len(grams) - op.W + 1, 1) if grams else 0):
        window = grams[s : s + op.W]
        low = min(window)
        out.add((s + max(k for k, v in enumerate(window) if v == low), low))
    return sorted(out)


def test_picks_by_definition(spark):
    texts = ["", "a", "abc" * 3, "x" * 20_000, h.prose(1, 6000), "é" * 40, "0123456789ab", "ab" * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    grams = {r.i: r.g for r in df.select("i", F.expr(f"transform(sequence(0, greatest(octet_length(t) - {op.K - 1}, 1) - 1), i -> xxhash64(substring(cast(t as binary), i + 1, {op.K})) & {op._HASH}L)").alias("g")).collect()}
    for r in df.select("i", op.winnow(F.col("t").cast("binary")).alias("p")).collect():
        assert [(p.pos, p.hash) for p in r.p] == (picks_of(grams[r.i]) if texts[r.i] else [])


def test_shared_passage_is_found(spark):
    passage = h.prose(5, 12)[: op.W + op.K - 1]
    df = spark.createDataFrame([(h.prose(6, 100) + passage + h.prose(7, 30),), (passage,), (h.prose(8, 50) + passage,)], "t string")
    sets = [set(r[0]) for r in df.select(op.hashes(op.winnow(F.col("t").cast("binary")))).collect()]
    assert set.intersection(*sets)


def test_rows_edited_texts_and_order(spark):
    rows = h.awkward()
    got = op.fingerprints(h.frame(spark, rows).repartition(5)).collect()
    order = sorted(((d, t or "") for d, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert len(got) == len(rows)
    for k, (r, (d, t)) in enumerate(zip(got, order, strict=True)):
        nxt = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (d, len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by_id = {r.doc_id: r for r in got}
    assert by_id[6].fingerprint == by_id[7].fingerprint != by_id[9].fingerprint
    assert by_id[1].fingerprint == by_id[2].fingerprint and by_id[6].near_next == 1.0


def test_edited_fingerprint_equals_that_of_the_edited_text(spark):
    rng = random.Random(3)
    rows = [(k, h.prose(k, rng.choice([1, 3, 8, 20, 200, 4000])), "en", "s", 0, "x", 1) for k in range(40)]
    got = {r.doc_id: r for r in op.fingerprints(h.frame(spark, rows)).collect()}
    texts = [r[1] for r in rows]
    edited = [(k, t[: len(t) - len(t) // 2] + texts[(k + 1) % 40][: len(t) // 2]) for k, t in enumerate(texts)]
    whole = spark.createDataFrame(edited, "k long, t string").select("k", op.winnow(F.col("t").cast("binary")).alias("p"))
    for r in whole.select("k", op.fingerprint(F.col("p")).alias("f")).collect():
        assert got[r.k].edited_fingerprint == r.f


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None, None, None)]])
def test_empty_table_and_single_row(spark, rows):
    assert op.fingerprints(h.frame(spark, rows)).count() == len(rows)
