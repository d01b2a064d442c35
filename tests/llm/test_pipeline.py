import os
import random

import helpers as h
import pytest

SF = "/root/testdata/sf0.001"


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_runs_over_the_smallest_tables(spark):
    import corpus_pipeline as c

    got = c.run(spark, SF).collect()
    ids = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert got and {r.doc_id for r in got} <= ids
    assert len({(r.doc_id, r.piece) for r in got}) == len(got)


def test_stages_take_effect(spark, tmp_path):
    import corpus_pipeline as c
    from lattica.llm.common import materialize

    rng, rows, marks = random.Random(1), [], []
    passage = h.prose(777, 70)
    for k in range(160):
        w = h.prose(2000 + k, 100).split()
        toxic = k % 5 == 0
        for _ in range(3 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["vilezor", "gruntok"]))
        rows.append((k, " ".join(w), "en", f"src{k % 4}", 0))
        marks.append((k, 1, int(toxic)))
    clean = [k for k in range(160) if k % 5]
    rows += [(1000 + k, rows[k][1] + " end", "en", "src1", 0) for k in clean[:5]]
    rows += [(1100 + k, h.prose(3000 + k, 60) + " " + passage + " " + h.prose(3100 + k, 60), "de", "src2", 0) for k in range(4)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    held = {}
    for name, stage in c.STAGES:
        docs = materialize(stage(spark, docs, str(tmp_path)), name)
        held[name] = docs
        if name != "packing":
            assert docs.columns == list(c.COLUMNS)
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in held.items()}
    assert not ids["toxicity"] & {k for k in range(160) if k % 5 == 0} and set(clean) <= ids["toxicity"]
    assert ids["near_duplicates"] == ids["toxicity"] - {1000 + k for k in clean[:5]}
    for r in held["repeated_passages"].where("doc_id >= 1100").collect():
        assert passage not in r.text and r.n_chars == len(r.text)
    assert {r.doc_id for r in held["packing"].collect()} == ids["target_weights"] <= ids["repeated_passages"]


def test_target_weights_keeps_the_rows_of_the_mix(spark):
    from collections import Counter

    import corpus_pipeline as c
    from lattica.llm import op10_mixing

    ids = [None] * 20 + [7] * 20 + list(range(100, 120))
    rows = [(d, h.prose(4000 + k, 5 + k % 9), "en" if k % 2 else None, f"src{k % 3}", k) for k, d in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = Counter((r.doc_id, r.n_tokens) for r in op10_mixing.mix(docs, c.MIX).where("copies > 0").collect())
    kept = c.target_weights(spark, docs, "")
    assert kept.columns == list(c.COLUMNS)
    kept = [tuple(r) for r in kept.collect()]
    assert set(kept) <= set(rows) and len(set(kept)) == len(kept) < len(rows)
    assert Counter((r[0], len(h.words(r[1]))) for r in kept) == want
    assert any(r[0] is None for r in kept)


def through(spark, rows, marks, path):
    """What each stage keeps of the rows."""
    import corpus_pipeline as c
    from lattica.llm.common import materialize

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(*r[:4], None if r[1] is None else len(r[1])) for r in rows], schema).write.parquet(f"{path}/documents.parquet")
    docs, held = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in c.STAGES:
        docs = materialize(stage(spark, docs, str(path)), name)
        held[name] = docs
    return held


def test_awkward_and_repeated_rows_in_every_stage(spark, tmp_path):
    import corpus_pipeline as c

    clean = [(1000 + k, h.prose(5000 + k, 60), "en", f"src{k % 3}") for k in range(40)]
    toxic = [(2000 + k, h.prose(6000 + k, 30) + " vilezor gruntok vilezor " + h.prose(6100 + k, 30), "en", "src1") for k in range(12)]
    without = [(None, h.prose(7000 + k, 50), "de", None) for k in range(30)]
    rows = clean + clean[:5] + toxic + without + without[:1] + [r[:4] for r in h.awkward()]
    held = through(spark, rows, [(r[0], 1, int(r[0] >= 2000)) for r in clean + toxic], tmp_path)
    rows_of = {n: [tuple(r) for r in d.collect()] for n, d in held.items()}
    ids = {n: [r[0] for r in rows_of[n]] for n in rows_of}
    assert not any(2000 <= (i or 0) < 2012 for i in ids["toxicity"]) and ids["toxicity"].count(1000) == 2
    for name in ("near_duplicates", "repeated_passages"):
        assert all(ids[name].count(r[0]) == 1 for r in clean) and ids[name].count(None) == 31, name
    texts = {r[0]: r[1] for r in rows_of["repeated_passages"]}
    assert all(texts[r[0]] == r[1] for r in clean)
    assert ids["target_weights"].count(None) > 0 and set(ids["packing"]) == set(ids["target_weights"])
    assert sum(r.n_tokens for r in held["packing"].collect()) == sum(len(h.words(r[1])) for r in rows_of["target_weights"])
    got = c.run(spark, str(tmp_path))
    assert {r.doc_id for r in got.collect()} == set(ids["packing"])


def test_an_empty_table_in_every_stage(spark, tmp_path):
    held = through(spark, [], [], tmp_path)
    assert [d.count() for d in held.values()] == [0] * 5


def test_frames_that_are_held_survive_a_stage(spark, tmp_path):
    import corpus_pipeline as c
    from lattica.llm import op2_quality

    rows = [(k, h.prose(k, 30), "en", "src1") for k in range(30)]
    held = through(spark, rows, [(k, k % 2, 0) for k in range(30)], tmp_path)
    scored = op2_quality.op2_quality(spark, str(tmp_path))
    c.run(spark, str(tmp_path)).count()
    c.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).count()
    assert scored.count() == 30 and held["target_weights"].count() > 0
