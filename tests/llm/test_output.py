import zlib

import duckdb
import helpers as h
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import op4_packing, op9_ids, op10_mixing, rangecoder


def naive_best_fit(items, capacity):
    bins, out = [], []
    for size, source, cluster in items:
        fits = [(capacity - b["used"], i) for i, b in enumerate(bins) if capacity - b["used"] >= size and not b["s"] & source and not b["c"] & cluster]
        if fits:
            _, i = min(fits)
        else:
            bins.append({"used": 0, "s": 0, "c": 0})
            i = len(bins) - 1
        b = bins[i]
        out.append((i, b["used"]))
        b["used"] += size
        b["s"] |= source
        b["c"] |= cluster
    return out


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 4), st.integers(0, 6)), max_size=60))
@settings(max_examples=300, deadline=None)
def test_best_fit_by_definition(items):
    items = [(n, (1 << s) >> 1, (1 << c) >> 1) for n, s, c in items]
    assert op4_packing.best_fit(items, 30) == naive_best_fit(items, 30)


@pytest.mark.parametrize("shard", [2048, 40])
def test_packing_places_every_token_once(spark, monkeypatch, shard):
    monkeypatch.setattr(op4_packing, "SHARD", shard)
    rows = h.awkward() + [(100 + k, h.prose(k, 5 + 13 * (k % 40)), "en", f"s{k % 3}", 0, "x", 1) for k in range(150)]
    got = op4_packing.pack(op4_packing.items_of(h.frame(spark, rows)), 300).collect()
    want = sorted(len(h.words(r[1])) for r in rows)
    assert sum(r.n_tokens for r in got) == sum(want) and len({(r.doc_id, r.piece) for r in got}) <= len(got)
    bins = {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(r)
    for own in bins.values():
        assert sum(r.n_tokens for r in own) <= 300
        spans = sorted((r.offset, r.offset + r.n_tokens) for r in own)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        for column in ("source", "cluster"):
            names = [r[column] for r in own if r[column] is not None]
            assert len(names) == len(set(names))
    assert op4_packing.pack(op4_packing.items_of(h.frame(spark, []))).count() == 0


def test_bins_meet_across_shards(spark, monkeypatch):
    # one document a shard: only the later rounds can unite
    rows = [(k, h.prose(k, 10), None, None, 0, "x", 1) for k in range(120)]
    items = op4_packing.items_of(h.frame(spark, rows))
    together = op4_packing.fill(op4_packing.pack(items, 100), 100).first()
    monkeypatch.setattr(op4_packing, "SHARD", 8)
    apart = op4_packing.fill(op4_packing.pack(items, 100), 100).first()
    assert together.bins == 12 and together.tokens == apart.tokens == 1200 and apart.bins <= 16
    monkeypatch.setattr(op4_packing, "SHARD", 40)
    same = [(7, "the same words", "en", "s", 0, "x", 1)] * 100
    got = op4_packing.pack(op4_packing.items_of(h.frame(spark, same))).collect()
    assert len(got) == 100 and len({r.bin_id for r in got}) == 100  # one source, one cluster: each alone


@pytest.mark.parametrize("last_rows", [10_000, 2])
def test_mixing_equals_sql(spark, monkeypatch, last_rows):
    monkeypatch.setattr(op10_mixing, "LAST_ROWS", last_rows)
    rows = h.awkward() + [(100 + k, h.prose(k, 1 + k % 37), ["en", "de", None][k % 3], f"src{k % 7}" if k % 11 else None, 0, "x", 1) for k in range(400)]
    rows = [r for r in rows if r[0] != 10]  # interchangeable rows
    plan = op10_mixing.Plan(weights={"domain": {"d0": 5}, "lang": {"en": 3}}, budget=1.2, epochs=2, seed=3)
    docs = h.frame(spark, rows)
    got = sorted(tuple(r) for r in op10_mixing.mix(docs, plan).select("doc_id", "domain", "lang", "source", "n_tokens", "copies").na.fill(-99, ["doc_id"]).collect())
    con = duckdb.connect()
    documents = docs.select("doc_id", "text", "lang", "source").toArrow()  # noqa: F841
    want = sorted(con.sql("select coalesce(doc_id, -99), domain, lang, source, n_tokens, copies from (" + op10_mixing._sql(plan) + ")").fetchall())
    assert got == want
    assert op10_mixing.mix(h.frame(spark, []), plan).count() == 0


def test_mixing_ends_among_equal_orders(spark, monkeypatch):
    # the budget ends among documents without an id, and among rows of one repeated id
    monkeypatch.setattr(op10_mixing, "LAST_ROWS", 2)
    rows = [(None, h.prose(k, 3 + k % 5), "en", "src1", 0, "x", 1) for k in range(60)] + [(7, h.prose(1, 4), "de", "src1", 0, "x", 1)] * 60
    plan = op10_mixing.Plan(budget=0.5, seed=3)
    docs = h.frame(spark, rows)
    got = sorted(tuple(r) for r in op10_mixing.mix(docs, plan).na.fill(-99, ["doc_id"]).collect())
    con = duckdb.connect()
    documents = docs.select("doc_id", "text", "lang", "source").toArrow()  # noqa: F841
    want = sorted(con.sql("select coalesce(doc_id, -99), domain, lang, source, n_tokens, copies from (" + op10_mixing._sql(plan) + ")").fetchall())
    assert got == want
    assert {(r[0], r[5]) for r in got} == {(-99, 0), (-99, 1), (7, 0), (7, 1)}


def test_shortage_goes_to_siblings_first(spark):
    # a/en can't use its share: a/de takes the rest before domain b does
    leaves = spark.createDataFrame([("a", "en", "s", 10), ("a", "de", "s", 500), ("b", "en", "s", 500)], "domain string, lang string, source string, tokens long")
    got = {(r.domain, r.lang): r.epoch * {"en": 10}.get(r.lang, 0) + r.rest for r in op10_mixing.budgets(leaves, op10_mixing.Plan(budget=400 / 1010)).where("domain = 'a'").collect()}
    assert got == {("a", "en"): 10, ("a", "de"): 190}


@given(st.lists(st.integers(0, 65535), max_size=300), st.integers(1, 64))
@settings(max_examples=25, deadline=None)
def test_range_coder_round_trip(ids, block):
    ids = np.array(ids, np.uint32)
    names, lengths, back = rangecoder.unpack(rangecoder.pack([7, None], [len(ids), 0], ids, block=block))
    assert names == [7, None] and lengths.tolist() == [len(ids), 0] and (back == ids).all()


def test_range_coder_adapts_and_checks():
    ids = np.tile(np.array([5, 900, 41, 7], np.uint32), 600)
    raw = rangecoder.pack([1], [len(ids)], ids)
    assert len(raw) < len(ids) / 2
    with pytest.raises(ValueError):
        rangecoder.unpack(raw[:-9] + bytes([raw[-9] ^ 255]) + raw[-8:])
    with pytest.raises(ValueError):
        rangecoder.unpack(raw[:20] + bytes([raw[20] ^ 1]) + raw[21:])


def test_range_coder_many_lanes(monkeypatch):
    monkeypatch.setattr(rangecoder, "LANES", 3)
    ids = np.random.default_rng(1).zipf(1.4, 1000).clip(0, 49_000).astype(np.uint32)
    assert (rangecoder.unpack(rangecoder.pack([1], [1000], ids, block=90))[2] == ids).all()


def test_range_coder_of_many_and_large_ids():
    rng = np.random.default_rng(2)
    ids = np.concatenate((rng.permutation(40_000), rng.integers(0, 1 << 32, 3000))).astype(np.uint32)
    assert (rangecoder.unpack(rangecoder.pack([1], [len(ids)], ids))[2] == ids).all()
    assert sum(rangecoder.classes(40_000)[1]) == 40_000


def test_ids_equal_the_tokenizer(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(op9_ids, "FILE_IDS", 500)
    rows = h.awkward()[:8] + h.awkward()[9:]
    files = op9_ids.write(h.frame(spark, rows))
    got = sorted(op9_ids.digest(files).collect(), key=lambda r: r.start)
    tokenizer = Tokenizer.from_file(op9_ids.tokenizer_path())
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start = 0
    for r, (d, text) in zip(got, order, strict=True):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert sum(len(r.ids) for r in op9_ids.read(files).collect()) == start
    assert op9_ids.digest(op9_ids.write(h.frame(spark, []))).count() == 0


def test_words_that_repeat_are_phrases():
    rng = np.random.default_rng(3)
    sizes = rng.integers(0, 6, 300)
    flat = rng.integers(0, 49_408, int(sizes.sum())).astype(np.uint32)
    words = np.concatenate((rng.zipf(1.3, 4000).clip(1, 200) - 1, np.arange(200, 300), [299]))
    ids = np.concatenate([flat[b - n : b] for b, n in zip(np.cumsum(sizes)[words], sizes[words], strict=True)])
    raw = rangecoder.pack_words([4], np.array([len(ids)]), words, sizes, flat, block=700)
    names, lengths, back = rangecoder.unpack(raw)
    assert names == [4] and lengths.tolist() == [len(ids)] and (back == ids).all()
    # a phrase is one symbol, a word that comes once is as many as it has ids, an empty one is none
    often = np.bincount(words, minlength=300) > 1
    assert rangecoder._HEAD.unpack_from(raw)[-1] == int(np.where(often, np.minimum(sizes, 1), sizes)[words].sum())
    assert len(raw) < len(rangecoder.pack([4], [len(ids)], ids, block=700))


def test_range_coder_finds_any_damage():
    raw = rangecoder.pack([1, 2], [500, 400], np.random.default_rng(4).zipf(1.3, 900).clip(0, 49_000).astype(np.uint32), block=128)
    for at in range(0, len(raw), 7):
        with pytest.raises(ValueError):
            rangecoder.unpack(raw[:at] + bytes([raw[at] ^ 4]) + raw[at + 1 :])


def test_words_are_cut_as_the_tokenizer_cuts():
    import random

    pick = random.Random(3)
    letters = [*"abcXYZTKßéÉÀÿŸñ×÷'|<>=_-.,!?09²½ªºİıœŒ中あ👍", "\u0300", "\u0338", "\u0308", "\u0301", "\u00a0", "\u0085", "\u3000", "\x00", "\x1c", "'s", "'T", "<|startoftext|>", "T\u0308", "e\u0301", " ", "\n", "\x0b", *"etaoin" * 4]
    texts = ["".join(pick.choices(letters, k=pick.randrange(50))) for _ in range(3000)]
    pieces, file = op9_ids._Pieces(op9_ids.tokenizer_path()), op9_ids._File()
    data = [t.encode() for t in texts]
    file.add(list(range(len(texts))), np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in data]))))
    _, lengths, ids = rangecoder.unpack(file.packed(pieces)[0])
    want = [[*e.ids, 1] for e in pieces.whole.encode_batch(texts, add_special_tokens=False)]
    assert lengths.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_a_tokenizer_of_other_rules_gets_whole_words(tmp_path):
    from tokenizers import Tokenizer, normalizers
    import pyarrow as pa

    other = Tokenizer.from_file(op9_ids.tokenizer_path())
    other.normalizer = normalizers.NFD()
    other.save(str(tmp_path / "other.json"))
    pieces = op9_ids._Pieces(str(tmp_path / "other.json"))
    words = ["Été,12", "THE", "the"]
    sizes, flat = pieces.ids(pa.array(words, pa.large_string()))
    want = [other.encode(w, add_special_tokens=False).ids for w in words]
    assert pieces.model is None and sizes.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]


def test_known_pieces_are_forgotten_beyond_the_bound(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(op9_ids, "_KEPT", 3)
    pieces = op9_ids._Pieces(op9_ids.tokenizer_path())
    for words in (["one", "two", "one,two"], ["three", "two!"], ["four", "five", "six", "seven"], ["one"]):
        sizes, flat = pieces.ids(pa.array(words, pa.large_string()))
        want = [pieces.whole.encode(w, add_special_tokens=False).ids for w in words]
        assert sizes.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]
