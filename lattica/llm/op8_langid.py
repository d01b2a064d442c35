"""Language identification: sparse multinomial logistic regression.

Features are character uni-, bi- and trigrams (letters lower-cased, everything
else a space) hashed to 2**14 cells, with sublinear term frequency times inverse
document frequency, scaled to unit length. Document frequencies are counted over
every training document; weights are fitted by follow-the-regularised-leader
(FTRL-proximal, L1 and L2 penalties) on a bounded, hash-chosen sample of at most
about ``SAMPLE`` training documents a language, and a temperature is fitted on a
held-back fifth of that sample.

Defined results: ``und`` with score 0 for a null text or one without a letter, and
for every text if nothing can be learned; ties between languages go to the first
in alphabetical order; repeated rows count as often as they occur; a very long text is
one document of all its n-grams; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, steps, table

BITS = 14
CELLS = 1 << BITS
#: Documents of a language in the sample that weights are fitted on (in the mean of the hash).
SAMPLE = 500
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.02, 0.1
_STEP_DOCS = 96

_tables: list[np.ndarray] = []


def _lookup() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower-cased form or a space, and whether it's a letter."""
    if not _tables:
        top = 0x110000
        letter = np.fromiter((chr(i).isalpha() for i in range(top)), bool, top)
        low = np.where(letter, np.arange(top), 32).astype(np.uint32)
        for i in np.flatnonzero(letter[:0x2FFF]):
            if len(c := chr(i).lower()) == 1:
                low[i] = ord(c)
        _tables.extend((low, letter))
    return _tables[0], _tables[1]


def terms(data: np.ndarray, offsets: np.ndarray):
    """Term counts of each document: rows, cells, counts (by row, then cell), and whether it has a letter."""
    low, letter = _lookup()
    n = len(offsets) - 1
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    at = lead[offsets]
    if len(points) != at[-1]:  # bytes that aren't UTF-8: each document for itself
        each = [np.frombuffer(data[i:j].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
        points, at = np.concatenate(each), np.cumsum([0, *map(len, each)])
    docs = np.repeat(np.arange(n), np.diff(at))
    has = np.bincount(docs, weights=letter[points], minlength=n) > 0
    c = low[points]
    base = docs << BITS
    keys = [base + ((c * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))]
    h = c * np.uint32(0x9E3779B1)
    for k in (1, 2):
        if len(c) > k:
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + c[k:] * np.uint32(0xC2B2AE3D)
            same = docs[:-k] == docs[k:]
            mixed = h ^ (h >> np.uint32(13))
            keys.append((base[:-k] + ((mixed * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)))[same])
    counts = np.bincount(np.concatenate(keys), minlength=n << BITS)
    found = np.flatnonzero(counts)
    return found >> BITS, found & (CELLS - 1), counts[found], has


def weigh(rows, cells, counts, idf, n: int) -> np.ndarray:
    value = (1 + np.log(counts)) * idf[cells]
    norm = np.sqrt(np.bincount(rows, weights=value * value, minlength=n))
    return value / np.maximum(norm, 1e-12)[rows]


def _frequencies(batches):
    seen, n = np.zeros(CELLS, np.int64), 0
    for batch in batches:
        for _, data, offsets in steps(batch, max_docs=_STEP_DOCS):
            _, cells, _, _ = terms(data, offsets)
            seen += np.bincount(cells, minlength=CELLS)
            n += len(offsets) - 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(CELLS + 1)), pa.array(np.append(seen, n))], names=["cell", "n"])


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of each cell over ``docs``."""
    got = docs.select("text").mapInArrow(_frequencies, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(CELLS + 1)
    n[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return np.log((1 + n[-1]) / (1 + n[:-1])) + 1


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Ftrl:
    """Multinomial FTRL-proximal with elastic net; the last cell is a bias."""

    def __init__(self, n_classes: int):
        self.z, self.n = np.zeros((n_classes, CELLS + 1)), np.zeros((n_classes, CELLS + 1))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[:, at], self.n[:, at]
        return np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0)

    def learn(self, cells, values, label: int) -> None:
        at, x = np.append(cells, CELLS), np.append(values, 1.0)
        w = self.weights(at)
        p = _softmax(w @ x)
        p[label] -= 1
        g = p[:, None] * x
        n = self.n[:, at]
        grown = n + g * g
        self.z[:, at] += g - (np.sqrt(grown) - np.sqrt(n)) / ALPHA * w
        self.n[:, at] = grown


class Model:
    def __init__(self, langs, idf, weights, temperature):
        self.langs, self.idf, self.weights, self.temperature = langs, idf.astype(np.float64), weights, temperature

    def predict(self, data, offsets):
        """Class index (-1: none) and probability of each document."""
        n = len(offsets) - 1
        rows, cells, counts, has = terms(data, offsets)
        value = weigh(rows, cells, counts, self.idf, n)
        logit = np.column_stack([np.bincount(rows, weights=value * w[cells], minlength=n) + w[-1] for w in self.weights])
        p = _softmax(logit / self.temperature)
        best = p.argmax(1)
        return np.where(has, best, -1), np.where(has, p[np.arange(n), best], 0.0)


def fit(docs: DataFrame) -> Model | None:
    """Learns from text and lang of ``docs`` with a non-null lang."""
    docs = docs.where("lang is not null")
    n = {r.lang: r.n for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not n:
        return None
    langs = sorted(n)
    idf = document_frequencies(docs)
    key = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, int(min(1, SAMPLE / n[lang]) * (1 << 30)))])

    def run(batches):
        for batch in batches:
            for part, data, offsets in steps(batch, max_docs=_STEP_DOCS):
                rows, cells, counts, has = terms(data, offsets)
                value = weigh(rows, cells, counts, idf, len(offsets) - 1).astype(np.float32)
                bounds = np.searchsorted(rows, np.arange(len(offsets))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("lang"), pa.array(has), pa.ListArray.from_arrays(bounds, pa.array(cells.astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(value))], names=["key", "lang", "has", "cells", "weights"])

    got = docs.select(key.alias("key"), "lang", "text").where(F.col("key") < share[F.col("lang")]).mapInArrow(run, "key long, lang string, has boolean, cells array<int>, weights array<float>").where("has").orderBy("key", "lang", "cells").toArrow().to_pydict()
    rows = [(langs.index(lang), np.array(c, np.int64), np.array(v)) for lang, c, v in zip(got["lang"], got["cells"], got["weights"], strict=True)]
    back, train = rows[::5] if len(rows) >= 50 else [], [r for i, r in enumerate(rows) if i % 5 or len(rows) < 50]
    ftrl = Ftrl(len(langs))
    for _ in range(EPOCHS):
        for y, c, v in train:
            ftrl.learn(c, v, y)
    weights = ftrl.weights()
    temperature = 1.0
    if back:
        logit = np.array([weights[:, c] @ v + weights[:, -1] for _, c, v in back])
        y = np.array([r[0] for r in back])
        loss = lambda t: -np.log(np.maximum(_softmax(logit / t)[np.arange(len(y)), y], 1e-12)).mean()
        temperature = min(np.geomspace(0.05, 10, 80), key=loss)
    return Model(langs, idf, weights, float(temperature))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score of every document."""
    if model is None:
        return docs.select(F.col("doc_id").cast("long"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        names = np.array([*model_langs, "und"], object)
        for batch in batches:
            for part, data, offsets in steps(batch, max_docs=_STEP_DOCS):
                best, p = shared.value.predict(data, offsets)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names[best], pa.string()), pa.array(p)], names=["doc_id", "lang_pred", "score"])

    model_langs = model.langs
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op8_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    found = identify(docs, fit(docs.where(~out)))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")
