"""Toxicity: class-conditional Kneser-Ney word models.

Each class has an interpolated Kneser-Ney model of expressions: a word's
discounted count, backed off to the discounted count of its head (its first four
letters), backed off to shared continuation counts, the number of different words
of either class that begin with the head. So an expression rare in one class falls
back on the same mass in both, and an unseen inflection of a toxic word on what its
head was seen in.

The evidence of a text is length-normalised: the mean over its expressions of the
difference of the two log-likelihoods, and the same over its one and two strongest
expressions, which a long text would drown. A logistic curve turns evidence into a
score; it is fitted on training rows whose words were not counted.

Counts are taken over every other labelled training row and summed by shuffle under
64-bit hashes of the words and the bytes of the heads themselves. The model is a table
that grows with the vocabulary. Workers hold it whole up to HELD_WORDS words and heads;
of a larger one they hold the words seen most, and a document's other words are joined
to the table by shuffle, so its scores depend on no bound.

Words are runs of letters, lower-cased. Defined results: a null or empty text
has no evidence and gets the curve's value at none; null labels are no labels; a
document labelled twice counts with its largest label; without both classes in
the training rows every score is the share of label 1 (0 without labels);
repeated rows are scored each, and each is counted if its id has a label; a very long
text is one document, whose words are all counted; a score equal to the threshold is
predicted 1; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytescan as b
from .common import attach, fold, materialize, steps, table
from .docstats import LETTER

#: Kneser-Ney discount of both levels: above 1, since a word of one or two toxic rows proves nothing.
DISCOUNT = 2.0
#: Letters (bytes) of a head.
HEAD = 4
#: Training rows, at most, that the logistic curve is fitted on (their words are not counted).
CURVE_ROWS, CURVE_SHARE = 20_000, 0.25
THRESHOLD = 0.3
#: Words and heads with their ratios (16 bytes each) that every worker may hold; of a larger model the words seen most.
HELD_WORDS = 1 << 20
_HELD_KEYS = 1 << 21


def _words(data, offsets):
    """Hashes of all words, their heads, and the words' bounds by document."""
    low = b.LOWER[data]
    if len(data) > 1:
        after_c3 = np.flatnonzero(data[:-1] == 0xC3) + 1
        big = after_c3[(data[after_c3] >= 0x80) & (data[after_c3] <= 0x9E) & (data[after_c3] != 0x97)]
        low[big] += 32
    starts, ends, bounds = b.runs(LETTER[low], offsets)
    head = np.zeros(len(starts), np.int64)
    for j in range(HEAD):
        at = starts + j
        head = (head << 8) | np.where(at < ends, low[np.minimum(at, len(low) - 1)], 0)
    return b.piece_hash(low, starts, ends).view(np.int64), head, bounds


def _count(batches):
    """Words of each partition with their heads, toxic and ordinary counts."""
    held, size = [], 0

    def flush():
        word, head, toxic = (np.concatenate(x) for x in zip(*held, strict=True))
        keys, first, at = np.unique(word, return_index=True, return_inverse=True)
        t = np.bincount(at, weights=toxic, minlength=len(keys)).astype(np.int64)
        n = np.bincount(at, minlength=len(keys))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, head[first], t, n - t)], names=["word", "head", "t", "o"])

    for batch in batches:
        for part, data, offsets in steps(batch):
            word, head, bounds = _words(data, offsets)
            toxic = part.column("toxic").to_numpy(zero_copy_only=False)[b.doc_of(bounds)]
            held.append((word, head, toxic))
            size += len(word)
            if size > _HELD_KEYS:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


def _find(table, keys):
    """Values of the keys in a table of sorted keys and values, and which keys it has."""
    if not len(table[0]):
        return np.zeros(len(keys)), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    return table[1][at], table[0][at] == keys


class Held:
    """What every worker holds: ratios of words and heads, the ratio of unseen heads."""

    def __init__(self, words, heads, other: float, whole: bool):
        self.words, self.heads, self.other, self.whole = words, heads, other, whole

    def parts(self, data, offsets):
        """Of each document's words: number, sum of the ratios, largest and second largest (-inf: none). Words to be joined have no part in the last three."""
        word, head, bounds = _words(data, offsets)
        n, doc = np.diff(bounds), b.doc_of(bounds)
        ratio, known = _find(self.words, word)
        if self.whole:
            got, seen = _find(self.heads, head[~known])
            ratio[~known] = np.where(seen, got, self.other)
            known[:] = True
        total = np.bincount(doc[known], weights=ratio[known], minlength=len(n)).astype(float)  # whole numbers if nothing is known
        ratio[~known] = -np.inf
        top = np.full((2, len(n)), -np.inf)
        some = n > 0
        if some.any():
            top[0][some] = np.maximum.reduceat(ratio, bounds[:-1][some])
            # the second: the largest without the first place of the largest
            at = np.flatnonzero(ratio == top[0][doc])
            ratio[at[np.unique(doc[at], return_index=True)[1]]] = -np.inf
            top[1][some] = np.maximum.reduceat(ratio, bounds[:-1][some])
        return n, total, *top

    def missing(self, data, offsets):
        """Document, hash, head and number of each of its different words that are not held."""
        word, head, bounds = _words(data, offsets)
        rest = np.flatnonzero(~_find(self.words, word)[1])
        word, head, doc = word[rest], head[rest], b.doc_of(bounds)[rest]
        order = np.lexsort((word, doc))
        word, head, doc = word[order], head[order], doc[order]
        first = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])))[: len(word)])
        return doc[first], word[first], head[first], np.diff(np.append(first, len(word)))


def _text_key():
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


class Model:
    """Log-likelihood differences of words and heads as tables, what workers hold of them, and the curve."""

    def __init__(self, words: DataFrame):
        """words: word, head, t, o (toxic and ordinary counts)."""
        spark = words.sparkSession
        under = materialize(words.groupBy("head").agg(F.sum("t").alias("ht"), F.sum("o").alias("ho"), F.count("*").alias("kinds")), "heads")
        loose = lambda c: F.sum(F.least(F.col(c).cast("double"), F.lit(DISCOUNT)))
        w = words.agg(F.sum("t"), F.sum("o"), loose("t"), loose("o"), F.count("*")).first()
        h = under.agg(loose("ht"), loose("ho"), F.count("*")).first()
        self.curve = np.zeros(5)
        self.words = self.heads = None
        if not w[0] or not w[1]:  # a class without words: no word is evidence
            self.held = spark.sparkContext.broadcast(Held((np.zeros(0, np.int64),) * 2, (np.zeros(0, np.int64),) * 2, 0.0, True))
            return
        share = (F.col("kinds") + 0.1) / F.lit(w[4] + 0.1 * (h[2] + 1))
        cut = lambda c: F.greatest(F.col(c) - DISCOUNT, F.lit(0.0))
        back = [F.lit(w[2 + k] / w[k]) * (cut(c) + F.lit(h[k]) * share) / w[k] for k, c in enumerate(("ht", "ho"))]
        backed = under.select("head", back[0].alias("b0"), back[1].alias("b1"), (F.col("ht") + F.col("ho") + 0.1).alias("seen"))
        within = F.least((F.col("t") + F.col("o") + 0.1) / F.col("seen"), F.lit(1.0))
        p = [cut(c) / w[k] + F.col(f"b{k}") * within for k, c in enumerate("to")]
        heads = backed.select("head", (F.log("b0") - F.log("b1")).alias("ratio"))
        # a word of no count above the discount has exactly its head's ratio, and needs no row of its own
        words = words.where((F.col("t") > DISCOUNT) | (F.col("o") > DISCOUNT))
        ratios = attach(words, backed, "head").select("word", (F.log(p[0]) - F.log(p[1])).alias("ratio"), (F.col("t") + F.col("o")).alias("n"))
        self.other = float(np.log(w[2] / w[0] * h[0] / w[0]) - np.log(w[3] / w[1] * h[1] / w[1]))
        whole = words.count() + h[2] <= HELD_WORDS
        most = ratios
        if not whole:
            ratios = materialize(ratios.withColumn("size", F.floor(F.log2("n") * 8)), "ratios")
            least, fits = None, HELD_WORDS
            for size, n in sorted(ratios.groupBy("size").count().collect(), reverse=True):
                fits -= n
                if fits < 0:
                    break
                least = size
            most = ratios.limit(0) if least is None else ratios.where(F.col("size") >= least)
            self.words = ratios.select("word", "ratio") if least is None else ratios.where(F.col("size") < least).select("word", "ratio")
            self.heads = heads
        held = [self._sorted(most.select("word", "ratio")), self._sorted(heads if whole else heads.limit(0))]
        self.held = spark.sparkContext.broadcast(Held(*held, self.other, whole))

    @staticmethod
    def _sorted(df: DataFrame):
        got = df.toArrow()
        keys, values = (got.column(k).to_numpy() for k in (0, 1))
        order = np.argsort(keys)
        return keys[order], values[order]

    def evidence(self, docs: DataFrame, carry: str) -> DataFrame:
        """A column of ``docs`` (it has text) and, for each row, mean ratio, largest, second largest and log length as e1 to e4."""
        held, kind = self.held, docs.schema[carry].dataType.simpleString()

        def run(batches):
            for batch in batches:
                for part, data, offsets in steps(batch):
                    x = [pa.array(x) for x in held.value.parts(data, offsets)]
                    yield pa.RecordBatch.from_arrays([part.column("carry"), part.column("key"), *x], names=["carry", "key", "n", "total", "e2", "e3"])

        def rest(batches):
            for batch in batches:
                for part, data, offsets in steps(batch):
                    doc, *x = held.value.missing(data, offsets)
                    yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(doc)), *(pa.array(y) for y in x)], names=["key", "word", "head", "k"])

        joined = self.words is not None
        key = _text_key() if joined else F.lit(None).cast("binary")
        out = docs.select(F.col(carry).alias("carry"), key.alias("key"), "text").mapInArrow(run, f"carry {kind}, key binary, n long, total double, e2 double, e3 double")
        if joined:
            # by text, as the words of equal texts are the same
            more = docs.select(key.alias("key"), "text").mapInArrow(rest, "key binary, word long, head long, k long").groupBy("key", "word", "head").agg(F.max("k").alias("k"))
            more = attach(more.join(self.words, "word", "left"), self.heads.withColumnRenamed("ratio", "backed"), "head", "left")
            more = more.select("key", "k", F.coalesce("ratio", "backed", F.lit(self.other)).alias("r"))
            more = more.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("r"))))
            second = F.max(F.when((F.col("place") == 2) | (F.col("place") == 1) & (F.col("k") > 1), F.col("r")))
            more = more.groupBy("key").agg(F.sum(F.col("r") * F.col("k")).alias("sum"), F.max("r").alias("r1"), second.alias("r2"))
            none = F.lit(float("-inf"))
            r1, r2 = F.coalesce("r1", none), F.coalesce("r2", none)
            out = out.join(more, "key", "left").select("carry", "n", (F.col("total") + F.coalesce("sum", F.lit(0.0))).alias("total"), F.greatest("e2", r1).alias("e2"), F.greatest(F.least("e2", r1), "e3", r2).alias("e3"))
        low = F.lit(-1.0)
        mean, first = F.col("total") / F.greatest("n", F.lit(1)), F.when(F.col("n") > 0, F.col("e2")).otherwise(low)
        return out.select(F.col("carry").alias(carry), mean.alias("e1"), first.alias("e2"), F.greatest("e3", low).alias("e3"), F.log1p("n").alias("e4"))

    def scored(self, docs: DataFrame, carry: str) -> DataFrame:
        at = sum((F.col(f"e{k}") * float(self.curve[k]) for k in range(1, 5)), F.lit(float(self.curve[0])))
        return self.evidence(docs, carry).select(carry, (1 / (1 + F.exp(-F.greatest(F.least(at, F.lit(500.0)), F.lit(-500.0))))).alias("score"))


def _logistic(x, y, ridge=1e-3) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _counted(rows: DataFrame) -> DataFrame:
    counts = rows.select("text", F.col("toxic").cast("long")).mapInArrow(_count, "word long, head long, t long, o long")
    return materialize(counts.groupBy("word", "head").agg(F.sum("t").alias("t"), F.sum("o").alias("o")), "words")


def fit(docs: DataFrame, labels: DataFrame):
    """``labels``: doc_id, toxic (0 or 1). Returns a Model, or a constant share of label 1."""
    labels = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    if not n.get(0) or not n.get(1):
        return n.get(1, 0) / total if total else 0.0
    share = min(CURVE_SHARE, CURVE_ROWS / total)
    for_curve = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))
    rows = attach(docs.select("doc_id", "text"), labels)
    model = Model(_counted(rows.where(~for_curve)))
    got = model.evidence(rows.where(for_curve), "toxic").toArrow()
    y = got.column("toxic").to_numpy()
    x = np.column_stack([np.ones(len(y)), *(got.column(c).to_numpy() for c in ("e1", "e2", "e3", "e4"))])
    # without both classes among the curve's rows: plain odds of the evidence
    model.curve = _logistic(x, y) if 0 < y.sum() < len(y) else np.array([np.log(n[1] / n[0]) - 3, 4.0, 0.5, 0.5, 0.0])
    return model


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, score of every document."""
    if isinstance(model, float | int):
        return docs.select(F.col("doc_id").cast("long"), F.lit(float(model)).alias("score"))
    return model.scored(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id")


def keep_ordinary(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold."""
    if isinstance(model, float | int):
        return docs if model < threshold else docs.limit(0)
    keyed = docs.withColumn("_text_key", _text_key())
    gone = model.scored(keyed, "_text_key").where(F.col("score") >= threshold).select("_text_key").distinct()
    return attach(keyed, materialize(gone, "toxic"), "_text_key", "left_anti").select(*docs.columns)


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(fold(F.col("doc_id"), 4) != 2).select("doc_id", "toxic")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Learns from labels.toxic of the documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, training_labels(table(spark, sf_dir, "labels"))))
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
