"""From raw documents to packed training bins: five stages, each on what the one before kept.

Every stage is a function (spark, docs, sf_dir) -> DataFrame. run() writes each
stage's result as Parquet in the shared folder and hands the reread table on. All but
the last return the columns of ``documents``. run() keeps the scratch tables of each of its
stages in an area of their own and deletes it when the stage's result is written.

Defined results, for every stage: a document without an id takes part as its text
demands (near duplicates links documents by id, so there it stays); null or empty texts
have no words and stay, unless all of a text is cut as a repeat; null lang and source are values of their
own; very long texts are documents like others; ties follow the operator's docstring; equal rows are
copies of each other, of which near_duplicates keeps one; an empty table gives an empty
result; extra columns go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import op4_packing, op5_suffix, op6_toxicity, op7_neardup, op10_mixing
from lattica.llm.common import discard, materialize, scratch_area, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Four fifths of the tokens at hand, each document at most once, English at twice the other languages' weight.
MIX = op10_mixing.Plan(weights={"lang": {"en": 2}}, budget=0.8, epochs=1, seed=29)


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose score reaches the operator's threshold; a document without an id is scored too."""
    labels = op6_toxicity.training_labels(table(spark, sf_dir, "labels"))
    return op6_toxicity.keep_ordinary(_columns(docs), op6_toxicity.fit(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the document with the smallest doc_id stays; of rows with equal id and text one stays."""
    return op7_neardup.keep_first(_columns(docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 200 bytes that occur elsewhere out of the texts; a document of which nothing is left goes."""
    cut = op5_suffix.remove_repeats(_columns(docs))
    left = cut.where("n_removed = 0 or n_removed < n_bytes")
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("long").alias("n_chars"))


def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows that the mix selects, also such without an id or of a repeated id."""
    return op10_mixing.mix(docs, MIX, COLUMNS).where("copies > 0").select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document, with its bin."""
    return op4_packing.pack(op4_packing.items_of(docs))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("target_weights", target_weights), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        with scratch_area(spark, f"stage-{name}") as drop:
            made = stage(spark, docs, sf_dir)
        with scratch_area(spark, "pipeline"):
            docs = materialize(made, name)
        drop()
        if before is not None:
            discard(before)
        before = docs
    return docs


#: SQL can't express the signatures, the models and the packing; tests hold the stages against brute force.
ORACLE_SQL = None
