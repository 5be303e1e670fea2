"""A corpus pipeline: quality classifier, near-duplicates, repeated passages, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads; :func:`run` writes each result as Parquet
into the shared folder. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, near_duplicates, packing, quality, substrings
from tidemark.llm.common import materialize, settled, table
from tidemark.llm.queries import tokenizer_path


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, fitted on the labels outside the held-out quarter, doesn't reject.

    Each row is judged by its own text, so null and repeated ids make no difference. Null and empty texts are judged like
    any other; ties at the threshold are kept. Without labelled documents the score is 0.5 and all rows are rejected. An
    empty table gives an empty one."""
    return settled(lambda: quality.accepted(docs, table(spark, sf_dir, "labels")), "good")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates (two-word shingles, as in the operator's own query): the one
    with the smallest id.

    Rows that share an id share a component: all of them stay or go, whatever their texts, but rows that also have the
    same text become one, any of them, as they differ at most in other columns. Texts without words resemble nothing and
    stay; so do rows with a null id, which can't name a component, and of those with equal texts one. An empty table
    gives an empty one."""
    gone = settled(lambda: near_duplicates.near_duplicates(docs, words=2).where("not kept").select(F.col("doc_id").alias("other")).distinct(), "copies")
    text = [F.xxhash64("text"), F.xxhash64(F.lit("second"), "text"), F.length("text")]
    rows = docs.select("doc_id", F.struct(*(docs[c] for c in docs.columns)).alias("row"), *(c.alias(f"k{i}") for i, c in enumerate(text)))
    # by sorted runs: neither texts nor ids have a bound, so nothing is broadcast, whatever its size here
    rows = rows.hint("merge").join(gone, rows["doc_id"] == gone["other"], "left_anti")
    return rows.dropDuplicates(["doc_id", *(f"k{i}" for i in range(len(text)))]).select("row.*")


def new_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words that a smaller id has, too. Texts that lose nothing stay as they are; documents
    that lose all their words go.

    Null, empty and blank texts have no words to lose and stay. Rows with a null id lose nothing and are no source; rows
    that share an id are no sources for each other. n_chars, if there is such a column, follows a text that is cut. An
    empty table gives an empty one."""
    rest = tuple(c for c in docs.columns if c != "doc_id")
    cut = substrings.remove_repeats(docs, carry=rest).where("n_words = 0 or n_removed < n_words")
    whole = F.col("n_removed") == 0
    values = {c: F.col(f"carry_{c}") for c in rest} | {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType)}
    if "n_chars" in rest:
        values["n_chars"] = F.when(whole, F.col("carry_n_chars")).otherwise(F.length("kept_text")).cast(docs.schema["n_chars"].dataType)
    values["text"] = F.when(whole, F.col("carry_text")).otherwise(F.col("kept_text"))
    return cut.select(*(values[c].alias(c) for c in docs.columns))


def weighted_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, each whole: a source may exceed its target by a part of one text.

    A null source is a source of its own. Texts without words add nothing to a mix and go. Null and repeated ids are
    mixed row by row; equal rows are taken alike. An empty table gives an empty one."""
    return mixing.mixed_rows(docs, cut_last=False)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each token piece of each row of the mix is placed: the columns of ``packing.pack``. Null and empty texts are
    single pieces of one id; rows that repeat are packed each; a null id stays null. An empty table gives an empty one."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", good_documents),
    ("minhash_near_dedup", one_of_each),
    ("substring_dedup", new_passages),
    ("source_mix", weighted_mix),
    ("best_fit_packing", packed),
]

#: SQL expresses neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
