"""A corpus pipeline of five operators; each stage works on all that the one before kept.

toxicity    documents whose toxicity is judged 0.5 or more go
simhash     of each group of near-duplicates (similarity 0.8) the document of smallest doc_id stays
substrings  words in windows of 20 that also start earlier go from the texts
benchmark   runs of words that benchmark items share go from the texts
packing     what is left becomes sequences of at most 4096 tokens

All stages but the last return the columns of documents; n_chars follows the text.
A document that loses all its words stays with an empty text. The second stage keeps
one row of each group, whatever doc_ids other groups have: a null doc_id is larger than
any other, and rows of one group and doc_id are settled by a hash of the text. Columns beside
doc_id and text pass through, whatever their names; tables may be empty.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliometer.llm import decontaminate, nearcopies, packing, substrings, toxicity
from foliometer.llm.common import shared_dir, table


def _bare(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns in one, so that no name of theirs meets one that an operator uses."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in others] or [F.lit(None).alias("none")]).alias("others"))


def _whole(out: DataFrame, docs: DataFrame, changed: bool = False) -> DataFrame:
    """The columns of docs again; n_chars, a number, follows a text that may have changed."""
    columns = {c: F.col(c) if c in ("doc_id", "text") else F.col("others").getField(c) for c in docs.columns}
    if changed and "n_chars" in columns and isinstance(docs.schema["n_chars"].dataType, T.NumericType):
        columns["n_chars"] = F.when(F.col("text").isNull(), columns["n_chars"]).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[v.alias(c) for c, v in columns.items()])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain does not judge toxic, unchanged."""
    scored = toxicity.score(_bare(docs), toxicity.chain_of(spark, sf_dir, docs))
    return _whole(scored.where("p_toxic < 0.5"), docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: sets of five-word shingles of similarity 0.8 or more."""
    # what tells rows apart: two hashes of doc_id and text
    keyed = _bare(docs).select("*", F.xxhash64("doc_id", "text").alias("_h1"), F.xxhash64(F.lit("_"), "text", "doc_id").alias("_h2"))
    kept = nearcopies.one_of_each(keyed, ["_h1", "_h2"], shingle_words=5, similarity=0.8).select("_h1", "_h2")
    # rows of the same doc_id and text stay once; the join and the window share one shuffle
    first = Window.partitionBy("_h1", "_h2").orderBy(F.to_json("others"))
    return _whole(keyed.join(kept, ["_h1", "_h2"], "left_semi").withColumn("_n", F.row_number().over(first)).where("_n = 1"), docs)


def substrings_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that an earlier window of 20 words already has."""
    return _whole(substrings.remove_repeats(_bare(docs), window=20), docs, changed=True)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that stand in a window of a benchmark item."""
    return _whole(decontaminate.scan(_bare(docs), table(spark, sf_dir, "benchmark"), remove="spans"), docs, changed=True)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("simhash", simhash_stage),
    ("substrings", substrings_stage),
    ("benchmark", benchmark_stage),
    ("packing", packing_stage),
]

#: The stages rest on a trained model and on XXH64, which SQL has not; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
