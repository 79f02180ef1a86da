"""Corpus pipeline: raw documents to token ids, in five stages.

Each stage takes the documents that the one before it kept, all of them, and its decisions take effect; all but the last
return the columns of documents. Between stages the documents are written and read again, so a lost executor costs
one stage at most.

Defined cases, in all stages: an empty table gives no rows; a null text is an empty one and goes at the first stage; documents with a
null doc_id, lang or source stay (a null source is one of its own in the mix, last in order); further columns, whatever their
names, pass through up to the last stage; texts are read whole, however long.

Every stage bounds the batches that Spark hands to Python workers by bytes, in the session (spark.sql.execution.arrow.maxBytesPerBatch, if
it is unset): workers stand beside the executor's heap, two to a task in some plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylake.llm import op2_quality, op4_simhash, op6_mix, op8_langid, op9_bpe
from keylake.llm.common import bounded_batches, held_out, load, materialize, spread


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or the trees' verdict go; rows repeated are judged one by one. Without labels the base rule alone decides."""
    bounded_batches(spark)
    return op2_quality.filtered(docs, op2_quality.train(docs, load(spark, sf_dir, "labels")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or far from every known language, go. Where no document has a lang, nothing is known and all go."""
    bounded_batches(spark)
    return op8_langid.filtered(spark, docs, op8_langid.train(spark, docs.where(~held_out(F.col("doc_id"), op8_langid.FOLDS))))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id (a null one only if there is no other).

    Rows repeated are copies like any other; of rows with one doc_id and text, that with the smallest hash of all its columns stays.
    """
    bounded_batches(spark)
    return op4_simhash.deduplicated(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: a row for each take, text and n_chars cut to the words taken; some twice, some not at all."""
    bounded_batches(spark)
    return op6_mix.mixed(spark, docs)


def bpe_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, decoded of each document of the mix, one row for each of its rows."""
    bounded_batches(spark)
    return op9_bpe.encoded(docs, op9_bpe.default_path(), ("lang", "source"))


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("SimHash near-dedup", simhash_dedup),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", bpe_codec),
]
#: Fitted trees, centroids and merges have no SQL; the tests hold every stage, and run(), against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(load(spark, sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
