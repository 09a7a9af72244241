"""A corpus pipeline: five stages over ``documents``, each one of the llm operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
keep the columns of documents.  A stage first releases what the one before left in the driver and on disk.  ``run`` writes each stage's rows as Parquet in the
shared folder and reads them again as the next stage's input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.cluster import release, shared_dir
from scriptorium.llm.op2_minhash import drop_near_duplicates
from scriptorium.llm.op4_mixing import mixed_documents
from scriptorium.llm.op5_bpe import encode, public_vocabulary
from scriptorium.llm.op7_langid import fits_column
from scriptorium.llm.op7_langid import train as train_languages
from scriptorium.llm.op10_toxicity import toxicity_column
from scriptorium.llm.op10_toxicity import train as train_toxicity
from scriptorium.session import attach


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic, each row judged by its own text.

    Null and empty texts stay.  Rows of one id are judged apart.
    """
    release(attach(spark))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train_toxicity(docs, labels, "doc_id", "text", "toxic", F.lit(True), train_docs=2000, train_chars=20_000_000)
    release(spark)
    return docs.where(toxicity_column(model, docs)(F.col("text").cast("string")) < 0.5)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that some language fits, each row judged by its own text.

    A text goes where the language that cuts it into the fewest phrases still needs, for each character, over twice
    the phrases of all labelled texts that were not learnt, and where it has no letter (null texts included).  Where no row has a
    language to learn from, all that have a letter stay.
    """
    release(attach(spark))
    model = train_languages(docs, "text", "lang", train_texts=64, train_chars=24_000)
    text = F.col("text").cast("string")
    if not model.languages:
        return docs.where(text.rlike(r"\p{L}"))
    return docs.where(fits_column(model, docs)(text))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group linked by a similarity of 0.8 or
    more over 5-word shingles.

    Rows without an id and texts without a word stay; rows that repeat the kept id stay.
    """
    release(attach(spark))
    return drop_near_duplicates(docs, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, cut where it takes a part."""
    release(attach(spark))
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, encoded and decoded again.

    Workers know fewer pieces of their own at once than the operator's default lets them, and the two Python passes run
    one after the other, since the executors' heaps are grown by the stages before.  Pieces folded for all tasks are as many as there.
    """
    release(attach(spark))
    return encode(docs, *public_vocabulary(), flush_bytes=1 << 18, most_words=150_000, apart=True)


STAGES = [
    ("toxicity", toxicity),
    ("language", language),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: Learnt stages and the vocabulary's merges are beyond SQL; tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    attach(spark)
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
