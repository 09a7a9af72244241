"""The thin ``opN_<name>`` queries over the tables of a data folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from ..session import attach
from .op1_warc import archive
from .op2_minhash import near_duplicates
from .op3_shards import balanced_shards
from .op4_mixing import mix
from .op5_bpe import encode, public_vocabulary
from .op6_topk import top_k
from .op7_langid import held_out, identify
from .op8_fingerprints import edited_fingerprints
from .op9_lm import score_documents
from .op10_toxicity import score_toxicity
from .op11_packing import pack
from .op11_packing import public_vocabulary as packing_vocabulary
from .op12_fim import fill_in_middle, restored, sha256
from .op13_spelling import spelling_groups, spelt_words
from .oracles import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return attach(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archive(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_prefix_sum_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(_table(spark, sf_dir, "documents"))


def op4_hypergeometric_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(_table(spark, sf_dir, "documents"), *public_vocabulary())


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_cross_parsing_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = held_out("doc_id", 4, 2)
    found = identify(docs, ~held)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op8_one_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(_table(spark, sf_dir, "documents"))


def op9_gru_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = held_out("doc_id", 5, 1)
    found = score_documents(_table(spark, sf_dir, "documents"), ~held)
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_nb_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = held_out("doc_id", 5, 0)
    found = score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ~held)
    return found.select("doc_id", held.alias("held_out"), "score", "predicted")


def op11_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), packing_vocabulary())


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(_table(spark, sf_dir, "documents"))
    digests = sha256("output").alias("output_sha256"), sha256(restored("output", "form")).alias("restored_sha256")
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(spelt_words(_table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit() and callable(v)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
