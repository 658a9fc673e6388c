"""Registered queries of the corpus operators: each applies one to its whole table with production parameters.

Fingerprints, checksums, tokenisation and learned models are beyond SQL; the tests under ``tests/llm`` hold those queries
against a brute-force version, an exact round trip or held-out labels. The others have an SQL oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (convtrie, decontam, langid, licenses, linededup, lmscore, packing, pii, ranking, sharding, simhash, topk,
               toxicity)
from .common import crc_mod, prepare, table


#: Key of the registered query; a production run passes its own to the operator.
PSEUDONYM_KEY = "registered-query"


def default_tokenizer() -> str:
    """The installed byte-level BPE vocabulary; other files are passed to the operator as a path."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_classes(table(spark, sf_dir, "documents"))


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.hilbert_shards(table(spark, sf_dir, "documents"), shards=16)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.backoff_scores(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(table(spark, sf_dir, "documents"), default_tokenizer(), capacity=2048)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    return convtrie.prefix_trie(table(spark, sf_dir, "conversations"), head_of=conv - conv % 5,
                                head_turns=crc_mod(conv, convtrie.HEAD + 1))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_toxicity, op2_line_dedup, op3_hilbert_shards, op4_decontamination, op5_pseudonyms, op6_lm_scores, op7_simhash,
        op8_language_id, op9_packing, op10_topk, op11_prefix_trie, op12_license_scan, op13_ranked_search)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def prepared(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        return run

    return {name: prepared(fn) for name, fn in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {"op10_topk": topk.ORACLE_SQL, "op11_prefix_trie": convtrie.ORACLE_SQL, "op12_license_scan": licenses.oracle_sql(),
            "op13_ranked_search": ranking.ORACLE_SQL}
