"""One query for each corpus operator, over the whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (
    decontaminate,
    license_scan,
    line_dedup,
    nb_svm,
    oracles,
    pii_surrogates,
    piece_dropout,
    quality_risk,
    shard_balance,
    simhash_anchor,
    token_alignment,
    url_reputation,
    warc,
    whitening,
)
from tessera.llm.common import table

#: (action, host, path)
RULES = [("block", "com", "en/"), ("allow", "example.com", "en/7"), ("allow", "net", "de/"), ("block", "example.net", "de/8"), ("block", "org", "es/")]
#: The model file of the segmentation: a parameter, any BPE model with byte fallback.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The two tokenizers that are aligned: a byte-level BPE and one with byte fallback; parameters as well.
ALIGNED = ("/opt/tokenizers/byte_bpe_50k.json", MODEL)
#: The key of the surrogates. In production it comes from a store of secrets.
SURROGATE_KEY = b"not a secret: for tests"


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), RULES)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op3_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(table(spark, sf_dir, "pages"))


def op4_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = piece_dropout.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), MODEL)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "lossless")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii_surrogates.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)
    return done.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), "entities")


def op7_shard_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = shard_balance.shard(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_simhash_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = simhash_anchor.near_duplicates(table(spark, sf_dir, "documents"))
    return done.select("doc_id", simhash_anchor.hex_fingerprint().alias("fingerprint"), "component_id")


def op9_quality_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_risk.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op11_nb_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nb_svm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = token_alignment.cross_align(table(spark, sf_dir, "documents").select("doc_id", "text"), *ALIGNED)
    return done.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_url_reputation, op2_line_dedup, op3_warc_chain, op4_piece_dropout, op5_decontaminate, op6_pii_surrogates,
        op7_shard_balance, op8_simhash_anchor, op9_quality_risk, op10_license_scan, op11_nb_svm, op12_token_alignment,
        op13_whitening,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_reputation": oracles.op1(RULES),
        "op2_line_dedup": oracles.OP2,
        "op3_warc_chain": oracles.OP3,
        "op9_quality_risk": oracles.op9(),
        "op10_license_scan": oracles.op10(),
    }
