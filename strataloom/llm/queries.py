"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, hard_negatives, language_id, line_dedup, mixing, near_dups, outliers, packing, secrets, superkmers, toxicity, wrappers


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_mix(spark, sf_dir):
    return mixing.mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op2_line_dedup(spark, sf_dir):
    d = line_dedup.dedup_lines(_docs(spark, sf_dir).select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op3_language_id(spark, sf_dir):
    return language_id.identify(_docs(spark, sf_dir))


def op4_near_dups(spark, sf_dir):
    return near_dups.near_duplicates(_docs(spark, sf_dir))


def op5_html(spark, sf_dir):
    return wrappers.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_secrets(spark, sf_dir):
    return secrets.scan_paths(_docs(spark, sf_dir)).drop("blob")


def op7_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints(_docs(spark, sf_dir))


def op8_substring_dedup(spark, sf_dir):
    return superkmers.remove_repeats(_docs(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_packing(spark, sf_dir):
    return packing.pack(_docs(spark, sf_dir), vocabulary())


def op10_quality(spark, sf_dir):
    return outliers.judge(_docs(spark, sf_dir)).drop("distance2")


def op11_toxicity(spark, sf_dir):
    return toxicity.score(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_hard_negatives(spark, sf_dir):
    return hard_negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    f.__name__: f
    for f in (op1_mix, op2_line_dedup, op3_language_id, op4_near_dups, op5_html, op6_secrets, op7_fingerprints, op8_substring_dedup, op9_packing, op10_quality, op11_toxicity, op12_hard_negatives)
}
ORACLE_SQL = {"op1_mix": mixing.ORACLE_SQL, "op2_line_dedup": line_dedup.ORACLE_SQL, "op8_substring_dedup": superkmers.ORACLE_SQL, "op12_hard_negatives": hard_negatives.ORACLE_SQL}
