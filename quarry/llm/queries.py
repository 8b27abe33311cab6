"""The thin queries of the training-data operators and their SQL oracles."""

from __future__ import annotations

from quarry.llm import bpe, exact_dedup, language_id, license_scan, line_dedup, mixing, mpeg_audio, ngram_join, secret_scan, toxicity
from quarry.llm.common import documents

QUERIES = {
    "op1_bpe": lambda spark, sf_dir: bpe.digest(documents(spark, sf_dir)),
    "op2_mixing": lambda spark, sf_dir: mixing.digest(documents(spark, sf_dir)),
    "op3_secret_scan": lambda spark, sf_dir: secret_scan.scan(documents(spark, sf_dir)),
    "op4_exact_dedup": lambda spark, sf_dir: exact_dedup.decide(documents(spark, sf_dir)),
    "op5_ngram_join": lambda spark, sf_dir: ngram_join.digest(documents(spark, sf_dir)),
    "op6_language_id": lambda spark, sf_dir: language_id.identify(documents(spark, sf_dir)),
    "op7_toxicity": lambda spark, sf_dir: toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")),
    "op8_line_dedup": lambda spark, sf_dir: line_dedup.digest(documents(spark, sf_dir)),
    "op9_license_scan": lambda spark, sf_dir: license_scan.scan(documents(spark, sf_dir)),
    "op10_mpeg_audio": lambda spark, sf_dir: mpeg_audio.digest(documents(spark, sf_dir)),
}
ORACLES: dict[str, str] = {
    "op2_mixing": mixing.ORACLE,
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
}
