"""The registered queries of this subpackage, one for each numbered operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dayline.llm import bpe_automaton, centroids, exact_dedup, language_id, line_dedup, mixing, near_dup, nn_descent, pii, quality, repair, simhash, spelling

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op5_nn_descent": nn_descent.op5_nn_descent,
    "op4_repair_shards": repair.op4_repair_shards,
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_pii_boosting": pii.op2_pii_boosting,
    "op10_soft_mixing": mixing.op10_soft_mixing,
    "op8_minhash_near_dedup": near_dup.op8_minhash_near_dedup,
    "op3_language_gru": language_id.op3_language_gru,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_bpe_automaton": bpe_automaton.op7_bpe_automaton,
    "op9_quality_discriminant": quality.op9_quality_discriminant,
    "op11_simhash": simhash.op11_simhash,
    "op12_spelling": spelling.op12_spelling,
    "op13_centroids": centroids.op13_centroids,
}

ORACLE_SQL: dict[str, str] = {
    "op6_exact_dedup": exact_dedup.SQL,
    "op13_centroids": centroids.SQL,
}
