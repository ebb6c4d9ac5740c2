"""The queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_voronoi, op2_language, op3_toxicity, op4_mixing, op5_bpe, op6_quality, op7_secrets, op8_licenses, op9_simhash, op10_ogg, op11_minimax, op12_middle, op13_trie, oracles
from .shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_voronoi": lambda spark, d: op1_voronoi.search(table(spark, d, "embeddings")),
    "op2_language": lambda spark, d: op2_language.languages(table(spark, d, "documents")),
    "op3_toxicity": lambda spark, d: op3_toxicity.toxicity(table(spark, d, "documents"), table(spark, d, "labels")),
    "op4_mixing": lambda spark, d: op4_mixing.mix(table(spark, d, "documents")),
    "op5_bpe": lambda spark, d: op5_bpe.digests(table(spark, d, "documents")),
    "op6_quality": lambda spark, d: op6_quality.quality(table(spark, d, "documents"), table(spark, d, "labels")),
    "op7_secrets": lambda spark, d: op7_secrets.secrets(table(spark, d, "documents")),
    "op8_licenses": lambda spark, d: op8_licenses.licenses(table(spark, d, "documents")),
    "op9_simhash": lambda spark, d: op9_simhash.near_duplicates(table(spark, d, "documents")),
    "op10_ogg": lambda spark, d: op10_ogg.media(table(spark, d, "documents")),
    "op11_minimax": lambda spark, d: op11_minimax.assigned(table(spark, d, "documents")),
    "op12_middle": lambda spark, d: op12_middle.digests(table(spark, d, "documents")),
    "op13_trie": lambda spark, d: op13_trie.trie(table(spark, d, "conversations")),
}

ORACLES: dict[str, str] = {"op1_voronoi": op1_voronoi.ORACLE, "op4_mixing": oracles.MIXING, "op7_secrets": oracles.SECRETS, "op8_licenses": oracles.LICENSES, "op11_minimax": op11_minimax.ORACLE, "op12_middle": op12_middle.ORACLE, "op13_trie": op13_trie.ORACLE}
