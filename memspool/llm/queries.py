"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op01_quality, op02_rules, op03_tokens, op04_lines, op05_language, op06_toxicity, op07_simhash, op08_html, op09_mix
from . import op10_decontam as op10_edits
from . import op11_prefixes as op11_trie
from . import op12_merkle as op12_tree
from . import op13_secrets as op13_scan


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_quality.classify_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_rules.quality_rules(_table(spark, sf_dir, "documents"))


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return op03_tokens.encode_corpus(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the lines it had, how many went, and a digest of the text that stays."""
    out = op04_lines.drop_recurring(_table(spark, sf_dir, "documents"), counts=True)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_dropped", F.length(text).cast("long").alias("kept_chars"), F.crc32(text.cast("binary")).alias("kept_crc32"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_language.identify_languages(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_toxicity.classify_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op07_simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_html.extract_pages(_table(spark, sf_dir, "pages"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_mix.mix_report(_table(spark, sf_dir, "documents"))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a test item, with the item and its edit distance."""
    found = op10_edits.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "distance", "end_char")


def op11_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_trie.prefix_trie(_table(spark, sf_dir, "conversations")).drop("digest")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_tree.merkle_manifest(_table(spark, sf_dir, "documents")).drop("depth")


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_scan.secrets_report(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_rules": op2_rules,
    "op3_tokens": op3_tokens,
    "op4_lines": op4_lines,
    "op5_language": op5_language,
    "op6_toxicity": op6_toxicity,
    "op7_simhash": op7_simhash,
    "op8_html": op8_html,
    "op9_mix": op9_mix,
    "op10_decontam": op10_decontam,
    "op11_prefixes": op11_prefixes,
    "op12_merkle": op12_merkle,
    "op13_secrets": op13_secrets,
}

#: The others are not wholly expressible in SQL; tests compare them with brute-force versions.
ORACLES: dict[str, str] = {"op11_prefixes": op11_trie.ORACLE, "op12_merkle": op12_tree.ORACLE}
