"""The document pipeline: five of the training-data operators in turn.

Each stage takes ``(spark, docs, sf_dir)``, works on all documents that its predecessor kept, and returns
a DataFrame that is written as Parquet and read again as the next one's documents.  All stages but
the last return the columns of ``documents``, whatever other columns there are.

Defined cases, for every stage: null and empty texts are kept as documents of no words; null ids are ids like any other;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memspool.llm import common, op03_tokens, op06_toxicity, op07_simhash, op09_mix, op10_decontam

#: A file of the installed package of public tokenizers.
TOKENIZER = "word_bpe_49k.json"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; null and wordless texts stay, and without labels all do."""
    return op06_toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (Jaccard 0.8 or more, five-word shingles) stays.

    It is that of the smallest id; a null id stays only in a group without others.  All texts without words are one group; of rows with one id the
    smallest hash of the text decides, then that of all columns.
    """
    return op07_simhash.deduplicate(docs, words=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go; without test items all stay."""
    return op10_decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target asks for: none, one or two, equal rows each by itself; wordless ones have size 0."""
    return op09_mix.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in files, and what these hold for each document; a text without tokens is its end id."""
    import public_tokenizers

    return op03_tokens.encode_corpus(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("tokens", tokens),
]

#: Learned scores, hashes and grammar files have no SQL twin; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialize(docs, f"stage-{name}")
    return docs
