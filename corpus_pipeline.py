"""The corpus pipeline: quality rules, near-duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; run() writes each stage's rows as
Parquet into the folder that driver and executors share and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.llm import common, decontamination, near_duplicates, packing, pii, quality
from trialweave.llm.queries import tokenizer_path

COVERAGE = 0.5  # documents with more of their words in test items than this go, others lose the words


def _with_length(docs: DataFrame, names: list[str]) -> DataFrame:
    """The columns as they were, with n_chars, where there is one, as the text is now; null texts keep theirs."""
    kinds = dict(docs.dtypes)
    chars = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(kinds["n_chars"]) if "n_chars" in names else None
    return docs.select(*[chars.alias("n_chars") if n == "n_chars" else F.col(f"`{n}`") for n in names])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor a learned rule rejects; the rules are learned on these documents' labels.

    Rows are judged one by one, whatever their ids, so repeated rows and rows without an id each get their verdict.
    """
    rules = quality.learn_rules(docs, common.table(spark, sf_dir, "labels"))
    return quality.keep(docs, rules)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones (five-word shingles, similarity of 0.8 or more)."""
    return near_duplicates.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of the benchmark; what consists mostly of them goes."""
    out = decontamination.purified(docs, common.table(spark, sf_dir, "benchmark"), max_coverage=COVERAGE)
    return _with_length(out, docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with placeholders for personal data."""
    return _with_length(pii.redact(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequences and offsets."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("decontamination", decontaminate),
    ("personal data", personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: Learned rules, patterns and tokenizers have no SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None
