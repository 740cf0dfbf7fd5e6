"""A training corpus from raw documents, in stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: the documents that stay, with all their columns, or, from the
last, what the token files hold. ``run`` writes each stage's result as Parquet into the shared folder and rereads it, and deletes the tables
that a stage wrote on its way.

Rows without a doc_id pass the first three stages, since nothing is known against them, and end at the mix, which draws by id. A null or empty text
is never toxic by its words, a duplicate or contaminated; it has no words to mix and is the end id alone as tokens. Rows that repeat a doc_id are
judged each by toxicity; one row of an id stays after near-duplicates. Other columns are kept, whatever their names; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontamination, minhash, mixing, tokens, toxicity
from plumbline.llm.common import scratch, table, tidy
from plumbline.llm.queries import tokenizer_path


#: Chunks that a token worker keeps: fewer than where token output is all that executors do, since they keep memory of the stages before.
CHUNKS = 150_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the machine, trained on labels, scores as toxic."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles at a similarity of 0.8 or more connect: the smallest doc_id."""
    return minhash.one_of_each(docs, shingle=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold any window of a benchmark item."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix by source takes it, up to three times."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids as entropy-coded files, and what reading them gives, a row for each document."""
    return tokens.round_trip(docs, tokenizer_path(), cached=CHUNKS)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: Learning, dependent rounding and entropy coding have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
        tidy(spark)
    return docs
