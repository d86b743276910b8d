"""A training corpus from raw documents: quality rules, near-duplicate removal, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as Parquet in the shared folder and gives it to the next, so that
a lost executor costs a stage's tasks and not the chain. Stages keep columns beyond those of documents, whatever their names, and take tables without rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontam, jaccard_join, mixing, quality, token_output
from quern.llm.shared import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _held(docs: DataFrame) -> DataFrame:
    """docs with columns beyond those of documents put away in one, so that no name of an operator's clashes with theirs."""
    more = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c not in COLUMNS]
    return docs.select(*[c for c in docs.columns if c in COLUMNS], F.struct(*more).alias("__more")) if more else docs


def _given(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, from an operator's result on what _held gave it."""
    return out.select(*[F.col(c) if c in COLUMNS else F.col(f"__more.c{k}").alias(c) for k, c in enumerate(docs.columns)])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the isolation forest keep. A null or empty text has no words and goes; repeated rows are judged alike; very long texts are judged whole."""
    return _given(quality.judge_quality(_held(docs), table(spark, sf_dir, "labels")).where("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of least id, of each class that links of similarity 0.8 or more over five-word shingles join; of repeated rows one. Texts without words, null ones too, stay, each for itself."""
    return _given(jaccard_join.join_near_duplicates(_held(docs)).where("is_first"), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item. Null and empty texts have none and stay, and so do all rows if the benchmark is empty."""
    return _given(decontam.mark_contaminated(_held(docs), table(spark, sf_dir, "benchmark")).where("not contaminated"), docs)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times. A null text has size 0; null sources are a source of their own, the last; rows equal in id, text and source are taken alike."""
    mixed = mixing.mix_sources(_held(docs).withColumn("__words", mixing.n_words("text")), "__words", id_cols=("doc_id", "text"))
    return _given(mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' rows as read back: document, where its ids start, how many it has and their checksum. A null text is empty and has the end id alone."""
    return token_output.token_digest(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing_to_weights),
    ("token-ID output", token_files),
]

#: Not to be said in SQL: the isolation forest and the tokenizer. tests/llm compares run() with a plain version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
