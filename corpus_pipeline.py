"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and works on all rows of its input; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelweave.llm import decontaminate, mixing, quality, simhash, token_files
from pixelweave.llm.common import materialize, remove, run_dir, scratch, table
from pixelweave.llm.queries import MIX_WEIGHTS


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: those that share 0.8 of their five-word shingles or more."""
    return simhash.keep_first(docs, width=5, similarity=0.8)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to the target weights, each document at most once."""
    return mixing.mix(docs, fraction=0.8, weights=MIX_WEIGHTS, max_epochs=1, only_rows=True)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: one row per document."""
    path = run_dir(spark, "pipeline-tokens")
    token_files.write_tokens(docs, path, end_id=2)
    return token_files.checksums(token_files.read_tokens(spark, path))


STAGES = [("quality rules", quality_stage), ("near-duplicates", dedup_stage), ("decontamination", decontaminate_stage), ("mixing", mix_stage), ("tokens", tokens_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's result is written to the shared folder; then what it worked with, and the result before it,
    are removed."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with scratch() as keep:
            docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"), keep)
        remove(before)
        before = list(keep)
    out = STAGES[-1][1](spark, docs, sf_dir)
    remove(before)  # the token files are written
    return out


#: The stages hash and learn in ways that SQL can't express.
ORACLE_SQL = None
