"""A corpus pipeline of five of the operators in hearthframe.llm; part of that subpackage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hearthframe.llm import contamination, mixing, ngram_join, sharding, toxicity
from hearthframe.llm.common import Scratch, release, scratch_mark, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("ngram_jaccard_join", ngram_join.stage),
    ("benchmark_decontamination", contamination.stage),
    ("mixing", mixing.stage),
    ("sharding", sharding.stage),
]

#: A factorization machine's scores can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder, what it needed for that is deleted."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        mark = scratch_mark()
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        release(spark, mark)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
