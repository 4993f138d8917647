"""From raw documents to packed training sequences.

The stages, in order: quality rules drop rejected documents, near-dedup keeps one of each group, personal
data is masked, sources are mixed to their target weights, and the mixed documents are packed. Each takes
and returns the columns of documents, but the last, which returns the pieces of the packed sequences.

Nulls: a null text has no words, so quality rules drop it; rows without an id are documents of their own, and a null source is one
more source. Repeated rows and near copies leave one row, the one of least id. Ties are settled as each operator says. Texts
of any length go through whole. An empty table gives no rows. Columns beside those of documents are carried up to the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm import mixing, neardup, packing, pii, quality
from colloquy.llm.common import stored
from colloquy.llm.queries import tokenizer_path


#: Near copies from this Jaccard similarity on, in percent, are one group; op5's 85 binds that query alone.
NEAR = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs, NEAR)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("personal data", personal_data), ("source mix", source_mix), ("packing", sequence_packing)]

#: The label model, the tagger, hash orders and the tokenizer have no SQL form; tests hold the stages
#: against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents, each stored in the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
