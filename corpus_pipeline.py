"""From raw documents to packed training sequences, stage by stage.

Each stage takes the documents that the one before it kept, as Parquet, and all
but the last return the columns of ``documents``: quality rules, line dedup,
SimHash near-dedup on five-word shingles at a Jaccard similarity of 0.8 (one
document of each group stays), mixing sources to target weights (a row for each time a document is taken), best-fit packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echosieve.llm.common import named
from echosieve.llm.line_dedup import drop_common_lines
from echosieve.llm.mixing import mixed_documents
from echosieve.llm.near_dedup import one_of_each
from echosieve.llm.packing import pack, pieces
from echosieve.llm.quality import judge
from echosieve.storage import Scratch, discard, materialize

VOCABULARY = "word_bpe_49k.json"


def _as_documents(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with the length of the text as it is now."""
    length = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return rows.select(*(length.alias(c) if c == "n_chars" else named(c) for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return judge(docs, keep_text=True).filter("es_kept").select(*map(named, docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _as_documents(drop_common_lines(docs), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _as_documents(mixed_documents(docs), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(pieces(docs, VOCABULARY))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("simhash near-dedup", near_dedup), ("source mixing", source_mixing), ("best-fit packing", packing)]

#: SQL expresses neither the shingle search nor the tokenizer; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with Scratch() as own:
            kept = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            own.release(kept)
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
