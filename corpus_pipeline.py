"""Five stages from raw documents to packed sequences; each is written as Parquet and read again by the next one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import documents, settle
from barloom.llm.exact import exact_dedup
from barloom.llm.packing import pack
from barloom.llm.passages import remove_repeats
from barloom.llm.perplexity import quality_rules
from barloom.llm.simhash import near_dedup


ROW = "row"


def _numbered(docs: DataFrame) -> DataFrame:
    """With a row id that every scan gives alike: the file that a row is read from, and its place there."""
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    try:
        return docs.withColumn(ROW, place)
    except AnalysisException:  # not read from Parquet files
        return settle(docs).withColumn(ROW, place)


def _under_plain_names(docs: DataFrame, change: Callable[[DataFrame, dict[str, str]], DataFrame]) -> DataFrame:
    """Apply `change` to `docs` under names that clash with nothing; the columns of `docs` come back under their own.

    The row id is a column too, named in the mapping by the empty string.
    """
    plain = [f"column{k}" for k in range(len(docs.columns))]
    of = dict(zip(docs.columns, plain, strict=True)) | {"": ROW}
    out = change(_numbered(docs.toDF(*plain)), of)
    return out.select(*(F.col(p).alias(c) for p, c in zip(plain, docs.columns, strict=True)))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within their language's perplexity band."""
    return _under_plain_names(docs, lambda d, of: quality_rules(d, of["text"], of["lang"]).filter("kept"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return _under_plain_names(docs, lambda d, of: exact_dedup(d, of["text"], of["doc_id"], row_id=of[""]).filter("kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component the row with the smallest doc_id."""
    return _under_plain_names(
        docs, lambda d, of: near_dedup(d, of["text"], of["doc_id"], carry=d.columns, row_id=of[""]).filter("kept")
    )


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the passages that occur elsewhere too; n_chars follows the text."""

    def change(d: DataFrame, of: dict[str, str]) -> DataFrame:
        out = remove_repeats(d, of["text"], texts=of["text"])
        return out.withColumn(of["n_chars"], F.length(of["text"]).cast(d.schema[of["n_chars"]].dataType)) if "n_chars" in of else out

    return _under_plain_names(docs, change)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("repeated_passages", passage_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
