"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, mixing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trussline.llm.common import table, written
from trussline.llm.decontaminate import without_leaks
from trussline.llm.language_id import UNKNOWN, identify
from trussline.llm.line_dedup import dedup_lines
from trussline.llm.mixing import mix_sources
from trussline.llm.near_copies import without_near_copies


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter (null ones too), in which no language can be told; learns from all labelled documents
    and writes the predicted language where `lang` is null. Where nothing is labelled, `lang` stays as it is. Texts are read
    whole however long; rows that repeat an id or a text and rows without an id are judged one by one; extra columns stay;
    an empty table gives an empty one."""
    found = identify(docs, docs, keep=tuple(docs.columns)).where(F.col("text").cast("string").rlike(r"\p{L}"))
    filled = F.coalesce("lang", F.nullif("lang_pred", F.lit(UNKNOWN)).cast(docs.schema["lang"].dataType))
    return found.withColumn("lang", filled).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that a document of smaller id holds; n_chars follows the text. Null texts stay null and empty ones empty;
    rows of one id are one document, rows without an id one that comes last; texts are split whole; extra columns stay; an
    empty table gives an empty one."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    kept = dedup_lines(docs, keep=others)
    if "n_chars" in others:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (five-word shingles, similarity 0.8), the smallest id. All texts without a
    word are one group; ties and null ids, long texts and an empty table as in `without_near_copies`; extra columns stay."""
    return without_near_copies(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item. Null and empty texts hold none; items without a word are in no document;
    long texts are read in overlapping chunks; repeated rows are judged alike; an empty table of documents gives an empty
    one, an empty benchmark drops nothing."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of every remaining document the mix takes: one row a row. Null and empty texts have size 0 and give
    nothing; null sources are one source, the last; repeated rows and ids count each; an empty table gives no rows."""
    return mix_sources(docs)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark_leaks", benchmark_leaks), ("mixture", mixture)]

#: SQL can express neither the trained network nor the fingerprints and the schedule.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`: the rows of the last one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
