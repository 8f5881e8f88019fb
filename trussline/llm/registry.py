"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .ann import op1_nearest_vectors
from .decontaminate import op7_decontaminate
from .language_id import op3_language_id
from .line_dedup import OP4_SQL, op4_line_dedup
from .mixing import op10_mix_sources
from .periodic_runs import op12_periodic_runs
from .phrases import OP11_SQL, op11_collocations
from .quality import op13_quality
from .simhash import op5_simhash_dedup
from .suffix_dedup import op9_suffix_dedup
from .token_counts import op8_token_counts
from .toxicity import op6_toxicity
from .url_filter import OP2_SQL, op2_url_filter


QUERIES = (
    op1_nearest_vectors,
    op2_url_filter,
    op3_language_id,
    op4_line_dedup,
    op5_simhash_dedup,
    op6_toxicity,
    op7_decontaminate,
    op8_token_counts,
    op9_suffix_dedup,
    op10_mix_sources,
    op11_collocations,
    op12_periodic_runs,
    op13_quality,
)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline lies beside the package, so it is imported when it is run: the operators do not need it."""
    from corpus_pipeline import run

    return run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (*QUERIES, pipeline)}


def oracles() -> dict:
    return {"op2_url_filter": OP2_SQL, "op4_line_dedup": OP4_SQL, "op11_collocations": OP11_SQL}
