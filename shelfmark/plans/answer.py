"""The search and answer chain: one keyword search per question, its best hits as one numbered context."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as V
from ..functions.evidence import cited_ordinals
from ..operators import retrieval, search


def contexts(documents: DataFrame, questions: DataFrame, mode: str = "balanced") -> DataFrame:
    """Numbered context of each question from its best documents (id, filename, text); the number of hits
    follows the mode."""
    k = V.MODE_SIZES[mode]
    hits = retrieval.bm25(documents.select("id", "text"), questions, k)
    described = hits.withColumnRenamed("rank", "place").join(
        documents.select("id", "filename", F.substring("text", 1, 500).alias("excerpt")), "id")
    return search.rag_context(described, "query_id", [F.col("place")], k)


def citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources cited in given answers by superscript number. ``answers`` hold group and answer, ``sources``
    group, ordinal and source_id; numbers without a source find no partner."""
    cited = answers.select("group", F.explode(cited_ordinals(F.col("answer"))).alias("ordinal"))
    return cited.join(sources, ["group", "ordinal"])
