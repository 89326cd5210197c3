"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.op10_toxicity import op10_toxicity
from corpusloom.llm.op1_fingerprints import op1_fingerprints
from corpusloom.llm.op2_language import op2_language_id
from corpusloom.llm.op3_packing import op3_packing
from corpusloom.llm.op4_quality import op4_quality
from corpusloom.llm.op5_html import op5_html_extract
from corpusloom.llm.op6_sharding import op6_sharding, op6_sql
from corpusloom.llm.op7_decontaminate import op7_decontaminate
from corpusloom.llm.op8_simhash_dedup import op8_simhash_dedup
from corpusloom.llm.op9_chat import OP9_SQL, op9_chat_format


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": op1_fingerprints,
        "op2_language_id": op2_language_id,
        "op3_packing": op3_packing,
        "op4_quality": op4_quality,
        "op5_html_extract": op5_html_extract,
        "op6_sharding": op6_sharding,
        "op7_decontaminate": op7_decontaminate,
        "op8_simhash_dedup": op8_simhash_dedup,
        "op9_chat_format": op9_chat_format,
        "op10_toxicity": op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_sharding": op6_sql(), "op9_chat_format": OP9_SQL}
