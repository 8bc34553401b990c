"""The queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docketry.llm.ann import op1_multi_index_hashing
from docketry.llm.bpe import op7_byte_bpe
from docketry.llm.fim import OP13_SQL, op13_fill_in_middle
from docketry.llm.html import op10_html_extraction
from docketry.llm.jaccard import OP6_SQL, op6_ngram_jaccard
from docketry.llm.lines import OP3_SQL, op3_line_dedup
from docketry.llm.packing import op9_packing
from docketry.llm.pii import OP8_SQL, op8_pii
from docketry.llm.quality import op4_quality_rules
from docketry.llm.repair import op11_structure_repair
from docketry.llm.suffixes import OP2_SQL, op2_suffix_array_dedup
from docketry.llm.tokencounts import op12_token_counts
from docketry.llm.warc import op5_warc_derivatives


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": _pipeline} | {f.__name__: f for f in (op1_multi_index_hashing, op2_suffix_array_dedup, op3_line_dedup, op4_quality_rules, op5_warc_derivatives, op6_ngram_jaccard, op7_byte_bpe, op8_pii, op9_packing, op10_html_extraction, op11_structure_repair, op12_token_counts, op13_fill_in_middle)}


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_array_dedup": OP2_SQL, "op3_line_dedup": OP3_SQL, "op6_ngram_jaccard": OP6_SQL, "op8_pii": OP8_SQL, "op13_fill_in_middle": OP13_SQL}
