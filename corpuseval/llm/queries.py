"""Registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuseval.llm.byte_bpe import op9_byte_bpe
from corpuseval.llm.decontaminate import OP8_SQL, op8_decontaminate
from corpuseval.llm.embedding_dedup import OP2_SQL, op2_embedding_dedup
from corpuseval.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from corpuseval.llm.language_id import op1_language_id
from corpuseval.llm.line_dedup import OP11_SQL, op11_line_dedup
from corpuseval.llm.quality import op3_quality
from corpuseval.llm.sharding import op10_sharding
from corpuseval.llm.simhash import op7_simhash
from corpuseval.llm.substring_dedup import OP6_SQL, op6_substring_dedup
from corpuseval.llm.url_filter import op4_url_filter
from corpuseval.llm.warc import OP5_SQL, op5_warc
from corpuseval.llm.whitening import op12_whitening

_QUERIES = (op1_language_id, op2_embedding_dedup, op3_quality, op4_url_filter, op5_warc, op6_substring_dedup, op7_simhash, op8_decontaminate, op9_byte_bpe, op10_sharding, op11_line_dedup, op12_whitening, op13_hard_negatives)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {q.__name__: q for q in _QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_dedup": OP2_SQL, "op5_warc": OP5_SQL, "op6_substring_dedup": OP6_SQL, "op8_decontaminate": OP8_SQL, "op11_line_dedup": OP11_SQL, "op13_hard_negatives": OP13_SQL}
