"""Queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import op9_byte_bpe
from .embedding_dedup import OP3_SQL, op3_embedding_dedup
from .fill_in_middle import OP13_SQL, op13_fill_in_middle
from .html_text import op1_html_text
from .language import op4_language_id
from .neighbours import op2_nearest_neighbours
from .packing import op6_packing
from .sharding import op7_sharding
from .simhash import op10_simhash
from .suffix_dedup import op12_suffix_dedup
from .toxicity import op5_toxicity
from .url_filter import OP8_SQL, op8_url_filter
from .vector_codes import OP11_SQL, op11_vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_text": op1_html_text,
        "op2_nearest_neighbours": op2_nearest_neighbours,
        "op3_embedding_dedup": op3_embedding_dedup,
        "op4_language_id": op4_language_id,
        "op5_toxicity": op5_toxicity,
        "op6_packing": op6_packing,
        "op7_sharding": op7_sharding,
        "op8_url_filter": op8_url_filter,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_simhash": op10_simhash,
        "op11_vector_codes": op11_vector_codes,
        "op12_suffix_dedup": op12_suffix_dedup,
        "op13_fill_in_middle": op13_fill_in_middle,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_embedding_dedup": OP3_SQL, "op8_url_filter": OP8_SQL, "op11_vector_codes": OP11_SQL, "op13_fill_in_middle": OP13_SQL}
