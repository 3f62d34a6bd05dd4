"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tamarack.llm.bpe import op4_byte_bpe
from tamarack.llm.chat import OP1_SQL, op1_chat_snapshots
from tamarack.llm.decontamination import OP11_SQL, op11_decontamination
from tamarack.llm.language import op10_language_id
from tamarack.llm.line_dedup import OP2_SQL, op2_line_dedup
from tamarack.llm.media import op6_media
from tamarack.llm.packing import op5_packing
from tamarack.llm.ranked_search import OP13_SQL, op13_ranked_search
from tamarack.llm.simhash import op3_simhash
from tamarack.llm.token_counts import op9_token_counts
from tamarack.llm.toxicity import op7_toxicity
from tamarack.llm.vectors import op8_vectors
from tamarack.llm.whitening import op12_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_snapshots": op1_chat_snapshots,
    "op2_line_dedup": op2_line_dedup,
    "op3_simhash": op3_simhash,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_packing": op5_packing,
    "op6_media": op6_media,
    "op7_toxicity": op7_toxicity,
    "op8_vectors": op8_vectors,
    "op9_token_counts": op9_token_counts,
    "op10_language_id": op10_language_id,
    "op11_decontamination": op11_decontamination,
    "op12_whitening": op12_whitening,
    "op13_ranked_search": op13_ranked_search,
}

ORACLE_SQL: dict[str, str] = {"op1_chat_snapshots": OP1_SQL, "op2_line_dedup": OP2_SQL, "op11_decontamination": OP11_SQL, "op13_ranked_search": OP13_SQL}
