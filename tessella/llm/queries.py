"""The corpus operators as registered queries, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import chat_format, collocations, near_dedup, substring_dedup, topk_search, vector_codes
from tessella.llm.chat_format import op13_chat_format
from tessella.llm.collocations import op11_collocations
from tessella.llm.fingerprints import op5_fingerprints
from tessella.llm.main_text import op8_html
from tessella.llm.near_dedup import op6_near_dedup
from tessella.llm.packing import op9_packing
from tessella.llm.pii import op1_pii
from tessella.llm.prefix_bpe import op2_bpe
from tessella.llm.sharding import op7_sharding
from tessella.llm.substring_dedup import op3_substring_dedup
from tessella.llm.topk_search import op4_topk
from tessella.llm.toxicity import op10_toxicity
from tessella.llm.vector_codes import op12_vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pii, op2_bpe, op3_substring_dedup, op4_topk, op5_fingerprints, op6_near_dedup, op7_sharding, op8_html, op9_packing, op10_toxicity, op11_collocations, op12_vector_codes, op13_chat_format)}
ORACLES: dict[str, str] = {"op3_substring_dedup": substring_dedup.ORACLE, "op4_topk": topk_search.ORACLE, "op6_near_dedup": near_dedup.ORACLE, "op11_collocations": collocations.ORACLE, "op12_vector_codes": vector_codes.ORACLE, "op13_chat_format": chat_format.ORACLE}
