"""The registered queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.ball_codes import OP11_SQL, op11_vector_codes
from ledgerloom.llm.decontamination import OP6_SQL, op6_decontamination
from ledgerloom.llm.jaccard_join import op1_jaccard_join
from ledgerloom.llm.language_id import language_of_pages, op7_language_id
from ledgerloom.llm.mixing import op3_context_mixing
from ledgerloom.llm.packing import op9_packing
from ledgerloom.llm.quality_classifier import op4_quality_classifier
from ledgerloom.llm.quality_rules import OP5_SQL, op5_quality_rules
from ledgerloom.llm.repeats import OP8_SQL, op8_repeats
from ledgerloom.llm.token_counts import op10_token_counts
from ledgerloom.llm.token_files import op12_token_files
from ledgerloom.llm.toxicity import op2_toxicity
from ledgerloom.llm.turn_repair import OP13_SQL, op13_conversation_repair

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_toxicity": op2_toxicity,
    "op3_context_mixing": op3_context_mixing,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_quality_rules": op5_quality_rules,
    "op6_decontamination": op6_decontamination,
    "op7_language_id": op7_language_id,
    "language_of_pages": language_of_pages,
    "op8_repeats": op8_repeats,
    "op9_packing": op9_packing,
    "op10_token_counts": op10_token_counts,
    "op11_vector_codes": op11_vector_codes,
    "op12_token_files": op12_token_files,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES: dict[str, str] = {
    "op5_quality_rules": OP5_SQL,
    "op6_decontamination": OP6_SQL,
    "op8_repeats": OP8_SQL,
    "op11_vector_codes": OP11_SQL,
    "op13_conversation_repair": OP13_SQL,
}
