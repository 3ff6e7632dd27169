"""The queries of this subpackage by name, and SQL for those that SQL can state."""

from __future__ import annotations

from .chat import OP8_SQL, op8_chat_format
from .classifier import op5_quality_classifier
from .lines import OP7_SQL, op7_line_dedup
from .mixing import OP6_SQL, op6_mixing
from .passages import OP2_SQL, op2_substring_dedup
from .pii import op3_pii
from .quality_rules import op9_quality_rules
from .sentencepieces import op4_sentencepiece
from .simhash import op1_simhash
from .topk import OP10_SQL, op10_topk

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_pii": op3_pii,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_mixing": op6_mixing,
    "op7_line_dedup": op7_line_dedup,
    "op8_chat_format": op8_chat_format,
    "op9_quality_rules": op9_quality_rules,
    "op10_topk": op10_topk,
}
ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": OP2_SQL,
    "op6_mixing": OP6_SQL,
    "op7_line_dedup": OP7_SQL,
    "op8_chat_format": OP8_SQL,
    "op10_topk": OP10_SQL,
}
