"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from graphloom.llm.cap_filters import OP3_SQL, op3_embedding_near_dedup
from graphloom.llm.chat_format import OP10_SQL, op10_chat_format
from graphloom.llm.graph_search import op9_nearest_neighbours
from graphloom.llm.line_dedup import OP2_SQL, op2_line_dedup
from graphloom.llm.packing import op6_best_fit_packing
from graphloom.llm.pii import op5_pii
from graphloom.llm.quality import op8_quality
from graphloom.llm.sentencepiece_codec import op1_sentencepiece
from graphloom.llm.simhash import op7_simhash
from graphloom.llm.toxicity import op4_toxicity

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_line_dedup": op2_line_dedup,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_pii": op5_pii,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_simhash": op7_simhash,
    "op8_quality": op8_quality,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_chat_format": op10_chat_format,
}

SQL = {
    "op2_line_dedup": OP2_SQL,
    "op3_embedding_near_dedup": OP3_SQL,
    "op10_chat_format": OP10_SQL,
}
